"""Language-model scores from a hashed maximum-entropy model.

The next token is predicted from hashed n-gram and skip features of the
tokens before it (the last token, the one before that with the last skipped,
and the pair), through a softmax factored by class: first the class, then the
token within its class.  The ``HEAD`` most frequent training tokens form
classes of ``CLASS_SIZE``; one more class, the tail, holds every other token.
Within the tail a token has its absolutely discounted relative frequency, and
the discounted mass is the probability of an unknown token, so the model is a
distribution over the known tokens and one unknown token, as the base is.

Training.  Token counts cover every training text.  Feature weights start at
zero above the unigram biases and are moved by distributed gradient updates:
each worker sums observed less expected feature counts over its share of the
training positions (all positions of every training text), the sums meet in
one table, and each weight moves by the damped log ratio of observed to
expected counts, the step iterative scaling takes along that gradient.  Equal
events (context buckets, class, token) are one row with their number: workers
count theirs while scanning, a shuffle by (context, class) adds them up, and a
round takes each distinct context and class once, however often it occurs.

Plan.  Three scans: counts (combined per worker, then shuffled by token),
events, scores.  Only ``TOP`` tokens of at most ``MAX_TOKEN`` bytes and
the weights reach the driver (both bounded by parameters).  What a text has of
rarer tokens leaves the scoring scan as (row, token, n) and meets its count in
a shuffled join; such tokens are rare by construction, and a token unknown to
training that is common elsewhere is split by adaptive execution.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evtrail.llm.common import in_arrow, materialize, read_table, text_bytes
from evtrail.llm.registry import query

TOP = 1 << 17             # tokens whose counts every worker has
MAX_TOKEN = 64            # bytes; longer tokens are joined like rare ones
HEAD, CLASS_SIZE = 1024, 32
BUCKETS = 512             # of each feature template
OWN = 319                 # contexts with a bucket of their own; then the start, then hashed endings
TEMPLATES = 3
ROUNDS = 4
STEP = 0.35
PRIOR = 8.0               # added to observed and expected counts
FOLDS = 10                # remainder 0 is held out
_FLUSH = 300_000
_EVENTS = 1 << 21         # positions a worker has in hand before it counts equal ones
_BLOCK = 1 << 14


def remainder(col: str):
    """crc32 of the id as text, modulo the folds (a null id counts as empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def tokens_of(text: bytes) -> list[bytes]:
    """Lower-cased words, then the end token (empty, as no word is)."""
    return [*text.lower().split(), b""]


# ------------------------------------------------------------ counts -----

def _count_batches(batches):
    import pyarrow as pa
    counts: Counter = Counter()

    def flush():
        out = pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["token", "n"])
        counts.clear()
        return out

    for b in batches:
        for text in b.column(0):
            counts.update(tokens_of(text.as_py()))
            if len(counts) > _FLUSH:
                yield flush()
    yield flush()


def token_counts(texts: DataFrame) -> DataFrame:
    """``texts``: one binary column.  Returns ``token``, ``c``."""
    return in_arrow(texts, _count_batches, "token binary, n long").groupBy("token").agg(F.sum("n").alias("c"))


# ------------------------------------------------------------- model -----

@dataclass
class Vocabulary:
    """Bounded part of the counts, most frequent first, and corpus totals."""
    tokens: list[bytes]
    counts: np.ndarray
    total: int            # N
    types: int            # V
    tail_total: int
    tail_types: int
    discount: float

    @property
    def head(self) -> int:
        return min(HEAD, len(self.tokens))

    def base_log10(self, c):
        return np.log10((c + 0.1) / (self.total + 0.1 * (self.types + 1)))

    def tail_log10(self, c):
        """Within the tail: known tokens by discounted count, the unknown one by what that leaves."""
        if not self.tail_total:
            return np.zeros_like(np.asarray(c, float))
        unknown = self.discount * self.tail_types
        c = np.asarray(c, float)
        return np.log10(np.where(c > 0, np.maximum(c - self.discount, 1e-9), unknown) / self.tail_total)


@dataclass
class Weights:
    """``cls``: (buckets, classes + 1); ``word``: (buckets, classes, size)."""
    cls_bias: np.ndarray
    word_bias: np.ndarray
    cls: np.ndarray
    word: np.ndarray


def classes(vocab: Vocabulary) -> int:
    return -(-vocab.head // CLASS_SIZE)


def start_weights(vocab: Vocabulary) -> Weights:
    k, n = classes(vocab), TEMPLATES * BUCKETS
    padded = np.zeros(k * CLASS_SIZE)
    padded[:vocab.head] = vocab.counts[:vocab.head]
    by_class = padded.reshape(k, CLASS_SIZE)
    mass = np.append(by_class.sum(1), max(vocab.tail_total, 1.0))
    with np.errstate(divide="ignore", invalid="ignore"):
        word_bias = np.log(by_class / by_class.sum(1, keepdims=True))
    return Weights(np.log(mass / mass.sum()).astype(np.float32),
                   np.nan_to_num(word_bias, nan=-1e9, neginf=-1e9).astype(np.float32),
                   np.zeros((n, k + 1), np.float32), np.zeros((n, k, CLASS_SIZE), np.float32))


def context_features(last: np.ndarray, skip: np.ndarray) -> tuple:
    """Buckets of the templates: the last token, the one before it, the pair."""
    return last, BUCKETS + skip, 2 * BUCKETS + (last * 769 + skip * 31) % BUCKETS


class Featurizer:
    """Token codes and hashed context features of texts.  A code is a token's
    rank among the top tokens, or -1 less the bucket of its ending."""

    def __init__(self, vocab: Vocabulary):
        self.code = {t: i for i, t in enumerate(vocab.tokens)}
        self.endings = BUCKETS - OWN - 1
        own = min(OWN, len(vocab.tokens))
        self.context = np.array([*range(own), *(OWN + 1 + zlib.crc32(t[-3:]) % self.endings
                                                for t in vocab.tokens[own:])], np.int64)

    def codes(self, tokens: list[bytes]) -> np.ndarray:
        get, n = self.code.get, self.endings
        return np.array([c if (c := get(t)) is not None else -1 - zlib.crc32(t[-3:]) % n for t in tokens], np.int64)

    def features(self, codes: np.ndarray) -> np.ndarray:
        """(n, TEMPLATES) feature buckets at each position of one text."""
        key = np.empty(len(codes) + 2, np.int64)
        key[:2] = OWN                        # the start
        top = codes >= 0
        key[2:][top] = self.context[codes[top]]
        key[2:][~top] = OWN - codes[~top]
        last, skip = key[1:-1], key[:-2]
        return np.stack(context_features(last, skip), axis=1)


def _softmax(z: np.ndarray) -> np.ndarray:
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


def _gathered(w: np.ndarray, feats: np.ndarray, bias: np.ndarray) -> np.ndarray:
    out = w[feats[:, 0]] + bias
    for k in range(1, TEMPLATES):
        out += w[feats[:, k]]
    return out


def log10_probabilities(vocab: Vocabulary, weights: Weights, codes: np.ndarray, feats: np.ndarray) -> np.ndarray:
    """Of each token; a token that is not among the top ones gets the
    probability of the tail, without its own share in it."""
    out = np.empty(len(codes))
    k = len(weights.cls_bias) - 1
    flat = weights.word.reshape(-1, CLASS_SIZE)
    for lo in range(0, len(codes), _BLOCK):
        c, f = codes[lo:lo + _BLOCK], feats[lo:lo + _BLOCK]
        head = (c >= 0) & (c < vocab.head)
        cls = np.where(head, c // CLASS_SIZE, k)
        p = _softmax(_gathered(weights.cls, f, weights.cls_bias))[np.arange(len(c)), cls].astype(float)
        if head.any():
            hc, hf = cls[head], f[head]
            q = _softmax(_gathered(flat, hf * k + hc[:, None], weights.word_bias[hc]))
            p[head] *= q[np.arange(len(hc)), c[head] % CLASS_SIZE]
        lp = np.log10(np.maximum(p, 1e-300))
        middle = c >= vocab.head             # a top token of the tail
        lp[middle] += vocab.tail_log10(vocab.counts[c[middle]])
        out[lo:lo + _BLOCK] = lp
    return out


# ---------------------------------------------------------- training -----

def _event_batches(shared):
    """Texts -> (event, word, n): how often each class, and each token in it,
    follows a context.  The event is the context buckets and the class; the
    pair's bucket follows from the other two."""
    def run(batches):
        import pyarrow as pa
        vocab = shared.value[0]
        make = Featurizer(vocab)
        k = classes(vocab)
        held: list[np.ndarray] = []
        size = 0

        def flush():
            key, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(key // CLASS_SIZE, pa.int64()), pa.array(key % CLASS_SIZE, pa.int32()),
                 pa.array(n, pa.int64())], ["event", "word", "n"])

        for b in batches:
            for text in b.column(0):
                every = make.codes(tokens_of(text.as_py()))
                feats = make.features(every)
                for lo in range(0, len(every), _EVENTS):
                    codes, f = every[lo:lo + _EVENTS], feats[lo:lo + _EVENTS]
                    head = (codes >= 0) & (codes < vocab.head)
                    event = (f[:, 0] * BUCKETS + f[:, 1] - BUCKETS) * (k + 1) + np.where(head, codes // CLASS_SIZE, k)
                    held.append(event * CLASS_SIZE + np.where(head, codes % CLASS_SIZE, 0))
                    size += len(codes)
                    if size >= _EVENTS:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()
    return run


def _packed_batches(batches):
    """(event, word, n) rows -> blobs of them in order of the event."""
    import pyarrow as pa
    held: list[np.ndarray] = []
    size = 0

    def flush():
        rows = np.concatenate(held)
        return pa.RecordBatch.from_arrays([pa.array([rows[np.argsort(rows[:, 0], kind="stable")].tobytes()],
                                                    pa.binary())], ["rows"])

    for b in batches:
        held.append(np.column_stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)]))
        size += len(held[-1])
        if size >= 1 << 18:
            yield flush()
            held, size = [], 0
    if size:
        yield flush()


def training_events(texts: DataFrame, shared) -> DataFrame:
    """``rows``: blobs of (event, word, n) over all training positions."""
    counted = (in_arrow(texts, _event_batches(shared), "event long, word int, n long")
               .repartition("event").groupBy("event", "word").agg(F.sum("n").alias("n")))
    return counted.mapInArrow(_packed_batches, "rows binary")


def _unpacked(blob: bytes, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets, class and token in it of each row, and its number."""
    event, word, n = np.frombuffer(blob, np.int64).reshape(-1, 3).T
    context, cls = event // (k + 1), event % (k + 1)
    last, skip = context // BUCKETS, context % BUCKETS
    return np.stack([*context_features(last, skip), cls, np.where(cls < k, word, -1)], axis=1), n


def _add_rows(into: np.ndarray, at: np.ndarray, rows: np.ndarray):
    """into[at] += rows, with repeats, by sorted segments."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else at
    if len(at):
        into[at[first]] += np.add.reduceat(rows[order], first, axis=0)


def _runs(rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the first of each run of equal rows, and the run's sum of ``n``."""
    if not len(rows):
        return np.zeros(0, np.int64), n
    first = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]).any(axis=1)))
    return first, np.add.reduceat(n, first)


def gradient(weights: Weights, rows: np.ndarray, observed: bool, n: np.ndarray | None = None
             ) -> tuple[np.ndarray, np.ndarray]:
    """Summed expected feature counts (or observed ones) of positions, each
    row counted ``n`` times."""
    cls_sum = np.zeros(weights.cls.shape)
    word_sum = np.zeros(weights.word.shape)
    flat = word_sum.reshape(-1, CLASS_SIZE)
    k = weights.word.shape[1]
    n = np.ones(len(rows)) if n is None else n.astype(float)
    for lo in range(0, len(rows), _BLOCK):
        part, m = rows[lo:lo + _BLOCK].astype(np.int64), n[lo:lo + _BLOCK]
        f, cls, word = part[:, :TEMPLATES], part[:, TEMPLATES], part[:, TEMPLATES + 1]
        head = word >= 0
        hf, hc, hm = f[head], cls[head], m[head]
        if observed:
            for t in range(TEMPLATES):
                np.add.at(cls_sum, (f[:, t], cls), m)
                np.add.at(flat, (hf[:, t] * k + hc, word[head]), hm)
            continue
        first, times = _runs(f, m)            # equal contexts, and equal contexts and classes, are one row
        f = f[first]
        p = _softmax(_gathered(weights.cls, f, weights.cls_bias)) * times[:, None]
        first, times = _runs(np.column_stack([hf, hc]), hm)
        hf, hc = hf[first], hc[first]
        q = _softmax(_gathered(weights.word.reshape(-1, CLASS_SIZE), hf * k + hc[:, None],
                               weights.word_bias[hc])) * times[:, None]
        for t in range(TEMPLATES):
            _add_rows(cls_sum, f[:, t], p)
            _add_rows(flat, hf[:, t] * k + hc, q)
    return cls_sum, word_sum


def _gradient_batches(shared, observed: bool, slices: int):
    def run(batches):
        import pyarrow as pa
        vocab, weights = shared.value
        total = None
        for b in batches:
            for blob in b.column(0):
                rows, n = _unpacked(blob.as_py(), classes(vocab))
                one = gradient(weights, rows, observed, n)
                total = one if total is None else tuple(x + y for x, y in zip(total, one))
        if total is not None:
            flat = np.concatenate([x.ravel() for x in total]).astype(np.float32)
            parts = np.array_split(flat, slices)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(slices), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())],
                ["slice", "sums"])
    return run


def _sum_batches(batches):
    import pyarrow as pa
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for s, x in zip(b.column(0).to_pylist(), b.column(1)):
            v = np.frombuffer(x.as_py(), np.float32)
            total[s] = total[s] + v if s in total else v.astype(np.float64)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int32()), pa.array([v.astype(np.float32).tobytes() for v in total.values()],
                                                     pa.binary())], ["slice", "sums"])


def _corpus_sums(events: DataFrame, shared, observed: bool, like: Weights, slices: int = 16):
    """Feature sums over all workers: each adds up its own, slices of the
    vector meet by shuffle, and the bounded whole comes to the driver."""
    parts = events.mapInArrow(_gradient_batches(shared, observed, slices), "slice int, sums binary")
    rows = parts.repartition("slice").mapInArrow(_sum_batches, "slice int, sums binary").collect()
    size = like.cls.size + like.word.size
    flat = (np.concatenate([np.frombuffer(r["sums"], np.float32) for r in sorted(rows, key=lambda r: r["slice"])])
            if rows else np.zeros(size, np.float32))
    return flat[:like.cls.size].reshape(like.cls.shape), flat[like.cls.size:].reshape(like.word.shape)


def train(spark: SparkSession, texts: DataFrame, rounds: int = ROUNDS) -> tuple[Vocabulary, Weights, DataFrame]:
    """``texts``: one binary column of training texts.  Returns the bounded
    vocabulary, the weights, and the table of all counts."""
    counts = materialize(token_counts(texts), "lm-counts")
    top = counts.where(F.length("token") <= MAX_TOKEN).orderBy(F.desc("c"), "token").limit(TOP).toArrow()
    tokens, c = top.column("token").to_pylist(), top.column("c").to_numpy().astype(np.int64)
    s = counts.agg(F.sum("c"), F.count(F.lit(1)), F.sum((F.col("c") == 1).cast("long")),
                   F.sum((F.col("c") == 2).cast("long"))).first()
    total, types, once, twice = (int(x or 0) for x in s)
    head = min(HEAD, len(tokens))
    once -= int((c[:head] == 1).sum())
    twice -= int((c[:head] == 2).sum())
    discount = once / (once + 2 * twice) if once and twice else 0.5
    vocab = Vocabulary(tokens, c, total, types, total - int(c[:head].sum()), types - head, discount)
    weights = start_weights(vocab)
    if not head:
        return vocab, weights, counts
    shared = spark.sparkContext.broadcast((vocab, weights))
    events = materialize(training_events(texts, shared), "lm-events")
    seen = _corpus_sums(events, shared, True, weights)
    for _ in range(rounds):
        expected = _corpus_sums(events, shared, False, weights)
        shared.unpersist()
        for w, o, e in zip((weights.cls, weights.word), seen, expected):
            w += STEP * np.log((o + PRIOR) / (np.maximum(e, 0) + PRIOR))
        shared = spark.sparkContext.broadcast((vocab, weights))
    return vocab, weights, counts


# ------------------------------------------------------------ scores -----

def _score_batches(shared):
    def run(batches):
        import pyarrow as pa
        vocab, weights = shared.value
        make = Featurizer(vocab)
        base = vocab.base_log10(vocab.counts.astype(float))

        def block(rids, ids, held, token_lists):
            """Texts of about _BLOCK tokens together: one row a text, then its rarer tokens."""
            codes = [make.codes(t) for t in token_lists]
            feats = np.concatenate([make.features(c) for c in codes])
            size = np.array([len(c) for c in codes])
            flat = np.concatenate(codes)
            first = np.concatenate(([0], np.cumsum(size)[:-1]))
            top = flat >= 0
            lp = log10_probabilities(vocab, weights, flat, feats)
            bp = np.where(top, base[np.where(top, flat, 0)] if len(base) else 0.0, 0.0)
            known = np.add.reduceat(top.astype(np.int64), first)
            cols = [list(rids), list(ids), list(held), [None] * len(rids), size.tolist(), known.tolist(),
                    np.add.reduceat(bp, first).tolist(), np.add.reduceat(lp, first).tolist()]
            for rid, tokens, c in zip(rids, token_lists, codes):
                rare = Counter([tokens[i] for i in np.flatnonzero(c < 0)])
                n = len(rare)
                for col, x in zip(cols, ([rid] * n, [None] * n, [None] * n, list(rare), list(rare.values()),
                                         [0] * n, [0.0] * n, [0.0] * n)):
                    col.extend(x)
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.int64(), pa.float64(),
                     pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds)],
                                              ["rid", "id", "held", "token", "n", "known", "base", "score"])

        for b in batches:
            held: list[tuple] = []
            size = 0
            for row in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3)):
                tokens = tokens_of(row[3].as_py())
                held.append((*row[:3], tokens))
                size += len(tokens)
                if size > 4 * _BLOCK:
                    yield block(*zip(*held))
                    held, size = [], 0
            if held:
                yield block(*zip(*held))
    return run


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row per input row: ``<id>``, ``held_out``, ``n_tokens``,
    ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Texts whose crc32(id as text) modulo ten is not 0 are learnt from.

    Defined cases: a null or empty text is its end token; a null id counts as
    empty text in the fold and stays null; rows that repeat are learnt from
    and scored as often as they occur; with nothing to learn from every token
    is unknown and has probability one in the model; an empty table gives an
    empty result; other columns are not read.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("id"), (remainder(id_col) == 0).alias("held"),
                      text_bytes(text_col).alias("t"))
    vocab, weights, counts = train(spark, own.where("not held").select("t"), rounds)
    shared = spark.sparkContext.broadcast((vocab, weights))
    rows = in_arrow(
        own.select(F.monotonically_increasing_id().alias("rid"), "id", "held", "t"), _score_batches(shared),
        "rid long, id long, held boolean, token binary, n long, known long, base double, score double")
    rows = materialize(rows, "lm-rows")      # row numbers are fixed from here on

    c = F.coalesce(F.col("c"), F.lit(0))
    floor = vocab.total + 0.1 * (vocab.types + 1)
    if vocab.tail_total:
        inside = F.log10(F.when(c > 0, F.greatest(c - vocab.discount, F.lit(1e-9)))
                         .otherwise(vocab.discount * vocab.tail_types) / vocab.tail_total)
    else:
        inside = F.lit(0.0)
    rare = (rows.where("token is not null").select("rid", "token", "n").join(counts, "token", "left")
            .groupBy("rid").agg(F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("r_known"),
                                F.sum(F.col("n") * F.log10((c + 0.1) / floor)).alias("r_base"),
                                F.sum(F.col("n") * inside).alias("r_score")))
    out = rows.where("token is null").join(rare, "rid", "left")
    zero = lambda x: F.coalesce(F.col(x), F.lit(0))
    return out.select(F.col("id").alias(id_col), F.col("held").alias("held_out"), F.col("n").alias("n_tokens"),
                      (F.col("known") + zero("r_known")).cast("long").alias("n_known"),
                      F.lit(vocab.total).cast("long").alias("train_tokens"),
                      (F.col("base") + zero("r_base")).alias("base_score"),
                      (F.col("score") + zero("r_score")).alias("score"))


@query("op7_maxent_lm")
def op7_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(read_table(spark, sf_dir, "documents"))
