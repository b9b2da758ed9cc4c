"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or abstain on every document.
Expectation-maximisation over the counts of vote patterns estimates each
labeller's accuracy and the class shares; the posterior of a document's
pattern is its label, and these labels train a hashed linear scorer
(logistic, on word and word-shape features).

Plan.  One scan for the votes.  The sufficient statistic of EM is the count of
each pattern, at most ``3 ** len(LABELLERS)`` rows whatever the corpus, and it
covers all documents.  The scorer is fitted on a bounded sample
(``SAMPLE`` documents, the least hashes of the id, one text an id), in ``SHARDS`` parts whose
weights are averaged.  Scoring is one scan without a shuffle.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evtrail.llm.common import in_arrow, least_hashed, materialize, read_table, text_bytes
from evtrail.llm.registry import query

GOOD, BAD, ABSTAIN = 1, 0, 2
SAMPLE = 8000
SHARDS = 4
HASH_BITS = 16
EPOCHS = 4
MIN_SCORE = 0.4
_SYMBOLS = b"#*$%&|<>"
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_MARKS = (b"!!", b"??", b"%%", b"$$", b"##", b"**", b"&&")
# The shape of a byte: A upper case, a other letter, 9 digit, the rest itself.
_SHAPE = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 57 if 48 <= b <= 57 else b
               for b in range(256))


def _counts(text: bytes) -> dict:
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    grams = Counter(zip(words, words[1:], words[2:]))
    return {"n": len(words), "size": len(text), "symbols": len(text) - len(text.translate(None, _SYMBOLS)),
            "upper": len(text) - len(text.translate(None, _UPPER)),
            "lower": len(text) - len(text.translate(None, _LOWER)),
            "bars": text.count(b"|"), "marks": sum(map(text.count, _MARKS)),
            "distinct": len(set(words)), "lines": len(lines),
            "ended": sum(x.rstrip()[-1:] in (b".", b"!", b"?", b'"', b":") for x in lines),
            "twice": sum(c for c in grams.values() if c > 1), "grams": max(1, len(words) - 2)}


def _between(bad: bool, good: bool) -> int:
    return BAD if bad else GOOD if good else ABSTAIN


# The labellers and their thresholds.
LABELLERS = [
    ("length", lambda c: _between(c["n"] < 20, c["n"] >= 100)),
    ("symbols", lambda c: _between(5 * c["symbols"] > c["n"], c["symbols"] == 0 and c["n"] >= 20)),
    ("case", lambda c: _between(c["upper"] > c["lower"], 5 * c["upper"] < c["lower"])),
    ("repeats", lambda c: _between(2 * c["twice"] > c["grams"], c["n"] >= 20 and 10 * c["twice"] < c["grams"])),
    ("bars", lambda c: _between(5 * c["bars"] > c["n"], c["bars"] == 0 and c["n"] >= 20)),
    ("sentences", lambda c: _between(4 * c["ended"] < c["lines"], c["lines"] > 0 and 4 * c["ended"] > 3 * c["lines"])),
    ("variety", lambda c: _between(c["n"] >= 50 and 4 * c["distinct"] < c["n"],
                                   c["n"] >= 20 and 2 * c["distinct"] > c["n"])),
    ("marks", lambda c: _between(5 * c["marks"] > c["n"], c["marks"] == 0 and c["n"] >= 20)),
]


def votes(text: bytes) -> int:
    """The votes of all labellers as a base-3 number, the first one lowest."""
    c = _counts(text)
    return sum(vote(c) * 3 ** i for i, (_, vote) in enumerate(LABELLERS))


def _vote_batches(batches):
    import pyarrow as pa
    for b in batches:
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(2), pa.array([votes(t.as_py()) for t in b.column(1)], pa.int32())],
            ["id", "th", "pattern"])


def label_model(patterns: dict[int, int], rounds: int = 60) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over pattern counts.  Returns the posterior of "good" for every
    pattern, each labeller's P(vote | class, it voted) as (labellers, 2, 2),
    and the share of good documents.  Labellers are taken as independent
    given the class, and abstaining says nothing (a short text makes many
    abstain); the prior counts tie each table to a labeller that is right
    more often than not."""
    m = len(LABELLERS)
    every = np.arange(3 ** m)
    vote = np.stack([every // 3 ** i % 3 for i in range(m)], axis=1)
    n = np.zeros(len(every))
    for p, c in patterns.items():
        n[p] = c
    good = (vote == GOOD).sum(1)
    bad = (vote == BAD).sum(1)
    post = np.clip((good + 1) / (good + bad + 2), 0.05, 0.95)
    # a bad sign outweighs: junk shows in few labellers, clean text in none
    post = np.where(bad >= 2, np.minimum(post, 0.3), post)
    table = np.zeros((m, 2, 2))
    share = 0.5
    prior = np.array([[4.0, 1.0], [1.0, 4.0]])               # rows: bad, good; columns: votes bad, good
    for _ in range(rounds):
        weight = np.stack([n * (1 - post), n * post])
        share = (weight[1].sum() + 1) / (n.sum() + 2)
        for i in range(m):
            for c in (0, 1):
                t = np.bincount(vote[:, i], weights=weight[c], minlength=3)[:2] + prior[c]
                table[i, c] = t / t.sum()
        said = np.concatenate([np.log(table), np.zeros((m, 2, 1))], axis=2)
        log = np.log([1 - share, share])[:, None] + sum(said[i][:, vote[:, i]] for i in range(m))
        post = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    return post, table, float(share)


# ------------------------------------------------------- linear scorer ---

def hashed_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features and their values: words (unit length), word
    shapes (twice that), and tenths of some shares of the text."""
    mask = (1 << HASH_BITS) - 1
    seen = Counter(text.lower().split())
    shapes = Counter([w[-4:] for w in text.translate(_SHAPE).split()])
    n = max(1, sum(shapes.values()))
    at = np.fromiter((zlib.crc32(w) & mask for w in seen), np.int64, len(seen))
    value = np.log1p(np.fromiter(seen.values(), float, len(seen)))
    value /= max(1e-9, np.sqrt((value * value).sum()))
    at2 = np.fromiter((zlib.crc32(w, 1) & mask for w in shapes), np.int64, len(shapes))
    value2 = 2 * np.sqrt(np.fromiter(shapes.values(), float, len(shapes)) / n)
    if not len(at):
        return at, value
    size = len(text)
    shares = (len(seen) / n, (size - len(text.translate(None, _SYMBOLS))) / n, sum(map(text.count, _MARKS)) / n,
              (size - len(text.translate(None, _UPPER))) / size)
    at3 = np.array([zlib.crc32(b"%d %d" % (i, min(10, int(10 * x))), 2) & mask for i, x in enumerate(shares)])
    at, value = np.concatenate([at, at2, at3]), np.concatenate([value, value2, np.ones(len(shares))])
    at, inverse = np.unique(at, return_inverse=True)
    return at, np.bincount(inverse, weights=value)


def _feature_batches(batches):
    import pyarrow as pa
    for b in batches:
        feats = [hashed_features(t.as_py()) for t in b.column(2)]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array([f[0].astype(np.int32).tobytes() for f in feats], pa.binary()),
             pa.array([f[1].astype(np.float32).tobytes() for f in feats], pa.binary())],
            ["h", "post", "at", "value"])


def _train_batches(epochs: int):
    """One shard: logistic loss against posterior labels, AdaGrad."""
    def run(batches):
        import pyarrow as pa
        rows = []
        for b in batches:
            rows += [(h, p, np.frombuffer(a, np.int32), np.frombuffer(v, np.float32)) for h, p, a, v in zip(
                *(b.column(i).to_pylist() for i in range(4)))]
        if not rows:
            return
        rows.sort(key=lambda r: r[0])
        w, g = np.zeros((1 << HASH_BITS) + 1), np.full((1 << HASH_BITS) + 1, 1e-3)
        for _ in range(epochs):
            for _, p, a, v in rows:
                z = w[a] @ v + w[-1]
                q = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                d = q - p
                step = d * v + 1e-5 * w[a]
                g[a] += step * step
                w[a] -= 0.3 * step / np.sqrt(g[a])
                g[-1] += d * d
                w[-1] -= 0.3 * d / np.sqrt(g[-1])
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], ["w"])
    return run


def _score_batches(shared, min_score: float):
    def run(batches):
        import pyarrow as pa
        post, w = shared.value
        for b in batches:
            pattern, score = [], []
            for text in b.column(1):
                t = text.as_py()
                pattern.append(votes(t))
                at, value = hashed_features(t)
                score.append(float(1 / (1 + np.exp(-np.clip(w[at] @ value + w[-1], -30, 30)))))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(pattern, pa.int32()), pa.array(post[pattern].tolist(), pa.float64()),
                 pa.array(score, pa.float64()), pa.array([s >= min_score for s in score], pa.bool_())],
                ["id", "pattern", "posterior", "score", "kept"])
    return run


def weak_label_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE,
                       epochs: int = EPOCHS, min_score: float = MIN_SCORE) -> DataFrame:
    """One row per input row: ``<id>``, ``pattern`` (votes, base 3),
    ``posterior`` (of the label model), ``score`` (of the linear scorer),
    ``kept``.

    Defined cases: a null or empty text has no features, and its score is the
    scorer's bias; a null id stays null and is not in the sample; rows that
    repeat are judged alike, and count as often as they occur in the label
    model, but an id is in the scorer's sample once, with the text of the
    least hash; an empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("t"))
    kind = own.schema["id"].dataType.simpleString()
    cast = materialize(in_arrow(own.withColumn("th", F.xxhash64("t")), _vote_batches,
                                f"id {kind}, th long, pattern int"), "weak-votes")
    patterns = {r["pattern"]: r["count"] for r in cast.groupBy("pattern").count().collect()}  # <= 3^labellers rows
    post, _, _ = label_model(patterns)

    chosen = least_hashed(cast, "id", sample, F.min(F.struct("th", "pattern")).alias("one"))
    labels = spark.createDataFrame([(int(p), float(post[p])) for p in patterns], "pattern int, post double")
    chosen = (chosen.select("id", "h", "one.th", "one.pattern").join(F.broadcast(labels), "pattern")
              .select("id", "h", "th", "post"))                                           # <= sample rows
    texts = own.withColumn("th", F.xxhash64("t")).join(F.broadcast(chosen), ["id", "th"])
    rows = in_arrow(texts.select("h", "post", "t"), _feature_batches, "h long, post double, at binary, value binary")
    # copies of one id and text have equal features; one row a hash is left, before the shuffle
    rows = rows.groupBy("h").agg(F.min(F.struct("post", "at", "value")).alias("one")).select("h", "one.*")
    shards = rows.repartitionById(SHARDS, F.pmod("h", F.lit(SHARDS)).cast("int")).mapInArrow(_train_batches(epochs), "w binary")
    trained = [np.frombuffer(r["w"], float) for r in shards.collect()]            # <= SHARDS vectors
    w = np.mean(trained, axis=0) if trained else np.zeros((1 << HASH_BITS) + 1)
    shared = spark.sparkContext.broadcast((post, w))
    out = in_arrow(own, _score_batches(shared, min_score),
                         f"id {kind}, pattern int, posterior double, score double, kept boolean")
    return out.withColumnRenamed("id", id_col)


@query("op6_weak_label_classifier")
def op6_weak_label_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_label_quality(read_table(spark, sf_dir, "documents"))
