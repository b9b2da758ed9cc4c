"""Quality rules by labelling the lines of a document.

A linear-chain conditional random field marks each line with a word as
content or boilerplate; Viterbi decoding finds the best marking of the whole
document, and the share of words in content lines decides whether it stays.

The field is trained here: a documented, bounded sample of labelled documents
(``SAMPLE`` of each class, the least hashes of the id) gives line sequences;
lines of good documents count as content, lines of bad documents as
boilerplate where they show a sign of noise.  Its log-likelihood is maximised
with exact forward-backward gradients, tied to a prior that also stands in
when there are no labels.

Plan.  The sample is a top-k of the label table, joined by broadcasting its
at most ``2 * SAMPLE`` ids, and only its line features (one integer a line)
reach the driver.  Decoding is one scan without a shuffle; a line's state is
two numbers, so very long documents need no more than their lines.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evtrail.llm.common import in_arrow, least_hashed, read_table, text_bytes
from evtrail.llm.registry import query

SAMPLE = 1000             # labelled documents of each class
SAMPLE_LINES = 200        # longer documents are not taken into the sample
MIN_SHARE = 0.5           # of the words in content lines
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

# Line features in bit order, and the prior weight of each for
# "content" against "boilerplate".
FEATURES = [
    ("bias", 2.0), ("one_to_three_words", -0.5), ("over_eight_words", 0.5), ("ends_sentence", 0.7),
    ("symbols_some", -1.5), ("symbols_many", -2.5), ("bars", -2.5), ("upper_case", -2.5), ("digits", -1.5),
    ("seen_before", -2.0), ("few_distinct_words", -2.0), ("doubled_marks", -2.0), ("notice_words", -1.0),
    ("address", -0.3), ("bullet", -0.5), ("long_words", -1.0),
]
_BIT = {name: 1 << i for i, (name, _) in enumerate(FEATURES)}
NOISE = ("symbols_many", "bars", "upper_case", "doubled_marks", "few_distinct_words")
# Words of notices.
NOTICE = frozenset(b"cookie cookies copyright licensed license subscribe login newsletter privacy".split())
_SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\x0b\x0c\r"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = b"0123456789"
_MARKS = (b"!!", b"??", b"%%", b"$$", b"##", b"**", b"&&")


def line_features(line: bytes, words: list[bytes], seen: bool) -> int:
    """Features of a line with at least one word, as bits."""
    n, size = len(words), len(line)
    f = _BIT["bias"]
    if n <= 3:
        f |= _BIT["one_to_three_words"]
    elif n > 8:
        f |= _BIT["over_eight_words"]
    if line.rstrip(_SPACES)[-1:] in (b".", b"!", b"?", b'"', b":"):
        f |= _BIT["ends_sentence"]
    symbols = size - len(line.translate(None, _SYMBOLS))
    if symbols:
        f |= _BIT["symbols_many" if 10 * symbols > n else "symbols_some"]
        if line.count(b"|") >= 2:
            f |= _BIT["bars"]
    upper = size - len(line.translate(None, _UPPER))
    if upper > 10 and upper > size - len(line.translate(None, _LOWER)):
        f |= _BIT["upper_case"]
    if 3 * (size - len(line.translate(None, _DIGITS))) > size:
        f |= _BIT["digits"]
    if seen:
        f |= _BIT["seen_before"]
    if n >= 12 and 2 * len(set(words)) < n:
        f |= _BIT["few_distinct_words"]
    if sum(map(line.count, _MARKS)) * 4 > n:
        f |= _BIT["doubled_marks"]
    if not NOTICE.isdisjoint(line.lower().replace(b",", b"").replace(b".", b"").split()):
        f |= _BIT["notice_words"]
    if b"://" in line or b"@" in line:
        f |= _BIT["address"]
    if words[0] in (b"-", b"*", b"+", b"\xe2\x80\xa2"):
        f |= _BIT["bullet"]
    if size > 25 * n:
        f |= _BIT["long_words"]
    return f


def document_lines(text: bytes) -> list[tuple[int, int, int]]:
    """(line number, words, features) of each line with a word, and duplicates counted in features."""
    seen: set[bytes] = set()
    out = []
    for i, line in enumerate(text.split(b"\n")):
        words = line.split()
        if words:
            out.append((i, len(words), line_features(line, words, line in seen)))
            seen.add(line)
    return out


# ------------------------------------------------------ the field --------

@dataclass
class LineField:
    """State 1 is content.  ``emit``: weight of each feature for state 1;
    ``move``: transition scores; ``start``: scores of the first line."""
    emit: np.ndarray = field(default_factory=lambda: np.array([w for _, w in FEATURES]))
    move: np.ndarray = field(default_factory=lambda: np.array([[0.7, -0.2], [-0.5, 0.7]]))
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))

    def scores(self, features: list[int]) -> list[float]:
        w = self.emit.tolist()
        return [sum(x for i, x in enumerate(w) if f >> i & 1) for f in features]

    def viterbi(self, features: list[int]) -> list[int]:
        """The best marking; ties go to content."""
        (stay0, to1), (to0, stay1) = self.move.tolist()
        v0, v1 = self.start.tolist()
        back = []
        for i, s in enumerate(self.scores(features)):
            if i:
                a, b = v0 + stay0, v1 + to0
                c, d = v0 + to1, v1 + stay1
                back.append((int(b >= a), int(d >= c)))
                v0, v1 = max(a, b), max(c, d)
            v1 += s
        if not features:
            return []
        state = int(v1 >= v0)
        path = [state]
        for step in reversed(back):
            state = step[state]
            path.append(state)
        return path[::-1]


def fit_field(sequences: list[tuple[list[int], list[int]]], rounds: int = 120, rate: float = 0.15,
              tie: float = 0.02) -> LineField:
    """Maximum likelihood (features, states) with a Gaussian tie to the prior."""
    prior = LineField()
    if not sequences:
        return prior
    n, t, k = len(sequences), max(len(f) for f, _ in sequences), len(FEATURES)
    x = np.zeros((n, t, k))
    y = np.zeros((n, t), np.int64)
    on = np.zeros((n, t), bool)
    for i, (f, s) in enumerate(sequences):
        x[i, :len(f)] = (np.array(f)[:, None] >> np.arange(k)) & 1
        y[i, :len(s)] = s
        on[i, :len(f)] = True
    both = on[:, 1:] & on[:, :-1]
    seen_emit = (x * (y * on)[:, :, None]).sum((0, 1))
    seen_move = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & both).sum() for b in (0, 1)] for a in (0, 1)], float)
    seen_start = np.bincount(y[:, 0], minlength=2).astype(float)
    first = np.concatenate([prior.emit, prior.move.ravel(), prior.start])
    theta, m, v = first.copy(), np.zeros_like(first), np.zeros_like(first)
    total = on.sum()
    for step in range(1, rounds + 1):
        emit, move, start = theta[:k], theta[k:k + 4].reshape(2, 2), theta[k + 4:]
        e = np.zeros((n, t, 2))
        e[:, :, 1] = x @ emit
        alpha, beta = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        alpha[:, 0] = start + e[:, 0]
        for j in range(1, t):
            a = np.logaddexp(alpha[:, j - 1, 0, None] + move[0], alpha[:, j - 1, 1, None] + move[1]) + e[:, j]
            alpha[:, j] = np.where(on[:, j, None], a, alpha[:, j - 1])
        for j in range(t - 2, -1, -1):
            nxt = beta[:, j + 1] + e[:, j + 1]
            b = np.logaddexp(move[None, :, 0] + nxt[:, 0, None], move[None, :, 1] + nxt[:, 1, None])
            beta[:, j] = np.where(on[:, j + 1, None], b, 0.0)
        z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        gamma = np.exp(alpha + beta - z[:, None, None]) * on[:, :, None]
        exp_emit = np.einsum("ntk,nt->k", x, gamma[:, :, 1])
        exp_move = np.array([[np.exp(np.where(both, alpha[:, :-1, a] + move[a, b] + e[:, 1:, b] + beta[:, 1:, b]
                                              - z[:, None], -np.inf)).sum() for b in (0, 1)] for a in (0, 1)])
        exp_start = gamma[:, 0].sum(0)
        grad = np.concatenate([seen_emit - exp_emit, (seen_move - exp_move).ravel(), seen_start - exp_start]) / total
        grad -= tie * (theta - first) / len(theta)
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        theta = theta + rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return LineField(theta[:k], theta[k:k + 4].reshape(2, 2), theta[k + 4:])


def _sample_batches(batches):
    import pyarrow as pa
    for b in batches:
        fits, lines = [], []
        for text in b.column(2):
            own = [f for _, _, f in document_lines(text.as_py())]
            fits.append(0 < len(own) <= SAMPLE_LINES)
            if fits[-1]:
                lines.append(own)
        rows = b.select([0, 1, 3]).filter(pa.array(fits, pa.bool_()))
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(lines, pa.list_(pa.int32()))],
                                         ["h", "quality", "th", "lines"])


def train_line_field(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> LineField:
    """Fit the field on at most ``sample`` labelled documents of each class
    (the least hashes of ``doc_id``).  ``docs``: doc_id, text; ``labels``:
    doc_id, quality (1 good, 0 bad; other rows are not used).  Without
    labels of both classes the prior is returned.

    An id labelled both ways is not used; one that is labelled more than once
    counts once, and of the texts of a repeated id the one with the least
    hash is taken, so at most ``2 * sample`` rows reach the driver."""
    chosen = labels.where("quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("q"))
    ids = [least_hashed(chosen, "doc_id", sample, F.min("q").alias("quality"), F.max("q").alias("most"),
                        where=f"quality = {q} and most = {q}").select("doc_id", "h", "quality") for q in (0, 1)]
    own = (docs.select("doc_id", text_bytes().alias("t")).join(F.broadcast(ids[0].unionByName(ids[1])), "doc_id")
           .select("h", "quality", "t", F.xxhash64("t").alias("th")))
    rows = in_arrow(own, _sample_batches, "h long, quality int, th long, lines array<int>")
    rows = (rows.groupBy("h", "quality").agg(F.min(F.struct("th", "lines")).alias("one"))
            .select("quality", "one.lines").collect())                                   # <= 2 * sample rows
    if len({r["quality"] for r in rows}) < 2:
        return LineField()
    noise = sum(_BIT[x] for x in NOISE)
    return fit_field(sorted((list(r["lines"]), [1] * len(r["lines"]) if r["quality"] == 1
                             else [int(not f & noise) for f in r["lines"]]) for r in rows))


# ------------------------------------------------------ the verdict ------

def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = text.split()
    n = len(words)
    chars = len(text.decode("utf-8", "replace")) - (len(text) - len(text.translate(None, _SPACES)))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    seen: set[bytes] = set()
    dup = 0
    for line in text.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip(_SPACES):
            seen.add(line)
    repeat = 0
    if n > 3:
        known: dict[bytes, int] = {}
        ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
        pair = ids[:-1] * len(known) + ids[1:]
        pair = np.unique(pair, return_inverse=True)[1]
        _, inverse, count = np.unique(pair[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True)
        twice = count[inverse] > 1
        cover = np.zeros(n, bool)
        for i in range(3):
            cover[i:n - 2 + i] |= twice
        repeat = int(cover.sum())
    return n, chars, symbols, dup, repeat


def _judge_batches(model: LineField, min_words: int, max_repeat: int, min_share: float):
    def run(batches):
        import pyarrow as pa
        for b in batches:
            cols: list[list] = [[] for _ in range(9)]
            for text in b.column(1):
                t = text.as_py()
                counts = base_counts(t)
                failed = counts[0] < min_words or 100 * counts[4] > max_repeat * counts[0]
                lines = document_lines(t)
                marks = model.viterbi([f for _, _, f in lines])
                inside = sum(w for (_, w, _), m in zip(lines, marks) if m)
                share = inside / counts[0] if counts[0] else 0.0
                shown = ["-"] * (t.count(b"\n") + 1)
                for (i, _, _), m in zip(lines, marks):
                    shown[i] = "CB"[1 - m]
                for c, x in zip(cols, (*counts, failed, not failed and share >= min_share, share, "".join(shown))):
                    c.append(x)
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.bool_(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]],
                ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                 "kept", "content_share", "line_marks"])
    return run


def judge_quality(docs: DataFrame, model: LineField, id_col: str = "doc_id", text_col: str = "text",
                  min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT,
                  min_share: float = MIN_SHARE) -> DataFrame:
    """One row per input row: ``<id>``, the base counts, ``base_failed``,
    ``kept``, ``content_share`` and ``line_marks`` (one of C content, B
    boilerplate, - no word, per line).

    Defined cases: a null text counts as empty; a text without a word has
    share 0, fails the base rule and goes; a null id stays null; rows that
    repeat are judged alike, each by itself; an empty table gives an empty
    result; other columns are not read.
    """
    own = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("t"))
    kind = own.schema["id"].dataType.simpleString()
    out = in_arrow(own, 
        _judge_batches(model, min_words, max_repeat_percent, min_share),
        f"id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, content_share double, line_marks string")
    return out.withColumnRenamed("id", id_col)


def _filter_batches(model: LineField, text_at: int, min_words: int, max_repeat: int, min_share: float):
    def run(batches):
        import pyarrow as pa
        judge = _judge_batches(model, min_words, max_repeat, min_share)
        for b in batches:
            texts = pa.array([(t.as_py() or "").encode() for t in b.column(text_at)], pa.binary())
            for verdict in judge([pa.RecordBatch.from_arrays([pa.nulls(len(texts)), texts], ["id", "t"])]):
                yield b.filter(verdict.column(7))
    return run


def keep_good(docs: DataFrame, model: LineField, text_col: str = "text", min_words: int = MIN_WORDS,
              max_repeat_percent: int = MAX_REPEAT_PERCENT, min_share: float = MIN_SHARE) -> DataFrame:
    """The rows of ``docs`` that :func:`judge_quality` keeps, all columns as
    they are, in one scan without a join."""
    at = docs.columns.index(text_col)
    return in_arrow(docs, _filter_batches(model, at, min_words, max_repeat_percent, min_share), docs.schema)


@query("op1_line_crf")
def op1_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = train_line_field(docs, read_table(spark, sf_dir, "labels"))
    return judge_quality(docs, model).drop("line_marks")
