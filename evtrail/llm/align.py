"""Alignment of the tokens two public tokenizers give the same texts.

Tokenizer A reads a space and the text, tokenizer B the text, before which it
puts a space itself.  Both token streams are arrays of byte ends.  While ends
agree at the current shift between the two indexes, exponential probing
compares ever longer stretches of the arrays and jumps over them; where they
part, the irregular group is walked token by token until both end together,
and the shift is updated.

Two tokens that end together are spellings of which one is the other's
ending, so all pairs that can ever be linked follow from the two vocabularies
(at most one per token and ending: under 600,000 here).  That proves the size
of the corpus-wide table of pair counts, whatever the corpus.

Plan.  One scan encodes and aligns; its digests and links (4 bytes each) are
written.  A second scan, of the links only, adds up pair counts inside each
task; they are summed in one small shuffle and handed to every worker as two
arrays; a third reads the links again and looks them up.  No text and no link
is shuffled.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evtrail.llm.common import in_arrow, materialize, read_table, text_bytes
from evtrail.llm.registry import query

BATCH_BYTES = 32 << 20
WALK = 4        # tokens compared one by one before a stretch is probed


def run_skips(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in A and in B of the tokens that end together, for two int32
    arrays of rising ends that share their last."""
    raw_a, raw_b = ends_a.tobytes(), ends_b.tobytes()
    a, b = ends_a.tolist(), ends_b.tolist()
    n, m = len(a), len(b)
    starts_a: list[int] = []
    starts_b: list[int] = []
    sizes: list[int] = []
    i = j = 0
    while i < n:
        x, y = a[i], b[j]
        while x != y:                      # an irregular group: the shift changes here
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        size, most = 1, min(n - i, m - j)
        while size < most and size < WALK and a[i + size] == b[j + size]:
            size += 1
        if size == WALK:                   # a regular stretch: probe ever further, then ever nearer
            stride = WALK
            while stride:
                step = min(stride, most - size)
                p, q = 4 * (i + size), 4 * (j + size)
                if step and raw_a[p:p + 4 * step] == raw_b[q:q + 4 * step]:
                    size += step
                    stride = stride * 2 if step == stride else 0
                else:
                    break
            stride = min(stride, most - size)
            while stride > 1:
                stride = (stride + 1) // 2
                p, q = 4 * (i + size), 4 * (j + size)
                if size + stride <= most and raw_a[p:p + 4 * stride] == raw_b[q:q + 4 * stride]:
                    size += stride
            while size < most and a[i + size] == b[j + size]:
                size += 1
        starts_a.append(i)
        starts_b.append(j)
        sizes.append(size)
        i += size
        j += size
    size = np.array(sizes, np.int64)
    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return np.repeat(np.array(starts_a, np.int64), size) + inner, np.repeat(np.array(starts_b, np.int64), size) + inner


class Tokenizers:
    """Both vocabularies as byte spellings, their encoders, and the pairs that
    can end together, numbered in the order of (A id, B id)."""

    def __init__(self, path_a: str, path_b: str, pattern: str):
        import json

        import sentencepiece
        import tiktoken
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in printable]
        unspell = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(other)}
        with open(path_a, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        ranks = {bytes(map(unspell.__getitem__, t)): i for t, i in vocab.items()}
        self.encode_a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks,
                                          special_tokens={}).encode_ordinary
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for spelling, i in ranks.items():
            self.bytes_a[i] = spelling
        pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.encode_b = lambda texts: pieces.encode(texts, num_threads=1)
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in ((i, pieces.id_to_piece(i)) for i in range(pieces.vocab_size()))]
        self.size_a = np.array(list(map(len, self.bytes_a)), np.int32)
        self.size_b = np.array(list(map(len, self.bytes_b)), np.int32)
        self.digits_a, self.width_a = _digits(len(self.bytes_a))
        self.digits_b, self.width_b = _digits(len(self.bytes_b))
        self.pairs = self._possible()

    def _possible(self) -> np.ndarray:
        ids_a, ids_b = {}, {}
        for ids, spellings in ((ids_a, self.bytes_a), (ids_b, self.bytes_b)):
            for i, s in enumerate(spellings):
                ids.setdefault(s, []).append(i)
        keys = [i << 32 | j for s, found in ids_a.items() for k in range(len(s))
                for j in ids_b.get(s[k:], ()) for i in found]
        keys += [i << 32 | j for s, found in ids_b.items() for k in range(1, len(s))
                 for i in ids_a.get(s[k:], ()) for j in found]
        return np.unique(np.array(keys, np.int64))

    def streams(self, texts: list[str]):
        """(A ids, B ids) of each text; none where a stream does not spell the
        space and the text."""
        for text, b in zip(texts, self.encode_b(texts)):
            spaced = " " + text
            a = self.encode_a(spaced) if text else []
            want = spaced.encode()
            if (not text or b"".join(map(self.bytes_a.__getitem__, a)) != want
                    or b"".join(map(self.bytes_b.__getitem__, b)) != want):
                a, b = [], []
            yield np.array(a, np.int64), np.array(b, np.int64)

    def group_line(self, a, b, at_a, at_b) -> bytes:
        """``a1,a2|b1;a3|b2,b3``: the groups' decimal ids in order."""
        rows = len(a) + len(b)
        ends_a, ends_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        ends_a[at_a] = ends_b[at_b] = 1
        group_a, group_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b
        row_a = np.arange(len(a)) + np.r_[0, at_b + 1][group_a]
        row_b = np.arange(len(b)) + (at_a + 1)[group_b]
        text = np.zeros((rows, 8), np.uint8)
        size = np.zeros(rows, np.int64)
        text[row_a], text[row_b] = self.digits_a[a], self.digits_b[b]
        size[row_a], size[row_b] = self.width_a[a], self.width_b[b]
        mark = np.full(rows, ord(","), np.uint8)
        mark[row_a[at_a]], mark[row_b[at_b]] = ord("|"), ord(";")
        text[np.arange(rows), size] = mark
        return text[np.arange(8) <= size[:, None]].tobytes()[:-1]


def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 .. n - 1 in rows of 8, and how many each has."""
    spelt = np.char.mod("%d", np.arange(n)).astype("S8")
    rows = spelt.view(np.uint8).reshape(n, 8).copy()
    return rows, (rows > 0).sum(axis=1)


@lru_cache(maxsize=2)
def tokenizers(path_a: str, path_b: str, pattern: str) -> Tokenizers:
    return Tokenizers(path_a, path_b, pattern)


def _align(paths):
    def run(batches):
        import pyarrow as pa
        both = tokenizers(*paths)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            out: list[list] = [[] for _ in range(5)]
            for a, b in both.streams(texts):
                at_a = at_b = np.zeros(0, np.int64)
                digest = ""
                if len(a):
                    at_a, at_b = run_skips(np.cumsum(both.size_a[a], dtype=np.int32),
                                           np.cumsum(both.size_b[b], dtype=np.int32))
                    digest = hashlib.sha256(both.group_line(a, b, at_a, at_b)).hexdigest()
                links = np.searchsorted(both.pairs, a[at_a] << 32 | b[at_b]).astype(np.int32)
                for column, value in zip(out, (len(a), len(b), len(at_a), digest, links.tobytes())):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, k) for x, k in zip(out, kinds))],
                ["id", "n_a", "n_b", "n_groups", "groups_sha256", "links"])
    return run


def _count_links(paths):
    def run(batches):
        import pyarrow as pa
        both = tokenizers(*paths)
        counts = np.zeros(len(both.pairs), np.int64)
        for batch in batches:
            for links in batch.column(0).to_pylist():
                np.add.at(counts, np.frombuffer(links, np.int32), 1)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], ["pair", "n"])
    return run


def _look_up(counts: np.ndarray, best: np.ndarray):
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            n_best, total = [], []
            for links in batch.column(5).to_pylist():
                at = np.frombuffer(links, np.int32)
                n_best.append(int(best[at].sum()))
                total.append(int(counts[at].sum()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(5)), pa.array(n_best, pa.int64()), pa.array(total, pa.int64())],
                ["id", "n_a", "n_b", "n_groups", "groups_sha256", "n_best", "count_sum"])
    return run


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, pattern: str, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per
    row: tokens of either side, groups and links, links whose pair is the B
    token's most frequent of the corpus (ties included), the links' corpus-wide
    pair counts added up, and the digest of the groups.

    Defined cases: a null or empty text, and one that a tokenizer does not
    spell byte by byte (such as one with U+2581, which B reads as a space), has
    zeros and the empty digest; special tokens' strings are plain text; a null
    id stays null; repeated rows count each, also in the pair counts; an empty
    table gives an empty result; other columns are not read; texts are taken
    batch by batch of bounded bytes, a very long one by itself.
    """
    own = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).cast("string").alias("t"))
    spark = own.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    kind = own.schema["id"].dataType.simpleString()
    head = f"id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string"
    paths = (path_a, path_b, pattern)
    aligned = materialize(in_arrow(own, _align(paths), head + ", links binary"), "aligned-tokens")
    pairs = tokenizers(*paths).pairs
    found = (in_arrow(aligned.select("links"), _count_links(paths), "pair long, n long")
             .groupBy("pair").agg(F.sum("n").alias("n")).toArrow())     # at most len(pairs) rows
    counts = np.zeros(len(pairs), np.int64)
    counts[found.column(0).to_numpy()] = found.column(1).to_numpy()
    token_b = pairs & 0xFFFFFFFF
    most = np.zeros(int(token_b.max()) + 1, np.int64)
    np.maximum.at(most, token_b, counts)
    out = in_arrow(aligned, _look_up(counts, counts == most[token_b]), head + ", n_best long, count_sum long")
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"),
                      "n_best", "count_sum", "groups_sha256")


@query("op12_tokenizer_alignment")
def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P
    return align_tokenizers(read_table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"),
                            P.path("piece_bpe_32k.model"), P.PATTERN)
