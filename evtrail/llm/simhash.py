"""SimHash near-duplicates found by fuzzy hashing with the Golay code.

A 64-bit fingerprint is cut into three segments (22, 21, 21 bits).  With at
most four differing bits between two fingerprints, either some segment is
equal, or no segment is and then two of them differ in exactly one bit
(1 + 1 + at most 2).  The binary Golay code (23, 12, 7) is perfect, so each
segment, read as a 23-bit word, lies within three bits of exactly one
codeword; every other codeword within four bits is one of five, and there are
such only at distance three.  If two words differ in at most one bit, the
nearest codeword of either is within four bits of the other.  So per pair of
segments (p, q) a fingerprint gets the keys (nearest p, each of up to six q)
and (each of up to six p, nearest q): the key (nearest p of x, nearest q of
y) is then common to x and y.  Three keys with one whole segment cover the
first case.  No pair within four bits is missed; candidates are verified by
bit distance.

Plan.  Copies collapse first: everything after the fingerprint pass works on
distinct fingerprints, about 32 keys of 16 bytes each.  Keys are shuffled and
each key's fingerprints are searched breadth-first with packed XOR: a bucket
of m emits at most m - 1 links (a spanning forest of its exact components),
never its pairs, and a dense bucket costs a few passes since linked members
leave the search.  Keys that hold more than ``MAX_BUCKET`` fingerprints are
first split by one of five equal bit classes (with four differing bits one
of five classes is equal), which is exact too, up to three times.
"""

from __future__ import annotations

import itertools
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evtrail.llm.common import (connected_components, in_arrow, materialize, read_table, text_bytes,
                                with_row_key)
from evtrail.llm.registry import query

SHINGLE = 4
MAX_BITS = 4
SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))     # (lowest bit, bits)
MAX_BUCKET = 10_000
SPLITS = ((1, 5), (13, 5), (7, 5))           # bit i belongs to class (i * step) % 67 % 5
GOLAY = 0xAE3                                # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
_CHUNK = 1 << 16


# ------------------------------------------------------- fingerprints ----

def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text; no word: zero."""
    from xxhash import xxh64_intdigest
    words = text.lower().split()             # bytes: A-Z only, and the six ASCII spaces
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):           # bounded memory for very long texts
        part = words[at:at + _CHUNK + shingle - 1]
        k = max(1, len(part) - shingle + 1)
        line = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
        lo = np.concatenate(([0], ends[:k - 1] + 1)).tolist()
        hi = ends[min(shingle, len(part)) - 1:][:k].tolist()
        h = np.fromiter((xxh64_intdigest(line[a:b], SEED) for a, b in zip(lo, hi)), np.uint64, k)
        bits = np.unpackbits(h.view(np.uint8).reshape(k, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    majority = (2 * ones > n).astype(np.uint8)
    return int(np.packbits(majority, bitorder="little").view(np.uint64)[0])


def _fingerprint_batches(shingle: int):
    def run(batches):
        import pyarrow as pa
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([ids, pa.array(fp.view(np.int64))], [b.schema.names[0], "fp"])
    return run


# --------------------------------------------------------- Golay keys ----

def _syndrome(word: int) -> int:
    for i in range(22, 10, -1):
        if word >> i & 1:
            word ^= GOLAY << (i - 11)
    return word


@lru_cache(maxsize=1)
def _tables():
    """Syndromes of the low, middle and high byte; the coset leader of each
    syndrome; the five patterns of weight four that share it (or -1)."""
    unit = [_syndrome(1 << i) for i in range(23)]
    bytes_ = np.zeros((3, 256), np.int64)
    for b in range(3):
        for v in range(256):
            s = 0
            for i in range(8):
                if v >> i & 1 and 8 * b + i < 23:
                    s ^= unit[8 * b + i]
            bytes_[b, v] = s
    leader = np.full(2048, -1, np.int64)
    four: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for pos in itertools.combinations(range(23), weight):
            s = e = 0
            for i in pos:
                s ^= unit[i]
                e |= 1 << i
            if weight < 4:
                leader[s] = e
            else:
                four[s].append(e)
    near = np.full((2048, 5), -1, np.int64)
    for s, es in enumerate(four):
        near[s, :len(es)] = es
    return bytes_, leader, near


def codeword_indices(words: np.ndarray) -> np.ndarray:
    """(n, 6) indices of the codewords within four bits of 23-bit words:
    the nearest first, -1 where there is none."""
    bytes_, leader, near = _tables()
    s = bytes_[0][words & 255] ^ bytes_[1][words >> 8 & 255] ^ bytes_[2][words >> 16 & 255]
    errors = np.concatenate([leader[s][:, None], near[s]], axis=1)
    return np.where(errors >= 0, (words[:, None] ^ errors) >> 11, -1)


def fuzzy_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``fp``, key) of all keys of unsigned fingerprints."""
    seg = [(fp >> np.uint64(lo) & np.uint64((1 << n) - 1)).astype(np.int64) for lo, n in SEGMENTS]
    code = [codeword_indices(s) for s in seg]
    at = np.arange(len(fp))
    who, keys = [], []
    for i, s in enumerate(seg):              # kind 0..2: a whole segment
        who.append(at)
        keys.append(i << 32 | s)
    for kind, (p, q) in enumerate(itertools.combinations(range(3), 2), 3):
        for j in range(6):
            for a, b, skip in ((code[p][:, 0], code[q][:, j], False), (code[p][:, j], code[q][:, 0], j == 0)):
                if skip:
                    continue
                ok = (a >= 0) & (b >= 0)
                who.append(at[ok])
                keys.append(kind << 32 | a[ok] << 12 | b[ok])
    return np.concatenate(who), np.concatenate(keys)


def _key_batches(batches):
    import pyarrow as pa
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        for at in range(0, len(fp), 4096):
            part = fp[at:at + 4096]
            who, keys = fuzzy_keys(part)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[who].view(np.int64))], ["key", "fp"])


# ---------------------------------------------------- search in a key ----

def bucket_links(fp: np.ndarray, max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """A spanning forest of the links (``max_bits`` or fewer differing bits)
    among distinct unsigned fingerprints, as position pairs: breadth first,
    members leave the search as soon as they are linked."""
    rest = np.arange(len(fp))
    out = []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            hit = np.bitwise_count(fp[rest] ^ fp[x]) <= max_bits
            if hit.any():
                found = rest[hit]
                rest = rest[~hit]
                out.extend((int(x), int(y)) for y in found)
                queue.extend(found.tolist())
    return out


def _link_batches(max_bits: int):
    """Rows sorted by key -> links; a key's rows may span batches."""
    def links(key, fp):
        cut = np.flatnonzero(np.diff(key)) + 1
        lo, hi = np.concatenate(([0], cut)), np.concatenate((cut, [len(key)]))
        a, b = [], []
        two = lo[hi - lo == 2]               # most shared keys hold two
        x, y = fp[two], fp[two + 1]
        ok = np.bitwise_count(x ^ y) <= max_bits
        a.append(x[ok])
        b.append(y[ok])
        for i, j in zip(lo[hi - lo > 2], hi[hi - lo > 2]):
            part = np.unique(fp[i:j])
            if pairs := bucket_links(part, max_bits):
                p = np.array(pairs)
                a.append(part[p[:, 0]])
                b.append(part[p[:, 1]])
        return np.concatenate(a), np.concatenate(b)

    def run(batches):
        import pyarrow as pa

        def emit(key, fp):
            a, b = links(key, fp)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            fp = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            if not len(key):
                continue
            if held and held[-1][0][-1] != key[0]:
                yield emit(np.concatenate([k for k, _ in held]), np.concatenate([f for _, f in held]))
                held = []
            last = int(np.searchsorted(key, key[-1]))
            if last:                          # whole keys before the last one
                held.append((key[:last], fp[:last]))
                yield emit(np.concatenate([k for k, _ in held]), np.concatenate([f for _, f in held]))
                held = []
            held.append((key[last:], fp[last:]))
        if held:
            yield emit(np.concatenate([k for k, _ in held]), np.concatenate([f for _, f in held]))
    return run


def _split_hot(keys: DataFrame, limit: int) -> DataFrame:
    """Give fingerprints of keys with more than ``limit`` members five finer
    keys each (one for each class of bits, with that class's value), until
    no key is larger or the classes are used up.  No link is lost: two
    fingerprints with four differing bits agree on one of five classes."""
    for step, n in SPLITS:
        hot = materialize(keys.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > limit)
                          .select("key", F.lit(True).alias("hot")), "simhash-hot")
        if hot.isEmpty():
            return keys
        classes = [sum(1 << i for i in range(64) if i * step % 67 % n == c) for c in range(n)]
        signed = [c - (1 << 64) if c >> 63 else c for c in classes]
        finer = F.array(*[F.xxhash64("key", F.lit(i), F.col("fp").bitwiseAND(F.lit(m)))
                          for i, m in enumerate(signed)])
        keys = (keys.join(hot, "key", "left")
                .select(F.explode(F.when(F.col("hot"), finer).otherwise(F.array("key"))).alias("key"), "fp"))
        keys = materialize(keys, "simhash-split")
    return keys


def _labelled(distinct: DataFrame, max_bits: int, max_bucket: int) -> DataFrame:
    """``distinct`` (one row a fingerprint ``fp``) with the ``label`` of its component."""
    if max_bits > 4:
        raise ValueError("the keys cover up to four differing bits")
    keys = _split_hot(distinct.select("fp").mapInArrow(_key_batches, "key long, fp long"), max_bucket)
    links = (keys.repartition(F.col("key")).sortWithinPartitions("key")
             .mapInArrow(_link_batches(max_bits), "a long, b long").distinct())
    comp = materialize(connected_components(links), "simhash-comp")
    return (distinct.join(comp, distinct["fp"] == comp["node"], "left")
            .select(*distinct.columns, F.coalesce("root", "fp").alias("label")))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                       max_bits: int = MAX_BITS, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """One row per input row: ``<id>``, ``fingerprint`` (16 lower-case hex
    digits), ``component_id``: the smallest id that links reach.

    Defined cases: a null or empty text has fingerprint zero, which links
    like any other; a text shorter than the shingle is one shingle; rows that
    repeat an id or a text share a fingerprint and so a component; a
    component whose ids are all null has a null ``component_id``; an empty
    table gives an empty result; other columns are not read.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("t"))
    prints = materialize(in_arrow(own, _fingerprint_batches(shingle), "id long, fp long"), "simhash-prints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")

    labelled = _labelled(distinct, max_bits, max_bucket)
    least = materialize(labelled.groupBy("label").agg(F.min("least").alias("component_id")), "simhash-least")
    named = materialize(labelled.join(least, "label").select("fp", "component_id"), "simhash-named")
    out = prints.join(named, "fp")
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                      "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                     max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one document of each component: the one of the smallest
    id.  Rows without an id stay."""
    comp = simhash_components(docs, id_col, text_col, shingle, max_bits).select(
        F.col(id_col).alias("gone"), (F.col(id_col) == F.col("component_id")).alias("kept"))
    gone = (comp.where("gone is not null").groupBy("gone").agg(F.max("kept").alias("kept"))
            .where("not kept").select("gone"))
    gone = materialize(gone, "simhash-gone")
    return docs.join(gone, docs[id_col] == gone["gone"], "left_anti")


def one_of_each_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                          max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with exactly one row of each component: that of the smallest
    id, a null id after any other, of equal ids the first row.  Rows go by
    their own number, so null and repeated ids are no exception."""
    keyed, key = with_row_key(docs, "simhash-rows")
    own = keyed.select(F.struct(F.col(key).alias("rid"), F.col(id_col).cast("long").alias("id")).alias("row"),
                       text_bytes(text_col).alias("t"))
    prints = materialize(in_arrow(own, _fingerprint_batches(shingle), "row struct<rid:long,id:long>, fp long"),
                         "simhash-prints")
    first = F.min(F.struct(F.col("row.id").isNull().alias("none"), "row.id", "row.rid"))
    distinct = materialize(prints.groupBy("fp").agg(first.alias("first")), "simhash-distinct")
    kept = (_labelled(distinct, max_bits, MAX_BUCKET).groupBy("label").agg(F.min("first").alias("first"))
            .select(F.col("first.rid").alias("kept")))
    rids = prints.select(F.col("row.rid").alias("gone"))
    gone = materialize(rids.join(kept, rids["gone"] == kept["kept"], "left_anti"), "simhash-gone")
    return keyed.join(gone, keyed[key] == gone["gone"], "left_anti").select(*docs.columns)


@query("op8_simhash_golay")
def op8_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read_table(spark, sf_dir, "documents"))
