"""Audit of how the sources of one language differ in their use of words.

Words are counted per (language, source) inside the tasks; a language keeps
the terms that enough of its documents hold.  Each group's kept terms become
sorted (term id, count) arrays, cut into blocks of at most ``BLOCK_TERMS``
ids, and every unordered pair of groups is one task per block: a galloping
intersection finds the terms both have, whose prices are compared one by one;
a term of one side only is compared with the other side's price of nothing;
the terms neither has are added once, by their number.

Plan.  One scan of the texts; what leaves a task is one row per (language,
source, term) and flush, so a hot source or a very common word is added up
before the shuffle.  One exchange by (language, term) serves the sums, the
document count of the term and its place among the sources.  The kept rows
are written once.  Arrays travel once per pair they take part in, which is
the size of the result times the block; nothing is held that grows with the
texts.  Prices are whole numbers throughout.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evtrail.llm.common import in_arrow, materialize, read_table, text_bytes, text_or_empty
from evtrail.llm.registry import query

SCALE = 1_000_000_000
SMOOTH = 5
BLOCK_TERMS = 8192       # ids in one array: a pair's task holds two of them
FLUSH_TERMS = 300_000    # words a task counts before it hands them on
BATCH_BYTES = 32 << 20

#: ASCII letters become lower case, other ASCII characters part the words, and
#: every byte of a longer character belongs to a word.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _flush(groups: dict):
    import pyarrow as pa
    for (lang, source), (n, d) in groups.items():
        words = [b"", *n]
        counts = [0, *n.values()]
        held = [0, *map(d.__getitem__, n)]
        for lo in range(0, len(words), 20_000):
            part = words[lo:lo + 20_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(part)), pa.array([source] * len(part)),
                 pa.array(part, pa.binary()).cast(pa.string()),
                 pa.array(counts[lo:lo + 20_000], pa.int64()), pa.array(held[lo:lo + 20_000], pa.int64())],
                ["lang", "source", "term", "n", "d"])


def _count_terms(batches):
    """(lang, source, term, occurrences, documents) of the rows of a task; the
    empty term with zeros says that the group occurs."""
    groups: dict = defaultdict(lambda: (Counter(), Counter()))
    for batch in batches:
        langs, sources, texts = (batch.column(i).to_pylist() for i in range(3))
        for lang, source, text in zip(langs, sources, texts):
            n, d = groups[lang, source]
            words = text.translate(_FOLD).split()
            n.update(words)
            d.update(set(words))
        if sum(len(n) for n, _ in groups.values()) > FLUSH_TERMS:
            yield from _flush(groups)
            groups.clear()
    yield from _flush(groups)


def shares(counts: np.ndarray, total: int, kept: int) -> np.ndarray:
    """``1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * kept))``, exact
    for counts of any size."""
    below = total + SMOOTH * kept
    if not len(counts):
        return np.zeros(0, np.int64)
    if int(counts.max()) + SMOOTH < (1 << 63) // SCALE:
        return 1 + (counts + SMOOTH) * SCALE // below
    return np.array([1 + (int(c) + SMOOTH) * SCALE // below for c in counts], np.int64)


def gallop(small: np.ndarray, large: np.ndarray) -> np.ndarray:
    """For each value of sorted ``small`` its place in sorted ``large``, or -1.
    The values are taken 64 at a time; from the place reached so far the probe
    doubles its stride until it is past the last of them, and only the stretch
    in between is searched."""
    found = np.full(len(small), -1, np.int64)
    at = 0
    for lo in range(0, len(small), 64):
        part = small[lo:lo + 64]
        stride = 64
        while at + stride < len(large) and large[at + stride] < part[-1]:
            stride *= 2
        stretch = large[at:at + stride + 1]
        place = np.searchsorted(stretch, part)
        inside = place < len(stretch)
        hit = np.zeros(len(part), bool)
        hit[inside] = stretch[place[inside]] == part[inside]
        found[lo:lo + 64][hit] = at + place[hit]
        at += int(place[-1])
        if at >= len(large):
            break
    return found


def price_pair(ids_a, n_a, ids_b, n_b, total_a: int, total_b: int, kept: int) -> tuple[int, int]:
    """(sum of price differences over the terms at least one side has, number
    of these terms)."""
    if len(ids_a) > len(ids_b):
        ids_a, n_a, total_a, ids_b, n_b, total_b = ids_b, n_b, total_b, ids_a, n_a, total_a
    place = gallop(ids_a, ids_b)
    both = place >= 0
    p_a, p_b = shares(n_a, total_a, kept), shares(n_b, total_b, kept)
    none_a, none_b = (1 + SMOOTH * SCALE // (t + SMOOTH * kept) for t in (total_a, total_b))
    alone_b = np.ones(len(ids_b), bool)
    alone_b[place[both]] = False
    value = (int(np.abs(p_a[both] - p_b[place[both]]).sum()) + int(np.abs(p_a[~both] - none_b).sum())
             + int(np.abs(p_b[alone_b] - none_a).sum()))
    return value, len(ids_a) + int(alone_b.sum())


def _price(batches):
    import pyarrow as pa

    def lists(column):
        flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]

    for batch in batches:
        ids_lo, n_lo, ids_hi, n_hi = (lists(batch.column(i)) for i in range(3, 7))
        totals = [batch.column(i).to_pylist() for i in range(7, 10)]
        out = [price_pair(a, x, b, y, ta, tb, v)
               for a, x, b, y, ta, tb, v in zip(ids_lo, n_lo, ids_hi, n_hi, *totals)]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(3)), pa.array([v for v, _ in out], pa.int64()),
             pa.array([u for _, u in out], pa.int64())], ["lang", "lo", "hi", "value", "held"])


def _share(count, total, kept):
    """``shares`` as an expression over wide decimals."""
    wide = lambda c: c.cast("decimal(28,0)")
    return F.expr("1L") + F.call_function("div", wide(count + F.lit(SMOOTH)) * F.lit(SCALE).cast("decimal(10,0)"),
                                          wide(total + F.lit(SMOOTH) * kept))


def kept_terms(docs: DataFrame, min_docs: int, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(lang, source, term, n, lang_n, head): the counts of every kept term in
    every group that has it, its count in the language, and ``head`` on one of
    its rows; one row with the empty term for every group."""
    own = docs.select(text_or_empty(lang_col), text_or_empty(source_col), text_bytes(text_col))
    own.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    counted = in_arrow(own, _count_terms, "lang string, source string, term string, n long, d long")
    one = Window.partitionBy("lang", "term")
    return (counted.repartition("lang", "term").groupBy("lang", "term", "source")
            .agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
            .withColumn("lang_d", F.sum("d").over(one)).withColumn("lang_n", F.sum("n").over(one))
            .withColumn("first", F.min("source").over(one))
            .where((F.col("lang_d") >= min_docs) | (F.col("term") == ""))
            .select("lang", "source", "term", "n", "lang_n",
                    ((F.col("source") == F.col("first")) & (F.col("term") != "")).cast("long").alias("head")))


def source_divergence(docs: DataFrame, min_docs: int = 30, top: int = 50, text_col: str = "text",
                      lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank).  Part ``pair``: every other
    source of the language with the sum of price differences over all kept
    terms; part ``term``: the ``top`` terms the group prices most above its
    language.

    Defined cases: null text, lang or source counts as empty; a group without
    a kept term prices every term at nothing's share and has no ``term`` rows;
    a language without kept terms has pairs of value 0; a language with one
    source has no pairs; ties go by the item's UTF-8 order; repeated rows
    count each; an empty table gives an empty result; other columns, whatever
    their names, are not read; texts are taken batch by batch of bounded
    bytes, a very long one by itself.
    """
    kept = materialize(kept_terms(docs, min_docs, text_col, lang_col, source_col), "divergence-terms")
    per_lang = kept.groupBy("lang").agg(F.sum("head").alias("kept"), F.sum("n").alias("lang_total"))
    groups = (kept.groupBy("lang", "source").agg(F.sum("n").alias("total")).join(per_lang, "lang"))
    groups = materialize(groups, "divergence-groups")
    terms = kept.where(F.col("term") != "")

    # over-priced terms of each group
    priced = (terms.where("n > 0").join(groups, ["lang", "source"])
              .select("lang", "source", F.col("term").alias("item"),
                      (_share(F.col("n"), F.col("total"), F.col("kept"))
                       - _share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))).alias("value"))
              .where("value > 0"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = priced.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    term_part = ranked.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")

    # pairs of groups
    most = groups.agg(F.max("kept")).first()[0] or 0
    blocks = max(1, -(-int(most) * 2 // BLOCK_TERMS))
    numbered = (terms.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int"))
                .withColumn("id", F.dense_rank().over(Window.partitionBy("lang", "block").orderBy("term"))))
    arrays = (numbered.groupBy("lang", "source", "block")
              .agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("a"))
              .select("lang", "source", "block", F.col("a.id").alias("ids"), F.col("a.n").alias("ns")))
    lo = groups.select("lang", F.col("source").alias("lo"), F.col("total").alias("total_lo"), "kept")
    hi = groups.select("lang", F.col("source").alias("hi"), F.col("total").alias("total_hi"))
    pairs = lo.join(hi, "lang").where("lo < hi")
    names = ["lang", "block", "lo", "hi"]
    left = arrays.withColumnRenamed("source", "lo").join(pairs.select("lang", "lo", "hi"), ["lang", "lo"])
    right = arrays.withColumnRenamed("source", "hi").join(pairs.select("lang", "lo", "hi"), ["lang", "hi"])
    met = (left.select(*names, F.col("ids").alias("ids_lo"), F.col("ns").alias("ns_lo"))
           .join(right.select(*names, F.col("ids").alias("ids_hi"), F.col("ns").alias("ns_hi")), names, "full"))
    empty_ids, empty_ns = F.expr("cast(array() as array<int>)"), F.expr("cast(array() as array<bigint>)")
    tasks = (met.join(pairs, ["lang", "lo", "hi"])
             .select("lang", "lo", "hi", F.coalesce("ids_lo", empty_ids), F.coalesce("ns_lo", empty_ns),
                     F.coalesce("ids_hi", empty_ids), F.coalesce("ns_hi", empty_ns),
                     "total_lo", "total_hi", "kept"))
    block_sums = in_arrow(tasks, _price, "lang string, lo string, hi string, value long, held long")
    sums = block_sums.groupBy("lang", "lo", "hi").agg(F.sum("value").alias("value"), F.sum("held").alias("held"))
    nothing = F.abs(_share(F.lit(0), F.col("total_lo"), F.col("kept"))
                    - _share(F.lit(0), F.col("total_hi"), F.col("kept")))
    whole = (pairs.join(sums, ["lang", "lo", "hi"], "left")
             .withColumn("value", F.when(F.col("kept") == 0, F.lit(0).cast("long")).otherwise(
                 F.coalesce("value", F.lit(0)) + (F.col("kept") - F.coalesce("held", F.lit(0))) * nothing)))
    both_ways = (whole.withColumn("way", F.explode(F.array(F.struct(F.col("lo").alias("source"), F.col("hi").alias("item")),
                                                           F.struct(F.col("hi").alias("source"), F.col("lo").alias("item")))))
                 .select("lang", "way.source", "way.item", "value"))
    pair_part = (both_ways.withColumn("rank", F.row_number().over(order))
                 .select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank"))
    return pair_part.unionByName(term_part)


SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
counted AS (
  SELECT k, lang, source, term, count(*) AS n
  FROM (SELECT k, lang, source, unnest(words) AS term FROM docs) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n)::HUGEINT AS lang_n FROM counted GROUP BY ALL HAVING count(*) >= 30),
grp AS (SELECT DISTINCT lang, source FROM docs),
have AS (SELECT c.lang, c.source, c.term, sum(c.n)::HUGEINT AS n FROM counted c JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(lang_n)::HUGEINT AS total FROM kept GROUP BY lang),
tot AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM have GROUP BY ALL),
cell AS (
  SELECT g.lang, g.source, k.term, coalesce(h.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(h.n, 0) + 5)) // (coalesce(t.total, 0) + 5 * v.v) AS p,
         1 + (1000000000::HUGEINT * (k.lang_n + 5)) // (v.total + 5 * v.v) AS q
  FROM grp g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN tot t USING (lang, source)
  LEFT JOIN have h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term),
pair_sum AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM cell a JOIN cell b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair_sum s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
res AS (
  SELECT lang, source, 'pair' AS part, item, value,
         row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT,
         row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term)::INTEGER
  FROM cell WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank FROM res WHERE part = 'pair' OR rank <= 50
"""


@query("op13_source_divergence", SQL)
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(read_table(spark, sf_dir, "documents"))
