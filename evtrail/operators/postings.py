"""Inverted index of documents and top-k search that skips hopeless ones.

The index is a table of postings (document, term, tf) dealt by document, and
one row per term with its document count and its greatest tf, which bounds
what the term can add to any score.

Search, per query (all queries at once, as DataFrames):

1. the documents of its rarest terms are scored in full; the k-th best of
   them is a threshold no result can be below;
2. its terms are ordered by document count.  The most common ones whose
   bounds (and the tag bonus) together stay below a share of the threshold
   cannot lift a document into the result by themselves: only documents that
   hold one of the other, essential terms are looked at, and of these only
   those whose essential score and all that is left reach the threshold;
3. these are scored in full.

Exact: a document that is left out scores below the threshold.  Postings that
no query term needs are dropped before they are dealt.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evtrail.functions.prefix import dealt_by_rows
from evtrail.functions.text import word_tokens
from evtrail.functions.topk import topk_per_group
from evtrail.sources.io import scratch_path

SEED_DOCS = 16      # times k: documents of rare terms that set the threshold
DOCS_PER_TASK = 5000     # their words are made and counted in one task
SHARE = 0.5         # of the threshold that a query's common terms stay below together


def _written(df: DataFrame, name: str) -> DataFrame:
    """Written first: used more than once, and the planner knows its size."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass
class PostingsIndex:
    postings: DataFrame         # _d, term, tf
    terms: DataFrame            # term, df, max_tf
    tags: DataFrame             # _d, _tags (documents with a tag)
    rows: int                   # postings


def build_index(docs: DataFrame, d_id: str, d_text: Column, d_tags: Column | None = None,
                vocabulary: DataFrame | None = None) -> PostingsIndex:
    """Index of ``docs``; with ``vocabulary`` (column ``term``) of these terms
    only.  Tags are document text as well."""
    none = F.array().cast("array<string>")
    text = d_text if d_tags is None else F.concat_ws(" ", d_text, F.array_join(d_tags, " "))
    d = docs.select(F.col(d_id).alias("_d"), text.alias("_text"),
                    F.array_distinct(F.transform(F.coalesce(d_tags if d_tags is not None else none, none),
                                                 lambda t: F.lower(t))).alias("_tags"))
    # dealt by document before the words are made: their counts stay in place
    texts = dealt_by_rows(d.select("_d", "_text").repartition("_d"), docs.count(), "_d", per_task=DOCS_PER_TASK)
    words = texts.select("_d", F.explode(word_tokens(F.col("_text"))).alias("term"))
    if vocabulary is not None:
        words = words.join(vocabulary.select("term").distinct(), "term", "left_semi")
    postings = _written(words.groupBy("_d", "term").agg(F.count(F.lit(1)).alias("tf")), "postings")
    terms = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("tf").alias("max_tf"))
    return PostingsIndex(postings, terms, d.select("_d", "_tags").where(F.size("_tags") > 0), postings.count())


def _score(index: PostingsIndex, dealt: DataFrame, pairs: DataFrame, query_terms: DataFrame, filters: DataFrame,
           tag_bonus: float) -> DataFrame:
    """(_q, _d, score) of the pairs, all their terms counted."""
    wanted = pairs.join(query_terms.select("_q", "term", "qtf"), "_q")
    own = lambda df: dealt_by_rows(df, index.rows, "_d", "term")
    lexical = (own(wanted).join(own(dealt), ["_d", "term"])
               .groupBy("_q", "_d").agg(F.sum(F.least("tf", "qtf")).alias("_l")))
    with_tags = lexical.join(index.tags, "_d", "left").join(filters, "_q", "left")
    bonus = F.when(F.arrays_overlap("_tags", "_qf"), tag_bonus).otherwise(0.0)
    return with_tags.select("_q", "_d", (F.col("_l") + bonus).alias("score"))


def candidates(index: PostingsIndex, query_terms: DataFrame, filters: DataFrame, k: int, tag_bonus: float) -> tuple:
    """(pairs to score in full, dealt postings, bounded query terms).
    ``query_terms``: _q, term, qtf; ``filters``: _q, _qf (queries with a
    filter)."""
    own = query_terms.join(index.terms, "term").withColumn("bound", F.least("qtf", "max_tf"))
    rising = Window.partitionBy("_q").orderBy("df", "term")
    own = _written(
        own.withColumn("seen", F.coalesce(F.sum("df").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("left", F.sum("bound").over(rising.rowsBetween(Window.currentRow, Window.unboundedFollowing))),
        "query-bounds")
    dealt = index.postings.join(own.select("term").distinct(), "term", "left_semi")
    dealt = dealt_by_rows(dealt.repartition("_d"), index.rows, "_d")

    def holders(terms: DataFrame) -> DataFrame:
        return dealt.join(terms.select("_q", "term"), "term").select("_q", "_d").distinct()

    seeds = _score(index, dealt, holders(own.where(F.col("seen") < SEED_DOCS * k)), own, filters, tag_bonus)
    threshold = (topk_per_group(seeds, ["_q"], [F.col("score").desc(), F.col("_d")], k)
                 .where(F.col("rank") == k).select("_q", F.col("score").alias("least")))
    most_bonus = F.when(F.col("_qf").isNotNull(), F.lit(tag_bonus)).otherwise(0.0)
    # written: used twice, and where it is small the postings are met in place
    bounded = _written(own.join(threshold, "_q", "left").join(filters, "_q", "left").withColumn(
        "common", F.coalesce(F.col("left") < SHARE * F.col("least") - most_bonus, F.lit(False))), "query-reach")
    reach = bounded.groupBy("_q").agg(F.max("least").alias("least"), F.max(most_bonus).alias("most_bonus"),
                                      F.coalesce(F.max(F.when(F.col("common"), F.col("left"))), F.lit(0)).alias("rest"))
    met = (dealt.join(bounded.where(~F.col("common")).select("_q", "term", "qtf"), "term")
           .groupBy("_q", "_d").agg(F.sum(F.least("tf", "qtf")).alias("_l")).join(reach, "_q"))
    open_ = F.col("least").isNull() | (F.col("_l") + F.col("rest") + F.col("most_bonus") >= F.col("least"))
    return met.where(open_).select("_q", "_d"), dealt, own


def search_index(index: PostingsIndex, query_terms: DataFrame, filters: DataFrame, k: int, tag_bonus: float) -> DataFrame:
    """(_q, _d, score, rank): the best ``k`` of each query by score, then id,
    among the documents that share a term with it."""
    pairs, dealt, own = candidates(index, query_terms, filters, k, tag_bonus)
    scored = _score(index, dealt, pairs, own, filters, tag_bonus)
    return topk_per_group(scored, ["_q"], [F.col("score").desc(), F.col("_d")], k)
