"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evtrail.session import ensure_checkpoint_dir

#: The six ASCII white-space characters every contract names: [\x20\x09-\x0D].
ASCII_SPACE = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder the cluster names in
    ``spark.checkpoint.dir`` and read it back: lineage is cut, the copy
    survives lost executors and row order and ids in it are fixed."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/evtrail-llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_row_key(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``docs`` written with a number for each row, and that column's name:
    rows are told apart whatever their ids, and every later scan sees the
    same numbers."""
    key = "row_key"
    while key in {c.lower() for c in docs.columns}:
        key += "_"
    return materialize(docs.withColumn(key, F.monotonically_increasing_id()), name), key


def least_hashed(rows: DataFrame, id_col: str, n: int, *aggs, where: str = "true") -> DataFrame:
    """At most ``n`` rows ``<id>, h, <aggs>``: one for each of the ids with the
    least hashes ``h`` whose aggregates meet ``where``.  Repeated ids are one
    row before the limit.  Only rows below a hash bound are grouped, and the
    bound widens until it holds ``n`` ids or all rows, so the sample is the
    same whatever the estimate it starts from; null ids are not in it."""
    rows = rows.where(F.col(id_col).isNotNull())
    known = rows.agg(F.approx_count_distinct(id_col)).first()[0]
    share = 4.0 * n / max(known, 1)
    while True:
        near = rows if share >= 1 else rows.where(F.xxhash64(id_col) < F.lit(int(-2 ** 63 + share * 2 ** 64)))
        out = (near.groupBy(id_col).agg(*aggs).where(where).withColumn("h", F.xxhash64(id_col))
               .orderBy("h", id_col).limit(n))
        if share >= 1 or out.count() == n:
            return out
        share *= 8


def in_arrow(df: DataFrame, fn, schema) -> DataFrame:
    """``mapInArrow`` for rows that hold whole texts: batches of at most a
    thousand rows, so that what a task has in hand stays small."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return df.mapInArrow(fn, schema)


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def text_bytes(col: str = "text"):
    """UTF-8 bytes of a text column (null: empty), for Arrow tasks that work on bytes."""
    return text_or_empty(col).cast("binary")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph by alternating large-star
    and small-star rounds (each O(edges), no neighbourhood is collected).

    ``edges``: two long columns ``a``, ``b``.  Returns ``node``, ``root``: the
    smallest node of the component, for every node that has an edge to
    another node; an empty edge table gives an empty result.  Each round is
    written to the shared folder, so a hub's join is one shuffle whose
    skewed side adaptive execution splits.
    """
    e = (edges.where("a <> b")
         .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    e = materialize(e, "cc")
    before = None
    for _ in range(max_rounds):
        # large star: neighbours greater than u hang on u's smallest neighbour
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m"))
                          .select("u", F.least("u", "m").alias("m")), "cc-low")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "cc-large")
        # small star: u and its smaller neighbours hang on the smallest of them
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "cc-low")
        j = large.join(low, "u")
        small = (j.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v")))).distinct()
        e = materialize(small, "cc")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("connected components did not converge")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
