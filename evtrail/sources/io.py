"""Scans, sources and sinks (A).

All scratch output lives under the shared folder the cluster names in
``spark.checkpoint.dir`` (see :func:`evtrail.session.ensure_checkpoint_dir`),
never in a machine-local temporary folder.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evtrail.functions.text import normalize_header
from evtrail.session import cut_lineage, ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/evtrail-io/{name}-{uuid.uuid4().hex[:12]}"


# ------------------------------------------------------------- readers ----

def read_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """A1: every column as string (no inference), header row."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def read_typed_csv(spark: SparkSession, path: str, schema: T.StructType, date_format: str = "yyyy-MM-dd",
                   timestamp_format: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """A2: explicit schema, date/timestamp formats."""
    return (spark.read.schema(schema).option("header", True).option("dateFormat", date_format)
            .option("timestampFormat", timestamp_format).csv(path))


def pruned_scan(spark: SparkSession, path: str, columns: Sequence[str], where=None) -> DataFrame:
    """A3: projection (and filter) pushed into the parquet scan."""
    df = spark.read.parquet(path).select(*columns)
    return df if where is None else df.where(where)


def read_csv_checked(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """A4: well-formed rows (DROPMALFORMED semantics) and the malformed
    lines, from one PERMISSIVE read with a corrupt-record column."""
    sch = T.StructType(list(schema.fields) + [T.StructField("_corrupt_record", T.StringType())])
    raw = (spark.read.schema(sch).option("header", True).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", "_corrupt_record").csv(path))
    # queries over a raw file may not reference only the corrupt-record
    # column: persist the parsed rows once (reliable checkpoint) and split
    raw = cut_lineage(raw)
    good = raw.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    bad = raw.where(F.col("_corrupt_record").isNotNull()).select("_corrupt_record")
    return good, bad


def read_lines_checked(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",") -> tuple[DataFrame, DataFrame]:
    """A4: (rows, skipped lines): lines with another number of fields than the
    schema are skipped; a field that does not parse is null, as in the
    reader.  For files without quoted separators."""
    lines = spark.read.text(path).select(F.col("value").alias("_line"), F.split("value", re.escape(sep), -1).alias("_f"))
    fits = F.size("_f") == len(schema.fields)
    good = lines.where(fits).select(*[F.expr(f"try_cast(_f[{i}] AS {f.dataType.simpleString()})").alias(f.name)
                                      for i, f in enumerate(schema.fields)])
    return good, lines.where(~fits).select("_line")


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None, multi_line: bool = False) -> DataFrame:
    """JSON source (``multi_line`` for one document/array per file)."""
    r = spark.read.option("multiLine", multi_line)
    return (r.schema(schema) if schema is not None else r).json(path)


def read_with_file_key(spark: SparkSession, glob: str, fmt: str = "parquet",
                       key_pattern: str | None = None) -> DataFrame:
    """Multi-file read with the source file and an optional key
    extracted from the path."""
    df = spark.read.format(fmt).load(glob).withColumn("source_file", F.input_file_name())
    if key_pattern:
        df = df.withColumn("file_key", F.regexp_extract("source_file", key_pattern, 1))
    return df


def sql_scan(spark: SparkSession, sql: str, args: Mapping | None = None, **frames: DataFrame) -> DataFrame:
    """Parameterised SQL over DataFrames (named markers ``:p``)."""
    return spark.sql(sql, args=dict(args or {}), **frames)


# ------------------------------------------------------------- headers ----

def normalise_headers(df: DataFrame) -> DataFrame:
    """Lower, ``[^a-z0-9_]`` -> ``_``, collapse, strip."""
    return df.toDF(*[normalize_header(c) for c in df.columns])


def _key(s: str) -> str:
    return re.sub(r"[\s_\-]+", "", s.strip().lower())


def apply_aliases(df: DataFrame, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rename columns through an alias map, matching case- and
    space-insensitively; unmatched columns are kept."""
    lookup = {_key(a): target for target, names in aliases.items() for a in [target, *names]}
    return df.select(*[F.col(f"`{c}`").alias(lookup.get(_key(c), c)) for c in df.columns])


# --------------------------------------------------------------- sinks ----

def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> str:
    """Parquet, optionally partitioned (partition pruning on read)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def write_csv(df: DataFrame, path: str, header: bool = True, mode: str = "overwrite") -> str:
    """A6."""
    df.write.mode(mode).option("header", header).csv(path)
    return path


def write_json_report(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Report rows as JSON lines (one object per row, written in parallel)."""
    df.write.mode(mode).json(path)
    return path


def save_bucketed_table(df: DataFrame, table: str, path: str, buckets: int, by: Sequence[str],
                        sort_by: Sequence[str] = ()) -> DataFrame:
    """External table bucketed (and sorted) on the lookup key: lookups
    read one bucket, joins on the key are co-located.  Returns the table."""
    w = df.write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, *by)
    (w.sortBy(*sort_by) if sort_by else w).saveAsTable(table)
    return df.sparkSession.table(table)


def batched_copy(df: DataFrame, path: str, key: str, n_batches: int = 4) -> DataFrame:
    """A10: one write, partitioned by hash batch, and a reconciliation of the
    row counts; returns (source_rows, target_rows, batches)."""
    b = F.pmod(F.xxhash64(F.col(key)), F.lit(n_batches))
    df.withColumn("_batch", b).write.mode("overwrite").partitionBy("_batch").parquet(path)
    src = df.agg(F.count(F.lit(1)).alias("source_rows"))
    tgt = df.sparkSession.read.parquet(path).agg(F.count(F.lit(1)).alias("target_rows"))
    return src.crossJoin(tgt).withColumn("batches", F.lit(n_batches)) \
        .withColumn("reconciled", F.col("source_rows") == F.col("target_rows"))
