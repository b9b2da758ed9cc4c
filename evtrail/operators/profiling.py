"""Profiling and data-quality audits (C).

Every audit is one or two aggregate passes producing small result tables
(one row per column / relation / key statistic), never a driver loop over
data.  Per-column statistics unpivot the table once into (column, value)
so a wide table costs one shuffle, not one job per column.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evtrail.functions.topk import topk_per_group

# Keyword -> role used to classify column names.
ROLE_KEYWORDS = {
    "id": ("id", "key", "npi", "num"),
    "date": ("date", "time", "ts", "start", "stop", "dt"),
    "clinical": ("code", "diag", "proc", "drg", "icd", "hcpcs", "condition", "medication", "vital"),
    "quality": ("quality", "score", "mips"),
    "location": ("lat", "lon", "state", "zip", "city", "address", "nation", "region"),
    "telehealth": ("telehealth", "tele", "virtual"),
}

LEAKY_NAME_TOKENS = ("id", "key", "label", "target", "outcome", "future")


def column_roles(columns: Sequence[str]) -> list[tuple[str, str]]:
    """C1 (metadata): first matching role per column name, else 'other'."""
    out = []
    for c in columns:
        lc = c.lower()
        parts = set(lc.replace("-", "_").split("_"))
        role = "other"
        for r, kws in ROLE_KEYWORDS.items():
            if any(k in parts for k in kws):
                role = r
                break
        out.append((c, role))
    return out


def table_inventory(df: DataFrame, name: str, date_cols: Sequence[str] = ()) -> DataFrame:
    """Rows, columns, duplicate rows, and per-date-column min/max."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for d in date_cols:
        aggs += [F.date_format(F.min(d), "yyyy-MM-dd").alias(f"{d}_min"),
                 F.date_format(F.max(d), "yyyy-MM-dd").alias(f"{d}_max")]
    base = df.agg(*aggs)
    distinct_rows = df.distinct().agg(F.count(F.lit(1)).alias("_d"))
    return (base.crossJoin(distinct_rows)
            .select(F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).alias("n_cols"),
                    (F.col("n_rows") - F.col("_d")).alias("duplicate_rows"),
                    *[c for d in date_cols for c in (f"{d}_min", f"{d}_max")]))


def schema_catalogue(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table and column (place, name, type) with the table's
    files and rows.  Only file names and row counts are asked of the tables,
    which Parquet answers from its footers: no column is read."""
    spark = next(iter(tables.values())).sparkSession
    columns = spark.createDataFrame(
        [(t, i + 1, f.name, f.dataType.simpleString()) for t, df in tables.items() for i, f in enumerate(df.schema.fields)],
        "table_name string, position int, column_name string, dtype string")
    counts = reduce(DataFrame.unionByName, [
        df.select(F.col("_metadata.file_path").alias("file")).groupBy("file").agg(F.count(F.lit(1)).alias("n"))
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_files"))
        .select(F.lit(t).alias("table_name"), "n_rows", "n_files") for t, df in tables.items()])
    return columns.join(F.broadcast(counts), "table_name")                      # one row a table


def inventory(tables: dict[str, tuple[DataFrame, str | None]]) -> DataFrame:
    """C1 over several tables: rows, columns, duplicate rows and the first and
    last day of each table's date column (null without one)."""
    def one(name, df, day):
        t = table_inventory(df, name, [day] if day else [])
        ends = [F.col(f"{day}_{e}") if day else F.lit(None).cast("string") for e in ("min", "max")]
        return t.select("table_name", "n_rows", "n_cols", "duplicate_rows", ends[0].alias("first_day"),
                        ends[1].alias("last_day"))
    return reduce(DataFrame.unionByName, [one(n, df, day) for n, (df, day) in tables.items()])


def _long_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        [], list(cols), "column_name", "value")


def column_profile(df: DataFrame, cols: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Per column dtype, missing count/% , distinct count, blank count.
    ``exact=False`` uses HyperLogLog (no value shuffle) for huge tables."""
    cols = list(cols or df.columns)
    dtypes = dict(df.dtypes)
    long = _long_values(df, cols)
    if exact:
        per_val = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("_n"))
        stats = per_val.groupBy("column_name").agg(
            F.sum("_n").alias("n_rows"),
            F.sum(F.when(F.col("value").isNull(), F.col("_n")).otherwise(0)).alias("n_missing"),
            F.count("value").alias("n_distinct"),
            F.sum(F.when(F.trim(F.col("value")) == "", F.col("_n")).otherwise(0)).alias("n_blank"))
    else:
        stats = long.groupBy("column_name").agg(
            F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col("value").isNull(), 1)).alias("n_missing"),
            F.approx_count_distinct("value").alias("n_distinct"),
            F.count(F.when(F.trim(F.col("value")) == "", 1)).alias("n_blank"))
    types = df.sparkSession.createDataFrame([(c, dtypes[c]) for c in cols], "column_name string, dtype string")
    return (stats.join(F.broadcast(types), "column_name")
            .withColumn("pct_missing", F.round(F.col("n_missing") * 100.0 / F.col("n_rows"), 4)))


def schema_drift(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Present vs expected columns -> (column_name, status)."""
    spark = df.sparkSession
    have = spark.createDataFrame([(c,) for c in df.columns], "column_name string")
    want = spark.createDataFrame([(c,) for c in expected], "column_name string")
    j = have.withColumn("h", F.lit(1)).join(want.withColumn("w", F.lit(1)), "column_name", "full")
    return j.select("column_name", F.when(F.col("h").isNull(), "missing").when(F.col("w").isNull(), "additional")
                    .otherwise("present").alias("status"))


def sample_values(df: DataFrame, cols: Sequence[str], k: int = 5) -> DataFrame:
    """The k smallest distinct non-null values per column (sorted, so
    deterministic), via salted two-level top-k -- no unbounded collect."""
    long = _long_values(df, cols).where(F.col("value").isNotNull()).distinct()
    top = topk_per_group(long, ["column_name"], [F.col("value")], k)
    return top.groupBy("column_name").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "value"))), lambda s: s["value"]),
                     " | ").alias("examples"))


def stage_log(stages: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Rows per named stage (one count aggregate per stage, unioned)."""
    out = None
    for i, (name, d) in enumerate(stages):
        q = d.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(i).alias("step"), F.lit(name).alias("stage"),
                                                              "n_rows")
        out = q if out is None else out.unionByName(q)
    return out


def orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str, relation: str,
            k: int = 5) -> DataFrame:
    """Orphan child keys (not null, missing in parent): count + k samples."""
    ck = child.select(F.col(child_key).alias("_k")).where(F.col("_k").isNotNull()).distinct()
    pk = parent.select(F.col(parent_key).alias("_k")).distinct()
    orph = ck.join(pk, "_k", "left_anti")
    cnt = orph.agg(F.count(F.lit(1)).alias("orphan_keys"))
    smp = topk_per_group(orph.withColumn("_g", F.lit(1)), ["_g"], [F.col("_k")], k)
    smp = smp.agg(F.array_join(F.transform(F.sort_array(F.collect_list("_k")), lambda x: x.cast("string")), ",")
                  .alias("samples"))
    return cnt.crossJoin(smp).select(F.lit(relation).alias("relation"), "orphan_keys",
                                     F.coalesce("samples", F.lit("")).alias("samples"))


def fk_match_rate(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str, relation: str) -> DataFrame:
    """% child rows whose key has a parent (left join to distinct parents)."""
    pk = parent.select(F.col(parent_key).alias("_p")).distinct().withColumn("_hit", F.lit(1))
    j = child.select(F.col(child_key).alias("_p")).join(pk, "_p", "left")
    return j.agg(F.count(F.lit(1)).alias("child_rows"), F.count("_hit").alias("matched")).select(
        F.lit(relation).alias("relation"), "child_rows", "matched",
        F.round(F.col("matched") * 100.0 / F.col("child_rows"), 4).alias("match_pct"))


def id_overlap(a: DataFrame, a_key: str, b: DataFrame, b_key: str, name: str) -> DataFrame:
    """Distinct ids in a, in b, in both, % of a."""
    da = a.select(F.col(a_key).alias("_k")).where(F.col("_k").isNotNull()).distinct()
    db = b.select(F.col(b_key).alias("_k")).where(F.col("_k").isNotNull()).distinct()
    both = da.intersect(db).agg(F.count(F.lit(1)).alias("n_both"))
    na = da.agg(F.count(F.lit(1)).alias("n_a"))
    nb = db.agg(F.count(F.lit(1)).alias("n_b"))
    return (na.crossJoin(nb).crossJoin(both)
            .select(F.lit(name).alias("pair"), "n_a", "n_b", "n_both",
                    F.round(F.col("n_both") * 100.0 / F.col("n_a"), 4).alias("pct_of_a")))


def key_uniqueness(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Rows, distinct keys, duplicate-key rows."""
    n = df.agg(F.count(F.lit(1)).alias("n_rows"))
    d = df.select(*keys).distinct().agg(F.count(F.lit(1)).alias("n_keys"))
    return n.crossJoin(d).select(F.lit(name).alias("table_name"), "n_rows", "n_keys",
                                 (F.col("n_rows") - F.col("n_keys")).alias("duplicate_rows"))


def global_distinct(frames: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """C11: distinct keys across several tables."""
    u = None
    for d, k in frames:
        x = d.select(F.col(k).alias("key"))
        u = x if u is None else u.unionByName(x)
    return u.where(F.col("key").isNotNull()).distinct().agg(F.count(F.lit(1)).alias("distinct_keys"))


def rows_per_key(df: DataFrame, key: str) -> DataFrame:
    """Distribution of rows per key."""
    per = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("n_keys"), F.min("n").alias("min_rows"), F.max("n").alias("max_rows"),
                   F.round(F.avg("n"), 6).alias("mean_rows"),
                   F.percentile(F.col("n").cast("double"), 0.5).alias("median_rows"))


def varying_within_key(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Fields that take >1 value (null counts as a value) within a key
    -> (key, field, num_values, values_found)."""
    tok = "<null>"
    long = df.select(key, *[F.coalesce(F.col(f).cast("string"), F.lit(tok)).alias(f) for f in fields]).unpivot(
        [key], list(fields), "field", "value")
    per = long.groupBy(key, "field", "value").agg(F.count(F.lit(1)).alias("_n"))
    agg = per.groupBy(key, "field").agg(F.count(F.lit(1)).alias("num_values"),
                                        F.array_join(F.sort_array(F.collect_list("value")), "|").alias("values_found"))
    return agg.where(F.col("num_values") > 1)


def domain_violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """C14: count rows violating each named domain check."""
    agg = df.agg(*[F.count(F.when(~cond | cond.isNull(), 1)).alias(n) for n, cond in checks.items()])
    return agg.unpivot([], list(checks), "check_name", "violations")


def severity_checks(df: DataFrame, checks: dict[str, Column], high_pct: float = 1.0) -> DataFrame:
    """Count / % of rows flagged by each check with severity and action."""
    agg = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(F.when(c, 1)).alias(n) for n, c in checks.items()])
    long = agg.unpivot(["_n"], list(checks), "check_name", "n_flagged")
    pct = F.round(F.col("n_flagged") * 100.0 / F.col("_n"), 4)
    return long.select("check_name", "n_flagged", pct.alias("pct"),
                       F.when(pct > high_pct, "HIGH").when(F.col("n_flagged") > 0, "LOW").otherwise("NONE")
                       .alias("severity"),
                       F.when(pct > high_pct, "investigate source").when(F.col("n_flagged") > 0, "clip or null")
                       .otherwise("none").alias("action"))


def leakage_audit(df: DataFrame, features: Sequence[str], recency_cols: Sequence[str]) -> DataFrame:
    """Id-like feature names and negative recency counts."""
    spark = df.sparkSession
    names = spark.createDataFrame(
        [(f, int(any(t in f.lower().split("_") for t in LEAKY_NAME_TOKENS))) for f in features],
        "feature string, id_like int")
    neg = df.agg(*[F.count(F.when(F.col(c) < 0, 1)).alias(c) for c in recency_cols]) \
        .unpivot([], list(recency_cols), "feature", "negative_values") if recency_cols else None
    out = names if neg is None else names.join(neg, "feature", "left")
    return out.select("feature", "id_like", F.coalesce("negative_values", F.lit(0)).alias("negative_values")
                      if neg is not None else F.lit(0).alias("negative_values"))


def quality_flags(profile: DataFrame, max_missing_pct: float = 50.0) -> DataFrame:
    """C17: features with >50% missing or <=1 distinct value."""
    return profile.select("column_name", (F.col("pct_missing") > max_missing_pct).cast("int").alias("high_missing"),
                          (F.col("n_distinct") <= 1).cast("int").alias("constant")) \
        .where((F.col("high_missing") == 1) | (F.col("constant") == 1))


def leakage_gate(audit: DataFrame) -> DataFrame:
    """Fail the job when the audit finds leakage (``raise_error`` runs on
    the executors as part of the plan)."""
    bad = (F.col("id_like") == 1) | (F.col("negative_values") > 0)
    return audit.select("feature", F.when(bad, F.raise_error(F.concat(F.lit("leakage: "), F.col("feature"))))
                        .otherwise(F.lit("ok")).alias("gate"))


def feature_availability(profile: DataFrame, required: Sequence[str]) -> DataFrame:
    """C20: required feature list joined to the profile."""
    req = profile.sparkSession.createDataFrame([(r,) for r in required], "column_name string")
    j = req.join(profile, "column_name", "left")
    return j.select("column_name", F.col("n_rows").isNotNull().cast("int").alias("exists"),
                    F.coalesce("pct_missing", F.lit(100.0)).alias("pct_missing"),
                    F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"))


def cohort_summary(df: DataFrame, name: str, entity: str, label: str, ts: str, n_features: int) -> DataFrame:
    """One row per cohort: entities, rows, prevalence, time range."""
    return df.agg(F.count_distinct(entity).alias("entities"), F.count(F.lit(1)).alias("rows"),
                  F.round(F.avg(label), 6).alias("prevalence"),
                  F.date_format(F.min(ts), "yyyy-MM-dd").alias("first_date"),
                  F.date_format(F.max(ts), "yyyy-MM-dd").alias("last_date")) \
        .select(F.lit(name).alias("cohort"), "*", F.lit(n_features).alias("n_features"))


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Target / split value counts."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def numeric_summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Missing, distinct, variance (sample) per numeric feature."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "feature", "v")
    return long.groupBy("feature").agg(F.count(F.when(F.col("v").isNull(), 1)).alias("n_missing"),
                                       F.count_distinct("v").alias("n_distinct"),
                                       F.round(F.var_samp("v"), 4).alias("variance"))


def scores_agree(a: DataFrame, b: DataFrame, key: str, col: str, tol: float = 1e-5) -> DataFrame:
    """Two scorings aligned on key agree within tol."""
    j = a.select(key, F.col(col).alias("_a")).join(b.select(key, F.col(col).alias("_b")), key, "full")
    return j.agg(F.count(F.lit(1)).alias("n"),
                 F.count(F.when(F.abs(F.col("_a") - F.col("_b")) <= tol, 1)).alias("n_agree"),
                 F.count(F.when(F.col("_a").isNull() | F.col("_b").isNull(), 1)).alias("n_unaligned"))
