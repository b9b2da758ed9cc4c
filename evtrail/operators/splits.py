"""Splits, folds and resampling (F).

Global orderings (chronological holdouts, expanding windows, thirds) use
:func:`evtrail.functions.prefix.global_rank` -- bucketed running counts --
so no split needs a single-partition window.  Counts (n, n per class) are
one-row aggregates joined back as broadcast scalars.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evtrail.functions.prefix import global_rank
from evtrail.functions.text import text_hash


def temporal_split(df: DataFrame, date_col: str, min_years: int = 3) -> DataFrame:
    """last year = test, previous = validation, earlier = train; fewer
    than ``min_years`` distinct years fails the job."""
    yrs = df.agg(F.max(F.year(date_col)).alias("_ymax"), F.count_distinct(F.year(date_col)).alias("_ny"))
    j = df.crossJoin(F.broadcast(yrs))
    y = F.year(date_col)
    split = (F.when(F.col("_ny") < min_years, F.raise_error(F.lit(f"temporal split needs >= {min_years} years")))
             .when(y == F.col("_ymax"), "test").when(y == F.col("_ymax") - 1, "validation").otherwise("train"))
    return j.withColumn("split", split).drop("_ymax", "_ny")


def year_map_split(df: DataFrame, date_col: str, year_map: dict[int, str], default: str = "exclude") -> DataFrame:
    """fixed year -> split map, default 'exclude'."""
    m = F.create_map(*[x for k, v in year_map.items() for x in (F.lit(k), F.lit(v))])
    return df.withColumn("split", F.coalesce(F.try_element_at(m, F.year(date_col)), F.lit(default)))


def grouped_holdout(df: DataFrame, entity: str, date_col: str, fractions=(0.6, 0.2)) -> DataFrame:
    """entities ordered by their last index date (then id); first 60%
    train, next 20% validation, rest test; rows inherit their entity's split."""
    last = df.groupBy(entity).agg(F.max(F.unix_date(F.to_date(date_col))).alias("_last"))
    ranked = global_rank(last, "_last", [entity], name="_r")
    n = last.agg(F.count(F.lit(1)).alias("_n"))
    r = ranked.crossJoin(F.broadcast(n))
    a = F.floor(F.col("_n") * fractions[0])
    b = F.floor(F.col("_n") * (fractions[0] + fractions[1]))
    sp = r.select(entity, F.when(F.col("_r") <= a, "train").when(F.col("_r") <= b, "validation").otherwise("test")
                  .alias("split"))
    return df.join(sp, entity)


def group_kfold(df: DataFrame, group: str, k: int = 5, seed: int = 0) -> DataFrame:
    """fold = hash(group) mod k [our choice: hash, not greedy balance]."""
    return df.withColumn("fold", F.pmod(text_hash(F.col(group), seed), F.lit(k)).cast("int"))


def expanding_folds(df: DataFrame, date_col: str, id_col: str, n_splits: int = 3) -> DataFrame:
    """rows ordered by (date, id); test size = n // (k+1); fold i trains
    on rows before (i+1)*size and tests on the next ``size`` rows.  Output:
    one row per (row, fold, role) -- only rows that take part in a fold."""
    ranked = global_rank(df.withColumn("_d", F.unix_micros(F.col(date_col).cast("timestamp"))), "_d", [id_col],
                         name="_r").drop("_d")
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    r = ranked.crossJoin(F.broadcast(n)).withColumn("_ts", F.floor(F.col("_n") / (n_splits + 1)))
    r = r.withColumn("_pos", F.col("_r") - 1)
    folds = F.sequence(F.lit(0), F.lit(n_splits - 1))
    e = r.select("*", F.explode(folds).alias("fold"))
    role = (F.when(F.col("_pos") < (F.col("fold") + 1) * F.col("_ts"), "train")
            .when(F.col("_pos") < (F.col("fold") + 2) * F.col("_ts"), "test"))
    return e.withColumn("role", role).where(F.col("role").isNotNull()).drop("_r", "_n", "_ts", "_pos")


def rolling_origin(df: DataFrame, date_col: str, label: str) -> DataFrame:
    """for each evaluation year y: fit < y-1, tune = y-1, hold = y; years
    whose hold or fit set is empty, or whose hold set has no positives, are
    skipped.  Output: (eval_year, role, n, positives)."""
    yr = df.select(F.year(date_col).alias("_y"), label)
    years = yr.select(F.col("_y").alias("eval_year")).distinct()
    per = yr.groupBy("_y").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label)).alias("positives"))
    j = years.crossJoin(per)   # (#years x #years): bounded by the calendar
    role = (F.when(F.col("_y") < F.col("eval_year") - 1, "fit").when(F.col("_y") == F.col("eval_year") - 1, "tune")
            .when(F.col("_y") == F.col("eval_year"), "hold"))
    t = j.withColumn("role", role).where(F.col("role").isNotNull()).groupBy("eval_year", "role").agg(
        F.sum("n").alias("n"), F.sum("positives").alias("positives"))
    ok = t.groupBy("eval_year").agg(
        F.max(F.when((F.col("role") == "hold") & (F.col("positives") > 0), 1).otherwise(0)).alias("_h"),
        F.max(F.when(F.col("role") == "fit", 1).otherwise(0)).alias("_f"))
    return t.join(ok.where((F.col("_h") == 1) & (F.col("_f") == 1)).select("eval_year"), "eval_year")


def stratified_kfold(df: DataFrame, label: str, id_col: str, k: int = 5, seed: int = 0) -> DataFrame:
    """within each class, rows ordered by a seeded hash then id get folds
    0..k-1 round-robin -- exact stratification (ranks via bucketed counts)."""
    h = df.withColumn("_h", text_hash(F.col(id_col), seed))
    r = global_rank(h, "_h", [id_col], group_cols=[label], name="_r")
    return r.withColumn("fold", ((F.col("_r") - 1) % k).cast("int")).drop("_h", "_r")


def split_audit(df: DataFrame, split: str, entity: str, date_col: str, label: str) -> DataFrame:
    """F8: per split: rows, entities, date range, class rate."""
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(entity).alias("entities"),
                                 F.date_format(F.min(date_col), "yyyy-MM-dd").alias("first_date"),
                                 F.date_format(F.max(date_col), "yyyy-MM-dd").alias("last_date"),
                                 F.avg(F.col(label).cast("double")).alias("positive_rate"))


def split_overlap(df: DataFrame, split: str, entity: str) -> DataFrame:
    """F8: entities shared by each pair of splits (per-entity split sets are
    bounded by the number of splits)."""
    per = df.groupBy(entity).agg(F.array_sort(F.collect_set(split)).alias("_s"))
    pairs = per.select(F.explode(F.filter(
        F.flatten(F.transform("_s", lambda a: F.transform("_s", lambda b: F.struct(a.alias("a"), b.alias("b"))))),
        lambda p: p["a"] < p["b"])).alias("p"))
    return pairs.groupBy(F.col("p.a").alias("split_a"), F.col("p.b").alias("split_b")).agg(
        F.count(F.lit(1)).alias("shared_entities"))


def temporal_thirds(df: DataFrame, date_col: str, id_col: str) -> DataFrame:
    """rows ordered by (date, id) split into thirds of n // 3, the last
    third takes the remainder."""
    ranked = global_rank(df.withColumn("_d", F.unix_micros(F.col(date_col).cast("timestamp"))), "_d", [id_col],
                         name="_r").drop("_d")
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    r = ranked.crossJoin(F.broadcast(n)).withColumn("_t", F.floor(F.col("_n") / 3))
    third = F.least(F.floor((F.col("_r") - 1) / F.col("_t")) + 1, F.lit(3)).cast("int")
    return r.withColumn("third", F.when(F.col("_t") > 0, third).otherwise(F.lit(3))).drop("_r", "_n", "_t")


def class_weight(df: DataFrame, label: str) -> DataFrame:
    """prevalence and (n - pos) / pos."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label)).cast("long").alias("positives")).select(
        "n", "positives", (F.col("positives") / F.col("n")).alias("prevalence"),
        F.when(F.col("positives") > 0, (F.col("n") - F.col("positives")) / F.col("positives")).alias("pos_weight"))


def assemble_oof(fold_outputs: Sequence[DataFrame]) -> DataFrame:
    """concatenate per-fold predictions."""
    out = fold_outputs[0]
    for d in fold_outputs[1:]:
        out = out.unionByName(d)
    return out
