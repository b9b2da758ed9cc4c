"""Service queries and dashboard aggregates (L).

Point lookups and pages are filters + ordered limits (the limit is the
feature); dashboards are one aggregate each; state lifecycles are
append-only event logs reduced with ``max_by`` -- last authorised write
wins -- with rejected events kept in their own table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup_or_latest(rows: DataFrame, requests: DataFrame, entity: str, event: str, ts: str,
                     req_event: str = "req_event") -> DataFrame:
    """L1: per request (entity, requested event) the exact row if present,
    else the entity's latest row: an equi-join on (entity, event) and one row
    per entity, never every row of an entity against every request."""
    others = [c for c in rows.columns if c not in (entity, event, ts)]
    pick = F.max(F.struct(F.col(ts).alias("_t"), F.col(event).alias("_e"), *others)).alias("_m")
    latest = rows.groupBy(entity).agg(pick)
    exact = rows.groupBy(entity, F.col(event).alias(req_event)).agg(pick).withColumnRenamed("_m", "_x")
    j = requests.join(latest, entity).join(exact, [entity, req_event], "left")
    m = F.coalesce("_x", "_m")
    return j.select(entity, req_event, F.col("_x").isNotNull().cast("int").alias("exact_match"),
                    m["_e"].alias(event), m["_t"].alias(ts), *[m[c].alias(c) for c in others])


def id_search(df: DataFrame, col: str, needle: str, order: str, limit: int = 50) -> DataFrame:
    """L2: case-insensitive substring search, ordered page (limit is the feature)."""
    return df.where(F.col(col).ilike(f"%{needle}%")).orderBy(order).limit(limit)


def top_n(df: DataFrame, where: Column, order: Sequence[Column], n: int = 3) -> DataFrame:
    """L3: flagged top n (TakeOrderedAndProject)."""
    return df.where(where).orderBy(*order).limit(n)


def dashboard_counts(rows: DataFrame, entity: str, ed90: str, appts: DataFrame, status: str) -> DataFrame:
    """L4: total rows; distinct entities with >=2 ED visits in 90 d; scheduled."""
    a = rows.agg(F.count(F.lit(1)).alias("rows"),
                 F.count_distinct(F.when(F.col(ed90) >= 2, F.col(entity))).alias("frequent_ed_patients"))
    b = appts.agg(F.count(F.when(F.col(status) == "Scheduled", 1)).alias("scheduled"))
    return a.crossJoin(b)


def newest_first(df: DataFrame, entity: str, ts: str, id_col: str) -> DataFrame:
    """Every entity's rows newest first (rank column), by the global
    rank within entities, so a very busy entity is ranked in parallel."""
    from evtrail.functions.prefix import global_rank
    d = df.withColumns({"_nt": -F.unix_micros(F.col(ts).cast("timestamp")), "_ni": -F.col(id_col)})
    return global_rank(d, "_nt", ["_ni"], group_cols=[entity], name="recency_rank").drop("_nt", "_ni")


def status_counts_with_all(df: DataFrame, status: str) -> DataFrame:
    """Per-status counts plus an 'All' total (rollup)."""
    r = df.rollup(status).agg(F.count(F.lit(1)).alias("n"), F.grouping(status).alias("_g"))
    return r.select(F.when(F.col("_g") == 1, F.lit("All")).otherwise(F.col(status)).alias(status), "n")


def status_cube(df: DataFrame, fields: list[str]) -> DataFrame:
    """L6 by several fields in one scan: counts per combination, per single
    field and in all (grouping sets); a field that is summed over is 'All'."""
    sets = [[F.col(f) for f in fields], *([F.col(f)] for f in fields), []]
    r = df.groupingSets(sets, *fields).agg(F.count(F.lit(1)).alias("n"), *[F.grouping(f).alias(f"_g_{f}") for f in fields])
    return r.select(*[F.when(F.col(f"_g_{f}") == 1, F.lit("All")).otherwise(F.col(f)).alias(f) for f in fields], "n")


def upcoming_past(df: DataFrame, status: str, upcoming=("Scheduled", "Rescheduled")) -> DataFrame:
    """L18."""
    return df.groupBy(F.when(F.col(status).isin(*upcoming), "upcoming").otherwise("past").alias("bucket")) \
        .agg(F.count(F.lit(1)).alias("n"))


def lifecycle(events: DataFrame, owners: DataFrame, key: str, status: str, ts: str, actor: str,
              owner: str, seq: str) -> tuple[DataFrame, DataFrame]:
    """Status events -> latest state per key from authorised events only
    (actor is the owner); unauthorised events go to a rejects table."""
    j = events.join(owners, key, "left")
    ok = j.where(F.col(actor) == F.col(owner))
    rejects = j.where((F.col(actor) != F.col(owner)) | F.col(owner).isNull()).select(key, status, ts, actor)
    latest = ok.groupBy(key).agg(F.max_by(status, F.struct(ts, seq)).alias("current_status"),
                                 F.count(F.lit(1)).alias("n_events"))
    return latest, rejects


def validated_append(existing: DataFrame, new: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """Append rows passing ``valid``; others go to rejects."""
    return existing.unionByName(new.where(valid), allowMissingColumns=True), new.where(~valid | valid.isNull())


def row_access(rows: DataFrame, viewer_id: str, role: str, owner_col: str, patient_id=None) -> DataFrame:
    """The rows one viewer may see: a patient their own, a manager all."""
    if role == "manager":
        return rows.withColumn("viewer_id", F.lit(viewer_id))
    return rows.where(F.col(owner_col) == F.lit(patient_id)).withColumn("viewer_id", F.lit(viewer_id))


def visible_rows(rows: DataFrame, viewers: DataFrame, owner_col: str) -> DataFrame:
    """How many rows each viewer (viewer_id, role, patient_id) may see.
    Rows are counted per owner first; managers share the one total, so no
    (viewer, row) pair is built."""
    per = rows.groupBy(F.col(owner_col).alias("_o")).agg(F.count(F.lit(1)).alias("_n"))
    total = per.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_all"))          # one row
    v = viewers.join(per, F.col("patient_id") == F.col("_o"), "left").crossJoin(F.broadcast(total))
    n = F.when(F.col("role") == "manager", F.col("_all")).otherwise(F.coalesce("_n", F.lit(0)))
    return v.select("viewer_id", n.alias("visible_rows")).where("visible_rows > 0")


def monthly_trend(df: DataFrame, ts: str, flag: Column) -> DataFrame:
    """L10."""
    return df.groupBy(F.date_format(F.date_trunc("month", ts), "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("total"), F.count(F.when(flag, 1)).alias("flagged"))


def share_of_total(df: DataFrame, cat: str) -> DataFrame:
    """Count / total over the (small) category table."""
    c = df.groupBy(cat).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


def trend_ranking(df: DataFrame, cat: str, period: Column) -> DataFrame:
    """Counts per (category, period), period-over-period change %,
    rank by latest count -- windows over the small aggregated table."""
    c = df.groupBy(cat, period.alias("period")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(cat).orderBy("period")
    c = c.withColumn("prev", F.lag("n").over(w))
    c = c.withColumn("trend_pct", F.when(F.col("prev") > 0, (F.col("n") - F.col("prev")) * 100.0 / F.col("prev")))
    # categories by their latest count, ties by name
    latest = c.groupBy(cat).agg(F.max_by("n", "period").alias("_latest"))
    latest = latest.withColumn("rank", F.row_number().over(
        Window.partitionBy(F.lit(1)).orderBy(F.col("_latest").desc(), cat)))      # one row per category
    return c.drop("prev").join(latest.select(cat, "rank"), cat)


def funnel(df: DataFrame, ts: str, outcome: str, stages: Sequence[str]) -> DataFrame:
    """Per month, counts per outcome stage (pivot with explicit values)."""
    return (df.groupBy(F.date_format(F.date_trunc("month", ts), "yyyy-MM").alias("month"))
            .pivot(outcome, list(stages)).agg(F.count(F.lit(1))).fillna(0))


def cost_avoidance(df: DataFrame, flag: Column, unit_cost: float) -> DataFrame:
    """L14."""
    return df.agg(F.count(F.when(flag, 1)).alias("flagged"), F.count(F.lit(1)).alias("total")).select(
        "flagged", "total", (F.col("flagged") * unit_cost).alias("cost_avoidance"),
        (F.col("flagged") / F.col("total")).alias("flag_rate"))
