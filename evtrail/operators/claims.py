"""Claims reshaping and aggregation (D)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evtrail.functions.dates import day_number


def unpivot_codes(df: DataFrame, id_cols: Sequence[str], prefix: str,
                  slot_col: str = "slot", code_col: str = "code") -> DataFrame:
    """Wide repeated code columns (``prefix*``) -> long rows, blanks dropped."""
    cols = [c for c in df.columns if c.startswith(prefix)]
    long = df.select(*id_cols, *[F.col(c).cast("string") for c in cols]).unpivot(
        list(id_cols), cols, slot_col, code_col)
    return long.where(F.col(code_col).isNotNull() & (F.trim(F.col(code_col)) != ""))


def code_list(code: Column, sep: str = "|") -> Column:
    """D2 aggregate: distinct sorted codes joined by ``sep`` (set union is a
    partial aggregate; the result is bounded by the code vocabulary)."""
    return F.array_join(F.sort_array(F.collect_set(code)), sep)


def collapse_claims(lines: DataFrame, claim: str, segment: str, code_prefix: str | None = "code_",
                    first_cols: Sequence[str] = (), min_ts: Sequence[str] = (), max_ts: Sequence[str] = (),
                    sum_cols: Sequence[str] = (), sep: str = "|") -> DataFrame:
    """D3+D1+D2+D4 fused: one ``groupBy(claim)`` gives min from, max thru,
    summed payment, first-by-segment ids and the distinct code list."""
    aggs = [F.min(c).alias(c) for c in min_ts] + [F.max(c).alias(c) for c in max_ts]
    aggs += [F.sum(c).alias(c) for c in sum_cols]
    # first non-null value in segment order; duplicate segments tie-break on
    # the value itself so the result never depends on row order
    aggs += [F.min(F.struct(F.col(c).isNull().alias("n"), F.col(segment).alias("s"), F.col(c).alias("v")))["v"]
             .alias(c) for c in first_cols]
    aggs.append(F.count(F.lit(1)).alias("n_segments"))
    if code_prefix:
        # the distinct codes of a claim are bounded by the code vocabulary
        cols = [c for c in lines.columns if c.startswith(code_prefix)]
        own = F.filter(F.transform(F.array(*[F.col(c).cast("string") for c in cols]), lambda x: F.trim(x)),
                       lambda x: x.isNotNull() & (x != ""))
        codes = F.sort_array(F.array_distinct(F.flatten(F.collect_set(own))))
        aggs.append(F.when(F.size(codes) > 0, F.array_join(codes, sep)).alias("codes"))
    return lines.groupBy(claim).agg(*aggs)


def union_aligned(*dfs: DataFrame) -> DataFrame:
    """Union by name, missing columns become null."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def code_set_flag(codes: Column, code_set: Sequence[str], sep: str = "|") -> Column:
    """1 when the pipe list shares a code with ``code_set``."""
    arr = F.split(F.coalesce(codes, F.lit("")), "\\" + sep if sep in "|.^$*+?()[]{}\\" else sep)
    return F.arrays_overlap(arr, F.array(*[F.lit(c) for c in code_set])).cast("int")


def tri_state(codes: Column, flag: Column) -> Column:
    """CONFIRMED / UNKNOWN (no codes) / NON."""
    return (F.when(flag == 1, "CONFIRMED")
            .when(codes.isNull() | (F.trim(codes) == ""), "UNKNOWN").otherwise("NON"))


def los_days(start, end) -> Column:
    """Length of stay in days, null -> 0."""
    return F.coalesce(F.datediff(F.to_date(end), F.to_date(start)), F.lit(0))


def entity_summary(events: DataFrame, entity: str, ts: str, windows: Sequence[int] = (30, 90, 180, 365)) -> DataFrame:
    """Per entity vs the dataset max date: total, counts within w days,
    first/latest date and days since latest.  The max date is one row."""
    mx = events.agg(F.max(F.to_date(ts)).alias("_max"))
    e = events.where(F.col(ts).isNotNull()).crossJoin(F.broadcast(mx))
    age = F.datediff(F.col("_max"), F.to_date(ts))
    aggs = [F.count(F.lit(1)).alias("total_events")]
    aggs += [F.count(F.when(age <= w, 1)).alias(f"events_{w}d") for w in windows]
    aggs += [F.min(F.to_date(ts)).alias("first_date"), F.max(F.to_date(ts)).alias("latest_date"),
             F.min(age).alias("days_since_latest")]
    return e.groupBy(entity).agg(*aggs)


def exists_in_day_window(queries: DataFrame, events: DataFrame, entity: str, q_day: str, e_day: str,
                         lo: int, hi: int, name: str = "found") -> DataFrame:
    """Range semi-join without pairs: does ``events`` have a row of the same
    entity with day in [q_day+lo, q_day+hi]?  Events are counted per
    (entity, day), query days are merged in, and a RANGE frame answers all
    queries in one sorted pass."""
    ev = events.groupBy(F.col(entity).alias("_e"), F.col(e_day).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    qk = queries.select(F.col(entity).alias("_e"), F.col(q_day).alias("_k")).distinct()
    pts = ev.join(qk, ["_e", "_k"], "full").select("_e", "_k", F.coalesce("_n", F.lit(0)).alias("_n"))
    frame = Window.partitionBy("_e").orderBy("_k").rangeBetween(lo, hi)
    vals = pts.select("_e", "_k", (F.coalesce(F.sum("_n").over(frame), F.lit(0)) > 0).alias(name))
    return queries.join(vals, (queries[entity] == vals["_e"]) & (queries[q_day] == vals["_k"]), "left").drop("_e", "_k")


def entity_year(df: DataFrame, entity: str, ts: str, flag_exprs: dict[str, Column]) -> DataFrame:
    """Entity-year roll: flags (any in year), burden = Σ flags,
    coverage months = distinct active months."""
    aggs = [F.max(cond.cast("int")).alias(n) for n, cond in flag_exprs.items()]
    aggs.append(F.count_distinct(F.month(ts)).alias("coverage_months"))
    out = df.groupBy(F.col(entity), F.year(ts).alias("year")).agg(*aggs)
    return out.withColumn("burden", sum((F.col(n) for n in flag_exprs), F.lit(0)))


def groups_having(df: DataFrame, keys: Sequence[str], min_count: int = 2) -> DataFrame:
    """Groups with more than one row."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def daynum(ts) -> Column:
    return day_number(ts)
