"""Point-in-time cohort, look-back features and look-ahead labels (E).

Design (scales to one entity holding a third of all rows):

* Every raw event is first rolled up to **one row per (entity, day)** with a
  map-side partial aggregation.  A hot entity therefore spreads over many
  shuffle tasks in that first exchange and shrinks to at most one row per
  calendar day before anything is partitioned by entity alone.
* All look-back / look-ahead features are integer ``RANGE`` frames over that
  daily series, written with ONE window spec so Spark sorts once.
* Interval features (active-at, long-standing, distinct-in-window) use a
  *sweep*: each interval becomes a +1 and a -1 delta on the time axis and the
  value at a query point is the running sum of deltas strictly before it.
  No (index x history) pairs are ever materialised.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evtrail.functions.dates import day_number
from evtrail.functions.prefix import dealt_by_rows


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- E1 / E2 ---

def index_cohort(events: DataFrame, entity: str, ts: str, event_id: str,
                 where: Column | None = None) -> DataFrame:
    """Index events filtered by ``where`` and collapsed to the first event
    (by ts, then id) per entity-day.  Output: entity, day, index_ts, index_id.

    ``min(struct(ts, id))`` is an aggregate with partial (map-side) combine,
    so a hot (entity, day) never lands whole in one task."""
    ev = events if where is None else events.where(where)
    first = F.min(F.struct(F.col(ts).alias("t"), F.col(event_id).alias("i")))
    return (ev.where(F.col(ts).isNotNull())
            .groupBy(F.col(entity).alias(entity), day_number(ts).alias("day"))
            .agg(first.alias("_f"))
            .select(entity, "day", F.col("_f.t").alias("index_ts"), F.col("_f.i").alias("index_id")))


def max_event_day(events: DataFrame, ts: str) -> DataFrame:
    """Scalar (1 row) max day over ALL events: the end of observation."""
    return events.agg(F.max(day_number(ts)).alias("max_day"))


def censor_followup(index: DataFrame, max_day: DataFrame, horizon: int = 90,
                    day_col: str = "day") -> DataFrame:
    """Keep index rows whose follow-up window fits in the observed data.
    ``max_day`` is a single row, so the broadcast is bounded."""
    return (index.crossJoin(F.broadcast(max_day))
            .where(F.col(day_col) + F.lit(horizon) <= F.col("max_day")).drop("max_day"))


# ------------------------------------------------------------ daily series ---

def daily_rollup(events: DataFrame, entity: str, ts: str, counts: dict[str, Column] | None = None,
                 sums: dict[str, Column] | None = None, mins: dict[str, Column] | None = None,
                 maxs: dict[str, Column] | None = None) -> DataFrame:
    """One row per (entity, day): conditional counts, sums, min/max."""
    counts, sums, mins, maxs = counts or {}, sums or {}, mins or {}, maxs or {}
    aggs = [F.count(F.lit(1)).alias("n_events")]
    aggs += [F.count(F.when(cond, 1)).alias(name) for name, cond in counts.items()]
    aggs += [F.sum(expr).alias(name) for name, expr in sums.items()]
    aggs += [F.min(expr).alias(name) for name, expr in mins.items()]
    aggs += [F.max(expr).alias(name) for name, expr in maxs.items()]
    return (events.where(F.col(ts).isNotNull())
            .groupBy(F.col(entity).alias(entity), day_number(ts).alias("day")).agg(*aggs))


def lookback(daily: DataFrame, entity: str, windows: Sequence[int], count_cols: Sequence[str] = (),
             sum_cols: Sequence[str] = (), name: str = "{col}_{w}d") -> DataFrame:
    """Σ over the half-open day window [d-w, d) -- the index day itself
    and any later day are excluded."""
    w0 = Window.partitionBy(entity).orderBy("day")
    out = []
    for w in windows:
        frame = w0.rangeBetween(-w, -1)
        for c in count_cols:
            out.append(F.coalesce(F.sum(c).over(frame), F.lit(0)).cast("long").alias(name.format(col=c, w=w)))
        for c in sum_cols:
            out.append(F.coalesce(F.sum(c).over(frame), F.lit(0.0)).alias(name.format(col=c, w=w)))
    return daily.select("*", *out)


def history_before(daily: DataFrame, entity: str, cols: Sequence[str], prefix: str = "hist_") -> DataFrame:
    """All-time totals strictly before the day."""
    frame = Window.partitionBy(entity).orderBy("day").rangeBetween(Window.unboundedPreceding, -1)
    return daily.select("*", *[F.coalesce(F.sum(c).over(frame), F.lit(0)).cast("long").alias(prefix + c)
                               for c in cols])


def recency(daily: DataFrame, entity: str, flag_counts: dict[str, str | None],
            missing: int | None = None) -> DataFrame:
    """Days since the previous day having an event (of a class).
    ``flag_counts`` maps output name -> daily count column (None = any event).
    Missing history -> ``missing`` (null in v2/claims, 9999 in v1)."""
    frame = Window.partitionBy(entity).orderBy("day").rangeBetween(Window.unboundedPreceding, -1)
    out = []
    for name, cnt in flag_counts.items():
        last_day = F.max(F.col("day") if cnt is None else F.when(F.col(cnt) > 0, F.col("day"))).over(frame)
        val = (F.col("day") - last_day).cast("long")
        out.append((val if missing is None else F.coalesce(val, F.lit(missing).cast("long"))).alias(name))
    return daily.select("*", *out)


def lookahead_any(daily: DataFrame, entity: str, count_col: str, horizon: int = 90,
                  name: str = "label") -> DataFrame:
    """1 when any later distinct day in (d, d+horizon] has ``count_col``>0."""
    frame = Window.partitionBy(entity).orderBy("day").rangeBetween(1, horizon)
    return daily.select("*", F.coalesce(F.max(F.when(F.col(count_col) > 0, 1)).over(frame), F.lit(0))
                        .cast("int").alias(name))


def next_event_ts_after_day(daily: DataFrame, entity: str, min_ts_col: str, name: str = "next_ts") -> DataFrame:
    """Earliest event timestamp on any later day (input: daily min ts of the
    class, null when none)."""
    frame = Window.partitionBy(entity).orderBy("day").rangeBetween(1, Window.unboundedFollowing)
    return daily.select("*", F.min(min_ts_col).over(frame).alias(name))


def label_hybrid(index_ts: Column, next_ts: Column, horizon_days: int = 90) -> Column:
    """E4 (v1): later day AND ts <= index_ts + horizon (timestamp grain)."""
    return F.coalesce((next_ts <= index_ts + F.make_dt_interval(F.lit(horizon_days))).cast("int"), F.lit(0))


def gap_to_next_label(events: DataFrame, entity: str, ts: str, event_id: str,
                      horizon: int = 90, name: str = "label_gap") -> DataFrame:
    """E5: per event, gap (days) to the next event of the same entity in
    (ts, id) order; label = 0 < gap <= horizon.  Same-day successors give gap
    0 -> label 0 (differs from E3).  Built on the daily series: only the last
    event of a day can see a later day."""
    ev = events.where(F.col(ts).isNotNull()).withColumn("day", day_number(ts))
    last = (ev.groupBy(entity, "day")
            .agg(F.max(F.struct(F.col(ts).alias("t"), F.col(event_id).alias("i"))).alias("_last")))
    w = Window.partitionBy(entity).orderBy("day")
    last = last.select(entity, "day", F.col("_last.i").alias("_last_id"),
                       (F.lead("day").over(w) - F.col("day")).alias("_gap_next_day"))
    j = ev.join(last, [entity, "day"])
    gap = F.when(F.col(event_id) == F.col("_last_id"), F.col("_gap_next_day")).otherwise(F.lit(0))
    return (j.select(*events.columns, "day", gap.cast("long").alias("gap_days"))
            .withColumn(name, F.coalesce(((F.col("gap_days") > 0) & (F.col("gap_days") <= horizon)).cast("int"),
                                         F.lit(0))))


# ------------------------------------------------------------------ sweeps ---

def sweep_count(intervals: DataFrame, queries: DataFrame, entity: str, open_after: str,
                close_after: str | None, query_key: str, name: str = "active",
                bucket_width: int | None = None, rows: int = 0) -> DataFrame:
    """Count intervals alive at each query key.

    An interval contributes at query key ``q`` iff ``q > open_after`` and not
    ``q > close_after`` (``close_after`` null = never closes).  Keys are longs
    (day numbers or epoch micros).  Each interval becomes +1 at
    ``open_after`` and -1 at ``greatest(open_after, close_after)`` (so empty
    intervals cancel); deltas are pre-aggregated per (entity, key), then the
    running sum over keys strictly below ``q`` is read at the query rows.

    ``bucket_width`` (e.g. one day of micros) makes the running sum two-level:
    per-bucket totals are summed over preceding buckets (a window over at most
    one row per bucket) plus a running sum inside the query's own bucket, so
    even a hot entity never puts all of its distinct keys in one window
    partition."""
    return sweep_counts(intervals, queries, entity, open_after, close_after, query_key, {name: F.lit(True)}, bucket_width,
                        rows)


def sweep_counts(intervals: DataFrame, queries: DataFrame, entity: str, open_after: str, close_after: str | None,
                 query_key: str, counts: Mapping[str, Column], bucket_width: int | None = None,
                 rows: int = 0) -> DataFrame:
    """Several counts of one sweep: ``counts`` gives each name the condition
    (over ``intervals``) under which an interval takes part in it.  ``rows``:
    about how many intervals there are, by which windows over whole entities
    are dealt."""
    names = list(counts)
    # one pass over the intervals emits both deltas (+1 open, -1 close)
    plus = F.struct(F.col(open_after).cast("long").alias("k"), F.lit(1).alias("d"))
    if close_after is None:
        ds = F.array(plus)
    else:
        minus = F.when(F.col(close_after).isNotNull(),
                       F.struct(F.greatest(F.col(open_after), F.col(close_after)).cast("long").alias("k"),
                                F.lit(-1).alias("d")))
        ds = F.array(plus, minus)
    part = [f"_in{i}" for i in range(len(names))]
    delta = [f"_d{i}" for i in range(len(names))]
    deltas = (intervals.select(F.col(entity).alias("_e"), *[counts[n].cast("int").alias(p) for n, p in zip(names, part)],
                               F.explode(ds).alias("_x"))
              .where(F.col("_x").isNotNull() & F.col("_x.k").isNotNull())
              .select("_e", F.col("_x.k").alias("_k"), *[(F.col("_x.d") * F.col(p)).alias(d) for p, d in zip(part, delta)]))
    deltas = (dealt_by_rows(deltas, 2 * rows, "_e", "_k").groupBy("_e", "_k")
              .agg(*[F.sum(d).alias(d) for d in delta]))
    # query points join the delta rows as flagged zero-deltas (no re-aggregation);
    # the RANGE frame ends before the current key, so a delta at the same key
    # never counts, and values are read at the flagged rows only
    qk = queries.select(F.col(entity).alias("_e"), F.col(query_key).cast("long").alias("_k")).distinct()
    pts = (qk.withColumns({d: F.lit(0).cast("long") for d in delta} | {"_q": F.lit(True)})
           .unionByName(deltas.withColumn("_q", F.lit(False))))
    before_key = lambda d, w: F.coalesce(F.sum(d).over(w), F.lit(0))
    if bucket_width is None:
        frame = Window.partitionBy("_e").orderBy("_k").rangeBetween(Window.unboundedPreceding, -1)
        pts = dealt_by_rows(pts, 2 * rows, "_e")
        vals = (pts.select("_e", "_k", "_q", *[before_key(d, frame).cast("long").alias(n) for n, d in zip(names, delta)])
                .where("_q").drop("_q"))
    else:
        pts = pts.withColumn("_b", F.floor(F.col("_k") / F.lit(bucket_width)).cast("long"))
        tot = pts.groupBy("_e", "_b").agg(*[F.sum(d).alias(d) for d in delta])
        before = Window.partitionBy("_e").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        off = tot.select("_e", "_b", *[before_key(d, before).alias(f"_off{d}") for d in delta])
        inside = Window.partitionBy("_e", "_b").orderBy("_k").rangeBetween(Window.unboundedPreceding, -1)
        vals = (pts.select("_e", "_b", "_k", "_q", *[before_key(d, inside).alias(d) for d in delta])
                .where("_q").join(off, ["_e", "_b"])
                .select("_e", "_k", *[(F.col(f"_off{d}") + F.col(d)).cast("long").alias(n) for n, d in zip(names, delta)]))
    return (queries.join(vals, (queries[entity] == vals["_e"]) & (queries[query_key].cast("long") == vals["_k"]),
                         "left").drop("_e", "_k"))


def distinct_in_window(events: DataFrame, queries: DataFrame, entity: str, day: str, key: str,
                       window_days: int | None, name: str, query_day: str = "day", rows: int = 0) -> DataFrame:
    """Exact count of distinct non-null ``key`` values seen in [d-w, d)
    (all history when ``window_days`` is None) at each query day ``d``.

    For each (entity, key) the distinct days t1<t2<... are found; occurrence
    ti makes the key count for d in (ti, min(t(i+1), ti+w)].  Those disjoint
    intervals go through :func:`sweep_count` -- no sets are collected.

    ``rows``: about how many events there are, by which the windows are dealt
    (0: as the session deals)."""
    occ = (events.where(F.col(key).isNotNull() & F.col(day).isNotNull())
           .select(entity, key, day).distinct())
    if window_days is None:
        first = occ.groupBy(entity, key).agg(F.min(day).alias("_open"))
        return sweep_count(first, queries, entity, "_open", None, query_day, name, rows=rows)
    w = Window.partitionBy(entity, key).orderBy(day)
    iv = dealt_by_rows(occ, rows, entity, key).select(
        entity, F.col(day).alias("_open"),
        F.least(F.coalesce(F.lead(day).over(w), F.col(day) + window_days), F.col(day) + window_days).alias("_close"))
    return sweep_count(iv, queries, entity, "_open", "_close", query_day, name, rows=rows)


def active_at(intervals: DataFrame, queries: DataFrame, entity: str, start: str, stop: str,
              query_ts: str, name: str = "active", mode: str = "v1", min_age_days: int = 0) -> DataFrame:
    """E11/E12/E22 at microsecond grain.

    mode ``v1``:      START <  t AND (STOP IS NULL OR STOP >= t)
    mode ``context``: START <= t AND (STOP IS NULL OR STOP >  t)
    ``min_age_days`` > 0 additionally requires START <= t - age (E12), which
    simply shifts the interval's opening point."""
    return _active(intervals, queries, entity, start, stop, query_ts, {name: F.lit(True)}, mode, min_age_days)


def _active(intervals: DataFrame, queries: DataFrame, entity: str, start: str, stop: str, query_ts: str,
            counts: Mapping[str, Column], mode: str, min_age_days: int) -> DataFrame:
    us = F.lit(86_400_000_000 * min_age_days)
    s = F.unix_micros(F.col(start).cast("timestamp"))
    e = F.unix_micros(F.col(stop).cast("timestamp"))
    if mode == "v1":
        opens = s + us if min_age_days == 0 else s + us - 1  # START < t  |  START <= t-age
        closes = e                                               # alive while t <= STOP
    elif mode == "context":
        opens = s + us - 1                                       # START <= t(-age)
        closes = e - 1                                           # alive while t < STOP
    else:
        raise ValueError(mode)
    iv = intervals.where(F.col(start).isNotNull()).withColumns({"_open": opens, "_close": closes})
    q = queries.withColumn("_qk", F.unix_micros(F.col(query_ts).cast("timestamp")))
    return sweep_counts(iv, q, entity, "_open", "_close", "_qk", counts, bucket_width=86_400_000_000).drop("_qk")


# ---------------------------------------------------------- misc features ---

def asof_last_before(left: DataFrame, right: DataFrame, entity: str, day: str, value: str,
                     right_ts: str, name: str, strict: bool = True) -> DataFrame:
    """As-of join at day grain: value of the latest right row (by
    ``right_ts``) on a day strictly before (or on, if not strict) the left
    day.  Right rows are first reduced to one per (entity, day) with
    ``max_by``, then carried forward with one window."""
    r = (right.groupBy(F.col(entity).alias("_e"), F.col(day).alias("_k"))
         .agg(F.max_by(value, right_ts).alias("_v")))
    l_keys = left.select(F.col(entity).alias("_e"), F.col(day).alias("_k")).distinct()
    pts = l_keys.join(r, ["_e", "_k"], "full")
    frame = Window.partitionBy("_e").orderBy("_k").rangeBetween(
        Window.unboundedPreceding, -1 if strict else 0)
    vals = pts.select("_e", "_k", F.last("_v", ignorenulls=True).over(frame).alias(name))
    return left.join(vals, (left[entity] == vals["_e"]) & (left[day] == vals["_k"]), "left").drop("_e", "_k")


def age_years(at, born, clip: tuple[float, float] | None = None) -> Column:
    """days/365.25 (optionally clipped)."""
    yrs = F.datediff(F.to_date(_c(at)), F.to_date(_c(born))) / F.lit(365.25)
    if clip:
        yrs = F.least(F.greatest(yrs, F.lit(clip[0])), F.lit(clip[1]))
    return yrs


def exclude_competing(index: DataFrame, death_col: str, index_ts: str, label_col: str,
                      policy: str = "always", horizon_days: int = 90) -> DataFrame:
    """Tag each index row with an exclusion reason (null = kept).

    ``always``:     drop if death <= index + horizon (v2 / claims)
    ``label0``:     drop only if the label is 0 and death <= index + horizon (v1)
    ``strict``:     drop if index < death <= index + horizon (audit)"""
    end = F.col(index_ts) + F.make_dt_interval(F.lit(horizon_days))
    d = F.col(death_col)
    if policy == "always":
        cond = d <= end
    elif policy == "label0":
        cond = (d <= end) & (F.col(label_col) == 0)
    elif policy == "strict":
        cond = (d > F.col(index_ts)) & (d <= end)
    else:
        raise ValueError(policy)
    return index.withColumn("exclusion_reason", F.when(d.isNotNull() & cond, F.lit("competing_event")))


def sum_in_day_window(queries: DataFrame, events: DataFrame, entity: str, q_day: str, e_day: str, value: Column,
                      lo: int, hi: int, name: str) -> DataFrame:
    """Σ ``value`` of the same entity's events with day in [q_day+lo,
    q_day+hi] (e.g. lo=-90, hi=-1 for the 90 days before).  Events are
    summed per (entity, day), query days merged in, one RANGE frame."""
    ev = events.groupBy(F.col(entity).alias("_e"), F.col(e_day).alias("_k")).agg(F.sum(value).alias("_v"))
    qk = queries.select(F.col(entity).alias("_e"), F.col(q_day).alias("_k")).distinct()
    pts = ev.join(qk, ["_e", "_k"], "full")
    frame = Window.partitionBy("_e").orderBy("_k").rangeBetween(lo, hi)
    vals = pts.select("_e", "_k", F.coalesce(F.sum("_v").over(frame), F.lit(0)).alias(name))
    return queries.join(vals, (queries[entity] == vals["_e"]) & (queries[q_day] == vals["_k"]), "left") \
        .drop("_e", "_k")


def active_by_kind(intervals: DataFrame, queries: DataFrame, entity: str, start: str, stop: str, query_ts: str,
                   kind_col: str, kinds: Sequence[str], prefix: str = "active_", mode: str = "v1",
                   min_age_days: int = 0) -> DataFrame:
    """Active-interval counts for several interval kinds in one sweep, with
    one column of deltas per kind (a bounded list)."""
    iv = intervals.where(F.col(kind_col).isin(*kinds))
    out = _active(iv, queries, entity, start, stop, query_ts, {prefix + k: F.col(kind_col) == k for k in kinds}, mode,
                  min_age_days)
    return out.withColumns({prefix + k: F.coalesce(F.col(prefix + k), F.lit(0)).cast("long") for k in kinds})
