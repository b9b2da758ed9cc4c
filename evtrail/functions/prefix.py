"""Two-level (bucketed) cumulative sums over an ordered key.

A window with ``orderBy`` but no ``partitionBy`` moves every row into one
task.  Ordered metrics (ROC/PR curves, threshold sweeps) and ranks need
running sums over a whole axis, so the rows are dealt into ranges of (group,
order key, tie-break), the running sum runs inside each range in parallel,
and the running total of the preceding ranges of the group is added.  The
number of ranges follows the row count, and since the tie-break takes part in
the cut, rows that share one order key (a day, a score) are split as well.
The result is exact: ranges only decide where the work is cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evtrail.session import cut_lineage

ROWS_PER_RANGE = 1_000_000


def _ranges(df: DataFrame, rows: int) -> int:
    """Enough ranges that none holds more than about ROWS_PER_RANGE rows, and
    for smaller tables as many as the session has shuffle partitions."""
    session = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(session, -(-rows // 1000)), -(-rows // ROWS_PER_RANGE))


ROWS_PER_TASK = 500_000


def dealt_by_rows(df: DataFrame, rows: int, *cols: str, per_task: int | None = None) -> DataFrame:
    """``df`` dealt by ``cols`` into parts of about ``per_task`` (ROWS_PER_TASK
    unless given) of its ``rows``, so that what a task sorts or hashes does not
    grow with the table; as it is where the session's own number of shuffle
    partitions makes no larger parts."""
    parts = -(-rows // (per_task or ROWS_PER_TASK))
    session = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *cols) if parts > session else df


def grouped_prefix_sums(df: DataFrame, order_col: str, value_cols: list[str],
                        group_cols: list[str] | None = None, descending: bool = False,
                        suffix: str = "_cum", tiebreak: list[str] | None = None) -> DataFrame:
    """Add ``<v><suffix>`` = sum of ``v`` over rows with order key <= current
    (>= when ``descending``), per group.  ``df`` must have one row per
    (group, order key) -- aggregate first -- or pass ``tiebreak`` columns
    that make (order key, tiebreak) unique (ascending tie-break).  The order
    key is of any type that has an order; nulls come first.

    ``df`` is written once, so that its source is planned once; the second
    copy fixes which range each row is in."""
    gkeys = list(group_cols or [])
    order = [F.col(order_col).desc_nulls_first() if descending else F.col(order_col).asc_nulls_first(),
             *(F.col(t).asc_nulls_first() for t in tiebreak or [])]
    base = cut_lineage(df)
    n = _ranges(df, base.count())
    cut = cut_lineage(base.repartitionByRange(n, *[F.col(g) for g in gkeys], *order)
                      .withColumn("__b", F.spark_partition_id()))

    w_in = (Window.partitionBy(*gkeys, "__b").orderBy(*order)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inner = cut.select("*", *[F.sum(v).over(w_in).alias(f"__in_{v}") for v in value_cols])
    # one row per (group, range that holds some of it)
    tot = cut.groupBy(*gkeys, "__b").agg(*[F.sum(v).alias(f"__t_{v}") for v in value_cols])
    w_off = Window.partitionBy(*gkeys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(gkeys)], F.col("__b").alias("__ob"),
                     *[F.coalesce(F.sum(f"__t_{v}").over(w_off), F.lit(0)).alias(f"__o_{v}") for v in value_cols])
    same = F.col("__b") == F.col("__ob")
    for i, g in enumerate(gkeys):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    out = inner.join(off, same)
    return out.select(*[c for c in df.columns],
                      *[(F.col(f"__o_{v}") + F.col(f"__in_{v}")).alias(f"{v}{suffix}") for v in value_cols])


def running_state(df: DataFrame, group_cols: list[str], order_cols: list[str], last_cols: list[str] = (),
                  sum_cols: list[str] = (), set_cols: list[str] = ()) -> DataFrame:
    """Replace columns by their running state over ``order_cols`` (a total
    order) within a group: ``last_cols`` by the last value that is not null so
    far, ``sum_cols`` by the sum so far, ``set_cols`` (arrays of a bounded
    vocabulary) by the sorted union so far.

    Rows are dealt into ranges of (group, order), so a group of any size is
    split: windows run inside a range, one row per (group, range) says what
    the range adds, and each range starts from what the ranges before it
    left.  ``df`` is written once, and once more with its ranges."""
    order = [F.col(c).asc_nulls_first() for c in order_cols]
    base = cut_lineage(df)
    n = _ranges(df, base.count())
    cut = cut_lineage(base.repartitionByRange(n, *[F.col(g) for g in group_cols], *order)
                      .withColumn("__b", F.spark_partition_id()))
    inside = (Window.partitionBy(*group_cols, "__b").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = [c for c in df.columns if c not in {*last_cols, *sum_cols, *set_cols}]
    inner = cut.select(*kept, "__b", *[F.last(c, ignorenulls=True).over(inside).alias(c) for c in last_cols],
                       *[F.sum(c).over(inside).alias(c) for c in sum_cols],
                       *[F.array_distinct(F.flatten(F.collect_set(c).over(inside))).alias(c) for c in set_cols])
    # what each range adds: one row per (group, range)
    place = F.struct(*[F.col(c) for c in order_cols])
    adds = cut.groupBy(*group_cols, "__b").agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(f"__last_{c}") for c in last_cols],
        *[F.sum(c).alias(f"__sum_{c}") for c in sum_cols],
        *[F.array_distinct(F.flatten(F.collect_set(c))).alias(f"__set_{c}") for c in set_cols])
    before = Window.partitionBy(*group_cols).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = adds.select(
        *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group_cols)], F.col("__b").alias("__ob"),
        *[F.last(f"__last_{c}", ignorenulls=True).over(before).alias(f"__last_{c}") for c in last_cols],
        *[F.sum(f"__sum_{c}").over(before).alias(f"__sum_{c}") for c in sum_cols],
        *[F.flatten(F.collect_set(f"__set_{c}").over(before)).alias(f"__set_{c}") for c in set_cols])
    same = F.col("__b") == F.col("__ob")
    for i, g in enumerate(group_cols):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    state = ({c: F.coalesce(c, f"__last_{c}") for c in last_cols}
             | {c: F.coalesce(F.col(c), F.lit(0)) + F.coalesce(f"__sum_{c}", F.lit(0)) for c in sum_cols}
             | {c: F.array_sort(F.array_union(c, f"__set_{c}")) for c in set_cols})
    return inner.join(starts, same).select(*[state[c].alias(c) if c in state else F.col(c) for c in df.columns])


def exact_quantiles(df: DataFrame, col: str, probs: list[float], group_cols: list[str] | None = None,
                    name: str = "q") -> DataFrame:
    """Exact linear-interpolation quantiles (numpy default) without sending
    all values of a group to one task: count per distinct value, bucketed
    running counts, then each requested rank finds its value with a
    range predicate against the small table of ranks.

    Output: group cols, ``prob``, ``<name>``."""
    group_cols = list(group_cols or [])
    gk = group_cols or ["__g"]
    base = df.where(F.col(col).isNotNull()).select(*group_cols, F.col(col).cast("double").alias("__v"))
    if not group_cols:
        base = base.withColumn("__g", F.lit(0))
    cnt = base.groupBy(*gk, "__v").agg(F.count(F.lit(1)).alias("__c"))
    cum = grouped_prefix_sums(cnt, "__v", ["__c"], gk)
    cum = cum.withColumn("__lo", F.col("__c_cum") - F.col("__c"))        # ranks [lo, cum) hold this value
    tot = cnt.groupBy(*gk).agg(F.sum("__c").alias("__n"))
    pr = df.sparkSession.createDataFrame([(float(p),) for p in probs], "prob double")
    # bounded: (#groups x #probs) rows
    want = tot.crossJoin(F.broadcast(pr)).withColumn("__h", (F.col("__n") - 1) * F.col("prob"))
    want = want.select(*gk, "prob", "__h", F.floor("__h").cast("long").alias("__r0"),
                       F.ceil("__h").cast("long").alias("__r1"))
    ranks = (want.select(*gk, "prob", F.col("__r0").alias("__r"))
             .unionByName(want.select(*gk, "prob", F.col("__r1").alias("__r"))).distinct())
    hit = ranks.join(cum, [*gk], "inner").where((F.col("__r") >= F.col("__lo")) & (F.col("__r") < F.col("__c_cum")))
    vals = hit.select(*gk, "prob", "__r", "__v")
    v0 = vals.withColumnRenamed("__r", "__r0").withColumnRenamed("__v", "__v0")
    v1 = vals.withColumnRenamed("__r", "__r1").withColumnRenamed("__v", "__v1")
    out = want.join(v0, [*gk, "prob", "__r0"]).join(v1, [*gk, "prob", "__r1"])
    q = F.col("__v0") + (F.col("__h") - F.col("__r0")) * (F.col("__v1") - F.col("__v0"))
    return out.select(*group_cols, "prob", q.alias(name))


def global_rank(df: DataFrame, order_col: str, tiebreak: list[str], group_cols: list[str] | None = None,
                name: str = "rank") -> DataFrame:
    """1-based row number under (order_col, tiebreak...) per group, computed
    with bucketed prefix sums instead of a single-partition window."""
    d = df.withColumn("__one", F.lit(1))
    out = grouped_prefix_sums(d, order_col, ["__one"], group_cols, tiebreak=tiebreak)
    return out.withColumnRenamed("__one_cum", name).drop("__one")
