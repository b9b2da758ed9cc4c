"""Evaluation kit (H, F10).

Scale notes
* Everything threshold-like is computed on aggregates: rows are first
  reduced to one row per (group, distinct score) with pos/neg counts
  (map-side combine), and running sums over the score axis use the
  bucketed two-level prefix sums of :mod:`evtrail.functions.prefix` -- no
  ``Window.orderBy`` without ``partitionBy`` over data.
* Threshold sweeps map each row to ONE threshold bucket (how many
  thresholds it clears), count per bucket, then take suffix sums over the
  tiny bucket table.  No rows x thresholds cross join.
* Bootstrap replicates use per-row Poisson(1) weights from a hash; the
  replicate explode is followed immediately by a partial aggregation, so
  the shuffle carries (replicate x bucket) counts, not rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evtrail.functions.prefix import _ranges, exact_quantiles, grouped_prefix_sums
from evtrail.functions.text import text_hash
from evtrail.session import cut_lineage


def _gk(group_cols):
    return list(group_cols or [])


# ------------------------------------------------------------------ H1/H2 --

def confusion(df: DataFrame, y: str, p: str, threshold: float | Column, group_cols: Sequence[str] = ()) -> DataFrame:
    """H1: tp/fp/tn/fn with ``p >= threshold`` as positive."""
    thr = threshold if isinstance(threshold, Column) else F.lit(threshold)
    pred = F.col(p) >= thr
    pos = F.col(y) == 1
    return df.groupBy(*_gk(group_cols)).agg(
        F.count(F.when(pred & pos, 1)).alias("tp"), F.count(F.when(pred & ~pos, 1)).alias("fp"),
        F.count(F.when(~pred & ~pos, 1)).alias("tn"), F.count(F.when(~pred & pos, 1)).alias("fn"))


def _div(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def rates(cm: DataFrame) -> DataFrame:
    """H2: precision, recall, F1, specificity, accuracy, FPR, FNR, PPR;
    zero-division -> 0."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    prec, rec = _div(tp, tp + fp), _div(tp, tp + fn)
    return cm.select("*", prec.alias("precision"), rec.alias("recall"),
                     _div(2 * tp, 2 * tp + fp + fn).alias("f1"), _div(tn, tn + fp).alias("specificity"),
                     _div(tp + tn, n).alias("accuracy"), _div(fp, fp + tn).alias("fpr"),
                     _div(fn, fn + tp).alias("fnr"), _div(tp + fp, n).alias("ppr"))


# --------------------------------------------------------------- curves ----

def score_curve(df: DataFrame, y: str, p: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """Per (group, distinct score): pos, neg, cum_tp/cum_fp for scores >=
    this one, and group totals P/N."""
    g = _gk(group_cols)
    per = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(*g, F.col(p).alias("score")).agg(
        F.count(F.when(F.col(y) == 1, 1)).alias("pos"), F.count(F.when(F.col(y) != 1, 1)).alias("neg"))
    cum = grouped_prefix_sums(per, "score", ["pos", "neg"], g, descending=True)
    cum = cum.withColumnRenamed("pos_cum", "cum_tp").withColumnRenamed("neg_cum", "cum_fp")
    tot = per.groupBy(*g).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return cum.join(tot, g) if g else cum.crossJoin(tot)


def curve_metrics(df: DataFrame, y: str, p: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """H3 ROC-AUC (ties averaged, Mann-Whitney), H4 average precision
    (step, sklearn definition), H5 PR-AUC by trapezoid over the PR curve
    (starts at recall 0 / precision 1, stops at the first full-recall
    point).  Single-class groups get null AUC/AP."""
    g = _gk(group_cols)
    c = score_curve(df, y, p, g)
    P, N = F.col("P").cast("double"), F.col("N").cast("double")
    tp, fp = F.col("cum_tp").cast("double"), F.col("cum_fp").cast("double")
    prev_tp, prev_fp = tp - F.col("pos"), fp - F.col("neg")
    prec = tp / (tp + fp)
    prev_prec = F.when(prev_tp + prev_fp > 0, prev_tp / (prev_tp + prev_fp)).otherwise(F.lit(1.0))
    rec, prev_rec = tp / P, prev_tp / P
    auc_term = F.col("pos") * ((N - fp) + 0.5 * F.col("neg"))
    trap = F.when(prev_tp < P, (rec - prev_rec) * (prec + prev_prec) / 2).otherwise(F.lit(0.0))
    agg = c.groupBy(*g, "P", "N").agg(F.sum(auc_term).alias("_auc"), F.sum(F.col("pos") * prec).alias("_ap"),
                                      F.sum(trap).alias("_trap"))
    both = (F.col("P") > 0) & (F.col("N") > 0)
    return agg.select(*g, F.when(both, F.col("_auc") / (P * N)).alias("roc_auc"),
                      F.when(F.col("P") > 0, F.col("_ap") / P).alias("average_precision"),
                      F.when(F.col("P") > 0, F.col("_trap")).alias("pr_auc_trapezoid"))


def brier(df: DataFrame, y: str, p: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """H6."""
    return df.groupBy(*_gk(group_cols)).agg(F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"))


def metrics_table(df: DataFrame, y: str, p: str, threshold: float = 0.5, group_cols: Sequence[str] = ()) -> DataFrame:
    """The full scorecard per group (counts, AUC, AP, rates, Brier)."""
    g = _gk(group_cols)
    cm = rates(confusion(df, y, p, threshold, g))
    base = df.groupBy(*g).agg(F.count(F.lit(1)).alias("sample_count"),
                              F.count(F.when(F.col(y) == 1, 1)).alias("positive_count"),
                              F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"))
    cur = curve_metrics(df, y, p, g)
    out = base.join(cm, g) if g else base.crossJoin(cm)
    out = out.join(cur, g) if g else out.crossJoin(cur)
    return out.withColumn("threshold", F.lit(float(threshold)))


# ------------------------------------------------------------ H7 sweep -----

def threshold_grid(start: float, stop: float, step: float) -> list[float]:
    """Like ``numpy.arange``: stop is exclusive."""
    n = int(round((stop - start) / step))
    return [round(start + i * step, 6) for i in range(n + 1) if start + i * step < stop - 1e-9]


def threshold_sweep(df: DataFrame, y: str, p: str, thresholds: Sequence[float],
                    group_cols: Sequence[str] = ()) -> DataFrame:
    """H7: confusion + rates at every threshold.  Each row lands in the bucket
    = number of thresholds it clears; suffix sums over the (tiny) bucket table
    give TP/FP at each threshold."""
    g = _gk(group_cols)
    ts = sorted(set(float(t) for t in thresholds))
    arr = F.array(*[F.lit(t) for t in ts])
    per = df.groupBy(*g, F.size(F.filter(arr, lambda t: t <= F.col(p))).alias("_b")).agg(
        F.count(F.when(F.col(y) == 1, 1)).alias("_pos"), F.count(F.when(F.col(y) != 1, 1)).alias("_neg"))
    spark = df.sparkSession
    tdf = spark.createDataFrame([(i + 1, t) for i, t in enumerate(ts)], "_k int, threshold double")
    groups = per.select(*g).distinct() if g else None
    grid = groups.crossJoin(F.broadcast(tdf)) if g else tdf
    # TP(t_k) = sum of pos over buckets >= k ; bounded (#groups x #thresholds)
    j = grid.join(per, g, "left") if g else grid.crossJoin(per)
    j = j.where(F.col("_b") >= F.col("_k"))
    hits = j.groupBy(*g, "_k", "threshold").agg(F.sum("_pos").alias("tp"), F.sum("_neg").alias("fp"))
    tot = per.groupBy(*g).agg(F.sum("_pos").alias("_P"), F.sum("_neg").alias("_N"))
    full = (grid.join(hits, [*g, "_k", "threshold"], "left").join(tot, g, "left") if g else
            grid.join(hits, ["_k", "threshold"], "left").crossJoin(tot))
    full = full.select(*g, "threshold", F.coalesce("tp", F.lit(0)).alias("tp"), F.coalesce("fp", F.lit(0)).alias("fp"),
                       "_P", "_N")
    full = full.select(*g, "threshold", "tp", "fp", (F.col("_N") - F.col("fp")).alias("tn"),
                       (F.col("_P") - F.col("tp")).alias("fn"))
    return rates(full)


def select_threshold(sweep: DataFrame, metric: str = "f1", group_cols: Sequence[str] = ()) -> DataFrame:
    """H8: argmax of a metric, ties -> lowest threshold (sweep table is
    small: #groups x #thresholds)."""
    g = _gk(group_cols)
    rest = [c for c in sweep.columns if c not in g and c != "threshold"]
    best = sweep.groupBy(*g).agg(F.min_by(F.struct("threshold", *rest),
                                          F.struct((-F.col(metric)).alias("m"), F.col("threshold"))).alias("b"))
    return best.select(*g, F.lit(metric).alias("criterion"), "b.*")


def constrained_threshold(sweep: DataFrame, min_acc: float = .9, min_rec: float = .4, min_prec: float = .15,
                          min_f1: float = .2, fallback: float = .5) -> DataFrame:
    """H9: best F1 among thresholds meeting all constraints; else the max
    accuracy with recall >= min_rec; else ``fallback``."""
    ok = sweep.where((F.col("accuracy") >= min_acc) & (F.col("recall") >= min_rec) &
                     (F.col("precision") >= min_prec) & (F.col("f1") >= min_f1))
    a = ok.agg(F.min_by("threshold", F.struct(-F.col("f1"), F.col("threshold"))).alias("t1"))
    b = sweep.where(F.col("recall") >= min_rec).agg(
        F.min_by("threshold", F.struct(-F.col("accuracy"), F.col("threshold"))).alias("t2"))
    return a.crossJoin(b).select(
        F.coalesce("t1", "t2", F.lit(fallback)).alias("threshold"),
        F.when(F.col("t1").isNotNull(), "constraints_met").when(F.col("t2").isNotNull(), "max_accuracy_recall")
        .otherwise("fallback").alias("rule"))


def capacity_threshold(df: DataFrame, p: str, top_share: float = 0.2, where: Column | None = None) -> DataFrame:
    """Threshold that flags the top ``top_share`` of (train) scores."""
    src = df if where is None else df.where(where)
    return exact_quantiles(src, p, [1 - top_share], name="threshold").drop("prob")


# ------------------------------------------------------- H11 calibration ---

def calibration_bins(df: DataFrame, y: str, p: str, n_bins: int = 8, group_cols: Sequence[str] = ()) -> DataFrame:
    """Quantile edges (linear interpolation), bin = number of inner edges
    strictly below p, empty bins dropped, bins renumbered 1.."""
    g = _gk(group_cols)
    probs = [i / n_bins for i in range(1, n_bins)]
    q = exact_quantiles(df, p, probs, g, name="_e")
    edges = q.groupBy(*g).agg(F.transform(F.sort_array(F.collect_list(F.struct("prob", "_e"))),
                                          lambda s: s["_e"]).alias("_edges"))
    j = df.join(edges, g) if g else df.crossJoin(F.broadcast(edges))
    b = j.withColumn("_bin", F.size(F.filter("_edges", lambda e: e < F.col(p))))
    agg = b.groupBy(*g, "_bin").agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_predicted"),
                                    F.avg(F.col(y).cast("double")).alias("observed_rate"))
    w = Window.partitionBy(*g).orderBy("_bin") if g else Window.orderBy("_bin")   # <= n_bins rows per group
    return agg.select(*g, F.dense_rank().over(w).alias("bin"), "n", "mean_predicted", "observed_rate")


# ------------------------------------------------------- H12 subgroups -----

def subgroup_metrics(df: DataFrame, y: str, p: str, fields: Sequence[str], threshold: float = 0.5,
                     min_n: int = 10) -> DataFrame:
    """Unpivot (field, value), full scorecard per subgroup, keep those
    with n >= min_n and both classes present."""
    long = df.select(y, p, *[F.coalesce(F.col(f).cast("string"), F.lit("None")).alias(f) for f in fields]) \
        .unpivot([y, p], list(fields), "field", "group")
    m = metrics_table(long, y, p, threshold, ["field", "group"])
    return m.where((F.col("sample_count") >= min_n) & (F.col("positive_count") > 0) &
                   (F.col("positive_count") < F.col("sample_count")))


# ------------------------------------------------------- H13..H18 ----------

def score_distribution(df: DataFrame, p: str, threshold: float, group_cols: Sequence[str] = ()) -> DataFrame:
    """Min, max, mean, median, p25, p75, p90, p99, count above."""
    g = _gk(group_cols)
    base = df.groupBy(*g).agg(F.min(p).alias("min"), F.max(p).alias("max"), F.avg(p).alias("mean"),
                              F.count(F.when(F.col(p) >= threshold, 1)).alias("n_above"))
    q = exact_quantiles(df, p, [0.25, 0.5, 0.75, 0.9, 0.99], g, name="v")
    names = {0.25: "p25", 0.5: "median", 0.75: "p75", 0.9: "p90", 0.99: "p99"}
    piv = q.groupBy(*g).agg(*[F.max(F.when(F.col("prob") == k, F.col("v"))).alias(n) for k, n in names.items()])
    return base.join(piv, g) if g else base.crossJoin(piv)


def outcome_label(y: str, p: str, threshold: float) -> Column:
    pred = F.col(p) >= threshold
    pos = F.col(y) == 1
    return (F.when(pred & pos, "TP").when(pred & ~pos, "FP").when(~pred & pos, "FN").otherwise("TN"))


def error_cohort_means(df: DataFrame, y: str, p: str, threshold: float, features: Sequence[str]) -> DataFrame:
    """Feature means per outcome cohort (TP/FP/FN/TN)."""
    return df.groupBy(outcome_label(y, p, threshold).alias("outcome")).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(f).alias(f"mean_{f}") for f in features])


def complementarity(df: DataFrame, y: str, p1: str, p2: str, t1: float, t2: float) -> DataFrame:
    """2x2 of which model is right, with % of rows."""
    r1 = (F.col(p1) >= t1).cast("int") == F.col(y)
    r2 = (F.col(p2) >= t2).cast("int") == F.col(y)
    agg = df.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(r1 & r2, 1)).alias("both_right"),
                 F.count(F.when(~r1 & ~r2, 1)).alias("both_wrong"), F.count(F.when(r1 & ~r2, 1)).alias("only_first"),
                 F.count(F.when(~r1 & r2, 1)).alias("only_second"))
    return agg.select("*", *[(F.col(c) * 100.0 / F.col("n")).alias(f"{c}_pct")
                             for c in ("both_right", "both_wrong", "only_first", "only_second")])


def score_correlation(df: DataFrame, p1: str, p2: str) -> DataFrame:
    """Pearson correlation of two scorings."""
    return df.agg(F.corr(p1, p2).alias("correlation"))


def decision_churn(df: DataFrame, y: str, p: str, t_base: float, t_new: float, p_new: str | None = None) -> DataFrame:
    """Recovered FN, new FP, lost TP, fixed FP between two decisions."""
    b = F.col(p) >= t_base
    e = F.col(p_new or p) >= t_new
    pos = F.col(y) == 1
    return df.agg(F.count(F.when(pos & ~b & e, 1)).alias("recovered_fn"), F.count(F.when(~pos & ~b & e, 1)).alias("new_fp"),
                  F.count(F.when(pos & b & ~e, 1)).alias("lost_tp"), F.count(F.when(~pos & b & ~e, 1)).alias("fixed_fp"))


def ap_lift(curve: DataFrame, df: DataFrame, y: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """AP / prevalence."""
    g = _gk(group_cols)
    prev = df.groupBy(*g).agg(F.avg(F.col(y).cast("double")).alias("prevalence"))
    j = curve.join(prev, g) if g else curve.crossJoin(prev)
    return j.select(*g, "average_precision", "prevalence",
                    (F.col("average_precision") / F.col("prevalence")).alias("ap_lift"))


def compare_models(metrics: DataFrame, model_col: str, baseline: str, metric_cols: Sequence[str],
                   split_col: str | None = None) -> DataFrame:
    """Deltas vs the baseline model, best model per metric (bounded:
    one row per model x split)."""
    keys = [split_col] if split_col else []
    base = metrics.where(F.col(model_col) == baseline).select(*keys, *[F.col(m).alias(f"_b_{m}") for m in metric_cols])
    j = metrics.join(base, keys) if keys else metrics.crossJoin(base)
    return j.select(*keys, model_col, *metric_cols, *[(F.col(m) - F.col(f"_b_{m}")).alias(f"delta_{m}")
                                                       for m in metric_cols])


def best_by_metric(metrics: DataFrame, model_col: str, metric_cols: Sequence[str]) -> DataFrame:
    """Best model per metric (ties -> smallest model name)."""
    long = metrics.select(model_col, *metric_cols).unpivot([model_col], list(metric_cols), "metric", "value")
    return long.groupBy("metric").agg(
        F.min_by(F.col(model_col), F.struct(-F.col("value"), F.col(model_col))).alias("best_model"),
        F.max("value").alias("best_value"))


def train_test_gap(metrics: DataFrame, model_col: str, split_col: str, metric: str,
                   train: str = "train", test: str = "test") -> DataFrame:
    """Train - test gap of a metric per model."""
    pv = metrics.groupBy(model_col).agg(F.max(F.when(F.col(split_col) == train, F.col(metric))).alias("train"),
                                        F.max(F.when(F.col(split_col) == test, F.col(metric))).alias("test"))
    return pv.withColumn("gap", F.col("train") - F.col("test"))


# ------------------------------------------------------------- F10 ---------

# Poisson(1) CDF, used to turn a uniform hash into a Poisson(1) count.  The
# mass above 12 is under 2**-32, the step of the hash: no larger count occurs.
def poisson1_cdf(kmax: int = 12) -> list[float]:
    import math
    out, acc = [], 0.0
    for k in range(kmax + 1):
        acc += math.exp(-1) / math.factorial(k)
        out.append(acc)
    return out


def poisson_weight(row_key: Column, replicate: Column, seed: int) -> Column:
    u = text_hash(F.concat_ws(":", row_key.cast("string"), replicate.cast("string")), seed) / float(1 << 32)
    return sum(((u >= c).cast("int") for c in poisson1_cdf()), F.lit(0))


def bootstrap_ci(df: DataFrame, y: str, p: str, row_key: str, threshold: float, n_boot: int = 100,
                 seed: int = 42, alpha: float = 0.05, with_ap: bool = True) -> DataFrame:
    """Poisson bootstrap of precision / recall / F1 (and AP) at a
    threshold; percentile CI.  Returns (metric, point, lo, hi, n_boot).

    Weights are drawn once: rows are dealt evenly (one replicate of a row is
    one draw), added up per (replicate, score), and all metrics of a replicate
    follow from that table."""
    base = cut_lineage(df.select(y, p, row_key))
    reps = (base.repartition(_ranges(base, base.count() * n_boot))
            .withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1)))))
    # the weight is a column of its own before rows are left out by it, so that it is drawn once
    reps = reps.withColumn("w", poisson_weight(F.col(row_key), F.col("b"), seed))
    pos = F.col(y) == 1
    sc = reps.groupBy("b", F.col(p).alias("score")).agg(
        F.sum(F.when(pos, F.col("w")).otherwise(0)).alias("pos"),
        F.sum(F.when(~pos, F.col("w")).otherwise(0)).alias("neg"), F.sum("w").alias("_w")).where(F.col("_w") > 0)
    if with_ap:
        sc = grouped_prefix_sums(sc, "score", ["pos", "neg"], ["b"], descending=True)
    pred = F.col("score") >= threshold
    count = lambda where, c: F.sum(F.when(where, F.col(c)).otherwise(0))
    ap = F.sum(F.col("pos") * F.col("pos_cum") / (F.col("pos_cum") + F.col("neg_cum"))) if with_ap else F.lit(None)
    cm = sc.groupBy("b").agg(count(pred, "pos").alias("tp"), count(pred, "neg").alias("fp"),
                             count(~pred, "pos").alias("fn"), count(~pred, "neg").alias("tn"),
                             F.sum("pos").alias("_P"), ap.alias("_ap"))
    metrics = ["precision", "recall", "f1"]
    per = rates(cm)
    if with_ap:
        per = per.withColumn("average_precision", F.when(F.col("_P") > 0, F.col("_ap") / F.col("_P")))
        metrics.append("average_precision")
    per = per.select("b", *metrics)
    long = per.unpivot(["b"], metrics, "metric", "value")
    ci = long.groupBy("metric").agg(
        F.percentile("value", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("_ci"),
        F.count("value").alias("n_boot"))
    pt = rates(confusion(base, y, p, threshold)).select("precision", "recall", "f1")
    if with_ap:
        pt = pt.crossJoin(curve_metrics(base, y, p).select("average_precision"))
    pt = pt.unpivot([], metrics, "metric", "point")
    return ci.join(pt, "metric").select("metric", "point", F.col("_ci")[0].alias("ci_low"),
                                        F.col("_ci")[1].alias("ci_high"), "n_boot")
