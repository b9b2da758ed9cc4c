"""Registered evaluation queries (H, F10).

Scored table (binding): labelled documents; y = quality, two deterministic
scorings p (from length) and p2 (from id), subgroup fields lang/source, a
split by id.  The SQL oracles use independent textbook definitions
(pairwise AUC, per-positive precision for AP) rather than the Spark
algebra.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from evtrail.operators import evaluation as H
from evtrail.plans import bindings as B
from evtrail.plans.registry import query

SCORED_SQL = """s AS (
  SELECT l.doc_id, l.quality AS y, l.toxic AS y2, (d.n_chars % 97) / 100.0 AS p,
         ((l.doc_id * 37) % 100) / 100.0 AS p2, d.n_chars, d.lang, d.source,
         CASE l.doc_id % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def scored(spark, sf):
    lab = B.table(spark, sf, "labels")
    doc = B.table(spark, sf, "documents").select("doc_id", "n_chars", "lang", "source")
    j = lab.join(doc, "doc_id")
    return j.select("doc_id", F.col("quality").alias("y"), F.col("toxic").alias("y2"),
                    ((F.col("n_chars") % 97) / 100.0).alias("p"), ((F.col("doc_id") * 37) % 100 / 100.0).alias("p2"),
                    "n_chars", "lang", "source",
                    F.when(F.col("doc_id") % 5 == 0, "test").when(F.col("doc_id") % 5 == 1, "validation")
                    .otherwise("train").alias("split"))


def _r(df, cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


RATE_COLS = ["precision", "recall", "f1", "specificity", "accuracy", "fpr", "fnr", "ppr"]


def _rates_sql(src: str, keys: str) -> str:
    """SELECT of the H2 rates from a CTE with tp/fp/tn/fn."""
    k = f"{keys}, " if keys else ""
    d = "CAST({a} AS DOUBLE) / NULLIF({b}, 0)"
    return f"""SELECT {k}tp, fp, tn, fn,
  round(COALESCE({d.format(a='tp', b='tp + fp')}, 0), 6) AS precision,
  round(COALESCE({d.format(a='tp', b='tp + fn')}, 0), 6) AS recall,
  round(COALESCE({d.format(a='2 * tp', b='2 * tp + fp + fn')}, 0), 6) AS f1,
  round(COALESCE({d.format(a='tn', b='tn + fp')}, 0), 6) AS specificity,
  round(COALESCE({d.format(a='tp + tn', b='tp + fp + tn + fn')}, 0), 6) AS accuracy,
  round(COALESCE({d.format(a='fp', b='fp + tn')}, 0), 6) AS fpr,
  round(COALESCE({d.format(a='fn', b='fn + tp')}, 0), 6) AS fnr,
  round(COALESCE({d.format(a='tp + fp', b='tp + fp + tn + fn')}, 0), 6) AS ppr FROM {src}"""


def _cm_sql(thr: str, keys: str = "", src: str = "s") -> str:
    k = f"{keys}, " if keys else ""
    g = f" GROUP BY {keys}" if keys else ""
    return f"""SELECT {k}count(*) FILTER (WHERE p >= {thr} AND y = 1) AS tp, count(*) FILTER (WHERE p >= {thr} AND y <> 1) AS fp,
  count(*) FILTER (WHERE p < {thr} AND y <> 1) AS tn, count(*) FILTER (WHERE p < {thr} AND y = 1) AS fn FROM {src}{g}"""


@query("h01_confusion", f"WITH {SCORED_SQL}\n{_cm_sql('0.5', 'split')}")
def h01(spark, sf):
    return H.confusion(scored(spark, sf), "y", "p", 0.5, ["split"])


@query("h02_rates", f"WITH {SCORED_SQL}, cm AS ({_cm_sql('0.5', 'split')})\n{_rates_sql('cm', 'split')}")
def h02(spark, sf):
    return _r(H.rates(H.confusion(scored(spark, sf), "y", "p", 0.5, ["split"])), RATE_COLS)


_AUC_SQL = f"""WITH {SCORED_SQL},
pos AS (SELECT p FROM s WHERE y = 1), neg AS (SELECT p FROM s WHERE y <> 1)
SELECT round((SELECT sum(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END) FROM pos a, neg b)
       / ((SELECT count(*) FROM pos) * (SELECT count(*) FROM neg)), 6) AS roc_auc"""


@query("h03_roc_auc", _AUC_SQL)
def h03(spark, sf):
    return _r(H.curve_metrics(scored(spark, sf), "y", "p").select("roc_auc"), ["roc_auc"])


_AP_SQL = f"""WITH {SCORED_SQL}
SELECT round(avg((SELECT count(*) FILTER (WHERE t.y = 1) * 1.0 / count(*) FROM s t WHERE t.p >= o.p)), 6)
       AS average_precision FROM s o WHERE o.y = 1"""


@query("h04_average_precision", _AP_SQL)
def h04(spark, sf):
    return _r(H.curve_metrics(scored(spark, sf), "y", "p").select("average_precision"), ["average_precision"])


_TRAP_SQL = f"""WITH {SCORED_SQL},
d AS (SELECT p, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y <> 1) AS neg FROM s GROUP BY p),
c AS (SELECT p, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp FROM d),
t AS (SELECT sum(pos) AS tot_pos FROM d),
pts AS (SELECT tp * 1.0 / tot_pos AS r, tp * 1.0 / (tp + fp) AS pr,
               lag(tp * 1.0 / tot_pos, 1, 0.0) OVER (ORDER BY p DESC) AS r0,
               lag(tp * 1.0 / (tp + fp), 1, 1.0) OVER (ORDER BY p DESC) AS pr0,
               lag(tp, 1, 0) OVER (ORDER BY p DESC) AS tp0, tot_pos FROM c, t)
SELECT round(sum(CASE WHEN tp0 < tot_pos THEN (r - r0) * (pr + pr0) / 2 ELSE 0 END), 6) AS pr_auc_trapezoid FROM pts"""


@query("h05_pr_auc_trapezoid", _TRAP_SQL)
def h05(spark, sf):
    return _r(H.curve_metrics(scored(spark, sf), "y", "p").select("pr_auc_trapezoid"), ["pr_auc_trapezoid"])


@query("h06_brier", f"WITH {SCORED_SQL}\nSELECT split, round(avg((p - y) * (p - y)), 6) AS brier FROM s GROUP BY split")
def h06(spark, sf):
    return _r(H.brier(scored(spark, sf), "y", "p", ["split"]), ["brier"])


SWEEP = H.threshold_grid(0.01, 0.405, 0.005)


@query("h07_threshold_sweep", f"""WITH {SCORED_SQL},
th AS (SELECT CAST(round(0.01 + i * 0.005, 6) AS DOUBLE) AS threshold FROM range(0, {len(SWEEP)}) r(i)),
cm AS (SELECT th.threshold, count(*) FILTER (WHERE p >= threshold AND y = 1) AS tp,
         count(*) FILTER (WHERE p >= threshold AND y <> 1) AS fp, count(*) FILTER (WHERE p < threshold AND y <> 1) AS tn,
         count(*) FILTER (WHERE p < threshold AND y = 1) AS fn FROM th, s GROUP BY th.threshold)
{_rates_sql('cm', 'threshold')}""")
def h07(spark, sf):
    return _r(H.threshold_sweep(scored(spark, sf), "y", "p", SWEEP), RATE_COLS)


_SWEEP_CTE = f"""th AS (SELECT CAST(round(0.01 + i * 0.005, 6) AS DOUBLE) AS threshold FROM range(0, {len(SWEEP)}) r(i)),
cm AS (SELECT th.threshold, count(*) FILTER (WHERE p >= threshold AND y = 1) AS tp,
         count(*) FILTER (WHERE p >= threshold AND y <> 1) AS fp, count(*) FILTER (WHERE p < threshold AND y <> 1) AS tn,
         count(*) FILTER (WHERE p < threshold AND y = 1) AS fn FROM th, s GROUP BY th.threshold),
sw AS ({_rates_sql('cm', 'threshold')})"""


@query("h08_threshold_select", f"""WITH {SCORED_SQL}, {_SWEEP_CTE}
SELECT crit AS criterion, threshold FROM (
  SELECT 'f1' AS crit, threshold, row_number() OVER (ORDER BY f1 DESC, threshold) AS rn FROM sw
  UNION ALL SELECT 'precision', threshold, row_number() OVER (ORDER BY precision DESC, threshold) FROM sw
  UNION ALL SELECT 'recall', threshold, row_number() OVER (ORDER BY recall DESC, threshold) FROM sw) WHERE rn = 1""")
def h08(spark, sf):
    sw = _r(H.threshold_sweep(scored(spark, sf), "y", "p", SWEEP), RATE_COLS)
    out = None
    for m in ("f1", "precision", "recall"):
        q = H.select_threshold(sw, m).select("criterion", "threshold")
        out = q if out is None else out.unionByName(q)
    return out


@query("h08b_pr_curve_threshold", f"""WITH {SCORED_SQL},
d AS (SELECT p AS threshold, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y <> 1) AS neg FROM s
      WHERE p IS NOT NULL AND y IS NOT NULL GROUP BY p),
c AS (SELECT threshold, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS np FROM d
      WINDOW w AS (ORDER BY threshold DESC)),
f AS (SELECT threshold, round(2.0 * tp / (tp + fp + np), 6) AS f1 FROM c)
SELECT threshold, f1 FROM f ORDER BY f1 DESC, threshold LIMIT 1""")
def h08b(spark, sf):
    """H8: the score on the precision-recall curve with the best F1."""
    c = H.score_curve(scored(spark, sf), "y", "p")
    f1 = F.round(2.0 * F.col("cum_tp") / (F.col("cum_tp") + F.col("cum_fp") + F.col("P")), 6)
    best = c.agg(F.min_by(F.struct(F.col("score").alias("threshold"), f1.alias("f1")),
                          F.struct(-f1, F.col("score"))).alias("b"))
    return best.select("b.threshold", "b.f1")


@query("h09_constrained_threshold", f"""WITH {SCORED_SQL}, {_SWEEP_CTE},
a AS (SELECT threshold FROM sw WHERE accuracy >= 0.5 AND recall >= 0.4 AND precision >= 0.15 AND f1 >= 0.2
      ORDER BY f1 DESC, threshold LIMIT 1),
b AS (SELECT threshold FROM sw WHERE recall >= 0.4 ORDER BY accuracy DESC, threshold LIMIT 1)
SELECT COALESCE((SELECT threshold FROM a), (SELECT threshold FROM b), CAST(0.5 AS DOUBLE)) AS threshold,
       CASE WHEN (SELECT count(*) FROM a) > 0 THEN 'constraints_met' WHEN (SELECT count(*) FROM b) > 0
            THEN 'max_accuracy_recall' ELSE 'fallback' END AS rule""")
def h09(spark, sf):
    sw = _r(H.threshold_sweep(scored(spark, sf), "y", "p", SWEEP), RATE_COLS)
    return H.constrained_threshold(sw, min_acc=0.5)


@query("h10_capacity_threshold", f"""WITH {SCORED_SQL},
t AS (SELECT quantile_cont(p, 0.8) AS threshold FROM s WHERE split = 'train')
SELECT round(threshold, 6) AS threshold, (SELECT count(*) FROM s WHERE split = 'test' AND p >= threshold) AS flagged_test
FROM t""")
def h10(spark, sf):
    sc = scored(spark, sf)
    t = H.capacity_threshold(sc, "p", 0.2, F.col("split") == "train")
    test = sc.where(F.col("split") == "test")
    flagged = test.crossJoin(F.broadcast(t)).where(F.col("p") >= F.col("threshold")).agg(
        F.count(F.lit(1)).alias("flagged_test"))
    return t.select(F.round("threshold", 6).alias("threshold")).crossJoin(flagged)


@query("h11_calibration_bins", f"""WITH {SCORED_SQL},
e AS (SELECT quantile_cont(p, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]) AS edges FROM s),
b AS (SELECT s.*, len(list_filter(e.edges, lambda x: x < s.p)) AS bin0 FROM s, e),
g AS (SELECT bin0, count(*) AS n, avg(p) AS mp, avg(y) AS orate FROM b GROUP BY bin0)
SELECT CAST(dense_rank() OVER (ORDER BY bin0) AS INTEGER) AS bin, n, round(mp, 6) AS mean_predicted,
       round(orate, 6) AS observed_rate FROM g""")
def h11(spark, sf):
    return _r(H.calibration_bins(scored(spark, sf), "y", "p", 8), ["mean_predicted", "observed_rate"])


_SUB_KEYS = "field, grp"


@query("h12_subgroup_metrics", f"""WITH {SCORED_SQL},
long AS (SELECT y, p, 'lang' AS field, COALESCE(lang, 'None') AS grp FROM s
         UNION ALL SELECT y, p, 'source', COALESCE(source, 'None') FROM s),
cm AS ({_cm_sql('0.5', _SUB_KEYS, 'long')}),
base AS (SELECT field, grp, count(*) AS sample_count, count(*) FILTER (WHERE y = 1) AS positive_count,
                round(avg((p - y) * (p - y)), 6) AS brier FROM long GROUP BY field, grp)
SELECT b.field, b.grp AS "group", b.sample_count, b.positive_count, b.brier, r.f1, r.precision, r.recall
FROM base b JOIN ({_rates_sql('cm', _SUB_KEYS)}) r ON r.field = b.field AND r.grp = b.grp
WHERE b.sample_count >= 10 AND b.positive_count > 0 AND b.positive_count < b.sample_count""")
def h12(spark, sf):
    m = H.subgroup_metrics(scored(spark, sf), "y", "p", ["lang", "source"], 0.5, 10)
    return _r(m.select("field", "group", "sample_count", "positive_count", "brier", "f1", "precision", "recall"),
              ["brier", "f1", "precision", "recall"])


@query("h13_score_distribution", f"""WITH {SCORED_SQL}
SELECT round(min(p), 6) AS min, round(max(p), 6) AS max, round(avg(p), 6) AS mean,
       round(quantile_cont(p, 0.5), 6) AS median, round(quantile_cont(p, 0.25), 6) AS p25,
       round(quantile_cont(p, 0.75), 6) AS p75, round(quantile_cont(p, 0.9), 6) AS p90,
       round(quantile_cont(p, 0.99), 6) AS p99, count(*) FILTER (WHERE p >= 0.5) AS n_above FROM s""")
def h13(spark, sf):
    d = H.score_distribution(scored(spark, sf), "p", 0.5)
    return _r(d, ["min", "max", "mean", "median", "p25", "p75", "p90", "p99"])


@query("h14_error_cohort_means", f"""WITH {SCORED_SQL}
SELECT CASE WHEN p >= 0.5 AND y = 1 THEN 'TP' WHEN p >= 0.5 THEN 'FP' WHEN y = 1 THEN 'FN' ELSE 'TN' END AS outcome,
       count(*) AS n, round(avg(n_chars), 6) AS mean_n_chars FROM s GROUP BY outcome""")
def h14(spark, sf):
    return _r(H.error_cohort_means(scored(spark, sf), "y", "p", 0.5, ["n_chars"]), ["mean_n_chars"])


@query("h15_complementarity", f"""WITH {SCORED_SQL},
r AS (SELECT CAST(p >= 0.5 AS INTEGER) = y AS r1, CAST(p2 >= 0.5 AS INTEGER) = y AS r2 FROM s),
a AS (SELECT count(*) AS n, count(*) FILTER (WHERE r1 AND r2) AS both_right, count(*) FILTER (WHERE NOT r1 AND NOT r2)
      AS both_wrong, count(*) FILTER (WHERE r1 AND NOT r2) AS only_first, count(*) FILTER (WHERE NOT r1 AND r2)
      AS only_second FROM r)
SELECT *, round(both_right * 100.0 / n, 6) AS both_right_pct, round(both_wrong * 100.0 / n, 6) AS both_wrong_pct,
       round(only_first * 100.0 / n, 6) AS only_first_pct, round(only_second * 100.0 / n, 6) AS only_second_pct FROM a""")
def h15(spark, sf):
    c = H.complementarity(scored(spark, sf), "y", "p", "p2", 0.5, 0.5)
    return _r(c, [x for x in c.columns if x.endswith("_pct")])


@query("h16_score_correlation", f"WITH {SCORED_SQL}\nSELECT round(corr(p, p2), 6) AS correlation FROM s")
def h16(spark, sf):
    return _r(H.score_correlation(scored(spark, sf), "p", "p2"), ["correlation"])


@query("h17_decision_churn", f"""WITH {SCORED_SQL}
SELECT count(*) FILTER (WHERE y = 1 AND p < 0.5 AND p >= 0.3) AS recovered_fn,
       count(*) FILTER (WHERE y <> 1 AND p < 0.5 AND p >= 0.3) AS new_fp,
       count(*) FILTER (WHERE y = 1 AND p >= 0.5 AND p < 0.3) AS lost_tp,
       count(*) FILTER (WHERE y <> 1 AND p >= 0.5 AND p < 0.3) AS fixed_fp FROM s""")
def h17(spark, sf):
    return H.decision_churn(scored(spark, sf), "y", "p", 0.5, 0.3)


@query("h18_ap_lift", f"""WITH {SCORED_SQL},
ap AS (SELECT avg((SELECT count(*) FILTER (WHERE t.y = 1) * 1.0 / count(*) FROM s t WHERE t.p >= o.p)) AS ap
       FROM s o WHERE o.y = 1)
SELECT round(ap, 6) AS average_precision, round((SELECT avg(y) FROM s), 6) AS prevalence,
       round(ap / (SELECT avg(y) FROM s), 6) AS ap_lift FROM ap""")
def h18(spark, sf):
    sc = scored(spark, sf)
    return _r(H.ap_lift(H.curve_metrics(sc, "y", "p"), sc, "y"), ["average_precision", "prevalence", "ap_lift"])


_H19_COLS = ["roc_auc", "average_precision", "brier", "precision", "recall", "f1", "accuracy", "specificity"]


@query("h19_metrics_by_split", f"""WITH {SCORED_SQL},
cm AS ({_cm_sql('0.5', 'split')}), r AS ({_rates_sql('cm', 'split')}),
base AS (SELECT split, count(*) AS sample_count, count(*) FILTER (WHERE y = 1) AS positive_count,
                round(avg((p - y) * (p - y)), 6) AS brier FROM s GROUP BY split),
auc AS (SELECT a.split, sum(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END) AS w FROM s a JOIN s b
        ON a.split = b.split AND a.y = 1 AND b.y <> 1 GROUP BY a.split),
ap AS (SELECT o.split, avg((SELECT count(*) FILTER (WHERE t.y = 1) * 1.0 / count(*) FROM s t
        WHERE t.split = o.split AND t.p >= o.p)) AS ap FROM s o WHERE o.y = 1 GROUP BY o.split)
SELECT base.split, sample_count, positive_count, brier, r.tp, r.fp, r.tn, r.fn, r.precision, r.recall, r.f1,
       r.accuracy, r.specificity,
       round(auc.w / (positive_count * (sample_count - positive_count)), 6) AS roc_auc,
       round(ap.ap, 6) AS average_precision
FROM base JOIN r USING (split) LEFT JOIN auc USING (split) LEFT JOIN ap USING (split)""")
def h19(spark, sf):
    m = H.metrics_table(scored(spark, sf), "y", "p", 0.5, ["split"])
    return _r(m.select("split", "sample_count", "positive_count", "tp", "fp", "tn", "fn", *_H19_COLS), _H19_COLS)


@query("h20_model_comparison", f"""WITH {SCORED_SQL},
long AS (SELECT 'length_model' AS model, split, y, p FROM s UNION ALL SELECT 'id_model', split, y, p2 FROM s),
m AS (SELECT model, split, round(avg((p - y) * (p - y)), 6) AS brier,
        round(COALESCE(CAST(count(*) FILTER (WHERE p >= 0.5 AND y = 1) AS DOUBLE) / NULLIF(count(*) FILTER (WHERE p >= 0.5), 0), 0), 6) AS precision
      FROM long GROUP BY model, split)
SELECT m.split, m.model, m.brier, m.precision, round(m.brier - b.brier, 6) AS delta_brier,
       round(m.precision - b.precision, 6) AS delta_precision
FROM m JOIN m b ON b.split = m.split AND b.model = 'length_model'""")
def h20(spark, sf):
    sc = scored(spark, sf)
    long = (sc.select(F.lit("length_model").alias("model"), "split", "y", "p")
            .unionByName(sc.select(F.lit("id_model").alias("model"), "split", "y", F.col("p2").alias("p"))))
    m = _r(H.metrics_table(long, "y", "p", 0.5, ["model", "split"]).select("model", "split", "brier", "precision"),
           ["brier", "precision"])
    cmp = H.compare_models(m, "model", "length_model", ["brier", "precision"], "split")
    return _r(cmp, ["delta_brier", "delta_precision"])


def _by_model(spark, sf):
    sc = scored(spark, sf)
    long = (sc.select(F.lit("length_model").alias("model"), "split", "y", "p")
            .unionByName(sc.select(F.lit("id_model").alias("model"), "split", "y", F.col("p2").alias("p"))))
    return _r(H.metrics_table(long, "y", "p", 0.5, ["model", "split"]).select("model", "split", "precision", "recall"),
              ["precision", "recall"])


_BY_MODEL_SQL = f"""WITH {SCORED_SQL},
long AS (SELECT 'length_model' AS model, split, y, p FROM s UNION ALL SELECT 'id_model', split, y, p2 FROM s),
m AS (SELECT model, split,
  round(COALESCE(CAST(count(*) FILTER (WHERE p >= 0.5 AND y = 1) AS DOUBLE) / NULLIF(count(*) FILTER (WHERE p >= 0.5), 0), 0), 6)
    AS precision,
  round(COALESCE(CAST(count(*) FILTER (WHERE p >= 0.5 AND y = 1) AS DOUBLE) / NULLIF(count(*) FILTER (WHERE y = 1), 0), 0), 6)
    AS recall FROM long GROUP BY model, split)"""


@query("h20b_best_by_metric", _BY_MODEL_SQL + """
SELECT metric, arg_min(model, (-value, model)) AS best_model, max(value) AS best_value FROM (
  SELECT model, 'precision' AS metric, precision AS value FROM m WHERE split = 'test'
  UNION ALL SELECT model, 'recall', recall FROM m WHERE split = 'test') GROUP BY metric""")
def h20b(spark, sf):
    return H.best_by_metric(_by_model(spark, sf).where(F.col("split") == "test"), "model", ["precision", "recall"])


@query("h20c_train_test_gap", _BY_MODEL_SQL + """
SELECT model, max(precision) FILTER (WHERE split = 'train') AS train, max(precision) FILTER (WHERE split = 'test') AS test,
  round(max(precision) FILTER (WHERE split = 'train') - max(precision) FILTER (WHERE split = 'test'), 6) AS gap
FROM m GROUP BY model""")
def h20c(spark, sf):
    return _r(H.train_test_gap(_by_model(spark, sf), "model", "split", "precision"), ["gap"])


_WEIGHT_SQL = " + ".join(f"CAST(u >= {c!r} AS INTEGER)" for c in H.poisson1_cdf())


@query("f10_bootstrap_ci", f"""WITH {SCORED_SQL},
r AS (SELECT y, p, b, CAST('0x' || substr(md5('42:' || CAST(doc_id AS VARCHAR) || ':' || CAST(b AS VARCHAR)), 1, 8) AS BIGINT)
        / 4294967296.0::DOUBLE AS u FROM s, range(0, 100) t(b)),
w AS (SELECT y, p, b, {_WEIGHT_SQL} AS w FROM r),
cm AS (SELECT b, sum(w) FILTER (WHERE p >= 0.5 AND y = 1) AS tp, sum(w) FILTER (WHERE p >= 0.5 AND y <> 1) AS fp,
         sum(w) FILTER (WHERE p < 0.5 AND y = 1) AS fn FROM w GROUP BY b),
sc AS (SELECT b, p, sum(w) FILTER (WHERE y = 1) AS pos, sum(w) AS n FROM w WHERE w > 0 GROUP BY b, p),
cu AS (SELECT b, COALESCE(pos, 0) AS pos, sum(COALESCE(pos, 0)) OVER d AS cp, sum(n) OVER d AS cn,
         sum(COALESCE(pos, 0)) OVER (PARTITION BY b) AS np FROM sc WINDOW d AS (PARTITION BY b ORDER BY p DESC)),
ap AS (SELECT b, sum(pos * cp / cn) / max(np) AS average_precision FROM cu GROUP BY b),
per AS (SELECT COALESCE(tp / nullif(tp + COALESCE(fp, 0), 0), 0) AS precision, COALESCE(tp / nullif(tp + COALESCE(fn, 0), 0), 0) AS recall,
          COALESCE(2.0 * tp / nullif(2 * tp + COALESCE(fp, 0) + COALESCE(fn, 0), 0), 0) AS f1, average_precision FROM cm JOIN ap USING (b)),
long AS (UNPIVOT per ON precision, recall, f1, average_precision INTO NAME metric VALUE value),
ci AS (SELECT metric, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi, count(value) AS n_boot FROM long GROUP BY metric),
c0 AS (SELECT count(*) FILTER (WHERE p >= 0.5 AND y = 1) AS tp, count(*) FILTER (WHERE p >= 0.5 AND y <> 1) AS fp,
         count(*) FILTER (WHERE p < 0.5 AND y = 1) AS fn FROM s),
a0 AS (SELECT avg((SELECT count(*) FILTER (WHERE t.y = 1) * 1.0 / count(*) FROM s t WHERE t.p >= o.p)) AS ap FROM s o WHERE o.y = 1),
pt AS (SELECT 'precision' AS metric, tp * 1.0 / (tp + fp) AS point FROM c0 UNION ALL SELECT 'recall', tp * 1.0 / (tp + fn) FROM c0
  UNION ALL SELECT 'f1', 2.0 * tp / (2 * tp + fp + fn) FROM c0 UNION ALL SELECT 'average_precision', ap FROM a0)
SELECT metric, round(point, 6) AS point, round(lo, 6) AS ci_low, round(hi, 6) AS ci_high, n_boot FROM ci JOIN pt USING (metric)""")
def f10(spark, sf):
    b = H.bootstrap_ci(scored(spark, sf), "y", "p", "doc_id", 0.5, n_boot=100, seed=42)
    return _r(b, ["point", "ci_low", "ci_high"])
