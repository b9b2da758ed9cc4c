"""Registered modelling queries (G).  Model fits have no SQL twin (rows-only
check); deterministic preparation steps carry DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from evtrail.functions.prefix import exact_quantiles
from evtrail.operators import models as G
from evtrail.operators import splits as S
from evtrail.operators.ml_stages import isotonic_apply, isotonic_fit
from evtrail.functions.text import text_hash
from evtrail.plans.q_evaluation import SCORED_SQL, scored
from evtrail.plans.q_pointintime import E24_SQL, model_table_out
from evtrail.plans.registry import query
from evtrail.session import cut_lineage, memo_checkpoint
from evtrail.sources.io import scratch_path

NUMERIC = ["n_emergency_30d", "n_emergency_90d", "n_emergency_365d", "n_inpatient_90d", "n_outpatient_90d",
           "cost_30d", "cost_90d", "hist_visits", "days_since_prev_visit", "days_since_prev_emergency",
           "cost_velocity", "ed_out_ratio", "accelerating"]
CATEGORICAL = ["segment", "nation"]


ROWS_PER_FIT_TASK = 200_000


@memo_checkpoint
def _modelling_rows(spark, sf):
    """Model table with the temporal split and label; checkpointed because
    every model query reuses it several times."""
    mt = model_table_out(spark, sf).withColumn("index_ts", F.to_timestamp("index_date"))
    return S.temporal_split(mt, "index_ts")


def in_fit_parts(d, rows):
    """A written table in as many parts as the cluster has cores, or more of
    ROWS_PER_FIT_TASK rows.  A fit is hundreds of short stages, and each of
    their tasks answers the driver: what it gets follows rows, not files."""
    return d.coalesce(max(d.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_PER_FIT_TASK)))


def modelling_table(spark, sf):
    d = _modelling_rows(spark, sf)
    return in_fit_parts(d, d.count())


def _train_test(spark, sf):
    d = modelling_table(spark, sf)
    return d.where(F.col("split") != "test"), d.where(F.col("split") == "test")


MT = lambda: f"""mt0 AS (SELECT * FROM ({E24_SQL}) x), y AS (SELECT max(year(CAST(index_date AS DATE))) AS ymax FROM mt0),
mt AS (SELECT mt0.*, CASE WHEN year(CAST(index_date AS DATE)) = ymax THEN 'test'
  WHEN year(CAST(index_date AS DATE)) = ymax - 1 THEN 'validation' ELSE 'train' END AS split FROM mt0, y)"""  # noqa: E731


def median_impute(train, df, cols):
    """G1 (exact): training median (numpy linear interpolation) + indicator."""
    out = df
    for c in cols:
        m = exact_quantiles(train, c, [0.5], name="_med").select("_med")
        out = (out.crossJoin(F.broadcast(m)).withColumn(f"{c}_missing", F.col(c).isNull().cast("int"))
               .withColumn(c, F.coalesce(F.col(c), F.col("_med"))).drop("_med"))
    return out


@query("g01_median_impute", lambda: f"""WITH {MT()},
med AS (SELECT quantile_cont(days_since_prev_emergency, 0.5) AS m FROM mt WHERE split <> 'test')
SELECT index_id, round(COALESCE(days_since_prev_emergency, m), 6) AS days_since_prev_emergency,
  CAST(days_since_prev_emergency IS NULL AS INTEGER) AS days_since_prev_emergency_missing FROM mt, med""")
def g01(spark, sf):
    tr, _ = _train_test(spark, sf)
    d = median_impute(tr, modelling_table(spark, sf), ["days_since_prev_emergency"])
    return d.select("index_id", F.round("days_since_prev_emergency", 6).alias("days_since_prev_emergency"),
                    "days_since_prev_emergency_missing")


@query("g02_mode_impute", lambda: f"""WITH {MT()},
md AS (SELECT days_since_prev_emergency AS m FROM mt WHERE split <> 'test' AND days_since_prev_emergency IS NOT NULL
       GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT index_id, COALESCE(days_since_prev_emergency, (SELECT m FROM md)) AS days_since_prev_emergency FROM mt""")
def g02(spark, sf):
    tr, _ = _train_test(spark, sf)
    d = G.mode_impute(tr, modelling_table(spark, sf), ["days_since_prev_emergency"])
    return d.select("index_id", "days_since_prev_emergency")


@query("g03_standardise", lambda: f"""WITH {MT()},
st AS (SELECT avg(cost_30d) AS m, stddev_samp(cost_30d) AS s FROM mt WHERE split <> 'test')
SELECT index_id, round((cost_30d - m) / CASE WHEN COALESCE(s, 0) = 0 THEN 1.0 ELSE s END, 6) AS cost_30d FROM mt, st""")
def g03(spark, sf):
    tr, _ = _train_test(spark, sf)
    d = G.standardise(tr, modelling_table(spark, sf), ["cost_30d"])
    return d.select("index_id", F.round("cost_30d", 6).alias("cost_30d"))


@query("g04_one_hot", lambda: f"""WITH {MT()},
voc AS (SELECT segment, CAST(row_number() OVER (ORDER BY segment) - 1 AS DOUBLE) AS idx FROM
        (SELECT DISTINCT segment FROM mt WHERE split = 'train' AND segment IS NOT NULL)),
nv AS (SELECT count(*) AS n FROM voc)
SELECT index_id, COALESCE(voc.idx, CAST(nv.n AS DOUBLE)) AS segment_idx, CAST(nv.n + 2 AS INTEGER) AS ohe_size
FROM mt LEFT JOIN voc USING (segment), nv""")
def g04(spark, sf):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array
    d = modelling_table(spark, sf)
    model = Pipeline(stages=G.one_hot_stages(["segment"])).fit(d.where(F.col("split") == "train"))
    out = model.transform(d)
    return out.select("index_id", F.col("segment_idx").alias("segment_idx"),
                      F.size(vector_to_array("segment_ohe")).alias("ohe_size"))


@query("g05_ordinal_encode", lambda: f"""WITH {MT()},
voc AS (SELECT nation, CAST(row_number() OVER (ORDER BY nation) - 1 AS INTEGER) AS code FROM
        (SELECT DISTINCT nation FROM mt WHERE split = 'train' AND nation IS NOT NULL))
SELECT index_id, COALESCE(voc.code, -1) AS nation_code FROM mt LEFT JOIN voc USING (nation)""")
def g05(spark, sf):
    d = modelling_table(spark, sf)
    e = G.ordinal_encode(d.where(F.col("split") == "train"), d, "nation", unknown=-1, start=0)
    return e.select("index_id", "nation_code")


@query("g06_train_vocabulary", lambda: f"""WITH {MT()},
voc AS (SELECT nation, CAST(row_number() OVER (ORDER BY nation) AS INTEGER) AS code FROM
        (SELECT DISTINCT nation FROM mt WHERE split = 'train' AND nation IS NOT NULL))
SELECT index_id, COALESCE(voc.code, 0) AS nation_code FROM mt LEFT JOIN voc USING (nation)""")
def g06(spark, sf):
    d = modelling_table(spark, sf)
    e = G.ordinal_encode(d.where(F.col("split") == "train"), d, "nation", unknown=0, start=1)
    return e.select("index_id", "nation_code")


_UTILIZATION = ["n_emergency_30d", "n_emergency_90d", "n_emergency_365d", "n_inpatient_90d", "n_outpatient_90d",
                "days_since_prev_visit", "days_since_prev_emergency"]
GROUPS = G.feature_groups(
    ["segment", "nation"], _UTILIZATION,
    [["hist_visits", "hist_emergency"], ["cost_30d", "cost_90d"], ["cost_velocity", "ed_out_ratio"], ["accelerating"]],
    {"demographic": ["segment", "nation"], "utilization": _UTILIZATION, "cost": ["cost_30d", "cost_90d", "cost_velocity"]})


@query("g07_feature_groups", lambda: f"""WITH {MT()}
SELECT index_id, {", ".join(GROUPS["G"])} FROM mt""")
def g07(spark, sf):
    d = modelling_table(spark, sf)
    return d.select("index_id", *GROUPS["G"])


@query("g07b_group_catalogue", lambda: f"WITH {MT()}\n" + " UNION ALL ".join(
    f"SELECT '{g}' AS feature_group, {len(c)} AS n_features, CAST({' + '.join(f'count({x})' for x in c)} AS BIGINT) AS n_values FROM mt"
    for g, c in GROUPS.items()))
def g07b(spark, sf):
    """The nested groups A..G and the specialist groups, with the values each holds."""
    d = modelling_table(spark, sf)
    one = d.agg(*[F.count(c).alias(c) for c in dict.fromkeys(x for g in GROUPS.values() for x in g)])
    return one.select(F.explode(F.array(*[F.struct(
        F.lit(g).alias("feature_group"), F.lit(len(c)).alias("n_features"),
        sum((F.col(x) for x in c[1:]), F.col(c[0])).alias("n_values")) for g, c in GROUPS.items()])).alias("x")).select("x.*")


def _fit_eval(spark, sf, kind):
    tr, te = _train_test(spark, sf)
    _, sc = G.fit_score(tr, te, NUMERIC, CATEGORICAL, kind)
    s = G.score_summary(sc)
    return s.select(F.lit(kind).alias("model"), "roc_auc", "average_precision", "brier")


@query("g08_logistic_regression", None)
def g08(spark, sf):
    return _fit_eval(spark, sf, "logistic")


@query("g09_random_forest", None)
def g09(spark, sf):
    return _fit_eval(spark, sf, "random_forest")


@query("g10_gradient_boosted_trees", None)
def g10(spark, sf):
    return _fit_eval(spark, sf, "gbt")


def _folds(spark, sf):
    tr, _ = _train_test(spark, sf)
    return cut_lineage(S.expanding_folds(tr, "index_ts", "index_id", 3))


@query("g11_random_search", None)
def g11(spark, sf):
    return G.random_search(None, _folds(spark, sf), NUMERIC, [], "logistic",
                           {"regParam": [0.0, 0.01, 0.1, 1.0], "maxIter": [20, 50]}, n_iter=3)


@query("g12_cv_benchmark", None)
def g12(spark, sf):
    return G.cv_benchmark(_folds(spark, sf), NUMERIC, [], ["logistic", "random_forest"])


@query("g12b_forest_importances", None)
def g12b(spark, sf):
    tr, te = _train_test(spark, sf)
    model, _ = G.fit_score(tr, te, NUMERIC, [], "random_forest")
    return G.importances(model, [*NUMERIC, *(f"{c}_missing" for c in NUMERIC)], spark)


@query("g12c_group_folds", None)
def g12c(spark, sf):
    """Cross-validation over entity folds: no entity on both sides."""
    tr, _ = _train_test(spark, sf)
    folds = S.group_kfold(tr, "entity_id", 3)
    return G.cv_summary(G.group_fold_scores(folds, "fold", NUMERIC, [], ["logistic", "random_forest"]))


@query("g13_calibration", None)
def g13(spark, sf):
    """The model is fitted on the training years, the calibrators on one half
    of the validation year; the other half picks the method."""
    d = modelling_table(spark, sf)
    model, te = G.fit_score(d.where(F.col("split") == "train"), d.where(F.col("split") == "test"), NUMERIC, CATEGORICAL, "gbt")
    va = G.positive_score(model.transform(d.where(F.col("split") == "validation")))
    half = F.pmod(text_hash(F.col("index_id")), F.lit(2))
    return G.calibrate(va.where(half == 0).select("label", "p"), va.where(half == 1).select("label", "p"),
                       te.select("label", "p"))


@query("g13b_isotonic_steps", f"""WITH {SCORED_SQL},
pt AS (SELECT p, count(*) AS w, sum(y) AS wy, row_number() OVER (ORDER BY p) AS i FROM s GROUP BY p),
run AS (SELECT i, p, sum(w) OVER (ORDER BY i) AS cw, sum(wy) OVER (ORDER BY i) AS cy, w, wy FROM pt),
span AS (SELECT a.i AS a, b.i AS b, (b.cy - a.cy + a.wy) * 1.0 / (b.cw - a.cw + a.w) AS mean
         FROM run a JOIN run b ON b.i >= a.i),
low AS (SELECT a, b AS i, min(mean) OVER (PARTITION BY a ORDER BY b DESC) AS least FROM span)
SELECT round(pt.p, 6) AS p, round(max(least), 6) AS fitted FROM low JOIN pt USING (i) GROUP BY i, pt.p""")
def g13b(spark, sf):
    """Isotonic fit of the labelled scores, applied to each distinct score."""
    d = scored(spark, sf)
    out = isotonic_apply(d.select("p").distinct(), isotonic_fit(d, "y", "p"), "p", "fitted")
    return out.select(F.round("p", 6).alias("p"), F.round("fitted", 6).alias("fitted"))


@query("g14_ensemble_sweep", f"""WITH {SCORED_SQL},
w AS (SELECT i / 10.0 AS weight FROM range(0, 11) t(i)),
e AS (SELECT w.weight, s.y, w.weight * s.p + (1 - w.weight) * s.p2 AS pe FROM s, w),
ap AS (SELECT o.weight, avg((SELECT count(*) FILTER (WHERE t.y = 1) * 1.0 / count(*) FROM e t
        WHERE t.weight = o.weight AND t.pe >= o.pe)) AS ap FROM e o WHERE o.y = 1 GROUP BY o.weight)
SELECT round(weight, 6) AS weight, round(ap, 6) AS average_precision,
  round((SELECT weight FROM ap ORDER BY ap DESC, weight LIMIT 1), 6) AS best_weight FROM ap""")
def g14(spark, sf):
    sw = G.ensemble_sweep(scored(spark, sf), "y", "p", "p2", 10)
    return sw.select(F.round("weight", 6).alias("weight"), F.round("average_precision", 6).alias("average_precision"),
                     F.round("best_weight", 6).alias("best_weight"))


@query("g15_stacking", None)
def g15(spark, sf):
    """Base models score the rows each temporal fold held out; the meta-model
    learns on those scores and is judged on the test year."""
    tr, te = _train_test(spark, sf)
    kinds = ("logistic", "random_forest")
    folds = _folds(spark, sf)
    of = lambda f, r: folds.where((F.col("fold") == f) & (F.col("role") == r))
    tasks = [*((of(f, "train"), of(f, "test")) for f in range(3)), (tr, te)]
    *held, test = G.in_parallel(spark, lambda t: _two_scores(*t, kinds), tasks)
    st = G.stacking(cut_lineage(S.assemble_oof(held)), cut_lineage(test), [f"p_{k}" for k in kinds])
    return G.score_summary(st, "label", "p_stack")


def _two_scores(fit, out, kinds):
    ready, fit = G.prepare(G.add_balanced_weight(fit), NUMERIC, [])
    out = ready.transform(out)
    for k in kinds:
        out = G.positive_score(G.make_classifier(k).fit(fit).transform(out), f"p_{k}").drop(
            "rawPrediction", "probability", "prediction")
    return out.select("index_id", "label", *[f"p_{k}" for k in kinds])


@query("g16_batch_scoring", None)
def g16(spark, sf):
    """The model is saved with its schema, loaded again and applied; the
    latest scored row of every entity."""
    tr, _ = _train_test(spark, sf)
    d = modelling_table(spark, sf)
    path = scratch_path(spark, "model")
    G.save_model(G.build_pipeline(NUMERIC, CATEGORICAL, "logistic").fit(G.add_balanced_weight(tr)), tr,
                 [*NUMERIC, *CATEGORICAL], path)
    sc = G.score_with_stored(spark, path, d).select("entity_id", "index_id", "index_ts", "p")
    return G.latest_per_entity(sc, "entity_id", "index_ts", "index_id")


@query("g18_permutation_importance", None)
def g18(spark, sf):
    tr, te = _train_test(spark, sf)
    model, _ = G.fit_score(tr, te, NUMERIC, [], "logistic")
    return G.permutation_importance(model, te.select("index_id", "label", *NUMERIC), ["n_emergency_90d", "hist_visits", "cost_30d"], "index_id")


@query("g19_ablation", None)
def g19(spark, sf):
    tr, te = _train_test(spark, sf)
    return G.ablation(tr, te, ["n_emergency_90d"], ["hist_visits", "cost_30d", "days_since_prev_visit"])
