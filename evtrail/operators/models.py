"""Feature preparation and modelling with ``pyspark.ml`` (G).

Everything trains and scores as distributed Spark ML stages; evaluation of
fitted scores reuses :mod:`evtrail.operators.evaluation` (distributed AP /
AUC), never a driver-side metric loop over rows.  Search loops (G11, G12,
G14, G19) iterate over a handful of configurations on the driver -- each
iteration is a distributed fit.
"""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evtrail.functions.prefix import global_rank
from evtrail.operators import evaluation as H
from evtrail.operators.ml_stages import ExactMedianImputer, isotonic_apply, isotonic_fit
from evtrail.session import cut_lineage


# ------------------------------------------------------------- G1..G6 -----

def mode_impute(train: DataFrame, df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fill nulls with the training mode (ties -> smallest value)."""
    out = df
    for c in cols:
        m = (train.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
             .agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(c).alias("v")))["v"].alias("_mode")))
        out = out.crossJoin(F.broadcast(m)).withColumn(c, F.coalesce(F.col(c), F.col("_mode"))).drop("_mode")
    return out


def standardise(train: DataFrame, df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - mean) / std from the training rows; zero std -> 1."""
    st = train.agg(*[x for c in cols for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_samp(c).alias(f"_s_{c}"))])
    j = df.crossJoin(F.broadcast(st))
    for c in cols:
        s = F.when(F.coalesce(F.col(f"_s_{c}"), F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col(f"_s_{c}"))
        j = j.withColumn(c, (F.col(c) - F.col(f"_m_{c}")) / s)
    return j.drop(*[x for c in cols for x in (f"_m_{c}", f"_s_{c}")])


def one_hot_stages(cols: Sequence[str]):
    """StringIndexer(keep unseen) + OneHotEncoder(keep) stages."""
    idx = StringIndexer(inputCols=list(cols), outputCols=[f"{c}_idx" for c in cols], handleInvalid="keep",
                        stringOrderType="alphabetAsc")
    ohe = OneHotEncoder(inputCols=[f"{c}_idx" for c in cols], outputCols=[f"{c}_ohe" for c in cols],
                        handleInvalid="keep", dropLast=False)
    return [idx, ohe]


def ordinal_encode(train: DataFrame, df: DataFrame, col: str, unknown: int = -1, start: int = 0) -> DataFrame:
    """Dictionary of training values (sorted, code start..), joined
    back; unseen -> ``unknown`` (G5: -1, G6: 0 with start=1).  The dictionary
    is ranked with bucketed counts, not a single-partition window."""
    vocab = train.select(F.col(col).cast("string").alias("_v")).where(F.col("_v").isNotNull()).distinct()
    ranked = global_rank(vocab, "_v", [], name="_code").select("_v", (F.col("_code") - 1 + start).alias("_code"))
    out = df.join(ranked, df[col].cast("string") == ranked["_v"], "left")
    return out.withColumn(f"{col}_code", F.coalesce(F.col("_code"), F.lit(unknown)).cast("int")).drop("_v", "_code")


# Nested feature groups (each group adds to the previous).
def feature_groups(base: Sequence[str], utilization: Sequence[str], blocks: Sequence[Sequence[str]],
                   specialists: Mapping[str, Sequence[str]] | None = None) -> dict[str, list[str]]:
    """A the base, B with utilization, then B with one block each (C, D,
    ...), the last letter B with all blocks; and the specialist groups."""
    b = [*base, *utilization]
    groups = {"A": list(base), "B": b}
    for letter, block in zip("CDEFGHIJKLMNOPQRSTUVWXY", blocks):
        groups[letter] = [*b, *block]
    groups[chr(ord("C") + len(blocks))] = [*b, *(c for block in blocks for c in block)]
    return groups | {k: list(v) for k, v in (specialists or {}).items()}


# ------------------------------------------------------------- G8..G10 ----

def make_classifier(kind: str, params: Mapping | None = None, weight_col: str | None = "w", seed: int = 42):
    params = dict(params or {})
    w = {"weightCol": weight_col} if weight_col else {}
    if kind == "logistic":
        return LogisticRegression(featuresCol="features", labelCol="label", maxIter=params.get("maxIter", 50),
                                  regParam=params.get("regParam", 0.01), **w)
    if kind == "random_forest":
        return RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=params.get("numTrees", 50),
                                      maxDepth=params.get("maxDepth", 6), seed=seed, **w)
    if kind == "gbt":
        return GBTClassifier(featuresCol="features", labelCol="label", maxIter=params.get("maxIter", 30),
                             maxDepth=params.get("maxDepth", 4), stepSize=params.get("stepSize", 0.1), seed=seed, **w)
    raise ValueError(kind)


def build_pipeline(numeric: Sequence[str], categorical: Sequence[str], kind: str, params: Mapping | None = None,
                   scale: bool = False) -> Pipeline:
    """Median impute with missing indicators -> (one-hot) -> assemble ->
    (scale) -> classifier.  Numeric features come first, then one-hot
    vectors, then the indicators."""
    missing = [f"{c}_missing" for c in numeric]
    stages = [ExactMedianImputer(inputCols=list(numeric), outputCols=[f"{c}_imp" for c in numeric],
                                 indicatorCols=missing)]
    feats = [f"{c}_imp" for c in numeric]
    if categorical:
        stages += one_hot_stages(categorical)
        feats += [f"{c}_ohe" for c in categorical]
    feats += missing
    stages.append(VectorAssembler(inputCols=feats, outputCol="raw_features" if scale else "features",
                                  handleInvalid="keep"))
    if scale:
        stages.append(StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True))
    stages.append(make_classifier(kind, params))
    return Pipeline(stages=stages)


def add_balanced_weight(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weights: positives get (n - pos) / pos."""
    st = df.agg(F.count(F.lit(1)).alias("_n"), F.sum(label).alias("_p"))
    return (df.crossJoin(F.broadcast(st))
            .withColumn("w", F.when(F.col(label) == 1, (F.col("_n") - F.col("_p")) / F.col("_p")).otherwise(1.0))
            .drop("_n", "_p"))


def positive_score(pred: DataFrame, name: str = "p") -> DataFrame:
    return pred.withColumn(name, vector_to_array("probability")[1])


def fit_score(train: DataFrame, test: DataFrame, numeric, categorical, kind, params=None) -> tuple[PipelineModel, DataFrame]:
    model = build_pipeline(numeric, categorical, kind, params).fit(add_balanced_weight(train))
    return model, positive_score(model.transform(test))


def prepare(train: DataFrame, numeric, categorical) -> tuple[PipelineModel, DataFrame]:
    """The steps before the classifier, fitted on ``train``, and its rows with
    features: several classifiers learn from one preparation."""
    model = Pipeline(stages=build_pipeline(numeric, categorical, "logistic").getStages()[:-1]).fit(train)
    return model, model.transform(train)


def in_parallel(spark, fn, tasks: Sequence, parallelism: int = 4) -> list:
    """Results of ``fn`` for a handful of tasks, each a distributed job."""
    with ThreadPool(parallelism) as pool:
        return pool.map(inheritable_thread_target(spark)(fn), list(tasks))


def score_summary(scored: DataFrame, label: str = "label", p: str = "p") -> DataFrame:
    """AP, ROC-AUC, Brier of a scored frame (distributed)."""
    cm = H.curve_metrics(scored, label, p)
    br = H.brier(scored, label, p)
    return cm.crossJoin(br)


# ------------------------------------------------------------ G11..G16 ----

def random_search(train: DataFrame, folds: DataFrame, numeric, categorical, kind: str,
                  space: Mapping[str, Sequence], n_iter: int = 4, seed: int = 42) -> DataFrame:
    """Seeded random parameter draws x temporal folds (``folds`` has
    fold/role per row), scored by AP; returns (trial, params, mean_ap)."""
    rng = random.Random(seed)
    trials = [{k: rng.choice(list(v)) for k, v in space.items()} for _ in range(n_iter)]
    scores = fold_scores(folds, numeric, categorical, {str(t): (kind, prm) for t, prm in enumerate(trials)})
    drawn = folds.sparkSession.createDataFrame([(str(t), str(prm)) for t, prm in enumerate(trials)],
                                               "model string, params string")
    return (H.curve_metrics(scores, "label", "p", ["model", "fold"]).groupBy("model")
            .agg(F.avg("average_precision").alias("mean_ap"), F.count(F.lit(1)).alias("n_folds"))
            .join(drawn, "model").select(F.col("model").cast("int").alias("trial"), "params", "mean_ap", "n_folds"))


def fold_scores(folds: DataFrame, numeric, categorical, models: Mapping[str, tuple[str, Mapping | None]],
                id_col: str = "index_id", parallelism: int = 4) -> DataFrame:
    """Scores of the held-out rows, (model, fold, id, label, p), written as a
    table.  ``folds`` has fold and role (train/test) per row; ``models``: name
    -> (kind, parameters).  A fold is prepared once for all its models;
    ``parallelism`` folds are fitted at a time, each as distributed jobs."""
    fold_ids = sorted(r["fold"] for r in folds.select("fold").distinct().collect())   # a few fold ids

    def one(fold) -> DataFrame:
        part = folds.where(F.col("fold") == fold)
        ready, fit = prepare(add_balanced_weight(part.where(F.col("role") == "train")), numeric, categorical)
        held = ready.transform(part.where(F.col("role") == "test"))
        return reduce(DataFrame.unionByName, [
            positive_score(make_classifier(kind, params).fit(fit).transform(held)).select(
                F.lit(name).alias("model"), F.lit(int(fold)).alias("fold"), id_col, "label", "p")
            for name, (kind, params) in models.items()])

    return cut_lineage(reduce(DataFrame.unionByName, in_parallel(folds.sparkSession, one, fold_ids, parallelism)))


def group_fold_scores(df: DataFrame, fold_col: str, numeric, categorical, kinds: Sequence[str], id_col: str = "index_id",
                      parallelism: int = 4) -> DataFrame:
    """Held-out scores of a k-fold cross-validation with given folds (such as
    group folds, F4): each fold's models are fitted on the rows of the other
    folds, prepared once for all kinds, and score the rows of the fold.  Every
    row has a fold from 0 on and no fold is empty, else the job fails."""
    weighted = cut_lineage(add_balanced_weight(df.withColumn(fold_col, F.col(fold_col).cast("int"))))
    rows = {r[fold_col]: r["count"] for r in weighted.groupBy(fold_col).count().collect()}     # one row a fold
    n_folds = max((f for f in rows if f is not None), default=-1) + 1
    if n_folds < 2 or set(rows) != set(range(n_folds)):
        raise ValueError(f"folds 0, 1, ... expected, rows by fold: {rows}")

    def one(fold) -> DataFrame:
        ready, fit = prepare(weighted.where(F.col(fold_col) != fold), numeric, categorical)
        held = ready.transform(weighted.where(F.col(fold_col) == fold))
        return reduce(DataFrame.unionByName, [
            positive_score(make_classifier(kind).fit(fit).transform(held)).select(
                F.lit(kind).alias("model"), F.lit(fold).alias("fold"), id_col, "label", "p") for kind in kinds])

    return cut_lineage(reduce(DataFrame.unionByName, in_parallel(df.sparkSession, one, range(n_folds), parallelism)))


def cv_summary(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Mean and standard deviation over folds of AP, AUC and F1 at
    ``threshold``, per model, from stored fold scores; all folds in one pass."""
    hit = (F.col("p") >= threshold).cast("long")
    f1 = scores.groupBy("model", "fold").agg(
        F.sum(hit * F.col("label")).alias("tp"), F.sum(hit).alias("called"), F.sum("label").alias("pos"))
    f1 = f1.select("model", "fold", F.coalesce(F.try_divide(2 * F.col("tp"), F.col("called") + F.col("pos")),
                                               F.lit(0.0)).alias("f1"))
    per_fold = H.curve_metrics(scores, "label", "p", ["model", "fold"]).join(f1, ["model", "fold"])
    return per_fold.groupBy("model").agg(*[f(c).alias(f"{n}_{k}") for c, n in
                                           (("average_precision", "ap"), ("roc_auc", "auc"), ("f1", "f1"))
                                           for f, k in ((F.avg, "mean"), (F.stddev_pop, "std"))])


def cv_benchmark(folds: DataFrame, numeric, categorical, kinds: Sequence[str]) -> DataFrame:
    """Models x temporal folds -> mean/std AP, AUC and F1."""
    return cv_summary(fold_scores(folds, numeric, categorical, {k: (k, None) for k in kinds}))


def importances(model: PipelineModel, feature_names: Sequence[str], spark) -> DataFrame:
    """A tree model's own importances as rows (feature, importance,
    rank); one row per feature, metadata of the model."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    ranked = sorted(zip(feature_names, imp), key=lambda x: (-x[1], x[0]))
    return spark.createDataFrame([(f, float(v), i) for i, (f, v) in enumerate(ranked, 1)],
                                 "feature string, importance double, rank int")


def calibrate(fit_scored: DataFrame, pick_scored: DataFrame, test_scored: DataFrame, label: str = "label",
              p: str = "p") -> DataFrame:
    """Sigmoid (logistic regression on the logit of the score) and
    isotonic calibration fitted on ``fit_scored``, rows the model was not
    trained on; the method of least Brier on ``pick_scored`` is chosen, and
    every method's Brier on ``test_scored`` reported."""
    eps = 1e-6
    logit = F.log(F.least(F.greatest(F.col(p), F.lit(eps)), F.lit(1 - eps)) /
                  (1 - F.least(F.greatest(F.col(p), F.lit(eps)), F.lit(1 - eps))))
    va = VectorAssembler(inputCols=["_logit"], outputCol="_f")
    tr = va.transform(fit_scored.withColumn("_logit", logit))
    sig = LogisticRegression(featuresCol="_f", labelCol=label, predictionCol="_sp", probabilityCol="_sprob",
                             rawPredictionCol="_sraw").fit(tr)
    steps = isotonic_fit(fit_scored, label, p)

    def briers(scored):
        x = va.transform(scored.withColumn("_logit", logit))
        x = sig.transform(x).select(label, p, vector_to_array("_sprob")[1].alias("_sp1"))
        x = isotonic_apply(x, steps, p, "_ip")
        b = x.agg(*[F.avg(F.pow(F.col(c) - F.col(label), 2)).alias(n)
                    for c, n in ((p, "raw"), ("_sp1", "sigmoid"), ("_ip", "isotonic"))])
        return b.unpivot([], ["raw", "sigmoid", "isotonic"], "method", "brier")
    picked = briers(pick_scored).withColumnRenamed("brier", "brier_validation")
    best = picked.agg(F.min_by("method", F.struct("brier_validation", "method")).alias("best"))
    return briers(test_scored).join(picked, "method").crossJoin(best)


def ensemble_sweep(df: DataFrame, label: str, p1: str, p2: str, steps: int = 10) -> DataFrame:
    """AP of w*p1 + (1-w)*p2 for w on a grid; the grid is exploded
    (bounded, steps+1 copies) and AP is computed per weight with the
    bucketed curve."""
    e = df.select(label, p1, p2, F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("_i"))
    e = e.withColumn("weight", F.col("_i") / steps).drop("_i")
    e = e.withColumn("p_ens", F.col("weight") * F.col(p1) + (1 - F.col("weight")) * F.col(p2))
    cm = H.curve_metrics(e, label, "p_ens", ["weight"])
    best = cm.agg(F.min_by("weight", F.struct((-F.col("average_precision")).alias("a"), F.col("weight")))
                  .alias("best_weight"))
    return cm.crossJoin(best)


def stacking(train: DataFrame, test: DataFrame, score_cols: Sequence[str], label: str = "label") -> DataFrame:
    """Logistic meta-model on out-of-fold scores."""
    va = VectorAssembler(inputCols=list(score_cols), outputCol="features")
    lr = LogisticRegression(featuresCol="features", labelCol=label)
    model = Pipeline(stages=[va, lr]).fit(train)
    return positive_score(model.transform(test), "p_stack")


def save_model(model: PipelineModel, train: DataFrame, inputs: Sequence[str], path: str) -> None:
    """A fitted pipeline and the names and types of its input columns."""
    model.write().overwrite().save(f"{path}/pipeline")
    fields = [(c, train.schema[c].dataType.simpleString()) for c in inputs]
    train.sparkSession.createDataFrame(fields, "name string, type string").coalesce(1).write.mode("overwrite").parquet(
        f"{path}/inputs")


def score_with_stored(spark, path: str, df: DataFrame, name: str = "p") -> DataFrame:
    """Load a stored pipeline, check that the table has its input columns
    with the stored types, and score it."""
    inputs = {r["name"]: r["type"] for r in spark.read.parquet(f"{path}/inputs").collect()}   # one row a column
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    wrong = sorted(f"{c}: {t} expected, {have.get(c, 'absent')} found" for c, t in inputs.items() if have.get(c) != t)
    if wrong:
        raise ValueError("table does not fit the stored model: " + "; ".join(wrong))
    return positive_score(PipelineModel.load(f"{path}/pipeline").transform(df), name)


def latest_per_entity(scored: DataFrame, entity: str, ts: str, id_col: str) -> DataFrame:
    """The latest scored row per entity (aggregate, not a window)."""
    cols = [c for c in scored.columns if c != entity]
    m = scored.groupBy(entity).agg(F.max(F.struct(F.col(ts).alias("_t"), F.col(id_col).alias("_i"),
                                                  *[F.col(c) for c in cols])).alias("_m"))
    return m.select(entity, *[F.col(f"_m.{c}").alias(c) for c in cols])


def permuted_columns(df: DataFrame, cols: Sequence[str], id_col: str, seed: int = 7) -> DataFrame:
    """Add ``_perm_<column>``, a seeded permutation of each column: rows ranked
    by id and by a seeded hash; the value at id-rank r moves to the row at
    hash-rank r.  The two rankings serve all columns."""
    by_id = global_rank(df.select(id_col, *[F.col(c).alias(f"_perm_{c}") for c in cols]), id_col, [], name="_r").drop(id_col)
    by_h = global_rank(df.withColumn("_h", F.xxhash64(F.col(id_col), F.lit(seed))), "_h", ["_h", id_col], name="_r").drop("_h")
    return by_h.join(by_id, "_r").drop("_r")


def permute_column(df: DataFrame, col: str, id_col: str, seed: int = 7) -> DataFrame:
    """Seeded permutation of one column."""
    return permuted_columns(df, [col], id_col, seed).drop(col).withColumnRenamed(f"_perm_{col}", col)


def permutation_importance(model: PipelineModel, test: DataFrame, features: Sequence[str], id_col: str,
                           label: str = "label") -> DataFrame:
    """AP drop when each feature is permuted.  The rows are scored as they
    are and with one column exchanged at a time, in one pass."""
    variants = permuted_columns(test, features, id_col).withColumn(
        "_variant", F.explode(F.array(F.lit("rows as they are"), *[F.lit(f"permuted {f}") for f in features])))
    variants = variants.withColumns({f: F.when(F.col("_variant") == f"permuted {f}", F.col(f"_perm_{f}")).otherwise(F.col(f))
                                     for f in features})
    scored = positive_score(model.transform(variants)).select("_variant", label, "p")
    ap = cut_lineage(H.curve_metrics(scored, label, "p", ["_variant"]).select("_variant", "average_precision"))
    base = ap.where(F.col("_variant") == "rows as they are").select(F.col("average_precision").alias("_base"))
    out = (ap.where(F.col("_variant") != "rows as they are")
           .select(F.substring("_variant", len("permuted ") + 1, 10_000).alias("feature"), "average_precision")
           .crossJoin(base).withColumn("ap_drop", F.col("_base") - F.col("average_precision")).drop("_base"))
    w = Window.orderBy(F.col("ap_drop").desc(), "feature")          # one row per feature: bounded
    return out.withColumn("importance_rank", F.row_number().over(w))


def ablation(train: DataFrame, test: DataFrame, base: Sequence[str], candidates: Sequence[str], kind: str = "logistic",
             label: str = "label") -> DataFrame:
    """AP of the base set, base + each candidate, then base + top-2 and
    top-3 candidates by gain.  All columns are imputed once; the sets of a
    round are fitted in parallel and their scores judged in one pass."""
    cols = [*base, *candidates]
    ready = ExactMedianImputer(inputCols=cols, outputCols=[f"{c}_imp" for c in cols],
                               indicatorCols=[f"{c}_missing" for c in cols]).fit(train)
    pick = lambda d, *more: ready.transform(d).select(
        label, *more, *[f"{c}_{x}" for c in cols for x in ("imp", "missing")])
    fit, held = cut_lineage(pick(add_balanced_weight(train), "w")), cut_lineage(pick(test))

    def judged(sets: Mapping[str, Sequence[str]]) -> DataFrame:
        def one(name) -> DataFrame:
            va = VectorAssembler(inputCols=[*(f"{c}_imp" for c in sets[name]), *(f"{c}_missing" for c in sets[name])],
                                 outputCol="features", handleInvalid="keep")
            model = make_classifier(kind).fit(va.transform(fit))
            return positive_score(model.transform(va.transform(held))).select(F.lit(name).alias("feature_set"), label, "p")
        scores = reduce(DataFrame.unionByName, in_parallel(train.sparkSession, one, sets))
        return cut_lineage(H.curve_metrics(scores, label, "p", ["feature_set"]).select("feature_set", "average_precision"))

    first = judged({"base": list(base)} | {f"base+{c}": [*base, c] for c in candidates})
    res = {r["feature_set"]: r["average_precision"] for r in first.collect()}   # one number per feature set
    gains = sorted(candidates, key=lambda c: (-(res.get(f"base+{c}") or 0), c))
    return first.unionByName(judged({"base+top2": [*base, *gains[:2]], "base+top3": [*base, *gains[:3]]}))
