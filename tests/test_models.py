"""Exact imputer stage, distributed isotonic regression, fold scores and stored models."""

import random
import statistics

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from evtrail.functions import prefix
from evtrail.operators import ml_stages as M
from evtrail.operators import models as G
from evtrail.sources.io import scratch_path


def _imputer():
    return M.ExactMedianImputer(inputCols=["a", "b", "c"], outputCols=["a_imp", "b_imp", "c_imp"],
                                indicatorCols=["a_missing", "b_missing", "c_missing"])


def test_imputer_is_exact_and_survives_saving(spark, monkeypatch):
    monkeypatch.setattr(prefix, "ROWS_PER_RANGE", 40)
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 2, 3, 9]), rng.choice([None, float("nan"), rng.random()]), None) for _ in range(301)]
    df = spark.createDataFrame(rows, "a int, b double, c double")
    model = Pipeline(stages=[_imputer()]).fit(df)
    path = scratch_path(spark, "t-imputer")
    model.write().save(path)
    a = statistics.median(r[0] for r in rows if r[0] is not None)
    b = statistics.median(r[1] for r in rows if r[1] is not None and r[1] == r[1])
    want = sorted((float(a if x is None else x), float(x is None), b if y is None or y != y else y,
                   float(y is None or y != y), 0.0, 1.0) for x, y, _ in rows)
    cols = ["a_imp", "a_missing", "b_imp", "b_missing", "c_imp", "c_missing"]
    for m in (model, PipelineModel.load(path)):
        assert sorted(tuple(r) for r in m.transform(df).select(*cols).collect()) == want


def plain_isotonic(points):
    """(score -> fit) by pooling from left to right."""
    by = {}
    for s, y in points:
        by.setdefault(s, []).append(y)
    blocks = []
    for s in sorted(by):
        blocks.append([[s], len(by[s]), sum(by[s])])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][1] >= blocks[-1][2] / blocks[-1][1]:
            s2, w2, t2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s2, blocks[-1][1] + w2, blocks[-1][2] + t2]
    return {s: t / w for ss, w, t in blocks for s in ss}


@pytest.mark.parametrize("shape", ["rising", "falling", "ties"])
def test_isotonic_equals_one_pass(spark, monkeypatch, shape):
    monkeypatch.setattr(prefix, "ROWS_PER_RANGE", 25)
    rng = random.Random(2)
    score = {"rising": lambda: rng.random(), "falling": lambda: rng.random(), "ties": lambda: rng.randint(0, 9) / 10}[shape]
    points = [(s := score(), int(rng.random() < (1 - s if shape == "falling" else s))) for _ in range(600)]
    df = spark.createDataFrame(points, "p double, y int")
    want = plain_isotonic(points)
    steps = M.isotonic_fit(df, "y", "p", merge=3)
    got = M.isotonic_apply(df.union(spark.createDataFrame([(-1.0, 0), (2.0, 0), (None, 1)], "p double, y int")),
                           steps, "p", "fit").collect()
    assert len(got) == 603
    for r in got:
        expect = None if r["p"] is None else want.get(r["p"], min(want.values()) if r["p"] < 0 else max(want.values()))
        assert r["fit"] is None if expect is None else abs(r["fit"] - expect) < 1e-9
    assert M.isotonic_fit(df.limit(0), "y", "p").count() == 0


def _table(spark, n=240):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        x, z = rng.random(), rng.choice([None, 0.0, 1.0])
        rows.append((i, f"e{i % 40}", x, z, int(rng.random() < x)))
    return spark.createDataFrame(rows, "index_id long, entity_id string, x double, z double, label int")


def test_summary_follows_from_the_stored_fold_scores(spark):
    df = _table(spark).withColumn("fold", F.pmod(F.xxhash64("entity_id"), F.lit(3)).cast("int"))
    scores = G.group_fold_scores(df, "fold", ["x", "z"], [], ["logistic"])
    assert scores.count() == df.count()                       # every row held out once
    assert scores.join(df, ["index_id", "fold"], "left_anti").count() == 0
    scores.createOrReplaceTempView("t_scores")
    want = spark.sql("""
      WITH f AS (SELECT fold, 2.0 * sum(int(p >= 0.5) * label) / (sum(int(p >= 0.5)) + sum(label)) AS f1 FROM t_scores GROUP BY fold),
      a AS (SELECT o.fold, avg((SELECT sum(label) / count(*) FROM t_scores t WHERE t.fold = o.fold AND t.p >= o.p)) AS ap
            FROM t_scores o WHERE o.label = 1 GROUP BY o.fold)
      SELECT avg(f1) AS f1, stddev_pop(f1) AS f1_std, avg(ap) AS ap, stddev_pop(ap) AS ap_std FROM f JOIN a USING (fold)""").first()
    got = G.cv_summary(scores).first()
    for name, value in (("f1_mean", want["f1"]), ("f1_std", want["f1_std"]), ("ap_mean", want["ap"]), ("ap_std", want["ap_std"])):
        assert abs(got[name] - float(value)) < 1e-6, name


def test_fold_scores_cover_all_test_rows(spark):
    df = _table(spark)
    folds = df.withColumn("fold", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(
        "role", F.when(F.col("index_id") % 2 == F.col("fold"), "test").otherwise("train"))
    scores = G.fold_scores(folds, ["x", "z"], [], {"a": ("logistic", None), "b": ("logistic", {"regParam": 1.0})})
    assert scores.groupBy("model").count().collect() and scores.count() == 2 * df.count()


def test_stored_model_scores_the_same_and_checks_its_table(spark):
    df = _table(spark)
    model, scored = G.fit_score(df, df, ["x", "z"], [], "logistic")
    path = scratch_path(spark, "t-model")
    G.save_model(model, df, ["x", "z"], path)
    again = G.score_with_stored(spark, path, df)
    pick = lambda d: sorted((r["index_id"], round(r["p"], 12)) for r in d.select("index_id", "p").collect())
    assert pick(again) == pick(scored)
    with pytest.raises(ValueError, match="z: double expected, string found"):
        G.score_with_stored(spark, path, df.withColumn("z", F.col("z").cast("string")))


def test_medians_are_exact_whatever_is_around_them(spark, monkeypatch):
    rng = random.Random(8)
    inf = float("inf")
    cols = {"a": [rng.random() for _ in range(501)], "b": [rng.choice([1.0, 5.0]) for _ in range(500)] + [None],
            "c": [-inf] * 300 + [2.0] * 201, "d": [None] * 501, "e": [None, 4.0, 7.0] + [float("nan")] * 498}
    df = spark.createDataFrame(list(zip(*cols.values())), "a double, b double, c double, d double, e double")
    want = {c: statistics.median(x for x in v if x is not None and x == x) for c, v in cols.items() if c != "d"}
    for accuracy in (10_000, 5):                     # by 5 the values around the median are far from it, and many
        monkeypatch.setattr(M, "ACCURACY", accuracy)
        assert M.exact_medians(df, list(cols)) == want
    assert M.exact_medians(df.limit(0), list(cols)) == {}


@pytest.fixture
def imputed(monkeypatch):
    """The columns of each imputer that is fitted."""
    seen, fit = [], M.ExactMedianImputer._fit
    monkeypatch.setattr(M.ExactMedianImputer, "_fit", lambda self, df: seen.append(self.getInputCols()) or fit(self, df))
    return seen


def test_each_fold_is_prepared_once_for_all_models(spark, imputed):
    df = _table(spark).withColumn("fold", (F.col("index_id") % 3).cast("int"))
    scores = G.group_fold_scores(df, "fold", ["x", "z"], [], ["logistic", "random_forest"])
    assert scores.count() == 2 * df.count() and len(imputed) == 3
    # the scores of a fold are those of a model fitted by itself
    weighted = G.add_balanced_weight(df)
    one = G.build_pipeline(["x", "z"], [], "logistic").fit(weighted.where("fold <> 1")).transform(df.where("fold = 1"))
    own = {r["index_id"]: r["p"] for r in G.positive_score(one).select("index_id", "p").collect()}
    got = scores.where("model = 'logistic' AND fold = 1").collect()
    assert len(got) == len(own) and all(abs(r["p"] - own[r["index_id"]]) < 1e-6 for r in got)
    with pytest.raises(ValueError, match="rows by fold"):
        G.group_fold_scores(df.withColumn("fold", F.when(F.col("index_id") > 9, F.col("fold"))), "fold", ["x"], [], ["logistic"])


def test_ablation_imputes_once_and_scores_as_single_models(spark, imputed):
    df = _table(spark).withColumn("u", F.pmod(F.xxhash64("index_id"), F.lit(9)).cast("double"))
    tr, te = df.where("index_id % 3 > 0"), df.where("index_id % 3 = 0")
    got = {r["feature_set"]: r["average_precision"] for r in G.ablation(tr, te, ["u"], ["x", "z"]).collect()}
    assert len(imputed) == 1 and set(got) == {"base", "base+x", "base+z", "base+top2", "base+top3"}
    for name, cols in (("base", ["u"]), ("base+x", ["u", "x"])):
        _, sc = G.fit_score(tr, te, cols, [], "logistic")
        assert abs(G.score_summary(sc).first()["average_precision"] - got[name]) < 1e-6


def test_permutation_ranks_rows_once_for_all_features(spark, monkeypatch):
    df = _table(spark)
    model, _ = G.fit_score(df, df, ["x", "z"], [], "logistic")
    ranked, rank = [], G.global_rank
    monkeypatch.setattr(G, "global_rank", lambda *a, **k: ranked.append(a[1]) or rank(*a, **k))
    got = {r["feature"]: r for r in G.permutation_importance(model, df, ["x", "z"], "index_id").collect()}
    assert len(ranked) == 2 and sorted(r["importance_rank"] for r in got.values()) == [1, 2]
    base = G.score_summary(G.positive_score(model.transform(df))).first()["average_precision"]
    for f in ("x", "z"):
        moved = G.permute_column(df, f, "index_id")
        ap = G.score_summary(G.positive_score(model.transform(moved))).first()["average_precision"]
        assert abs(got[f]["average_precision"] - ap) < 1e-9 and abs(got[f]["ap_drop"] - (base - ap)) < 1e-9
