"""Distributed helpers (bucketed prefix sums, exact quantiles, global rank,
top-k) and evaluation metrics against brute-force references."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from evtrail.functions.prefix import exact_quantiles, global_rank, grouped_prefix_sums
from evtrail.functions.topk import topk_per_group
from evtrail.operators import evaluation as H


def test_prefix_sums(spark):
    rnd = random.Random(1)
    rows = [(g, float(k), rnd.randint(0, 5)) for g in range(3) for k in rnd.sample(range(1000), 200)]
    df = spark.createDataFrame(rows, "g int, k double, v long")
    got = {(r["g"], r["k"]): r["v_cum"] for r in grouped_prefix_sums(df, "k", ["v"], ["g"]).collect()}
    for g in range(3):
        run = 0
        for _, k, v in sorted([r for r in rows if r[0] == g], key=lambda r: r[1]):
            run += v
            assert got[(g, k)] == run
    got_d = {r["k"]: r["v_cum"] for r in grouped_prefix_sums(df.where("g = 0"), "k", ["v"], descending=True).collect()}
    tot = 0
    for _, k, v in sorted([r for r in rows if r[0] == 0], key=lambda r: -r[1]):
        tot += v
        assert got_d[k] == tot


def test_exact_quantiles(spark):
    vals = [float(x) for x in np.random.default_rng(0).integers(0, 50, 301)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.8, 0.99, 1.0]
    got = {r["prob"]: r["q"] for r in exact_quantiles(df, "x", probs).collect()}
    for p in probs:
        assert abs(got[p] - float(np.percentile(vals, p * 100))) < 1e-9


def test_global_rank_and_topk(spark):
    rows = [(i % 4, (i * 7919) % 101, i) for i in range(500)]
    df = spark.createDataFrame(rows, "g int, s long, id long")
    r = {x["id"]: x["rank"] for x in global_rank(df, "s", ["id"]).collect()}
    order = sorted(rows, key=lambda t: (t[1], t[2]))
    assert all(r[t[2]] == i + 1 for i, t in enumerate(order))
    top = topk_per_group(df, ["g"], [F.col("s").desc(), F.col("id")], 3).collect()
    for g in range(4):
        exp = sorted([t for t in rows if t[0] == g], key=lambda t: (-t[1], t[2]))[:3]
        got = sorted([(x["rank"], x["id"]) for x in top if x["g"] == g])
        assert [i for _, i in got] == [t[2] for t in exp]


def test_ranks_of_ties_prefixes_and_wide_characters(spark, monkeypatch):
    from evtrail.functions import prefix
    monkeypatch.setattr(prefix, "ROWS_PER_RANGE", 100)          # many ranges
    same = spark.createDataFrame([(7, i) for i in range(900)], "day int, id long")
    got = {r["id"]: r["rank"] for r in global_rank(same, "day", ["id"]).collect()}
    assert got == {i: i + 1 for i in range(900)}
    cut = same.repartitionByRange(prefix._ranges(same, 900), F.col("day"), F.col("id"))
    assert cut.withColumn("b", F.spark_partition_id()).groupBy("b").count().agg(F.max("count")).first()[0] < 300
    names = ["Supplier#%06d" % i for i in range(300)] + ["b", "a\U0001F600", "a", "a\uFFFF", "", "zz"]
    df = spark.createDataFrame([(n,) for n in names], "v string")
    got = {r["v"]: r["rank"] for r in global_rank(df, "v", []).collect()}
    assert got == {n: i + 1 for i, n in enumerate(sorted(names, key=lambda n: n.encode()))}
    groups = spark.createDataFrame([(g, i) for g in ("hot", None, "x") for i in range(400 if g == "hot" else 3)],
                                   "g string, s long")
    got = {(r["g"], r["s"]): r["rank"] for r in global_rank(groups, "s", [], group_cols=["g"]).collect()}
    assert got == {(g, i): i + 1 for g in ("hot", None, "x") for i in range(400 if g == "hot" else 3)}


def _auc_ap(y, p):
    pos = [s for s, t in zip(p, y) if t == 1]
    neg = [s for s, t in zip(p, y) if t == 0]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    ap = np.mean([sum(1 for s, t in zip(p, y) if s >= a and t == 1) / sum(1 for s in p if s >= a) for a in pos])
    return auc, ap


def test_auc_ap_with_ties(spark):
    rnd = random.Random(7)
    y = [rnd.randint(0, 1) for _ in range(300)]
    p = [round(rnd.random() * (0.6 + 0.3 * t), 1) for t in y]      # heavy ties
    df = spark.createDataFrame(list(zip(y, p)), "y int, p double")
    m = H.curve_metrics(df, "y", "p").first()
    auc, ap = _auc_ap(y, p)
    assert abs(m["roc_auc"] - auc) < 1e-12 and abs(m["average_precision"] - ap) < 1e-12


def test_threshold_sweep_matches_direct(spark):
    rnd = random.Random(9)
    rows = [(rnd.randint(0, 1), round(rnd.random(), 3)) for _ in range(400)]
    df = spark.createDataFrame(rows, "y int, p double")
    ts = [0.1, 0.25, 0.5, 0.75, 0.9]
    sw = {r["threshold"]: r for r in H.threshold_sweep(df, "y", "p", ts).collect()}
    for t in ts:
        tp = sum(1 for y, p in rows if p >= t and y == 1)
        fp = sum(1 for y, p in rows if p >= t and y == 0)
        assert sw[t]["tp"] == tp and sw[t]["fp"] == fp
        assert sw[t]["tn"] + sw[t]["fn"] + tp + fp == len(rows)


def test_single_class_group_has_null_auc(spark):
    df = spark.createDataFrame([("a", 1, 0.3), ("a", 1, 0.5), ("b", 0, 0.1), ("b", 1, 0.9)], "g string, y int, p double")
    m = {r["g"]: r["roc_auc"] for r in H.curve_metrics(df, "y", "p", ["g"]).collect()}
    assert m["a"] is None and m["b"] == 1.0


def test_bootstrap_ci_brackets_point(spark):
    rnd = random.Random(11)
    rows = [(i, rnd.randint(0, 1), rnd.random()) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, y int, p double")
    ci = {r["metric"]: r for r in H.bootstrap_ci(df, "y", "p", "id", 0.5, n_boot=30, with_ap=False).collect()}
    for m in ("precision", "recall", "f1"):
        assert ci[m]["ci_low"] <= ci[m]["point"] + 0.05 and ci[m]["ci_high"] >= ci[m]["point"] - 0.05
        assert ci[m]["n_boot"] == 30


def test_bootstrap_draws_weights_once_and_deals_them(spark):
    rows = [(i, int(i % 3 == 0), (i * 7 % 10) / 10) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, y int, p double").coalesce(1)
    out = H.bootstrap_ci(df, "y", "p", "id", 0.5, n_boot=20)
    assert "md5" not in out._jdf.queryExecution().toString()           # no draw is left to be made a second time
    cdf = H.poisson1_cdf()

    def weight(i, b):
        u = int(hashlib.md5(f"42:{i}:{b}".encode()).hexdigest()[:8], 16) / 2 ** 32
        return sum(c <= u for c in cdf)

    recalls, aps = [], []
    for b in range(20):
        drawn = [(weight(i, b), y, p) for i, y, p in rows]
        total = sum(w for w, y, _ in drawn if y)
        recalls.append(sum(w for w, y, p in drawn if y and p >= 0.5) / total)
        above = lambda s, all_: sum(w for w, y, p in drawn if p >= s and (y or all_))
        aps.append(sum(w * above(p, False) / above(p, True) for w, y, p in drawn if y and w) / total)
    got = {r["metric"]: r for r in out.collect()}
    for name, values in (("recall", recalls), ("average_precision", aps)):
        low, high = np.percentile(values, [2.5, 97.5])
        assert abs(got[name]["ci_low"] - low) < 1e-9 and abs(got[name]["ci_high"] - high) < 1e-9
        assert got[name]["n_boot"] == 20
