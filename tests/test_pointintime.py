"""Boundary semantics of the point-in-time operators, and the sweep /
distinct-in-window operators against brute force."""

import datetime as dt
import random

from pyspark.sql import functions as F

from evtrail.operators import pointintime as pit
from evtrail.plans.model_table import build_model_table

D0 = dt.datetime(2020, 1, 1)


def _ev(spark, rows):
    return spark.createDataFrame([(e, i, D0 + dt.timedelta(days=d, hours=h), c, cost)
                                  for e, i, d, h, c, cost in rows],
                                 "entity_id long, event_id long, ts timestamp, cls string, cost double")


def test_window_boundaries_and_labels(spark):
    rows = [
        # entity 1: index at day 400 (two emergencies that day), history at exactly 30/90/365 days before
        (1, 1, 400, 9, "emergency", 10.0), (1, 2, 400, 11, "emergency", 10.0),
        (1, 3, 370, 0, "emergency", 1.0),   # exactly 30 days before -> inside [d-30, d)
        (1, 4, 310, 0, "inpatient", 2.0),   # exactly 90 days before -> inside 90, outside 30
        (1, 5, 35, 0, "outpatient", 4.0),   # exactly 365 days before -> inside 365
        (1, 6, 34, 0, "outpatient", 8.0),   # 366 days before -> outside
        (1, 7, 490, 0, "emergency", 0.0),   # exactly +90 -> label 1
        # entity 2: repeat at +91 only -> label 0
        (2, 10, 100, 0, "emergency", 0.0), (2, 11, 191, 0, "emergency", 0.0),
        # far-future event to keep follow-up uncensored
        (3, 20, 1000, 0, "wellness", 0.0),
    ]
    enc = _ev(spark, rows)
    mt = {r["index_id"]: r for r in build_model_table(enc).collect()}
    r = mt[1]                                   # first event of the day by (ts, id)
    assert r["n_emergency_30d"] == 1 and r["n_emergency_90d"] == 1 and r["n_emergency_365d"] == 1
    assert r["n_inpatient_30d"] == 0 and r["n_inpatient_90d"] == 1
    assert r["n_outpatient_365d"] == 1
    assert abs(r["cost_365d"] - 7.0) < 1e-9
    assert r["days_since_prev_visit"] == 30 and r["days_since_prev_emergency"] == 30
    assert r["label"] == 1
    assert 2 not in mt                          # same-day second emergency collapsed
    assert mt[10]["label"] == 0
    assert mt[10]["days_since_prev_visit"] is None


def test_censoring(spark):
    enc = _ev(spark, [(1, 1, 10, 0, "emergency", 0.0), (1, 2, 95, 0, "wellness", 0.0)])
    assert build_model_table(enc).count() == 0               # 10 + 90 > 95
    assert build_model_table(enc, censor=False).count() == 1


def test_future_rows_do_not_change_features(spark):
    base = [(1, 1, 100, 0, "emergency", 5.0), (1, 2, 80, 0, "emergency", 5.0), (9, 9, 1000, 0, "wellness", 0.0)]
    a = build_model_table(_ev(spark, base)).where("index_id = 1").drop("label").collect()[0]
    b = build_model_table(_ev(spark, base + [(1, 3, 101, 0, "inpatient", 99.0)])).where("index_id = 1") \
        .drop("label").collect()[0]
    assert a == b


def _brute_active(intervals, queries, mode):
    out = {}
    for qid, e, t in queries:
        n = 0
        for e2, s, stop in intervals:
            if e2 != e or s is None:
                continue
            if mode == "v1":
                ok = s < t and (stop is None or stop >= t)
            else:
                ok = s <= t and (stop is None or stop > t)
            n += ok
        out[qid] = n
    return out


def test_active_at_matches_brute_force(spark):
    rnd = random.Random(3)
    ivs = []
    for _ in range(300):
        e = rnd.randint(1, 5)
        s = D0 + dt.timedelta(days=rnd.randint(0, 60))
        stop = None if rnd.random() < 0.3 else s + dt.timedelta(days=rnd.randint(-2, 20))
        ivs.append((e, s, stop))
    qs = [(i, rnd.randint(1, 5), D0 + dt.timedelta(days=rnd.randint(0, 70))) for i in range(200)]
    qs += [(1000 + i, e, s) for i, (e, s, _) in enumerate(ivs[:30])]          # exactly on a START
    qs += [(2000 + i, e, st) for i, (e, _, st) in enumerate(ivs[:60]) if st]   # exactly on a STOP
    idf = spark.createDataFrame(ivs, "entity_id long, start_ts timestamp, stop_ts timestamp")
    qdf = spark.createDataFrame(qs, "qid long, entity_id long, t timestamp")
    for mode in ("v1", "context"):
        got = {r["qid"]: (r["active"] or 0) for r in
               pit.active_at(idf, qdf, "entity_id", "start_ts", "stop_ts", "t", "active", mode=mode).collect()}
        assert got == _brute_active(ivs, qs, mode), mode


def test_distinct_in_window_matches_brute_force(spark):
    rnd = random.Random(5)
    ev = [(rnd.randint(1, 3), rnd.randint(0, 400), rnd.choice(["a", "b", "c", "d", None])) for _ in range(400)]
    qs = [(i, rnd.randint(1, 3), rnd.randint(0, 420)) for i in range(150)]
    edf = spark.createDataFrame(ev, "entity_id long, day long, provider string")
    qdf = spark.createDataFrame(qs, "qid long, entity_id long, day long")
    for w in (30, 365, None):
        got = {r["qid"]: (r["n"] or 0) for r in
               pit.distinct_in_window(edf, qdf, "entity_id", "day", "provider", w, "n").collect()}
        exp = {}
        for qid, e, d in qs:
            lo = -10 ** 9 if w is None else d - w
            exp[qid] = len({p for e2, d2, p in ev if e2 == e and p is not None and lo <= d2 < d})
        assert got == exp, w


def test_gap_label_same_day(spark):
    enc = _ev(spark, [(1, 1, 10, 8, "emergency", 0.0), (1, 2, 10, 9, "emergency", 0.0), (1, 3, 40, 0, "emergency", 0.0)])
    g = {r["event_id"]: (r["gap_days"], r["label_gap"]) for r in
         pit.gap_to_next_label(enc, "entity_id", "ts", "event_id").collect()}
    assert g[1] == (0, 0) and g[2] == (30, 1) and g[3][1] == 0


def test_asof_strictly_before(spark):
    left = spark.createDataFrame([(1, 10), (1, 20), (2, 5)], "entity_id long, day long")
    right = spark.createDataFrame([(1, 10, 3, 1), (1, 15, 7, 1), (1, 15, 9, 2)],
                                  "entity_id long, day long, los long, o long")
    got = {(r["entity_id"], r["day"]): r["v"] for r in
           pit.asof_last_before(left, right, "entity_id", "day", "los", "o", "v").collect()}
    assert got[(1, 10)] is None and got[(1, 20)] == 9 and got[(2, 5)] is None
    assert F is not None
