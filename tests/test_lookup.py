"""Index lookups against brute force."""

import math
import random

from pyspark.sql import functions as F

from evtrail.operators import lookup as X


def test_contains_pairs(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choices("abcé ", k=n))
    texts = [word(rng.randint(0, 14)) for _ in range(150)] + [None, ""]
    needles = [word(rng.randint(0, 5)) for _ in range(60)] + [None, "", "zzz", "abc"]
    got = X.contains_pairs(spark.createDataFrame([(n,) for n in needles], "needle string"),
                           spark.createDataFrame([(t,) for t in texts], "text string"))
    want = {(n, t) for n in needles for t in texts if n is not None and t is not None and n in t}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def _km(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def test_nearest_at_poles_and_date_line(spark):
    rng = random.Random(2)
    places = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180), i % 3, "a" if i % 10 else "b") for i in range(700)]
    places += [(800, 89.9, 10.0, 0, "a"), (801, 89.9, -170.0, 0, "a"), (802, 0.0, 179.9, 0, "a"), (803, 0.0, -179.9, 1, "a"),
               (804, 0.0, -179.9, 5, "a"), (805, -90.0, 0.0, 0, "a"), (806, 90.0, 77.0, 0, "a"), (807, None, 1.0, 0, "a"),
               (808, 0.0, 180.0, 0, "a"), (809, 0.0, -180.0, 0, "a")]
    points = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180), "ab"[i % 2]) for i in range(60)]
    points += [(100, 90.0, 0.0, "a"), (101, -90.0, 50.0, "a"), (102, 0.0, 180.0, "a"), (103, 0.0, -180.0, "a"),
               (104, 89.95, 100.0, "a"), (105, 0.0, 0.0, "none"), (106, None, 0.0, "a"), (107, -89.0, 179.99, "b")]
    p = spark.createDataFrame(points, "point long, plat double, plon double, kind string")
    q = spark.createDataFrame(places, "id long, lat double, lon double, use long, kind string")
    for k, on in ((3, ()), (5, ("kind",)), (90, ("kind",))):
        got = X.nearest(p if on else p.drop("kind"), q, "point", "plat", "plon", [F.col("use").desc(), F.col("id")], k, on)
        rows = {(r["point"], r["rank"]): r["id"] for r in got.collect()}
        want = {}
        for i, a, b, kind in points:
            if a is None:
                continue
            near = sorted((_km(a, b, c, d), -u, j) for j, c, d, u, other in places if c is not None and (not on or kind == other))
            want |= {(i, r): x for r, x in enumerate(near[:k], 1)}
        assert rows.keys() == want.keys()
        for key, found in rows.items():                  # equal up to rounding of equal distances
            _, c, d, _, _ = next(x for x in places if x[0] == found)
            a, b = next((x[1], x[2]) for x in points if x[0] == key[0])
            assert found == want[key][2] or abs(_km(a, b, c, d) - want[key][0]) < 1e-6
    assert X.nearest(p.drop("kind"), q.limit(0), "point", "plat", "plon", [F.col("id")]).count() == 0
