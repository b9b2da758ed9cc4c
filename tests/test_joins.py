"""Validated many-to-one joins fail on duplicate right keys."""

import pytest

from evtrail.operators.joins import join_many_to_one


def test_many_to_one_ok_and_duplicate(spark):
    left = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    ok = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    got = sorted((r["k"], r["v"]) for r in join_many_to_one(left, ok, ["k"]).collect())
    assert got == [(1, "a"), (2, "b"), (3, None)]
    dup = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Exception, match="duplicate key"):
        join_many_to_one(left, dup, ["k"]).collect()
