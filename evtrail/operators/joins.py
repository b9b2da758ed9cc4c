"""Join helpers that Spark does not provide directly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unique_right(right: DataFrame, keys: Sequence[str], name: str = "right") -> DataFrame:
    """Right side of a many-to-one join, validated: one aggregate per key
    (partial combine, so a duplicated hot key cannot stall one task) that
    fails the job with ``raise_error`` when a key occurs more than once."""
    others = [c for c in right.columns if c not in keys]
    g = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in others])
    err = F.raise_error(F.concat(F.lit(f"duplicate key in {name}: "),
                                 F.concat_ws("|", *[F.col(k).cast("string") for k in keys])))
    # the check is folded into the first key column, which the join needs,
    # so the optimiser cannot prune it away
    k0 = F.when(F.col("_n") > 1, err).otherwise(F.col(keys[0])).alias(keys[0])
    return g.select(k0, *keys[1:], *others)


def join_many_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left",
                     name: str = "right") -> DataFrame:
    """``left`` join with the right key asserted unique (pandas
    ``validate='many_to_one'``)."""
    return left.join(unique_right(right, keys, name), list(keys), how)
