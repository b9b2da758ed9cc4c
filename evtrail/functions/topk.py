"""Top-k per group.

``row_number() <= k`` lets the planner keep each partition's own k best rows
of a group before the shuffle (a window group limit), so at most
``partitions * k`` rows of a group meet in its window however large the group
is.  Exact, and no salt is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def topk_per_group(df: DataFrame, group_cols: Sequence[str], order: Sequence[Column], k: int,
                   rank_col: str = "rank") -> DataFrame:
    """Keep the first ``k`` rows per group under ``order`` (which must be a
    total order -- add an id tie-break) and number them 1..k."""
    w = Window.partitionBy(*group_cols).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)
