"""Stages and fits that Spark ML lacks in a form that stays off the driver:
an exact median imputer as a pipeline stage, and isotonic regression by
pooling inside score ranges."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evtrail.functions.prefix import _ranges, exact_quantiles, running_state
from evtrail.session import cut_lineage


# ------------------------------------------------------------ imputer -----

def _present(col: str) -> Column:
    """The value as a double; null and NaN are missing."""
    v = F.col(col).cast("double")
    return F.when(~F.isnan(v), v)


ACCURACY = 10_000         # of the approximate quantiles around a median


def exact_medians(df: DataFrame, cols: list[str]) -> dict[str, float]:
    """Exact median (linear interpolation) of each column that has a value.

    One aggregation of all columns finds, by approximate quantiles, two values
    around each median; a second one counts the values below and each value
    between them, about ``4 / ACCURACY`` of the rows, where the middle ranks
    are found.  Should a rank lie outside, the column is counted whole."""
    around = [0.5 - 2 / ACCURACY, 0.5 + 2 / ACCURACY]
    found = df.agg(*[x for i, c in enumerate(cols) for x in (
        F.count(_present(c)).alias(f"n{i}"), F.percentile_approx(_present(c), around, ACCURACY).alias(f"q{i}"))]).first()
    used = {i: (found[f"n{i}"], *found[f"q{i}"]) for i in range(len(cols)) if found[f"n{i}"]}
    if not used:
        return {}
    below = F.lit(float("-inf"))
    marks = [F.struct(F.lit(i).alias("i"), F.when(_present(cols[i]) < lo, below).when(_present(cols[i]) <= hi, _present(cols[i]))
                      .alias("v")) for i, (_, lo, hi) in used.items()]
    counts = (df.select(F.explode(F.array(*marks)).alias("x")).select("x.*").where(F.col("v").isNotNull())
              .groupBy("i", "v").agg(F.count(F.lit(1)).alias("n")))
    upto = F.sum("n").over(Window.partitionBy("i").orderBy("v"))           # the values around one median
    ranks = F.create_map(*[x for i, (n, *_) in used.items() for x in (F.lit(i), F.lit((n - 1) // 2))])
    first = F.try_element_at(ranks, F.col("i"))
    odd = F.create_map(*[x for i, (n, *_) in used.items() for x in (F.lit(i), F.lit(n // 2))])
    last = F.try_element_at(odd, F.col("i"))
    hits = (counts.select("i", "v", "n", upto.alias("upto"))
            .where((F.col("upto") > first) & (F.col("upto") - F.col("n") <= last))
            .select("i", "v", (F.col("upto") - F.col("n")).alias("lo"), "upto").collect())      # two rows a column at most
    out = {}
    for i, (n, lo, _) in used.items():
        at = {r: x["v"] for x in hits if x["i"] == i for r in ((n - 1) // 2, n // 2) if x["lo"] <= r < x["upto"]}
        if len(at) < len({(n - 1) // 2, n // 2}) or (lo > float("-inf") and float("-inf") in at.values()):
            out[cols[i]] = float(exact_quantiles(df.select(_present(cols[i]).alias("v")), "v", [0.5], name="m").first()["m"])
        else:
            a, b = at[(n - 1) // 2], at[n // 2]
            out[cols[i]] = a if a == b else a + 0.5 * (b - a)
    return out


class _ImputerParams(HasInputCols, HasOutputCols):
    indicatorCols = Param(Params._dummy(), "indicatorCols", "1 where the input is missing", TypeConverters.toListString)

    def getIndicatorCols(self) -> list[str]:
        return self.getOrDefault(self.indicatorCols)


class ExactMedianImputer(Estimator, _ImputerParams, DefaultParamsReadable, DefaultParamsWritable):
    """Median imputation (linear interpolation, exact) with a missing
    indicator per column.

    The median is the value at the middle ranks of :func:`exact_medians`; the
    driver sees one number per column.  A column without any value has median
    0."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, indicatorCols=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> ExactMedianImputerModel:
        cols = self.getInputCols()
        medians = exact_medians(dataset, cols)
        model = ExactMedianImputerModel(medians=json.dumps([medians.get(c, 0.0) for c in cols]))
        return self._copyValues(model)


class ExactMedianImputerModel(Model, _ImputerParams, DefaultParamsReadable, DefaultParamsWritable):
    """The fitted medians, kept as a parameter so that the stage is saved and
    loaded with its pipeline."""

    medians = Param(Params._dummy(), "medians", "median of each input column, as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, medians=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        values = json.loads(self.getOrDefault(self.medians))
        filled = {o: F.coalesce(_present(c), F.lit(m)) for c, o, m in zip(self.getInputCols(), self.getOutputCols(), values)}
        missing = {o: _present(c).isNull().cast("double") for c, o in zip(self.getInputCols(), self.getIndicatorCols())}
        return dataset.withColumns(filled | missing)


# ----------------------------------------------------------- isotonic -----

def _pool(blocks: pd.DataFrame) -> pd.DataFrame:
    """Adjacent violators of blocks ordered by ``lo``, pooled."""
    blocks = blocks.sort_values("lo", ignore_index=True)
    stack: list[list[float]] = []
    for lo, hi, w, wy in blocks[["lo", "hi", "w", "wy"]].itertuples(index=False):
        stack.append([lo, hi, w, wy])
        while len(stack) > 1 and stack[-2][3] * stack[-1][2] >= stack[-1][3] * stack[-2][2]:
            _, hi_, w_, wy_ = stack.pop()
            top = stack[-1]
            top[1], top[2], top[3] = hi_, top[2] + w_, top[3] + wy_
    out = pd.DataFrame(stack, columns=["lo", "hi", "w", "wy"], dtype=float)
    out.insert(0, "b", np.int64(blocks["b"].iloc[0]))
    return out


def isotonic_fit(df: DataFrame, label: str, score: str, weight: str | None = None, merge: int = 16) -> DataFrame:
    """Non-decreasing least-squares fit of ``label`` over ``score``: one row
    per step (lo, hi, w, value).

    Rows are added up per distinct score, the scores dealt into ranges, and
    adjacent violators pooled inside each range; then ``merge`` neighbouring
    ranges at a time are pooled together, until one is left.  Pooling may go
    in any order, so the result is that of one pass over all scores.  What is
    left of a range is its steps; no row and no step passes through the
    driver.  Null scores and labels take no part."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    points = (df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
              .groupBy(F.col(score).cast("double").alias("lo"))
              .agg(F.sum(w).alias("w"), F.sum(w * F.col(label)).alias("wy")))
    base = cut_lineage(points)
    ranges = _ranges(df, base.count())
    schema = "b long, lo double, hi double, w double, wy double"
    steps = (base.repartitionByRange(ranges, "lo")
             .select(F.spark_partition_id().cast("long").alias("b"), "lo", F.col("lo").alias("hi"), "w", "wy"))
    while True:
        steps = cut_lineage(steps.groupBy("b").applyInPandas(_pool, schema))
        if ranges <= 1:
            break
        ranges = -(-ranges // merge)
        steps = steps.withColumn("b", F.floor(F.col("b") / merge).cast("long"))
    return steps.select("lo", "hi", "w", (F.col("wy") / F.col("w")).alias("value"))


def isotonic_apply(df: DataFrame, steps: DataFrame, score: str, name: str) -> DataFrame:
    """Add ``name``: the value of the last step that begins at or below the
    score (the first step's below all of them).  Steps and rows are put in one
    order and the value runs on over ranges, so neither side is broadcast."""
    cols = df.columns
    marks = steps.select(F.col("lo").alias("__s"), F.lit(0).alias("__k"), F.col("value").alias("__v"),
                         *[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in cols])
    rows = df.select(F.col(score).cast("double").alias("__s"), F.lit(1).alias("__k"),
                     F.lit(None).cast("double").alias("__v"), *cols)
    # rows of one score carry nothing on, so their order among each other is free
    ran = running_state(marks.unionByName(rows), [], ["__s", "__k"], ["__v"])
    least = steps.agg(F.min("value").alias("__least"))
    return (ran.where(F.col("__k") == 1).crossJoin(F.broadcast(least))
            .select(*cols, F.when(F.col(score).isNotNull(), F.coalesce("__v", "__least")).alias(name)))
