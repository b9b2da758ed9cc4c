"""Lookups by index instead of by comparing everything with everything: texts
that contain a word, and nearest places on the sphere."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evtrail.functions.geo import EARTH_RADIUS_KM, haversine_km
from evtrail.functions.topk import topk_per_group
from evtrail.session import cut_lineage

GRAM = 3
HALF_CIRCLE_KM = math.pi * EARTH_RADIUS_KM


# ----------------------------------------------------------- containment ---

def _grams(text: Column, n: int) -> Column:
    """All substrings of ``n`` characters."""
    places = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.substring(text, i, F.lit(n)))


def contains_pairs(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """(needle, text): distinct texts that contain a distinct needle, case
    as it is.  Texts are indexed by their substrings of up to ``GRAM``
    characters; a needle is looked up by the rarest of its own longest ones,
    and only texts found there are compared.  The empty needle is in every
    text; nulls match nothing."""
    texts = texts.select("text").where(F.col("text").isNotNull()).distinct()
    needles = needles.select("needle").where(F.col("needle").isNotNull()).distinct()
    own = F.array_distinct(F.concat(F.array(F.lit("")), *[_grams(F.col("text"), n) for n in range(1, GRAM + 1)]))
    index = cut_lineage(texts.select("text", F.explode(own).alias("gram")))
    size = F.least(F.length("needle"), F.lit(GRAM))
    asked = F.when(size == 0, F.array(F.lit("")))
    for n in range(1, GRAM + 1):
        asked = asked.when(size == n, _grams(F.col("needle"), n))
    wanted = needles.select("needle", F.explode(F.array_distinct(asked)).alias("gram"))
    known = wanted.join(index.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "gram", "left")
    # a gram that no text has decides as well: it is the rarest
    rarest = known.groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("r")).select(
        "needle", F.col("r.gram").alias("gram"))
    return rarest.join(index, "gram").where(F.col("text").contains(F.col("needle"))).select("needle", "text")


# --------------------------------------------------------------- nearest ---

def _band(lat: Column, step: float) -> Column:
    return F.floor((lat + 90.0) / step).cast("int")


def _cells_around(band: Column, step: float) -> Column:
    """Number of cells of a band: cells are about as wide as they are high
    at the band's edge nearer to the equator."""
    low = F.abs(band * step - 90.0)
    high = F.abs((band + 1) * step - 90.0)
    crosses = (band * step - 90.0 <= 0) & ((band + 1) * step - 90.0 >= 0)
    widest = F.when(crosses, F.lit(1.0)).otherwise(F.cos(F.radians(F.least(low, high))))
    return F.greatest(F.lit(1), F.floor(widest * 360.0 / step).cast("int"))


def _cell(lon: Column, around: Column) -> Column:
    """Cell of a longitude in its band, wrapped at the date line."""
    return F.pmod(F.floor((lon + 180.0) / 360.0 * around).cast("int"), around)


def _covering(lat: Column, lon: Column, radius_km: float, step: float) -> Column:
    """Cells (band, cell) that the circle around a point touches."""
    reach = math.degrees((radius_km * (1 + 1e-9) + 1e-3) / EARTH_RADIUS_KM)
    top = int(180 // step)
    bands = F.sequence(F.greatest(_band(lat - reach, step), F.lit(0)), F.least(_band(lat + reach, step), F.lit(top)))
    over_pole = (lat + reach >= 90.0) | (lat - reach <= -90.0)
    half = F.degrees(F.asin(F.least(F.sin(F.radians(F.lit(min(reach, 90.0)))) / F.cos(F.radians(lat)), F.lit(1.0)))) + 1e-6

    def of_band(band: Column) -> Column:
        around = _cells_around(band, step)
        first = F.floor((lon - half + 180.0) / 360.0 * around).cast("int")
        last = F.floor((lon + half + 180.0) / 360.0 * around).cast("int")
        everything = over_pole | (last - first + 1 >= around)
        cells = F.sequence(F.when(everything, F.lit(0)).otherwise(first),
                           F.when(everything, around - 1).otherwise(last))
        return F.transform(cells, lambda c: F.struct(band.alias("band"), F.pmod(c, around).alias("cell")))
    return F.flatten(F.transform(bands, of_band))


def nearest(points: DataFrame, places: DataFrame, point_key: str, plat: str, plon: str, order: Sequence[Column],
            k: int = 3, on: Sequence[str] = ()) -> DataFrame:
    """The ``k`` nearest ``places`` (lat, lon) of each point by great-circle
    distance, ties by ``order``, among those that agree in the columns ``on``.

    Ring search over grid cells: a circle that should hold some hits is laid
    around each point, and places meet it by an equi-join on the cells it
    touches (a bounded number, also at the poles and the date line).  A point
    with ``k`` hits inside its circle is done, since whatever lies outside is
    farther; the others go on with a circle four times as wide and cells to
    match, until it is the whole sphere.  Points or places without a position
    take no part."""
    places = cut_lineage(places.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()))
    left = cut_lineage(points.where(F.col(plat).isNotNull() & F.col(plon).isNotNull()))
    n = max(1, places.count())
    radius = min(HALF_CIRCLE_KM, max(1.0, 2 * HALF_CIRCLE_KM * math.sqrt(k / n)))
    parts = []
    while True:
        whole = radius >= HALF_CIRCLE_KM
        step = min(180.0, math.degrees(radius / EARTH_RADIUS_KM))
        band = _band(F.col("lat"), step)
        dealt = places.withColumn("_cell", F.struct(band.alias("band"), _cell(F.col("lon"), _cells_around(band, step)).alias("cell")))
        rings = left.withColumn("_cell", F.explode(_covering(F.col(plat), F.col(plon), radius, step)))
        hits = dealt.join(rings, [*on, "_cell"]).drop("_cell").withColumn("distance_km", haversine_km(plat, plon, "lat", "lon"))
        hits = hits if whole else hits.where(F.col("distance_km") <= radius)
        top = cut_lineage(topk_per_group(hits, [point_key], [F.col("distance_km"), *order], k))
        if whole:
            parts.append(top)
            break
        done = top.where(F.col("rank") == k).select(point_key)
        parts.append(top.join(done, point_key, "left_semi"))
        left = cut_lineage(left.join(done, point_key, "left_anti"))
        if left.isEmpty():
            break
        radius = min(HALF_CIRCLE_KM, radius * 4)
    return reduce(DataFrame.unionByName, parts)
