"""Radius joins of points."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_RADIUS_M, haversine_m

_METRES_A_DEGREE = math.pi * EARTH_RADIUS_M / 180


def radius_pairs(points: DataFrame, key: str, lat: str = "stop_lat", lon: str = "stop_lon", radius_m: float = 150.0) -> DataFrame:
    """(a, b, distance_m) of all pairs a < b of keys at most ``radius_m`` apart.

    Points fall in cells at least a radius high and wide. Only one point of a pair is dealt to the
    cells around its own, so the join is on the cell, and the exact distance decides. Longitudes
    meet at 180 degrees. Rows with a null key or coordinate have no pair.
    """
    known = points.select(F.col(key).alias("k"), F.col(lat).alias("y"), F.col(lon).alias("x")).where("k IS NOT NULL AND y IS NOT NULL AND x IS NOT NULL")
    top = known.agg(F.max(F.abs("y"))).first()[0] or 0.0
    step = radius_m / _METRES_A_DEGREE * (1 + 1e-9)
    # cells of one row are as wide as at its edge nearest to a pole, never more than the circle has
    rows = F.floor(F.col("y") / step)
    wide = min(360.0, step / max(math.cos(math.radians(min(top + step, 90.0))), 1e-9))
    across = max(1, int(360.0 // wide))
    cell = F.pmod(F.floor((F.col("x") + 180.0) / (360.0 / across)), F.lit(across))
    placed = known.withColumns({"row": rows, "cell": cell})
    around = F.array_distinct(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.pmod(F.col("cell") + d, F.lit(across))))
    dealt = placed.withColumn("row", F.explode(F.array(F.col("row") - 1, F.col("row"), F.col("row") + 1))).withColumn("cell", F.explode(around))
    a, b = dealt.alias("p"), placed.alias("q")
    met = a.join(b, (F.col("p.row") == F.col("q.row")) & (F.col("p.cell") == F.col("q.cell")) & (F.col("p.k") < F.col("q.k")))
    apart = haversine_m(F.col("p.y"), F.col("p.x"), F.col("q.y"), F.col("q.x"))
    return met.select(F.col("p.k").alias("a"), F.col("q.k").alias("b"), apart.alias("distance_m")).where(F.col("distance_m") <= radius_m)
