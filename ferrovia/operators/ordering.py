"""Places and ranks in a total order, without one task that sorts everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import stash


def _free(df: DataFrame, name: str) -> str:
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def placed(df: DataFrame, *order: Column, name: str, ranks: bool = False) -> DataFrame:
    """``df`` with the place of each row in the order, from 0; with ``ranks`` equal rows share the first one's place.

    Rows are dealt into ranges of the order, which equal rows share, each range is numbered on its
    own, and the ranges' sizes, a row for each, are added up. No rows give no rows.
    """
    part = _free(df, "part")
    ranged = stash(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranges")
    before, so_far = [], 0
    for r in ranged.groupBy(part).agg(F.count("*").alias("n")).orderBy(part).collect():  # as many as partitions
        before.append((r[part], so_far))
        so_far += r["n"]
    start = _free(df, "start")
    starts = df.sparkSession.createDataFrame(before, f"{part} int, {start} long")
    own = (F.rank() if ranks else F.row_number()).over(Window.partitionBy(part).orderBy(*order))
    return ranged.join(F.broadcast(starts), part).withColumn(name, own - 1 + F.col(start)).drop(part, start)
