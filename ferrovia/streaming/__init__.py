"""Checks on tables that grow: the row checks of a feed as streaming queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def failing_rows(stream: DataFrame, rule: Column, name: str) -> DataFrame:
    """Rows that break ``rule``, as they come; unknown counts as broken."""
    return stream.where(~F.coalesce(rule, F.lit(False))).withColumn("broken_rule", F.lit(name))


def fault_counts(stream: DataFrame, time: str, rule: Column, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Rows and faults by window of event time; rows later than ``late`` are left out."""
    bad = F.count_if(~F.coalesce(rule, F.lit(False)))
    return stream.withWatermark(time, late).groupBy(F.window(time, window)).agg(F.count("*").alias("n"), bad.alias("n_bad"))
