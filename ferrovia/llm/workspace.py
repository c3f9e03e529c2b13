"""Small helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import shared_dir, stash

__all__ = ["WORD", "count_words", "kept", "release", "shared_dir", "stash", "table"]

#: Characters between words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def count_words(text: Column | str) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


_KEPT: dict[Hashable, object] = {}


def release() -> None:
    """Give memory that a Python worker no longer uses back to the machine: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def kept[T](name: Hashable, make: Callable[[], T]) -> T:
    """What ``make`` gives, once for each Python worker. A worker keeps one such thing: that of the operator it ran last."""
    if name not in _KEPT:
        _KEPT.clear()
        release()
        _KEPT[name] = make()
    return _KEPT[name]
