"""Stop names: normal form and similarity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: What a name may begin with besides its own words.
NAME_PREFIXES = ("c. c. metro ", "c.c. metro ", "cetram metro ", "base metro ", "base cetram ", "mb ", "metro ", "base ", "cetram ")

_PREFIXES = "^(?:(?:" + "|".join(p.replace(".", r"\.") for p in NAME_PREFIXES) + r")\s*)+"


def normalize_name(name: Column) -> Column:
    """Trimmed, lower case, without any prefix that it starts with. Null stays null."""
    return F.regexp_replace(F.lower(F.trim(name)), _PREFIXES, "")


def sorted_tokens(name: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(name, r"\s+"), lambda t: t != "")), " ")


def indel_ratio(a: str, b: str) -> float:
    """100 * 2 * LCS / (len a + len b); 100 for two empty strings.

    The longest common subsequence comes bit-parallel: a zero bit of ``row`` is a place of ``b`` where it grows.
    """
    if not a and not b:
        return 100.0
    places: dict[str, int] = {}
    for k, y in enumerate(b):
        places[y] = places.get(y, 0) | 1 << k
    whole = (1 << len(b)) - 1
    row = whole
    for x in a:
        met = row & places.get(x, 0)
        row = (row + met | row - met) & whole
    return 200.0 * (len(b) - row.bit_count()) / (len(a) + len(b))


@F.pandas_udf(DoubleType())
def _indel(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else indel_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def token_sort_ratio(a: Column, b: Column) -> Column:
    """Similarity from 0 to 100 of two names whatever the order of their words."""
    return _indel(sorted_tokens(a), sorted_tokens(b))


def highest_ratio(a: Column, b: Column) -> Column:
    """What the similarity of two names can't exceed, by their lengths alone."""
    n, m = (F.length(sorted_tokens(x)) for x in (a, b))
    return F.when(n + m == 0, 100.0).otherwise(200.0 * F.least(n, m) / (n + m))


def shorten(text: Column, width: int = 43) -> Column:
    """The first ``width`` characters, with three dots after them if there were more."""
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))).otherwise(text)
