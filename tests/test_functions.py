import pytest
from pyspark.sql import functions as F

from ferrovia.functions.geo import haversine_m, hourly_frequency, seconds_of_day
from ferrovia.functions.text import indel_ratio, normalize_name, token_sort_ratio


def test_names_lose_prefixes(spark):
    rows = spark.createDataFrame([("Base Metro  Norte",), ("MB Norte",), ("METRO",), ("metro ",), (None,), ("C.C. Metro base mb Sur",)], "n string")
    assert [r[0] for r in rows.select(normalize_name(F.col("n"))).collect()] == ["norte", "norte", "metro", "metro", None, "sur"]


@pytest.mark.parametrize("a, b, want", [("buenavista", "buena vista", 95.24), ("tasqueña", "tasquena", 87.5), ("san lázaro", "san lázaro norte", 76.92), ("", "", 100.0), ("a", "", 0.0)])
def test_indel_ratio(a, b, want):
    assert round(indel_ratio(a, b), 2) == want


def test_token_order_does_not_matter(spark):
    rows = spark.createDataFrame([("norte terminal", "terminal  norte"), (None, "x")], "a string, b string")
    assert [r[0] for r in rows.select(token_sort_ratio(F.col("a"), F.col("b"))).collect()] == [100.0, None]


def test_haversine(spark):
    rows = spark.createDataFrame([(19.4, -99.1, 19.401, -99.1), (19.4, -99.1, 19.402, -99.1), (0.0, 0.0, 0.0, 180.0)], "a double, b double, c double, d double")
    got = [r[0] for r in rows.select(haversine_m(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()]
    assert [round(x, 2) for x in got] == [111.19, 222.39, 20015086.8]


def test_times_pass_midnight(spark):
    rows = spark.createDataFrame([("25:10:00",), ("7:05:09",), ("",), (None,), ("x",)], "t string")
    assert [r[0] for r in rows.select(seconds_of_day(F.col("t"))).collect()] == [90600.0, 25509.0, None, None, None]


def test_zero_headway_has_no_frequency(spark):
    rows = spark.createDataFrame([(180,), (0,), (None,)], "h int")
    assert [r[0] for r in rows.select(hourly_frequency(F.col("h"))).collect()] == [20.0, None, None]
