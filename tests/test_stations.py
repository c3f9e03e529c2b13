import math
import random

import pytest

from pyspark.sql import functions as F

from ferrovia.operators import spatial, stations
from ferrovia.operators.components import connected_components
from ferrovia.operators.ordering import placed
from ferrovia.operators.stats import rank_of, ranked

STOPS = "stop_id string, stop_name string, stop_lat double, stop_lon double, stop_ordinal long"


def test_components_against_union_find(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(40)] + [(200, 201 + k) for k in range(30)] + [(7, None)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    want = {}
    for x in list(root):
        want.setdefault(find(x), set()).add(x)
    want = {v: min(g) for g in want.values() for v in g}
    for limit in (None, 0):
        got = connected_components(spark.createDataFrame(pairs, "a long, b long"), one_task=limit)
        assert {r["node"]: r["component"] for r in got.collect()} == want
        assert connected_components(spark.createDataFrame([], "a long, b long"), one_task=limit).count() == 0
    got = connected_components(spark.createDataFrame([("b", "a"), ("c", "b"), (None, "c"), ("z", "z")], "x string, y string"), "x", "y")
    assert sorted(tuple(r) for r in got.collect()) == [("a", "a"), ("b", "a"), ("c", "a")]


def test_places_and_ranks(spark):
    rows = [(k % 7 if k % 11 else None, k) for k in range(200)]
    df = spark.createDataFrame(rows, "x int, part int").repartition(5)
    got = placed(df, F.col("x").desc_nulls_last(), F.col("part"), name="at")
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert sorted((r["at"], r["x"], r["part"]) for r in got.collect()) == [(k, *r) for k, r in enumerate(order)]
    ranks = {(r["x"], r["rank"]) for r in ranked(df, "x").collect()}
    assert ranks == {(x, 1 + sum(y is not None and (x is None or y > x) for y, _ in rows)) for x, _ in rows}
    assert placed(df.limit(0), F.col("x"), name="at").count() == 0
    values = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 3.0), ("d", None)], "node_id string, v double")
    assert [tuple(r) for r in rank_of(values, "v", ["c", "a", "d", "q"]).collect()] == [("c", 3.0, 1), ("a", 1.0, 3), ("d", None, None), ("q", None, None)]


def test_stops_of_one_place(spark):
    """Unnamed or unplaced stops never stand for one another; equal ones do."""
    rows = [("a", "Sur", 19.4, -99.1, 0), ("b", "Sur", 19.4, -99.1, 1), ("c", None, 19.4, -99.1, 2), ("d", None, 19.4, -99.1, 3), ("e", "Sur", None, -99.1, 4), ("f", "Sur", None, -99.1, 5), ("g", "metro sur", 19.4, -99.1, 6)]
    got = {r["stop_id"]: r["station_id"] for r in stations.build_crosswalk(spark.createDataFrame(rows, STOPS)).collect()}
    assert got == {"a": "station_0_0", "b": "station_0_0", "g": "station_0_0", "c": "station_0_1", "d": "station_0_2", "e": "station_1_0", "f": "station_2_0"}


@pytest.mark.parametrize("y, x", [(19.4, -99.1), (0.0, 179.9995), (85.0, 10.0), (-60.0, 0.0)])
def test_radius_pairs_against_all_pairs(spark, y, x):
    rng = random.Random(3)
    wide = 1 / math.cos(math.radians(y))
    pts = [(k, y + rng.uniform(-0.003, 0.003), (x + rng.uniform(-0.003, 0.003) * wide + 180) % 360 - 180) for k in range(120)]

    def far(p, q):
        a, b = math.radians(p[1]), math.radians(q[1])
        h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(q[2] - p[2]) / 2) ** 2
        return 2 * 6371000 * math.asin(math.sqrt(min(1, h)))

    want = {(p[0], q[0]) for p in pts for q in pts if p[0] < q[0] and far(p, q) <= 150}
    got = spatial.radius_pairs(spark.createDataFrame(pts, "k long, stop_lat double, stop_lon double"), "k").collect()
    assert want and sorted((r["a"], r["b"]) for r in got) == sorted(want)


def test_chains_and_numbers(spark):
    rows = [("c", "Metro Norte", 19.4, -99.1, 0), ("d", "Sur", 19.401, -99.1, 1), ("e", "MB Norte", 19.402, -99.1, 2), ("x", "Lejos", 10.0, -99.1, 3), ("y", "norte", 19.4005, -99.1, 4)]
    got = {r["stop_id"]: r["station_id"] for r in stations.build_crosswalk(spark.createDataFrame(rows, STOPS)).collect()}
    # c and e are named alike but 222 m apart; y is within reach of c only
    assert got == {"c": "station_0_0", "d": "station_0_1", "e": "station_0_2", "x": "station_1_0", "y": "station_0_0"}


def test_overrides(spark):
    cw = spark.createDataFrame([("a", "A", "station_0_0", 0), ("b", "B", "station_1_0", 1)], "stop_id string, stop_name string, station_id string, geo_cluster int")
    twice = spark.createDataFrame([("a", "merge_into", "station_9_0", ""), ("a", "merge_into", "station_9_0", "again")], "stop_id string, action string, target_station_id string, note string")
    assert {r["stop_id"]: r["station_id"] for r in stations.apply_overrides(cw, twice).collect()} == {"a": "station_9_0", "b": "station_1_0"}
    assert stations.unknown_targets(cw, twice).count() == 2
    clash = spark.createDataFrame([("a", "m", "x", ""), ("a", "m", "y", "")], twice.schema)
    with pytest.raises(ValueError, match="several override targets"):
        stations.apply_overrides(cw, clash)


def test_candidates(spark):
    cw = spark.createDataFrame([("a", "A", "s0", 0), ("b", "B", "s1", 0), ("c", "C", "s2", 1)], "stop_id string, stop_name string, station_id string, geo_cluster int")
    served = spark.createDataFrame([("a", "M"), ("b", "R"), ("c", "M")], "stop_id string, agency_id string")
    assert [tuple(r) for r in stations.override_candidates(cw, served).collect()] == [(0, 2, 2, 2, ["M", "R"], ["A", "B"])]
    assert stations.override_candidates(cw, served.limit(0)).count() == 0
