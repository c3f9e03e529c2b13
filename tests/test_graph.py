import pytest
from feeds import feed

from ferrovia.operators import capacity, graph, stats


def crosswalk(spark, *pairs):
    return spark.createDataFrame(pairs, "stop_id string, station_id string")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_pairs_follow_one_another(spark):
    times = [("T", s, k, t) for k, (s, t) in enumerate([("a1", 0.0), ("a2", 60.0), ("b", 100.0), ("c", 160.0)])]
    f = feed(spark, stop_times=times, trips=[("T", "R", "S")], routes=[("R", "M", 1)])
    cw = crosswalk(spark, ("a1", "A"), ("a2", "A"), ("b", "B"), ("c", "C"))
    assert rows(graph.raw_service_edges(f, cw), "source", "target", "travel_time_s") == [("A", "B", 40.0), ("B", "C", 60.0)]
    with pytest.raises(ValueError, match="outside the crosswalk"):
        graph.raw_service_edges(f, crosswalk(spark, ("a1", "A")))


def test_routes_stay_apart(spark):
    raw = spark.createDataFrame([("T1", "s", "t", 40.0, "R1", "M"), ("T2", "s", "t", 60.0, "R1", "M"), ("T3", "s", "t", 10.0, "R2", "M"), ("T4", "s", "t", 1.0, None, None)], "trip_id string, source string, target string, travel_time_s double, route_id string, agency_id string")
    assert rows(graph.aggregate_edges(raw), "route_id", "avg_travel_time_s", "trip_count") == [("R1", 50.0, 2), ("R2", 10.0, 1)]


def test_least_headway_of_a_route(spark):
    f = feed(spark, trips=[("T", "R1", "S"), ("U", "R2", "S")], frequencies=[("T", 600), ("T", 300)])
    edges = spark.createDataFrame([("R1",), ("R2",)], "route_id string")
    assert rows(graph.attach_headway(edges, f), "route_id", "headway_secs") == [("R1", 300), ("R2", None)]


def test_transfers_are_all_ordered_pairs(spark):
    nodes = spark.createDataFrame([("S", a, 19.4 + k / 1000, -99.1, None, f"S|{a}") for k, a in enumerate("MBR")] + [("T", "M", 19.0, -99.0, None, "T|M")], "station_id string, agency_id string, lat double, lon double, stop_name string, node_id string")
    found = graph.transfer_edges(nodes).collect()
    assert len(found) == 6
    assert all(abs(r["avg_travel_time_s"] - r["distance_m"] / 1.3) < 1e-9 for r in found)
    assert {(r["source"], r["target"]) for r in found} == {(r["target"], r["source"]) for r in found}
    assert rows(graph.transfer_stations(nodes), "station_id", "n_agencies") == [("S", 3)]


def edges_of(spark, *e):
    return spark.createDataFrame(e, "source string, target string, route_id string, agency_id string, avg_travel_time_s double, headway_secs int, edge_type string, distance_m double")


def test_capacity(spark):
    e = edges_of(spark, ("a", "b", "1", "METRO", 1.0, 180, "servicio", None), ("c", "d", "2", "RTP", 1.0, 5100, "servicio", None), ("e", "f", "3", "NEW", 1.0, 60, "servicio", None), ("g", "h", None, None, 1.0, None, "transbordo", 5.0))
    assert rows(capacity.node_capacity(e, capacity.capacity_table(spark)), "node_id", "C_i") == [("a", 26000.0), ("c", 56.5), ("e", 0.0)]


def test_describe_rounds_half_to_even(spark):
    v = spark.createDataFrame([(x, "g") for x in (1.0, 2.0, 3.0, 4.0, 10.0, 11.5, None)], "v double, g string")
    assert tuple(stats.describe(v, "v", ["g"]).first()) == ("g", 6, 5.2, 4.4, 1.0, 2.2, 3.5, 8.5, 11.5)


def test_histogram_closes_the_last_bin(spark):
    v = spark.createDataFrame([("g", float(x)) for x in (0, 1, 2, 3)] + [("h", 5.0)], "k string, v double")
    got = {(r["k"], r["bin"]): (r["bin_start"], r["n"]) for r in stats.histogram(v, "v", "k", 3).collect()}
    assert [got["g", b] for b in range(3)] == [(0.0, 1), (1.0, 1), (2.0, 2)]
    assert [got["h", b][1] for b in range(3)] == [0, 1, 0]


def test_matrix_and_margins(spark):
    e = edges_of(spark, *((f"S|{a}", f"S|{b}", None, None, 1.0, None, "transbordo", 1.0) for a in "MBR" for b in "MBR" if a != b))
    assert [tuple(r) for r in stats.transfer_matrix(e).collect()] == [("B", 0, 1, 1), ("M", 1, 0, 1), ("R", 1, 1, 0)]
    assert rows(stats.transfer_margins(e), "agency", "outgoing", "incoming", "total_both_directions") == [(a, 2, 2, 4) for a in "BMR"]
    assert rows(stats.edge_counts(e), "agency_id") == []
    assert rows(stats.edge_counts(e, attribute_transfers=True), "agency_id", "transbordo") == [("B", 2), ("M", 2), ("R", 2)]


def test_ranks_of_a_few(spark):
    v = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("c", 3.0)], "node_id string, x double")
    assert rows(stats.rank_of(v, "x", ["b", "c", "z"]), "node_id", "rank") == [("b", 3), ("c", 1), ("z", None)]
