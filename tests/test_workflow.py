import csv

from pyspark.sql import functions as F

from ferrovia.functions.text import shorten
from ferrovia.plans import workflow

TABLES = {
    "agency": "agency_id\nMETRO\nRTP\n",
    "routes": "route_id,agency_id,route_type\nR1,METRO,1\nR2,RTP,3\n",
    "trips": "route_id,service_id,trip_id\nR1,S,T1\nR2,S,T2\n",
    "calendar": "service_id\nS\n",
    "calendar_dates": "service_id\nS\n",
    "frequencies": "trip_id,headway_secs\nT1,180\nT2,600\nT2,300\n",
    "stops": "stop_id,stop_name,stop_lat,stop_lon\na1,Metro Norte,19.4,-99.1\na2,Norte,19.4003,-99.1\nb1,Sur,19.45,-99.1\nb2,Base Sur,19.4502,-99.1\nc,Este,19.5,-99.0\n",
    "stop_times": "trip_id,arrival_time,stop_id,stop_sequence\nT1,24:00:00,a1,1\nT1,24:05:00,b1,2\nT2,8:00:00,a2,1\nT2,8:10:00,b2,2\nT2,8:30:00,c,3\n",
}


def rows(folder):
    (part,) = folder.glob("part-*")
    with part.open() as f:
        return list(csv.DictReader(f))


def test_feed_to_loads(spark, tmp_path, capsys):
    feed, out = tmp_path / "feed", tmp_path / "out"
    feed.mkdir()
    for name, text in TABLES.items():
        (feed / f"{name}.txt").write_text(text)
    (tmp_path / "overrides.csv").write_text("stop_id,action,target_station_id,note\nc,merge_into,station_7_0,\n")
    assert workflow.main(["all", str(feed), str(out), "--overrides", str(tmp_path / "overrides.csv")]) == 0
    said = capsys.readouterr().out
    assert "[OK] headway_secs is positive" in said and "1 overrides name a station" in said
    assert {r["stop_id"]: r["station_id"] for r in rows(out / "crosswalk.csv")} == {"a1": "station_0_0", "a2": "station_0_0", "b1": "station_1_0", "b2": "station_1_0", "c": "station_7_0"}
    assert [(r["node_id"], r["C_i"]) for r in rows(out / "node_capacity.csv")] == [("station_0_0|METRO", "26000.0"), ("station_0_0|RTP", "960.0"), ("station_1_0|RTP", "960.0")]
    assert [tuple(r.values()) for r in rows(out / "transfer_matrix.csv")] == [("METRO", "0", "2"), ("RTP", "2", "0")]
    edges = spark.read.parquet(str(out / "edges.parquet"))
    assert {(r["source"], r["avg_travel_time_s"]) for r in edges.where("edge_type = 'servicio'").collect()} == {("station_0_0|METRO", 300.0), ("station_0_0|RTP", 600.0), ("station_1_0|RTP", 1200.0)}
    assert "5 stops, 3 clusters, 3 stations" in said and "1 transfer stations" not in said and "L_i_flujo: 5 nodes" in said
    assert len(rows(out / "load_flujo.csv")) == len(rows(out / "load_topological.csv")) == 5


def test_options(spark, tmp_path, capsys):
    feed, out = tmp_path / "feed", tmp_path / "out"
    feed.mkdir()
    for name, text in TABLES.items():
        (feed / f"{name}.txt").write_text(text)
    (tmp_path / "capacities.csv").write_text("agency_id,capacity_per_vehicle\nMETRO,10\nRTP,1\n")
    for stage in ("stations", "network"):
        assert workflow.main([stage, str(feed), str(out)]) == 0
    there = ["--nodes", str(out / "nodes.parquet"), "--edges", str(out / "edges.parquet")]
    other = tmp_path / "other"
    assert workflow.main(["analyze", str(feed), str(other), *there, "--figures-dir", str(other / "figures"), "--transfer-csv", str(other / "m.csv"), "--output-map", str(other / "points")]) == 0
    assert rows(other / "figures/hist_degree.csv") and rows(other / "m.csv") and list((other / "points").glob("part-*")) and not (other / "map.geojsonl").exists()
    capsys.readouterr()
    assert workflow.main(["loads", str(feed), str(other), *there, "--capacities", str(tmp_path / "capacities.csv"), "--k", "0", "--damping", "0.5", "--tol", "1e-6", "--spot", "station_0_0|METRO", "nowhere"]) == 0
    said = capsys.readouterr().out
    assert [r["C_i"] for r in rows(other / "node_capacity.csv")] == ["200.0", "12.0", "12.0"]
    assert "station_0_0|METRO: 200, rank 1 of 3" in said and "nowhere: unknown" in said
    assert workflow.main(["cascades", str(feed), str(other), *there]) == 0
    assert {(r["tipo_ataque"], r["variante_carga"]) for r in rows(other / "alpha_sweep.csv")} == {(a, b) for a in ("dirigido", "aleatorio") for b in ("flujo", "topo")}


def test_a_bad_feed_fails(spark, tmp_path):
    for name, text in (TABLES | {"routes": "route_id,agency_id,route_type\n"}).items():
        (tmp_path / f"{name}.txt").write_text(text)
    assert workflow.main(["validate", str(tmp_path)]) == 1


def test_notes_are_shortened(spark):
    got = spark.createDataFrame([("x" * 43,), ("x" * 44,), (None,)], "n string").select(shorten(F.col("n"))).collect()
    assert [r[0] for r in got] == ["x" * 43, "x" * 43 + "...", None]
