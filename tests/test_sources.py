import zipfile

from pyspark.sql import functions as F

from ferrovia import streaming
from ferrovia.sources import feed as sources


def test_feed_archive(spark, tmp_path):
    tables = {
        "stops.txt": 'stop_lon,stop_id,stop_name,stop_lat\n-99.1,B,"Tasqueña, sur",19.4\n,A,,\n',
        "stop_times.txt": "trip_id,arrival_time,stop_id,stop_sequence\nT,25:10:00,B,1\n",
        "trips.txt": "route_id,service_id,trip_id\nR,S,T\nR9,S,U\n",
        "routes.txt": "route_id,agency_id,route_type\nR,M,1\n",
        "calendar.txt": "service_id\nS\n",
        "note.md": "x",
    }
    archive = tmp_path / "feed.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for name, text in tables.items():
            z.writestr(name, text)
    feed = sources.read_feed(spark, sources.unzip_feed(str(archive), str(tmp_path / "feed")))
    assert [tuple(r)[:4] for r in feed.stops.orderBy("stop_ordinal").collect()] == [("B", "Tasqueña, sur", 19.4, -99.1), ("A", None, None, None)]
    assert feed.stop_times.first()["arrival_time"] == 90600.0
    assert feed.frequencies.count() == 0
    pruned = sources.read_feed(spark, str(tmp_path / "feed"), prune=True)
    assert pruned.trips.count() == 1 and pruned.stops.count() == 1
    feed.register()
    assert spark.sql("SELECT count(*) FROM trips").first()[0] == 2


def test_reference_tables(spark, tmp_path):
    (tmp_path / "c.csv").write_text('agency_id,capacity_per_vehicle,note\nM,1,"a, ""b"""\nM,2,\n')
    assert [tuple(r) for r in sources.read_capacities(spark, str(tmp_path / "c.csv")).collect()] == [("M", 2)]
    (tmp_path / "o.csv").write_text('stop_id,action,target_station_id,note\nA,merge_into,station_1_0,"x, y"\n')
    assert sources.read_overrides(spark, str(tmp_path / "o.csv")).first()["note"] == "x, y"
    (tmp_path / "w.csv").write_text("stop_id,stop_name,station_id,geo_cluster\nA,a,station_1_0,1\n")
    assert sources.read_crosswalk(spark, str(tmp_path / "w.csv")).first()["geo_cluster"] == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0, ["x"]), ("b", 2.0, [])], "node_id string, v double, l array<string>")
    sources.write_csv(df, str(tmp_path / "out"), "v", "node_id", descending=True)
    (part,) = (tmp_path / "out").glob("part-*")
    assert part.read_text().splitlines() == ["node_id,v,l", "b,2.0,[]", 'a,1.0,"[""x""]"']
    sources.write_graph(df, df, str(tmp_path))
    nodes, edges = sources.read_graph(spark, str(tmp_path))
    assert nodes.count() == edges.count() == 2


def test_streamed_checks(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 00:10:00", 5), ("2024-01-01 00:20:00", -1), ("2024-01-01 00:30:00", None)], "ts string, h int").select(F.to_timestamp("ts").alias("ts"), "h").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, h int").parquet(str(tmp_path / "in"))
    for name, df, mode in (("bad", streaming.failing_rows(stream, F.col("h") > 0, "h"), "append"), ("counts", streaming.fault_counts(stream, "ts", F.col("h") > 0), "complete")):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        query.processAllAvailable()
        query.stop()
    assert spark.sql("SELECT count(*) FROM bad").first()[0] == 2
    assert tuple(spark.sql("SELECT n, n_bad FROM counts").first()) == (3, 2)
