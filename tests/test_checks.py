from feeds import feed

from ferrovia.operators import checks


def one(df):
    return df.collect()[0]


def test_orphans(spark):
    f = feed(
        spark,
        stops=[("A", "a", 0.0, 0.0, 0)],
        stop_times=[("T", "A", 1, 0.0), ("T", "Z", 2, 1.0), ("T", None, 3, 2.0)],
        trips=[("T", "R9", "S")],
        routes=[("R1", "M", 1)],
        calendar=[("S",)],
        frequencies=[("T", 60)],
    )
    assert one(checks.orphan_stops(f))["n_bad"] == 1
    assert one(checks.orphan_routes(f)).asDict() == {"name": "trips.route_id in routes", "ok": False, "n_bad": 1, "detail": "R9"}
    assert one(checks.orphan_services(f))["ok"] and one(checks.orphan_frequency_trips(f))["ok"]
    assert not checks.all_passed(checks.run_checks(f))
    assert "[FALLA] trips.route_id in routes (1: R9)" in checks.report(checks.run_checks(f))


def test_sequences_may_not_repeat(spark):
    rows = [("T1", "A", n, 0.0) for n in (1, 2, 2)] + [("T2", "A", n, 0.0) for n in (3, 1, 2)]
    assert one(checks.stop_sequence(feed(spark, stop_times=rows)))["detail"] == "T1"


def test_headways_and_windows(spark):
    f = feed(spark, frequencies=[("T", 120), ("T", 0), ("U", -5), ("V", 60), ("V", 60), ("V", 60)])
    assert one(checks.positive_headways(f))["n_bad"] == 2
    assert one(checks.frequency_granularity(f))["detail"] == "2 several windows, 1 one (66.7%)"
    assert one(checks.frequency_granularity(feed(spark)))["detail"] == "0 several windows, 0 one (0.0%)"


def test_empty_feed_passes(spark):
    f = feed(spark)
    assert checks.all_passed(checks.run_checks(f))
    assert [r["ok"] for r in checks.run_checks(f, checks.WARNINGS).collect()] == [True, True, False, True, True]


def test_trips_without_stops_name_their_agencies(spark):
    f = feed(spark, trips=[("T", "R", "S"), ("U", "R", "S")], routes=[("R", "M", 1)], stop_times=[("T", "A", 1, 0.0)], frequencies=[("W", 60)])
    assert one(checks.trips_without_stop_times(f))["detail"] == "U, W / M"
