"""Feed and graph checks: each gives one row (name, ok, n_bad, detail)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.feed import Feed


def _first(column: Column, k: int) -> Column:
    """The first k distinct values, sorted."""
    return F.array_join(F.slice(F.array_sort(F.collect_set(column)), 1, k), ", ")


def _result(bad: DataFrame, name: str, key: str, examples: int = 5) -> DataFrame:
    """``bad`` has a row for each fault."""
    n = F.count("*")
    return bad.agg(n.alias("n_bad"), _first(F.col(key).cast("string"), examples).alias("detail")).select(F.lit(name).alias("name"), (F.col("n_bad") == 0).alias("ok"), "n_bad", "detail")


def missing_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``left``, null aside, that ``right`` lacks."""
    return left.select(key).where(F.col(key).isNotNull()).distinct().join(right, key, "left_anti")


def orphan_stops(feed: Feed) -> DataFrame:
    return _result(missing_keys(feed.stop_times, feed.stops, "stop_id"), "stop_times.stop_id in stops", "stop_id")


def orphan_routes(feed: Feed) -> DataFrame:
    return _result(missing_keys(feed.trips, feed.routes, "route_id"), "trips.route_id in routes", "route_id")


def orphan_services(feed: Feed) -> DataFrame:
    return _result(missing_keys(feed.trips, feed.calendar, "service_id"), "trips.service_id in calendar", "service_id", 10)


def orphan_frequency_trips(feed: Feed) -> DataFrame:
    return _result(missing_keys(feed.frequencies, feed.trips, "trip_id"), "frequencies.trip_id in trips", "trip_id")


def stop_sequence(feed: Feed) -> DataFrame:
    """Sorted by sequence, a trip must rise strictly: it may not repeat or lack a number."""
    by_trip = feed.stop_times.where(F.col("trip_id").isNotNull()).groupBy("trip_id").agg(F.count("*").alias("n"), F.count_distinct("stop_sequence").alias("k"))
    return _result(by_trip.where("n <> k"), "stop_sequence rises strictly", "trip_id")


def positive_headways(feed: Feed) -> DataFrame:
    return _result(feed.frequencies.where("headway_secs <= 0"), "headway_secs is positive", "trip_id")


def frequency_granularity(feed: Feed) -> DataFrame:
    """How many trips have several windows; informs only."""
    by_trip = feed.frequencies.where(F.col("trip_id").isNotNull()).groupBy("trip_id").agg(F.count("*").alias("n"))
    many, one = F.count_if(F.col("n") > 1), F.count_if(F.col("n") == 1)
    share = F.coalesce(F.round(F.try_divide(100.0 * F.col("many"), F.col("many") + F.col("one")), 1), F.lit(0.0))
    said = F.concat(F.col("many"), F.lit(" several windows, "), F.col("one"), F.lit(" one ("), F.format_number(share, 1), F.lit("%)"))
    return by_trip.agg(many.alias("many"), one.alias("one")).select(F.lit("windows by trip").alias("name"), F.lit(True).alias("ok"), F.col("many").alias("n_bad"), said.alias("detail"))


def route_type_consistency(feed: Feed) -> DataFrame:
    mixed = feed.routes.where(F.col("agency_id").isNotNull()).groupBy("agency_id").agg(F.count_distinct("route_type").alias("k")).where("k > 1")
    return _result(mixed, "one route_type by agency", "agency_id")


def calendar_dates_present(feed: Feed) -> DataFrame:
    n = F.count("*")
    return feed.calendar_dates.agg(n.alias("n")).select(F.lit("calendar_dates has rows").alias("name"), (F.col("n") > 0).alias("ok"), F.when(F.col("n") > 0, 0).otherwise(1).cast("long").alias("n_bad"), F.lit("").alias("detail"))


def orphan_agencies(feed: Feed) -> DataFrame:
    return _result(missing_keys(feed.routes, feed.agency, "agency_id"), "routes.agency_id in agency", "agency_id")


def trips_without_stop_times(feed: Feed) -> DataFrame:
    """Trips, of the trips or frequencies, that make no edge; with the agencies they belong to."""
    expected = feed.trips.select("trip_id").union(feed.frequencies.select("trip_id"))
    missing = missing_keys(expected, feed.stop_times, "trip_id")
    owners = missing.join(feed.trips, "trip_id", "left").join(feed.routes.select("route_id", "agency_id"), "route_id", "left")
    both = owners.agg(F.count_distinct("trip_id").alias("n_bad"), _first(F.col("trip_id"), 5).alias("trips"), _first(F.col("agency_id"), 1000).alias("agencies"))
    return both.select(F.lit("trips have stop_times").alias("name"), (F.col("n_bad") == 0).alias("ok"), "n_bad", F.concat("trips", F.lit(" / "), "agencies").alias("detail"))


def stations_without_transfer(nodes: DataFrame, transfers: DataFrame) -> DataFrame:
    shared = nodes.groupBy("station_id").agg(F.count_distinct("agency_id").alias("k")).where("k >= 2")
    linked = transfers.select(F.split_part("source", F.lit("|"), F.lit(1)).alias("station_id"))
    return _result(shared.join(linked, "station_id", "left_anti"), "shared stations have transfers", "station_id")


def sparse_routes(edges: DataFrame, max_gap_s: float = 3600.0) -> DataFrame:
    """Edges that take longer than ``max_gap_s``, and their routes."""
    return _result(edges.where(F.col("avg_travel_time_s") > max_gap_s), "travel times within the limit", "route_id", 1000)


BLOCKING: tuple[Callable[[Feed], DataFrame], ...] = (orphan_stops, orphan_routes, orphan_services, orphan_frequency_trips, stop_sequence, positive_headways)
WARNINGS: tuple[Callable[[Feed], DataFrame], ...] = (frequency_granularity, route_type_consistency, calendar_dates_present, orphan_agencies, trips_without_stop_times)


def run_checks(feed: Feed, checks=BLOCKING) -> DataFrame:
    """All results as one table, which is one job."""
    return reduce(DataFrame.unionByName, (check(feed) for check in checks))


def all_passed(results: DataFrame) -> bool:
    return results.agg(F.bool_and("ok").alias("ok")).first()["ok"] is not False


def report(results: DataFrame) -> str:
    return "\n".join(f"[{'OK' if r['ok'] else 'FALLA'}] {r['name']}" + (f" ({r['n_bad']}: {r['detail']})" if r["n_bad"] else "") for r in results.collect())


def validate_feed(feed: Feed) -> bool:
    """Print the report; blocking checks decide."""
    blocking = run_checks(feed).cache()
    print(report(blocking))
    print(report(run_checks(feed, WARNINGS)))
    return all_passed(blocking)


def require(bad: DataFrame, what: str, examples: int = 5) -> None:
    """Raise, naming rows, if ``bad`` has any."""
    if rows := bad.limit(examples).collect():
        raise ValueError(f"{what}: " + "; ".join(str(r.asDict()) for r in rows))
