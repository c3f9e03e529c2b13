"""Stops to stations: clusters by distance, then by name, then manual overrides."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import highest_ratio, normalize_name, token_sort_ratio
from ..plans.storage import stash
from .checks import require
from .components import connected_components
from .ordering import placed
from .spatial import radius_pairs

RADIUS_M, NAME_THRESHOLD = 150.0, 85.0


def _items(stops: DataFrame) -> DataFrame:
    """``stops`` with item: the first of the stops at the same place that bear the same name, which links alike.

    So the stops of a terminal meet once for each name and place, not once for each pair of stops.
    """
    lone = F.when(F.col("stop_lat").isNull() | F.col("stop_lon").isNull() | F.col("stop_name").isNull(), F.col("stop_ordinal"))
    same = [F.col("stop_lat").alias("y"), F.col("stop_lon").alias("x"), normalize_name(F.col("stop_name")).alias("name"), lone.alias("lone")]
    keyed = stops.select("*", *same)
    keys = ("y", "x", "name", "lone")
    firsts = keyed.groupBy(*(F.col(c).alias(f"of_{c}") for c in keys)).agg(F.min("stop_ordinal").alias("item"))
    return keyed.join(firsts, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in keys]).select(*stops.columns, "name", "item")


def _rooted(items: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """``items`` with ``name``: the least item of its component."""
    reached = connected_components(pairs).select(F.col("node").alias("item"), F.col("component").alias(name))
    return items.join(reached, "item", "left").withColumn(name, F.coalesce(name, "item"))


def _near(items: DataFrame, radius_m: float) -> DataFrame:
    return stash(radius_pairs(items.where("stop_ordinal = item"), "item", radius_m=radius_m).select("a", "b"), "near")


def _with_clusters(stops: DataFrame, radius_m: float) -> tuple[DataFrame, DataFrame]:
    """Items with geo_cluster, numbered by their first stop in the file; pairs of near items."""
    items = stash(_items(stops), "items")
    near = _near(items, radius_m)
    rooted = _rooted(items, near, "root")
    numbers = placed(rooted.select("root").distinct(), F.col("root"), name="geo_cluster")
    return rooted.join(numbers, "root").drop("root"), near


def geographic_clusters(stops: DataFrame, radius_m: float = RADIUS_M) -> DataFrame:
    """``stops`` with geo_cluster: chains of stops at most ``radius_m`` apart, numbered by their first stop in the file."""
    return _with_clusters(stops, radius_m)[0].select(*stops.columns, "geo_cluster")


def alike_pairs(items: DataFrame, near: DataFrame, threshold: float = NAME_THRESHOLD) -> DataFrame:
    """Those of the pairs (a, b) of near items that are named alike; a pair of names is compared once, a null name is like none."""
    names = items.where("stop_ordinal = item").select("item", "name")
    named = near.join(names.select(F.col("item").alias("a"), F.col("name").alias("x")), "a").join(names.select(F.col("item").alias("b"), F.col("name").alias("y")), "b")
    named = named.where("x IS NOT NULL AND y IS NOT NULL").select("a", "b", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    x, y = F.col("x"), F.col("y")
    alike = named.select("x", "y").distinct().where(highest_ratio(x, y) >= threshold).where(token_sort_ratio(x, y) >= threshold)
    return named.join(alike, ["x", "y"]).select("a", "b")


def build_crosswalk(stops: DataFrame, radius_m: float = RADIUS_M, threshold: float = NAME_THRESHOLD) -> DataFrame:
    """stop_id, stop_name, station_id ``station_{geo}_{sub}``, geo_cluster of each stop.

    Stops that are near and named alike chain to stations; a cluster's stations are numbered by their first stop.
    """
    clustered, near = _with_clusters(stops, radius_m)
    clustered = stash(clustered, "clustered")
    rooted = _rooted(clustered, alike_pairs(clustered, near, threshold), "root")
    order = Window.partitionBy("geo_cluster").orderBy("root")  # a row for each station of a cluster
    numbers = rooted.select("geo_cluster", "root").distinct().withColumn("sub", F.row_number().over(order) - 1)
    station = F.concat(F.lit("station_"), F.col("geo_cluster").cast("string"), F.lit("_"), F.col("sub").cast("string"))
    return rooted.join(numbers, ["geo_cluster", "root"]).select("stop_id", "stop_name", station.alias("station_id"), "geo_cluster")


def conflicting_overrides(overrides: DataFrame) -> DataFrame:
    """Rows of stops that are sent to several stations."""
    split = overrides.groupBy("stop_id").agg(F.count_distinct("target_station_id").alias("k")).where("k > 1")
    return overrides.join(split, "stop_id", "left_semi")


def unknown_targets(crosswalk: DataFrame, overrides: DataFrame) -> DataFrame:
    """Overrides whose station no stop has: the ids of the clusters have probably moved."""
    return overrides.join(crosswalk, overrides["target_station_id"] == crosswalk["station_id"], "left_anti")


def apply_overrides(crosswalk: DataFrame, overrides: DataFrame) -> DataFrame:
    """The crosswalk, an override's target in place of the computed station."""
    require(conflicting_overrides(overrides), "stops with several override targets")
    targets = overrides.groupBy("stop_id").agg(F.max("target_station_id").alias("target"))
    station = F.coalesce("target", "station_id").alias("station_id")
    return crosswalk.join(targets, "stop_id", "left").select("stop_id", "stop_name", station, "geo_cluster")


def override_candidates(crosswalk: DataFrame, stop_agencies: DataFrame) -> DataFrame:
    """Clusters that hold several stations and several agencies, largest first; ``stop_agencies`` has (stop_id, agency_id)."""
    served = crosswalk.join(stop_agencies.distinct(), "stop_id", "left")
    by = served.groupBy("geo_cluster").agg(
        F.count_distinct("stop_id").alias("n_stops"),
        F.count_distinct("station_id").alias("n_station_ids_tras_paso2"),
        F.count_distinct("agency_id").alias("n_agencias"),
        F.array_sort(F.collect_set("agency_id")).alias("agencias"),
        F.array_sort(F.collect_set("stop_name")).alias("nombres"),
    )
    return by.where("n_station_ids_tras_paso2 > 1 AND n_agencias > 1").orderBy(F.desc("n_stops"), "geo_cluster")
