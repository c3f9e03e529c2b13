"""The multiplex graph: service edges along trips, transfer edges inside stations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import WALKING_SPEED_MPS, haversine_m
from ..plans.storage import stash
from ..sources.feed import Feed
from .checks import require

SERVICE, TRANSFER = "servicio", "transbordo"


def node_id(station: Column, agency: Column) -> Column:
    return F.concat(station, F.lit("|"), agency)


def agency_of(node: Column) -> Column:
    return F.split_part(node, F.lit("|"), F.lit(2))


def trip_agencies(feed: Feed) -> DataFrame:
    """trip_id, route_id, agency_id."""
    return feed.trips.select("trip_id", "route_id").join(feed.routes.select("route_id", "agency_id"), "route_id", "left").select("trip_id", "route_id", "agency_id")


def stop_agencies(feed: Feed) -> DataFrame:
    """(stop_id, agency_id) pairs that a trip serves."""
    served = feed.stop_times.select("trip_id", "stop_id").join(trip_agencies(feed), "trip_id", "left")
    return served.select("stop_id", "agency_id").where("agency_id IS NOT NULL").distinct()


def agencies_by_stop(feed: Feed) -> DataFrame:
    """(stop_id, agencies), sorted."""
    return stop_agencies(feed).groupBy("stop_id").agg(F.array_sort(F.collect_set("agency_id")).alias("agencies"))


def unmapped_stop_times(feed: Feed, crosswalk: DataFrame) -> DataFrame:
    return feed.stop_times.join(crosswalk.where("station_id IS NOT NULL"), "stop_id", "left_anti")


def raw_service_edges(feed: Feed, crosswalk: DataFrame, strict: bool = True) -> DataFrame:
    """A row for each two stops that follow one another on a trip at different stations.

    Stations are not merged before they are paired: of A, A, B only the second A leads to B. Rows of
    a stop outside the crosswalk raise if ``strict``, which costs a job.
    """
    if strict:
        require(unmapped_stop_times(feed, crosswalk).select("trip_id", "stop_id"), "stop_times outside the crosswalk")
    at = feed.stop_times.join(crosswalk.select("stop_id", "station_id"), "stop_id", "left")
    along = Window.partitionBy("trip_id").orderBy("stop_sequence", "arrival_time", "stop_id")
    ahead = at.select("trip_id", F.col("station_id").alias("source"), F.lead("station_id").over(along).alias("target"), (F.lead("arrival_time").over(along) - F.col("arrival_time")).alias("travel_time_s"))
    return ahead.where("source <> target").join(trip_agencies(feed), "trip_id", "left")


def aggregate_edges(raw: DataFrame) -> DataFrame:
    """Mean time and trips by (source, target, route, agency); routes stay apart, rows without one go."""
    keys = ["source", "target", "route_id", "agency_id"]
    whole = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    return raw.where(whole).groupBy(*keys).agg(F.avg("travel_time_s").alias("avg_travel_time_s"), F.count_distinct("trip_id").alias("trip_count"))


def route_headways(feed: Feed) -> DataFrame:
    """The least headway of each route over all its trips and windows."""
    windows = feed.frequencies.join(feed.trips.select("trip_id", "route_id"), "trip_id", "left").where("route_id IS NOT NULL")
    return windows.groupBy("route_id").agg(F.min("headway_secs").alias("headway_secs"))


def attach_headway(edges: DataFrame, feed: Feed) -> DataFrame:
    return edges.join(route_headways(feed), "route_id", "left")


def build_nodes(edges: DataFrame, feed: Feed, crosswalk: DataFrame) -> DataFrame:
    """(station, agency) pairs that edges touch, at the mean place of the stops served, named by the first of them."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("station_id"), "agency_id").distinct()
    here = feed.stops.join(crosswalk.select("stop_id", "station_id"), "stop_id").join(stop_agencies(feed), "stop_id")
    first = F.min_by("stop_name", F.when(F.col("stop_name").isNotNull(), F.col("stop_ordinal")))
    at = here.groupBy("station_id", "agency_id").agg(F.avg("stop_lat").alias("lat"), F.avg("stop_lon").alias("lon"), first.alias("stop_name"))
    return ends.join(at, ["station_id", "agency_id"], "left").withColumn("node_id", node_id(F.col("station_id"), F.col("agency_id")))


def to_node_ids(edges: DataFrame) -> DataFrame:
    """Composite ids in source and target; plain stations beside them."""
    own = lambda c: node_id(F.col(c), F.col("agency_id"))
    return edges.withColumns({"source_station": F.col("source"), "target_station": F.col("target"), "source": own("source"), "target": own("target")})


def transfer_edges(nodes: DataFrame, speed_mps: float = WALKING_SPEED_MPS) -> DataFrame:
    """Both directions between any two agencies of a station, walked in a straight line."""
    a, b = nodes.alias("a"), nodes.alias("b")
    both = a.join(b, (F.col("a.station_id") == F.col("b.station_id")) & (F.col("a.agency_id") != F.col("b.agency_id")))
    apart = haversine_m(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    flat = both.select(F.col("a.node_id").alias("source"), F.col("b.node_id").alias("target"), F.col("a.station_id").alias("source_station"), F.col("b.station_id").alias("target_station"), apart.alias("distance_m"))
    return flat.withColumns({"avg_travel_time_s": F.col("distance_m") / speed_mps, "edge_type": F.lit(TRANSFER)})


_EDGE = {"source": "string", "target": "string", "route_id": "string", "agency_id": "string", "avg_travel_time_s": "double", "trip_count": "long", "headway_secs": "int", "source_station": "string", "target_station": "string", "edge_type": "string", "distance_m": "double"}


def all_edges(service: DataFrame, transfers: DataFrame) -> DataFrame:
    """Service edges (with node ids) and transfer edges as one table; what a kind lacks is null."""
    marked = service.withColumns({"edge_type": F.lit(SERVICE), "distance_m": F.lit(None).cast("double")})
    return marked.unionByName(transfers, allowMissingColumns=True).select(*(F.col(c).cast(t).alias(c) for c, t in _EDGE.items()))


def build_graph(feed: Feed, crosswalk: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges. Service edges and nodes are written, so that the feed is read once however often the graph is."""
    service = stash(attach_headway(aggregate_edges(raw_service_edges(feed, crosswalk, strict)), feed), "service")
    nodes = stash(build_nodes(service, feed, crosswalk), "nodes")
    return nodes, all_edges(to_node_ids(service), transfer_edges(nodes))


def transfer_stations(nodes: DataFrame) -> DataFrame:
    """Stations of two agencies or more."""
    return nodes.groupBy("station_id").agg(F.count_distinct("agency_id").alias("n_agencies")).where("n_agencies >= 2")
