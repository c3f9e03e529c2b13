"""Passengers an hour that leave a node."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import hourly_frequency
from .graph import SERVICE

#: Passengers in a vehicle of each agency.
CAPACITY_PER_VEHICLE = {"CBB": 10, "CC": 80, "INTERURBANO": 719, "MB": 160, "METRO": 1300, "PUMABUS": 40, "RTP": 80, "SUB": 1130, "TL": 400, "TROLE": 90}

#: What a vehicle is, where each value comes from being an assumption of the domain.
NOTES = {
    "CBB": "cabin of a cable car",
    "CC": "city bus",
    "INTERURBANO": "commuter train of five cars, standing included",
    "MB": "articulated bus",
    "METRO": "between a train of six cars and one of nine",
    "PUMABUS": "campus shuttle; estimated, the least certain",
    "RTP": "city bus",
    "SUB": "suburban train of four cars",
    "TL": "light rail; its fleet is being replaced",
    "TROLE": "trolleybus",
}

#: What follows from how these operators use the values.
CAVEATS = (
    "A capacity is what a vehicle holds, not how many travel in it.",
    "Every route of an agency, and every hour, has the agency's one value.",
    "A wrong value scales the capacity of all nodes of its agency by the same factor.",
    "An agency without a value counts as zero, and so do its nodes.",
)


def capacity_table(spark: SparkSession) -> DataFrame:
    rows = [(a, n, NOTES[a]) for a, n in sorted(CAPACITY_PER_VEHICLE.items())]
    return spark.createDataFrame(rows, "agency_id string, capacity_per_vehicle int, note string")


def missing_headways(edges: DataFrame) -> DataFrame:
    """Service edges that no capacity can be given for."""
    return edges.where((F.col("edge_type") == SERVICE) & F.col("headway_secs").isNull())


def node_capacity(edges: DataFrame, capacities: DataFrame) -> DataFrame:
    """(node_id, C_i) of nodes with outgoing service: vehicles an hour times their capacity, to one decimal; unknown agencies count 0."""
    service = edges.where(F.col("edge_type") == SERVICE).select("source", "agency_id", "headway_secs")
    flow = hourly_frequency(F.col("headway_secs")) * F.col("capacity_per_vehicle")
    rated = service.join(capacities.select("agency_id", "capacity_per_vehicle"), "agency_id", "left")
    return rated.groupBy(F.col("source").alias("node_id")).agg(F.bround(F.coalesce(F.sum(flow), F.lit(0.0)), 1).alias("C_i"))
