"""Schedule feeds, and the tables that stages hand to each other."""

from __future__ import annotations

import zipfile
from dataclasses import dataclass, fields, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import seconds_of_day

#: Column types of each table; only these columns are read.
COLUMNS = {
    "stops": {"stop_id": "string", "stop_name": "string", "stop_lat": "double", "stop_lon": "double"},
    "stop_times": {"trip_id": "string", "stop_id": "string", "stop_sequence": "int", "arrival_time": "time"},
    "trips": {"trip_id": "string", "route_id": "string", "service_id": "string"},
    "routes": {"route_id": "string", "agency_id": "string", "route_type": "int"},
    "agency": {"agency_id": "string"},
    "calendar": {"service_id": "string"},
    "calendar_dates": {"service_id": "string"},
    "frequencies": {"trip_id": "string", "headway_secs": "int"},
}


@dataclass(frozen=True)
class Feed:
    stops: DataFrame
    stop_times: DataFrame
    trips: DataFrame
    routes: DataFrame
    agency: DataFrame
    calendar: DataFrame
    calendar_dates: DataFrame
    frequencies: DataFrame

    def register(self) -> None:
        """As temporary views, for SQL."""
        for f in fields(self):
            getattr(self, f.name).createOrReplaceTempView(f.name)

    def pruned(self) -> Feed:
        """Only rows that others refer to, from trips downwards."""
        trips = self.trips.join(self.routes, "route_id", "left_semi").join(self.calendar, "service_id", "left_semi")
        times = self.stop_times.join(trips, "trip_id", "left_semi")
        return replace(self, trips=trips, stop_times=times, stops=self.stops.join(times, "stop_id", "left_semi"), frequencies=self.frequencies.join(trips, "trip_id", "left_semi"))


def read_csv(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """``columns`` of a file with a header line, by name; those it lacks are null, and so are NaN numbers."""
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("encoding", "UTF-8").csv(path)
    named = {c.strip().lstrip("﻿"): c for c in raw.columns}

    def column(name: str, kind: str):
        if name not in named:
            return F.lit(None).cast("double" if kind == "time" else kind).alias(name)
        text = F.col(f"`{named[name]}`")
        value = seconds_of_day(text) if kind == "time" else text if kind == "string" else F.expr(f"try_cast(`{named[name]}` AS {kind})")
        return (F.nanvl(value, F.lit(None)) if kind == "double" else value).alias(name)

    return raw.select(*(column(n, k) for n, k in columns.items()))


def read_feed(spark: SparkSession, path: str, prune: bool = False) -> Feed:
    """A folder of ``.txt`` tables; tables it lacks are empty. Stops get their place in the file."""
    found = {}
    for name, columns in COLUMNS.items():
        try:
            found[name] = read_csv(spark, f"{path}/{name}.txt", columns)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            kinds = ", ".join(f"{n} {'double' if k == 'time' else k}" for n, k in columns.items())
            found[name] = spark.createDataFrame([], kinds)
    found["stops"] = found["stops"].withColumn("stop_ordinal", F.monotonically_increasing_id())
    feed = Feed(**found)
    return feed.pruned() if prune else feed


def unzip_feed(archive: str, folder: str) -> str:
    """Unpack the tables of a feed archive; ``folder`` must be one that executors see."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(archive) as z:
        for name in z.namelist():
            if Path(name).suffix == ".txt":
                (Path(folder) / Path(name).name).write_bytes(z.read(name))
    return folder


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, dict.fromkeys(("stop_id", "action", "target_station_id", "note"), "string"))


def read_crosswalk(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, {"stop_id": "string", "stop_name": "string", "station_id": "string", "geo_cluster": "int"})


def read_capacities(spark: SparkSession, path: str) -> DataFrame:
    """agency_id and capacity_per_vehicle; of repeated agencies the last line counts."""
    rows = read_csv(spark, path, {"agency_id": "string", "capacity_per_vehicle": "int"}).withColumn("line", F.monotonically_increasing_id())
    return rows.groupBy("agency_id").agg(F.max_by("capacity_per_vehicle", "line").alias("capacity_per_vehicle"))


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges."""
    return spark.read.parquet(f"{path}/nodes.parquet"), spark.read.parquet(f"{path}/edges.parquet")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes.parquet")
    edges.write.mode("overwrite").parquet(f"{path}/edges.parquet")


def write_csv(df: DataFrame, path: str, *order: str, descending: bool = False, one_file: bool = True) -> None:
    """A file with a header, sorted, or with ``one_file=False`` as many as there are partitions, in order; arrays are written as JSON."""
    flat = df.select(*(F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes))
    if order:
        first = F.col(order[0])
        flat = flat.orderBy(first.desc() if descending else first, *order[1:])
    (flat.coalesce(1) if one_file else flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_geojson(markers: DataFrame, path: str, one_file: bool = True) -> None:
    """Map markers as GeoJSON features, one to a line; every column but the coordinates is a property."""
    rest = [c for c in markers.columns if c not in ("lat", "lon")]
    point = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*rest).alias("properties"))
    lines = markers.select(F.to_json(feature).alias("value"))
    (lines.coalesce(1) if one_file else lines).write.mode("overwrite").text(path)
