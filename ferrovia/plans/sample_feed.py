"""A schedule feed out of order tables, and the same views in SQL.

Orders stand for trips, their line items for stops, suppliers for places, market segments for
agencies. So that not every place is served by all agencies, an agency stops at the suppliers of some
nations and goes to its own terminus instead of the others: every line item is a stop.
``dirty`` variants have faults that checks should find.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.feed import Feed

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
#: Number in the file of the first agency's terminus; the others' follow.
FIRST_TERMINUS = 10_000_001
AGENCY_CODES = {"AUTOMOBILE": "METRO", "BUILDING": "RTP", "FURNITURE": "MB", "HOUSEHOLD": "TROLE", "MACHINERY": "XX"}


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders", "customer", "nation", "supplier", "part")}


def sample_feed(spark: SparkSession, sf_dir: str, dirty: bool = False) -> Feed:
    t = _tables(spark, sf_dir)
    places = t["customer"].join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
    route = F.concat("c_mktsegment", F.lit("-"), F.col("n_regionkey").cast("string"))
    base = t["orders"].join(places, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey"), F.col("o_orderkey").cast("string").alias("trip_id"), route.alias("route_id"), F.col("o_orderstatus").alias("service_id"), (F.array_position(F.array(*map(F.lit, SEGMENTS)), F.col("c_mktsegment")) - 1).alias("seg"))
    routes = places.select(route.alias("route_id"), F.col("c_mktsegment").alias("agency_id"), (F.col("n_regionkey") % 4).cast("int").alias("route_type")).distinct()
    order = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    served = t["lineitem"].join(base.select("o_orderkey", "trip_id", "seg"), F.col("l_orderkey") == F.col("o_orderkey")).join(t["supplier"].select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    at_supplier = (F.col("s_nationkey") * (F.col("seg") + 1)) % 7 < 3
    place = F.when(at_supplier, F.col("l_suppkey")).otherwise(F.col("seg") + FIRST_TERMINUS)
    number = F.col("l_linenumber") if dirty else F.row_number().over(order)
    stop_times = served.select("trip_id", place.cast("string").alias("stop_id"), number.cast("int").alias("stop_sequence"), (F.unix_date(F.to_date("l_shipdate")) * 2.0).cast("double").alias("arrival_time"))
    key = F.col("s_suppkey")
    lat = 19.3 + ((key * 7919) % 400) * 0.0001
    lon = -99.2 + ((key * 104729) % 400) * 0.0001
    prefix = F.get(F.array(*map(F.lit, ("Metro ", "MB ", "CETRAM Metro ", ""))), (key % 4).cast("int"))
    stops = t["supplier"].join(t["part"].select("p_partkey", "p_name"), key == F.col("p_partkey")).select(key.cast("string").alias("stop_id"), F.concat(prefix, "p_name").alias("stop_name"), lat.alias("stop_lat"), lon.alias("stop_lon"), key.cast("long").alias("stop_ordinal"))
    termini = [(str(FIRST_TERMINUS + k), f"Terminal {s.title()}", 19.5 + 0.01 * k, -99.3, FIRST_TERMINUS + k) for k, s in enumerate(SEGMENTS)]
    stops = stops.union(spark.createDataFrame(termini, "stop_id string, stop_name string, stop_lat double, stop_lon double, stop_ordinal long"))
    orderkey = F.col("o_orderkey")
    frequencies = t["orders"].select(orderkey.cast("string").alias("trip_id"), (60 * (1 + orderkey % 30)).cast("int").alias("headway_secs")).union(t["orders"].where(orderkey % 5 == 0).select(orderkey.cast("string"), (60 * (1 + orderkey % 7)).cast("int")))
    status = t["orders"].select(F.col("o_orderstatus").alias("service_id")).distinct()
    feed = Feed(
        stops=stops,
        stop_times=stop_times,
        trips=base.select("trip_id", "route_id", "service_id"),
        routes=routes,
        agency=routes.select("agency_id").distinct().where("agency_id <> 'MACHINERY'"),
        calendar=status.where("service_id <> 'P'"),
        calendar_dates=status.where("service_id = 'P'"),
        frequencies=frequencies,
    )
    if not dirty:
        return feed
    ghosts = t["orders"].where(orderkey % 50 == 0).select(F.concat(F.lit("x"), orderkey.cast("string")).alias("trip_id"), (orderkey % 3 - 1).cast("int").alias("headway_secs"))
    return replace(feed, calendar_dates=status.where("service_id = 'none'"), stops=feed.stops.where(F.col("stop_ordinal") % 10 != 0), routes=routes.where("route_id NOT LIKE '%-3'"), frequencies=frequencies.union(ghosts))


def sample_crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations are nations, so that they hold many stops, and termini."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    places = s.select(F.col("s_suppkey").cast("string").alias("stop_id"), F.concat(F.lit("station_"), F.col("s_nationkey").cast("string"), F.lit("_0")).alias("station_id"))
    termini = [(str(FIRST_TERMINUS + k), f"station_{900 + k}_0") for k in range(len(SEGMENTS))]
    return places.union(spark.createDataFrame(termini, "stop_id string, station_id string"))


def sample_capacities(spark: SparkSession) -> DataFrame:
    """By segment; the last has none."""
    from ..operators.capacity import CAPACITY_PER_VEHICLE

    rows = [(s, CAPACITY_PER_VEHICLE[a]) for s, a in AGENCY_CODES.items() if a in CAPACITY_PER_VEHICLE]
    return spark.createDataFrame(rows, "agency_id string, capacity_per_vehicle int")


_SEGS = ", ".join(f"'{s}'" for s in SEGMENTS)

#: Common table expressions of the views above.
SQL = f"""
agencies AS (SELECT unnest(range(5)) AS k, unnest([{_SEGS}]) AS s),
trip_base AS (
    SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS trip_id, c_mktsegment || '-' || n_regionkey AS route_id,
           o_orderstatus AS service_id, list_position([{_SEGS}], c_mktsegment) - 1 AS seg
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
), trips AS (SELECT trip_id, route_id, service_id FROM trip_base),
routes AS (
    SELECT DISTINCT c_mktsegment || '-' || n_regionkey AS route_id, c_mktsegment AS agency_id, CAST(n_regionkey % 4 AS INT) AS route_type
    FROM customer JOIN nation ON c_nationkey = n_nationkey
), dirty_routes AS (SELECT * FROM routes WHERE route_id NOT LIKE '%-3'),
served AS (
    SELECT trip_id, CASE WHEN (s_nationkey * (seg + 1)) % 7 < 3 THEN l_suppkey ELSE seg + {FIRST_TERMINUS} END AS stop, l_linenumber, l_shipdate,
           row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS place
    FROM lineitem JOIN trip_base ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
), stop_times AS (
    SELECT trip_id, CAST(stop AS VARCHAR) AS stop_id, place AS stop_sequence,
           CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) * 2.0 AS DOUBLE) AS arrival_time FROM served
), dirty_times AS (SELECT trip_id, CAST(stop AS VARCHAR) AS stop_id, l_linenumber AS stop_sequence FROM served),
stops AS (
    SELECT CAST(s_suppkey AS VARCHAR) AS stop_id, ['Metro ', 'MB ', 'CETRAM Metro ', ''][s_suppkey % 4 + 1] || p_name AS stop_name,
           CAST(19.3 AS DOUBLE) + ((s_suppkey * 7919) % 400) * CAST(0.0001 AS DOUBLE) AS stop_lat,
           CAST(-99.2 AS DOUBLE) + ((s_suppkey * 104729) % 400) * CAST(0.0001 AS DOUBLE) AS stop_lon, CAST(s_suppkey AS BIGINT) AS stop_ordinal
    FROM supplier JOIN part ON s_suppkey = p_partkey
    UNION ALL SELECT CAST({FIRST_TERMINUS} + k AS VARCHAR), 'Terminal ' || upper(s[1]) || lower(s[2:]), 19.5 + CAST(0.01 AS DOUBLE) * k, -99.3, {FIRST_TERMINUS} + k FROM agencies
), dirty_stops AS (SELECT * FROM stops WHERE stop_ordinal % 10 <> 0),
frequencies AS (
    SELECT CAST(o_orderkey AS VARCHAR) AS trip_id, CAST(60 * (1 + o_orderkey % 30) AS INT) AS headway_secs FROM orders
    UNION ALL SELECT CAST(o_orderkey AS VARCHAR), CAST(60 * (1 + o_orderkey % 7) AS INT) FROM orders WHERE o_orderkey % 5 = 0
), dirty_frequencies AS (
    SELECT * FROM frequencies UNION ALL SELECT 'x' || o_orderkey, CAST(o_orderkey % 3 - 1 AS INT) FROM orders WHERE o_orderkey % 50 = 0
), agency AS (SELECT DISTINCT agency_id FROM routes WHERE agency_id <> 'MACHINERY'),
calendar AS (SELECT DISTINCT o_orderstatus AS service_id FROM orders WHERE o_orderstatus <> 'P'),
dirty_calendar_dates AS (SELECT DISTINCT o_orderstatus AS service_id FROM orders WHERE o_orderstatus = 'none'),
crosswalk AS (
    SELECT CAST(s_suppkey AS VARCHAR) AS stop_id, 'station_' || s_nationkey || '_0' AS station_id FROM supplier
    UNION ALL SELECT CAST({FIRST_TERMINUS} + k AS VARCHAR), 'station_' || (900 + k) || '_0' FROM agencies
),
capacities(agency_id, capacity_per_vehicle) AS (VALUES ('AUTOMOBILE', 1300), ('BUILDING', 80), ('FURNITURE', 160), ('HOUSEHOLD', 90)),
trip_agencies AS (SELECT trip_id, route_id, agency_id FROM trips LEFT JOIN routes USING (route_id)),
paired AS (
    SELECT trip_id, station_id AS source, lead(station_id) OVER w AS target, lead(arrival_time) OVER w - arrival_time AS travel_time_s
    FROM stop_times LEFT JOIN crosswalk USING (stop_id) WINDOW w AS (PARTITION BY trip_id ORDER BY stop_sequence)
), raw_edges AS (SELECT * FROM paired LEFT JOIN trip_agencies USING (trip_id) WHERE source <> target),
edge_sums AS (
    SELECT source, target, route_id, agency_id, avg(travel_time_s) AS avg_travel_time_s, count(DISTINCT trip_id) AS trip_count
    FROM raw_edges WHERE route_id IS NOT NULL AND agency_id IS NOT NULL GROUP BY ALL
), headways AS (
    SELECT route_id, min(headway_secs) AS headway_secs FROM frequencies LEFT JOIN trips USING (trip_id) WHERE route_id IS NOT NULL GROUP BY route_id
), service AS (SELECT edge_sums.*, headway_secs FROM edge_sums LEFT JOIN headways USING (route_id)),
stop_agencies AS (SELECT DISTINCT stop_id, agency_id FROM stop_times JOIN trip_agencies USING (trip_id) WHERE agency_id IS NOT NULL),
ends AS (SELECT source AS station_id, agency_id FROM service UNION SELECT target, agency_id FROM service),
spots AS (
    SELECT station_id, agency_id, avg(stop_lat) AS lat, avg(stop_lon) AS lon, arg_min(stop_name, stop_ordinal) AS stop_name
    FROM stops JOIN crosswalk USING (stop_id) JOIN stop_agencies USING (stop_id) GROUP BY station_id, agency_id
), nodes AS (SELECT station_id, agency_id, lat, lon, stop_name, station_id || '|' || agency_id AS node_id FROM ends LEFT JOIN spots USING (station_id, agency_id)),
transfers AS (
    SELECT a.node_id AS source, b.node_id AS target, a.station_id AS source_station, b.station_id AS target_station,
           2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2)
               + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lon) - radians(a.lon)) / 2), 2)))) AS distance_m
    FROM nodes a JOIN nodes b ON a.station_id = b.station_id AND a.agency_id <> b.agency_id
), edges AS (
    SELECT source || '|' || agency_id AS source, target || '|' || agency_id AS target, route_id, agency_id, avg_travel_time_s, trip_count, headway_secs,
           source AS source_station, target AS target_station, 'servicio' AS edge_type, CAST(NULL AS DOUBLE) AS distance_m FROM service
    UNION ALL SELECT source, target, NULL, NULL, distance_m / 1.3, NULL, NULL, source_station, target_station, 'transbordo', distance_m FROM transfers
)
"""
