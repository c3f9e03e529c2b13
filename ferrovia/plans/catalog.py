"""Every operator as a query over the sample feed, with its counterpart in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import haversine_m, seconds_of_day
from ..functions.text import normalize_name, token_sort_ratio
from ..operators import capacity, cascade, centrality, checks, flow, graph, spatial, stations, stats
from .sample_feed import SQL, sample_capacities, sample_crosswalk, sample_feed

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = f"WITH RECURSIVE {SQL} {sql}"
        return f

    return keep


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return graph.build_graph(sample_feed(spark, sf_dir), sample_crosswalk(spark, sf_dir), strict=False)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Sums of doubles depend on their order in the last digits."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _check_sql(name: str, bad: str, key: str, k: int = 5) -> str:
    return f""", bad AS ({bad})
SELECT '{name}' AS name, count(*) = 0 AS ok, count(*) AS n_bad,
       coalesce(array_to_string(list_slice(list_sort(list(DISTINCT CAST({key} AS VARCHAR))), 1, {k}), ', '), '') AS detail FROM bad"""


def _orphans(left: str, right: str, key: str) -> str:
    return f"SELECT DISTINCT {key} FROM {left} WHERE {key} IS NOT NULL AND {key} NOT IN (SELECT {key} FROM {right})"


def _on_dirty(check) -> Query:
    return lambda spark, sf_dir: check(sample_feed(spark, sf_dir, dirty=True))


_CHECKS = {
    "v01_orphan_stops": (checks.orphan_stops, _check_sql("stop_times.stop_id in stops", _orphans("dirty_times", "dirty_stops", "stop_id"), "stop_id")),
    "v02_orphan_routes": (checks.orphan_routes, _check_sql("trips.route_id in routes", _orphans("trips", "dirty_routes", "route_id"), "route_id")),
    "v03_orphan_services": (checks.orphan_services, _check_sql("trips.service_id in calendar", _orphans("trips", "calendar", "service_id"), "service_id", 10)),
    "v04_orphan_frequency_trips": (checks.orphan_frequency_trips, _check_sql("frequencies.trip_id in trips", _orphans("dirty_frequencies", "trips", "trip_id"), "trip_id")),
    "v06_stop_sequence": (checks.stop_sequence, _check_sql("stop_sequence rises strictly", "SELECT trip_id FROM dirty_times GROUP BY trip_id HAVING count(*) <> count(DISTINCT stop_sequence)", "trip_id")),
    "v07_positive_headways": (checks.positive_headways, _check_sql("headway_secs is positive", "SELECT * FROM dirty_frequencies WHERE headway_secs <= 0", "trip_id")),
    "v08_frequency_granularity": (
        checks.frequency_granularity,
        """, w AS (SELECT trip_id, count(*) AS n FROM dirty_frequencies GROUP BY trip_id), c AS (SELECT count(*) FILTER (n > 1) AS many, count(*) FILTER (n = 1) AS one FROM w)
SELECT 'windows by trip' AS name, true AS ok, many AS n_bad, many || ' several windows, ' || one || ' one (' || printf('%.1f', round(100.0 * many / (many + one), 1)) || '%)' AS detail FROM c""",
    ),
    "v09_route_type_consistency": (checks.route_type_consistency, _check_sql("one route_type by agency", "SELECT agency_id FROM dirty_routes GROUP BY agency_id HAVING count(DISTINCT route_type) > 1", "agency_id")),
    "v10_calendar_dates_present": (checks.calendar_dates_present, "SELECT 'calendar_dates has rows' AS name, count(*) > 0 AS ok, CAST(count(*) = 0 AS BIGINT) AS n_bad, '' AS detail FROM dirty_calendar_dates"),
    "v11_orphan_agencies": (checks.orphan_agencies, _check_sql("routes.agency_id in agency", _orphans("dirty_routes", "agency", "agency_id"), "agency_id")),
    "v12_trips_without_stop_times": (
        checks.trips_without_stop_times,
        """, expected AS (SELECT trip_id FROM trips UNION SELECT trip_id FROM dirty_frequencies),
missing AS (SELECT trip_id FROM expected WHERE trip_id NOT IN (SELECT trip_id FROM dirty_times)),
owned AS (SELECT m.trip_id, agency_id FROM missing m LEFT JOIN trips USING (trip_id) LEFT JOIN dirty_routes USING (route_id))
SELECT 'trips have stop_times' AS name, count(DISTINCT trip_id) = 0 AS ok, count(DISTINCT trip_id) AS n_bad,
       coalesce(array_to_string(list_slice(list_sort(list(DISTINCT trip_id)), 1, 5), ', '), '') || ' / '
       || coalesce(array_to_string(list_sort(list(DISTINCT agency_id) FILTER (agency_id IS NOT NULL)), ', '), '') AS detail FROM owned""",
    ),
}
for _name, (_check, _sql) in _CHECKS.items():
    _query(_name, _sql)(_on_dirty(_check))


@_query("v13_stations_without_transfer", _check_sql("shared stations have transfers", "SELECT station_id FROM nodes GROUP BY station_id HAVING count(DISTINCT agency_id) >= 2 AND station_id NOT IN (SELECT source_station FROM transfers WHERE distance_m > 100)", "station_id"))
def v13(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return checks.stations_without_transfer(nodes, edges.where("edge_type = 'transbordo' AND distance_m > 100"))


@_query("v14_sparse_routes", _check_sql("travel times within the limit", "SELECT * FROM service WHERE avg_travel_time_s > 3600", "route_id", 1000))
def v14(spark, sf_dir):
    return checks.sparse_routes(_graph(spark, sf_dir)[1].where("edge_type = 'servicio'"))


@_query("v15_unmapped_stop_times", "SELECT trip_id, stop_id FROM stop_times WHERE stop_id NOT IN (SELECT stop_id FROM crosswalk WHERE station_id NOT LIKE 'station_3%')")
def v15(spark, sf_dir):
    known = sample_crosswalk(spark, sf_dir).where("station_id NOT LIKE 'station_3%'")
    return graph.unmapped_stop_times(sample_feed(spark, sf_dir), known).select("trip_id", "stop_id")


@_query("v16_conflicting_overrides", "SELECT CAST(s_suppkey AS VARCHAR) AS stop_id, t AS target_station_id FROM supplier, (VALUES ('a'), ('b')) v(t) WHERE s_suppkey % 9 = 0 AND s_suppkey % 2 = 0")
def v16(spark, sf_dir):
    return stations.conflicting_overrides(_overrides(spark, sf_dir, clash=True))


@_query("v17_missing_headways", "SELECT source, target, route_id FROM edges WHERE edge_type = 'servicio' AND headway_secs IS NULL")
def v17(spark, sf_dir):
    return capacity.missing_headways(_graph(spark, sf_dir)[1]).select("source", "target", "route_id")


@_query("raw_service_edges", "SELECT trip_id, source, target, travel_time_s, route_id, agency_id FROM raw_edges")
def raw_service_edges(spark, sf_dir):
    return graph.raw_service_edges(sample_feed(spark, sf_dir), sample_crosswalk(spark, sf_dir), strict=False).select("trip_id", "source", "target", "travel_time_s", "route_id", "agency_id")


@_query("service_edges", "SELECT source, target, route_id, agency_id, round(avg_travel_time_s, 6) AS avg_travel_time_s, trip_count, headway_secs FROM service")
def service_edges(spark, sf_dir):
    feed = sample_feed(spark, sf_dir)
    edges = graph.attach_headway(graph.aggregate_edges(graph.raw_service_edges(feed, sample_crosswalk(spark, sf_dir), strict=False)), feed)
    return _rounded(edges, "avg_travel_time_s").select("source", "target", "route_id", "agency_id", "avg_travel_time_s", "trip_count", "headway_secs")


@_query("route_headway", "SELECT route_id, headway_secs FROM headways")
def route_headway(spark, sf_dir):
    return graph.route_headways(sample_feed(spark, sf_dir))


@_query("agencies_by_stop", "SELECT stop_id, array_to_string(list_sort(list(agency_id)), ',') AS agencies FROM stop_agencies GROUP BY stop_id")
def agencies_by_stop(spark, sf_dir):
    return graph.agencies_by_stop(sample_feed(spark, sf_dir)).withColumn("agencies", F.array_join("agencies", ","))


@_query("nodes", "SELECT station_id, agency_id, round(lat, 6) AS lat, round(lon, 6) AS lon, stop_name, node_id FROM nodes")
def nodes(spark, sf_dir):
    return _rounded(_graph(spark, sf_dir)[0], "lat", "lon")


@_query("transfer_edges", "SELECT source, target, source_station, target_station, round(distance_m, 3) AS distance_m, round(distance_m / 1.3, 3) AS avg_travel_time_s FROM transfers")
def transfer_edges(spark, sf_dir):
    edges = _graph(spark, sf_dir)[1].where("edge_type = 'transbordo'")
    return edges.select("source", "target", "source_station", "target_station", F.round("distance_m", 3).alias("distance_m"), F.round("avg_travel_time_s", 3).alias("avg_travel_time_s"))


@_query("all_edges", "SELECT source, target, route_id, agency_id, round(avg_travel_time_s, 3) AS avg_travel_time_s, trip_count, headway_secs, source_station, target_station, edge_type, round(distance_m, 3) AS distance_m FROM edges")
def all_edges(spark, sf_dir):
    return _graph(spark, sf_dir)[1].withColumns({c: F.round(c, 3) for c in ("avg_travel_time_s", "distance_m")})


_DEGREES = """, ends_of AS (SELECT source AS node_id, 'out_' || edge_type AS kind FROM edges UNION ALL SELECT target, 'in_' || edge_type FROM edges),
degrees AS (SELECT node_id, count(*) FILTER (kind = 'out_servicio') AS out_servicio, count(*) FILTER (kind = 'out_transbordo') AS out_transbordo,
    count(*) FILTER (kind = 'in_servicio') AS in_servicio, count(*) FILTER (kind = 'in_transbordo') AS in_transbordo FROM ends_of GROUP BY node_id),
node_degrees AS (SELECT node_id, station_id, agency_id, coalesce(out_servicio + in_servicio, 0) AS grado_servicio, coalesce(out_transbordo + in_transbordo, 0) AS grado_transbordo
    FROM nodes LEFT JOIN degrees USING (node_id))"""


@_query("degree_by_node", _DEGREES + " SELECT * FROM degrees")
def degree_by_node(spark, sf_dir):
    return stats.degree_by_node(_graph(spark, sf_dir)[1])


@_query(
    "degree_summary",
    _DEGREES + " SELECT agency_id, " + ", ".join(f"round_even(quantile_cont({c}, 0.5), 1) AS {c}_median, round_even(avg({c}), 1) AS {c}_mean, max({c}) AS {c}_max" for c in ("grado_servicio", "grado_transbordo")) + " FROM node_degrees GROUP BY agency_id",
)
def degree_summary(spark, sf_dir):
    return stats.degree_summary(*_graph(spark, sf_dir))


_NUMBERS = "count(v) AS count, round_even(avg(v), 1) AS mean, round_even(stddev_samp(v), 1) AS std, round_even(min(v), 1) AS min, round_even(quantile_cont(v, 0.25), 1) AS p25, round_even(quantile_cont(v, 0.5), 1) AS p50, round_even(quantile_cont(v, 0.75), 1) AS p75, round_even(max(v), 1) AS max"


@_query(
    "weight_summary",
    f""", w AS (SELECT 'service_time_s' AS weight, avg_travel_time_s AS v FROM edges WHERE edge_type = 'servicio'
UNION ALL SELECT 'transfer_time_s', avg_travel_time_s FROM edges WHERE edge_type = 'transbordo' UNION ALL SELECT 'transfer_distance_m', distance_m FROM edges WHERE edge_type = 'transbordo')
SELECT weight, {_NUMBERS} FROM w WHERE v IS NOT NULL GROUP BY weight""",
)
def weight_summary(spark, sf_dir):
    return stats.weight_summary(_graph(spark, sf_dir)[1])


@_query("headway_summary", "SELECT agency_id, count(headway_secs) AS count, round_even(avg(headway_secs), 1) AS mean, round_even(quantile_cont(headway_secs, 0.5), 1) AS p50, CAST(min(headway_secs) AS DOUBLE) AS min, CAST(max(headway_secs) AS DOUBLE) AS max FROM service WHERE headway_secs IS NOT NULL GROUP BY agency_id")
def headway_summary(spark, sf_dir):
    return stats.headway_summary(_graph(spark, sf_dir)[1])


_MATRIX = ", counts AS (SELECT split_part(source, '|', 2) AS source_agency, split_part(target, '|', 2) AS target_agency, count(*) AS n FROM transfers GROUP BY ALL)"


@_query("transfer_matrix_long", _MATRIX + " SELECT * FROM counts")
def transfer_matrix_long(spark, sf_dir):
    return stats.transfer_counts(_graph(spark, sf_dir)[1])


_AGENCIES = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@_query(
    "transfer_matrix",
    _MATRIX + " SELECT v.a AS source_agency, " + ", ".join(f"CAST(coalesce(sum(n) FILTER (target_agency = '{a}'), 0) AS BIGINT) AS {a}" for a in _AGENCIES) + " FROM (VALUES " + ", ".join(f"('{a}')" for a in _AGENCIES) + ") v(a) LEFT JOIN counts ON source_agency = v.a GROUP BY v.a",
)
def transfer_matrix(spark, sf_dir):
    return stats.transfer_matrix(_graph(spark, sf_dir)[1], list(_AGENCIES))


@_query(
    "transfer_margins",
    _MATRIX
    + """, o AS (SELECT source_agency AS agency, CAST(sum(n) AS BIGINT) AS outgoing FROM counts GROUP BY 1), i AS (SELECT target_agency AS agency, CAST(sum(n) AS BIGINT) AS incoming FROM counts GROUP BY 1)
SELECT agency, outgoing, incoming, outgoing + incoming AS total_both_directions FROM o FULL JOIN i USING (agency)""",
)
def transfer_margins(spark, sf_dir):
    return stats.transfer_margins(_graph(spark, sf_dir)[1])


@_query("edge_counts", "SELECT agency_id, count(*) FILTER (edge_type = 'servicio') AS servicio, count(*) FILTER (edge_type = 'transbordo') AS transbordo FROM edges WHERE agency_id IS NOT NULL GROUP BY agency_id")
def edge_counts(spark, sf_dir):
    return stats.edge_counts(_graph(spark, sf_dir)[1])


@_query("edge_counts_attributed", "SELECT coalesce(agency_id, split_part(source, '|', 2)) AS agency_id, count(*) FILTER (edge_type = 'servicio') AS servicio, count(*) FILTER (edge_type = 'transbordo') AS transbordo FROM edges GROUP BY 1")
def edge_counts_attributed(spark, sf_dir):
    return stats.edge_counts(_graph(spark, sf_dir)[1], attribute_transfers=True)


def _histogram_sql(source: str, column: str, by: str, bins: int) -> str:
    return f""", hv AS (SELECT {by} AS g, CAST({column} AS DOUBLE) AS x FROM {source} WHERE {column} IS NOT NULL),
hr AS (SELECT g, CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS low, CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS high FROM hv GROUP BY g),
hc AS (SELECT g, CAST(least(floor((x - low) * {bins} / (high - low)), {bins - 1}) AS INT) AS bin, count(*) AS n FROM hv JOIN hr USING (g) GROUP BY ALL),
hist AS (SELECT g AS {by}, CAST(b.bin AS INT) AS bin, round(low + b.bin * (high - low) / {bins}, 3) AS bin_start, coalesce(n, 0) AS n
    FROM hr CROSS JOIN (SELECT unnest(range(0, {bins})) AS bin) b LEFT JOIN hc USING (g, bin))"""


@_query(
    "hist_degree",
    _DEGREES + _histogram_sql("node_degrees", "grado_servicio", "agency_id", 15) + " SELECT hist.*, m.median, m.n_nodes FROM hist JOIN (SELECT agency_id, quantile_cont(grado_servicio, 0.5) AS median, count(*) AS n_nodes FROM node_degrees GROUP BY agency_id) m USING (agency_id)",
)
def hist_degree(spark, sf_dir):
    return stats.degree_histogram(*_graph(spark, sf_dir)).withColumn("bin_start", F.round("bin_start", 3))


@_query("hist_travel_time", _histogram_sql("(SELECT edge_type, round(avg_travel_time_s, 3) AS t FROM edges)", "t", "edge_type", 30) + " SELECT * FROM hist")
def hist_travel_time(spark, sf_dir):
    edges = _graph(spark, sf_dir)[1].withColumn("avg_travel_time_s", F.round("avg_travel_time_s", 3))
    return stats.travel_time_histogram(edges).withColumn("bin_start", F.round("bin_start", 3))


@_query(
    "box_headway",
    """, h AS (SELECT agency_id, CAST(headway_secs AS DOUBLE) AS h FROM service WHERE headway_secs IS NOT NULL),
q AS (SELECT agency_id, quantile_cont(h, 0.25) AS q1, quantile_cont(h, 0.5) AS q2, quantile_cont(h, 0.75) AS q3 FROM h GROUP BY agency_id),
f AS (SELECT *, h BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM h JOIN q USING (agency_id))
SELECT agency_id, q1, q2, q3, min(h) FILTER (inside) AS whisker_low, max(h) FILTER (inside) AS whisker_high, count(*) FILTER (NOT inside) AS n_outliers FROM f GROUP BY agency_id, q1, q2, q3""",
)
def box_headway(spark, sf_dir):
    return stats.headway_boxes(_graph(spark, sf_dir)[1])


@_query(
    "map_markers",
    f""", shared AS (SELECT station_id FROM nodes GROUP BY station_id HAVING count(DISTINCT agency_id) >= 2),
colors AS (SELECT agency_id, [{", ".join(f"'{c}'" for c in stats.PALETTE)}][(row_number() OVER (ORDER BY agency_id) - 1) % 10 + 1] AS color FROM (SELECT DISTINCT agency_id FROM nodes))
SELECT node_id, round(lat, 6) AS lat, round(lon, 6) AS lon, color, CASE WHEN s THEN 8 ELSE 5 END AS radius, CASE WHEN s THEN 3 ELSE 1 END AS weight, CAST(CASE WHEN s THEN 0.8 ELSE 0.6 END AS DOUBLE) AS opacity,
       '<b>' || station_id || '</b><br>Agency: ' || agency_id || '<br>Stop: ' || coalesce(stop_name, 'None') AS popup
FROM (SELECT *, station_id IN (SELECT station_id FROM shared) AS s FROM nodes) JOIN colors USING (agency_id)""",
)
def map_markers(spark, sf_dir):
    return _rounded(stats.map_markers(_graph(spark, sf_dir)[0]), "lat", "lon")


@_query("map_center", "SELECT round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, 11 AS zoom FROM nodes")
def map_center(spark, sf_dir):
    return _rounded(stats.map_center(_graph(spark, sf_dir)[0]), "lat", "lon")


@_query("transfer_stations", "SELECT station_id, count(DISTINCT agency_id) AS n_agencies FROM nodes GROUP BY station_id HAVING count(DISTINCT agency_id) >= 2")
def transfer_stations(spark, sf_dir):
    return graph.transfer_stations(_graph(spark, sf_dir)[0])


_NEAR = """, near AS (SELECT a.stop_ordinal AS a, b.stop_ordinal AS b, 2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin((radians(b.stop_lat) - radians(a.stop_lat)) / 2), 2)
    + cos(radians(a.stop_lat)) * cos(radians(b.stop_lat)) * pow(sin((radians(b.stop_lon) - radians(a.stop_lon)) / 2), 2)))) AS distance_m
    FROM stops a JOIN stops b ON a.stop_ordinal < b.stop_ordinal AND abs(a.stop_lat - b.stop_lat) < 0.002)"""
_CLUSTERS = """, walked(k, r) AS (SELECT stop_ordinal, stop_ordinal FROM stops UNION SELECT l.y, w.r FROM walked w JOIN (SELECT a AS x, b AS y FROM near WHERE distance_m <= 150 UNION ALL SELECT b, a FROM near WHERE distance_m <= 150) l ON l.x = w.k),
roots AS (SELECT k, min(r) AS root FROM walked GROUP BY k), clusters AS (SELECT k, dense_rank() OVER (ORDER BY root) - 1 AS geo_cluster FROM roots)"""


@_query("haversine_pairs", _NEAR + " SELECT a, b, round(distance_m, 3) AS distance_m FROM near WHERE distance_m <= 150")
def haversine_pairs(spark, sf_dir):
    return spatial.radius_pairs(sample_feed(spark, sf_dir).stops, "stop_ordinal").withColumn("distance_m", F.round("distance_m", 3))


@_query("geo_clusters", _NEAR + _CLUSTERS + " SELECT CAST(k AS VARCHAR) AS stop_id, geo_cluster FROM clusters")
def geo_clusters(spark, sf_dir):
    return stations.geographic_clusters(sample_feed(spark, sf_dir).stops).select("stop_id", "geo_cluster")


@_query("normalize_name", "SELECT stop_id, regexp_replace(lower(trim(stop_name)), '^(?:(?:c\\. c\\. metro |c\\.c\\. metro |cetram metro |base metro |base cetram |mb |metro |base |cetram )\\s*)+', '') AS name FROM stops")
def names(spark, sf_dir):
    return sample_feed(spark, sf_dir).stops.select("stop_id", normalize_name(F.col("stop_name")).alias("name"))


def _ratio_sql(pairs: str) -> str:
    """ratios(a, b, ratio) of the pairs (a, b) of names: the longest common subsequence as a row of bits, a character at a time."""
    tokens = "array_to_string(list_sort(list_filter(string_split_regex({0}, '\\s+'), lambda t: t <> '')), ' ')"
    bits = "(CAST(1 AS HUGEINT) << len(y)) - 1"
    met = "s & coalesce(list_sum(list_transform(range(1, len(y) + 1), lambda k: CASE WHEN y[k] = x[i + 1] THEN CAST(1 AS HUGEINT) << CAST(k - 1 AS INT) ELSE CAST(0 AS HUGEINT) END)), 0)"
    return f""", asked AS ({pairs}), sorted_names AS (SELECT DISTINCT {tokens.format("a")} AS x, {tokens.format("b")} AS y FROM asked),
lcs(x, y, i, s) AS (SELECT x, y, 0, {bits} FROM sorted_names
    UNION ALL SELECT x, y, i + 1, ((s + u) | (s - u)) & ({bits}) FROM (SELECT x, y, i, s, {met} AS u FROM lcs WHERE i < len(x))),
ratios AS (SELECT a, b, CASE WHEN len(x) + len(y) = 0 THEN 100.0 ELSE 200.0 * (len(y) - bit_count(s)) / (len(x) + len(y)) END AS ratio
    FROM asked JOIN lcs ON x = {tokens.format("a")} AND y = {tokens.format("b")} WHERE i = len(x))"""


_NAME = "regexp_replace(lower(trim(stop_name)), '^(?:(?:c\\. c\\. metro |c\\.c\\. metro |cetram metro |base metro |base cetram |mb |metro |base |cetram )\\s*)+', '')"


@_query("token_sort_ratio", f", n AS (SELECT DISTINCT {_NAME} AS name FROM stops)" + _ratio_sql("SELECT p.name AS a, q.name AS b FROM n p JOIN n q ON split_part(p.name, ' ', 1) = split_part(q.name, ' ', 1)") + " SELECT a, b, round(ratio, 6) AS ratio FROM ratios")
def name_similarity(spark, sf_dir):
    n = sample_feed(spark, sf_dir).stops.select(normalize_name(F.col("stop_name")).alias("a")).distinct()
    pairs = n.join(n.withColumnRenamed("a", "b"), F.split_part("a", F.lit(" "), F.lit(1)) == F.split_part("b", F.lit(" "), F.lit(1)))
    return pairs.select("a", "b", F.round(token_sort_ratio(F.col("a"), F.col("b")), 6).alias("ratio"))


@_query(
    "crosswalk",
    _NEAR
    + _CLUSTERS
    + f", named AS (SELECT stop_id, stop_name, stop_ordinal, {_NAME} AS name FROM stops)"
    + _ratio_sql("SELECT DISTINCT p.name AS a, q.name AS b FROM near JOIN named p ON p.stop_ordinal = near.a JOIN named q ON q.stop_ordinal = near.b WHERE distance_m <= 150")
    + """, alike AS (SELECT near.a AS x, near.b AS y FROM near JOIN named p ON p.stop_ordinal = near.a JOIN named q ON q.stop_ordinal = near.b JOIN ratios r ON r.a = p.name AND r.b = q.name WHERE distance_m <= 150 AND ratio >= 85),
joined(k, r) AS (SELECT stop_ordinal, stop_ordinal FROM stops UNION SELECT l.y, j.r FROM joined j JOIN (SELECT x, y FROM alike UNION ALL SELECT y, x FROM alike) l ON l.x = j.k),
stations AS (SELECT k, min(r) AS station FROM joined GROUP BY k)
SELECT stop_id, stop_name, 'station_' || geo_cluster || '_' || (dense_rank() OVER (PARTITION BY geo_cluster ORDER BY station) - 1) AS station_id, geo_cluster
FROM named JOIN clusters ON clusters.k = stop_ordinal JOIN stations ON stations.k = stop_ordinal""",
)
def crosswalk(spark, sf_dir):
    return stations.build_crosswalk(sample_feed(spark, sf_dir).stops)


def _overrides(spark: SparkSession, sf_dir: str, clash: bool = False) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_suppkey % 9 = 0").select(F.col("s_suppkey").cast("string").alias("stop_id"), F.lit("a").alias("target_station_id"))
    return s.union(s.where("stop_id % 2 = 0").select("stop_id", F.lit("b"))) if clash else s


@_query("override_apply", "SELECT stop_id, stop_name, CASE WHEN stop_ordinal % 9 = 0 THEN 'a' ELSE station_id END AS station_id FROM stops JOIN crosswalk USING (stop_id)")
def override_apply(spark, sf_dir):
    stops = sample_feed(spark, sf_dir).stops.select("stop_id", "stop_name", F.lit(0).alias("geo_cluster"))
    return stations.apply_overrides(stops.join(sample_crosswalk(spark, sf_dir), "stop_id"), _overrides(spark, sf_dir)).drop("geo_cluster")


@_query(
    "override_candidates",
    """, cw AS (SELECT stop_id, stop_name, station_id, CAST(stop_ordinal % 13 AS INT) AS geo_cluster FROM stops JOIN crosswalk USING (stop_id))
SELECT geo_cluster, count(DISTINCT stop_id) AS n_stops, count(DISTINCT station_id) AS n_station_ids_tras_paso2, count(DISTINCT agency_id) AS n_agencias,
       array_to_string(list_sort(list(DISTINCT agency_id) FILTER (agency_id IS NOT NULL)), ',') AS agencias, array_to_string(list_sort(list(DISTINCT stop_name)), ',') AS nombres
FROM cw LEFT JOIN stop_agencies USING (stop_id) GROUP BY geo_cluster HAVING count(DISTINCT station_id) > 1 AND count(DISTINCT agency_id) > 1""",
)
def override_candidates(spark, sf_dir):
    feed = sample_feed(spark, sf_dir)
    cw = feed.stops.join(sample_crosswalk(spark, sf_dir), "stop_id").select("stop_id", "stop_name", "station_id", (F.col("stop_ordinal") % 13).cast("int").alias("geo_cluster"))
    return stations.override_candidates(cw, graph.stop_agencies(feed)).withColumns({c: F.array_join(c, ",") for c in ("agencias", "nombres")})


@_query("capacity_table", "SELECT * FROM (VALUES " + ", ".join(f"('{a}', {n}, '{capacity.NOTES[a]}')" for a, n in capacity.CAPACITY_PER_VEHICLE.items()) + ") t(agency_id, capacity_per_vehicle, note)")
def capacity_table(spark, sf_dir):
    return capacity.capacity_table(spark)


_CAPACITY = ", capacity AS (SELECT source AS node_id, round_even(coalesce(sum(3600.0 / headway_secs * capacity_per_vehicle), 0.0), 1) AS C_i FROM edges LEFT JOIN capacities USING (agency_id) WHERE edge_type = 'servicio' GROUP BY source)"


@_query("node_capacity", _CAPACITY + " SELECT * FROM capacity")
def node_capacity(spark, sf_dir):
    return capacity.node_capacity(_graph(spark, sf_dir)[1], sample_capacities(spark))


@_query("node_capacity_top10", _CAPACITY + " SELECT * FROM capacity ORDER BY C_i DESC, node_id LIMIT 10")
def node_capacity_top10(spark, sf_dir):
    return stats.top(node_capacity(spark, sf_dir), "C_i")


@_query("node_capacity_stats", _CAPACITY + " SELECT min(C_i) AS min, max(C_i) AS max, round(avg(C_i), 6) AS mean, count(*) FILTER (C_i > 0) AS n_positive, count(*) AS n FROM capacity")
def node_capacity_stats(spark, sf_dir):
    return _rounded(stats.column_stats(node_capacity(spark, sf_dir), "C_i"), "mean")


@_query("node_capacity_ranks", _CAPACITY + " SELECT node_id, C_i, CAST(rank() OVER (ORDER BY C_i DESC) AS INT) AS rank FROM capacity")
def node_capacity_ranks(spark, sf_dir):
    return stats.ranked(node_capacity(spark, sf_dir), "C_i")


_PROBS = ", w AS (SELECT source AS src, target AS dst, sum(3600.0 / headway_secs) AS w FROM edges WHERE edge_type = 'servicio' GROUP BY ALL), probs AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM w)"


@_query("transition_probs", _PROBS + " SELECT src, dst, round(p, 6) AS p FROM probs")
def transition_probs(spark, sf_dir):
    return _rounded(flow.transition_probs(_graph(spark, sf_dir)[1]), "p")


def _walk_sql(damping: float, steps: int) -> str:
    """settled(node_id, x): the walk's shares after so many steps, each a product with the whole matrix; scaled once, in the end."""
    return (
        _PROBS
        + f""", whole AS (SELECT count(*) AS n FROM nodes),
dense AS (SELECT a.node_id AS s, b.node_id AS d, {damping} * coalesce(p, 0.0) + (1 - {damping}) / n AS m FROM nodes a CROSS JOIN nodes b CROSS JOIN whole LEFT JOIN probs ON src = a.node_id AND dst = b.node_id),
walk(k, node_id, x) AS (SELECT 0, node_id, CAST(1 AS DOUBLE) FROM nodes UNION ALL SELECT k + 1, d, sum(x * m) FROM walk JOIN dense ON s = node_id WHERE k < {steps} GROUP BY k, d),
settled AS (SELECT node_id, x / sum(x) OVER () AS x FROM walk WHERE k = {steps})"""
    )


@_query("flow_load", _walk_sql(0.85, 200) + " SELECT node_id, round(x, 8) AS L_i_flujo, true AS converged FROM settled")
def flow_load(spark, sf_dir):
    nodes_, edges = _graph(spark, sf_dir)
    return flow.stationary_flow(edges, nodes_).select("node_id", F.round("L_i_flujo", 8).alias("L_i_flujo"), "converged")


@_query("flow_load_undamped", _walk_sql(1.0, 600) + " SELECT node_id, round(x, 6) AS L_i_flujo, true AS converged FROM settled")
def flow_load_undamped(spark, sf_dir):
    nodes_, edges = _graph(spark, sf_dir)
    return flow.stationary_flow(edges, nodes_, damping=1.0, tol=1e-10, max_iter=5000).select("node_id", F.round("L_i_flujo", 6).alias("L_i_flujo"), "converged")


def _betweenness_sql(k: int) -> str:
    """Walks of least length between two nodes are their shortest paths; those through a node are products of two."""
    return f""", arcs AS (SELECT DISTINCT source AS src, target AS dst FROM edges WHERE edge_type = 'servicio' AND source <> target),
roots AS (SELECT node_id FROM nodes ORDER BY md5(node_id || ':0'), node_id LIMIT {k}), n AS (SELECT count(*) AS n FROM nodes), used AS (SELECT count(*) AS used FROM roots),
walks(root, v, k, ways) AS (SELECT node_id, node_id, 0, CAST(1 AS DOUBLE) FROM nodes UNION ALL SELECT root, dst, k + 1, sum(ways) FROM walks JOIN arcs ON src = v WHERE k < 10 GROUP BY root, dst, k),
paths AS (SELECT root, v, min(k) AS d, arg_min(ways, k) AS ways FROM walks GROUP BY root, v),
shares AS (SELECT a.v AS node_id, sum(a.ways * b.ways / c.ways) AS x FROM roots r JOIN paths a ON a.root = r.node_id JOIN paths b ON b.root = a.v JOIN paths c ON c.root = r.node_id AND c.v = b.v AND c.d = a.d + b.d
    WHERE a.v <> r.node_id AND b.v <> a.v GROUP BY a.v)
SELECT node_id, round(coalesce(x, 0.0) * n / used / ((n - 1) * (n - 2)), 9) AS L_i_topo FROM nodes LEFT JOIN shares USING (node_id) CROSS JOIN n CROSS JOIN used"""


@_query("betweenness", _betweenness_sql(20))
def betweenness(spark, sf_dir):
    """From 20 pivots, fewer than there are nodes."""
    nodes_, edges = _graph(spark, sf_dir)
    return centrality.betweenness(edges, nodes_, k=20).withColumn("L_i_topo", F.round("L_i_topo", 9))


@_query("betweenness_exact", _betweenness_sql(1_000_000))
def betweenness_exact(spark, sf_dir):
    nodes_, edges = _graph(spark, sf_dir)
    return centrality.betweenness(edges, nodes_, k=None).withColumn("L_i_topo", F.round("L_i_topo", 9))


_WEAK = """, links AS (SELECT source AS x, target AS y FROM edges UNION ALL SELECT target, source FROM edges),
spread(k, r) AS (SELECT node_id, node_id FROM nodes UNION SELECT y, r FROM spread JOIN links ON x = k), heads AS (SELECT k AS node_id, min(r) AS component FROM spread GROUP BY k)"""


@_query("components", _WEAK + " SELECT node_id, component FROM heads")
def components(spark, sf_dir):
    nodes_, edges = _graph(spark, sf_dir)
    return centrality.node_components(edges, nodes_)


@_query("component_sizes", _WEAK + " SELECT component, count(*) AS n_nodes, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share FROM heads GROUP BY component")
def component_sizes(spark, sf_dir):
    nodes_, edges = _graph(spark, sf_dir)
    return centrality.component_sizes(edges, nodes_)


@_query("alpha_sweep")
def alpha_sweep(spark, sf_dir):
    nodes_, edges = _graph(spark, sf_dir)
    walked = flow.stationary_flow(edges, nodes_).select("node_id", F.col("L_i_flujo").alias("load"))
    seeds = stats.top(walked, "load", 3).select("node_id", F.lit("dirigido").alias("tipo_ataque")).union(centrality.pivots(nodes_, 3).select("node_id", F.lit("aleatorio")))
    weights = flow.transition_probs(edges).withColumnRenamed("p", "w")
    return cascade.alpha_sweep(weights, walked.select("node_id", F.lit("flujo").alias("variante_carga"), "load"), walked.select("node_id", F.col("load").alias("x")), seeds)


@_query("scalar_functions", "SELECT stop_id, round(2 * 6371000.0 * asin(sqrt(pow(sin((radians(19.4) - radians(stop_lat)) / 2), 2) + cos(radians(stop_lat)) * cos(radians(19.4)) * pow(sin((radians(-99.1) - radians(stop_lon)) / 2), 2))), 3) AS to_center_m, CAST((stop_ordinal + 20) * 3600 + (stop_ordinal % 60) * 60 + 5 AS DOUBLE) AS seconds FROM stops")
def scalar_functions(spark, sf_dir):
    stops = sample_feed(spark, sf_dir).stops
    clock = F.concat((F.col("stop_ordinal") + 20).cast("string"), F.lit(":"), F.lpad((F.col("stop_ordinal") % 60).cast("string"), 2, "0"), F.lit(":05"))
    away = haversine_m(F.col("stop_lat"), F.col("stop_lon"), F.lit(19.4), F.lit(-99.1))
    return stops.select("stop_id", F.round(away, 3).alias("to_center_m"), seconds_of_day(clock).alias("seconds"))


@_query("blocking_checks", " UNION ALL ".join(f"SELECT * FROM (WITH {_CHECKS[n][1][2:]})" for n in ("v01_orphan_stops", "v02_orphan_routes", "v03_orphan_services", "v04_orphan_frequency_trips", "v06_stop_sequence", "v07_positive_headways")))
def blocking_checks(spark, sf_dir):
    return checks.run_checks(sample_feed(spark, sf_dir, dirty=True))


@_query("v18_flow_distribution", _walk_sql(0.85, 200) + " SELECT 'shares sum to 1' AS name, abs(sum(x) - 1) < 1e-6 AND count(*) FILTER (x < 0) = 0 AS ok, count(*) FILTER (x < 0) AS n_bad FROM settled")
def v18(spark, sf_dir):
    nodes_, edges = _graph(spark, sf_dir)
    return flow.distribution_check(flow.stationary_flow(edges, nodes_)).drop("detail")


@_query("pruned_feed", ", kept AS (SELECT trip_id FROM trips WHERE route_id IN (SELECT route_id FROM dirty_routes) AND service_id IN (SELECT service_id FROM calendar)) SELECT trip_id, stop_id, stop_sequence FROM dirty_times WHERE trip_id IN (SELECT trip_id FROM kept)")
def pruned_feed(spark, sf_dir):
    return sample_feed(spark, sf_dir, dirty=True).pruned().stop_times.select("trip_id", "stop_id", "stop_sequence")


@_query("transition_probs_biased", ", w AS (SELECT source AS src, target AS dst, pow(sum(3600.0 / headway_secs), 0.5) AS w FROM edges WHERE edge_type = 'servicio' GROUP BY ALL) SELECT src, dst, round(w / sum(w) OVER (PARTITION BY src), 6) AS p FROM w")
def transition_probs_biased(spark, sf_dir):
    return _rounded(flow.transition_probs(_graph(spark, sf_dir)[1], beta=0.5), "p")


@_query("service_components", _WEAK.replace("FROM edges", "FROM edges WHERE edge_type = 'servicio'") + " SELECT node_id, component FROM heads")
def service_components(spark, sf_dir):
    nodes_, edges = _graph(spark, sf_dir)
    return centrality.node_components(edges, nodes_, service_only=True)


@_query("spot_check", _CAPACITY + ", r AS (SELECT *, rank() OVER (ORDER BY C_i DESC) AS rank FROM capacity) SELECT v.n AS node_id, C_i, rank FROM (VALUES ('station_0_0|AUTOMOBILE'), ('station_7_0|FURNITURE'), ('nowhere')) v(n) LEFT JOIN r ON r.node_id = v.n")
def spot_check(spark, sf_dir):
    return stats.rank_of(node_capacity(spark, sf_dir), "C_i", ["station_0_0|AUTOMOBILE", "station_7_0|FURNITURE", "nowhere"])


@_query("degree_stats", _DEGREES + " SELECT min(grado_servicio) FILTER (grado_servicio > 0) AS min, max(grado_servicio) AS max, round(avg(grado_servicio), 6) AS mean, count(*) FILTER (grado_servicio > 0) AS n_positive, count(*) AS n FROM node_degrees")
def degree_stats(spark, sf_dir):
    return _rounded(stats.column_stats(stats.node_degrees(*_graph(spark, sf_dir)), "grado_servicio", positive_min=True), "mean")
