"""Descriptive statistics of the graph, and the tables behind its charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import stash
from .graph import SERVICE, TRANSFER, agency_of, transfer_stations
from .ordering import placed

DEGREES = ("out_servicio", "out_transbordo", "in_servicio", "in_transbordo")

#: Colours of agencies in alphabetical order, over again after the last.
PALETTE = ("#1f77b4", "#ff7f0e", "#2ca02c", "#d62728", "#9467bd", "#8c564b", "#e377c2", "#7f7f7f", "#bcbd22", "#17becf")


def _service(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("edge_type") == SERVICE)


def degree_by_node(edges: DataFrame) -> DataFrame:
    """Edges out of and into each node that has any, by kind."""
    end = lambda c, way: edges.select(F.col(c).alias("node_id"), F.concat(F.lit(way), F.col("edge_type")).alias("kind"))
    return end("source", "out_").union(end("target", "in_")).groupBy("node_id").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in DEGREES))


def node_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """grado_servicio and grado_transbordo of every node, 0 without edges."""
    joined = nodes.join(degree_by_node(edges), "node_id", "left").na.fill(0, list(DEGREES))
    return joined.select("node_id", "station_id", "agency_id", (F.col("out_servicio") + F.col("in_servicio")).alias("grado_servicio"), (F.col("out_transbordo") + F.col("in_transbordo")).alias("grado_transbordo"))


def degree_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Median, mean and largest degree by agency, to one decimal."""
    stats = [f(c).alias(f"{c}_{name}") for c in ("grado_servicio", "grado_transbordo") for name, f in (("median", lambda c: F.bround(F.median(c), 1)), ("mean", lambda c: F.bround(F.avg(c), 1)), ("max", F.max))]
    return node_degrees(nodes, edges).groupBy("agency_id").agg(*stats)


def describe(values: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Count, mean, sample deviation, least, quartiles and largest, to one decimal; nulls are skipped."""
    q = F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    found = values.where(F.col(column).isNotNull()).groupBy(*by).agg(F.count(column).alias("count"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min"), q.alias("q"), F.max(column).alias("max"))
    r = lambda c, name: F.bround(c.cast("double"), 1).alias(name)
    return found.select(*by, "count", r(F.col("mean"), "mean"), r(F.col("std"), "std"), r(F.col("min"), "min"), r(F.get("q", 0), "p25"), r(F.get("q", 1), "p50"), r(F.get("q", 2), "p75"), r(F.col("max"), "max"))


def weight_summary(edges: DataFrame) -> DataFrame:
    """The eight numbers of service time, transfer time and transfer distance."""
    time, transfer = F.col("avg_travel_time_s"), F.col("edge_type") == TRANSFER
    long = edges.select(F.explode(F.array(F.struct(F.when(transfer, "transfer_time_s").otherwise("service_time_s").alias("weight"), time.alias("v")), F.struct(F.when(transfer, "transfer_distance_m").alias("weight"), F.col("distance_m").alias("v")))).alias("x"))
    return describe(long.select("x.weight", "x.v").where("weight IS NOT NULL"), "v", ["weight"])


def headway_summary(edges: DataFrame) -> DataFrame:
    found = _service(edges).where("headway_secs IS NOT NULL AND agency_id IS NOT NULL").groupBy("agency_id")
    r = lambda c: F.bround(c.cast("double"), 1)
    return found.agg(F.count("headway_secs").alias("count"), r(F.avg("headway_secs")).alias("mean"), r(F.median("headway_secs")).alias("p50"), r(F.min("headway_secs")).alias("min"), r(F.max("headway_secs")).alias("max"))


def transfer_counts(edges: DataFrame) -> DataFrame:
    """Transfer edges by (source_agency, target_agency): the matrix in long form."""
    return edges.where(F.col("edge_type") == TRANSFER).groupBy(agency_of(F.col("source")).alias("source_agency"), agency_of(F.col("target")).alias("target_agency")).agg(F.count("*").alias("n"))


def transfer_matrix(edges: DataFrame, agencies: list[str] | None = None) -> DataFrame:
    """A row for each source agency and a column for each target agency, 0 where none; only those that occur unless ``agencies`` are given."""
    wide = transfer_counts(edges).groupBy("source_agency").pivot("target_agency", agencies).agg(F.sum("n")).na.fill(0)
    if agencies:
        rows = edges.sparkSession.createDataFrame([(a,) for a in agencies], "source_agency string")
        wide = rows.join(wide, "source_agency", "left").na.fill(0)
    return wide.orderBy("source_agency")


def transfer_margins(edges: DataFrame) -> DataFrame:
    counts = transfer_counts(edges)
    out = counts.groupBy(F.col("source_agency").alias("agency")).agg(F.sum("n").alias("outgoing"))
    into = counts.groupBy(F.col("target_agency").alias("agency")).agg(F.sum("n").alias("incoming"))
    return out.join(into, "agency", "full").withColumn("total_both_directions", F.col("outgoing") + F.col("incoming"))


def edge_counts(edges: DataFrame, attribute_transfers: bool = False) -> DataFrame:
    """Edges by agency and kind. Transfers have no agency of their own and aren't counted unless the source's is taken."""
    agency = F.coalesce("agency_id", agency_of(F.col("source"))) if attribute_transfers else F.col("agency_id")
    kept = edges.select(agency.alias("agency_id"), "edge_type").where("agency_id IS NOT NULL")
    return kept.groupBy("agency_id").agg(*(F.count_if(F.col("edge_type") == k).alias(k) for k in (SERVICE, TRANSFER)))


def histogram(values: DataFrame, column: str, by: str, bins: int) -> DataFrame:
    """Counts in equal bins over each group's range, the last one closed; equal values get a range of one around them."""
    x = F.col(column).cast("double")
    known = values.where(x.isNotNull()).select(by, x.alias("x"))
    ends = known.groupBy(by).agg(F.min("x").alias("a"), F.max("x").alias("b"))
    flat = F.col("a") == F.col("b")
    ends = ends.select(by, F.when(flat, F.col("a") - 0.5).otherwise(F.col("a")).alias("low"), F.when(flat, F.col("b") + 0.5).otherwise(F.col("b")).alias("high"))
    bin_of = F.least(F.floor((F.col("x") - F.col("low")) * bins / (F.col("high") - F.col("low"))), F.lit(bins - 1)).cast("int")
    counted = known.join(ends, by).groupBy(by, bin_of.alias("bin")).agg(F.count("*").alias("n"))
    every = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    width = (F.col("high") - F.col("low")) / bins
    return every.join(counted, [by, "bin"], "left").select(by, "bin", (F.col("low") + F.col("bin") * width).alias("bin_start"), F.coalesce("n", F.lit(0)).alias("n"))


def degree_histogram(nodes: DataFrame, edges: DataFrame, bins: int = 15) -> DataFrame:
    degrees = stash(node_degrees(nodes, edges), "degrees")
    middle = degrees.groupBy("agency_id").agg(F.median("grado_servicio").alias("median"), F.count("*").alias("n_nodes"))
    return histogram(degrees, "grado_servicio", "agency_id", bins).join(middle, "agency_id")


def travel_time_histogram(edges: DataFrame, bins: int = 30) -> DataFrame:
    return histogram(edges, "avg_travel_time_s", "edge_type", bins)


def headway_boxes(edges: DataFrame) -> DataFrame:
    """Quartiles, whiskers at the last values within 1.5 quartile ranges, and outliers of headways by agency."""
    known = _service(edges).where("headway_secs IS NOT NULL AND agency_id IS NOT NULL").select("agency_id", F.col("headway_secs").cast("double").alias("h"))
    q = F.percentile("h", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    boxes = known.groupBy("agency_id").agg(q.alias("q")).select("agency_id", F.get("q", 0).alias("q1"), F.get("q", 1).alias("q2"), F.get("q", 2).alias("q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("h") >= F.col("q1") - reach) & (F.col("h") <= F.col("q3") + reach)
    return known.join(boxes, "agency_id").groupBy("agency_id", "q1", "q2", "q3").agg(F.min(F.when(inside, F.col("h"))).alias("whisker_low"), F.max(F.when(inside, F.col("h"))).alias("whisker_high"), F.count_if(~inside).alias("n_outliers"))


def agency_colors(nodes: DataFrame) -> DataFrame:
    """A colour for each agency; agencies are few, one task ranks them."""
    agencies = nodes.select("agency_id").where("agency_id IS NOT NULL").distinct()
    place = F.row_number().over(Window.orderBy("agency_id")) - 1
    return agencies.select("agency_id", F.get(F.array(*map(F.lit, PALETTE)), place % len(PALETTE)).alias("color"))


def map_markers(nodes: DataFrame) -> DataFrame:
    """How each node is drawn: transfer stations larger and stronger, agencies by colour."""
    shared = transfer_stations(nodes).select("station_id", F.lit(True).alias("shared"))
    drawn = nodes.join(shared, "station_id", "left").join(agency_colors(nodes), "agency_id")
    pick = lambda a, b: F.when(F.col("shared"), a).otherwise(b)
    text = F.concat(F.lit("<b>"), "station_id", F.lit("</b><br>Agency: "), "agency_id", F.lit("<br>Stop: "), F.coalesce("stop_name", F.lit("None")))
    return drawn.select("node_id", "lat", "lon", "color", pick(8, 5).alias("radius"), pick(3, 1).alias("weight"), pick(0.8, 0.6).alias("opacity"), text.alias("popup"))


def map_center(nodes: DataFrame, zoom: int = 11) -> DataFrame:
    return nodes.agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon")).withColumn("zoom", F.lit(zoom))


def column_stats(values: DataFrame, column: str, positive_min: bool = False) -> DataFrame:
    """Least, largest, mean, and how many are above zero; the least of those alone if ``positive_min``."""
    x: Column = F.col(column)
    return values.agg(F.min(F.when(x > 0, x) if positive_min else x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.count_if(x > 0).alias("n_positive"), F.count("*").alias("n"))


def ranked(values: DataFrame, column: str, key: str = "node_id") -> DataFrame:
    """Competition ranks, largest first, nulls last."""
    return placed(values, F.col(column).desc_nulls_last(), name="rank", ranks=True).withColumn("rank", (F.col("rank") + 1).cast("int"))


def rank_of(values: DataFrame, column: str, keys: list, key: str = "node_id") -> DataFrame:
    """Value and rank of some keys, null where a key is absent: 1 and how many are larger. All keys are counted in one pass."""
    spark, kind = values.sparkSession, dict(values.dtypes)[column]
    found = {r[0]: r[1] for r in values.where(F.col(key).isin(keys)).select(key, column).collect()}  # a row for each key
    known = sorted({x for x in found.values() if x is not None})
    larger = values.agg(*(F.count_if(F.col(column) > F.lit(x)) for x in known)).first() if known else ()
    rank = {x: n + 1 for x, n in zip(known, larger, strict=True)}
    return spark.createDataFrame([(k, found.get(k), rank.get(found.get(k))) for k in keys], f"{key} string, {column} {kind}, rank long")


def top(values: DataFrame, column: str, k: int = 10, key: str = "node_id") -> DataFrame:
    return values.orderBy(F.desc(column), key).limit(k)
