"""The stages from a feed to its loads, each reading and writing files, and their command line."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import capacity, cascade, centrality, checks, flow, graph, stations, stats
from ..sources import feed as sources
from .storage import stash

STEPS = (1, 3, 4)


def validate(spark: SparkSession, feed_path: str) -> bool:
    """Print all checks; true if the blocking ones pass."""
    return checks.validate_feed(sources.read_feed(spark, feed_path))


def build_stations(spark: SparkSession, feed_path: str, out: str, overrides_path: str | None = None) -> DataFrame:
    """Write crosswalk.csv, overrides applied, and override_candidates.csv."""
    feed = sources.read_feed(spark, feed_path)
    crosswalk = stash(stations.build_crosswalk(feed.stops), "crosswalk")
    if overrides_path:
        overrides = sources.read_overrides(spark, overrides_path)
        print(f"{overrides.count()} overrides")
        if n := stations.unknown_targets(crosswalk, overrides).count():
            print(f"{n} overrides name a station that no stop has")
        crosswalk = stash(stations.apply_overrides(crosswalk, overrides), "crosswalk")
    n = crosswalk.agg(F.count("*").alias("stops"), F.count_distinct("geo_cluster").alias("clusters"), F.count_distinct("station_id").alias("stations")).first()
    print(f"{n['stops']} stops, {n['clusters']} clusters, {n['stations']} stations")
    sources.write_csv(crosswalk, f"{out}/crosswalk.csv", "stop_id")
    sources.write_csv(stations.override_candidates(crosswalk, graph.stop_agencies(feed)), f"{out}/override_candidates.csv", "n_stops", "geo_cluster", descending=True)
    return crosswalk


def build_network(spark: SparkSession, feed_path: str, crosswalk: DataFrame, out: str) -> tuple[DataFrame, DataFrame]:
    """Write nodes.parquet and edges.parquet, and print what looks wrong."""
    feed = sources.read_feed(spark, feed_path)
    sources.write_graph(*graph.build_graph(feed, crosswalk), out)
    nodes, edges = sources.read_graph(spark, out)
    service, transfers = (edges.where(F.col("edge_type") == k) for k in (graph.SERVICE, graph.TRANSFER))
    print_counts(nodes, edges)
    print(checks.report(checks.trips_without_stop_times(feed).union(checks.stations_without_transfer(nodes, transfers)).union(checks.sparse_routes(service))))
    return nodes, edges


def print_counts(nodes: DataFrame, edges: DataFrame) -> None:
    """Nodes, edges by kind, transfer stations, and the share of the largest component."""
    kinds = {r["edge_type"]: r["n"] for r in edges.groupBy("edge_type").agg(F.count("*").alias("n")).collect()}
    sizes = centrality.component_sizes(edges, nodes)
    whole = sizes.agg(F.count("*").alias("n"), F.max("share").alias("share")).first()
    print(f"{nodes.count()} nodes, {sum(kinds.values())} edges ({kinds.get(graph.SERVICE, 0)} service, {kinds.get(graph.TRANSFER, 0)} transfer)")
    print(f"{graph.transfer_stations(nodes).count()} transfer stations, {whole['n']} components, the largest with {100 * (whole['share'] or 0):.1f}% of the nodes")


def analyze(nodes: DataFrame, edges: DataFrame, out: str, steps: tuple[int, ...] = STEPS, figures: str | None = None, matrix: str | None = None, markers: str | None = None) -> None:
    """Step 1: summaries and chart tables; 3: the transfer matrix; 4: the map's markers. Folders and files default to those in ``out``."""
    charts = {"hist_degree", "box_headway", "hist_travel_time"}
    if 1 in steps:
        for name, table in {"degree_summary": stats.degree_summary(nodes, edges), "weight_summary": stats.weight_summary(edges), "headway_summary": stats.headway_summary(edges), "hist_degree": stats.degree_histogram(nodes, edges), "box_headway": stats.headway_boxes(edges), "edge_counts": stats.edge_counts(edges), "hist_travel_time": stats.travel_time_histogram(edges)}.items():
            sources.write_csv(table, f"{(figures or out) if name in charts else out}/{name}.csv", table.columns[0])
    if 3 in steps:
        sources.write_csv(stats.transfer_matrix(edges), matrix or f"{out}/transfer_matrix.csv", "source_agency")
        sources.write_csv(stats.transfer_margins(edges), f"{out}/transfer_summary.csv", "agency")
    if 4 in steps:
        sources.write_geojson(stats.map_markers(nodes), markers or f"{out}/map.geojsonl")


def print_load(table: DataFrame, column: str, spots: list[str], top: int = 10) -> None:
    """Range, mean and positive values of a load, its largest values, and value and rank of the nodes asked for."""
    n = stats.column_stats(table, column).first()
    print(f"{column}: {n['n']} nodes, {n['n_positive']} above zero" + (f", from {n['min']:g} to {n['max']:g}, mean {n['mean']:g}" if n["n"] else ""))
    for r in stats.top(table, column, top).collect():
        print(f"  {r['node_id']}  {r[column]:g}")
    for r in stats.rank_of(table, column, spots).collect() if spots else ():
        print(f"  {r['node_id']}: " + ("unknown" if r["rank"] is None else f"{r[column]:g}, rank {r['rank']} of {n['n']}"))


def write_loads(nodes: DataFrame, edges: DataFrame, out: str, capacities: DataFrame | None = None, k: int | None = 100, seed: int = 0, damping: float = 0.85, tol: float = 1e-10, spots: list[str] | None = None) -> None:
    """Write capacity assumptions, node_capacity, load_topological and load_flujo, largest first, and print a report of each."""
    spark = nodes.sparkSession
    known = capacities if capacities is not None else capacity.capacity_table(spark)
    checks.require(capacity.missing_headways(edges).select("source", "target", "route_id"), "service edges without headway")
    sources.write_csv(known, f"{out}/capacity_assumptions.csv", "agency_id")
    walked = stash(flow.stationary_flow(edges, nodes, damping, tol), "flow")
    checks.require(flow.distribution_check(walked).where("NOT ok"), "the flow is no distribution")
    print(*(f"note: {c}" for c in capacity.CAVEATS), sep="\n")
    for name, table, column in (("node_capacity", capacity.node_capacity(edges, known), "C_i"), ("load_topological", centrality.betweenness(edges, nodes, k, seed), "L_i_topo"), ("load_flujo", walked.select("node_id", "L_i_flujo"), "L_i_flujo")):
        table = stash(table, name)
        sources.write_csv(table, f"{out}/{name}.csv", column, "node_id", descending=True)
        print_load(table, column, spots or [])


def write_cascades(nodes: DataFrame, edges: DataFrame, out: str, k: int | None = 100, seed: int = 0, attacks: int = 10) -> None:
    """Write alpha_sweep.csv: cascades from the nodes of the largest loads and from as many drawn ones, by either load."""
    walked = stash(flow.stationary_flow(edges, nodes).select("node_id", F.col("L_i_flujo").alias("load")), "flow")
    between = stash(centrality.betweenness(edges, nodes, k, seed).select("node_id", F.col("L_i_topo").alias("load")), "between")
    loads = walked.withColumn("variante_carga", F.lit("flujo")).union(between.withColumn("variante_carga", F.lit("topo"))).select("node_id", "variante_carga", "load")
    seeds = stats.top(walked, "load", attacks).select("node_id", F.lit("dirigido").alias("tipo_ataque")).union(centrality.pivots(nodes, attacks, seed).select("node_id", F.lit("aleatorio")))
    sweep = stash(cascade.alpha_sweep(flow.transition_probs(edges).withColumnRenamed("p", "w"), loads, walked.select("node_id", F.col("load").alias("x")), seeds), "sweep")
    sources.write_csv(sweep, f"{out}/alpha_sweep.csv", "alpha", "tipo_ataque", "variante_carga")
    if n := cascade.rising_sizes(sweep).count():
        print(f"{n} steps of alpha at which the mean cascade grows")


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="ferrovia", description=__doc__)
    parser.add_argument("stage", choices=("validate", "stations", "network", "analyze", "loads", "cascades", "all"), help="all: every stage but cascades")
    parser.add_argument("feed", help="folder of .txt tables")
    parser.add_argument("out", nargs="?", default="data/processed", help="folder for results")
    parser.add_argument("--overrides", help="CSV of manual station overrides")
    parser.add_argument("--capacities", help="CSV of passengers in a vehicle of each agency")
    parser.add_argument("--nodes", help="Parquet of nodes, in place of that in out")
    parser.add_argument("--edges", help="Parquet of edges, in place of that in out")
    parser.add_argument("--figures-dir", help="folder for chart tables")
    parser.add_argument("--transfer-csv", help="file for the transfer matrix")
    parser.add_argument("--output-map", help="file for the map's markers")
    parser.add_argument("--steps", type=int, nargs="*", default=list(STEPS), help="of analyze")
    parser.add_argument("--k", type=int, default=100, help="pivots of the betweenness, 0 for all nodes")
    parser.add_argument("--seed", type=int, default=0, help="of the pivots")
    parser.add_argument("--damping", type=float, default=0.85, help="of the walk")
    parser.add_argument("--tol", type=float, default=1e-10, help="at which the walk has settled")
    parser.add_argument("--spot", nargs="*", default=[], help="nodes whose loads and ranks are printed")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("ferrovia").getOrCreate()
    whole = given.stage == "all"
    if whole or given.stage == "validate":
        if not validate(spark, given.feed):
            return 1
    if whole or given.stage == "stations":
        build_stations(spark, given.feed, given.out, given.overrides)
    if whole or given.stage == "network":
        build_network(spark, given.feed, sources.read_crosswalk(spark, f"{given.out}/crosswalk.csv"), given.out)
    if whole or given.stage in ("analyze", "loads", "cascades"):
        nodes = spark.read.parquet(given.nodes or f"{given.out}/nodes.parquet")
        edges = spark.read.parquet(given.edges or f"{given.out}/edges.parquet")
        if whole or given.stage == "analyze":
            analyze(nodes, edges, given.out, tuple(given.steps), given.figures_dir, given.transfer_csv, given.output_map)
        if whole or given.stage == "loads":
            capacities = sources.read_capacities(spark, given.capacities) if given.capacities else None
            write_loads(nodes, edges, given.out, capacities, given.k or None, given.seed, given.damping, given.tol, given.spot)
        if given.stage == "cascades":
            write_cascades(nodes, edges, given.out, given.k or None, given.seed)
    return 0


if __name__ == "__main__":
    sys.exit(main())
