"""Betweenness from sampled pivots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import stash
from .components import connected_components
from .graph import SERVICE

#: Arcs up to which every task may hold the graph.
IN_MEMORY_ARCS = 1_000_000


def service_arcs(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst): parallel edges don't change shortest paths; loops never lie on one."""
    return edges.where(F.col("edge_type") == SERVICE).select(F.col("source").alias("src"), F.col("target").alias("dst")).where("src <> dst").distinct()


def pivots(nodes: DataFrame, k: int | None, seed: int = 0) -> DataFrame:
    """``k`` nodes by a seeded hash (MD5, so that other engines draw the same); all if None."""
    ids = nodes.select("node_id").distinct()
    return ids if k is None else ids.orderBy(F.md5(F.concat("node_id", F.lit(f":{seed}"))), "node_id").limit(k)


def brandes(out: dict[str, list[str]], source: str) -> dict[str, float]:
    """Dependency of ``source`` on each node it reaches."""
    distance, paths, before, order = {source: 0}, {source: 1.0}, {source: []}, [source]
    for v in order:
        for w in out.get(v, ()):
            if w not in distance:
                distance[w], paths[w], before[w] = distance[v] + 1, 0.0, []
                order.append(w)
            if distance[w] == distance[v] + 1:
                paths[w] += paths[v]
                before[w].append(v)
    share = dict.fromkeys(order, 0.0)
    for w in reversed(order):
        for v in before[w]:
            share[v] += paths[v] / paths[w] * (1 + share[w])
    del share[source]
    return share


def _in_memory(arcs: DataFrame, roots: DataFrame) -> DataFrame:
    out: dict[str, list[str]] = {}
    for r in arcs.collect():  # at most IN_MEMORY_ARCS
        out.setdefault(r["src"], []).append(r["dst"])
    graph = arcs.sparkSession.sparkContext.broadcast(out)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [x for v in pdf["node_id"] for x in brandes(graph.value, v).items()]
            yield pd.DataFrame(rows, columns=["node_id", "x"])

    return roots.repartition(roots.sparkSession.sparkContext.defaultParallelism).mapInPandas(run, "node_id string, x double")


def _by_levels(arcs: DataFrame, roots: DataFrame) -> DataFrame:
    """All pivots' searches at once, a level at a time: a join out, then a join back."""
    level = stash(roots.select(F.col("node_id").alias("root"), F.col("node_id").alias("v"), F.lit(1.0).alias("paths")), "level")
    levels, seen = [level], level.select("root", "v")
    while True:
        ahead = level.join(arcs, level["v"] == arcs["src"]).groupBy("root", F.col("dst").alias("v")).agg(F.sum("paths").alias("paths"))
        level = stash(ahead.join(seen, ["root", "v"], "left_anti"), "level")
        if level.isEmpty():
            break
        levels.append(level)
        seen = seen.union(level.select("root", "v"))
        if len(levels) % 16 == 0:
            seen = stash(seen, "seen")
    total, share = None, None
    for depth in range(len(levels) - 1, 0, -1):
        here = levels[depth].select("root", F.col("v").alias("w"), F.col("paths").alias("paths_w"))
        here = here.join(share, ["root", "w"], "left").na.fill(0.0, ["x"]) if share is not None else here.withColumn("x", F.lit(0.0))
        counted = here.select(F.col("w").alias("node_id"), "x")
        total = counted if total is None else total.union(counted)
        back = here.join(arcs, here["w"] == arcs["dst"]).join(levels[depth - 1], (F.col("src") == F.col("v")) & (here["root"] == levels[depth - 1]["root"])).select(here["root"], F.col("v").alias("w"), (F.col("paths") / F.col("paths_w") * (1 + F.col("x"))).alias("x"))
        share = stash(back.groupBy("root", "w").agg(F.sum("x").alias("x")), "shares")
    return total if total is not None else roots.select("node_id", F.lit(0.0).alias("x")).limit(0)


def betweenness(edges: DataFrame, nodes: DataFrame, k: int | None = 100, seed: int = 0, in_memory_arcs: int = IN_MEMORY_ARCS) -> DataFrame:
    """(node_id, L_i_topo): unweighted directed betweenness over service edges, as a share of the (n-1)(n-2) pairs, scaled by n/k for ``k`` pivots."""
    arcs = stash(service_arcs(edges), "arcs")
    ids = stash(nodes.select("node_id").distinct(), "nodes")  # read again and again
    n = ids.count()
    roots = stash(pivots(ids, k if k is not None and k < n else None, seed), "pivots")
    used = roots.count()
    shares = _in_memory(arcs, roots) if arcs.count() <= in_memory_arcs else _by_levels(arcs, roots)
    scale = (n / used if used else 0.0) / ((n - 1) * (n - 2)) if n > 2 else 0.0
    summed = shares.groupBy("node_id").agg(F.sum("x").alias("x"))
    return ids.join(summed, "node_id", "left").select("node_id", (F.coalesce("x", F.lit(0.0)) * scale).alias("L_i_topo"))


def node_components(edges: DataFrame, nodes: DataFrame, service_only: bool = False) -> DataFrame:
    """(node_id, component): weak components, a node without edges on its own."""
    kept = edges.where(F.col("edge_type") == SERVICE) if service_only else edges
    reached = connected_components(kept, "source", "target")
    return nodes.select("node_id").distinct().join(reached, F.col("node_id") == F.col("node"), "left").select("node_id", F.coalesce("component", "node_id").alias("component"))


def component_sizes(edges: DataFrame, nodes: DataFrame, service_only: bool = False) -> DataFrame:
    """component, n_nodes and share of all nodes, largest first."""
    sizes = node_components(edges, nodes, service_only).groupBy("component").agg(F.count("*").alias("n_nodes"))
    whole = sizes.agg(F.sum("n_nodes").alias("n"))
    return sizes.join(F.broadcast(whole)).select("component", "n_nodes", (F.col("n_nodes") / F.col("n")).alias("share")).orderBy(F.desc("n_nodes"), "component")
