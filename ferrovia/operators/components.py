"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import stash

#: Edges up to which one task joins them all.
ONE_TASK = 1 << 18


def _in_one_task(edges: DataFrame, kind: str) -> DataFrame:
    """Union-find over all edges (u, v)."""

    def run(batches):
        import pyarrow as pa

        root: dict = {}

        def find(x):
            while (above := root[x]) != x:
                root[x] = x = root[above]
            return x

        for batch in batches:
            for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                root.setdefault(a, a)
                root.setdefault(b, b)
                a, b = sorted((find(a), find(b)))
                root[b] = a
        if root:
            names = batch.schema.field(0).type
            yield pa.RecordBatch.from_arrays([pa.array(list(root), names), pa.array([find(x) for x in root], names)], ["node", "component"])

    return edges.select("u", "v").coalesce(1).mapInArrow(run, f"node {kind}, component {kind}")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, one_task: int | None = None) -> DataFrame:
    """(node, component) for each node of an edge between two different nodes; component is the least node reached.

    Up to ``one_task`` distinct edges (:data:`ONE_TASK`) are joined by one task. Beyond, alternates large-star and small-star steps until the edge set no longer changes, which takes
    a logarithmic number of rounds. Minima are aggregated map-side before they are joined back,
    so a hub's neighbours never meet in one task unless Spark splits the join's skewed partition.
    Self-loops, repeated edges and edges with a null end are ignored; no edges give no rows.
    """
    u, v = F.col("u"), F.col("v")
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    now = stash(now.where(u != v).distinct(), "edges")
    mark = lambda t: t.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    seen = mark(now)
    if seen["n"] <= (ONE_TASK if one_task is None else one_task):
        return stash(_in_one_task(now, now.schema["u"].dataType.simpleString()), "components")
    for _ in range(max_rounds):
        if not seen["n"]:
            break
        both = now.union(now.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(v > u).join(least, "u").select(v.alias("u"), F.col("m").alias("v")).where(u != v).distinct()
        large = stash(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(v.alias("u"), F.col("m").alias("v")).where(u != v)
        now = stash(small.union(least).distinct(), "edges")
        before, seen = seen, mark(now)
        if seen == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(u.alias("node"), v.alias("component")).union(now.select(v, v).distinct())
