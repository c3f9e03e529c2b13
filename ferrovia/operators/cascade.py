"""Cascading failures under load: an extension whose rules are this library's choice.

A node holds ``(1 + alpha)`` times its load. When nodes fail, each passes its load to its neighbours
that still stand, by outgoing edge weight, all failures of a round at once; nodes beyond what they hold fail in
the next. Load without a standing neighbour is lost.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .centrality import IN_MEMORY_ARCS

METRICS = ("giant_component_ratio", "global_efficiency", "flujo_varado", "cascade_size")


def run_cascade(out: dict[str, dict[str, float]], load: dict[str, float], alpha: float, seed: str, limit: dict[str, float] | None = None) -> set[str]:
    """The nodes that have failed in the end. ``limit`` replaces (1 + alpha) * load."""
    now, holds = dict(load), limit or {v: (1 + alpha) * x for v, x in load.items()}
    failed, fresh = set(), {seed}
    while fresh:
        failed |= fresh
        for v in sorted(fresh):
            standing = {w: x for w, x in out.get(v, {}).items() if w not in failed}
            if whole := sum(standing.values()):
                for w, x in standing.items():
                    now[w] = now.get(w, 0.0) + now.get(v, 0.0) * x / whole
            now[v] = 0.0
        fresh = {w for w, x in now.items() if w not in failed and x > holds.get(w, 0.0) * (1 + 1e-12)}
    return failed


def giant_component(out: dict[str, dict[str, float]], nodes: set[str]) -> int:
    """Nodes of the largest weak component among ``nodes``."""
    near: dict[str, set[str]] = {v: set() for v in nodes}
    for v, targets in out.items():
        for w in targets:
            if v in near and w in near:
                near[v].add(w)
                near[w].add(v)
    best, left = 0, set(nodes)
    while left:
        queue, n = [left.pop()], 1
        while queue:
            new = near[queue.pop()] & left
            left -= new
            n += len(new)
            queue += new
        best = max(best, n)
    return best


def global_efficiency(out: dict[str, dict[str, float]], nodes: set[str]) -> float:
    """Mean of 1 / distance over ordered pairs, 0 where there is no way."""
    if len(nodes) < 2:
        return 0.0
    total = 0.0
    for s in nodes:
        distance, queue = {s: 0}, deque([s])
        while queue:
            v = queue.popleft()
            for w in out.get(v, {}):
                if w in nodes and w not in distance:
                    distance[w] = distance[v] + 1
                    total += 1 / distance[w]
                    queue.append(w)
    return total / (len(nodes) * (len(nodes) - 1))


def alpha_sweep(weights: DataFrame, loads: DataFrame, flow: DataFrame, seeds: DataFrame, alphas: list[float] | None = None, max_arcs: int = IN_MEMORY_ARCS) -> DataFrame:
    """Mean metrics by alpha, tipo_ataque and variante_carga.

    ``weights`` has (src, dst, w), ``loads`` (node_id, variante_carga, load), ``flow`` (node_id, x) with the
    stationary flow, ``seeds`` (node_id, tipo_ataque). Runs are independent and dealt over all cores; the graph is held by each task,
    so one of more than ``max_arcs`` arcs raises.
    """
    spark = weights.sparkSession
    for what, table in (("arcs", weights), ("loads", loads), ("shares of the flow", flow)):
        if table.count() > max_arcs:
            raise ValueError(f"cascades hold the graph in memory: at most {max_arcs} {what}")
    out: dict[str, dict[str, float]] = {}
    for r in weights.collect():
        out.setdefault(r["src"], {})[r["dst"]] = r["w"]
    load: dict[str, dict[str, float]] = {}
    for r in loads.collect():
        load.setdefault(r["variante_carga"], {})[r["node_id"]] = r["load"]
    pi = {r["node_id"]: r["x"] for r in flow.collect()}
    shared = spark.sparkContext.broadcast((out, load, pi))
    steps = alphas if alphas is not None else [round(0.1 * k, 1) for k in range(21)]
    runs = seeds.withColumn("alpha", F.explode(F.array(*(F.lit(float(a)) for a in steps)))).withColumn("variante_carga", F.explode(F.array(*map(F.lit, sorted(load)))))

    def run(batches):
        import pandas as pd

        out, load, pi = shared.value
        for pdf in batches:
            rows = []
            for seed, kind, alpha, variant in pdf[["node_id", "tipo_ataque", "alpha", "variante_carga"]].itertuples(index=False):
                everything = set(load[variant])
                failed = run_cascade(out, load[variant], alpha, seed)
                left = everything - failed
                before = giant_component(out, everything)
                rows.append((alpha, kind, variant, giant_component(out, left) / before if before else 0.0, global_efficiency(out, left), sum(pi.get(v, 0.0) for v in failed), len(failed) / max(1, len(everything))))
            yield pd.DataFrame(rows, columns=["alpha", "tipo_ataque", "variante_carga", *METRICS])

    found = runs.repartition(spark.sparkContext.defaultParallelism).mapInPandas(run, "alpha double, tipo_ataque string, variante_carga string, " + ", ".join(f"{m} double" for m in METRICS))
    return found.groupBy("alpha", "tipo_ataque", "variante_carga").agg(*(F.avg(m).alias(m) for m in METRICS))


def rising_sizes(sweep: DataFrame) -> DataFrame:
    """Steps of alpha at which the mean cascade grows: none are expected."""
    along = Window.partitionBy("tipo_ataque", "variante_carga").orderBy("alpha")
    return sweep.withColumn("before", F.lag("cascade_size").over(along)).where(F.col("cascade_size") > F.col("before") + 1e-12)
