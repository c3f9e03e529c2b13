"""Damped random walk over service edges."""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import hourly_frequency
from ..plans.storage import stash
from .graph import SERVICE

#: Transitions up to which one task holds the whole walk.
ONE_TASK = 2_000_000


def transition_probs(edges: DataFrame, beta: float = 1.0) -> DataFrame:
    """(src, dst, p): hourly vehicles between nodes, to the power ``beta``, as shares of their source's; a node without outgoing service has no row."""
    service = edges.where(F.col("edge_type") == SERVICE).groupBy(F.col("source").alias("src"), F.col("target").alias("dst"))
    weights = service.agg(F.coalesce(F.sum(hourly_frequency(F.col("headway_secs"))), F.lit(0.0)).alias("w")).where("w > 0")
    if beta != 1.0:
        weights = weights.withColumn("w", F.pow("w", F.lit(beta)))
    return weights.withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy("src"))).select("src", "dst", "p")


def walk(n: int, src: np.ndarray, dst: np.ndarray, p: np.ndarray, damping: float, tol: float, max_iter: int) -> tuple[np.ndarray, int, bool]:
    """Stationary distribution, iterations, whether it converged. What leaves nodes without a way out is lost, and the whole is scaled to 1."""
    pi = np.full(n, 1 / n)
    for k in range(1, max_iter + 1):
        new = damping * np.bincount(dst, weights=pi[src] * p, minlength=n) + (1 - damping) * pi.sum() / n
        new /= new.sum()
        step, pi = np.linalg.norm(new - pi), new
        if step < tol:
            return pi, k, True
    return pi, max_iter, False


def _in_one_task(nodes: DataFrame, probs: DataFrame, damping: float, tol: float, max_iter: int) -> DataFrame:
    def run(_, pages, rows):
        import pandas as pd

        ids = pd.Index(pages["node_id"].sort_values())
        pi, k, done = walk(len(ids), ids.get_indexer(rows["src"]), ids.get_indexer(rows["dst"]), rows["p"].to_numpy(), damping, tol, max_iter)
        return pd.DataFrame({"node_id": ids, "L_i_flujo": pi, "iterations": k, "converged": done})

    one = lambda t: t.withColumn("one", F.lit(1)).groupBy("one")
    return one(nodes.select("node_id")).cogroup(one(probs)).applyInPandas(run, "node_id string, L_i_flujo double, iterations int, converged boolean")


def _distributed(nodes: DataFrame, probs: DataFrame, damping: float, tol: float, max_iter: int, every: int = 5) -> DataFrame:
    n = nodes.count()
    pi, done, k, held = nodes.select("node_id", F.lit(1.0 / n).alias("x")), False, 0, []
    while k < max_iter and not done:
        k += 1
        came = probs.join(pi, probs["src"] == pi["node_id"]).groupBy("dst").agg(F.sum(F.col("x") * F.col("p")).alias("y"))
        new = nodes.join(came, nodes["node_id"] == came["dst"], "left").select("node_id", (F.lit(damping) * F.coalesce("y", F.lit(0.0)) + (1 - damping) / n).alias("y"))
        new = stash(new, "walk") if k % every == 0 else new.persist()
        held.append(new)
        whole = new.agg(F.sum("y")).first()[0]
        scaled = new.select("node_id", (F.col("y") / whole).alias("x"))
        step = scaled.join(pi.withColumnRenamed("x", "z"), "node_id").agg(F.sqrt(F.sum(F.pow(F.col("x") - F.col("z"), 2)))).first()[0]
        pi, done = scaled, step < tol
        if k % every == 0:  # the written round no longer needs those before it
            for old in held[:-1]:
                old.unpersist()
            held = held[-1:]
    return pi.select("node_id", F.col("x").alias("L_i_flujo"), F.lit(k).alias("iterations"), F.lit(done).alias("converged"))


def stationary_flow(edges: DataFrame, nodes: DataFrame, damping: float = 0.85, tol: float = 1e-10, max_iter: int = 5000, beta: float = 1.0, one_task: int = ONE_TASK) -> DataFrame:
    """(node_id, L_i_flujo, iterations, converged). ``damping=1`` is the plain walk.

    A walk of at most ``one_task`` transitions is iterated in one task; beyond, each iteration is a
    join and an aggregation, written every few rounds. Warns if it doesn't converge.
    """
    probs = stash(transition_probs(edges, beta), "transitions")
    ids = stash(nodes.select("node_id").distinct(), "nodes")  # read again and again
    way = _in_one_task if probs.count() <= one_task and ids.count() <= one_task else _distributed
    found = way(ids, probs, damping, tol, max_iter)
    if way is _distributed and not found.first()["converged"]:
        warnings.warn(f"the walk did not converge in {max_iter} iterations", stacklevel=2)
    return found


def distribution_check(found: DataFrame, column: str = "L_i_flujo", tol: float = 1e-6) -> DataFrame:
    """One row (name, ok, n_bad, detail): shares are not negative and sum to 1."""
    sums = found.agg(F.sum(column).alias("total"), F.count_if(F.col(column) < 0).alias("n_bad"))
    return sums.select(F.lit("shares sum to 1").alias("name"), ((F.abs(F.col("total") - 1) < tol) & (F.col("n_bad") == 0)).alias("ok"), "n_bad", F.col("total").cast("string").alias("detail"))
