import random
from itertools import product

import numpy as np
import pytest

from ferrovia.operators import cascade, centrality, flow

EDGE = "source string, target string, edge_type string, headway_secs int"


def graph(spark, arcs, names):
    edges = spark.createDataFrame([(a, b, "servicio", h) for a, b, h in arcs], EDGE)
    return edges, spark.createDataFrame([(n,) for n in names], "node_id string")


@pytest.mark.parametrize("one_task", [100, 0])
def test_lost_mass_is_scaled_back(spark, one_task):
    edges, nodes = graph(spark, [("a", "b", 60), ("b", "a", 60), ("b", "c", 60)], "abc")
    got = {r["node_id"]: r["L_i_flujo"] for r in flow.stationary_flow(edges, nodes, tol=1e-6 if not one_task else 1e-10, one_task=one_task).collect()}
    assert [round(got[x], 5) for x in "abc"] == [0.29739, 0.40522, 0.29739]
    assert abs(sum(got.values()) - 1) < 1e-9


def test_a_walk_that_does_not_settle_says_so():
    _, k, done = flow.walk(2, np.array([0, 1]), np.array([1, 0]), np.array([1.0, 0.5]), 1.0, 1e-12, 7)
    assert (k, done) == (7, False)


@pytest.mark.parametrize("in_memory", [1000, 0])
def test_path_betweenness(spark, in_memory):
    arcs = [("a", "b", 60), ("b", "c", 60), ("c", "d", 60), ("a", "b", 90)]
    edges, nodes = graph(spark, arcs, "abcd")
    got = {r["node_id"]: r["L_i_topo"] for r in centrality.betweenness(edges, nodes, k=None, in_memory_arcs=in_memory).collect()}
    assert got == pytest.approx({"a": 0, "b": 2 / 6, "c": 2 / 6, "d": 0})


def test_betweenness_against_all_shortest_paths(spark):
    rng = random.Random(2)
    names = "abcdefgh"
    arcs = sorted({(a, b) for a, b in product(names, names) if a != b and rng.random() < 0.3})
    out = {v: [b for a, b in arcs if a == v] for v in names}
    want = dict.fromkeys(names, 0.0)
    for s, t in product(names, names):
        ways, level = [], [[s]]
        while level and not ways and s != t:
            level = [p + [w] for p in level for w in out[p[-1]] if w not in p]
            ways = [p for p in level if p[-1] == t]
        for p in ways:
            for v in p[1:-1]:
                want[v] += 1 / len(ways) / 42
    edges, nodes = graph(spark, [(a, b, 60) for a, b in arcs], names)
    for limit in (1000, 0):
        got = {r["node_id"]: r["L_i_topo"] for r in centrality.betweenness(edges, nodes, k=None, in_memory_arcs=limit).collect()}
        assert got == pytest.approx(want)


def test_sampled_pivots_repeat(spark):
    _, nodes = graph(spark, [], [f"n{k}" for k in range(50)])
    first, again = (sorted(r[0] for r in centrality.pivots(nodes, 7, seed=4).collect()) for _ in range(2))
    assert first == again and len(first) == 7


def test_component_sizes(spark):
    edges, nodes = graph(spark, [("a", "b", 60), ("c", "b", 60)], "abcd")
    assert [(r["component"], r["n_nodes"], r["share"]) for r in centrality.component_sizes(edges, nodes).collect()] == [("a", 3, 0.75), ("d", 1, 0.25)]


def test_cascade_spreads_and_stops():
    out = {"a": {"b": 1.0, "c": 3.0}, "b": {"c": 1.0}, "c": {"d": 1.0}}
    load = dict.fromkeys("abcd", 1.0)
    assert cascade.run_cascade(out, load, 2.0, "a") == {"a"}
    assert cascade.run_cascade(out, load, 0.0, "a") == set("abcd")
    assert cascade.giant_component(out, set("abd")) == 2
    assert cascade.global_efficiency(out, set("abc")) == pytest.approx(3 / 6)


def test_sweep(spark):
    weights = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0)], "src string, dst string, w double")
    loads = spark.createDataFrame([(v, "flujo", 1 / 3) for v in "abc"], "node_id string, variante_carga string, load double")
    seeds = spark.createDataFrame([("a", "dirigido")], "node_id string, tipo_ataque string")
    got = cascade.alpha_sweep(weights, loads, loads.selectExpr("node_id", "load AS x"), seeds, [0.0, 5.0])
    assert {r["alpha"]: r["cascade_size"] for r in got.collect()} == pytest.approx({0.0: 1.0, 5.0: 1 / 3})
    assert cascade.rising_sizes(got).count() == 0
