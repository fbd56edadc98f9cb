"""Graph operators and metrics on hand-sized graphs and against literal models."""

import itertools
import random
from collections import Counter, defaultdict

import pytest

from graphcover.operators import graph as g
from graphcover.operators import growth as gr
from graphcover.operators import metrics as m
from graphcover.operators.components import components
from graphcover.operators.whiskers import whisker_nodes

K = lambda ids: list(itertools.combinations(ids, 2))
GRAPHS = {
    "triangle": (K([1, 2, 3]), 2, 3, [1, 2, 3]),
    "square_tail": ([(1, 2), (2, 3), (3, 4), (1, 4), (4, 5)], 2, 5, [1, 2, 3, 4]),
    "two_cliques": (K([1, 2, 3, 4]) + K([5, 6, 7, 8]) + [(4, 5)], 3, 8, [1, 2, 3, 4]),
    "gamma_clique": (K([1, 2, 3, 4]) + K(range(5, 11)), 4, 10, list(range(5, 11))),
    "isolated": (K([1, 2, 3]), 2, 6, [1, 2, 3]),
}
EXPECTED = {
    "triangle": (None, 0, 1, 1, 1 / 6, set()),
    "square_tail": (0.25, 1 / 9, 1, 0, 0.1, {5}),
    "two_cliques": (1 / 16, 1 / 13, 1, 1, 0.1376, set()),
    "gamma_clique": (0, 0, 1, 1, 0.1446, {1, 2, 3, 4}),
    "isolated": (0, 0, 1, 1, 1 / 6, set()),
}


def edges_of(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long")


def nodes_of(spark, n):
    return spark.range(1, n + 1).withColumnRenamed("id", "node")


def cover_of(spark, sets):
    return spark.createDataFrame([(k, x) for k, s in sets.items() for x in s], "comm_id long, node long")


@pytest.mark.parametrize("name", GRAPHS)
def test_hand_graphs(spark, name):
    rows, gamma, n, members = GRAPHS[name]
    edges, cover, nodes = edges_of(spark, rows), cover_of(spark, {1: members}), nodes_of(spark, n)
    ratio, cond, reach, tri, mod, whiskers = EXPECTED[name]
    assert m.cut_ratio(edges, cover, n).first()["cut_ratio"] == (None if ratio is None else pytest.approx(ratio))
    assert m.conductance(edges, cover).first()["conductance"] == pytest.approx(cond)
    assert m.fomd(edges, cover, nodes).first()["fomd"] == reach
    assert m.tpr(edges, cover).first()["tpr"] == tri
    assert m.modularity(edges, cover).first()["modularity"] == pytest.approx(mod, abs=1e-4)
    assert {r[0] for r in whisker_nodes(edges, gamma).collect()} == whiskers


def test_whiskers_do_not_depend_on_order(spark):
    rows = [("x", "i"), ("i", "c"), ("x", "j"), ("j", "c"), ("c", "p1"), ("p1", "p2"), ("x", "o1"), ("o1", "o2")]
    found = whisker_nodes(spark.createDataFrame(rows, "src string, dst string"), 6)
    assert {r[0] for r in found.collect()} == {"x", "i", "j", "c", "p1", "p2", "o1", "o2"}


def literal_whiskers(rows, gamma):
    adj = defaultdict(set)
    for a, b in rows:
        if a != b:
            adj[a].add(b)
            adj[b].add(a)
    out = set()
    for i in adj:
        for c in adj[i]:
            seen, todo = {i}, [i]
            while todo:
                for y in adj[todo.pop()] - {c}:
                    if y not in seen:
                        seen.add(y)
                        todo.append(y)
            if len(seen) < gamma:
                out |= seen
    return out


def random_rows(rng, n, k):
    return [(rng.randrange(1, n + 1), rng.randrange(1, n + 1)) for _ in range(k)]


@pytest.mark.parametrize("seed", range(3))
def test_whiskers_on_random_graphs(spark, seed):
    rng = random.Random(seed)
    rows = random_rows(rng, 40, 42)
    for gamma in (2, 4, 7):
        assert {r[0] for r in whisker_nodes(edges_of(spark, rows), gamma).collect()} == literal_whiskers(rows, gamma)


def test_components_with_isolated_nodes(spark):
    got = {tuple(r) for r in components(nodes_of(spark, 7), edges_of(spark, [(3, 2), (5, 3), (7, 6), (6, 6)])).collect()}
    assert got == {(1, 1), (2, 2), (3, 2), (5, 2), (4, 4), (6, 6), (7, 6)}
    path = edges_of(spark, [(i, i + 1) for i in range(1, 200)])
    assert {r["component"] for r in components(nodes_of(spark, 200), path).collect()} == {1}
    assert components(nodes_of(spark, 2), edges_of(spark, [])).count() == 2


def literal_metrics(rows, members, n):
    adj = defaultdict(set)
    for a, b in rows:
        if a != b:
            adj[a].add(b)
            adj[b].add(a)
    inside, deg = set(members), {x: len(adj[x]) for x in range(1, n + 1)}
    edges = sum(deg.values()) / 2
    s_in = sum(len(adj[x] & inside) for x in inside)
    s_out = sum(len(adj[x] - inside) for x in inside)
    ordered = sorted(deg.values())
    median = (ordered[(n - 1) // 2] + ordered[n // 2]) / 2
    tri = sum(any(b in adj[a] for a, b in itertools.combinations(adj[x] & inside, 2)) for x in inside)
    mod = sum((1 if b in adj[a] else 0) - deg[a] * deg[b] / (2 * edges) for a, b in itertools.combinations(sorted(inside), 2)) / (2 * edges)
    d = len(inside)
    return (
        s_out / (d * (n - d)) if d < n else None, s_out / (s_in + s_out) if s_in + s_out else 0, sum(len(adj[x] & inside) >= median for x in inside) / d,
        tri / d, mod, s_in / (d * (d - 1)) if d > 1 else None,
    )


@pytest.mark.parametrize("seed", range(2))
def test_metrics_match_literal_model(spark, seed):
    rng = random.Random(seed)
    n = 18
    rows = random_rows(rng, n, 60)
    sets = {k: set(rng.sample(range(1, n + 1), rng.randrange(1, 9))) for k in range(6)}
    edges, cover, nodes = edges_of(spark, rows), cover_of(spark, sets), nodes_of(spark, n)
    parts = [m.cut_ratio(edges, cover, n), m.conductance(edges, cover), m.fomd(edges, cover, nodes), m.tpr(edges, cover), m.modularity(edges, cover), m.edge_density(edges, cover)]
    got = [{r[0]: r[1] for r in p.collect()} for p in parts]
    for k, members in sets.items():
        for mine, want in zip(got, literal_metrics(rows, members, n)):
            assert mine[k] == (None if want is None else pytest.approx(want, abs=1e-12))
    suite = m.metric_suite(edges, cover, nodes).first()
    assert suite["modularity"] == pytest.approx(sum(got[4].values()))
    assert suite["tpr"] == pytest.approx(sum(got[3].values()) / len(sets))


def test_f1(spark):
    found, truth = cover_of(spark, {1: [1, 2, 3], 2: [4, 5]}), cover_of(spark, {7: [1, 2], 8: [4, 5]})
    assert m.average_f1(found, truth).first()[0] == pytest.approx(0.9)
    pairs = {(r["comm_id"], r["truth_id"]): r["f1"] for r in m.community_f1(found, truth).collect()}
    assert pairs == {(1, 7): pytest.approx(0.8), (2, 8): 1.0}
    assert m.average_f1(found, cover_of(spark, {7: [9]})).first()[0] == 0


def test_dirty_graph_has_two_degrees(spark):
    rows = [*K([1, 2, 3]), (1, 2), (3, 3)]
    assert {tuple(r) for r in g.degrees(edges_of(spark, rows)).collect()} == {(1, 3), (2, 3), (3, 4)}
    assert {tuple(r) for r in g.degrees(g.canonical_edges(edges_of(spark, [*rows, (2, 1), (None, 1)]))).collect()} == {(1, 2), (2, 2), (3, 2)}


def test_schedule_histogram_stats(spark):
    deg = spark.createDataFrame([(i, d) for i, d in enumerate([0, 1, 1, 3, 3, 3, 8, 9])], "node long, deg long")
    assert [tuple(r) for r in g.threshold_schedule(deg).orderBy("threshold").collect()] == [(2, 3), (3, 6), (8, 7)]
    bins = {r["bin"]: r["n"] for r in g.degree_histogram(deg, 3).collect()}
    assert bins == {0: 3, 1: 3, 2: 2}
    same = spark.createDataFrame([(1, 4), (2, 4)], "node long, deg long")
    assert [tuple(r) for r in g.degree_histogram(same).collect()] == [(0, 4.0, 4.0, 2)]
    row = g.degree_stats(deg).first()
    assert (row["n_nodes"], row["median_degree"], row["max_degree"]) == (8, 3.0, 9)
    assert g.max_degree(deg.filter("deg > 99")).first()[0] == 0


def test_growth_and_attachment(spark):
    rows = K([1, 2, 3, 4]) + [(5, 1), (5, 2), (6, 1), (5, 6), (5, 6)]
    edges = edges_of(spark, rows)
    into = {(r["comm_id"], r["node"]): r["n_edges"] for r in gr.edges_to_cluster(edges, cover_of(spark, {1: [1, 2, 3, 4], 2: [6]})).collect()}
    assert into == {(1, 5): 2, (1, 6): 1, (2, 1): 1, (2, 5): 2}
    grown = {(r["node"], r["is_core"]) for r in gr.grow(edges, cover_of(spark, {1: [1, 2, 3, 4]}), 0.8, 0.1).collect()}
    assert grown == {(1, True), (2, True), (3, True), (4, True), (5, False)}
    labelled = spark.createDataFrame([(1, 2), (2, 1), (3, 2)], "node long, label long")
    got = {r["node"]: (r["label"], r["n_edges"]) for r in gr.argmax_attach(edges, labelled, spark.createDataFrame([(4,), (5,), (9,)], "node long")).collect()}
    assert got == {4: (2, 2), 5: (1, 1), 9: (0, 0)}
    nodes = nodes_of(spark, 50)
    a, b = ({r[0] for r in gr.sample_nodes(nodes.repartition(k), 10, seed=3).collect()} for k in (2, 5))
    assert a == b and len(a) == 10
    by = gr.sample_nodes(nodes.selectExpr("node", "node % 3 AS part"), 4, by="part").collect()
    assert Counter(r["part"] for r in by) == {0: 4, 1: 4, 2: 4}
