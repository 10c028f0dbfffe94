"""Centralities against plain loops, by one task and by joins, and on a graph that no dense matrix would hold."""

import random
import resource

import numpy as np
import pytest

from quillspark.operators import centrality as C


def graph(seed, n, m):
    r = random.Random(seed)
    return [f"n{i}" for i in range(n)], [(f"n{r.randrange(n)}", f"n{r.randrange(n)}") for _ in range(m)]


def plain(names, edges):
    """{node: (in, out, betweenness, pagerank, clustering)} by dense matrices and search."""
    at, n = {x: i for i, x in enumerate(names)}, len(names)
    many = np.zeros((n, n))
    for a, b in edges:
        many[at[a], at[b]] += 1
    a = (many > 0).astype(float)
    rank, out = np.full(n, 1 / n), a.sum(1)
    for _ in range(5):
        rank = 0.85 * ((rank / np.where(out > 0, out, 1) * (out > 0)) @ a + rank[out == 0].sum() / n) + 0.15 / n
    b = a - np.diag(np.diag(a))
    sym = b + b.T
    room = sym.sum(1) * (sym.sum(1) - 1) - 2 * np.diag(b @ b)
    cluster = np.where(room > 0, np.diag(sym @ sym @ sym) / 2 / np.where(room > 0, room, 1), 0)
    between = np.zeros(n)
    for s in range(n):
        dist, ways, order = {s: 0}, {s: 1}, [s]
        for v in order:
            for w in np.flatnonzero(a[v]).tolist():
                if w not in dist:
                    dist[w], ways[w] = dist[v] + 1, 0
                    order.append(w)
                if dist[w] == dist[v] + 1:
                    ways[w] += ways[v]
        owed = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in order:
                if a[v, w] and dist[w] == dist[v] + 1:
                    owed[v] += ways[v] / ways[w] * (1 + owed[w])
            if w != s:
                between[w] += owed[w]
    between = between / ((n - 1) * (n - 2)) if n > 2 else between * 0
    k = max(n - 1, 1)
    return {x: (many.sum(0)[i] / k, many.sum(1)[i] / k, between[i], rank[i], cluster[i]) for x, i in at.items()}


@pytest.mark.parametrize("one_task", [10**6, 0])
def test_against_plain_loops(spark, one_task):
    graphs = {1: graph(1, 7, 10), 2: graph(2, 6, 25), 3: (["n0"], []), 4: (["n0", "n1"], [("n0", "n1"), ("n1", "n0"), ("n0", "n0")]), 5: graph(3, 6, 6)}
    nodes = spark.createDataFrame([(nb, x) for nb, (names, _) in graphs.items() for x in names], "nb_id long, node_id string")
    edges = spark.createDataFrame([(nb, a, b) for nb, (_, es) in graphs.items() for a, b in es] + [(1, "n0", "gone")], "nb_id long, src string, dst string")
    got = {(r.nb_id, r.node_id): tuple(r)[2:] for r in C.centrality(nodes, edges, rounds=5, tol=0, one_task=one_task).collect()}
    want = {(nb, x): v for nb, (names, es) in graphs.items() for x, v in plain(names, es).items()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-9) for k in want)


def test_a_notebook_keeps_ranks_that_have_settled(spark):
    nodes = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (2, "c")], "nb_id long, node_id string")
    edges = spark.createDataFrame([(1, "a", "b"), (1, "b", "a"), (2, "a", "b"), (2, "b", "c"), (2, "c", "b")], "nb_id long, src string, dst string")
    one, other = ({(r.nb_id, r.node_id): r.pagerank for r in C.centrality(nodes, edges, one_task=t).collect()} for t in (10**6, 0))
    assert one.keys() == other.keys() and all(abs(one[k] - other[k]) < 1e-12 for k in one)


def test_pivots_keep_their_bound():
    r = np.random.default_rng(1)
    n, src, dst = 400, r.integers(0, 400, 1600), r.integers(0, 400, 1600)
    exact, k = C.between(n, src, dst, np.arange(n)), C.pivots(n, 0.15)
    assert k < n and C.pivots(50, 0.15) == 50 and C.pivots(n, 0) == n
    assert np.abs(C.between(n, src, dst, np.sort(r.permutation(n)[:k])) - exact).max() < 0.15


def test_fifty_thousand_nodes_in_little_memory():
    r = np.random.default_rng(2)
    n = 50_000
    src, dst = np.append(np.arange(n - 1), r.integers(0, n, 150_000)), np.append(np.arange(1, n), r.integers(0, n, 150_000))
    src, dst = np.append(src, np.zeros(20_000, int)), np.append(dst, np.arange(20_000))  # a hub
    edges = np.unique(src * n + dst)
    src, dst = edges // n, edges % n
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert abs(C.ranks(n, src, dst, 0.85, 100, 1e-6).sum() - 1) < 1e-9 and C.triangles(n, src, dst).max() <= 1
    assert C.between(n, src, dst, r.permutation(n)[: C.pivots(n, 0.2)]).max() < 1
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 2_000_000  # KB


def test_empty_tables(spark):
    nodes, edges = spark.createDataFrame([], "nb_id long, node_id string"), spark.createDataFrame([], "nb_id long, src string, dst string")
    assert not C.centrality(nodes, edges).count()
