import random

import pytest

from quillspark.operators import graphs
from quillspark.plans import bindings


@pytest.fixture(scope="module")
def corpus(spark):
    """Notebooks of no to many edges, with cycles; some end where a batch of rows does not."""
    r = random.Random(5)
    edges = {(nb, f"n{r.randrange(size)}", f"n{r.randrange(size)}") for nb, size in [(i, r.choice([2, 5, 30])) for i in range(300)] for _ in range(size)}
    edges |= {(1000, f"n{i}", f"n{i + 1}") for i in range(12_000)}
    seeds = {(nb, f"n{k}") for nb in range(300) for k in (0, 1, 77)} | {(1000, "n11990"), (2000, "n0")}
    return edges, seeds, spark.createDataFrame(sorted(edges), "nb_id long, src string, dst string").repartition(7), spark.createDataFrame(sorted(seeds), "nb_id long, node_id string")


def _plain(edges, seeds):
    out = {}
    for nb, a, b in edges:
        out.setdefault((nb, a), set()).add(b)
    for nb, s in seeds:
        far, todo = {s: 0}, [s]
        for v in todo:
            for w in out.get((nb, v), ()):
                if w not in far:
                    far[w] = far[v] + 1
                    todo.append(w)
        yield from ((nb, s, v, d) for v, d in far.items())


def test_depths_of_small_and_large_notebooks(spark, corpus):
    edges, seeds, e, s = corpus
    want = set(_plain(edges, seeds))
    for large in (graphs.LARGE, 20):  # by walks alone; larger ones by joins
        got = [tuple(r) for r in graphs.closure_frontier(e.where("nb_id < 1000") if large == 20 else e, s.where("nb_id < 1000") if large == 20 else s, large=large).collect()]
        assert len(got) == len(set(got)) and set(got) == {x for x in want if large > 20 or x[0] < 1000}
    near = graphs.closure_frontier(e, s, depth=2)
    assert {tuple(r) for r in near.collect()} == {x for x in want if x[3] <= 2}


def test_depths_move_edges_once(spark, corpus):
    *_, e, s = corpus
    plan = graphs.closure_frontier(e, s)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "FlatMapGroups" not in plan and plan.count("MapInArrow") == 1


def test_walks_over_streamed_notebooks(spark, corpus):
    edges, seeds, e, s = corpus
    want = {(nb, a, b) for nb, a, b, d in _plain(edges, seeds) if d} | {(nb, a, a) for nb, a in seeds if any(x[0] == nb and x[2] == a and x[1] in {v for n, q, v, _ in _plain(edges, {(nb, a)})} for x in edges if x[0] == nb)}
    assert {tuple(r) for r in graphs.walks(e, s).collect()} == want
    assert {tuple(r) for r in graphs.reached(e, s).collect()} == {(nb, b) for nb, _, b in want}
    small = e.where("nb_id < 40")
    every = {(nb, x) for nb, a, b in edges if nb < 40 for x in (a, b)}
    assert {tuple(r) for r in graphs.closure(small).collect()} == {tuple(r) for r in graphs.walks(small, spark.createDataFrame(sorted(every), "nb_id long, node_id string")).collect()}


def test_users_are_dealt_to_more_tasks_as_events_grow(spark, monkeypatch):
    monkeypatch.setattr(bindings, "EVENTS", 10)
    n, e = bindings.graph(spark, "/root/testdata/sf0.001")
    rows = bindings.table(spark, "/root/testdata/sf0.001", "events").count()
    for df in (n, e):
        assert df.rdd.getNumPartitions() >= rows // 10
