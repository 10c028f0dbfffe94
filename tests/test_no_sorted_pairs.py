"""Walks and matches whose pairs are made once, so that no task sorts or compares more of them as tables grow."""

import random
from collections import defaultdict

import pytest

from quillspark.operators import graphs, knowledge, lineage


def reach(edges, start):
    seen, todo = set(), [start]
    for v in todo:
        fresh = {b for a, b in edges if a == v} - seen
        seen |= fresh
        todo += fresh
    return seen


@pytest.fixture(scope="module")
def graph(spark):
    """Two notebooks with cycles, loops, repeated edges and a node apart."""
    rng = random.Random(8)
    rows = [(nb, f"n{rng.randrange(11)}", f"n{rng.randrange(11)}", rng.randrange(6)) for nb in (1, 2) for _ in range(13)] + [(1, "n3", "n3", 1), (2, "x", "y", 1), (2, "x", "y", 1), (2, "y", "z", 0), (3, "p", "q", 1), (3, "q", "p", 1)]
    return rows, spark.createDataFrame(rows, "nb_id long, src string, dst string, label int")


def logical(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_around_variable(spark, graph):
    rows, e = graph
    seeds = [(1, "n0"), (1, "n3"), (1, "n3"), (1, "alone"), (2, "y"), (3, "p")]
    got = graphs.around_variable(e, spark.createDataFrame(seeds, "nb_id long, node_id string"))
    expected = set()
    for nb, s in seeds:
        ways = {(a, b) for n, a, b, _ in rows if n == nb}
        expected |= {(nb, s, v) for v in {s} | reach(ways, s) | reach({(b, a) for a, b in ways}, s)}
    found = [tuple(r) for r in got.collect()]
    assert set(found) == expected and len(found) == len(expected)
    assert "Aggregate" not in logical(got)


def test_gold_tuples(spark, graph):
    rows, e = graph
    expected = set()
    for nb in (1, 2, 3):
        ways = {(a, b) for n, a, b, _ in rows if n == nb}
        roots = {b for n, _, b, x in rows if n == nb and x == 1}
        tops = {r for r in roots if not any(r in reach(ways, o) for o in roots - {r})}
        for t in tops:
            ends = {(b, x) for n, _, b, x in rows if n == nb and x in (0, 4) and b in reach(ways, t) - {t}}
            expected |= {(nb, "<M, D>", b, t) if x == 0 else (nb, "<D, D>", t, b) for b, x in ends} or {(nb, "<D, Empty>", t, "Empty")}
    found = [tuple(r) for r in lineage.gold_tuples(None, e).collect()]
    assert set(found) == expected and len(found) == len(expected)
    # only ends of walks are rows
    got = graphs.first_walks(e, spark.createDataFrame([(2, "x"), (2, "y")], "nb_id long, node_id string"), spark.createDataFrame([(2, "z"), (2, "unknown")], "nb_id long, node_id string"))
    assert ("x", "z") in {(r.seed, r.node_id) for r in got.collect()} and {r.node_id for r in got.collect()} == {"z"}


def test_histories_go_with_their_nodes(spark):
    """Rows of nodes, repeated ones too, come back whole, and no join brings them."""
    n = spark.createDataFrame([(1, "a", 0, "pd", 1, None, [1.5]), (1, "b", 1, "fit", 9, "f(x)", None), (1, "c", 2, "df", 2, None, [2.0]), (1, "c", 2, "df", 2, None, [3.0]), (2, "d", 0, None, 1, None, None)], "nb_id long, node_id string, ord long, label string, struct_type int, code string, `more of it` array<double>")
    e = spark.createDataFrame([(1, "a", "b", 0), (1, "b", "c", 1), (1, "gone", "c", 2)], "nb_id long, src string, dst string, ord long")
    got = graphs.provenance(n, e)
    assert got.columns == [*n.columns, "base_inputs", "transform_history", "n_steps"]
    found = sorted((r.node_id, str(r["more of it"]), r.base_inputs, [tuple(s) for s in r.transform_history], r.n_steps) for r in got.collect())
    step = [("fit", "df", "f(x)")]
    assert found == [("a", "[1.5]", None, [], 0), ("b", "None", "pd", [], 0), ("c", "[2.0]", "pd", step, 1), ("c", "[3.0]", "pd", step, 1), ("d", "None", None, [], 0)]
    assert "Join" not in logical(got)


def test_match_nodes(spark):
    """Spans before names, the widest overlap, then the first; long spans lie on many cells."""
    rng = random.Random(4)
    span = lambda: rng.choice([(None, None), (a := float(rng.randrange(9000)), a + rng.choice([50, 700, 6000]))])
    asked = [(f"p{rng.randrange(6)}:{i}", i % 3, *span()) for i in range(60)]
    gold = [(f"g{i}", i % 3, *span(), rng.choice([None, "", f" p{rng.randrange(6)} "]), i // 2) for i in range(40)]
    expected = {}
    for ask, nb, s, e in asked:
        own, named = [], defaultdict(list)
        for g, n, gs, ge, code, o in gold:
            if n == nb and s is not None and gs is not None and gs < e and s < ge and (min(e, ge) - max(s, gs)) / min(e - s, ge - gs) >= 0.5:
                own.append((-(min(e, ge) - max(s, gs)) / min(e - s, ge - gs), o, g))
            if n == nb and code and code.strip() == ask.split(":")[0]:
                named[ask].append((o, g))
        if own or named:
            expected[ask] = min(own)[-1] if own else min(named[ask])[-1]
    a, g = spark.createDataFrame(asked, "ask_id string, nb_id long, s double, e double"), spark.createDataFrame(gold, "gold_id string, nb_id long, s double, e double, code string, ord long")
    got = knowledge.match_nodes(a, g)
    found = [tuple(r) for r in got.collect()]
    assert dict(found) == expected and len(found) == len(expected)
    plan = logical(got)
    assert plan.count("Join") == 2 and "Window" not in plan
