"""Joins and groups of the lineage projection run in tasks that grow in number with the rows, with the results of few tasks."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import lineage, shared

NODES = "nb_id long, node_id string, ord long, node_type int, domain_node boolean, code string, label string, cell_id string, predicted_label int"


@pytest.fixture(scope="module")
def graph(spark):
    """Notebooks with ends that are no nodes, repeated edges, nodes without a cell and rows without a notebook."""
    rng = random.Random(4)
    n = [(nb, f"n{i}", i, rng.choice([0, 1, 2, 2, 4, 7, 9]), rng.random() < 0.7, "f(x)", f"l{i}", None if rng.random() < 0.1 else f"c{i % 4}", rng.choice([None, 1, 2])) for nb in range(6) for i in range(12)] + [(None, "n0", 0, 2, False, "f(x)", "l", "c0", 2), (None, "n1", 1, 9, False, "f(x)", "l", "c1", 2)]
    e = [(nb, f"n{rng.randrange(14)}", f"n{rng.randrange(14)}", i) for nb in range(6) for i in range(40)] + [(0, "n0", "n1", 90), (0, "n0", "n1", 91), (None, "n0", "n1", 0)]
    return n, e, spark.createDataFrame(n, NODES), spark.createDataFrame(e, "nb_id long, src string, dst string, ord long")


def test_anchors_by_loops_in_more_tasks(graph, monkeypatch):
    rows, ways, n, e = graph
    monkeypatch.setattr(shared, "ROWS", 5, raising=False)
    at = {(r[0], r[1]): r for r in rows if r[0] is not None}
    expected = {}
    for r in rows:
        if r[3] in (1, 2, 7) or r[3] == 4 and r[4]:
            first = {}
            for nb, src, dst, o in ways:
                if (nb, src) == (r[0], r[1]) and (d := at.get((nb, dst))) and d[3] in (9, 4) and d[7] is not None:
                    first[dst] = min(first.get(dst, o), o)
            expected[r[0], r[1]] = [r[7], *(at[r[0], dst][7] for dst in sorted(first, key=first.get))]
    got = lineage.anchors(n, e)
    assert {(x.nb_id, x.node_id): x.occurrences for x in got.collect()} == expected
    assert got.rdd.getNumPartitions() == -(-len(rows) // 5)


def test_projection_in_more_tasks(graph, monkeypatch):
    shared.checkpoints(graph[2].sparkSession)
    made = []
    for size in (10**6, 5):
        monkeypatch.setattr(shared, "ROWS", size, raising=False)
        macro, ways = lineage.project(*graph[2:])
        made.append([sorted(map(repr, df.collect())) for df in (macro, ways.select("nb_id", "src", "dst"))])
    assert made[0] == made[1] and all(made[0])


def test_steps_follow_the_larger_table(graph, monkeypatch):
    monkeypatch.setattr(shared, "ROWS", 5, raising=False)
    _, ways, n, e = graph
    n = n.withColumns({"base_inputs": F.array().cast("array<string>"), "occurrences": F.array("cell_id")})
    e = e.select("nb_id", "src", "dst", F.array(F.lit("f")).alias("operations"), F.lit(2).alias("predicted_label"))
    folded = lineage.fold_auxiliary(n.drop("base_inputs"), e)
    shared.checkpoints(n.sparkSession)
    merged = lineage.collapse(n.where("node_type in (2, 4)"), e)
    assert [df.rdd.getNumPartitions() for df in (*folded, merged[1], lineage.chains(n, e))] == [-(-len(ways) // 5)] * 4
