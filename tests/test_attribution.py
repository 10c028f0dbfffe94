"""Attributions of tree models against the definition by subsets, and their sums against the model's margin."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import attribution as A
from quillspark.operators import labelers

TREES = "tree long, node long, feature int, threshold double, left long, right long, cover double, value double"


def grow(rng, tree, depth, width):
    rows, todo, n = [], [(0, depth, 1024.0)], 1
    while todo:
        node, left, cover = todo.pop()
        if left == 0 or (node and rng.random() < 0.2):
            rows.append((tree, node, None, None, None, None, cover, rng.uniform(-1, 1)))
            continue
        a = float(rng.randrange(0, int(cover) + 1)) if cover else 0.0
        rows.append((tree, node, rng.randrange(width), rng.choice([0.25, 0.5, 0.75]), n, n + 1, cover, 0.3))
        todo += [(n, left - 1, a), (n + 1, left - 1, cover - a)]
        n += 2
    return rows


def expected(nodes, x, known, node=0):
    _, _, f, t, left, right, cover, value = nodes[node]
    if left is None:
        return value
    if f in known:
        return expected(nodes, x, known, left if x[f] is not None and x[f] <= t else right)
    return sum(nodes[c][6] / cover * expected(nodes, x, known, c) for c in (left, right)) if cover else 0.0


def by_subsets(nodes, x):
    m, phi = len(x), [0.0] * len(x)
    for i in range(m):
        others = [j for j in range(m) if j != i]
        for r in range(m):
            for s in itertools.combinations(others, r):
                weight = math.factorial(r) * math.factorial(m - r - 1) / math.factorial(m)
                phi[i] += weight * (expected(nodes, x, {*s, i}) - expected(nodes, x, set(s)))
    return phi


def test_against_subsets(spark, monkeypatch):
    rng = random.Random(4)
    trees = [r for t in range(4) for r in grow(rng, t, 5, 5)]
    # ties with a threshold, entries that are null
    rows = [(i, [rng.choice([0.25, 0.5, None, rng.random()]) for _ in range(5)]) for i in range(12)] + [(99, None)]
    leaves = A.leaf_paths(spark.createDataFrame(trees, TREES)).cache()
    df = spark.createDataFrame(rows, "id long, features array<double>")
    for at_once in (1 << 16, 7):
        monkeypatch.setattr(A, "LEAVES", at_once)
        got = {r["id"]: r for r in A.attribute(df, leaves).collect()}
        assert got[99]["attributions"] is None and set(got) == {r[0] for r in rows}
        for i, x in rows[:-1]:
            want, base = np.zeros(5), 0.0
            for t in range(4):
                nodes = {r[1]: r for r in trees if r[0] == t}
                want += by_subsets(nodes, x)
                base += expected(nodes, x, set())
            assert got[i]["attributions"] == pytest.approx(want, abs=1e-12) and got[i]["base"] == pytest.approx(base)


def test_sums_to_the_margin(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, x := [rng.random() for _ in range(4)], int(x[0] + x[1] * x[2] > 0.8)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, features array<double>, label int")
    both = labelers.fit(df, "trees", 2)
    model = both.stages[0].models[1]
    model.write().overwrite().save(str(tmp_path / "m"))
    leaves = A.leaf_paths(A.tree_table(spark, str(tmp_path / "m"), model.treeWeights))
    got = A.attribute(df, leaves).select("id", "features", (F.col("base") + F.aggregate("attributions", F.lit(0.0), lambda a, x: a + x)).alias("margin"), "attributions").collect()
    from pyspark.ml.linalg import Vectors

    for r in got[:60]:
        # raw predictions are the margin against and for the class
        assert r["margin"] == pytest.approx(model.predictRaw(Vectors.dense(r["features"]))[1], abs=1e-9)
    told = {r["id"]: r for r in A.explain(df, both, str(tmp_path / "classes")).collect()}
    assert set(told) == set(range(200)) and {r["predicted_label"] for r in told.values()} == {0, 1}
    for r in got:
        if told[r["id"]]["predicted_label"] == 1:
            assert told[r["id"]]["attributions"] == pytest.approx(r["attributions"])
    size = np.abs([r["attributions"] for r in got]).sum(0)
    assert size[0] == size.max() and size[3] == size.min()


def test_spans(spark):
    df = spark.createDataFrame([(1, [3.0, -1.0, 0.0, 4.0]), (2, [0.0] * 4), (3, None), (4, [1.0, -1.0, 1.0, 0.0])], "id long, attributions array<double>")
    got = {(r["id"], r["group"]): (r["share"], [(t["dim"], t["share"], t["value"]) for t in r["top"]]) for r in A.of_spans(df, ["id"], [("a", 0, 3), ("b", 3, 4)], 2).collect()}
    assert got[1, "a"] == (0.5, [(0, 0.75, 3.0), (1, 0.25, -1.0)]) and got[1, "b"] == (0.5, [(3, 1.0, 4.0)])
    assert got[2, "a"] == (0.0, []) and (3, "a") not in got
    assert got[4, "a"][1] == [(0, 1 / 3, 1.0), (1, 1 / 3, -1.0)] and got[4, "b"] == (0.0, [])


def test_empty_and_lone_leaf(spark):
    lone = A.leaf_paths(spark.createDataFrame([(0, 0, None, None, None, None, 5.0, 0.75)], TREES))
    df = spark.createDataFrame([(1, [1.0, 2.0])], "id long, features array<double>")
    r = A.attribute(df, lone).first()
    assert r["attributions"] == [0.0, 0.0] and r["base"] == 0.75
    none = A.leaf_paths(spark.createDataFrame([], TREES))
    assert A.attribute(df, none).first()["base"] == 0.0 and A.attribute(df.limit(0), lone).count() == 0
    with pytest.raises(ValueError, match="made here"):
        A.attribute(df.withColumn("Base", F.lit(1)), lone)
