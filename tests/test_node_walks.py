"""Walks against plain ones drawn by the same numbers, and embeddings of planted communities."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillspark.operators import node_walks as W


def plain_draw(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[: W.DIGITS], 16)


def plain_walk(out, nb, start, walk, length, p, q, seed):
    most, before, here, path = max(1.0, 1 / p, 1 / q), None, start, [start]
    for step in range(1, length + 1):
        near = out.get((nb, here), [])
        if not near:
            break
        t = 0
        while True:
            to = near[plain_draw(seed, nb, start, walk, step, t) % len(near)]
            weight = most if before is None else 1 / p if to == before else 1.0 if to in out.get((nb, before), []) else 1 / q
            if p == q == 1 or plain_draw(seed, "keep", nb, start, walk, step, t) / W.DRAWS < weight / most:
                break
            t += 1
        before, here = here, to
        path.append(to)
    return path


@pytest.mark.parametrize("p,q", [(1.0, 1.0), (0.25, 4.0)])
def test_walks(spark, p, q):
    rng = random.Random(3)
    rows = [(nb, f"n{rng.randrange(12)}", f"n{rng.randrange(12)}") for nb in (1, 2) for _ in range(40)] + [(1, None, "n1"), (1, "n1", "n2"), (1, "n1", "n2")] + [(2, "hub", f"n{i}") for i in range(12)]
    names = [(nb, f"n{i}") for nb in (1, 2) for i in range(12)] + [(2, "hub"), (2, "alone"), (2, "alone"), (2, None)]
    out = defaultdict(set)
    for nb, a, b in rows:
        if a and b:
            out[nb, a].add(b)
    out = {k: sorted(v) for k, v in out.items()}
    n, e = spark.createDataFrame(names, "nb_id long, node_id string"), spark.createDataFrame(rows, "nb_id long, src string, dst string")
    expected = Counter((nb, s, w, i, v) for nb, s in {x for x in names if x[1]} for w in (1, 2) for i, v in enumerate(plain_walk(out, nb, s, w, 4, p, q, 7)))
    for parts in (1, 3):
        got = W.random_walks(n.repartition(parts), e.repartition(parts), 4, 2, p, q, 7)
        assert Counter(tuple(r) for r in got.collect()) == expected


def test_empty(spark):
    n, e = spark.createDataFrame([], "nb_id long, node_id string"), spark.createDataFrame([], "nb_id long, src string, dst string")
    w = W.random_walks(n, e, 2, 2)
    assert w.count() == W.vectors(W.embed(W.skip_grams(w))).count() == 0


def test_neighbours_are_nearer_than_strangers(spark):
    """Three groups of eight, each node with five edges inside and every fourth with one outside."""
    rng, rows = random.Random(5), []
    for g in range(3):
        for i in range(8):
            rows += [(1, f"{g}-{i}", f"{g}-{j}") for j in rng.sample([j for j in range(8) if j != i], 5)]
            if i % 4 == 0:
                rows.append((1, f"{g}-{i}", f"{(g + 1) % 3}-{i}"))
    e = spark.createDataFrame(rows, "nb_id long, src string, dst string")
    n = spark.createDataFrame([(1, f"{g}-{i}") for g in range(3) for i in range(8)], "nb_id long, node_id string")
    walks = W.random_walks(n, e, 6, 6, seed=1)
    got = {r.node_id: np.array(r.embedding) for r in W.vectors(W.embed(W.skip_grams(walks, 3), 64)).collect()}
    near = lambda a, b: got[a] @ got[b] / np.sqrt((got[a] @ got[a]) * (got[b] @ got[b]))
    same = [near(a, b) for a in got for b in got if a < b and a[0] == b[0]]
    other = [near(a, b) for a in got for b in got if a < b and a[0] != b[0]]
    assert len(got) == 24 and np.mean(same) > np.mean(other) + 0.3


def test_grams_of_paths_and_their_projection(spark):
    """Pairs counted in one direction and signs made for each context give what plain loops over both directions and all dims do."""
    rng = random.Random(11)
    paths = [(nb, f"n{i}", w, [f"n{rng.randrange(9)}" for _ in range(rng.randrange(1, 7))]) for nb in (1, 2) for i in range(9) for w in (1, 2)]
    n = Counter((nb, path[i], path[j]) for nb, _, _, path in paths for i in range(len(path)) for j in range(len(path)) if 1 <= abs(i - j) <= 2)
    of = spark.createDataFrame(paths, "nb_id long, start string, walk int, path array<string>")
    grams = W.path_grams(of, 2)
    assert {(r.nb_id, r.node_id, r.context): r.n for r in grams.collect()} == n and grams.count() == len(n)
    rows = of.selectExpr("nb_id", "start", "walk", "posexplode(path) as (step, node_id)")
    assert Counter(map(tuple, W.skip_grams(rows.repartition(3), 2).collect())) == Counter((*k, v) for k, v in n.items())
    dims = 65  # more signs than one number has
    total, left, right = Counter(), Counter(), Counter()
    for (nb, a, b), c in n.items():
        total[nb] += c
        left[nb, a] += c
        right[nb, b] += c
    expected = defaultdict(float)
    for (nb, a, b), c in n.items():
        for d in range(dims):
            expected[nb, a, d] += max(0.0, np.log(c * total[nb] / (left[nb, a] * right[nb, b]))) * (1 if plain_draw(42, b, d) % 2 == 0 else -1) / np.sqrt(dims)
    made = W.embed(grams, dims)
    got = {(r.nb_id, r.node_id, r.dim): r.value for r in made.collect()}
    assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-9 for k in got)
    # a pair is no row for each dim: dims are told apart behind the sums
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("posexplode") < plan.index("Aggregate")
