"""Attention over tables against dense matrices, and ordered provenance against a plain loop."""

import random

import numpy as np

from quillspark.operators import attention as A
from quillspark.operators import graphs

SIDES, HEADS, LAYERS, HIDDEN = ["operation", "variable"], 2, 2, 8
RELATIONS = [("in", "variable", "operation"), ("out", "operation", "variable"), ("rev_in", "operation", "variable")]


def dense_logits(nodes, edges, w):
    at = {k: i for i, k in enumerate(nodes)}
    h = {k: A.gelu(A.normed(A.dense(np.array(x)[None], w, f"in.{s}"), w, f"norm.{s}"))[0] for k, (s, x) in nodes.items()}
    d = HIDDEN // HEADS
    for i in range(LAYERS):
        new = {}
        for k, (s, _) in nodes.items():
            q = A.dense(h[k][None], w, f"{i}.q.{s}").reshape(HEADS, d)
            logit, value = [], []
            for nb, r, a, b in edges:
                known = next((x for x in RELATIONS if x[0] == r), None)
                if known and (nb, b) == k and (nb, a) in at and nodes[nb, a][0] == known[1] and s == known[2]:
                    key = A.dense(h[nb, a][None], w, f"{i}.k.{known[1]}").reshape(HEADS, d)
                    val = A.dense(h[nb, a][None], w, f"{i}.v.{known[1]}").reshape(HEADS, d)
                    logit.append([q[x] @ (key[x] @ w[f"{i}.key.{r}"][x]) * w[f"{i}.weight.{r}"][x] / np.sqrt(d) for x in range(HEADS)])
                    value.append([val[x] @ w[f"{i}.value.{r}"][x] for x in range(HEADS)])
            m = np.zeros(HIDDEN)
            if logit:
                p = np.exp(np.array(logit) - np.max(logit, 0))
                m = ((p / p.sum(0))[..., None] * np.array(value)).sum(0).ravel()
            keep = 1 / (1 + np.exp(-w[f"{i}.skip.{s}"]))
            got = keep * A.dense(A.gelu(m)[None], w, f"{i}.out.{s}")[0] + (1 - keep) * h[k]
            new[k] = A.gelu(A.normed((got + h[k])[None], w, f"{i}.norm.{s}"))[0]
        h = new
    return {k: A.dense(A.gelu(A.dense(h[k][None], w, "first")), w, "last")[0] for k, (s, _) in nodes.items() if s == "operation"}


def test_logits_equal_dense_ones(spark):
    r, rng = random.Random(1), np.random.default_rng(1)
    w = {k: np.asarray(rng.normal(0, 0.5, v)) for k, v in A.names(SIDES, RELATIONS, LAYERS, {"operation": 3, "variable": 5}, HIDDEN, 4, HEADS).items()}
    nodes = {(nb, f"n{i}"): (s := r.choice(SIDES), [r.gauss(0, 1) for _ in range(3 if s == "operation" else 5)]) for nb in (1, 2) for i in range(9)}
    # a hub, parallel edges, a lone node, ends of the wrong side, relations and nodes that aren't there
    edges = [(nb, r.choice(RELATIONS)[0], f"n{r.randrange(8)}", f"n{r.choice([0, 0, r.randrange(8)])}") for nb in (1, 2) for _ in range(60)] + [(1, "other", "n1", "n2"), (1, "in", "gone", "n1")]
    n = spark.createDataFrame([(*k, s, x) for k, (s, x) in nodes.items()], "nb_id long, node_id string, side string, x array<double>")
    e = spark.createDataFrame(edges, "nb_id long, relation string, src string, dst string").repartition(3)
    got = {(x.nb_id, x.node_id): x.logits for x in A.classify(n, e, w, RELATIONS, LAYERS, HEADS).collect()}
    want = dense_logits(nodes, edges, w)
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-5) for k in want)


def plain_histories(nodes, edges, sweeps):
    """{node: (base inputs, history)} by sweeps that compare whole lists."""
    order = [n for n, *_ in nodes]
    label, code, kind = ({n: x[k] for n, *x in nodes} for k in range(3))
    before = {n: list(dict.fromkeys(a for a, b in edges if b == n and a in label)) for n in order}
    hist, base = {n: [] for n in order}, {n: [] for n in order}
    for _ in range(sweeps):
        size = sum(map(len, hist.values())) + sum(map(len, base.values()))
        for n in order:
            for p in before[n]:
                hist[n] += [x for x in hist[p] if x not in hist[n]]
                base[n] += [x for x in base[p] if x not in base[n]]
                if kind[p] == 1 and label[p] not in base[n]:
                    base[n].append(label[p])
                if kind[p] in (3, 6, 9) and kind[n] not in (3, 6, 9) and (label[p], label[n], code[p]) not in hist[n]:
                    hist[n].append((label[p], label[n], code[p]))
        if size == sum(map(len, hist.values())) + sum(map(len, base.values())):
            break
    return {n: (", ".join(sorted(base[n])) or None, hist[n]) for n in order}


def test_histories_come_in_the_order_of_a_plain_loop(spark):
    r, graphs_ = random.Random(2), {}
    for nb in range(25):
        n = r.choice([1, 6, 12])
        nodes = [(f"n{i}", f"l{r.randrange(8)}", f"c{r.randrange(3)}", r.choice([0, 1, 2, 3, 6, 9, 9])) for i in range(n)]
        graphs_[nb] = nodes, [(f"n{r.randrange(n)}", f"n{r.randrange(n)}") for _ in range(r.choice([0, n, 2 * n]))]
    # a way back over forty nodes, which fifteen sweeps don't end
    graphs_[99] = [(f"n{i}", f"l{i}", "c", 9 if i == 39 else 0) for i in range(40)], [(f"n{i + 1}", f"n{i}") for i in range(39)]
    n = spark.createDataFrame([(nb, o, *x) for nb, (nodes, _) in graphs_.items() for o, x in enumerate(nodes)], "nb_id long, ord long, node_id string, label string, code string, struct_type int").repartition(3)
    e = spark.createDataFrame([(nb, o, a, b) for nb, (_, es) in graphs_.items() for o, (a, b) in enumerate(es)], "nb_id long, ord long, src string, dst string").repartition(3)
    got = {(x.nb_id, x.node_id): (x.base_inputs, [tuple(s) for s in x.transform_history]) for x in graphs.provenance(n, e).collect()}
    want = {(nb, k): v for nb, (nodes, es) in graphs_.items() for k, v in plain_histories(nodes, es, graphs.SWEEPS).items()}
    assert got == want and sum(bool(want[99, f"n{i}"][1]) for i in range(40)) == 15
