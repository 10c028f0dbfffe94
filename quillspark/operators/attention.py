"""Inference of a heterogeneous attention network over tables of nodes and edges, weights given.

A layer is: every node's key and value for each relation that leaves its side,
one join with the edges, and a softmax over each target's edges of all
relations. The softmax is summed up where the edges are and merged by target, so
that a node with very many edges is no large group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpoints


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + np.vectorize(math.erf)(x / math.sqrt(2)))


def normed(x: np.ndarray, w: dict, name: str, eps: float = 1e-5) -> np.ndarray:
    return (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + eps) * w[f"{name}.scale"] + w[f"{name}.shift"]


def dense(x: np.ndarray, w: dict, name: str) -> np.ndarray:
    return x @ w[f"{name}.w"] + w[f"{name}.b"]


def names(sides: list[str], relations: list[tuple[str, str, str]], layers: int, widths: dict[str, int], hidden: int, classes: int, heads: int) -> dict[str, tuple[int, ...]]:
    """The network's weights by name, with their shapes: `in`, `k`, `q`, `v`, `out`, `norm`, `skip` of each side, `key`, `value`, `weight` of each relation, `first` and `last`."""
    d, shapes = hidden // heads, {"first.w": (hidden, hidden), "first.b": (hidden,), "last.w": (hidden, classes), "last.b": (classes,)}
    linear = lambda name, a, b: shapes.update({f"{name}.w": (a, b), f"{name}.b": (b,)})
    norm = lambda name: shapes.update({f"{name}.scale": (hidden,), f"{name}.shift": (hidden,)})
    for s in sides:
        linear(f"in.{s}", widths[s], hidden)
        norm(f"norm.{s}")
        for i in range(layers):
            for part in ("k", "q", "v", "out"):
                linear(f"{i}.{part}.{s}", hidden, hidden)
            norm(f"{i}.norm.{s}")
            shapes[f"{i}.skip.{s}"] = ()
    for r, _, _ in relations:
        for i in range(layers):
            shapes |= {f"{i}.key.{r}": (heads, d, d), f"{i}.value.{r}": (heads, d, d), f"{i}.weight.{r}": (heads,)}
    return shapes


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.array(x.reshape(len(x), -1).tolist(), pa.list_(pa.float64()))


def _by_side(batches: Iterator[pa.RecordBatch], make) -> Iterator[pa.RecordBatch]:
    """make(side, rows) for the rows of each side of a batch."""
    for b in batches:
        sides = np.array(b.column("side").to_pylist(), object)
        for s in sorted(set(sides)):
            yield from make(s, b.take(pa.array(np.flatnonzero(sides == s))))


def _merged(part: list[tuple[np.ndarray, np.ndarray, np.ndarray]], group: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Softmax sums (most, weight, vector by head) of rows, put together by group."""
    most, weight, value = part
    top = np.full((n, most.shape[1]), -np.inf)
    np.maximum.at(top, group, most)
    share = np.exp(most - top[group]) * weight
    sums, vectors = np.zeros_like(top), np.zeros((n, *value.shape[1:]))
    np.add.at(sums, group, share)
    np.add.at(vectors, group, np.exp(most - top[group])[..., None] * value)
    return top, sums, vectors


def classify(nodes: DataFrame, edges: DataFrame, w: dict[str, np.ndarray], relations: list[tuple[str, str, str]], layers: int, heads: int, target: str = "operation") -> DataFrame:
    """(nb_id, node_id, logits) of the target side's nodes.

    nodes(nb_id, node_id, side, x array<double>), edges(nb_id, relation, src,
    dst); relations are (name, source side, target side). Parallel edges count
    each. A node without edges keeps its own part; edges of other relations or
    with an end that is no node of the relation's side are left out.
    """
    checkpoints(nodes.sparkSession)
    kind = nodes.schema["nb_id"].dataType.simpleString()
    hidden = len(w["first.b"])
    d = hidden // heads
    leave = {}
    for r, a, _ in relations:
        leave.setdefault(a, []).append(r)

    def start(s: str, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        h = gelu(normed(dense(_matrix(b.column("x")), w, f"in.{s}"), w, f"norm.{s}"))
        yield pa.RecordBatch.from_arrays([b.column("nb_id"), b.column("node_id"), b.column("side"), _lists(h)], names=["nb_id", "node_id", "side", "h"])

    state = f"nb_id {kind}, node_id string, side string, h array<double>"
    now = nodes.select("nb_id", "node_id", "side", "x").mapInArrow(lambda bs: _by_side(bs, start), state).checkpoint()
    sides = {r: (a, b) for r, a, b in relations}
    of = F.create_map(*(F.lit(x) for r, (a, b) in sides.items() for x in (r, b)))
    ways = edges.where(F.col("relation").isin(*sides)).select("nb_id", "relation", "src", "dst", of[F.col("relation")].alias("side")).checkpoint()
    for i in range(layers):

        def given(s: str, b: pa.RecordBatch, i: int = i) -> Iterator[pa.RecordBatch]:
            h = _matrix(b.column("h"))
            k, v = (dense(h, w, f"{i}.{p}.{s}").reshape(-1, heads, d) for p in "kv")
            for r in leave.get(s, []):
                # the relation's weight and the root of the width go into the key
                key = np.einsum("nhd,hde->nhe", k, w[f"{i}.key.{r}"]) * w[f"{i}.weight.{r}"][None, :, None] / math.sqrt(d)
                value = np.einsum("nhd,hde->nhe", v, w[f"{i}.value.{r}"])
                yield pa.RecordBatch.from_arrays([b.column("nb_id"), b.column("node_id"), pa.array([r] * len(b)), _lists(key), _lists(value)], names=["nb_id", "src", "relation", "k", "v"])

        def asked(s: str, b: pa.RecordBatch, i: int = i) -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([b.column("nb_id"), b.column("node_id"), b.column("side"), _lists(dense(_matrix(b.column("h")), w, f"{i}.q.{s}"))], names=["nb_id", "dst", "side", "q"])

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                q, k, v = (_matrix(b.column(c)).reshape(-1, heads, d) for c in "qkv")
                ends = list(zip(b.column("nb_id").to_pylist(), b.column("dst").to_pylist(), strict=True))
                at: dict = {}
                group = np.array([at.setdefault(e, len(at)) for e in ends])
                top, sums, vectors = _merged(((q * k).sum(2), np.ones((len(q), heads)), v), group, len(at))
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in at], b.schema.field("nb_id").type), pa.array([x for _, x in at], pa.string()), _lists(top), _lists(sums), _lists(vectors)], names=["nb_id", "node_id", "most", "weight", "value"])

        def put(key: tuple, t: pa.Table) -> pa.Table:
            most, weight, value = (_matrix(t[c].combine_chunks()) for c in ("most", "weight", "value"))
            _, sums, vectors = _merged((most, weight, value.reshape(-1, heads, d)), np.zeros(len(most), np.int64), 1)
            return pa.table({"nb_id": t["nb_id"][:1], "node_id": t["node_id"][:1], "m": _lists(vectors / sums[..., None])})

        def after(s: str, b: pa.RecordBatch, i: int = i) -> Iterator[pa.RecordBatch]:
            h, m = _matrix(b.column("h")), _matrix(b.column("m"))
            keep = 1 / (1 + np.exp(-w[f"{i}.skip.{s}"]))
            got = keep * dense(gelu(m), w, f"{i}.out.{s}") + (1 - keep) * h
            yield pa.RecordBatch.from_arrays([b.column("nb_id"), b.column("node_id"), b.column("side"), _lists(gelu(normed(got + h, w, f"{i}.norm.{s}")))], names=["nb_id", "node_id", "side", "h"])

        keys = now.mapInArrow(lambda bs, f=given: _by_side(bs, f), f"nb_id {kind}, src string, relation string, k array<double>, v array<double>")
        queries = now.mapInArrow(lambda bs, f=asked: _by_side(bs, f), f"nb_id {kind}, dst string, side string, q array<double>")
        met = ways.join(keys, ["nb_id", "relation", "src"]).join(queries, ["nb_id", "dst", "side"]).select("nb_id", "dst", "q", "k", "v")
        sums = met.mapInArrow(summed, f"nb_id {kind}, node_id string, most array<double>, weight array<double>, value array<double>").groupBy("nb_id", "node_id").applyInArrow(put, f"nb_id {kind}, node_id string, m array<double>")
        none = F.array_repeat(F.lit(0.0), hidden)
        now = now.join(sums, ["nb_id", "node_id"], "left").select("nb_id", "node_id", "side", "h", F.coalesce("m", none).alias("m")).mapInArrow(lambda bs, f=after: _by_side(bs, f), state).checkpoint()

    def last(s: str, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([b.column("nb_id"), b.column("node_id"), _lists(dense(gelu(dense(_matrix(b.column("h")), w, "first")), w, "last"))], names=["nb_id", "node_id", "logits"])

    return now.where(F.col("side") == target).mapInArrow(lambda bs: _by_side(bs, last), f"nb_id {kind}, node_id string, logits array<double>")
