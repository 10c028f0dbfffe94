"""Hard-negative mining by vantage-point trees.

Vectors get one more component that brings all to one norm, queries a zero: then
the inner product falls as the distance grows, so a window of scores is an
annulus about the query, and the best scores in it are the nearest to its inner
edge. A tree over a bounded sample parts the rows into cells, whose distances to
the tree's vantage points are then taken over all rows; a query visits only the
cells that can meet its annulus. Each block of a cell has a tree of its own,
whose leaves are visited nearest first until no other can hold a better row.
The sample sets how much is visited, never what is found: results are exact.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir

#: Rows of the sample and bytes of its vectors at most; cells at most; rows to a block, least and most; leaves to a block's tree.
SAMPLE, SAMPLE_BYTES, CELLS, BLOCK, LEAVES = 8192, 32 << 20, 1024, (4096, 65536), 64
#: Queries that one task answers over one block; more take further copies of the block.
VISITS = 65536
#: Queries worked on at a time.
CHUNK = 1024
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Arrays of numbers as rows, short ones filled up with zeros."""
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False), np.diff(column.offsets.to_numpy())
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, exact; those beyond 64 bits are held at the ends of their range."""
    most = lambda x: float(np.abs(x.astype(float)).max(initial=0))
    bound = most(a) * most(b) * max(1, a.shape[1])
    if bound < 2**52:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if bound < 2**62:
        return a @ b.T
    return np.clip(a.astype(object) @ b.astype(object).T, _LEAST, _MOST).astype(np.int64)


class Tree:
    """Rows parted by their distances to vantage points, in halves, down to leaves.

    Of each leaf it has the vantage points above it, and the least and largest
    distance of its rows to each.
    """

    def __init__(self, vectors: np.ndarray, top: float, leaf: int):
        self.top = top
        self.points: list[np.ndarray] = []
        self.radius: list[float] = []
        self.down: list[list[int]] = []  # node: inside, outside; leaves as -1 - number
        self.leaves: list[np.ndarray] = []
        self.above: list[list[int]] = []
        x = vectors.astype(float)
        side = np.sqrt(np.maximum(0, top - (x * x).sum(1)))
        todo: list[tuple[np.ndarray, list[int], int, int]] = [(np.arange(len(x)), [], -1, 0)]
        while todo:
            rows, above, parent, branch = todo.pop()
            if len(rows) <= leaf:
                name = -1 - len(self.leaves)
                self.leaves.append(rows)
                self.above.append(above)
            else:
                name = len(self.points)
                far = self._apart(x[rows], side[rows], x[rows[0]], side[rows[0]]).argmax()
                point = np.append(x[rows[far]], side[rows[far]])
                d = self._apart(x[rows], side[rows], point[:-1], point[-1])
                by = np.argsort(d, kind="stable")
                half = len(rows) // 2
                self.points.append(point)
                self.radius.append(float(d[by[half - 1]]))
                self.down.append([0, 0])
                todo += [(rows[by[half:]], [*above, name], name, 1), (rows[by[:half]], [*above, name], name, 0)]
            if parent >= 0:
                self.down[parent][branch] = name
        self.at = np.array(self.points).reshape(len(self.points), x.shape[1] + 1)

    @staticmethod
    def _apart(x: np.ndarray, side: np.ndarray, point: np.ndarray, point_side: float) -> np.ndarray:
        return np.sqrt(np.maximum(0, ((x - point) ** 2).sum(1) + (side - point_side) ** 2))

    def distances(self, vectors: np.ndarray) -> np.ndarray:
        """Of rows to every vantage point."""
        x = vectors.astype(float)
        side = np.sqrt(np.maximum(0, self.top - (x * x).sum(1)))
        out = (x * x).sum(1)[:, None] + side[:, None] ** 2 + (self.at**2).sum(1) - 2 * (x @ self.at[:, :-1].T + side[:, None] * self.at[:, -1])
        return np.sqrt(np.maximum(0, out))

    def seen(self, queries: np.ndarray) -> np.ndarray:
        """Of queries to every vantage point."""
        q = queries.astype(float)
        return np.sqrt(np.maximum(0, (q * q).sum(1)[:, None] + self.top - 2 * q @ self.at[:, :-1].T))

    def leaf_of(self, distances: np.ndarray) -> np.ndarray:
        out = np.zeros(len(distances), np.int64)
        todo = [(0, np.arange(len(distances)))] if self.points else []
        while todo:
            node, rows = todo.pop()
            inside = distances[rows, node] <= self.radius[node]
            for to, mine in zip(self.down[node], (rows[inside], rows[~inside]), strict=True):
                if to < 0:
                    out[mine] = -1 - to
                elif len(mine):
                    todo.append((to, mine))
        return out

    def reach(self, seen: np.ndarray, low: list[np.ndarray], high: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The least and largest distance that a query can have to a row of each leaf, by the distances (low, high) of its rows to the points above."""
        near, far = np.zeros((len(seen), len(self.above))), np.full((len(seen), len(self.above)), np.inf)
        for i, above in enumerate(self.above):
            if above:
                d = seen[:, above]
                near[:, i] = np.maximum(np.maximum(low[i] - d, d - high[i]).max(1), 0)
                far[:, i] = (d + high[i]).min(1)
        return near, far


def annulus(queries: np.ndarray, top: float, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inner and outer radius of score windows about their queries, and what rounding may have moved them by."""
    size = (queries.astype(float) ** 2).sum(1) + top
    inner = np.where(high == _MOST, 0, np.sqrt(np.maximum(0, size - 2 * high.astype(float))))
    outer = np.where(low == _LEAST, np.inf, np.sqrt(np.maximum(0, size - 2 * low.astype(float))))
    return inner, outer, 1e-6 * (np.sqrt(size) + 1)


def nearest(block: dict, tree: Tree, queries: np.ndarray, labels: np.ndarray, owners: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, ...]:
    """(query, row, score): of each query the k rows of best score within [low, high] that have its label, or have another, itself apart; ties by id."""
    inner, outer, slack = annulus(queries, tree.top, low, high)
    if tree.points:
        near, far = tree.reach(tree.seen(queries), block["low"], block["high"])
    else:
        near, far = np.zeros((len(queries), 1)), np.full((len(queries), 1), np.inf)
    way = np.maximum(near, inner[:, None])
    way[(far < (inner - slack)[:, None]) | (near > (outer + slack)[:, None])] = np.inf
    order = np.argsort(way, axis=1, kind="stable")
    size = (queries.astype(float) ** 2).sum(1) + tree.top
    q = row = score = np.zeros(0, np.int64)
    least, start, step = low.copy(), 0, 1
    while start < order.shape[1]:
        worst = np.where(least == _LEAST, np.inf, np.sqrt(np.maximum(0, size - 2 * least.astype(float))))
        part = order[:, start : start + step]
        open_ = np.take_along_axis(way, part, 1)
        i, j = np.nonzero(np.isfinite(open_) & (open_ <= (worst + slack)[:, None]))
        if not len(i):
            break
        leaf = part[i, j]
        by = np.argsort(leaf, kind="stable")
        edges = np.flatnonzero(np.diff(leaf[by], prepend=-1))
        new = [(q, row, score)]
        for a, b in zip(edges, np.append(edges[1:], len(by)), strict=True):
            mine, rows = i[by[a:b]], tree.leaves[leaf[by[a]]]
            s = products(queries[mine], block["vectors"][rows])
            fits = ((block["labels"][rows] == labels[mine, None]) == same) & (s >= least[mine, None]) & (s <= high[mine, None]) & (block["owners"][rows] != owners[mine, None])
            x, y = np.nonzero(fits)
            new.append((mine[x], rows[y], s[x, y]))
        q, row, score = (np.concatenate(x) for x in zip(*new, strict=True))
        by = np.lexsort((block["owners"][row], block["ids"][row], -score, q))
        q, row, score = q[by], row[by], score[by]
        place = np.arange(len(q)) - np.repeat(np.flatnonzero(np.diff(q, prepend=-1)), np.diff(np.append(np.flatnonzero(np.diff(q, prepend=-1)), len(q))))
        q, row, score = q[place < k], row[place < k], score[place < k]
        full = np.flatnonzero(np.bincount(q, minlength=len(queries)) == k)
        if len(full):
            last = np.searchsorted(q, full, side="right") - 1
            least[full] = np.maximum(least[full], score[last])
        start, step = start + step, 2 * step
    return q, row, score


_MET = "cell int, block int, part int, kind int, owner long, id long, label long, vector array<long>, window int, low long, high long"


def _answer(width: int, top: float, k: int, same: bool):
    """Rows of a block, then the queries that visit it, block by block."""

    def close(rows: list[pa.RecordBatch]) -> tuple[dict, Tree]:
        t = pa.Table.from_batches(rows).combine_chunks()
        one = lambda name: t[name].chunk(0) if t[name].num_chunks else t[name].combine_chunks()
        block = {"vectors": matrix(one("vector"), width), "ids": t["id"].to_numpy(), "owners": t["owner"].to_numpy(), "labels": t["label"].to_numpy()}
        tree = Tree(block["vectors"], top, max(LEAVES, -(-len(t) // LEAVES)))
        if tree.points:
            d = tree.distances(block["vectors"])
            block["low"] = [d[np.ix_(rows, above)].min(0) for rows, above in zip(tree.leaves, tree.above, strict=True)]
            block["high"] = [d[np.ix_(rows, above)].max(0) for rows, above in zip(tree.leaves, tree.above, strict=True)]
        return block, tree

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, built = None, [], None
        for batch in batches:
            place = np.stack([batch.column(c).to_numpy() for c in ("cell", "block", "part", "kind")])
            edges = np.append(np.flatnonzero((np.diff(place, axis=1, prepend=-1) != 0).any(0)), batch.num_rows)
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                mine, (*at, kind) = batch.slice(a, b - a), place[:, a].tolist()
                if at != now:
                    now, rows, built = at, [], None
                if kind == 0:
                    rows.append(mine)
                    continue
                if not rows:
                    continue
                built = built or close(rows)
                for c in range(0, mine.num_rows, CHUNK):
                    ask = mine.slice(c, CHUNK)
                    ask = pa.Table.from_batches([ask]).combine_chunks()
                    owner, window = ask["owner"].to_numpy(), ask["window"].to_numpy()
                    q, row, score = nearest(*built, matrix(ask["vector"].chunk(0), width), ask["label"].to_numpy(), owner, ask["low"].to_numpy(), ask["high"].to_numpy(), k, same)
                    if len(q):
                        block = built[0]
                        yield pa.RecordBatch.from_pydict({"owner": owner[q], "window": window[q], "other": block["owners"][row], "id": block["ids"][row], "score": score})

    return run


def mine(df: DataFrame, key: str = "vec_id", vector: str = "vector", label: str = "label", anchors: Column | None = None, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, sample: int = SAMPLE, block: int | None = None, visits: int = VISITS) -> DataFrame:
    """(anchor, positive, rank, negative, positive_score, negative_score) for the anchors among the rows of df.

    An anchor's positives are the `positives` other rows of its label with the
    best inner products, ties by key; for each the `negatives` best rows of other
    labels whose score is between low and high percent of the positive's. df has
    whole numbers as vectors; rows with a null label, vector or component take no
    part, short vectors are filled up with zeros. Rows of one key are each a row;
    a null key stands after all others. A positive with a negative score has no
    window, and an anchor without positives or negatives gives no row; so do
    empty tables. Other columns are not looked at. Labels are told apart by 64
    bits; scores beyond 64 bits are held at the ends of their range, which is
    beyond what components under 2^28 in 128 dimensions give.
    """
    spark = df.sparkSession
    where = f"{shared_dir(spark)}/negatives-{uuid.uuid4().hex}"
    t = df.where(F.col(vector).isNotNull() & F.col(label).isNotNull() & F.forall(vector, lambda x: x.isNotNull()))
    t = t.select(F.coalesce(F.col(key).cast("long"), F.lit(_MOST)).alias("id"), F.xxhash64(label).alias("label"), F.col(vector).cast("array<long>").alias("vector"), F.coalesce(anchors if anchors is not None else F.lit(True), F.lit(False)).alias("anchor"))
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, width, top = t.agg(F.count("*"), F.max(F.size("vector")), F.max(square)).first()
    if not n:
        return spark.createDataFrame([], "anchor long, positive long, rank int, negative long, positive_score long, negative_score long")
    width, top = max(1, width), float(top) * (1 + 1e-9)
    block = block or min(BLOCK[1], max(BLOCK[0], n // 16))
    most = max(64, min(sample, SAMPLE_BYTES // (8 * width)))
    taken = t.orderBy(F.xxhash64("id", "vector"), "id").limit(most).select("vector", "label").toArrow().combine_chunks()
    known, known_labels = matrix(taken["vector"].chunk(0), width), taken["label"].to_numpy()
    cells = max(1, min(CELLS, -(-n // block), len(known) // 8))
    tree = Tree(known, top, max(1, -(-len(known) // cells)))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = tree.leaf_of(tree.distances(matrix(b.column("vector"), width)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32))], names=[*b.schema.names, "cell"])

    t.mapInArrow(dealt, "id long, label long, vector array<long>, anchor boolean, cell int").withColumn("owner", F.monotonically_increasing_id()).write.parquet(where)
    rows = spark.read.parquet(where)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, d = b.column("cell").to_numpy(), tree.distances(matrix(b.column("vector"), width))
            out = []
            for c in np.unique(cell):
                mine, above = d[cell == c], tree.above[c]
                out += [(int(c), j, float(mine[:, v].min()), float(mine[:, v].max()), len(mine)) for j, v in enumerate(above)] or [(int(c), 0, 0.0, 0.0, len(mine))]
            kinds = (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["cell", "j", "low", "high", "n"])

    found = rows.select("vector", "cell").mapInArrow(spread, "cell int, j int, low double, high double, n long").groupBy("cell", "j").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).collect()
    stats = {(r["cell"], r["j"]): r for r in found}
    filled = sorted({c for c, _ in stats})
    bound = [[np.array([stats[c, j][k] for j in range(len(a))]) if (c, 0) in stats else np.zeros(len(a)) for c, a in enumerate(tree.above)] for k in ("low", "high")]
    blocks = [-(-stats[c, 0]["n"] // block) if (c, 0) in stats else 1 for c in range(len(tree.leaves))]
    parts = max(1, -(-rows.where("anchor").count() // visits))

    def visit(k: int, same: bool):
        """The cells that each window may find rows in, its lower end raised to the k-th best of the sample."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for a in range(0, whole.num_rows, CHUNK):
                    b = whole.slice(a, CHUNK)
                    b = pa.Table.from_batches([b]).combine_chunks().to_batches()[0]
                    q, own = matrix(b.column("vector"), width), b.column("label").to_numpy()
                    lo, hi = b.column("low").to_numpy().copy(), b.column("high").to_numpy()
                    s = products(q, known)
                    fits = ((known_labels == own[:, None]) == same) & (s >= lo[:, None]) & (s <= hi[:, None])
                    if known.shape[0] > k:
                        # one more than k, as the sample may hold the query's own row
                        best = -np.partition(np.where(fits, -s.astype(float), np.inf), k, axis=1)[:, k]
                        lo = np.where(np.isfinite(best), np.maximum(lo, np.where(np.isfinite(best), np.floor(best), 0).astype(np.int64)), lo) if (np.abs(s) < 2**52).all() else lo
                    inner, outer, slack = annulus(q, top, lo, hi)
                    near, far = tree.reach(tree.seen(q), *bound) if tree.points else (np.zeros((len(q), 1)), np.full((len(q), 1), np.inf))
                    open_ = (far >= (inner - slack)[:, None]) & (near <= (outer + slack)[:, None])
                    i, c = np.nonzero(open_[:, filled])
                    if len(i):
                        got = b.take(pa.array(i))
                        cell = pa.array(np.array(filled, np.int32)[c])
                        yield pa.RecordBatch.from_arrays([cell, *(got.column(x) for x in ("owner", "id", "label", "vector", "window")), pa.array(lo[i]), pa.array(hi[i])], names=["cell", "owner", "id", "label", "vector", "window", "low", "high"])

        return run

    of_cell = F.get(F.array(*(F.lit(int(x)) for x in blocks)), F.col("cell"))
    place = lambda x, m: F.pmod(F.xxhash64(F.lit(11), x), m).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), m - 1)).alias
    null = F.lit(None).cast("long")
    data = rows.select("cell", place("owner", of_cell).alias("block"), every(F.lit(parts))("part"), F.lit(0).alias("kind"), "owner", "id", "label", "vector", F.lit(0).alias("window"), F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high"))

    def search(asked: DataFrame, k: int, same: bool) -> DataFrame:
        sent = asked.mapInArrow(visit(k, same), "cell int, owner long, id long, label long, vector array<long>, window int, low long, high long")
        sent = sent.select("cell", every(of_cell)("block"), place("owner", F.lit(parts)).alias("part"), F.lit(1).alias("kind"), "owner", "id", "label", "vector", "window", "low", "high")
        met = data.unionByName(sent).repartition("cell", "block", "part").sortWithinPartitions("cell", "block", "part", "kind")
        got = met.mapInArrow(_answer(width, top, k, same), "owner long, window int, other long, id long, score long")
        by = Window.partitionBy("owner", "window").orderBy(F.desc("score"), "id", "other")
        return got.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)

    asked = rows.where("anchor").select("owner", "id", "label", "vector", F.lit(0).alias("window"), F.lit(_LEAST).alias("low"), F.lit(_MOST).alias("high"))
    best = search(asked, positives, True).select("owner", F.col("rank").alias("window"), F.col("id").alias("positive"), F.col("score").alias("positive_score")).checkpoint()
    percent = lambda p, up: F.floor((F.col("positive_score").cast("decimal(20,0)") * p + (99 if up else 0)) / 100).cast("long")
    windows = best.select("owner", "window", percent(low, True).alias("low"), percent(high, False).alias("high")).where("low <= high")
    asked = rows.where("anchor").select("owner", "id", "label", "vector").join(windows, "owner").select("owner", "id", "label", "vector", "window", "low", "high")
    worst = search(asked, negatives, False).select("owner", "window", "rank", F.col("id").alias("negative"), F.col("score").alias("negative_score"))
    names = rows.where("anchor").select("owner", F.col("id").alias("anchor"))
    known_id = lambda c: F.when(F.col(c) < _MOST, F.col(c)).otherwise(null).alias(c)
    return worst.join(best, ["owner", "window"]).join(names, "owner").select(known_id("anchor"), known_id("positive"), "rank", known_id("negative"), "positive_score", "negative_score")
