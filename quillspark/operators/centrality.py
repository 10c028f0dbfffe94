"""Centralities of graphs of any size: sparse per notebook where one task can hold it, by joins over all notebooks where not."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpoints

#: Distinct edges and nodes of a notebook up to which one task takes it whole (some 100 bytes each).
ONE_TASK = 2_000_000
#: Pivots that are searched from side by side, as entries of their tables.
TABLE = 4_000_000
#: Levels of a search after which what it has seen is written as one table.
LEVELS = 5


def pivots(n: int, error: float, risk: float = 0.1) -> int:
    """How many sources give every node's betweenness to within `error`, but for a chance of `risk`; all n where that is no fewer (Hoeffding over n nodes)."""
    return n if error <= 0 else min(n, math.ceil(math.log(2 * max(n, 1) / risk) / (2 * error * error)))


# ------------------------------------------------------------- one notebook


def _rows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, place) of every element of runs of these sizes."""
    which = np.repeat(np.arange(len(sizes)), sizes)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def ranks(n: int, src: np.ndarray, dst: np.ndarray, damping: float, rounds: int, tol: float) -> np.ndarray:
    """PageRank over distinct edges; ends of the flow give their rank to all."""
    out = np.bincount(src, minlength=n)
    rank = np.full(n, 1 / n)
    for _ in range(rounds):
        share = rank / np.maximum(out, 1)
        new = damping * (np.bincount(dst, share[src], n) + rank[out == 0].sum() / n) + (1 - damping) / n
        moved, rank = np.abs(new - rank).sum(), new
        if moved < n * tol:
            break
    return rank


def triangles(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Directed clustering: the weight of a node's triangles, by how many edges each side has, over what it could be."""
    real = src != dst
    a, b = np.minimum(src, dst)[real], np.maximum(src, dst)[real]
    pair, weight = np.unique(a * n + b, return_counts=True)
    a, b = pair // n, pair % n
    total = np.bincount(a, weight, n) + np.bincount(b, weight, n)
    mutual = np.bincount(a, weight == 2, n) + np.bincount(b, weight == 2, n)
    # from the end with fewer neighbours: no node has more than the root of twice the edges behind it
    near = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
    place = np.empty(n, np.int64)
    place[np.lexsort((np.arange(n), near))] = np.arange(n)
    low, high = np.where(place[a] < place[b], a, b), np.where(place[a] < place[b], b, a)
    by = np.lexsort((place[high], low))
    low, high, weight = low[by], high[by], weight[by]
    ends = np.searchsorted(low, low, side="right")
    keys = place[low] * n + place[high]
    order = np.argsort(keys)
    made = np.zeros(n)
    later = ends - np.arange(len(low)) - 1
    for start in range(0, len(low), 65536):
        which, at = _rows(later[start : start + 65536])
        e, f = which + start, which + start + at + 1
        want = place[high[e]] * n + place[high[f]]
        found = np.minimum(np.searchsorted(keys, want, sorter=order), max(len(keys) - 1, 0))
        hit = keys[order[found]] == want if len(want) else np.zeros(0, bool)
        e, f, g = e[hit], f[hit], order[found[hit]]
        w = weight[e] * weight[f] * weight[g]
        for x in (low[e], high[e], high[f]):
            made += np.bincount(x, w, n)
    room = total * (total - 1) - 2 * mutual
    return np.where(room > 0, made / np.where(room > 0, room, 1), 0.0)


def between(n: int, src: np.ndarray, dst: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """Betweenness by shortest ways from the sources, searched side by side, level by level; scaled to all n nodes."""
    if n < 3:
        return np.zeros(n)
    by = np.argsort(src, kind="stable")
    dst, first = dst[by], np.searchsorted(src[by], np.arange(n + 1))
    degree, out = np.diff(first), np.zeros(n)
    step = max(1, TABLE // n)
    for k in range(0, len(sources), step):
        own = sources[k : k + step]
        depth, ways = np.full(len(own) * n, -1, np.int32), np.zeros(len(own) * n)
        front = np.arange(len(own)) * n + own
        depth[front], ways[front], level, levels = 0, 1, 0, []
        while len(front):
            level += 1
            which, at = _rows(degree[front % n])
            a = front[which]
            b = a - a % n + dst[first[a % n] + at]
            new = np.unique(b[depth[b] < 0])
            depth[new] = level
            on = depth[b] == level
            a, b = a[on], b[on]
            np.add.at(ways, b, ways[a])
            levels.append((a, b))
            front = new
        owed = np.zeros(len(own) * n)
        for a, b in reversed(levels):
            np.add.at(owed, a, ways[a] / ways[b] * (1 + owed[b]))
        owed[np.arange(len(own)) * n + own] = 0
        out += owed.reshape(len(own), n).sum(0)
    return out * (n / len(sources)) / ((n - 1) * (n - 2))


_FOUND = "node_id string, betweenness double, pagerank double, clustering double"


def _small(damping: float, rounds: int, tol: float, error: float, seed: int):
    def per(table: pa.Table) -> pa.Table:
        every = pa.concat_arrays([c.cast(pa.string()) for x in ("src", "dst") for c in table[x].chunks]).dictionary_encode()
        names = every.dictionary.to_pylist()
        # names in their order, so that nothing depends on that of the rows
        place = np.empty(len(names), np.int64)
        place[np.argsort(np.array(names, object))] = np.arange(len(names))
        # a lone node stands as an edge without an end
        code = np.append(place, -1)[every.indices.fill_null(len(names)).to_numpy()]
        src, dst = code[: len(table)], code[len(table) :]
        src, dst, n = src[dst >= 0], dst[dst >= 0], len(names)
        edges = np.unique(src * n + dst)
        src, dst = edges // n, edges % n
        k = pivots(n, error)
        sources = np.arange(n) if k == n else np.sort(np.random.default_rng(seed).permutation(n)[:k])
        found = (between(n, src, dst, sources), ranks(n, src, dst, damping, rounds, tol), triangles(n, src, dst))
        nb = pa.array([table["nb_id"][0].as_py()] * n, table.schema.field("nb_id").type)
        return pa.table([nb, pa.array(sorted(names), pa.string()), *(pa.array(x, pa.float64()) for x in found)], names=["nb_id", "node_id", "betweenness", "pagerank", "clustering"])

    return per


# ------------------------------------------------------------- any size


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 100, tol: float = 1e-6) -> DataFrame:
    """(nb_id, node_id, pagerank) by a join and a sum a round; a notebook whose ranks move less than tol a node keeps them."""
    checkpoints(nodes.sparkSession)
    e = edges.select("nb_id", "src", "dst").distinct()
    out = e.groupBy("nb_id", F.col("src").alias("node_id")).agg(F.count("*").alias("out"))
    size = nodes.groupBy("nb_id").agg(F.count("*").alias("n"))
    now = nodes.select("nb_id", "node_id").join(size, "nb_id").join(out, ["nb_id", "node_id"], "left").select("nb_id", "node_id", "n", F.coalesce("out", F.lit(0)).alias("out"), (F.lit(1.0) / F.col("n")).alias("r"), F.lit(False).alias("done")).checkpoint()
    e = e.checkpoint()
    for _ in range(rounds):
        given = e.join(now.select("nb_id", F.col("node_id").alias("src"), F.try_divide("r", "out").alias("x")), ["nb_id", "src"]).groupBy("nb_id", F.col("dst").alias("node_id")).agg(F.sum("x").alias("x"))
        loose = now.groupBy("nb_id").agg(F.sum(F.when(F.col("out") == 0, F.col("r")).otherwise(0.0)).alias("loose"))
        new = damping * (F.coalesce("x", F.lit(0.0)) + F.col("loose") / F.col("n")) + (1 - damping) / F.col("n")
        after = now.join(given, ["nb_id", "node_id"], "left").join(loose, "nb_id").select("nb_id", "node_id", "n", "out", F.col("r").alias("old"), F.when(F.col("done"), F.col("r")).otherwise(new).alias("r"), "done")
        if tol > 0:
            still = after.groupBy("nb_id").agg((F.sum(F.abs(F.col("r") - F.col("old"))) < F.first("n") * tol).alias("still"))
            after = after.join(still, "nb_id").withColumn("done", F.col("done") | F.col("still"))
        # a round reads its ranks more than once, so each is written
        now = after.select("nb_id", "node_id", "n", "out", "r", "done").checkpoint()
        if tol > 0 and now.where(~F.col("done")).isEmpty():
            break
    return now.select("nb_id", "node_id", F.col("r").alias("pagerank"))


def clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(nb_id, node_id, clustering) by wedges from the end with fewer neighbours, closed by a join; no node opens more than the root of twice the edges squared."""
    checkpoints(nodes.sparkSession)
    e = edges.where("src <> dst").select("nb_id", "src", "dst").distinct()
    pairs = e.groupBy("nb_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("w")).checkpoint()
    ends = pairs.select("nb_id", "w", F.explode(F.array("a", "b")).alias("node_id"))
    of = ends.groupBy("nb_id", "node_id").agg(F.count("*").alias("near"), F.sum("w").alias("total"), F.count_if(F.col("w") == 2).alias("mutual")).checkpoint()
    name = lambda c: of.select("nb_id", F.col("node_id").alias(c), F.struct(F.col("near").alias("d"), F.col("node_id").alias("v")).alias(f"p{c}"))
    p = pairs.join(name("a"), ["nb_id", "a"]).join(name("b"), ["nb_id", "b"])
    p = p.select("nb_id", "w", F.least("pa", "pb").alias("low"), F.greatest("pa", "pb").alias("high")).checkpoint()
    wedge = p.select("nb_id", "low", F.col("high").alias("x"), F.col("w").alias("w1")).join(p.select("nb_id", "low", F.col("high").alias("y"), F.col("w").alias("w2")), ["nb_id", "low"]).where("x < y")
    closed = wedge.join(p.select("nb_id", F.col("low").alias("x"), F.col("high").alias("y"), F.col("w").alias("w3")), ["nb_id", "x", "y"])
    made = closed.select("nb_id", F.explode(F.array("low.v", "x.v", "y.v")).alias("node_id"), (F.col("w1") * F.col("w2") * F.col("w3")).alias("w")).groupBy("nb_id", "node_id").agg(F.sum("w").alias("made"))
    room = F.col("total") * (F.col("total") - 1) - 2 * F.col("mutual")
    found = of.join(made, ["nb_id", "node_id"], "left").select("nb_id", "node_id", F.when(room > 0, F.coalesce("made", F.lit(0)) / room).otherwise(0.0).alias("clustering"))
    return nodes.select("nb_id", "node_id").join(found, ["nb_id", "node_id"], "left").select("nb_id", "node_id", F.coalesce("clustering", F.lit(0.0)).alias("clustering"))


def betweenness(nodes: DataFrame, edges: DataFrame, error: float = 0.1, seed: int = 0) -> DataFrame:
    """(nb_id, node_id, betweenness) from pivots, the nodes of least seeded hash: a frontier joined with the edges a level, then back level by level."""
    checkpoints(nodes.sparkSession)
    v = nodes.select("nb_id", "node_id").distinct()
    sizes = v.groupBy("nb_id").agg(F.count("*").alias("n"))
    wanted = F.when(F.lit(error) <= 0, F.col("n")).otherwise(F.least(F.col("n"), F.ceil(F.log(2 * F.col("n") / 0.1) / (2 * error * error)))) if error > 0 else F.col("n")
    sizes = sizes.withColumn("k", wanted).checkpoint()
    from .shared import hash_ranked

    chosen = hash_ranked(v, F.col("nb_id"), "node_id", seed, "__r").join(sizes, "nb_id").where("__r < k").select("nb_id", F.col("node_id").alias("s"))
    e = edges.select("nb_id", "src", "dst").distinct().checkpoint()
    front = chosen.select("nb_id", "s", F.col("s").alias("v"), F.lit(1.0).alias("ways")).checkpoint()
    seen, levels = front.select("nb_id", "s", "v"), [front]
    while True:
        new = front.withColumnRenamed("v", "src").join(e, ["nb_id", "src"]).groupBy("nb_id", "s", F.col("dst").alias("v")).agg(F.sum("ways").alias("ways"))
        front = new.join(seen, ["nb_id", "s", "v"], "left_anti").checkpoint()
        if front.isEmpty():
            break
        levels.append(front)
        seen = seen.unionByName(front.select("nb_id", "s", "v"))
        if len(levels) % LEVELS == 0:
            seen = seen.checkpoint()
    owed, total = None, None
    for up, down in zip(reversed(levels[:-1]), reversed(levels[1:]), strict=True):
        below = down.select("nb_id", "s", F.col("v").alias("dst"), F.col("ways").alias("wb"), F.lit(0.0).alias("owed")) if owed is None else down.join(owed, ["nb_id", "s", "v"], "left").select("nb_id", "s", F.col("v").alias("dst"), F.col("ways").alias("wb"), F.coalesce("owed", F.lit(0.0)).alias("owed"))
        back = below.join(e, ["nb_id", "dst"]).join(up.withColumnRenamed("v", "src"), ["nb_id", "s", "src"])
        owed = back.groupBy("nb_id", "s", F.col("src").alias("v")).agg(F.sum(F.col("ways") / F.col("wb") * (1 + F.col("owed"))).alias("owed")).checkpoint()
        mine = owed.where("v <> s").select("nb_id", "v", "owed")
        total = mine if total is None else total.unionByName(mine)
    scale = F.when(F.col("n") > 2, F.col("n") / F.col("k") / ((F.col("n") - 1) * (F.col("n") - 2))).otherwise(0.0)
    sums = v.join(sizes, "nb_id")
    if total is None:
        return sums.select("nb_id", "node_id", F.lit(0.0).alias("betweenness"))
    got = total.groupBy("nb_id", F.col("v").alias("node_id")).agg(F.sum("owed").alias("owed"))
    return sums.join(got, ["nb_id", "node_id"], "left").select("nb_id", "node_id", (F.coalesce("owed", F.lit(0.0)) * scale).alias("betweenness"))


def centrality(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 100, tol: float = 1e-6, error: float = 0.0, seed: int = 0, one_task: int = ONE_TASK) -> DataFrame:
    """(nb_id, node_id, in_degree, out_degree, betweenness, pagerank, clustering).

    Degrees count parallel edges and are divided by n - 1; the others take the
    simple graph, clustering without loops. Betweenness is exact with error 0;
    else it is taken from as many pivots as give each node to within `error` but
    for one chance in ten. A notebook of at most `one_task` edges and nodes is
    one task, in memory that grows with its edges; larger ones go by joins. Nodes
    are those of `nodes`; edges to others are left out. Empty graphs give none.
    """
    checkpoints(nodes.sparkSession)
    v = nodes.select("nb_id", "node_id").distinct()
    known = v.select("nb_id", F.col("node_id").alias("src")), v.select("nb_id", F.col("node_id").alias("dst"))
    every = edges.select("nb_id", "src", "dst").join(known[0], ["nb_id", "src"], "left_semi").join(known[1], ["nb_id", "dst"], "left_semi").select("nb_id", "src", "dst").checkpoint()
    sizes = v.groupBy("nb_id").agg(F.count("*").alias("n"))
    sizes = sizes.join(every.groupBy("nb_id").agg(F.count("*").alias("m")), "nb_id", "left").select("nb_id", "n", (F.col("n") + F.coalesce("m", F.lit(0)) > one_task).alias("large")).checkpoint()
    lone = v.select("nb_id", F.col("node_id").alias("src"), F.lit(None).cast("string").alias("dst"))
    kind = nodes.schema["nb_id"].dataType.simpleString()
    large = sizes.where("large").select("nb_id")
    small = every.distinct().unionByName(lone).join(large, "nb_id", "left_anti").groupBy("nb_id").applyInArrow(_small(damping, rounds, tol, error, seed), f"nb_id {kind}, {_FOUND}")
    if not large.isEmpty():
        vl, el = v.join(large, "nb_id", "left_semi"), every.join(large, "nb_id", "left_semi")
        parts = betweenness(vl, el, error, seed).join(pagerank(vl, el, damping, rounds, tol), ["nb_id", "node_id"]).join(clustering(vl, el), ["nb_id", "node_id"])
        small = small.unionByName(parts)
    ends = every.select("nb_id", F.col("dst").alias("node_id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(every.select("nb_id", F.col("src").alias("node_id"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    degree = ends.groupBy("nb_id", "node_id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    share = lambda c, name: (F.coalesce(c, F.lit(0)) / F.greatest(F.col("n") - 1, F.lit(1))).alias(name)
    return small.join(sizes, "nb_id").join(degree, ["nb_id", "node_id"], "left").select("nb_id", "node_id", share("i", "in_degree"), share("o", "out_degree"), "betweenness", "pagerank", "clustering")
