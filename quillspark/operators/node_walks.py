"""Random walks over graphs of any size as joins, and node embeddings from what the walks pass by.

A draw is a seeded hash of the walk and its step, so the walks are the same
under any partitioning, and a step that is run again after a lost executor
draws again what it drew.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import checkpoints

#: Hex digits of a draw, and how many values that makes.
DIGITS = 12
DRAWS = 1 << 4 * DIGITS


def draw(*parts) -> Column:
    """A number below DRAWS from the parts' text, as any SQL with md5 can make it."""
    text = F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("long")


def walk_paths(nodes: DataFrame, edges: DataFrame, length: int = 20, walks: int = 10, p: float = 1.0, q: float = 1.0, seed: int = 42) -> DataFrame:
    """(nb_id, start, walk, path): `walks` walks of at most `length` edges from each node, as the names of their nodes from the start on.

    A node's successors are its distinct ones. A step back to the node before
    has weight 1 / p, one to a successor of the node before 1, any other 1 / q;
    the first step is even. Candidates are drawn evenly and kept by their
    weight, those of one round side by side, and walks whose candidates all fall
    draw again: no step reads all the successors of a hub. A walk ends where a
    node has none. Edges with a null end are left out, repeated nodes count
    once, and a node without edges gives its start alone.
    """
    checkpoints(nodes.sparkSession)
    e = edges.select("nb_id", "src", "dst").where("src is not null and dst is not null").distinct()
    # a window streams the successors of a node by their sort, and holds none
    placed = e.withColumn("i", F.row_number().over(Window.partitionBy("nb_id", "src").orderBy("dst")) - 1)
    placed = placed.select("nb_id", F.col("src").alias("node_id"), F.col("i").cast("long").alias("i"), F.col("dst").alias("to")).checkpoint()
    degree = placed.groupBy("nb_id", "node_id").agg(F.count("*").alias("n"))
    # an edge knows how many successors its end has, so that a step is one join
    next_of = placed.join(degree.select("nb_id", F.col("node_id").alias("to"), F.col("n").alias("to_n")), ["nb_id", "to"], "left").select("nb_id", "node_id", "i", "to", "to_n").checkpoint()
    known = placed.select("nb_id", F.col("node_id").alias("before"), "to", F.lit(True).alias("near"))
    most = max(1.0, 1 / p, 1 / q)
    # enough that few walks draw again: each candidate is kept with a chance of least / most or more
    tries = 1 if p == q == 1 else math.ceil(2 * most / min(1.0, 1 / p, 1 / q))

    starts = nodes.select("nb_id", "node_id").where("node_id is not null").distinct().join(degree, ["nb_id", "node_id"], "left")
    front = starts.select("nb_id", F.col("node_id").alias("start"), F.explode(F.sequence(F.lit(1), F.lit(walks))).alias("walk"), F.array("node_id").alias("path"), F.lit(None).cast("string").alias("before"), "node_id", "n")
    key = ["nb_id", "start", "walk"]
    further = [*key, F.when(F.col("to").isNull(), F.col("path")).otherwise(F.array_append("path", F.col("to"))).alias("path"), F.col("node_id").alias("before"), F.col("to").alias("node_id"), F.col("to_n").alias("n")]
    for step in range(1, length + 1):
        if tries == 1:
            place = draw(seed, F.col("nb_id"), F.col("start"), F.col("walk"), step, 0) % F.col("n")
            front = front.withColumn("i", place).join(next_of, ["nb_id", "node_id", "i"], "left").select(*further)
            continue
        waiting, gone, made = front.where("n is not null").drop("path"), 0, None
        while True:
            at = F.explode(F.sequence(F.lit(gone), F.lit(gone + tries - 1)))
            asked = waiting.withColumn("try", at)
            place = draw(seed, F.col("nb_id"), F.col("start"), F.col("walk"), step, F.col("try")) % F.col("n")
            found = asked.withColumn("i", place).join(next_of, ["nb_id", "node_id", "i"])
            weight = F.when(F.col("before").isNull(), most).when(F.col("to") == F.col("before"), 1 / p).when(F.col("near"), 1.0).otherwise(1 / q)
            luck = draw(seed, "keep", F.col("nb_id"), F.col("start"), F.col("walk"), step, F.col("try")) / DRAWS
            found = found.join(known, ["nb_id", "before", "to"], "left").where(luck < weight / most)
            found = found.groupBy(*key).agg(F.min_by(F.struct("to", "to_n"), "try").alias("x")).select(*key, "x.*").checkpoint()
            made = found if made is None else made.unionByName(found)
            waiting = waiting.join(found.select(*key), key, "left_anti").checkpoint()
            if waiting.isEmpty():
                break
            gone += tries
        if made.isEmpty():
            break
        front = front.join(made, key, "left").select(*further).checkpoint()
    return front.select(*key, "path")


def random_walks(nodes: DataFrame, edges: DataFrame, length: int = 20, walks: int = 10, p: float = 1.0, q: float = 1.0, seed: int = 42) -> DataFrame:
    """(nb_id, start, walk, step, node_id): walk_paths() with a row for each place; step 0 is the start."""
    return walk_paths(nodes, edges, length, walks, p, q, seed).select("nb_id", "start", "walk", F.posexplode("path").alias("step", "node_id"))


def path_grams(paths: DataFrame, window: int = 5) -> DataFrame:
    """(nb_id, node_id, context, n): how often a node has another place of its path within `window` steps; both directions.

    Both directions have equal counts, so a pair is counted once, its lesser name first.
    """
    size = F.size("path")
    ahead = lambda d: F.arrays_zip(F.slice("path", 1, F.greatest(size - d, F.lit(0))).alias("a"), F.slice("path", d + 1, F.greatest(size - d, F.lit(0))).alias("b"))
    pairs = paths.select("nb_id", F.explode(F.concat(*(ahead(d) for d in range(1, window + 1)))).alias("p"))
    once = pairs.groupBy("nb_id", F.least("p.a", "p.b").alias("a"), F.greatest("p.a", "p.b").alias("b")).agg(F.count("*").alias("n"))
    way = lambda x, y, n: F.struct(F.col(x).alias("node_id"), F.col(y).alias("context"), n.alias("n"))
    ways = F.when(F.col("a") == F.col("b"), F.array(way("a", "b", 2 * F.col("n")))).otherwise(F.array(way("a", "b", F.col("n")), way("b", "a", F.col("n"))))
    return once.select("nb_id", F.inline(ways))


def skip_grams(walks: DataFrame, window: int = 5) -> DataFrame:
    """path_grams() of walks by rows."""
    path = F.transform(F.array_sort(F.collect_list(F.struct("step", "node_id"))), lambda x: x["node_id"])
    return path_grams(walks.groupBy("nb_id", "start", "walk").agg(path.alias("path")), window)


#: Signs to a number.
_BITS = 62


def embed(pairs: DataFrame, dims: int = 64, seed: int = 42) -> DataFrame:
    """(nb_id, node_id, dim, value): positive pointwise mutual information of a node with its contexts, projected on `dims` random signs.

    That matrix is what skip-gram with one negative sample factors, and its
    projection keeps its rows' distances (to about the root of 1 / dims). Signs
    are bits of a hash of the context, made once for each context and moved with
    its pairs as bits, so that a shuffle of pairs and one sum make all of it, and
    vectors of nodes of one notebook can be compared. A node without contexts
    has no row; one that only chance brings near others is 0.
    """
    whole = pairs.groupBy("nb_id").agg(F.sum("n").alias("total"))
    left = pairs.groupBy("nb_id", "node_id").agg(F.sum("n").alias("a"))
    right = pairs.groupBy("nb_id", "context").agg(F.sum("n").alias("b")).join(whole, "nb_id")
    bit = lambda d: F.shiftleft(draw(seed, F.col("context"), d) % 2, d % _BITS)
    words = [functools.reduce(Column.bitwiseOR, map(bit, range(i, min(i + _BITS, dims)))).alias(f"s{i // _BITS}") for i in range(0, dims, _BITS)]
    names = [f"s{i}" for i in range(len(words))]
    joined = pairs.join(right.select("*", *words), ["nb_id", "context"]).select("nb_id", "node_id", "n", "b", "total", *names).join(left, ["nb_id", "node_id"])
    pmi = F.greatest(F.lit(0.0), F.log(F.col("n") * F.col("total") / (F.col("a").cast("double") * F.col("b"))))
    value = joined.select("nb_id", "node_id", pmi.alias("x"), *names)
    sign = lambda d: F.when(F.col(f"s{d // _BITS}").bitwiseAND(F.lit(1 << d % _BITS)) == 0, 1.0).otherwise(-1.0)
    sums = value.groupBy("nb_id", "node_id").agg(*(F.sum(F.col("x") * sign(d)).alias(f"v{d}") for d in range(dims)))
    return sums.select("nb_id", "node_id", F.posexplode(F.array(*(F.col(f"v{d}") / math.sqrt(dims) for d in range(dims)))).alias("dim", "value"))


def vectors(embedding: DataFrame) -> DataFrame:
    """(nb_id, node_id, embedding): the values as one array, by dim."""
    return embedding.groupBy("nb_id", "node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda x: x["value"]).alias("embedding"))
