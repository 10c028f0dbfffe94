"""What each feature adds to a tree model's margin: Shapley values of the trees' own conditional expectations.

A leaf's share of a row's margin is a product over the features on its path, of
1 or 0 where the feature is known (the row passes or not) and of the part of the
training rows that pass where it is not. The Shapley value of such a product is an
integral over [0, 1] of a polynomial, which Gauss points give without error, so a
leaf takes time by its path's length and no subsets are listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import checkpoints

#: Leaves whose paths one pass over the rows carries; a larger model takes more passes.
LEAVES = 1 << 16
#: Cells of a task's arrays: rows by leaves by conditions.
CELLS = 1 << 20


def tree_table(spark: SparkSession, saved: str, weights: list[float]) -> DataFrame:
    """(tree, node, feature, threshold, left, right, cover, value) of a saved tree ensemble; values times the trees' weights.

    `saved` is the folder that `model.write().save` made. A row goes left if its
    feature is at most the threshold; leaves have no children.
    """
    scale = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.col("treeID") + 1)
    n = spark.read.parquet(f"{saved}/data").select("treeID", "nodeData.*")
    inner = F.col("leftChild") >= 0
    of = lambda c: F.when(inner, c)
    return n.select(
        F.col("treeID").cast("long").alias("tree"), F.col("id").cast("long").alias("node"), of(F.col("split.featureIndex")).alias("feature"), of(F.get("split.leftCategoriesOrThreshold", F.lit(0))).alias("threshold"),
        of(F.col("leftChild").cast("long")).alias("left"), of(F.col("rightChild").cast("long")).alias("right"), F.col("rawCount").cast("double").alias("cover"), (F.col("prediction") * scale).alias("value"),
    )


def leaf_paths(trees: DataFrame) -> DataFrame:
    """(tree, leaf, value, path): for each leaf of nonzero value its conditions array<struct<feature, low, high, part>>.

    A feature that a path asks for more than once is one condition: low < x <=
    high, and the product of the parts of the rows that went on. Trees start at
    node 0, and a child that no training row reached has part 0. One join a level.
    """
    checkpoints(trees.sparkSession)
    trees = trees.checkpoint()
    inf, kind = float("inf"), "array<struct<feature:int,low:double,high:double,part:double>>"
    front = trees.where("node = 0").withColumn("path", F.array().cast(kind))
    ends = None
    names = [c for c in trees.columns if c != "tree"]
    while True:
        front = front.checkpoint()
        leaf = front.where("left is null")
        ends = leaf if ends is None else ends.unionByName(leaf)
        inner = front.where("left is not null")
        if inner.isEmpty():
            break
        side = F.explode(F.array(F.struct(F.col("left").alias("child"), F.lit(-inf).alias("low"), F.col("threshold").alias("high")), F.struct(F.col("right").alias("child"), F.col("threshold").alias("low"), F.lit(inf).alias("high"))))
        steps = inner.select("tree", "feature", F.col("cover").alias("whole"), "path", side.alias("s")).select("tree", "feature", "whole", "path", "s.*")
        below = trees.select("tree", *(F.col(c).alias(f"n_{c}") for c in names))
        met = steps.join(below, (steps["tree"] == below["tree"]) & (steps["child"] == below["n_node"])).drop(below["tree"])
        part = F.when(F.col("whole") > 0, F.col("n_cover") / F.col("whole")).otherwise(0.0)
        one = F.array(F.struct(F.col("feature").cast("int").alias("feature"), "low", "high", part.alias("part")).cast(kind[6:-1]))
        front = met.withColumn("path", F.concat("path", one)).select("tree", *(F.col(f"n_{c}").alias(c) for c in names), "path")
    long = ends.where("value <> 0").select("tree", F.col("node").alias("leaf"), "value", F.explode_outer("path").alias("c")).select("tree", "leaf", "value", "c.*")
    merged = long.groupBy("tree", "leaf", "value", "feature").agg(F.max("low").alias("low"), F.min("high").alias("high"), F.product("part").alias("part"))
    cond = F.when(F.col("feature").isNotNull(), F.struct("feature", "low", "high", "part"))
    return merged.groupBy("tree", "leaf", "value").agg(F.array_sort(F.collect_list(cond)).alias("path"))


def _shapley(x: np.ndarray, feature: np.ndarray, low: np.ndarray, high: np.ndarray, part: np.ndarray, value: np.ndarray, out: np.ndarray) -> None:
    """Adds to out (rows, features) what leaves of paths of one length, as arrays (leaves, conditions), give the rows x."""
    m = feature.shape[1]
    t, w = np.polynomial.legendre.leggauss((m + 1) // 2)
    step = max(1, CELLS // max(1, len(x) * m))
    for a in range(0, len(feature), step):
        f, z = feature[a : a + step], part[a : a + step]
        at = x[:, f]
        # written so that a value that is no number goes right, as it does in the model
        known = (~(at <= low[a : a + step]) & ((at <= high[a : a + step]) | np.isinf(high[a : a + step]))).astype(float)
        rest = np.zeros_like(known)
        for ti, wi in zip((t + 1) / 2, w / 2, strict=True):
            term = ti * known + (1 - ti) * z
            before, after = np.ones_like(term), np.ones_like(term)
            np.cumprod(term[..., :-1], -1, out=before[..., 1:])
            after[..., :-1] = np.cumprod(term[..., :0:-1], -1)[..., ::-1]
            rest += wi * before * after
        share = (known - z) * rest * value[a : a + step, None]
        np.add.at(out.T, f.ravel(), share.reshape(len(x), -1).T)


def attribute(df: DataFrame, leaves: DataFrame, features: str = "features") -> DataFrame:
    """df with `attributions` (array, one for each feature) and `base`; base and the attributions add up to the trees' margin.

    `leaves` is the table of `leaf_paths`. It is as large as the model, which
    its fit has held in one place before; LEAVES paths at a time go with the tasks,
    one pass after the other over the rows, none of them a shuffle. A null vector
    has null attributions and a null entry is no number (it goes right). Vectors
    shorter than the model's features are an error; entries that no tree asks for
    have 0. df may not have columns of these two names.
    """
    taken = {"attributions", "base", "__sum"} & {c.lower() for c in df.columns}
    if taken:
        raise ValueError(f"columns {sorted(taken)} are made here")
    base = leaves.agg(F.coalesce(F.sum(F.col("value") * F.aggregate("path", F.lit(1.0), lambda a, c: a * c["part"])), F.lit(0.0)).alias("b")).first()["b"]
    blocks: list[list] = [[]]
    for r in leaves.where("size(path) > 0").orderBy("tree", "leaf").toLocalIterator():
        if len(blocks[-1]) == LEAVES:
            blocks.append([])
        blocks[-1].append((r["value"], [tuple(c) for c in r["path"]]))
    out = df.withColumn("__sum", F.transform(F.col(features).cast("array<double>"), lambda x: F.lit(0.0)))
    for block in blocks:
        if block:
            out = out.mapInArrow(_adder(block, features), out.schema)
    return out.withColumnRenamed("__sum", "attributions").withColumn("base", F.lit(float(base)))


def _adder(block: list, features: str):
    lengths: dict[int, list] = {}
    for value, path in block:
        lengths.setdefault(len(path), []).append((value, path))
    groups = []
    for of_length in lengths.values():
        conditions = [np.array([[c[i] for c in path] for _, path in of_length], np.int64 if i == 0 else float) for i in range(4)]
        groups.append((*conditions, np.array([v for v, _ in of_length], float)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, at = batch.column(features).to_pylist(), batch.schema.get_field_index("__sum")
            sums = batch.column(at).to_pylist()
            by_width: dict[int, list[int]] = {}
            for i, v in enumerate(x):
                if v is not None:
                    by_width.setdefault(len(v), []).append(i)
            for places in by_width.values():
                rows = np.array([x[i] for i in places], float)
                out = np.array([sums[i] for i in places], float)
                for group in groups:
                    _shapley(rows, *group, out)
                for i, row in zip(places, out, strict=True):
                    sums[i] = row.tolist()
            yield batch.set_column(at, batch.schema.field(at), pa.array(sums, batch.schema.field(at).type))

    return run


def explain(df: DataFrame, model, saved: str) -> DataFrame:
    """df with predicted_label, and the attributions and base of the predicted class's margin, by a model of `labelers.fit(.., "trees")`.

    Each class's trees are written to `saved`, a folder that all executors see,
    and read back as tables. A row meets the trees of its own class only.
    """
    from . import labelers

    classes = model.stages[0].models
    labelled = labelers.predict(model, df)
    out = None
    for c, one in enumerate(classes):
        one.write().overwrite().save(f"{saved}/class-{c}")
        leaves = leaf_paths(tree_table(df.sparkSession, f"{saved}/class-{c}", one.treeWeights))
        got = attribute(labelled.where(F.col("predicted_label") == c), leaves)
        out = got if out is None else out.unionByName(got)
    return out


def of_spans(attributed: DataFrame, keys: list[str], spans: list[tuple[str, int, int]], k: int = 5) -> DataFrame:
    """(keys, group, share, top) of each span (group, start, end): the part of all attributions, in size, that falls in it, and its k largest entries.

    `top` is array<struct<dim, share, value>> by size, ties by dim, those of size 0
    left out; an entry's share is of its span, its value the attribution with its
    sign. Rows without attributions have none; a row whose attributions are all
    0 has shares of 0. Everything is made in the row: no shuffle.
    """
    size = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + F.abs(x))
    whole = size(F.col("attributions"))

    def entry(start: int, inner: Column):
        return lambda x, i: F.struct((-F.try_divide(F.abs(x), inner)).alias("order"), (i + start).cast("int").alias("dim"), x.alias("value"))

    made = []
    for name, start, end in spans:
        part = F.slice("attributions", start + 1, end - start)
        named = F.filter(F.transform(part, entry(start, size(part))), lambda c: c["order"] < 0)
        top = F.transform(F.slice(F.array_sort(named), 1, k), lambda c: F.struct(c["dim"], (-c["order"]).alias("share"), c["value"]))
        made.append(F.struct(F.lit(name).alias("group"), F.coalesce(F.try_divide(size(part), whole), F.lit(0.0)).alias("share"), top.alias("top")))
    return attributed.where("attributions is not null").select(*keys, F.explode(F.array(*made)).alias("__g")).select(*keys, "__g.*")
