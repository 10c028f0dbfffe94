"""Leakage detectors over nodes and edges of all notebooks at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ends_with_any, has_token, leaf_callee, tokens
from ..taxonomy import COMPUTE_HUBS, ESTIMATOR_SUFFIXES, ESTIMATORS, METRIC_CALLS, SPLIT_CALLS, SPLITTER_SUFFIXES, SPLITTERS, TEST_WORDS_WIDE, TRAIN_CALLS, TRAIN_WORDS, TRANSFORMER_SUFFIXES, TRANSFORMERS
from . import graphs

CLASSES = ["preprocessing_before_split", "target_leakage", "test_in_train", "metric_on_train", "no_holdout_evaluation"]


def _transformer(name: Column) -> Column:
    return name.isin(*TRANSFORMERS) | ends_with_any(name, TRANSFORMER_SUFFIXES)


def _model(name: Column) -> Column:
    return name.isin(*ESTIMATORS) | ends_with_any(name, ESTIMATOR_SUFFIXES)


def hubs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """CALL nodes with callee, ctor (the callee that made their receiver) and roles is_split, is_fit, is_train, is_metric.

    The receiver is the source of the first CALLER edge; its maker the first
    hub with an output edge to it, else the receiver itself.
    """
    n = nodes.select("nb_id", "node_id", "ord", F.col("node_type").isin(*COMPUTE_HUBS).alias("is_hub"), "code", leaf_callee(F.col("code")).alias("callee"))
    first = lambda df, key, value: df.groupBy("nb_id", key).agg(F.min_by(value, "ord").alias(value))
    receiver = first(edges.where("edge_type = 0").select("nb_id", F.col("dst").alias("node_id"), F.col("src").alias("receiver"), "ord"), "node_id", "receiver")
    made = edges.where("edge_type = 2").join(n.where("is_hub").select("nb_id", F.col("node_id").alias("src")), ["nb_id", "src"], "left_semi")
    producer = first(made.select("nb_id", F.col("dst").alias("receiver"), F.col("src").alias("producer"), "ord"), "receiver", "producer")
    ctor = n.select("nb_id", F.col("node_id").alias("maker"), F.col("callee").alias("ctor"))
    out = n.where("is_hub").join(receiver, ["nb_id", "node_id"], "left").join(producer, ["nb_id", "receiver"], "left")
    out = out.withColumn("maker", F.coalesce("producer", "receiver")).join(ctor, ["nb_id", "maker"], "left").withColumn("ctor", F.coalesce("ctor", F.lit("")))
    c, k = F.col("callee"), F.col("ctor")
    return out.select(
        "nb_id", "node_id", "ord", "code", "callee", "ctor",
        (c.isin(*SPLIT_CALLS) | ((c == "split") & (k.isin(*SPLITTERS) | ends_with_any(k, SPLITTER_SUFFIXES)))).alias("is_split"),
        (c.isin("fit_transform", "fit_resample") | ((c == "fit") & _transformer(k))).alias("is_fit"),
        (c.isin(*TRAIN_CALLS) & (c != "fit_resample") & (c.isin("fit_predict", "partial_fit") | _model(k) | ((c == "fit") & ~_transformer(k)))).alias("is_train"),
        c.isin(*METRIC_CALLS).alias("is_metric"),
    )


def split_outputs(nodes: DataFrame, edges: DataFrame, splits: DataFrame) -> DataFrame:
    """(nb_id, split, node_id, role): outputs of splits by train- and test-like names; if no output has one, even places train, odd test."""
    out = edges.where("edge_type = 2").join(splits.select("nb_id", F.col("node_id").alias("src")), ["nb_id", "src"], "left_semi").select("nb_id", F.col("src").alias("split"), F.col("dst").alias("node_id"), "ord")
    out = out.join(nodes.select("nb_id", "node_id", "label"), ["nb_id", "node_id"])
    words = F.array_union(tokens(F.col("label")), tokens(F.col("node_id")))
    over = lambda w: F.arrays_overlap(words, F.array(*map(F.lit, w)))
    named = F.when(over(TEST_WORDS_WIDE), "test").when(over(TRAIN_WORDS), "train")
    w = Window.partitionBy("nb_id", "split")
    place = (F.row_number().over(w.orderBy("ord", "node_id")) - 1) % 2
    role = F.when(F.max(named.isNotNull()).over(w), named).otherwise(F.when(place == 0, "train").otherwise("test"))
    return out.withColumn("role", role).where("role is not null").select("nb_id", "split", "node_id", "role")


def _inputs(edges: DataFrame, of: DataFrame) -> DataFrame:
    """(nb_id, hub, node_id, i): INPUT sources of hubs in the order of edges, from 1."""
    e = edges.where("edge_type = 1").join(of.select("nb_id", F.col("node_id").alias("dst")), ["nb_id", "dst"], "left_semi")
    return e.select("nb_id", F.col("dst").alias("hub"), F.col("src").alias("node_id"), F.row_number().over(Window.partitionBy("nb_id", "dst").orderBy("ord")).alias("i"))


def _down(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Seeds and what they reach, (nb_id, node_id)."""
    s = seeds.select("nb_id", "node_id").distinct()
    return graphs.reached(edges, s).unionByName(s).distinct()


def _ways(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(nb_id, src, dst): each seed with itself and what it reaches."""
    s = seeds.select("nb_id", "node_id").distinct()
    return graphs.walks(edges, s).unionByName(s.select("nb_id", F.col("node_id").alias("seed"), "node_id")).distinct().select("nb_id", F.col("seed").alias("src"), F.col("node_id").alias("dst"))


def findings(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(nb_id, leakage_class, node, code, source_node), one row per class and node.

    nodes need node_type, ord, code, label; edges edge_type and ord. These, and
    the hubs, are written once to the shared folder, as all five detectors read
    them; each walks from its own seeds.
    """
    nodes = nodes.select("nb_id", "node_id", "node_type", "ord", "code", "label").checkpoint()
    edges = edges.select("nb_id", "src", "dst", "edge_type", "ord").checkpoint()
    h = hubs(nodes, edges).checkpoint()
    splits, fits, models, metrics = (h.where(c) for c in ("is_split", "is_fit", "is_train", "is_metric"))
    roles = split_outputs(nodes, edges, splits).checkpoint()
    used = h.where("is_split or is_fit or is_train or is_metric")
    ins = _inputs(edges, used).join(used.select("nb_id", F.col("node_id").alias("hub"), "is_split", "is_fit", "is_train", "is_metric"), ["nb_id", "hub"]).checkpoint()
    at = {"split": ins.where("is_split"), "fit": ins.where("is_fit"), "model": ins.where("is_train"), "metric": ins.where("is_metric")}

    def out(df: DataFrame, name: str) -> DataFrame:
        return df.select("nb_id", F.lit(name).alias("leakage_class"), "node", "code", "source_node")

    # preprocessing before a split that its input reaches; the first such split
    pairs = fits.select("nb_id", F.col("node_id").alias("node"), "code", F.col("ord").alias("o")).join(splits.select("nb_id", F.col("node_id").alias("dst"), F.col("ord").alias("so")), "nb_id").where("o < so")
    near = at["fit"].select("nb_id", F.col("hub").alias("node"), F.col("node_id").alias("src"))
    ways = _ways(edges, near.select("nb_id", F.col("src").alias("node_id")))
    d1 = pairs.join(near, ["nb_id", "node"]).join(ways, ["nb_id", "src", "dst"], "left_semi").groupBy("nb_id", "node").agg(F.first("code").alias("code"), F.min_by("dst", "so").alias("source_node"))

    # the target, without the split, reaches what a model's first input comes from
    targets = ins.where("i = 2 and (is_split or is_train)").select("nb_id", "node_id").distinct()
    no_split = splits.select("nb_id", F.col("node_id").alias("x"))
    sub = edges.join(no_split.withColumnRenamed("x", "src"), ["nb_id", "src"], "left_anti").join(no_split.withColumnRenamed("x", "dst"), ["nb_id", "dst"], "left_anti")
    below = graphs.reached(sub, targets).select("nb_id", F.col("node_id").alias("src")).join(h.select("nb_id", F.col("node_id").alias("src")), ["nb_id", "src"], "left_semi")
    made = edges.where("edge_type = 2")
    derived = made.join(below, ["nb_id", "src"], "left_semi").select("nb_id", F.col("dst").alias("node_id")).distinct()
    derived = derived.join(targets, ["nb_id", "node_id"], "left_anti")
    derived = derived.join(made.join(splits.select("nb_id", F.col("node_id").alias("src")), ["nb_id", "src"], "left_semi").select("nb_id", F.col("dst").alias("node_id")), ["nb_id", "node_id"], "left_anti")
    feature = at["model"].where("i = 1").select("nb_id", F.col("hub").alias("node"), F.col("node_id").alias("dst"))
    d2 = feature.join(_ways(edges, derived), ["nb_id", "dst"]).groupBy("nb_id", "node").agg(F.min("src").alias("source_node")).join(models.select("nb_id", F.col("node_id").alias("node"), "code"), ["nb_id", "node"])

    # test data reaches a model's input
    test = roles.where("role = 'test'").select("nb_id", "node_id")
    named = nodes.where(~F.col("node_type").isin(*COMPUTE_HUBS) & has_token(F.col("node_id"), TEST_WORDS_WIDE)).select("nb_id", "node_id").join(test.select("nb_id").distinct(), "nb_id", "left_anti")
    d3 = at["model"].join(_down(edges, test.unionByName(named)), ["nb_id", "node_id"], "left_semi").groupBy("nb_id", F.col("hub").alias("node")).agg(F.min_by("node_id", "i").alias("source_node")).join(models.select("nb_id", F.col("node_id").alias("node"), "code"), ["nb_id", "node"])

    # a metric of train data alone
    train = roles.where("role = 'train'").select("nb_id", "node_id").unionByName(at["model"].select("nb_id", "node_id"))
    seen = at["metric"]
    on_train = seen.join(_down(edges, train), ["nb_id", "node_id"], "left_semi").select("nb_id", "hub").distinct()
    on_test = seen.join(_down(edges, test), ["nb_id", "node_id"], "left_semi").select("nb_id", "hub")
    d4 = on_train.join(on_test, ["nb_id", "hub"], "left_anti").withColumnRenamed("hub", "node").join(metrics.select("nb_id", F.col("node_id").alias("node"), "code"), ["nb_id", "node"]).withColumn("source_node", F.lit(None).cast("string"))

    # models and no split: the first
    d5 = models.join(splits.select("nb_id"), "nb_id", "left_anti").groupBy("nb_id").agg(F.min_by(F.struct("node_id", "code"), "ord").alias("f")).select("nb_id", F.col("f.node_id").alias("node"), F.col("f.code").alias("code"), F.lit(None).cast("string").alias("source_node"))
    every = out(d1, CLASSES[0])
    for df, name in zip((d2, d3, d4, d5), CLASSES[1:], strict=True):
        every = every.unionByName(out(df, name))
    return every


def prevalence(found: DataFrame, notebooks: DataFrame) -> DataFrame:
    """(leakage_class, findings, notebooks, pct of notebooks)."""
    n = notebooks.select("nb_id").distinct().agg(F.count("*").alias("n"))
    got = found.groupBy("leakage_class").agg(F.count("*").alias("findings"), F.countDistinct("nb_id").alias("notebooks"))
    return got.crossJoin(F.broadcast(n)).select("leakage_class", "findings", "notebooks", F.round(100 * F.col("notebooks") / F.col("n"), 2).alias("pct"))


def score(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(leakage_class, tp, fp, fn, precision, recall, f1) of classes per notebook against (nb_id, leakage_class); 'micro' has all."""
    a = found.select("nb_id", "leakage_class").distinct().withColumn("p", F.lit(1))
    b = truth.where(F.col("leakage_class").isin(*CLASSES)).select("nb_id", "leakage_class").distinct().withColumn("g", F.lit(1))
    both = a.join(b, ["nb_id", "leakage_class"], "full").fillna(0, ["p", "g"])
    counts = both.rollup("leakage_class").agg(F.sum(F.col("p") * F.col("g")).alias("tp"), F.sum(F.col("p") * (1 - F.col("g"))).alias("fp"), F.sum((1 - F.col("p")) * F.col("g")).alias("fn")).withColumn("leakage_class", F.coalesce("leakage_class", F.lit("micro")))
    from .metrics import with_prf

    return with_prf(counts)


def overlay(found: DataFrame, gold: DataFrame) -> DataFrame:
    """found with gold classes (nb_id, node, leakage_class) in place of detected ones where a node has one."""
    g = gold.select("nb_id", "node", F.col("leakage_class").alias("__g"))
    out = found.join(g, ["nb_id", "node"], "left").withColumn("from_gold", F.col("__g").isNotNull())
    return out.withColumn("leakage_class", F.coalesce("__g", "leakage_class")).drop("__g")
