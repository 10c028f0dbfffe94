"""Evaluation metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_prf(counts: DataFrame) -> DataFrame:
    """counts(tp, fp, fn) with precision, recall and f1; 0 on an empty denominator."""
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = counts.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def node_scores(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(label, tp, fp, fn, ...) of (nb_id, node_id, label): a mismatch is one fp of the predicted class and one fn of the gold one; label null is all."""
    both = gold.select("nb_id", "node_id", F.col("label").alias("g")).join(predicted.select("nb_id", "node_id", F.col("label").alias("p")), ["nb_id", "node_id"], "left")
    hit = both.select(F.col("g").alias("label"), F.coalesce(F.col("g") == F.col("p"), F.lit(False)).cast("int").alias("tp"), F.lit(0).alias("fp"), (1 - F.coalesce(F.col("g") == F.col("p"), F.lit(False)).cast("int")).alias("fn"))
    wrong = both.where("p is not null and p <> g").select(F.col("p").alias("label"), F.lit(0).alias("tp"), F.lit(1).alias("fp"), F.lit(0).alias("fn"))
    return with_prf(hit.unionByName(wrong).rollup("label").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn"))))


def set_scores(gold: DataFrame, found: DataFrame, keys: list[str], group: str) -> DataFrame:
    """(group, tp, fp, fn, ...) of exact sets: edges (u, v, label) or tuples, per group and in all (null), by one full join and grouping sets."""
    a = gold.select(*keys).distinct().withColumn("g", F.lit(1))
    b = found.select(*keys).distinct().withColumn("f", F.lit(1))
    both = a.join(b, keys, "full").fillna(0, ["g", "f"])
    return with_prf(both.rollup(group).agg(F.sum(F.col("g") * F.col("f")).alias("tp"), F.sum((1 - F.col("g")) * F.col("f")).alias("fp"), F.sum(F.col("g") * (1 - F.col("f"))).alias("fn")))


def fold_summary(scores: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, sample deviation (0 for one) and number of the folds' values that aren't null."""
    return scores.groupBy(*keys).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.count(value).alias("n"))


def order_scores(predicted: DataFrame, truth: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(nb_id, accuracy, tau) of ordered pairs of (nb_id, item, rank); with pairs(nb_id, a, b) only of those."""
    x = truth.select("nb_id", F.col("item").alias("a"), F.col("rank").alias("ta"))
    y = truth.select("nb_id", F.col("item").alias("b"), F.col("rank").alias("tb"))
    p = predicted.select("nb_id", "item", "rank")
    both = x.join(y, "nb_id").where("ta < tb")
    if pairs is not None:
        both = both.join(pairs.select("nb_id", "a", "b"), ["nb_id", "a", "b"], "left_semi")
    both = both.join(p.withColumnsRenamed({"item": "a", "rank": "pa"}), ["nb_id", "a"]).join(p.withColumnsRenamed({"item": "b", "rank": "pb"}), ["nb_id", "b"])
    return both.groupBy("nb_id").agg(F.avg((F.col("pa") < F.col("pb")).cast("int")).alias("accuracy"), F.avg(F.when(F.col("pa") < F.col("pb"), 1).otherwise(-1)).alias("tau"))


def edge_audit(gold: DataFrame, found: DataFrame) -> DataFrame:
    """Counts of edges (nb_id, src, dst) in both, only in gold, only found."""
    g, f = gold.select("nb_id", "src", "dst").distinct(), found.select("nb_id", "src", "dst").distinct()
    return g.intersect(f).agg(F.count("*").alias("both")).crossJoin(g.exceptAll(f).agg(F.count("*").alias("missing"))).crossJoin(f.exceptAll(g).agg(F.count("*").alias("extra")))


def power_fit(df: DataFrame, x: str, y: str, lo: float = 0.02, hi: float = 0.98) -> DataFrame:
    """(slope, intercept, n) of a line through the logarithms of positive points within percentiles of x and under one of y."""
    bounds = df.agg(F.expr(f"percentile({x}, {lo})").alias("lo"), F.expr(f"percentile({x}, {hi})").alias("hi"), F.expr(f"percentile({y}, {hi})").alias("top"))
    kept = df.crossJoin(F.broadcast(bounds)).where(f"{x} >= lo and {x} <= hi and {y} <= top and {x} > 0 and {y} > 0")
    a, b = F.log10(F.col(x).cast("double")), F.log10(F.col(y).cast("double"))
    return kept.agg(F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"), F.count("*").alias("n"))


def serial_latency(df: DataFrame, workers: int = 16) -> DataFrame:
    """df(calls, seconds) with the seconds that one worker would take: rounds of `workers` calls made one after another."""
    return df.withColumn("serial_seconds", F.col("seconds") * F.col("calls") / F.greatest(F.ceil(F.col("calls") / workers), F.lit(1)))


def groups_by_coverage(labels: DataFrame, known: DataFrame) -> DataFrame:
    """labels(library, api, ...) with a group: shared if (library, api) is known, unique if only the api is, else unresolved."""
    a = known.select("library", "api").distinct().withColumn("__s", F.lit(True))
    b = known.select("api").distinct().withColumn("__u", F.lit(True))
    out = labels.join(a, ["library", "api"], "left").join(b, "api", "left")
    return out.withColumn("group", F.when(F.col("__s"), "shared").when(F.col("__u"), "unique").otherwise("unresolved")).drop("__s", "__u")


def top_two(df: DataFrame, probabilities: str) -> DataFrame:
    """df with predicted_label, runner_up, confidence and margin; ARTIFACT_EXPORT counts as DATA_EXPORT. Ties take the later class."""
    order = F.sort_array(F.zip_with(F.col(probabilities), F.sequence(F.lit(0), F.size(probabilities) - 1), lambda p, i: F.struct(p.alias("p"), i.alias("i"))), asc=False)
    label = lambda s: F.when(s["i"] == 6, 4).otherwise(s["i"]).cast("int")
    out = df.withColumn("__o", order)
    first, second = F.get("__o", F.lit(0)), F.get("__o", F.lit(1))
    return out.withColumns({"predicted_label": label(first), "runner_up": F.coalesce(label(second), label(first)), "confidence": first["p"], "margin": F.coalesce(first["p"] - second["p"], F.lit(1.0))}).drop("__o")


def softmax(df: DataFrame, logits: str) -> DataFrame:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    return df.withColumn(logits, e).withColumn(logits, F.transform(logits, lambda x: x / F.aggregate(logits, F.lit(0.0), lambda a, y: a + y)))


def group_importances(attributions: DataFrame, spans: DataFrame, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(share of each feature group per node, the k largest dimensions of each group) of (node_id, dim, value) and spans(group, start, end)."""
    a = attributions.withColumn("value", F.abs("value")).join(spans, (F.col("dim") >= F.col("start")) & (F.col("dim") < F.col("end")))
    per = a.groupBy("node_id", "group").agg(F.sum("value").alias("v"))
    total = F.sum("v").over(Window.partitionBy("node_id"))
    shares = per.select("node_id", "group", F.when(total > 0, F.col("v") / total).otherwise(0.0).alias("share"))
    w = Window.partitionBy("node_id", "group").orderBy(F.col("value").desc(), "dim")
    return shares, a.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("node_id", "group", "dim", "value", "r")
