"""Labelers of operations: knowledge base first, remote clients, classical models, priors."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..taxonomy import OPERATION
from . import graphs

NOT_RELEVANT = OPERATION["NOT_RELEVANT"]


class Pace:
    """At most `calls` requests and `tokens` tokens in a window of seconds; waits else. For one client in one task."""

    def __init__(self, calls: int = 60, tokens: int = 100_000, window: float = 60.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.calls, self.tokens, self.window, self.clock, self.sleep = calls, tokens, window, clock, sleep
        self.used: list[tuple[float, int]] = []

    def wait(self, tokens: int) -> None:
        while True:
            now = self.clock()
            self.used = [(t, n) for t, n in self.used if now - t < self.window]
            if not self.used or (len(self.used) < self.calls and sum(n for _, n in self.used) + tokens <= self.tokens):
                self.used.append((now, tokens))
                return
            self.sleep(max(0.001, self.window - (now - self.used[0][0])))


def with_retries(ask: Callable[[str], str], attempts: int = 4, first_wait: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], str]:
    """ask that tries again after doubling waits; the last failure is raised."""

    def again(prompt: str) -> str:
        for k in range(attempts):
            try:
                return ask(prompt)
            except Exception:
                if k == attempts - 1:
                    raise
                sleep(first_wait * 2**k)
        raise AssertionError

    return again


def rule_client() -> Callable[[str], str]:
    """A client without a network: it answers with the class that the prompt's callee suggests."""
    from ..taxonomy import LOAD_CALLS, MODEL_CALLS, WRITE_CALLS

    def ask(prompt: str) -> str:
        words = set(prompt.replace("(", " ").replace(".", " ").split())
        for names, label in ((LOAD_CALLS, "DATA_IMPORT_EXTRACTION"), (MODEL_CALLS, "MODEL_OPERATION"), (WRITE_CALLS, "DATA_EXPORT")):
            if words & set(names):
                return label
        return "DATA_TRANSFORM"

    return ask


def answer_label(answer: Column) -> Column:
    """The class that an answer names; NOT_RELEVANT if it names none, export for artifact export."""
    codes = F.create_map(*(F.lit(x) for k, v in OPERATION.items() if 0 <= v <= 6 for x in (k, 4 if v == 6 else v)))
    return F.coalesce(F.try_element_at(codes, F.upper(F.regexp_replace(F.trim(answer), r"[\s-]+", "_"))), F.lit(NOT_RELEVANT))


def prompt(code: Column, context: Column | None = None) -> Column:
    classes = ", ".join(k for k, v in OPERATION.items() if 0 <= v <= 5)
    head = F.lit(f"Name the class of this operation, one of {classes}.\nCode: ")
    return F.concat(head, code) if context is None else F.concat(head, code, F.lit("\nContext: "), context)


def ask_all(df: DataFrame, column: str, make_client: Callable[[], Callable[[str], str]], partitions: int = 8) -> DataFrame:
    """df with answer: each distinct prompt goes to a client once; `partitions` clients run at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = make_client()
        for b in batches:
            ps = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([client(p or "") for p in ps], pa.string())], names=["__p", "answer"])

    answers = df.select(F.col(column).alias("__p")).distinct().repartition(partitions, "__p").mapInArrow(run, "__p string, answer string")
    return df.join(answers, df[column].eqNullSafe(answers["__p"]), "left").drop("__p")


def label_by_code(nodes: DataFrame, make_client=rule_client) -> DataFrame:
    """CALL nodes by their code alone."""
    calls = nodes.where("struct_type = 9").withColumn("__q", prompt(F.coalesce("code", F.lit(""))))
    return ask_all(calls, "__q", make_client).withColumn("predicted_label", answer_label(F.col("answer"))).drop("__q", "answer")


def label_by_context(nodes: DataFrame, edges: DataFrame, make_client=rule_client) -> DataFrame:
    """CALL nodes by their code and the names around them."""
    c = graphs.context(nodes, edges)
    said = F.concat_ws("; ", *(F.concat(F.lit(f"{n}: "), F.array_join(F.coalesce(n, F.array().cast("array<string>")), ", ")) for n in ("inputs", "libraries", "outputs")))
    calls = nodes.where("struct_type = 9").join(c.select("nb_id", "node_id", said.alias("__c")), ["nb_id", "node_id"]).withColumn("__q", prompt(F.coalesce("code", F.lit("")), F.col("__c")))
    return ask_all(calls, "__q", make_client).withColumn("predicted_label", answer_label(F.col("answer"))).drop("__q", "__c", "answer")


def notebook_chunks(nodes: DataFrame, size: int = 60) -> DataFrame:
    """(nb_id, chunk, node_ids, prompt): a notebook's CALL nodes, `size` to a prompt."""
    rank = F.row_number().over(Window.partitionBy("nb_id").orderBy("ord")) - 1
    calls = nodes.where("struct_type = 9").withColumn("chunk", F.floor(rank / size))
    rows = F.array_sort(F.collect_list(F.struct("ord", "node_id", "code")))
    return calls.groupBy("nb_id", "chunk").agg(rows.alias("r")).select("nb_id", "chunk", F.transform("r", lambda x: x["node_id"]).alias("node_ids"), F.array_join(F.transform("r", lambda x: x["code"]), "\n").alias("prompt"))


def random_labels(nodes: DataFrame, classes: int = 6, seed: int = 42) -> DataFrame:
    """nodes with probabilities drawn from a flat Dirichlet by a seeded hash of the node, and their top two."""
    from .metrics import top_two

    u = lambda i: (F.pmod(F.xxhash64(F.lit(seed), i, "nb_id", "node_id"), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)
    e = F.array(*(-F.log(u(F.lit(i))) for i in range(classes)))
    p = F.transform("__e", lambda x: x / F.aggregate("__e", F.lit(0.0), lambda a, y: a + y))
    return top_two(nodes.withColumn("__e", e).withColumn("probabilities", p).drop("__e"), "probabilities")


def degree_prior(df: DataFrame, probabilities: str, factor: float = 2.0) -> DataFrame:
    """Probabilities with imports favoured at sources and exports at sinks of the graph (in_degree, out_degree), to sum 1."""
    boost = lambda p, i: F.when((F.col("in_degree") == 0) & (i == 1), p * factor).when((F.col("out_degree") == 0) & (i == 4), p * factor).otherwise(p)
    out = df.withColumn(probabilities, F.transform(probabilities, boost))
    return out.withColumn(probabilities, F.transform(probabilities, lambda x: x / F.aggregate(probabilities, F.lit(0.0), lambda a, y: a + y)))


def fit(df: DataFrame, kind: str = "mlp", classes: int = 6, seed: int = 42):
    """A fitted model of df(features array<double>, label): 'mlp' (one hidden layer), or 'trees' (boosted, one against the rest)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier, OneVsRest
    from pyspark.ml.functions import array_to_vector

    data = df.select(array_to_vector("features").alias("features"), F.col("label").cast("double").alias("label"))
    width = len(df.select("features").first()["features"])
    if kind == "mlp":
        return MultilayerPerceptronClassifier(layers=[width, 32, classes], maxIter=100, seed=seed).fit(data)
    return Pipeline(stages=[OneVsRest(classifier=GBTClassifier(maxIter=20, maxDepth=4, seed=seed))]).fit(data)


def predict(model, df: DataFrame) -> DataFrame:
    """df with predicted_label, and with probabilities and their top two where the model has them."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from .metrics import top_two

    out = model.transform(df.withColumn("__a", F.col("features")).withColumn("features", array_to_vector("features")))
    out = out.drop("features").withColumnRenamed("__a", "features")
    if "probability" in out.columns:
        return top_two(out.withColumn("probabilities", vector_to_array("probability")), "probabilities").drop("probability", "rawPrediction", "prediction")
    return out.withColumn("predicted_label", F.col("prediction").cast("int")).drop("rawPrediction", "prediction")


def message_passing(nodes: DataFrame, edges: DataFrame, features: str, rounds: int = 2) -> DataFrame:
    """nodes with features followed by the means of neighbours' features, in and out, round by round: what a linear graph network sees."""
    kind = nodes.schema["nb_id"].dataType.simpleString()
    n = nodes.select("nb_id", F.col("node_id").alias("a"), F.lit(None).cast("string").alias("b"), F.col(features).cast("array<double>").alias("x"))
    e = edges.select("nb_id", F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(None).cast("array<double>").alias("x"))

    def per(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        at = {r["a"]: i for i, r in enumerate(r for r in rows if r["b"] is None)}
        x = np.array([r["x"] for r in rows if r["b"] is None])
        m = np.zeros((len(at), len(at)))
        for r in rows:
            if r["b"] is not None and r["a"] in at and r["b"] in at:
                m[at[r["b"]], at[r["a"]]] = 1
        mean = lambda a: a / np.maximum(a.sum(1, keepdims=True), 1)
        out, here = [x], x
        for _ in range(rounds):
            here = np.concatenate([mean(m) @ here, mean(m.T) @ here], 1)
            out.append(here)
        full = np.concatenate(out, 1)
        nb = pa.array([rows[0]["nb_id"]] * len(at), table.schema.field("nb_id").type)
        return pa.table([nb, pa.array(list(at), pa.string()), pa.array(full.tolist(), pa.list_(pa.float64()))], names=["nb_id", "node_id", "features"])

    got = n.unionByName(e).groupBy("nb_id").applyInArrow(per, f"nb_id {kind}, node_id string, features array<double>")
    return nodes.drop("features").join(got, ["nb_id", "node_id"])


def resume(nodes: DataFrame, done: DataFrame) -> DataFrame:
    """Nodes of notebooks that have no result yet."""
    return nodes.join(done.select("nb_id").distinct(), "nb_id", "left_anti")


def cached(computed: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored labels before computed ones."""
    s = stored.select("nb_id", "node_id", F.col("predicted_label").alias("__s"))
    return computed.join(s, ["nb_id", "node_id"], "left").withColumn("predicted_label", F.coalesce("__s", "predicted_label")).drop("__s")
