"""Refinement rules over nodes with predicted labels, as DataFrame -> DataFrame steps in a fixed order.

The state is a row per node: what it is known to be, and deferred updates that
write_back() applies at the end, so that each rule sees original attributes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import callee, ends_with_any, has_token
from ..taxonomy import COMPUTE_HUBS, DOMAIN_NODE, HUBS, LOAD_CALLS, MODEL_CALLS, MODEL_SUFFIXES, OPERATION, TEST_WORDS, WRITE_CALLS
from . import graphs
from .shared import kept

#: Thresholds of confidence and margin.
CONFIDENT, MARGIN = 0.6, 0.12
Rule = Callable[[DataFrame, DataFrame], DataFrame]
_NAMES = {v: k for k, v in OPERATION.items()}


def _hub() -> Column:
    return F.col("node_type").isin(*HUBS)


def _compute() -> Column:
    return F.col("node_type").isin(*COMPUTE_HUBS)


def _confident() -> Column:
    """A missing confidence counts as 1."""
    return F.coalesce("confidence", F.lit(1.0)) >= CONFIDENT


def _overridable() -> Column:
    return (F.coalesce("confidence", F.lit(1.0)) < CONFIDENT) & (F.coalesce("margin", F.lit(1.0)) < MARGIN)


def _name_of(code: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for k, v in _NAMES.items() for x in (k, v))), code)


def begin(nodes: DataFrame) -> DataFrame:
    """State columns for nodes(nb_id, node_id, struct_type, domain_type, domain_node, code, label, predicted_label, runner_up, confidence, margin)."""
    return nodes.withColumn("node_type", F.coalesce("domain_type", "struct_type")).withColumns(
        {"dataset": F.lit(False), "model": F.lit(False), "hyper": F.lit(False), "leak": F.lit(False), "dead": F.lit(False), "new_type": F.lit(None).cast("int"), "new_label": F.lit(None).cast("string"), "new_predicted": F.lit(None).cast("int")}
    )


def _set(df: DataFrame, column: str, when: Column, value) -> DataFrame:
    return df.withColumn(column, F.when(F.coalesce(when, F.lit(False)), value).otherwise(F.col(column)))


def _marks(state: DataFrame, found: DataFrame, mark: str) -> DataFrame:
    """state with a flag for the (nb_id, node_id) in found."""
    return state.join(found.select("nb_id", "node_id").distinct().withColumn(mark, F.lit(True)), ["nb_id", "node_id"], "left").withColumn(mark, F.coalesce(mark, F.lit(False)))


def base_truth(state: DataFrame, edges: DataFrame) -> DataFrame:
    label = _name_of(F.col("predicted_label"))
    is_domain = F.coalesce("domain_node", F.lit(False))
    data = (F.col("node_type") == 2) | (is_domain & (F.col("node_type") == DOMAIN_NODE["DATASET"]))
    op = _compute() & label.isNotNull()
    out = _set(state, "dataset", data | (op & (label == "DATA_IMPORT_EXTRACTION")), True)
    out = _set(out, "model", (is_domain & (F.col("node_type") == DOMAIN_NODE["MODEL"]) & ~data) | (op & (label == "MODEL_OPERATION")), True)
    return _set(out, "new_label", op, label)


def static_seeds(state: DataFrame, edges: DataFrame) -> DataFrame:
    name = callee(F.col("code"))
    load = _compute() & name.isin(*LOAD_CALLS)
    model = _compute() & ~name.isin(*LOAD_CALLS) & (name.isin(*MODEL_CALLS) | ends_with_any(name, MODEL_SUFFIXES))
    out = _set(_set(state, "dataset", load, True), "model", model, True)
    out = _set(out, "new_label", load & ~_confident(), "DATA_IMPORT_EXTRACTION")
    return _set(out, "new_label", model & ~_confident(), "MODEL_OPERATION")


def _runner_up(state: DataFrame, mark: Column, otherwise: str) -> DataFrame:
    runner = F.col("runner_up")
    at = mark & _compute() & (F.col("predicted_label") == OPERATION["NOT_RELEVANT"]) & _overridable() & runner.isNotNull() & (runner != OPERATION["NOT_RELEVANT"])
    out = state.withColumn("__at", F.coalesce(at, F.lit(False)))
    out = _set(_set(out, "new_predicted", F.col("__at"), runner), "new_label", F.col("__at"), F.coalesce(_name_of(runner), F.lit(otherwise)))
    return out.drop("__at")


def relevance(state: DataFrame, edges: DataFrame) -> DataFrame:
    """NOT_RELEVANT calls behind an import call take their runner-up."""
    anchors = state.where(_compute() & (F.col("predicted_label") == 1)).select("nb_id", "node_id")
    behind = graphs.reached(edges, anchors)
    return _runner_up(_marks(state, behind, "__b"), F.col("__b"), "DATA_TRANSFORM").drop("__b")


def backward_source(state: DataFrame, edges: DataFrame) -> DataFrame:
    """NOT_RELEVANT calls before a confident transform, none of whose inputs a call made, take their runner-up. A missing confidence counts as 0 here."""
    anchors = state.where(_compute() & (F.col("predicted_label") == 2) & (F.coalesce("confidence", F.lit(0.0)) >= CONFIDENT)).select("nb_id", "node_id")
    before = graphs.reached(edges, anchors, backwards=True)
    calls = state.where(_compute()).select("nb_id", F.col("node_id").alias("src"))
    made = edges.join(calls, ["nb_id", "src"], "left_semi").select("nb_id", F.col("dst").alias("src"))
    fed = edges.join(made.distinct(), ["nb_id", "src"], "left_semi").select("nb_id", F.col("dst").alias("node_id"))
    marked = _marks(_marks(state, before, "__b"), fed, "__f")
    return _runner_up(marked, F.col("__b") & ~F.col("__f"), "DATA_IMPORT_EXTRACTION").drop("__b", "__f")


def _next_to(state: DataFrame, edges: DataFrame, label: str, side: str) -> DataFrame:
    """Nodes one edge behind (`dst`) or before (`src`) the nodes so labelled."""
    other = "src" if side == "dst" else "dst"
    hubs = state.where(F.col("new_label") == label).select("nb_id", F.col("node_id").alias(other))
    return edges.join(hubs, ["nb_id", other], "left_semi").select("nb_id", F.col(side).alias("node_id"))


def backward_features(state: DataFrame, edges: DataFrame) -> DataFrame:
    out = _marks(state, _next_to(state, edges, "MODEL_OPERATION", "src"), "__x")
    at = F.col("__x") & F.col("node_type").isin(0, 4)
    return _set(_set(out, "dataset", at, True), "new_type", at, DOMAIN_NODE["FEATURE_ENGINEERING"]).drop("__x")


def forward_datasets(state: DataFrame, edges: DataFrame) -> DataFrame:
    out = _marks(state, _next_to(state, edges, "DATA_IMPORT_EXTRACTION", "dst"), "__x")
    return _set(out, "dataset", F.col("__x") & F.col("node_type").isin(0, 4), True).drop("__x")


def forward_models(state: DataFrame, edges: DataFrame) -> DataFrame:
    out = _marks(state, _next_to(state, edges, "MODEL_OPERATION", "dst"), "__x")
    return _set(out, "model", F.col("__x") & F.col("node_type").isin(0, 4), True).drop("__x")


def taint(state: DataFrame, edges: DataFrame) -> DataFrame:
    """From datasets through hubs: hubs without a label become transforms, and what they give datasets."""
    e = graphs.with_ends(edges, state, "node_type", "dataset")
    hub = F.col("dst_node_type").isin(*HUBS)
    seeds = state.where(F.col("dataset") & ~_hub()).select("nb_id", "node_id")
    # a walk leaves a node only into hubs; from a hub any next node goes on, a hub so met too
    steps = e.where(hub).select("nb_id", F.col("src").alias("a"), F.col("dst").alias("h")).distinct()
    two = steps.join(edges.select("nb_id", F.col("src").alias("h"), F.col("dst").alias("b")).distinct(), ["nb_id", "h"]).select("nb_id", F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
    reach = graphs.reached(two, seeds)
    on = reach.unionByName(seeds).distinct()
    hubs = steps.join(on.withColumnRenamed("node_id", "a"), ["nb_id", "a"], "left_semi").select("nb_id", F.col("h").alias("node_id"))
    new = reach.join(seeds, ["nb_id", "node_id"], "left_anti")
    out = _marks(_marks(state, hubs, "__h"), new, "__r")
    out = _set(out, "new_label", F.col("__h") & F.col("new_label").isNull(), "DATA_TRANSFORM")
    data = F.col("__r") & ~_hub()
    return _set(_set(out, "new_type", data, DOMAIN_NODE["DATASET"]), "dataset", data, True).drop("__h", "__r")


def evaluation(state: DataFrame, edges: DataFrame) -> DataFrame:
    known = graphs.with_ends(edges, state, "model", "dataset").groupBy("nb_id", F.col("dst").alias("node_id")).agg(F.bool_or("src_model").alias("__m"), F.bool_or("src_dataset").alias("__d"))
    out = state.join(known, ["nb_id", "node_id"], "left")
    at = _hub() & ~_confident() & (F.coalesce("new_label", F.lit("")) != "MODEL_OPERATION") & F.col("__m") & F.col("__d")
    out = out.withColumn("__at", F.coalesce(at, F.lit(False)))
    return _set(_set(out, "new_label", F.col("__at"), "EDA"), "new_predicted", F.col("__at"), OPERATION["EDA"]).drop("__m", "__d", "__at")


def artifacts(state: DataFrame, edges: DataFrame) -> DataFrame:
    at = _hub() & ~_confident() & callee(F.col("code")).isin(*WRITE_CALLS)
    out = state.withColumn("__at", F.coalesce(at, F.lit(False)))
    behind = edges.join(out.where("__at").select("nb_id", F.col("node_id").alias("src")), ["nb_id", "src"], "left_semi").select("nb_id", F.col("dst").alias("node_id"))
    out = _marks(_set(out, "new_label", F.col("__at"), "DATA_EXPORT"), behind, "__b")
    return _set(out, "new_type", F.col("__b") & ~_hub(), DOMAIN_NODE["ARTIFACT"]).drop("__at", "__b")


def literals(state: DataFrame, edges: DataFrame) -> DataFrame:
    """Literals become hyperparameters of model operations, parameters of imports."""
    near = graphs.with_ends(edges, state, "new_label").groupBy("nb_id", F.col("src").alias("node_id")).agg(F.bool_or(F.col("dst_new_label") == "MODEL_OPERATION").alias("__m"), F.bool_or(F.col("dst_new_label") == "DATA_IMPORT_EXTRACTION").alias("__i"))
    out = state.join(near, ["nb_id", "node_id"], "left")
    literal = F.col("node_type") == 8
    out = _set(out, "new_label", literal & F.col("__i"), "PARAMETER")
    return _set(_set(out, "new_type", literal & F.col("__m"), DOMAIN_NODE["HYPERPARAMETER"]), "hyper", literal & F.col("__m"), True).drop("__m", "__i")


def exclusion(state: DataFrame, edges: DataFrame) -> DataFrame:
    plain = F.col("node_type").isin(0, 4)
    out = _set(state, "new_type", plain & F.col("dataset"), DOMAIN_NODE["DATASET"])
    return _set(out, "new_type", plain & F.col("model") & F.col("new_type").isNull(), DOMAIN_NODE["MODEL"])


def simple_leakage(state: DataFrame, edges: DataFrame) -> DataFrame:
    """Model operations that a dataset of a test-like name reaches."""
    test = state.where(F.col("dataset") & has_token(F.col("node_id"), TEST_WORDS)).select("nb_id", "node_id")
    reach = graphs.reached(edges, test).unionByName(test)
    out = _marks(state, reach, "__r")
    return _set(out, "leak", F.col("__r") & (F.col("new_label") == "MODEL_OPERATION"), True).drop("__r")


def dead_code(state: DataFrame, edges: DataFrame) -> DataFrame:
    out = _marks(state, edges.select("nb_id", F.col("src").alias("node_id")), "__o")
    return _set(out, "dead", _hub() & ~F.col("__o") & (F.coalesce("new_label", F.lit("NOT_RELEVANT")) == "NOT_RELEVANT"), True).drop("__o")


def nothing(state: DataFrame, edges: DataFrame) -> DataFrame:
    return state


def leakage_analysis(state: DataFrame, edges: DataFrame) -> DataFrame:
    from .leakage import findings

    out = _marks(state, findings(state, edges).select("nb_id", F.col("node").alias("node_id")), "__l")
    return _set(out, "leak", F.col("__l"), True).drop("__l")


EXTRACTION = [base_truth, static_seeds]
PROPAGATION = [relevance, backward_source, backward_features, forward_datasets, forward_models, taint]
RESOLUTION = [evaluation, artifacts, literals, exclusion]
ANALYSIS = [simple_leakage, dead_code]
ALL = EXTRACTION + PROPAGATION + RESOLUTION + ANALYSIS
PRESETS: dict[str, list[Rule]] = {
    "default": ALL,
    "seeding": EXTRACTION,
    "empty": [nothing],
    "no_propagation": EXTRACTION + RESOLUTION + ANALYSIS,
    "no_resolution": EXTRACTION + PROPAGATION + ANALYSIS,
    "no_analysis": EXTRACTION + PROPAGATION + RESOLUTION,
    "extraction_and_propagation": EXTRACTION + PROPAGATION,
    "leakage": [r for r in ALL if r is not simple_leakage] + [leakage_analysis],
}


def write_back(state: DataFrame) -> DataFrame:
    """Updates applied: node_type, domain_node, domain_label, predicted_label, has_leakage, is_dead_code."""
    code = F.try_element_at(F.create_map(*(F.lit(x) for k, v in OPERATION.items() if v >= 0 for x in (k, v))), F.col("new_label"))
    return state.select(
        *(c for c in state.columns if c not in {"domain_node", "predicted_label", "node_type", "new_type", "new_label", "new_predicted", "leak", "dead"}),
        F.coalesce("new_type", "node_type").alias("node_type"),
        (F.coalesce("domain_node", F.lit(False)) | F.col("new_type").isNotNull()).alias("domain_node"),
        F.col("new_label").alias("domain_label"),
        F.coalesce("new_predicted", code, "predicted_label").alias("predicted_label"),
        F.col("leak").alias("has_leakage"),
        F.col("dead").alias("is_dead_code"),
    )


def refine(nodes: DataFrame, edges: DataFrame, preset: str = "default") -> DataFrame:
    """The rules of a preset in order, then write-back.

    The edges and each rule's state are written to the shared folder, so that a
    plan of twelve rules does not make its input many times over. A state stays
    until the next one stands, in columns, and a rule's shuffles with it: what is
    on disk at once is that of one rule.
    """
    state, edges, old = begin(nodes), kept(edges), []
    for rule in PRESETS[preset]:
        state = kept(rule(state, edges), *old)
        old = [state]
    return write_back(state)
