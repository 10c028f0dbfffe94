"""The calls of the service, as functions of cells that return DataFrames.

cells: (nb_id, cell_id, document_index, source, execution_count, is_dirty).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ir import build
from ..operators import cells as C
from ..operators import graphs, labelers, leakage, lineage, mining, refine
from ..operators import trace as T
from ..operators.shared import checkpoints
from ..taxonomy import taxonomy


def constants(spark) -> DataFrame:
    return taxonomy(spark)


def syntax_tree(cells: DataFrame) -> DataFrame:
    return build.ast_nodes(cells)


def _graph(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    checkpoints(cells.sparkSession)
    records = build.parse(cells).checkpoint()
    nodes, edges = build.nodes(records), graphs.drop_redundant(graphs.bypass_branches(build.nodes(records), build.edges(records)))
    return graphs.drop_isolated(nodes, edges), edges


def dataflow(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) without import-only ends, with provenance."""
    nodes, edges = _graph(cells)
    nodes = graphs.drop_import_ends(nodes, edges)
    return graphs.provenance(nodes, edges), edges.join(nodes.select("nb_id", F.col("node_id").alias("src")), ["nb_id", "src"], "left_semi").join(nodes.select("nb_id", F.col("node_id").alias("dst")), ["nb_id", "dst"], "left_semi")


def labelled(cells: DataFrame, make_client=labelers.rule_client, preset: str = "default") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges), operations labelled and refined."""
    nodes, edges = _graph(cells)
    calls = labelers.label_by_code(nodes, make_client).select("nb_id", "node_id", "predicted_label")
    state = nodes.join(calls, ["nb_id", "node_id"], "left").withColumn("runner_up", F.lit(None).cast("int")).withColumn("confidence", F.lit(None).cast("double")).withColumn("margin", F.lit(None).cast("double"))
    return refine.refine(state, edges, preset), edges


def lineage_of(cells: DataFrame, make_client=labelers.rule_client) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(macro nodes, macro edges, tuples)."""
    nodes, edges = labelled(cells, make_client)
    nodes = nodes.checkpoint()
    macro, ways = lineage.project(nodes, edges)
    macro = macro.checkpoint()
    ways = ways.checkpoint()
    return macro, ways, lineage.tuples(macro, ways)


def leaks(cells: DataFrame) -> DataFrame:
    nodes, edges = _graph(cells)
    return leakage.findings(nodes.withColumn("node_type", F.col("struct_type")), edges)


def environment(cells: DataFrame) -> DataFrame:
    """(nb_id, roots, n_imports, complexity counts)."""
    return mining.import_summary(mining.imports(cells)).join(mining.complexity(cells), "nb_id", "full")


def cell_graph(cells: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells with attributes, edges, undefined uses) of cells that aren't blank, numbered anew."""
    from pyspark.sql import Window

    c = cells.where(F.trim(F.regexp_replace("source", r"\s", "")) != "").withColumn("document_index", F.row_number().over(Window.partitionBy("nb_id").orderBy("document_index")) - 1)
    checkpoints(cells.sparkSession)
    defs, uses, bad = build.symbols(c, keep=True)
    c = C.attributes(c, defs, uses).join(bad, ["nb_id", "cell_id"]).checkpoint()
    return c, C.cell_edges(c, defs, uses, build.file_io(c)).checkpoint(), C.undefined(c, defs, uses).checkpoint()


def execution_state(cells: DataFrame) -> DataFrame:
    """(nb_id, cell_id, rank, confidence, status, hidden_state_risk, unsafe_reorder)."""
    c, edges, undefined = cell_graph(cells)
    kept, dropped = C.break_cycles(c, edges)
    kept, dropped = kept.checkpoint(), dropped.checkpoint()
    unknown = dropped.select("nb_id", F.explode(F.array("src_cell", "dst_cell")).alias("cell_id"))
    return C.predict_order(c, kept).join(C.cell_states(c, kept, undefined, unknown), ["nb_id", "cell_id"])


def trace_analysis(cells: DataFrame, events: DataFrame) -> DataFrame:
    """Events with rerun_kind, out_of_doc_order and stale_input_names."""
    _, edges, _ = cell_graph(cells)
    return T.stale_inputs(T.out_of_order(T.rerun_kinds(events)), edges)
