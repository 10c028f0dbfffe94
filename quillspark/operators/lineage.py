"""Lineage projection to dataset and model anchors, and lineage tuples."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import graphs
from .shared import tasks

_ANCHORS = (1, 2, 4, 7)


def anchors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Anchor nodes (library, dataset, domain model, class) with occurrences: their own cell, then those of consuming successors."""
    keep = F.col("node_type").isin(*_ANCHORS) & ((F.col("node_type") != 4) | F.coalesce("domain_node", F.lit(False)))
    # joins and groups follow the tasks that one side is dealt to, which grow in number with the nodes
    parts = tasks(nodes)
    ends = nodes.where("node_type in (9, 4) and cell_id is not null").select("nb_id", F.col("node_id").alias("dst"), F.col("cell_id").alias("dst_cell_id"))
    first = edges.join(ends.repartition(parts, "nb_id", "dst"), ["nb_id", "dst"]).groupBy("nb_id", "src", "dst", "dst_cell_id").agg(F.min("ord").alias("o"))
    near = first.repartition(parts, "nb_id", "src").groupBy("nb_id", F.col("src").alias("node_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "dst_cell_id"))), lambda x: x["dst_cell_id"]).alias("__c"))
    own = nodes.where(keep).join(near, ["nb_id", "node_id"], "left")
    return own.withColumn("occurrences", F.concat(F.array("cell_id"), F.coalesce("__c", F.array().cast("array<string>")))).drop("__c")


def route(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(nb_id, src, dst, operations, predicted_label): anchors that a walk through other nodes joins.

    A breadth-first walk from each anchor in the order of edges; operations are
    the hubs' code on the way and the target's label; the label is that of the
    target's first hub, 2 without one. The last way found to a target stands.
    """
    kind = nodes.schema["nb_id"].dataType.simpleString()
    n = nodes.select("nb_id", F.lit(None).cast("string").alias("src"), F.col("node_id").alias("dst"), F.col("ord").cast("long").alias("ord"), "node_type", F.coalesce("domain_node", F.lit(False)).alias("domain_node"), "code", "label", "predicted_label")
    e = edges.select("nb_id", "src", "dst", F.col("ord").cast("long").alias("ord"), F.lit(None).cast("int").alias("node_type"), F.lit(None).cast("boolean").alias("domain_node"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("int").alias("predicted_label"))

    def per(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        at = {r["dst"]: r for r in sorted((r for r in rows if r["src"] is None), key=lambda r: r["ord"])}
        out: dict = {}
        before: dict = {}
        for r in sorted((r for r in rows if r["src"] is not None), key=lambda r: r["ord"]):
            out.setdefault(r["src"], {})[r["dst"]] = None
            before.setdefault(r["dst"], {})[r["src"]] = None
        anchor = {k for k, r in at.items() if r["node_type"] in _ANCHORS and (r["node_type"] != 4 or r["domain_node"])}
        found: dict = {}
        for start in (k for k in at if k in anchor):
            walk, seen = [(start, ())], set()
            for here, path in walk:
                for to in out.get(here, ()):
                    if to in seen or to not in at:
                        continue
                    if at[to]["node_type"] == 9:
                        seen.add(to)
                        step = at[to]["code"] if at[to]["code"] is not None else at[to]["label"]
                        walk.append((to, (*path, str(step)) if step else path))
                    elif to in anchor:
                        hub = next((p for p in before.get(to, ()) if p in at and at[p]["node_type"] == 9), None)
                        label = 2 if hub is None else 2 if at[hub]["predicted_label"] is None else at[hub]["predicted_label"]
                        found[start, to] = ((*path, at[to]["label"] or to), label)
                    else:
                        seen.add(to)
                        walk.append((to, path))
        nb = pa.array([table["nb_id"][0].as_py()] * len(found), table.schema.field("nb_id").type)
        return pa.table([nb, pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array([list(v[0]) for v in found.values()], pa.list_(pa.string())), pa.array([v[1] for v in found.values()], pa.int32())], names=["nb_id", "src", "dst", "operations", "predicted_label"])

    return n.unionByName(e).groupBy("nb_id").applyInArrow(per, f"nb_id {kind}, src string, dst string, operations array<string>, predicted_label int")


def fold_auxiliary(macro_nodes: DataFrame, macro_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Primary anchors with base_inputs from the library and class anchors before them, and the edges among primary anchors."""
    macro_nodes = macro_nodes.repartition(tasks(macro_nodes, macro_edges), "nb_id", "node_id")
    e = graphs.with_ends(macro_edges, macro_nodes, "node_type", "label")
    text = F.array_join(F.filter("operations", lambda x: x != ""), " -> ")
    library = F.col("src_node_type") == 1
    value = F.when(library & (text != ""), F.concat_ws(".", "src_label", text)).otherwise(F.coalesce(F.nullif(text, F.lit("")), "src_label"))
    value = F.when(library, value).otherwise(F.concat(F.lit('"'), value, F.lit('"')))
    aux = e.where("src_node_type in (1, 7) and dst_node_type in (2, 4)").groupBy("nb_id", F.col("dst").alias("node_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.when(library, 0).otherwise(1).alias("w"), value.alias("v")))), lambda x: x["v"]).alias("base_inputs"))
    primary = macro_nodes.where("node_type in (2, 4)").join(aux, ["nb_id", "node_id"], "left").withColumn("base_inputs", F.coalesce("base_inputs", F.array().cast("array<string>")))
    return primary, e.where("src_node_type in (2, 4) and dst_node_type in (2, 4)").select(macro_edges.columns)


def chains(macro_nodes: DataFrame, macro_edges: DataFrame, parts: int | None = None) -> DataFrame:
    """(nb_id, node_id, head, step): datasets on linear chains, each with the chain's head and its place behind it.

    A link joins a dataset with its only dataset successor if that has no
    other dataset predecessor; a circle's head is its least node.
    """
    kind = macro_nodes.schema["nb_id"].dataType.simpleString()
    parts = parts or tasks(macro_nodes, macro_edges)
    d = graphs.with_ends(macro_edges, macro_nodes, "node_type").where("src_node_type = 2 and dst_node_type = 2").select("nb_id", "src", "dst").distinct()
    d = d.repartition(parts, "nb_id").withColumn("o", F.count("*").over(Window.partitionBy("nb_id", "src"))).withColumn("i", F.count("*").over(Window.partitionBy("nb_id", "dst")))
    links = d.where("o = 1 and i = 1 and src <> dst").select("nb_id", "src", "dst")
    rows = macro_nodes.where("node_type = 2").select("nb_id", F.col("node_id").alias("src"), F.lit(None).cast("string").alias("dst")).repartition(parts, "nb_id").unionByName(links)

    def per(table: pa.Table) -> pa.Table:
        nexts = {a: b for a, b in zip(table["src"].to_pylist(), table["dst"].to_pylist(), strict=True) if b is not None}
        names = sorted(set(table["src"].to_pylist()))
        has = set(nexts.values())
        head: dict = {}
        for start in [n for n in names if n not in has] + names:
            here, step = start, 0
            while here is not None and here not in head:
                head[here] = (start, step)
                here, step = nexts.get(here), step + 1
        nb = pa.array([table["nb_id"][0].as_py()] * len(head), table.schema.field("nb_id").type)
        return pa.table([nb, pa.array(list(head), pa.string()), pa.array([v[0] for v in head.values()], pa.string()), pa.array([v[1] for v in head.values()], pa.int64())], names=["nb_id", "node_id", "head", "step"])

    return rows.groupBy("nb_id").applyInArrow(per, f"nb_id {kind}, node_id string, head string, step long")


def collapse(macro_nodes: DataFrame, macro_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chains merged into their heads: nodes with transform_history and occurrences in the chain's order, and edges from and to heads."""
    parts = tasks(macro_nodes, macro_edges)
    by = lambda df, *keys: df.repartition(parts, "nb_id", *keys)
    macro_nodes = by(macro_nodes, "node_id")
    c = by(chains(macro_nodes, macro_edges, parts).checkpoint(), "node_id")
    link = by(macro_edges.join(c.select("nb_id", F.col("node_id").alias("dst"), F.col("head").alias("h"), "step"), ["nb_id", "dst"]), "src", "h").join(c.select("nb_id", F.col("node_id").alias("src"), F.col("head").alias("h"), F.col("step").alias("s0")), ["nb_id", "src", "h"]).where("step = s0 + 1")
    labels = macro_nodes.select("nb_id", F.col("node_id").alias("dst"), F.col("label").alias("dst_label"), "base_inputs")
    text = F.coalesce(F.nullif(F.array_join(F.filter("operations", lambda x: x != ""), " -> "), F.lit("")), F.lit("Transform"))
    more = F.when(F.size("base_inputs") > 0, F.concat(F.lit(" [Inputs: "), F.array_join("base_inputs", ", "), F.lit("]"))).otherwise("")
    step = by(link.join(labels, ["nb_id", "dst"]).where("predicted_label = 2"), "h").groupBy("nb_id", F.col("h").alias("node_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("step", F.struct(F.col("dst_label").alias("target_node"), F.concat(text, more).alias("operation"), F.lit("").alias("transform_code")).alias("t")))), lambda x: x["t"]).alias("transform_history"))
    seen = by(macro_nodes.join(c, ["nb_id", "node_id"]), "head").groupBy("nb_id", "head").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("step", "occurrences"))), lambda x: x["occurrences"])).alias("occurrences"))
    heads = macro_nodes.where("node_type = 4").unionByName(macro_nodes.join(c.where("step = 0").select("nb_id", "node_id"), ["nb_id", "node_id"], "left_semi")).drop("occurrences") if "occurrences" in macro_nodes.columns else macro_nodes
    nodes = heads.join(step, ["nb_id", "node_id"], "left").join(seen.withColumnRenamed("head", "node_id"), ["nb_id", "node_id"], "left")
    to_head = c.select("nb_id", F.col("node_id").alias("n"), "head")
    e = macro_edges.join(to_head.withColumnRenamed("n", "src").withColumnRenamed("head", "a"), ["nb_id", "src"], "left").join(to_head.withColumnRenamed("n", "dst").withColumnRenamed("head", "b"), ["nb_id", "dst"], "left")
    e = e.select("nb_id", F.coalesce("a", "src").alias("src"), F.coalesce("b", "dst").alias("dst"), "operations", "predicted_label")
    inner = link.select("nb_id", F.col("h").alias("src"), F.col("h").alias("dst")).distinct()
    return nodes, by(e, "src", "dst").join(inner, ["nb_id", "src", "dst"], "left_anti").dropDuplicates(["nb_id", "src", "dst"])


def tuples(macro_nodes: DataFrame, macro_edges: DataFrame) -> DataFrame:
    """(nb_id, tuple_type, subject_id, object_id): <D, D>, <M, D> in either direction, <D, Empty> for datasets that nothing else takes."""
    e = graphs.with_ends(macro_edges.select("nb_id", "src", "dst").where("src <> dst"), macro_nodes, "node_type")
    dd = e.where("src_node_type = 2 and dst_node_type = 2").select("nb_id", F.lit("<D, D>").alias("tuple_type"), F.col("src").alias("subject_id"), F.col("dst").alias("object_id"))
    dm = e.where("src_node_type = 2 and dst_node_type = 4").select("nb_id", F.lit("<M, D>").alias("tuple_type"), F.col("dst").alias("subject_id"), F.col("src").alias("object_id"))
    md = e.where("src_node_type = 4 and dst_node_type = 2").select("nb_id", F.lit("<M, D>").alias("tuple_type"), F.col("src").alias("subject_id"), F.col("dst").alias("object_id"))
    used = macro_edges.where("src <> dst").select("nb_id", F.col("src").alias("node_id"))
    empty = macro_nodes.where("node_type = 2").join(used, ["nb_id", "node_id"], "left_anti").select("nb_id", F.lit("<D, Empty>").alias("tuple_type"), F.col("node_id").alias("subject_id"), F.lit("Empty").alias("object_id"))
    return dd.unionByName(dm).unionByName(md).unionByName(empty).distinct()


def gold_tuples(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Tuples of an annotated graph: roots are ends of import edges that descend from no other root; each is traced to exports and models."""
    roots = edges.where("label = 1").select("nb_id", F.col("dst").alias("node_id")).distinct()
    ends = edges.where("label in (0, 4)").select("nb_id", F.col("dst").alias("end"), F.when(F.col("label") == 0, "<M, D>").otherwise("<D, D>").alias("tuple_type")).distinct()
    # only ends leave the walk, each once for a root: no rows of all that roots reach are sorted or compared
    own = graphs.first_walks(edges, roots, ends.select("nb_id", F.col("end").alias("node_id"))).select("nb_id", F.col("seed").alias("src"), F.col("node_id").alias("dst"))
    hit = own.where("src <> dst").join(ends.withColumnRenamed("end", "dst"), ["nb_id", "dst"])
    found = hit.select("nb_id", "tuple_type", F.when(F.col("tuple_type") == "<M, D>", F.col("dst")).otherwise(F.col("src")).alias("subject_id"), F.when(F.col("tuple_type") == "<M, D>", F.col("src")).otherwise(F.col("dst")).alias("object_id"))
    alone = own.where("src = dst").select("nb_id", F.lit("<D, Empty>").alias("tuple_type"), F.col("src").alias("subject_id"), F.lit("Empty").alias("object_id"))
    return found.unionByName(alone)


def normalize_tuples(raw: DataFrame) -> DataFrame:
    """Posted tuples that name a known type and both ends, <D, Empty> with object Empty, without repeats."""
    t = raw.where("tuple_type in ('<D, D>', '<M, D>', '<D, Empty>') and coalesce(trim(subject_id), '') <> ''")
    t = t.withColumn("object_id", F.when(F.col("tuple_type") == "<D, Empty>", "Empty").otherwise(F.col("object_id")))
    return t.where("coalesce(trim(object_id), '') <> ''").dropDuplicates(["nb_id", "tuple_type", "subject_id", "object_id"])


def project(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Anchors, routes, folding and collapse in one; each step's small tables are written once to the shared folder."""
    macro, ways = fold_auxiliary(anchors(nodes, edges).checkpoint(), route(nodes, edges).checkpoint())
    return collapse(macro.checkpoint(), ways.checkpoint())


def write_tuples(found: DataFrame, path: str) -> None:
    found.write.partitionBy("nb_id").mode("overwrite").option("header", True).csv(path)
