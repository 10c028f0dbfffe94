"""Cells to tables: one pass per notebook, after a shuffle on nb_id."""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import sanitize
from ..operators.shared import by_group, dealt
from .flow import Flow
from .symbols import Symbols, file_access

_REC = "rec string, nb_id {kind}, a string, b string, key string, ord long, kind int, label string, code string, count int, cell_id string, lineno int, col_offset int, end_lineno int, end_col_offset int, error string"


def parse(cells: DataFrame, inline: bool = True, compare_hubs: str = "in_only", skip_bad: bool = False) -> DataFrame:
    """Node, edge and error records of cells(nb_id, cell_id, document_index, source).

    A notebook with a cell that doesn't parse gives one error record, or is
    read without that cell. Write the result once; nodes(), edges() and errors() select from it.
    """
    kind = cells.schema["nb_id"].dataType.simpleString()
    schema = _REC.format(kind=kind)

    def per(nb, cells: list[tuple]) -> list[tuple]:
        flow = Flow(inline, compare_hubs)
        for _, cell_id, source in cells:
            try:
                flow.cell_source(cell_id, source or "")
            except (SyntaxError, ValueError, RecursionError) as e:
                if not skip_bad:
                    return [("error", nb, None, None, None, 0, None, None, None, None, cell_id, None, None, None, None, f"{type(e).__name__}: {e}")]
        out = [("node", nb, n, None, None, i, d["struct_type"], d["label"], d["code"], None, d["cell_id"], *[None] * 4, None) for i, (n, d) in enumerate(flow.graph.nodes.items())]
        return out + [("edge", nb, s, t, f"{s}_{t}_{label}", i, d["edge_type"], label, d["raw_code"], d["count"], d["cell_id"], *d["pos"], None) for i, ((s, t, label), d) in enumerate(flow.graph.edges.items()) if s in flow.graph.nodes and t in flow.graph.nodes]

    clean = cells.select("nb_id", "document_index", "cell_id", sanitize(F.col("source")).alias("source"))
    return by_group(clean, "nb_id", ["document_index"], per, schema)


def nodes(records: DataFrame) -> DataFrame:
    return records.where("rec = 'node'").select("nb_id", F.col("a").alias("node_id"), "ord", "label", F.col("kind").alias("struct_type"), F.lit(None).cast("int").alias("domain_type"), F.lit(False).alias("domain_node"), "cell_id", "code")


def edges(records: DataFrame) -> DataFrame:
    return records.where("rec = 'edge'").select("nb_id", F.col("a").alias("src"), F.col("b").alias("dst"), "key", "ord", F.col("kind").alias("edge_type"), "label", F.col("code").alias("raw_code"), "count", "cell_id", "lineno", "col_offset", "end_lineno", "end_col_offset")


def errors(records: DataFrame) -> DataFrame:
    return records.where("rec = 'error'").select("nb_id", "cell_id", "error")


def _map(cells: DataFrame, fields: str, of):
    """Rows that of(source) gives for each cell, beside nb_id and cell_id."""
    kind = cells.schema["nb_id"].dataType.simpleString()
    types = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    cols = [f.strip().split(" ") for f in fields.split(",")]

    def run(batches):
        for b in batches:
            rows = [(n, c, *r) for n, c, s in zip(*(b.column(x).to_pylist() for x in ("nb_id", "cell_id", "source")), strict=True) for r in of(s or "")]
            data = list(zip(*rows, strict=True)) if rows else [[]] * (len(cols) + 2)
            yield pa.RecordBatch.from_arrays([pa.array(data[0], b.schema.field("nb_id").type), pa.array(data[1], pa.string()), *(pa.array(d, types[t]) for d, (_, t) in zip(data[2:], cols, strict=True))], names=["nb_id", "cell_id", *(c for c, _ in cols)])

    return dealt(cells.select("nb_id", "cell_id", sanitize(F.col("source")).alias("source")), "nb_id", "cell_id").mapInArrow(run, f"nb_id {kind}, cell_id string, {fields}")


def symbols(cells: DataFrame, keep: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(defs, uses, (nb_id, cell_id, parse_error)) from one pass over the cells; `keep` writes it once to the shared folder."""

    def of(source: str):
        s = Symbols(source)
        rows = [("cell", None, "bad" if s.parse_error else "good", None, None, None)]
        rows += [("def", n, k, line, None, None) for n, (k, line) in s.defs.items()]
        return rows + [("use", n, None, *u) for n, u in s.uses.items()]

    got = _map(cells, "rec string, name string, kind string, lineno int, deferred boolean, via string", of)
    got = got.checkpoint() if keep else got
    return (
        got.where("rec = 'def'").select("nb_id", "cell_id", "name", "kind", "lineno"),
        got.where("rec = 'use'").select("nb_id", "cell_id", "name", "lineno", "deferred", "via"),
        got.where("rec = 'cell'").select("nb_id", "cell_id", (F.col("kind") == "bad").alias("parse_error")),
    )


def file_io(cells: DataFrame) -> DataFrame:
    return _map(cells, "path string, mode string, lineno int", file_access)


def ast_nodes(cells: DataFrame) -> DataFrame:
    """(nb_id, cell_id, node int, parent int, type, lineno): the syntax tree of each cell that parses, in preorder."""

    def of(source: str):
        try:
            tree = ast.parse(source)
        except (SyntaxError, ValueError):
            return []
        out, todo = [], [(tree, -1)]
        while todo:
            node, parent = todo.pop()
            me = len(out)
            out.append((me, parent, type(node).__name__, getattr(node, "lineno", -1)))
            todo.extend((c, me) for c in reversed(list(ast.iter_child_nodes(node))))
        return out

    return _map(cells, "node int, parent int, type string, lineno int", of)


def parses(cells: DataFrame) -> DataFrame:
    """Cells whose source parses."""
    good = symbols(cells)[2].where("not parse_error").select("nb_id", "cell_id")
    return cells.join(good, ["nb_id", "cell_id"], "left_semi")


def leaf_paths(cells: DataFrame, most: int = 5) -> DataFrame:
    """(nb_id, cell_id, a int, b int, path string): ways between leaves of a cell's syntax tree of `most` edges at most, as types joined by '/'."""

    def of(source: str):
        try:
            tree = ast.parse(source)
        except (SyntaxError, ValueError):
            return []
        kinds, links, leaves = [], [], []
        todo = [(tree, -1)]
        while todo:
            node, parent = todo.pop()
            me = len(kinds)
            kinds.append(type(node).__name__)
            links.append([parent] if parent >= 0 else [])
            if parent >= 0:
                links[parent].append(me)
            below = list(ast.iter_child_nodes(node))
            if not below:
                leaves.append(me)
            todo.extend((c, me) for c in reversed(below))
        out, ends = [], set(leaves)
        for a in leaves:
            ways = [[a]]
            while ways:
                way = ways.pop()
                if len(way) > 1 and way[-1] in ends and way[-1] > a:
                    out.append((a, way[-1], "/".join(kinds[i] for i in way)))
                if len(way) <= most:
                    ways += [[*way, n] for n in links[way[-1]] if n not in way]
        return out

    return _map(cells, "a int, b int, path string", of)
