import json

from pyspark.sql import functions as F

from quillspark.ir import build
from quillspark.operators import metrics
from quillspark.sources import notebooks as N


def write(path, name, cells):
    (path / name).write_text(json.dumps({"nbformat": 4, "cells": cells}))


def test_notebooks(spark, tmp_path):
    write(tmp_path, "a.ipynb", [{"cell_type": "markdown", "source": "# t"}, {"cell_type": "code", "id": "k1", "source": ["x = 1\n", "y = x"], "execution_count": 2}, {"cell_type": "code", "source": "z = y", "execution_count": 1}, {"cell_type": "code", "id": "e", "source": "  "}, {"cell_type": "code", "id": "n", "source": "w = 1", "execution_count": None}])
    (tmp_path / "bad.ipynb").write_text("{")
    (tmp_path / "s.py").write_text("q = 3\n")
    cells = N.scan(spark, str(tmp_path))
    assert {r.nb_id for r in cells.collect()} == {"a.ipynb"} and cells.count() == 5
    all_ = N.code_cells(cells)
    assert [(r.cell_id, r.source) for r in all_.orderBy("rank").collect()] == [("k1", "x = 1\ny = x"), ("fallback-2", "z = y"), ("n", "w = 1")]
    ran = N.code_cells(cells, greedy=False)
    assert [r.cell_id for r in ran.orderBy("rank").collect()] == ["fallback-2", "k1"]
    assert [(r.src, r.dst) for r in N.execution_graph(ran).collect()] == [("fallback-2", "k1")]
    code = N.notebook_code(all_).first()
    assert (code.code, code.loc) == ("x = 1\ny = x\nz = y\nw = 1", 4)
    assert sorted(len(r.sources) for r in N.windows(all_, 2).collect()) == [2, 2]
    assert N.scripts(spark, str(tmp_path)).first().source == "q = 3\n"
    assert build.nodes(build.parse(all_)).where("label = 'z'").count() == 1
    assert N.folders(spark, str(tmp_path)).selectExpr("sum(n_notebooks) as n").first().n == 2


def test_elements(spark, tmp_path):
    body = [{"data": {"id": "a", "label": "A", "node_type": 0, "ui": 1}}, {"data": {"id": "b", "label": "B", "node_type": 9}}, {"data": {"source": "a", "target": "b", "edge_type": 1, "label": "in"}}, {"data": {"source": "a", "target": "ghost"}}]
    p = spark.createDataFrame([("n", json.dumps({"elements": body})), ("m", json.dumps(body)), ("x", "nothing")], "nb_id string, payload string")
    nodes, edges = N.elements(p)
    assert {(r.nb_id, r.node_id) for r in nodes.collect()} == {(nb, i) for nb in "nm" for i in "ab"}
    assert {(r.nb_id, r.src, r.dst, r.domain_label) for r in edges.collect()} == {(nb, "a", "b", "NOT_RELEVANT") for nb in "nm"}
    again = N.to_elements(nodes.select("nb_id", "node_id", "ord", "label", "node_type"), edges.select("nb_id", "src", "dst", "ord", "edge_type"))
    n2, e2 = N.elements(again)
    assert n2.count() == 4 and e2.count() == 2
    assert metrics.edge_audit(edges, e2).first().asDict() == {"both": 2, "missing": 0, "extra": 0}
    full = edges.withColumn("raw_code", F.lit("c"))
    N.save_graph(nodes, full, str(tmp_path / "g"))
    assert N.load_graph(spark, str(tmp_path / "g"))[0].count() == 4
    g = spark.createDataFrame([("n", json.dumps({"elements": [{"group": "nodes", "data": {"id": "a"}}, {"group": "nodes", "data": {"id": "b"}}, {"group": "edges", "data": {"source": "a", "target": "b"}}]}))], "nb_id string, payload string")
    gn, ge = N.grouped_elements(g)
    assert {(r["node_id"], r["index"]) for r in gn.collect()} == {("a", 0), ("b", 1)} and ge.count() == 1


def test_corpora(spark):
    nb = lambda *k: spark.createDataFrame([(x,) for x in k], "nb_id string")
    a, b = N.combined(one=(nb("x", "y"), nb("x")), two=(nb("x"), nb("x", "z")))
    assert {r.nb_id for r in a.collect()} == {r.nb_id for r in b.collect()} == {"one__x", "two__x"}
    assert [r.nb_id for r in N.pending(nb("x", "y"), nb("x")).collect()] == ["y"]
    found = spark.createDataFrame([("r", "p"), ("r", "p"), ("r", "q")], "repo string, path string")
    assert N.registry(found).first().paths == ["p", "q"]


def test_checked_elements(spark):
    """Payloads of every shape: none is lost, and each fault has its name."""
    from quillspark.sources.notebooks import checked_elements

    whole = '{"zoom":1,"elements":[{"data":{"id":"a","label":"x","node_type":3,"id2":{"id":"no"}},"position":{"x":1}},{"data":{"id":7,"node_type":"call"}},{"data":{"source":"a","target":7}},{"data":{"source":"a"}},{"data":{}},{"data":[1]},"note",null,{"group":"nodes"}]}'
    rows = [(1, whole), (2, '[{"data":{"id":"b"}}]'), (3, '{"elements":[]}'), (4, "{broken"), (5, None), (6, '{"elements":{"id":"a"}}'), (7, "3"), (8, "")]
    got = checked_elements(spark.createDataFrame(rows, "nb_id long, payload string")).collect()
    assert sorted(((r.nb_id, r.ord, r.kind, r.id, r.source, r.target, r.label, r.node_type, r.error) for r in got), key=lambda r: (r[0], r[1] or 0)) == [
        (1, 0, "node", "a", None, None, "x", 3, None),
        (1, 1, "node", "7", None, None, None, None, "type"),
        (1, 2, "edge", None, "a", "7", None, None, None),
        (1, 3, "edge", None, "a", None, None, None, "end"),
        (1, 4, "node", None, None, None, None, None, "id"),
        *((1, i, None, None, None, None, None, None, "element") for i in (5, 6, 7, 8)),
        (2, 0, "node", "b", None, None, None, None, None),
        *((i, None, None, None, None, None, None, None, "payload") for i in (4, 5, 6, 7, 8)),
    ]
    assert checked_elements(spark.createDataFrame([], "nb_id long, payload string")).count() == 0
