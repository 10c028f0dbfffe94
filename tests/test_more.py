import pytest
from pyspark.sql import functions as F

from quillspark.ir import build
from quillspark.operators import cells, graphs, leakage


def test_filter_relevant(spark):
    n = spark.createDataFrame([("n", x, i, t) for i, (x, t) in enumerate([("imp", 1), ("end", 0), ("load", 9), ("d", 0), ("show", 9), ("e", 0), ("far", 0), ("off", 0)])], "nb_id string, node_id string, ord long, struct_type int")
    e = spark.createDataFrame([("n", "imp", "end", 0, 5), ("n", "imp", "load", 1, 5), ("n", "load", "d", 2, 1), ("n", "d", "show", 3, 3), ("n", "show", "e", 4, 5), ("n", "d", "e", 5, 2), ("n", "far", "off", 6, 2)], "nb_id string, src string, dst string, ord long, predicted_label int")
    plain, _ = graphs.filter_relevant(n, e)
    assert {r.node_id for r in plain.collect()} == {"imp", "load", "d", "show", "e", "far", "off"}
    left, ways = graphs.filter_relevant(n, e, lineage=True)
    assert {r.node_id: r.struct_type for r in left.collect()} == {"imp": 1, "load": 9, "d": 2, "e": 2}
    assert {(r.src, r.dst) for r in ways.collect()} == {("imp", "load"), ("load", "d"), ("d", "e")}


def test_rebind(spark):
    e = spark.createDataFrame([("n", "a", "d", "x", True, ["a", "b"]), ("n", "a", "c", "y", False, ["a"])], "nb_id string, src_cell string, dst_cell string, name string, ambiguous boolean, candidate_def_cells array<string>")
    order = spark.createDataFrame([("n", c, i) for i, c in enumerate("abdc")], "nb_id string, cell_id string, rank int")
    assert {(r.src_cell, r.dst_cell) for r in cells.rebind(e, order).collect()} == {("b", "d"), ("a", "c")}
    scored = spark.createDataFrame([("n", "a", "b", 0.9), ("n", "b", "a", 0.1)], "nb_id string, a string, b string, score double")
    assert [r.cell_id for r in cells.learned_order(scored).orderBy("rank").collect()] == ["a", "b"]


def test_overlay(spark):
    f = spark.createDataFrame([("n", "h", "test_in_train"), ("n", "k", "clean")], "nb_id string, node string, leakage_class string")
    g = spark.createDataFrame([("n", "h", "uncertain")], "nb_id string, node string, leakage_class string")
    assert {(r.node, r.leakage_class, r.from_gold) for r in leakage.overlay(f, g).collect()} == {("h", "uncertain", True), ("k", "clean", False)}


def test_leaf_paths(spark):
    d = spark.createDataFrame([("n", "c", 0, "x = 1")], "nb_id string, cell_id string, document_index int, source string")
    paths = {r.path for r in build.leaf_paths(d).collect()}
    assert "Store/Name/Assign/Constant" in paths
    assert build.leaf_paths(d, 2).count() == 0
    assert build.ast_nodes(d).where(F.col("type") == "Constant").count() == 1


def test_validation_and_flags(spark):
    from quillspark.operators import mining

    rows = [("a", "c0", 0, "import Torch as t\nm.fit(x)\n"), ("a", "c1", 1, "  "), ("b", "c0", 0, "x = ("), ("c", "c0", 0, " \n"), ("d", "c0", 0, None)]
    got = {r.nb_id: r for r in mining.validate(spark.createDataFrame(rows, "nb_id string, cell_id string, document_index int, source string"), ["torch", "keras"]).collect()}
    assert (got["a"].success, got["a"].lines_of_code, got["a"].contains_ml_semantics, got["a"].matched_libraries) == (True, 2, True, ["torch"]) and got["a"].node_count > 0
    assert (got["b"].success, got["b"].error_type, got["b"].node_count) == (False, "SyntaxError", 0)
    assert got["c"].error_type == got["d"].error_type == "EmptyNotebook"
    old = spark.createDataFrame([("x", "needs_review"), ("y", "not_relevant")], "notebook string, flag string")
    new = spark.createDataFrame([("y", None, 2), ("z", "needs_review", 1), ("y", "needs_review", 1)], "notebook string, flag string, ord int")
    assert {tuple(r) for r in mining.flag(old, new).collect()} == {("x", "needs_review"), ("z", "needs_review")}
    with pytest.raises(Exception, match="no such flag"):
        mining.flag(old, spark.createDataFrame([("q", "odd", 1)], "notebook string, flag string, ord int")).collect()


def test_walks(spark):
    """Walks from seeds and the closure against plain search on random graphs with cycles; a long chain in one notebook."""
    import random

    from quillspark.operators import graphs

    r = random.Random(3)
    edges = {(k, f"n{r.randrange(12)}", f"n{r.randrange(12)}") for k in range(6) for _ in range(14)}
    e = spark.createDataFrame(list(edges), "nb_id long, src string, dst string")

    def reach(k, a, back=False):
        out, todo = set(), [a]
        for v in todo:
            for n, s, d in edges:
                s, d = (d, s) if back else (s, d)
                if n == k and s == v and d not in out:
                    out.add(d)
                    todo.append(d)
        return out

    names = {(k, x) for k, s, d in edges for x in (s, d)}
    assert {tuple(x) for x in graphs.closure(e).collect()} == {(k, a, b) for k, a in names for b in reach(k, a)}
    seeds = [(k, "n3") for k in range(6)] + [(0, "n5"), (9, "n1")]
    s = spark.createDataFrame(seeds, "nb_id long, node_id string")
    for back in (False, True):
        assert {tuple(x) for x in graphs.walks(e, s, back).collect()} == {(k, a, b) for k, a in seeds for b in reach(k, a, back)}
        assert {tuple(x) for x in graphs.reached(e, s, back).collect()} == {(k, b) for k, a in seeds for b in reach(k, a, back)}
    n = 50_000
    chain = spark.range(n).select(F.lit(1).cast("long").alias("nb_id"), F.concat(F.lit("v"), "id").alias("src"), F.concat(F.lit("v"), F.col("id") + 1).alias("dst"))
    assert graphs.reached(chain, spark.createDataFrame([(1, "v0")], "nb_id long, node_id string")).count() == n


def test_hash_ranks(spark):
    from quillspark.operators.shared import hash_ranked

    d = spark.range(3000).select("id", (F.col("id") % 3 == 0).alias("g"))
    got = hash_ranked(d, F.col("g"), "id", 1, "r").collect()
    assert sorted(x.r for x in got if x.g) == list(range(1000)) and sorted(x.r for x in got if not x.g) == list(range(2000))


def test_next_item(spark):
    from quillspark.operators import mining

    names = [f"i{k:03d}" for k in range(50)]
    items = spark.createDataFrame([(x,) for x in names], "item string").repartition(4)
    gone = items.where("item like '%3'")
    left = [x for x in names if not x.endswith("3")]
    got = dict(mining.next_item(items, gone, items).collect())
    assert got == {x: left[(left.index(x) + 1) % len(left)] if x in left else left[0] for x in names}


def test_task_chains_with_other_operands():
    import ast

    from quillspark.ir import rewrite

    for source in ("a >> f(b)", "a >> (b, c)", "a >> []"):
        tree = rewrite.rewritten(ast.parse(f"from airflow import DAG\n{source}\n"), {})
        assert ast.unparse(tree).endswith(ast.unparse(ast.parse(source)))


def test_deep_callee(spark):
    from quillspark.functions import text

    deep = "f(" + "g(" * 15 + ")" * 15 + ").h(1)"
    assert spark.createDataFrame([(deep,)], "c string").select(text.leaf_callee(F.col("c"))).first()[0] == "h"


def test_scopes():
    from quillspark.ir.symbols import Symbols

    s = Symbols("class A(B):\n  k = 1\n  j = k + c\n  def m(self):\n    return h(self, [v for v in w])\ntry:\n  t()\nexcept E as e:\n  pass\nwith o() as u: pass\nlambda q: q + r\n")
    assert set(s.defs) == {"A", "e", "u"} and {n for n, x in s.uses.items() if not x[1]} == {"B", "c", "t", "E", "o"}
    assert {n: x[2] for n, x in s.uses.items() if x[1]} == {"h": "m", "w": "m", "r": None}
