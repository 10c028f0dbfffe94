import pytest

from quillspark.ir import build, flow, programs, rewrite
from quillspark.ir.symbols import Symbols, file_access
from quillspark.operators import leakage
from quillspark.operators.shared import checkpoints


def edges_of(source, **options):
    f = flow.Flow(**options)
    f.cell_source("abcd1234", source)
    return f.graph, {(s, d): (v["edge_type"], k) for (s, d, k), v in f.graph.edges.items()}


def test_assignments_and_calls():
    g, e = edges_of("import pandas as pd\ndf = pd.read_csv('a.csv')\nx = df.dropna()\nx += 1\nx\n")
    call, drop = "call_read csv_abcd1234_2_5", "method_dropna_abcd1234_3_4"
    assert e["pandas", call] == (5, "read csv") and e[call, "df_abcd1234_2"][0] == 2
    assert e["df_abcd1234_2", drop] == (0, "dropna") and e[drop, "x_abcd1234_3"][0] == 2
    assert e["x_abcd1234_3", "op_aug_add_abcd1234_4_0"][0] == 0 and ("op_aug_add_abcd1234_4_0", "x_abcd1234_4") in e
    assert g.nodes[call]["struct_type"] == 9 and g.nodes["pandas"]["struct_type"] == 1 and g.nodes["literal_abcd1234_2_17"]["code"] == "a.csv"
    assert e["x_abcd1234_4", "sink_abcd1234_5_0"][0] == 1


def test_tuple_targets_share_a_hub():
    _, e = edges_of("from m import split\na, b = split(x)\n")
    assert ("call_split_abcd1234_2_7", "a_abcd1234_2") in e and ("call_split_abcd1234_2_7", "b_abcd1234_2") in e


def test_branches_and_loops():
    g, e = edges_of("x = f()\nif c:\n    x = g(x)\nelse:\n    x = h(x)\nfor i in x:\n    x = k(x, i)\nwhile x in y:\n    x = m(x)\n")
    assert e["x_abcd1234_1", "x_abcd1234_3"] == (3, "if") and e["x_abcd1234_1", "x_abcd1234_5"] == (3, "else")
    assert e["x_abcd1234_5", "for_op_abcd1234_6_0"][0] == 1 and e["for_op_abcd1234_6_0", "i_final_abcd1234_6"] == (2, "loop_exit")
    assert ("while_op_abcd1234_8_0", "x_final_abcd1234_8") in e and g.nodes["while_op_abcd1234_8_0"]["struct_type"] == 6


def test_compare_hubs():
    assert not any("op_gt" in n for n in edges_of("z = a > b\n")[0].nodes)
    assert any("op_gt" in n for n in edges_of("z = a > b\n", compare_hubs="all")[0].nodes)
    assert any("op_in" in n for n in edges_of("z = a in b\n")[0].nodes)


def test_inlining():
    source = "def prep(t):\n    u = t.dropna()\n    return u\nd = load()\ne = prep(d)\n"
    g, e = edges_of(source)
    assert e["d_abcd1234_4", "t_abcd1234_1"][0] == 5 and e["return_prep_abcd1234_3", "e_abcd1234_5"][0] == 2
    g, e = edges_of(source, inline=False)
    assert e["prep_abcd1234_1", "call_prep_abcd1234_5_4"][0] == 5
    g, _ = edges_of("def f(n):\n    return f(n - 1)\nx = f(3)\n")
    assert "call_f_abcd1234_3_4" in g.nodes


def test_classes_comprehensions_lambdas():
    g, e = edges_of("class M:\n    def __init__(self, k):\n        self.k = k\n    def go(self, q):\n        return q.run()\nm = M(3)\nr = m.go(d)\ns = [t for t in r]\nf = lambda a: a.b()\nw = f(s)\nxs.sort(key=f)\n")
    assert e["return_M.go_abcd1234_5", "r_abcd1234_7"][0] == 2
    assert e["list_comp_abcd1234_8_4", "s_abcd1234_8"][0] == 2
    assert any(k == "function pointer" for _, _, k in g.edges)


def test_rewrites():
    import ast

    tree = rewrite.rewritten(ast.parse("import apache_beam as beam\nwith beam.Pipeline() as p:\n    x = p | 'Read' >> beam.io.Read(1) | beam.Map(f)\n"), {})
    assert ast.unparse(tree).endswith("p = beam.Pipeline()\nx = p.Read(1).Map(f)")
    tree = rewrite.rewritten(ast.parse("from airflow import DAG\na >> [b, c]\n"), {})
    assert ast.unparse(tree).endswith("b = a.set_downstream(b)\nc = a.set_downstream(c)")
    assert ast.unparse(rewrite.rewritten(ast.parse("x = a | b\n"), {})) == "x = a | b"


def test_symbols():
    s = Symbols("import os.path as p, sys\nx = y + 1\ny = 2\ndef f(a):\n    return a + g\nz = [i for i in q]\nd.k = w\nfor n in m:\n    o += n\n")
    assert set(s.defs) == {"p", "sys", "x", "y", "f", "z", "n", "o"}
    assert {n for n, u in s.uses.items() if not u[1]} == {"y", "q", "w", "d", "m"} and s.uses["g"] == (5, True, "f")
    assert Symbols("x = (").parse_error
    assert file_access("open('a', 'w')\npd.read_csv('b')\ndf.to_csv('c')\nopen('d', mode='rb')\nf(1)") == [("a", "write", 1), ("b", "read", 2), ("c", "write", 3), ("d", "read", 4)]


@pytest.fixture(scope="module")
def corpus(spark):
    checkpoints(spark)
    return spark.createDataFrame(programs.corpus(), "nb_id string, cell_id string, document_index int, source string, defect string")


def test_leakage_on_seeded_programs(spark, corpus):
    records = build.parse(corpus).checkpoint()
    assert build.errors(records).count() == 0
    nodes = build.nodes(records).withColumn("node_type", build.F.col("struct_type"))
    found = leakage.findings(nodes, build.edges(records)).checkpoint()
    got = {(r.nb_id, r.leakage_class) for r in found.select("nb_id", "leakage_class").distinct().collect()}
    want = {(n, d) for n, _, _, _, d in programs.corpus() if d != "clean"}
    assert got == want
    scores = {r.leakage_class: r.f1 for r in leakage.score(found, corpus.withColumnRenamed("defect", "leakage_class")).collect()}
    assert scores == dict.fromkeys([*leakage.CLASSES, "micro"], 1.0)
    pct = {r.leakage_class: (r.notebooks, r.pct) for r in leakage.prevalence(found, corpus).collect()}
    assert pct["target_leakage"] == (4, 16.67)


def test_bad_cells(spark):
    d = spark.createDataFrame([("n", "c0", 0, "%matplotlib inline\nx = 1"), ("n", "c1", 1, "y = ("), ("m", "c0", 0, "x?\nz = 2")], "nb_id string, cell_id string, document_index int, source string")
    records = build.parse(d).collect()
    assert {(r.nb_id, r.rec) for r in records if r.rec == "error"} == {("n", "error")} and any(r.nb_id == "m" and r.rec == "node" for r in records)
    assert any(r.nb_id == "n" and r.rec == "node" for r in build.parse(d, skip_bad=True).collect())
    assert {r.cell_id for r in build.parses(d).where("nb_id = 'n'").collect()} == {"c0"}
    tree = build.ast_nodes(d.where("nb_id = 'm'")).orderBy("node").collect()
    assert [(r.type, r.parent) for r in tree][:2] == [("Module", -1), ("Assign", 0)]


def test_the_rest_of_a_mapping_pattern_is_bound():
    import ast

    from quillspark.ir import symbols

    got = [(e.name, e.kind) for e in symbols.events(ast.parse("match x:\n case {'k': v, **rest}:\n  print(rest)"))]
    assert got == [("x", None), ("v", "assign"), ("rest", "assign"), ("print", None), ("rest", None)]
