import json
import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import cells, features, graphs, knowledge, labelers, lineage, metrics, mining, refine
from quillspark.operators import trace as T
from quillspark.operators.shared import checkpoints
from quillspark.plans import service
from quillspark.taxonomy import LOAD_CALLS


def col(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x"))).first()[0]


@pytest.mark.parametrize(("code", "first", "leaf"), [("pd.read_csv('a')", "read_csv", "read_csv"), ("a.b(c(d)).fit(x, y(z))", "b", "fit"), ("x", "x", ""), ("", "", ""), ("f(g(h(1)))(2)", "f", "f"), ("a['k'].m()", "m", "m"), ("f(x", "f", "f"), ("(a)(b)", "", "")])
def test_callees(spark, code, first, leaf):
    assert col(spark, text.callee, code) == first
    assert col(spark, text.leaf_callee, code) == leaf


def djb2(s):
    v = 5381
    raw = s.encode("utf-16-le")
    for i in range(0, len(raw), 2):
        v = (v * 33 + (raw[i] | raw[i + 1] << 8)) & 0xFFFFFFFF
    v = v - (1 << 32) if v >= 1 << 31 else v
    out, n = "", abs(v)
    while n:
        out = "0123456789abcdefghijklmnopqrstuvwxyz"[n % 36] + out
        n //= 36
    return ("-" if v < 0 else "") + (out or "0")


def test_hashes(spark):
    import hashlib

    for s in ("", "x = 1", "naïve 😀 text" * 9):
        assert col(spark, text.djb2, s) == djb2(s)
        assert col(spark, text.md5_mod, s) == int(hashlib.md5(s.encode()).hexdigest(), 16) % 10000


def test_sanitizers(spark):
    assert col(spark, text.sanitize, "%matplotlib\nx = 1\n!ls\ny?\n?z") == "\nx = 1\n\n\n"
    assert col(spark, text.strip_jupyter, "%a\nx\n# In[1]\ny") == "x\ny"
    assert col(spark, text.comment_magics, "  !ls\nx") == "  # !ls\nx"
    assert col(spark, text.literal_tokens, "maxDepth_value") == ["max", "depth", "value"]


def random_graph(seed, n=14):
    r = random.Random(seed)
    nodes = [(f"nb{seed}", f"n{i}", i, r.choice([0, 1, 2, 4, 8, 9, 9, 9]), r.choice([None, None, None, 2, 4]), r.random() < 0.5, r.choice(["pd.read_csv('d.csv')", "m.fit(x, y)", "df.to_csv('o')", "plot(x)", "df.merge(z)"]), r.choice(["x_test", "df", "m"]), f"c{i % 4}", r.choice([None, 0, 1, 2, 3, 4, 5, 5, 5]), r.choice([0, 1, 2, 5]), r.choice([None, 0.1, 0.4, 0.9]), r.choice([None, 0.05, 0.5])) for i in range(n)]
    edges, seen = [], set()
    while len(edges) < 2 * n:
        a, b = r.sample(range(n), 2)
        if r.random() < 0.85:
            a, b = min(a, b), max(a, b)
        if (a, b) not in seen:
            seen.add((a, b))
            edges.append((f"nb{seed}", f"n{a}", f"n{b}", len(edges), r.choice([0, 1, 1, 2, 2]), "l", r.choice([0, 1, 2, 3])))
    return nodes, edges


@pytest.fixture(scope="module")
def many(spark):
    checkpoints(spark)
    got = [random_graph(s) for s in range(6)]
    n = [x for g in got for x in g[0]]
    e = [x for g in got for x in g[1]]
    nodes = spark.createDataFrame(n, "nb_id string, node_id string, ord long, struct_type int, domain_type int, domain_node boolean, code string, label string, cell_id string, predicted_label int, runner_up int, confidence double, margin double").cache()
    edges = spark.createDataFrame(e, "nb_id string, src string, dst string, ord long, edge_type int, label string, predicted_label int").cache()
    return nodes, edges, n, e


def reach_of(e):
    out = {}
    for nb, a, b, *_ in e:
        out.setdefault((nb, a), set()).add(b)
    full = {}
    for k in out:
        todo, seen = list(out[k]), set()
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out.get((k[0], x), ())
        full[k] = seen
    return full


def test_closures(spark, many):
    nodes, edges, _, e = many
    want = {(nb, a, b) for (nb, a), bs in reach_of(e).items() for b in bs}
    assert {tuple(r) for r in graphs.closure(edges).collect()} == want
    far = graphs.closure_frontier(edges, nodes.where("ord < 3").select("nb_id", "node_id"))
    assert {(r.nb_id, r.seed, r.node) for r in far.where("depth > 0").collect()} == {(nb, a, b) for nb, a, b in want if a in ("n0", "n1", "n2") and a != b}


def test_refinement_against_plain_rules(spark, many):
    nodes, edges, n, e = many
    got = {(r.nb_id, r.node_id): r for r in refine.refine(nodes, edges).collect()}
    for nb in {x[0] for x in n}:
        want = plain_rules([x for x in n if x[0] == nb], [x for x in e if x[0] == nb])
        for node, (kind, label, dead) in want.items():
            r = got[nb, node]
            assert (r.node_type, r.domain_label, r.is_dead_code) == (kind, label, dead), (nb, node)


def plain_rules(n, e):
    """The default rules on one graph, by sets and loops."""
    names = {0: "MODEL_OPERATION", 1: "DATA_IMPORT_EXTRACTION", 2: "DATA_TRANSFORM", 3: "EDA", 4: "DATA_EXPORT", 5: "NOT_RELEVANT"}
    a = {x[1]: {"t": x[3] if x[4] is None else x[4], "dom": x[5], "code": x[6], "p": x[9], "r": x[10], "c": x[11], "m": x[12]} for x in n}
    succ = {k: [] for k in a}
    pred = {k: [] for k in a}
    for _, s, d, *_ in e:
        succ[s].append(d)
        pred[d].append(s)
    reach = {k[1]: v for k, v in reach_of(e).items()}
    hub = lambda k: a[k]["t"] in (3, 6, 9)
    conf = lambda k: (1.0 if a[k]["c"] is None else a[k]["c"]) >= 0.6
    soft = lambda k: not conf(k) and (1.0 if a[k]["m"] is None else a[k]["m"]) < 0.12
    name = {k: v["code"].split("(")[0].split(".")[-1] for k, v in a.items()}
    data, model, label, kind = set(), set(), {}, {}
    for k, v in a.items():
        if v["t"] == 2:
            data.add(k)
        elif v["dom"] and v["t"] == 4:
            model.add(k)
        if v["t"] == 9 and v["p"] is not None:
            label[k] = names[v["p"]]
            {1: data, 0: model}.get(v["p"], set()).add(k)
    for k, v in a.items():
        if v["t"] == 9 and name[k] in LOAD_CALLS:
            data.add(k)
            if not conf(k):
                label[k] = names[1]
        elif v["t"] == 9 and name[k] == "fit":
            model.add(k)
            if not conf(k):
                label[k] = names[0]
    starts = [k for k, v in a.items() if v["t"] == 9 and v["p"] == 1]
    for k in {x for s in starts for x in reach.get(s, ())}:
        if a[k]["t"] == 9 and a[k]["p"] == 5 and soft(k) and a[k]["r"] not in (None, 5):
            label[k] = names[a[k]["r"]]
    ends = [k for k, v in a.items() if v["t"] == 9 and v["p"] == 2 and (v["c"] or 0.0) >= 0.6]
    for k in a:
        if any(t in reach.get(k, ()) for t in ends) and a[k]["t"] == 9 and a[k]["p"] == 5 and soft(k) and not any(a[q]["t"] == 9 for p in pred[k] for q in pred[p]) and a[k]["r"] not in (None, 5):
            label[k] = names[a[k]["r"]]
    now = dict(label)
    for k, x in now.items():
        if x == names[0]:
            for p in pred[k]:
                if a[p]["t"] in (0, 4):
                    data.add(p)
                    kind[p] = 9
    for k, x in now.items():
        for s in succ[k]:
            if a[s]["t"] in (0, 4):
                {names[1]: data, names[0]: model}.get(x, set()).add(s)
    todo = [k for k in data if not hub(k)]
    seen = set(todo)
    for u in todo:
        for h in succ[u]:
            if hub(h):
                label.setdefault(h, names[2])
                for v in succ[h]:
                    if v not in seen:
                        seen.add(v)
                        todo.append(v)
                        if not hub(v):
                            data.add(v)
                            kind[v] = 2
    for k in a:
        if hub(k) and label.get(k) != names[0] and not conf(k) and any(p in model for p in pred[k]) and any(p in data for p in pred[k]):
            label[k] = "EDA"
    for k in a:
        if hub(k) and not conf(k) and name[k] == "to_csv":
            label[k] = "DATA_EXPORT"
            for s in succ[k]:
                if not hub(s):
                    kind[s] = 11
    for k in a:
        if a[k]["t"] == 8:
            if any(label.get(s) == names[0] for s in succ[k]):
                kind[k] = 6
            if any(label.get(s) == names[1] for s in succ[k]):
                label[k] = "PARAMETER"
    for k in data:
        if a[k]["t"] in (0, 4):
            kind[k] = 2
    for k in model:
        if a[k]["t"] in (0, 4) and k not in kind:
            kind[k] = 4
    return {k: (kind.get(k, a[k]["t"]), label.get(k), hub(k) and not succ[k] and label.get(k) in (None, "NOT_RELEVANT")) for k in a}


def test_features(spark, many):
    nodes, edges, n, e = many
    assert features.layout(["degree", "neighbor"]) == [("degree", 0, 2), ("neighbor", 2, 4)]
    c = {(r.nb_id, r.node_id): r for r in features.centrality(nodes, edges).collect()}
    assert all(abs(sum(r.pagerank for k, r in c.items() if k[0] == nb) - 1) < 1e-6 for nb in {x[0] for x in n})
    line = spark.createDataFrame([("l", "a", "b"), ("l", "b", "c"), ("l", "c", "a")], "nb_id string, src string, dst string")
    names = spark.createDataFrame([("l", x) for x in "abc"], "nb_id string, node_id string")
    got = {r.node_id: r for r in features.centrality(names, line).collect()}
    assert got["a"].betweenness == 0.5 and abs(got["a"].clustering - 0.5) < 1e-9
    s = features.structure(nodes, edges)
    assert s.count() == sum(x[3] == 9 for x in n) and s.where("n_successor_ops > 1 or depth_from_source > 1").count() == 0
    vec = features.embed(spark.createDataFrame([("read csv",), ("",), (None,)], "t string"), "t", "v", 16).collect()
    assert [round(sum(x * x for x in r.v), 6) for r in sorted(vec, key=lambda r: r.t or "")] in ([0.0, 0.0, 1.0],)


def test_lineage(spark):
    checkpoints(spark)
    n = [("d1", 2, "a"), ("h1", 9, "f()"), ("d2", 2, "b"), ("h2", 9, "g()"), ("d3", 2, "c"), ("lib", 1, "pandas"), ("h3", 9, "m.fit()"), ("m", 4, "model")]
    nodes = spark.createDataFrame([("n", k, i, t, True, c, k, f"c{i}", 2 if t == 9 else None) for i, (k, t, c) in enumerate(n)], "nb_id string, node_id string, ord long, node_type int, domain_node boolean, code string, label string, cell_id string, predicted_label int")
    pairs = [("lib", "h1"), ("d1", "h1"), ("h1", "d2"), ("d2", "h2"), ("h2", "d3"), ("d3", "h3"), ("h3", "m")]
    edges = spark.createDataFrame([("n", a, b, i, 1) for i, (a, b) in enumerate(pairs)], "nb_id string, src string, dst string, ord long, edge_type int")
    macro, ways = lineage.project(nodes, edges)
    got = {r.node_id: r for r in macro.collect()}
    assert set(got) == {"d1", "m"} and [s.target_node for s in got["d1"].transform_history] == ["d2", "d3"]
    assert got["d1"].transform_history[0].operation == "f() -> d2 [Inputs: lib.f() -> d2]"
    assert {(r.src, r.dst) for r in ways.collect()} == {("d1", "m")}
    assert {(r.tuple_type, r.subject_id, r.object_id) for r in lineage.tuples(macro, ways).collect()} == {("<M, D>", "m", "d1")}
    raw = spark.createDataFrame([("n", "<D, D>", "a", "b"), ("n", "<D, D>", "a", "b"), ("n", "<X>", "a", "b"), ("n", "<D, Empty>", "a", None), ("n", "<M, D>", " ", "b")], "nb_id string, tuple_type string, subject_id string, object_id string")
    assert {(r.tuple_type, r.object_id) for r in lineage.normalize_tuples(raw).collect()} == {("<D, D>", "b"), ("<D, Empty>", "Empty")}


CELLS = [("n", "c0", 0, "import pandas as pd", 1, False), ("n", "c1", 1, "df = pd.read_csv('a.csv')\ndf.to_csv('b.csv')", 2, False), ("n", "c2", 2, "def f(q):\n    return q + late", 3, True), ("n", "c3", 3, "late = 3", 4, False), ("n", "c4", 4, "z = f(df)\nghost", 5, False), ("n", "c5", 5, "e = pd.read_csv('b.csv')", None, False), ("n", "c6", 6, "   ", None, False)]


@pytest.fixture(scope="module")
def notebook(spark):
    return spark.createDataFrame(CELLS, "nb_id string, cell_id string, document_index int, source string, execution_count int, is_dirty boolean")


def test_cell_graph(spark, notebook):
    c, e, undefined = service.cell_graph(notebook)
    got = {(r.src_cell, r.dst_cell, r.name, r.kind) for r in e.collect()}
    assert {("c0", "c1", "pd", "IMPORT"), ("c1", "c4", "df", "DATA"), ("c2", "c4", "f", "FUNCTION_DEF"), ("c3", "c4", "late", "DATA"), ("c1", "c5", "b.csv", "FILE_ARTIFACT"), ("c0", "c5", "pd", "IMPORT")} == got
    assert {(r.cell_id, r.name) for r in undefined.collect()} == {("c4", "ghost")}
    order = [r.cell_id for r in cells.topological_order(c, e).orderBy("rank").collect()]
    assert order == ["c0", "c1", "c2", "c3", "c4", "c5"]
    assert {(r.src_cell, r.dst_cell) for r in cells.minimal_constraints(e).collect()} == {("c0", "c1"), ("c1", "c4"), ("c2", "c4"), ("c3", "c4"), ("c1", "c5")}
    state = {r.cell_id: r.status for r in service.execution_state(notebook).collect()}
    assert state == {"c0": "fresh", "c1": "fresh", "c2": "dirty", "c3": "fresh", "c4": "stale", "c5": "unexecuted"}


def test_cycles(spark):
    c = spark.createDataFrame([("n", x, i) for i, x in enumerate("abc")], "nb_id string, cell_id string, document_index int")
    e = spark.createDataFrame([("n", "a", "b", 1.0), ("n", "b", "c", 0.5), ("n", "c", "a", 0.9)], "nb_id string, src_cell string, dst_cell string, confidence double")
    kept, dropped = cells.break_cycles(c, e)
    assert [(r.src_cell, r.dst_cell) for r in dropped.collect()] == [("b", "c")] and kept.count() == 2
    assert [r.cell_id for r in cells.topological_order(c, kept).orderBy("rank").collect()] == ["c", "a", "b"]
    assert [r.cell_id for r in cells.topological_order(c, e).orderBy("rank").collect()] == ["a", "b", "c"]
    draws = mining.linear_extensions(c, kept, n=3).collect()
    for d in range(3):
        rank = {r.cell_id: r.rank for r in draws if r.draw == d}
        assert rank["c"] < rank["a"] < rank["b"]


def test_trace(spark, notebook):
    payload = {"sessions": [{"session_id": "s", "kernel_id": "k", "events": [{"cell_id": "c1", "seq": 2, "document_index": 1, "source_hash": "h1"}, {"cell_id": "c0", "seq": 1, "document_index": 0, "source_hash": djb2(CELLS[0][3])}, {"nothing": 1}, {"cell_id": "gone", "seq": 5, "document_index": 0, "source_hash": "hg"}, {"cell_id": "c1", "seq": 4, "document_index": 1, "source_hash": "h2"}]}, {"events": []}], "sources": {"hg": "ghost = 1"}}
    sessions, events, sources = T.parse(spark.createDataFrame([("n", json.dumps(payload)), ("bad", "[")], "nb_id string, payload string"))
    assert {(r.session_id, r.kernel_id) for r in sessions.collect()} == {("s", "k"), ("session_1", None)}
    assert [(r.seq, r.rerun_kind) for r in T.rerun_kinds(events).orderBy("seq").collect()] == [(1, "first"), (2, "first"), (4, "edited"), (5, "first")]
    assert [r.out_of_doc_order for r in T.out_of_order(events).orderBy("seq").collect()] == [False, False, False, True]
    c, e, undefined = service.cell_graph(notebook)
    defined = sources.select("nb_id", "source_hash", F.lit("ghost").alias("name"))
    gone = T.deleted_reads(events, c, defined, undefined).collect()
    assert [(r.cell_id, r.names) for r in gone] == [("gone", ["ghost"])]
    fresh = T.freshness(events, c, e)
    state = {r.cell_id: r.freshness for r in fresh.collect()}
    assert state["c0"] == "fresh" and state["c1"] == "edited" and state["c5"] == "unexecuted"
    steps = T.replay_set(fresh, e, cells.topological_order(c, e), spark.createDataFrame([("n", "c4")], "nb_id string, cell_id string"))
    assert [r.cell_id for r in steps.orderBy("step").collect()] == ["c1", "c2", "c3", "c4"]
    kinds = {(r.kind, r.cell_id) for r in T.risks(e, events, T.deleted_reads(events, c, defined, undefined), fresh, c).collect()}
    assert {("deleted-cell-state", "gone"), ("edited-after-run", "c1")} <= kinds
    assert service.trace_analysis(notebook, events).count() == 4


def test_knowledge(spark, tmp_path):
    (tmp_path / "kb.csv").write_text('Library,Module,Caller,API Name,Inputs,Outputs\ncatboost,,,CatBoostClassifier,[\'hyperparameter\'],[\'model\']\ncatboost,,model,fit,"[\'features\', \'labels\']",[\'trained model\']\npandas,,,read_csv,[\'file_path\'],[\'data\']\nnumpy,,,load,[\'file_path\'],[\'data\']\npandas,,,load,[\'data\'],[\'metric\']\n')
    kb = knowledge.load(spark, str(tmp_path / "kb.csv"))
    rows = kb.withColumn("label", knowledge.signature_label(F.col("inputs"), F.col("outputs"), F.col("caller")))
    assert {(r.api, r.library): r.label for r in rows.collect()} == {("CatBoostClassifier", "catboost"): 0, ("fit", "catboost"): 5, ("read_csv", "pandas"): 1, ("load", "numpy"): 1, ("load", "pandas"): 3}
    idx = {(r.api, r.library): r.label for r in knowledge.index(rows).collect()}
    assert idx["read_csv", "*"] == 1 and ("load", "*") not in idx and idx["load", "pandas"] == 3
    asked = spark.createDataFrame([(1, "catboost", None, "model", "fit"), (2, "catboost", None, "other", "CatBoostClassifier"), (3, "torch", None, None, "fit")], "ask_id int, library string, module string, caller string, api string")
    got = {r.ask_id: r.inputs for r in knowledge.look_up(asked, kb).collect()}
    assert got == {1: ["features", "labels"], 2: ["hyperparameter"], 3: []}
    back = spark.createDataFrame([(1, "read_csv", ["data"]), (2, "read_csv", ["x"]), (3, "read_csv", [None])], "ask_id int, api string, outputs array<string>")
    assert {r.ask_id: r.inputs for r in knowledge.back_query(back, kb).collect()} == {1: ["file_path"], 2: [], 3: ["file_path"]}
    n = spark.createDataFrame([("n", "a", "pd.read_csv('x')", "pandas"), ("n", "b", "np.load('x')", "numpy"), ("n", "c", "foo()", "")], "nb_id string, node_id string, code string, base_inputs string")
    assert {r.node_id: r.kb_label for r in knowledge.label(n, knowledge.index(rows)).collect()} == {"a": 1, "b": 1, "c": None}
    more = knowledge.kb_first(n, knowledge.index(rows), lambda rest: rest.select("nb_id", "node_id", F.lit(5).alias("label")))
    assert {r.node_id: r.predicted_label for r in more.collect()} == {"a": 1, "b": 1, "c": 5}


def test_labelers(spark, many):
    nodes, edges, n, _ = many
    r = random.Random(0)
    rows = [([r.gauss(3 * (i % 3), 1), r.gauss(-3 * (i % 3), 1)], i % 3) for i in range(150)]
    d = spark.createDataFrame(rows, "features array<double>, label int")
    for kind in ("mlp", "trees"):
        got = labelers.predict(labelers.fit(d, kind, 3), d)
        assert got.where("predicted_label = label").count() > 130
    a = labelers.random_labels(nodes.select("nb_id", "node_id")).collect()
    assert a == labelers.random_labels(nodes.select("nb_id", "node_id")).collect() and all(abs(sum(x.probabilities) - 1) < 1e-9 for x in a)
    assert labelers.label_by_code(nodes).where("code like 'm.fit%' and predicted_label <> 0").count() == 0
    assert labelers.label_by_context(nodes, edges).count() == sum(x[3] == 9 for x in n)
    assert labelers.notebook_chunks(nodes, 2).selectExpr("max(size(node_ids)) as m").first().m == 2
    now = [0.0]
    pace = labelers.Pace(2, 100, 10.0, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(5):
        pace.wait(10)
    assert now[0] >= 20
    tries = []

    def flaky(p):
        tries.append(p)
        if len(tries) < 3:
            raise OSError
        return "ok"

    assert labelers.with_retries(flaky, sleep=lambda s: None)("q") == "ok" and len(tries) == 3
    x = nodes.select("nb_id", "node_id", F.array(F.col("struct_type").cast("double")).alias("features"))
    assert labelers.message_passing(x, edges, "features").selectExpr("min(size(features)) as m").first().m == 1 + 2 + 4


def test_metrics(spark):
    g = spark.createDataFrame([("n", "a", 1), ("n", "b", 2), ("n", "c", 1)], "nb_id string, node_id string, label int")
    p = spark.createDataFrame([("n", "a", 1), ("n", "b", 1)], "nb_id string, node_id string, label int")
    got = {r.label: (r.tp, r.fp, r.fn) for r in metrics.node_scores(g, p).collect()}
    assert got == {1: (1, 1, 1), 2: (0, 0, 1), None: (1, 1, 2)}
    t = spark.createDataFrame([("n", "a", 0), ("n", "b", 1), ("n", "c", 2)], "nb_id string, item string, rank int")
    q = spark.createDataFrame([("n", "a", 0), ("n", "b", 2), ("n", "c", 1)], "nb_id string, item string, rank int")
    assert [(round(r.accuracy, 3), round(r.tau, 3)) for r in metrics.order_scores(q, t).collect()] == [(0.667, 0.333)]
    s = metrics.softmax(spark.createDataFrame([([1.0, 2.0],)], "p array<double>"), "p").first().p
    assert abs(sum(s) - 1) < 1e-12 and s[1] > s[0]
    at = spark.createDataFrame([("n", 0, 1.0), ("n", 1, -3.0), ("n", 2, 4.0)], "node_id string, dim int, value double")
    spans = spark.createDataFrame([("x", 0, 2), ("y", 2, 3)], "group string, start int, end int")
    share, top = metrics.group_importances(at, spans, 1)
    assert {r.group: r.share for r in share.collect()} == {"x": 0.5, "y": 0.5} and {r.group: r.dim for r in top.collect()} == {"x": 1, "y": 2}


def test_mining(spark, notebook):
    got = mining.complexity(notebook.select("nb_id", "cell_id", F.lit("for i in x:\n    if a:\n        y = [j for j in i]\nelse:\n    pass").alias("source")).limit(1)).first()
    assert (got.loops, got.for_else, got.branches, got.list_comp, got.max_nesting_depth) == (1, 1, 1, 1, 3)
    assert [(r.roots, r.n_imports) for r in mining.import_summary(mining.imports(notebook)).collect()] == [(["pandas"], 1)]
    c, e, u = service.cell_graph(notebook)
    full = c.withColumn("undefined_uses", F.array().cast("array<string>"))
    pairs = mining.candidate_pairs(c, e)
    f = mining.pair_features(full, e, pairs)
    assert {len(r.features) for r in f.collect()} == {8 * 3 + 1 + 6 + 4}
    order = cells.topological_order(c, e).select("nb_id", F.col("cell_id").alias("item"), "rank")
    assert mining.pair_labels(pairs, order).where("related and label = 1").count() == 6
    assert mining.month_ranges("2024-01-15", "2024-03-20", spark).count() == 3
    kb = spark.createDataFrame([("a", None, None, "f", 1)], "library string, module string, caller string, api string, ord long")
    new = spark.createDataFrame([("a", None, None, "g", 2), ("a", None, None, "g", 3), ("a", None, None, None, 4)], kb.schema)
    calls = spark.createDataFrame([("a", "f"), ("a", "g")], "library string, api string")
    assert mining.evolve(kb, new, calls).count() == 2 and mining.evolve(kb, new.where("api is null"), calls).count() == 1
    out, counts = mining.relabel(spark.createDataFrame([("fit", 5), ("plot", 3)], "api string, label int"), spark.createDataFrame([("fit", 0)], "api string, label int"))
    assert {(r.old_label, r.new_label, r.n) for r in counts.collect()} == {(5, 0, 1), (3, 3, 1)}


def test_service(spark, notebook):
    macro, ways, tuples = service.lineage_of(notebook)
    assert tuples.count() > 0 and macro.where("node_type = 2").count() > 0
    nodes, edges = service.dataflow(notebook)
    assert nodes.where("base_inputs like '%pandas%'").count() > 0
    assert service.constants(spark).where("name = 'CALL'").first().code == 9
    assert service.environment(notebook).count() == 1 and service.leaks(notebook).count() == 0
