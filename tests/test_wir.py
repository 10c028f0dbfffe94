from quillspark.ir import wir

SOURCE = "import catboost as cb\nimport pandas as pd\nfrom sklearn.model_selection import train_test_split\nframe = pd.read_csv('a.csv')\nx = frame.drop('y', axis=1)\nmodel = cb.CatBoostClassifier(eval_metric='AUC')\na, b = train_test_split(x)\nmodel.fit(a, b)\n"
KB = [("catboost", None, None, "CatBoostClassifier", ["hyperparameter"], ["model"]), ("catboost", None, "model", "fit", ["features", "labels"], ["trained model"]), ("pandas", None, None, "read_csv", ["file_path"], ["data"]), ("sklearn", "model_selection", None, "train_test_split", ["features"], ["features", "validation features"])]


def test_relations(spark):
    prs = wir.process_relations(spark.createDataFrame([("n", SOURCE)], "nb_id string, source string")).collect()
    names = {(wir.bare(r.input), wir.bare(r.caller), wir.bare(r.op), wir.bare(r.output)) for r in prs}
    assert ("pandas", "", "ImportAs", "pd") in names
    assert ("a.csv", "pd", "read_csv", "frame") in names
    assert ("y", "frame", "drop", "x") in names
    assert not any(o == "Assign" and i == "frame" for i, _, o, _ in names)


PRS = "nb_id string, pr_id long, input string, caller string, op string, output string"


def test_a_look_up_and_its_call_are_one(spark):
    rows = [("n", 0, None, "df", "drop:meth", "drop:id1"), ("n", 1, "y", None, "drop:id1", "x"), ("n", 2, None, "other", "drop:meth", "drop:id1"), ("n", 3, "a", "df", "keep", "z"), ("m", 0, "y", None, "drop:id1", "x")]
    got = [tuple(r) for r in wir.one_call(spark.createDataFrame(rows, PRS)).orderBy("nb_id", "pr_id").collect()]
    assert got == [("m", 0, "y", None, "drop:id1", "x"), ("n", 1, "y", "df", "drop:id1", "x"), ("n", 3, "a", "df", "keep", "z")]


def test_imported_names_are_called_by_their_own_node(spark):
    rows = [("n", 0, "1", "fit", "op:id1", "u"), ("n", 1, "sk", None, "ImportFrom:id2", "fit"), ("n", 2, "2", "fit", "op:id3", "v"), ("n", 3, "other", None, "ImportFrom:id4", "fit"), ("n", 4, "3", "fit", "op:id5", "w")]
    got = [tuple(r)[2:] for r in wir.own_imports(spark.createDataFrame(rows, PRS)).orderBy("pr_id").collect()]
    assert got == [
        ("1", "fit", "op:id1", "u"), ("sk", None, "ImportFrom:id2", "fit:idf1"), (None, "fit:idf1", "fit", None), ("2", "fit:idf1", "op:id3", "v"),
        ("other", None, "ImportFrom:id4", "fit:idf3"), (None, "fit:idf3", "fit", None), ("3", "fit:idf3", "op:id5", "w"),
    ]


def test_labels_of_literals():
    from quillspark.ir.flow import literal_label

    assert [literal_label(x) for x in ("trainData.csv", "['a b', 'c']", "HTTPServer-2X", "xA", "AAbBc", 3.5, None, "", "Ab" * 30)] == ["train data csv", "a b, c", "http server 2 x", "x a", "a ab bc", "3 5", "none", "", " ".join(["ab"] * 23) + " a"]


def test_tracking():
    prs = [("y", "df", "drop:id1", "x"), ("c1", None, "List:id2", "l"), ("l", "df", "Subscript:id3", "z")]
    assert wir.track(prs, {"x"}) == (set(), {"y"})
    assert wir.track(prs, {"z"}) == ({"c1"}, set())


def test_tables(spark):
    d = spark.createDataFrame([("n", SOURCE), ("bad", "x = (")], "nb_id string, source string")
    prs = wir.process_relations(d).cache()
    assert {r.nb_id for r in prs.collect()} == {"n"}
    e = wir.edges(prs)
    assert e.where("edge_type = 2").count() > 4 and e.count() == e.distinct().count()
    assert wir.shared_names(prs).count() == 0
    notes = {(wir.bare(r.name), r.annotation) for r in wir.annotations(prs, KB).collect()}
    assert {("frame", "data"), ("model", "model"), ("cb", "catboost")} <= notes
    types = {wir.bare(r.node_id): r.domain_type for r in wir.node_types(wir.annotations(prs, KB)).collect()}
    assert types["frame"] == 2 and types["model"] == 4 and types["cb"] == 1
    prs.unpersist()


def test_tuples(spark):
    prs = wir.process_relations(spark.createDataFrame([("n", SOURCE)], "nb_id string, source string"))
    found = {(r.tuple_type, wir.bare(r.subject_id), wir.bare(r.object_id)) for r in wir.tuples(prs, wir.node_types(wir.annotations(prs, KB))).collect()}
    assert any(t == "<D, D>" and s == "frame" for t, s, _ in found)
