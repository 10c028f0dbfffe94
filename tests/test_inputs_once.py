from quillspark.operators import features, leakage, refine
from quillspark.operators.shared import GIVE_UP


def _graph(spark):
    n = spark.range(40).selectExpr("id div 10 as nb_id", "concat('n', id) as node_id", "id as ord", "cast(if(id % 3 = 0, 9, 0) as int) as struct_type", "cast(null as int) as domain_type", "false as domain_node", "'m.fit(x)' as code", "'x' as label", "'c' as cell_id", "1 as predicted_label", "2 as runner_up", "0.5d as confidence", "0.1d as margin")
    e = spark.range(39).where("id % 10 < 9").selectExpr("id div 10 as nb_id", "concat('n', id) as src", "concat('n', id + 1) as dst", "id as ord", "cast(id % 3 as int) as edge_type", "'x' as label", "1 as predicted_label")
    return n, e


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rules_read_edges_that_were_made_once(spark, monkeypatch):
    seen = []
    monkeypatch.setitem(refine.PRESETS, "seen", [lambda s, e: seen.append(_plan(e)) or s])
    assert refine.refine(*_graph(spark), "seen").count() == 40
    assert "Range (" not in seen[0]


def test_detectors_and_vectors_read_graphs_that_were_made_once(spark):
    n, e = _graph(spark)
    assert "Range (" not in _plan(leakage.findings(n.withColumn("node_type", n["struct_type"]), e))
    v = features.assemble(n, e, ["degree", "neighbor", "lineage_struct"])
    assert "Range (" not in _plan(v) and "FlatMapGroups" not in _plan(v) and v.count() == 14


def test_states_are_given_up_as_the_next_stands(spark):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.sparkContext._jsc.sc().getCheckpointDir().get()) if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else None
    files = lambda: {str(s.getPath()) for s in place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(place)} if place else set()
    before, conf = files(), spark.conf.get(GIVE_UP)
    out = refine.refine(*_graph(spark))
    place = place or spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.sparkContext._jsc.sc().getCheckpointDir().get())
    # the edges and the last of thirteen states
    assert len(files() - before) == 2 and out.count() == 40 and spark.conf.get(GIVE_UP) == conf
