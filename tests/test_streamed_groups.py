from pyspark.sql import functions as F

from quillspark.ir import build, wir
from quillspark.operators import shared


def test_groups_of_any_size_in_order(spark):
    d = spark.range(30_000).select(F.when(F.col("id") % 7 != 0, F.col("id") % 501).alias("k"), (-F.col("id")).alias("x"), F.col("id").cast("string").alias("s"))
    got = {r.k: (r.n, r.least, r.up) for r in shared.by_group(d, "k", ["x"], lambda k, rows: [(k, len(rows), rows[0][1], [x for x, _ in rows] == sorted(x for x, _ in rows))], "k long, n long, least string, up boolean").collect()}
    want = {r.k: (r.n, str(r.m), True) for r in d.groupBy("k").agg(F.count("*").alias("n"), F.max(-F.col("x")).alias("m")).collect()}
    assert got == want and None in got
    assert shared.by_group(d.limit(0), "k", ["x"], lambda k, rows: [(k,)], "k long").count() == 0


def test_relations_are_made_once_for_their_edges(spark):
    """As many small scripts as events: one stream of groups, read once."""
    scripts = spark.createDataFrame([(str(i), f"d = f{i}(x)\nd.g(y)") for i in range(50)], "nb_id string, source string")
    e = wir.edges(wir.process_relations(scripts))
    plan = e._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "FlatMapGroups" not in plan
    assert e.where("edge_type = 1 and src = 'x'").count() == 50


def test_parsing_is_dealt_to_set_tasks(spark):
    cells = spark.createDataFrame([(i // 4, f"c{i}", i, f"a{i} = b{i}.c()" if i != 5 else "(") for i in range(40)], "nb_id long, cell_id string, document_index int, source string")
    for made in (build.parse(cells), build.symbols(cells)[0]):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan and "FlatMapGroups" not in plan
    assert [(r.nb_id, r.cell_id) for r in build.errors(build.parse(cells)).collect()] == [(1, "c5")]
    assert build.nodes(build.parse(cells, skip_bad=True)).where("struct_type = 9").count() == 39


def test_rows_that_lie_by_their_key_are_dealt_too(spark):
    """A window by the key has dealt the rows before, in tasks by their bytes."""
    d = spark.range(100).selectExpr("id % 10 as nb_id", "row_number() over (partition by id % 10 order by id) as i")
    plan = shared.by_group(d, "nb_id", ["i"], lambda k, rows: [(k, len(rows))], "nb_id long, n long")
    assert "REPARTITION_BY_NUM" in plan._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in plan.collect()} == {(k, 10) for k in range(10)}
