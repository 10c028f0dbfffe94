from pyspark.sql import functions as F

from quillspark.ir import build

CELLS = "nb_id long, cell_id string, document_index int, source string"


def test_cells_with_long_ids_keep_their_own_nodes(spark):
    """Ids alike in their first 8 characters; a cell of one call each."""
    rows = [(1, f"c100000{i:02d}", i, f"d{i} = pd.read_csv('f')\nq = d{max(i - 1, 0)}.dropna()") for i in range(12)]
    records = build.parse(spark.createDataFrame(rows, CELLS), inline=False)
    calls = build.nodes(records).where("struct_type = 9")
    assert {x.cell_id: x["count"] for x in calls.groupBy("cell_id").count().collect()} == {c: 2 for _, c, *_ in rows}
    short = build.parse(spark.createDataFrame([(1, "abcd1234ef", 0, "x = f(1)")], CELLS))
    assert "x_abcd1234_1" in {x.node_id for x in build.nodes(short).collect()}


def test_cross_cells_are_named_at_any_length_of_id(spark, tmp_path):
    from quillspark.plans import catalog

    first = 999_990
    rows = [(first + i, f"2024-01-01 00:00:{i:02d}", 7, "view", 1.0, "{}") for i in range(30)] + [(10_000_000 + i, f"2024-01-01 00:01:{i:02d}", 8, "view", 1.0, "{}") for i in range(30)]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "events.parquet"))
    import duckdb

    c = duckdb.connect()
    c.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = {tuple(x) for x in c.execute(f"select nb_id, src_cell, dst_cell, name from ({catalog.ORACLE['flow_cross_cells']})").fetchall()}
    got = [tuple(x) for x in catalog.QUERIES["flow_cross_cells"](spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == want
