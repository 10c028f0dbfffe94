import datetime

import pytest

from quillspark.operators import trace as T
from quillspark.streaming import trace as S

T0 = datetime.datetime(2024, 1, 1)


def rows():
    out = []
    for nb in (1, 2):
        counts = [1, 2, 3, 1, 2, 3, 4]
        for seq, n in enumerate(counts):
            out.append((nb, seq, "abc"[seq % 3], seq % 3, n, "k" if seq < 5 else "k2", seq == 6, f"h{seq}", T0 + datetime.timedelta(minutes=2 * seq)))
    return out


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def streamed(spark, tmp_path, batches, **options):
    """Rows of live() over batches of events, one trigger each; the query starts anew for every batch."""
    path, out = str(tmp_path / "in"), []
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, S.EVENTS).coalesce(1).write.parquet(f"{path}/{i:03d}")
        stream = spark.readStream.schema(S.EVENTS).option("recursiveFileLookup", "true").parquet(path)
        q = S.live(stream, **options).writeStream.foreachBatch(lambda b, e: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / "ck")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    return out


def test_live_equals_batch(spark, tmp_path, rocks):
    every = rows()
    # the second batch repeats two events of each notebook
    got = streamed(spark, tmp_path, [[r for r in every if r[1] < 4], [r for r in every if r[1] >= 2]])
    events = {(r.nb_id, r.seq): r for r in got if r.kind == "event"}
    want = {(r.nb_id, r.seq): r.session_no for r in T.sessionize(spark.createDataFrame(every, S.EVENTS)).collect()}
    assert {k: r.session_no for k, r in events.items()} == want and len([r for r in got if r.kind == "event"]) == 14
    assert events[1, 0].rerun_kind == "first" and events[1, 3].rerun_kind == "first" and not events[1, 3].out_of_doc_order
    assert {(r.nb_id, r.session_no, r.events, r.cells) for r in got if r.kind == "closed"} == {(nb, no, n, n) for nb in (1, 2) for no, n in ((0, 3), (1, 2), (2, 1))}


def event(nb, seq, minute, cell="a", source="h", index=0, count=None):
    return (nb, seq, cell, index, count, "k", False, source, T0 + datetime.timedelta(minutes=minute))


def test_idle_sessions_are_closed_by_a_timer(spark, tmp_path, rocks):
    first = [event(1, 0, 0), event(1, 1, 5, "b", index=2), event(1, 2, 6, "a", "new", index=1), event(2, 0, 0)]
    # notebook 2 comes back after more than the idle time, before the watermark tells; 1 does after its timer
    then = [event(2, 1, 40), event(3, 0, 50)]
    later = [event(1, 3, 61, "a", "new"), event(1, 1, 61), event(4, 0, 200), event(9, 0, 5)]
    got = streamed(spark, tmp_path, [first, then, later, [event(4, 1, 201)]], late="5 minutes", idle_ms=30 * 60_000, forget_ms=90 * 60_000)
    assert [(r.nb_id, r.seq, r.session_no, r.rerun_kind, r.out_of_doc_order) for r in sorted((r for r in got if r.kind == "event"), key=lambda r: (r.nb_id, r.seq))] == [
        (1, 0, 0, "first", False), (1, 1, 0, "first", False), (1, 2, 0, "edited", True), (1, 3, 1, "first", False),
        (2, 0, 0, "first", False), (2, 1, 1, "first", False), (3, 0, 0, "first", False), (4, 0, 0, "first", False), (4, 1, 0, "identical", False),
    ]
    # event 9 is behind the watermark
    assert sorted((r.nb_id, r.session_no, r.events, r.cells) for r in got if r.kind == "closed") == [(1, 0, 3, 2), (1, 1, 1, 1), (2, 0, 1, 1), (2, 1, 1, 1), (3, 0, 1, 1)]


def test_forgotten_notebooks_start_anew(spark, tmp_path, rocks):
    got = streamed(spark, tmp_path, [[event(1, 5, 0)], [event(2, 0, 300)], [event(2, 1, 301)], [event(2, 2, 302)], [event(1, 0, 303)]], late="1 minute", idle_ms=60_000, forget_ms=3600_000)
    assert [(r.seq, r.session_no) for r in got if r.kind == "event" and r.nb_id == 1] == [(5, 0), (0, 0)]


def test_windows(spark, tmp_path):
    spark.createDataFrame(rows(), S.EVENTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = S.windowed(S.read(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("win_out").option("checkpointLocation", str(tmp_path / "ck")).outputMode("complete").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sum(r.runs for r in spark.table("win_out").collect()) == 14


def test_upsert(spark, tmp_path):
    path = str(tmp_path / "sessions")
    put = S.upsert(spark, path)
    d = lambda *r: spark.createDataFrame([*r], "nb_id long, session_id string, arrival int, events string")
    put(d((1, "a", 0, "x"), (1, "b", 0, "y"), (1, "", 0, "dropped")), 0)
    put(d((1, "b", 1, "old"), (1, "b", 2, "new"), (2, "a", 1, "z")), 1)
    put(d((9, "q", 1, "again")), 1)  # an epoch that was written already
    assert {(r.nb_id, r.session_id, r.events) for r in S.latest(spark, path).collect()} == {(1, "a", "x"), (1, "b", "new"), (2, "a", "z")}
