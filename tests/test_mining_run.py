"""Notebook stores as a source, and mining runs that break off and go on."""

import json

import pytest
from pyspark.sql import functions as F

from quillspark.operators import ledger as L
from quillspark.sources import notebooks, store


def notebook(*sources):
    return json.dumps({"cells": [{"cell_type": "code", "id": f"c{i}", "source": s} for i, s in enumerate(sources)], "nbformat": 4})


@pytest.fixture
def folder(tmp_path):
    top = tmp_path / "store"
    (top / "a").mkdir(parents=True)
    (top / "a" / "1.ipynb").write_text(notebook("x = 1", "y = x"))
    (top / "a" / "2.ipynb").write_text("{not json")
    (top / "a" / "3.ipynb").write_text('{"metadata": {}}')
    (top / "a" / "4.ipynb").write_bytes(b'{"cells": [\xff]}')
    (top / "b.jsonl").write_text(notebook("p = 1") + "\n\n" + notebook("q = ") + "\n")
    (top / "notes.txt").write_text("no notebook")
    return str(top)


def listed(df):
    return [(r.idx, r.line, r.name, r.error) for r in df.orderBy("idx", "line").collect()]


EVERY = [(0, 0, "a/1.ipynb", None), (1, 0, "a/2.ipynb", "NotJSON"), (2, 0, "a/3.ipynb", "NotANotebook"), (3, 0, "a/4.ipynb", "UnicodeDecodeError"), (4, 0, "b.jsonl", None), (4, 1, "b.jsonl", None)]


def test_places_are_read_once_from_any_start(spark, folder):
    assert listed(store.load(spark, folder)) == EVERY
    for k in range(6):
        assert listed(store.load(spark, folder, end=k)) + listed(store.load(spark, folder, start=k)) == EVERY
    assert listed(store.load(spark, folder + "/none")) == [] and listed(store.load(spark, folder, start=9)) == []
    good = store.load(spark, folder).where("error is null").select(F.concat_ws(":", "name", "line").alias("nb_id"), F.col("content").alias("value"))
    assert {(r.nb_id, r.cell_id, r.source) for r in notebooks.cells_of(good).collect()} == {("a/1.ipynb:0", "c0", "x = 1"), ("a/1.ipynb:0", "c1", "y = x"), ("b.jsonl:0", "c0", "p = 1"), ("b.jsonl:1", "c0", "q = ")}


def test_a_registry_sets_the_order(spark, folder, tmp_path):
    names = tmp_path / "names.txt"
    names.write_text("b.jsonl\ngone.ipynb\n\na/1.ipynb\n")
    assert listed(store.load(spark, folder, str(names), start=1)) == [(1, 0, "gone.ipynb", "NotFound"), (2, 0, "a/1.ipynb", None)]


def test_many_places_are_many_tasks(spark, tmp_path):
    top = tmp_path / "many"
    top.mkdir()
    for i in range(store.TASK * 2 + 3):
        (top / f"{i:04d}.ipynb").write_text(notebook(f"x = {i}"))
    got = store.load(spark, str(top))
    assert got.rdd.getNumPartitions() == 3 and got.count() == store.TASK * 2 + 3


def test_a_stream_goes_on_where_it_ended(spark, folder, tmp_path):
    names = tmp_path / "names.txt"
    names.write_text("a/1.ipynb\na/2.ipynb\n")
    seen = []

    def run():
        q = store.stream(spark, folder, str(names)).writeStream.foreachBatch(lambda b, e: seen.append((e, listed(b)))).option("checkpointLocation", str(tmp_path / "ck")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    run()
    names.write_text("a/1.ipynb\na/2.ipynb\nb.jsonl\n")
    run()
    run()
    assert [x for _, rows in seen for x in rows] == [(0, 0, "a/1.ipynb", None), (1, 0, "a/2.ipynb", "NotJSON"), (2, 0, "b.jsonl", None), (2, 1, "b.jsonl", None)]
    assert [e for e, _ in seen] == [0, 1]


def judged(n):
    return lambda start, end: n.where((F.col("idx") >= start) & (F.col("idx") < end))


def plain(spark, n):
    return spark.range(n).select(F.col("id").alias("idx"), F.lit(0).cast("long").alias("line"), (F.col("id") % 3 == 1).alias("kept"))


def told(book):
    return [(r.idx, r.kept) for r in book.rows().orderBy("idx").collect()]


def test_a_run_keeps_as_many_as_wanted(spark, tmp_path):
    n = plain(spark, 40)
    for target, last in ((None, 39), (5, 13), (1, 1), (13, 37), (14, 39)):
        book = L.Ledger(spark, str(tmp_path / f"t{target}"))
        state = L.mine(judged(n), 40, lambda d: d, book, target, step=7)
        assert told(book) == [(i, i % 3 == 1) for i in range(last + 1)] and state["next"] == last + 1 and state["processed"] == last + 1
        assert state["kept"] == sum(i % 3 == 1 for i in range(last + 1))
    # a larger target goes on from there
    book = L.Ledger(spark, str(tmp_path / "t5"))
    L.mine(judged(n), 40, lambda d: d, book, 6, step=7)
    assert told(book) == [(i, i % 3 == 1) for i in range(17)]


def test_a_run_killed_between_data_and_mark_gives_the_same_ledger(spark, tmp_path, monkeypatch):
    n, whole = plain(spark, 20), L.Ledger(spark, str(tmp_path / "whole"))
    L.mine(judged(n), 20, lambda d: d, whole, step=6)
    book = L.Ledger(spark, str(tmp_path / "killed"))
    put, calls = L.Ledger._mark, []

    def dies(self, state):
        calls.append(1)
        if len(calls) in (2, 4):
            raise RuntimeError("killed")
        return put(self, state)

    monkeypatch.setattr(L.Ledger, "_mark", dies)
    for _ in range(2):
        with pytest.raises(RuntimeError):
            L.mine(judged(n), 20, lambda d: d, book, step=6)
    monkeypatch.undo()
    state = L.mine(judged(n), 20, lambda d: d, L.Ledger(spark, book.path), step=6)
    assert told(book) == told(whole) and state["processed"] == 20 and state["epoch"] == 3
    assert book.clean() == 2 and told(book) == told(whole)


def test_an_epoch_is_added_once(spark, tmp_path):
    n, book = plain(spark, 4), L.Ledger(spark, str(tmp_path / "twice"))
    assert book.rows() is None and book.append(n, 0, 4) and not book.append(n, 0, 4)
    other = L.Ledger(spark, book.path)
    before = other.state()
    assert book.append(n.limit(1), 1, 5)
    # a writer that still holds the older mark loses the race, and looks again
    assert not other._mark(before | {"data": []}) and not other.append(n, 1, 9)
    for e in range(2, 5):
        book.writer()(n, e)
    book.compact()
    assert book.rows().count() == 17 and len(book.state()["data"]) == 1 and book.state()["epoch"] == 4
    assert book.clean() == 5 and book.rows().count() == 17


def test_entries_of_a_store(spark, folder):
    got = {r.source_id: r for r in L.entries(store.load(spark, folder)).collect()}
    assert {k: (r.success, r.status_reason) for k, r in got.items()} == {
        "a/1.ipynb": (True, "Dropped: Too Few Edges (<5)"),
        "a/2.ipynb": (False, "Failed: NotJSON"),
        "a/3.ipynb": (False, "Failed: NotANotebook"),
        "a/4.ipynb": (False, "Failed: UnicodeDecodeError"),
        "b.jsonl:0": (True, "Dropped: Too Few Edges (<5)"),
        "b.jsonl:1": (False, "Failed: SyntaxError"),
    }
    assert got["a/1.ipynb"].loc == 2 and not any(r.kept for r in got.values())
