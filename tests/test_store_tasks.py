from quillspark.sources import store


def test_few_files_are_read_side_by_side(spark, tmp_path):
    for i in range(20):
        (tmp_path / f"{i:02d}.ipynb").write_text('{"cells": []}')
    got = store.load(spark, str(tmp_path), tasks=4)
    assert got.rdd.getNumPartitions() >= 4
    assert sorted(r.idx for r in got.collect()) == list(range(20))
    parts = store._parted([str(i) for i in range(300)], 10, 300, 4)
    assert [x for p in parts for x in p.chosen] == [str(i) for i in range(10, 300)] and all(len(p.chosen) <= store.TASK for p in parts)
