"""Decontamination, conversation repair and hard negatives on the cases that small tables seldom hold."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import conversation_repair, decontamination, hard_negatives

from . import brute
from .conftest import prose


@pytest.mark.parametrize("most", [1 << 19, 0])
def test_spans_found_by_broadcast_and_by_shuffle(spark, most):
    r = random.Random(1)
    words = "alpha beta gamma delta".split()
    docs = [(i, " ".join(r.choices(words, k=r.randrange(40)))) for i in range(60)] + [(None, None), (3, ""), (4, "alpha")]
    items = [(i, " ".join(r.choices(words, k=k))) for i, k in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 14])]
    got = decontamination.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), most=most)
    assert Counter(map(tuple, got.collect())) == Counter((i, *brute.contamination(t, items)) for i, t in docs)


def test_decontamination_of_empty_tables_and_long_texts(spark):
    docs, items = "doc_id long, text string", "item_id long, text string"
    text = prose(1, 30_000)
    item = " ".join(text.split(" ")[20_000:20_050])
    one = spark.createDataFrame([(1, text)], docs)
    assert decontamination.decontaminate(one, spark.createDataFrame([], items)).select("n_words", "n_hit", "contaminated").first()[1:] == (0, False)
    assert not decontamination.decontaminate(spark.createDataFrame([], docs), spark.createDataFrame([(1, item)], items)).count()
    assert tuple(decontamination.decontaminate(one, spark.createDataFrame([(1, item)], items)).first()) == (1, *brute.contamination(text, [(1, item)]))


def test_layers_find_the_cheapest_and_least_audit():
    r = random.Random(2)
    for _ in range(3000):
        rows = [(r.choice("uuaasx"), r.random() < 0.3) for _ in range(r.randrange(14))]
        initials, cuts = [i for i, _ in rows], [c for _, c in rows]
        ((edits, _, after),) = conversation_repair.trace(initials, cuts, conversation_repair._END, True, [0])
        cost, audit = brute.edits([(i, "truncated" if c else "") for i, c in rows])
        assert "".join(e for _, e in edits) + after == audit
        assert min(conversation_repair.relation(initials, cuts)[t] + conversation_repair._END[t] for t in range(4)) == cost


@pytest.mark.parametrize("segment", [12, 2, 0])
def test_segments_give_the_same_repair(spark, segment, monkeypatch):
    """A conversation of many segments, an all-deleted one and one that ends in copies."""
    monkeypatch.setattr(conversation_repair, "SEGMENT", segment)
    r = random.Random(3)
    turns = [(c, t, r.choice(["user", "assistant", "system", "x"]), r.choice(["Hi.", "No", "", f"Turn {t}.", f"Turn {t}"])) for c in range(12) for t in range(r.choice([3, 40, 90]))]
    turns += [(50, t, "system", f"Only {t}") for t in range(30)] + [(51, 1, "user", "Same.")] * 40 + [(52, None, None, None)]
    name = lambda x: " " if x is None else x
    by: dict = {}
    for c, t, role, text in turns:
        by.setdefault(c, []).append((t, name(role), name(text)))
    want = {c: brute.repaired(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))) for c, rows in by.items()}
    got = conversation_repair.repair(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3))
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want


def test_repair_of_an_empty_table(spark):
    assert not conversation_repair.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count()


@pytest.mark.parametrize(("block", "visits", "sample"), [(None, 1 << 16, 8192), (50, 3, 64), (7, 100, 2)])
def test_negatives_don_t_depend_on_blocks(spark, block, visits, sample):
    """Clusters, a third of the rows equal, ties, short vectors and large components."""
    r = np.random.default_rng(4)
    rows = [(i, r.integers(-9, 9, 5).tolist(), int(r.integers(3))) for i in range(400)] + [(500 + i, [3, 3, 3, 3, 3], i % 3) for i in range(200)]
    rows += [(800, [7], 0), (801, [], 1), (900, [1 << 40, 0, 0, 0, 0], 1), (901, [1 << 40, 1, 0, 0, 0], 1), (902, [1 << 39, 0, 0, 0, 0], 2), (None, [5, 5, 5, 5, 5], 2)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>, label int").repartition(3)
    got = hard_negatives.mine(df, anchors=F.col("vec_id") % 100 == 0, block=block, visits=visits, sample=sample)
    want = []
    for a, (i, v, y) in enumerate(rows):
        if i is None or i % 100:
            continue
        dot = lambda u, v=v: max(-(1 << 63), min((1 << 63) - 1, sum(x * z for x, z in zip(u, v, strict=False))))
        scored = sorted((-dot(u), j is None, j or 0, b, z) for b, (j, u, z) in enumerate(rows) if b != a)
        for s, _, j, _, _ in [x for x in scored if x[4] == y][:5]:
            fits = [x for x in scored if x[4] != y and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
            want += [(i, None if rows[_b(rows, j)][0] is None else j, k + 1, rows[x[3]][0], -s, -x[0]) for k, x in enumerate(fits)]
    assert Counter(map(tuple, got.collect())) == Counter(want)


def _b(rows, j):
    return next(k for k, x in enumerate(rows) if (x[0] or 0) == j)


def test_negatives_of_tables_without_them(spark):
    schema = "vec_id long, vector array<long>, label int"
    for rows in ([], [(1, None, 1)], [(0, [1], 1)], [(0, [1], 1), (1, [2], 1)], [(0, [1], 1), (1, [2], 2)]):
        assert not hard_negatives.mine(spark.createDataFrame(rows, schema), anchors=F.col("vec_id") == 0).count()
