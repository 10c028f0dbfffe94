"""Texts' vectors by packed parts against those by rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import subwords as S
from quillspark.operators import text_vectors as T


def test_pieces_are_those_of_columns(spark):
    for w in ("a", "ab", "abc", "aaaaaaaa", "straße", "xyzxyzxyz"):
        assert set(spark.range(1).select(S.pieces(F.lit(w))).first()[0]) == T.pieces(w)
        own = [T.pieces(w, T._Parts(3), g) for g in range(3)]
        assert set.union(*own) == T.pieces(w) and sum(map(len, own)) == len(T.pieces(w))


def test_vectors_of_texts_are_those_by_rows(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    texts = [" ".join(words[int(rng.random() ** 2 * 60)] for _ in range(rng.randrange(2, 30))) for _ in range(40)]
    # words that no pair knows, copies, and texts without words
    texts += ["abcd", "zzzz9", "", "?!", None, texts[0], texts[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(3)
    model = S.train(df, "t", 8, rounds=2)
    want = {r["id"]: r["v"] for r in S.embed(df, "t", "v", model, 8).collect()}
    rows = T.embed(df, "t", "v", 8, rounds=2).collect()
    got = {r["id"]: r["v"] for r in rows}
    assert len(rows) == len(texts) and got.keys() == want.keys()
    # axes may point either way
    a, b = (np.array([x[i] for i in range(len(texts))]) for x in (got, want))
    assert np.allclose(a @ a.T, b @ b.T, atol=1e-4) and got[41] == got[42] == [0.0] * 8
    assert np.abs(b).max() > 0.1 and got[45] == pytest.approx(got[0])


def test_no_pairs(spark):
    df = spark.createDataFrame([("one",), (None,)], "t string")
    assert [r["v"] for r in T.embed(df, "t", "v", 4).collect()] == [[0.0] * 4] * 2
