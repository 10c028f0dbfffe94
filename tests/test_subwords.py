"""Subword vectors against numpy, and misspelt names against the hashed stand-in."""

import math
import random
import zlib
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.operators import features
from quillspark.operators import subwords as S


def plain_pairs(texts, window):
    out = Counter()
    for t in texts:
        w = [x for x in "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()]
        for i, a in enumerate(w):
            for b in w[i + 1 : i + 1 + window]:
                out[a, b] += 1
                out[b, a] += 1
    return out


def test_counts_and_associations(spark):
    texts = ["a b a_c", "B b", "", None, "one", "a, b. C d e f g h"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    want = plain_pairs(texts, 2)
    assert {(r["word"], r["context"]): r["n"] for r in S.pair_counts(df, "t", 2).collect()} == dict(want)
    total, margin = sum(want.values()), Counter()
    for (a, _), n in want.items():
        margin[a] += n
    pmi = {k: math.log(n * total / (margin[k[0]] * margin[k[1]])) for k, n in want.items()}
    got = {(r["word"], r["context"]): r["x"] for r in S.associations(S.pair_counts(df, "t", 2)).collect()}
    assert got == pytest.approx({k: x for k, x in pmi.items() if x > 0})


def test_associations_of_texts_are_those_of_pairs(spark):
    """A row for each place instead of each pair, for hot words too."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdefghij") * rng.randrange(1, 3) for _ in range(n)) for n in (0, 1, 2, 3, 7, 40, 200)] + [None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(3)
    want = {(r["word"], r["context"]): r["x"] for r in S.associations(S.pair_counts(df, "t", 3), 2).collect()}
    for hot in (10**6, 100, 0):
        got = S.text_associations(df, "t", 3, 2, hot)
        rows = got.collect()
        assert len(rows) == len(want) and {(r["word"], r["context"]): r["x"] for r in rows} == pytest.approx(want)
        assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[0]
    assert S.text_associations(df.limit(0), "t").count() == 0


def shuffled_rows(plan):
    own = plan.metrics()
    own = own.apply("shuffleRecordsWritten").value() if own.contains("shuffleRecordsWritten") else 0
    return own + sum(shuffled_rows(plan.children().apply(i)) for i in range(plan.children().size()))


def test_blocks_are_shuffled_not_places(spark):
    rng = random.Random(11)
    texts = [" ".join(f"w{int(rng.random() ** 3 * 60)}" for _ in range(60)) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(2).cache()
    want = {(r["word"], r["context"]): r["x"] for r in S.associations(S.pair_counts(df, "t")).collect()}
    df_rows = (made := S.text_associations(df, "t")).collect()
    assert {(r["word"], r["context"]): r["x"] for r in df_rows} == pytest.approx(want) and len(df_rows) == len(want)
    # 24 000 places; a block for each two sides of 4, and its sums
    assert shuffled_rows(made._jdf.queryExecution().executedPlan()) < 100


def test_texts_of_several_chunks(monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 50)
    rng = random.Random(12)
    texts = [[rng.choice("abcdeé") * rng.randrange(1, 4) for _ in range(n)] for n in (2, 30, 2, 7, 120, 3, 49, 2)]
    batches = [pa.record_batch({"w": pa.array(t, pa.list_(pa.string()))}) for t in (texts[:3], texts[3:])]
    rows = [r for b in S._counted(3, 2)(iter(batches)) for r in b.to_pylist()]
    assert len({r["rows"] for r in rows}) > 6
    every = sorted({w for t in texts for w in t}, key=str.encode)
    for i in range(3):
        own = [w.encode() for w in every if zlib.crc32(w.encode()) % 3 == i]
        rows += [{"i": min(i, j), "j": max(i, j), "kind": -2 if i <= j else -1, "rows": S._names(own), "columns": None, "gaps": None, "n": S._thin(np.arange(len(own)))} for j in range(3)]
    rows.sort(key=lambda r: (r["i"], r["j"], r["kind"]))
    got = Counter()
    for _, _, r, _, c, _, low, high, n in S._blocks_of(iter([pa.RecordBatch.from_pylist(rows, S._ARROW)])):
        for x, y, k in zip(low.tolist(), high.tolist(), n.tolist()):
            got[r[x].decode(), c[y].decode()] += k
            got[c[y].decode(), r[x].decode()] += k
    assert got == plain_pairs([" ".join(t) for t in texts], 2)


def test_vectors_go_to_blocks_not_to_pairs(spark, monkeypatch):
    monkeypatch.setattr(S, "STRETCH", 7)
    rng = random.Random(9)
    rows = {(f"w{rng.randrange(30)}", f"w{rng.randrange(30)}"): rng.random() for _ in range(300)}
    pairs = spark.createDataFrame([(a, b, x) for (a, b), x in rows.items()], "word string, context string, x double")
    v = {f"w{i}": [rng.random(), rng.random()] for i in range(30)}
    blocks = S._blocks(pairs, 3)
    assert blocks.count() <= 9
    got = {r["word"]: r["v"] for r in S._times(blocks, spark.createDataFrame(list(v.items()), "word string, v array<double>"), 3).collect()}
    want = {a: [sum(x * v[c][k] for (b, c), x in rows.items() if b == a) for k in (0, 1)] for a in {a for a, _ in rows}}
    assert got.keys() == want.keys() and all(got[a] == pytest.approx(want[a]) for a in want)


def test_leading_part(spark):
    """Inner products of the vectors against those of numpy's decomposition, for any partitioning and with more dims than words."""
    rng = random.Random(6)
    names = [f"w{i}" for i in range(9)]
    m = np.zeros((9, 9))
    for _ in range(25):
        i, j = rng.randrange(9), rng.randrange(9)
        m[i, j] = m[j, i] = rng.random() + 0.1
    rows = [(names[i], names[j], float(m[i, j])) for i in range(9) for j in range(9) if m[i, j]]
    size, axes = np.linalg.eigh(m)
    want = (axes * np.abs(size)) @ axes.T
    for parts, dims in ((1, 12), (3, 9)):
        got = {r["word"]: r["v"] for r in S.word_vectors(spark.createDataFrame(rows, "word string, context string, x double").repartition(parts), dims, 2).collect()}
        v = np.array([got.get(n, [0.0] * dims) for n in names])
        assert v.shape == (9, dims) and np.allclose(v @ v.T, want, atol=1e-6)


def test_pieces(spark):
    got = spark.range(1).select(S.pieces(F.lit("ab")).alias("a"), S.pieces(F.lit("a")).alias("b"), S.pieces(F.lit("abcd")).alias("c")).first()
    assert set(got["a"]) == {"<ab", "ab>", "<ab>"} and set(got["b"]) == {"<a>"}
    assert set(got["c"]) == {"<ab", "abc", "bcd", "cd>", "<abc", "abcd", "bcd>", "<abcd", "abcd>", "<abcd>"}


def cosine(a, b):
    return float(np.dot(a, b) / ((np.linalg.norm(a) * np.linalg.norm(b)) or 1.0))


def test_misspelt_names_stay_near(spark):
    """Three topics of API names; a misspelt or inflected one has to be nearest to the topic of its origin."""
    topics = {"io": "readcsv readparquet loadtable writecsv savetable openfile".split(), "fit": "trainmodel fitmodel predictlabel crossvalidate scoremodel classifier".split(), "plot": "plotline scatterplot histogram barchart showfigure heatmap".split()}
    rng = random.Random(1)
    texts = [" ".join(rng.choices(topics[t], k=8)) for t in topics for _ in range(60)]
    odd = {"readcvs": "io", "loadtables": "io", "openfiles": "io", "trainmodels": "fit", "predictlabels": "fit", "classifiers": "fit", "plotlines": "plot", "histogramm": "plot", "heatmaps": "plot", "barcharts": "plot"}
    model = S.train(spark.createDataFrame([(t,) for t in texts], "t string"), "t", 16).cache()
    asked = spark.createDataFrame([(w,) for w in [*odd, *sum(topics.values(), [])]] + [("",), (None,), ("qqq",)], "t string")

    def right(put):
        v = {r["t"]: r["v"] for r in put(asked, "t", "v").collect()}
        near = {w: max(topics, key=lambda t: np.mean([cosine(v[w], v[x]) for x in topics[t]])) if any(v[w]) else None for w in odd}
        return sum(near[w] == t for w, t in odd.items()), v

    found, v = right(partial(S.embed, model=model, dims=16))
    stand_in, _ = right(partial(features.embed, width=16))
    assert found == len(odd) and stand_in < found
    assert v[""] == v[None] == v["qqq"] == [0.0] * 16 and len(v) == len(odd) + 18 + 3


def test_empty(spark):
    none = S.train(spark.createDataFrame([("one",), (None,)], "t string"), "t", 4)
    assert none.count() == 0
    got = S.embed(spark.createDataFrame([("a b", 1), (None, 2)], "t string, n int"), "t", "v", none, 4).collect()
    assert [r["v"] for r in got] == [[0.0] * 4] * 2
