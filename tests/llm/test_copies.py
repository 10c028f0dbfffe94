"""Equal rows: their numbers, the ranges they are dealt to, and results that don't depend on the files."""


from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from quillspark.llm import common, fingerprint, token_files


@pytest.fixture(scope="module")
def repeated(spark):
    """Half of the rows are one row of a null id without text; other ids stand for several texts, some of them twice."""
    rows = [(None, None)] * 3000 + [(i % 40, f"Text {i % 60}. And more of it." if i % 3 else f"{i}\nb") for i in range(300)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_numbers_of_copies(spark, repeated, monkeypatch):
    monkeypatch.setattr(common, "AT_ONCE", 100)
    got = [tuple(r) for r in common.numbered(repeated.repartition(3)).collect()]
    assert Counter(r[:2] for r in got) == Counter(tuple(r) for r in repeated.collect())
    assert sorted(n for i, t, n in got if i is None) == list(range(1, 3001))
    assert {n for i, t, n in got if i is not None} == {1}
    assert common.numbered(repeated.limit(0)).count() == 0


def test_equal_rows_are_parted_over_ranges(repeated):
    t = common.numbered(repeated)
    cuts = fingerprint.quantiles(t, "doc_id", 64)
    u = F.shiftrightunsigned(F.xxhash64("text", "__copy"), 33)
    place = t.where("doc_id is null").select(fingerprint.range_of(F.coalesce("doc_id", F.lit(-(2**63))), u, cuts).alias("p")).groupBy("p").count().collect()
    assert len(place) >= 16 and max(r["count"] for r in place) < 300


def test_fingerprints_from_any_partitions(repeated):
    made = [Counter(tuple(r) for r in fingerprint.edited_with_next(repeated.repartition(n)).collect()) for n in (1, 3, 5)]
    assert made[0] == made[1] == made[2] and made[0].total() == 3300


def test_token_files_from_any_partitions(repeated, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "RANGE_BYTES", 200)
    path, made = public_tokenizers.path("word_bpe_49k.json"), []
    for n in (1, 3, 5):
        files = token_files.write_files(repeated.repartition(n), "doc_id", "text", path, str(tmp_path / f"f{n}"))
        rows = sorted(token_files.read_files(files, measure=True).collect(), key=lambda r: r["start"])
        assert files.select("range").distinct().count() > 16
        made.append([(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows])
    assert made[0] == made[1] == made[2] and len(made[0]) == 3300
    keys = [(i is not None, i or 0) for i, *_ in made[0]]
    assert keys == sorted(keys)


def plain_lanes(text):
    """The centred lanes of a text's pieces, one by one."""
    pieces = [p for p in regex.split(fingerprint.PIECE, text + "\n", flags=regex.V1) if p]
    lanes = np.zeros((fingerprint.SEEDS, 64))
    for p in pieces:
        for k in range(fingerprint.SEEDS):
            h = xxhash.xxh64_intdigest(p.encode(), seed=xxhash.xxh64_intdigest(k.to_bytes(4, "little"), seed=42))
            lanes[k] += [2 * (h >> s & 1) - 1 for s in range(64)]
    return lanes.ravel()


def plain_likeness(a, b):
    x, y = plain_lanes(a), plain_lanes(b)
    return min(1.0, max(0.0, x @ y / np.sqrt((x @ x) * (y @ y))))


def test_likeness_against_a_plain_version(spark):
    texts = ["One is here. Two is not.\nThree", "One is here. Four was.\nThree", "Nothing alike at all!", "é\U0001f600. One is here. Two is not.\nThree\n\n", "x"]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r for r in fingerprint.edited_with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        nxt, h = texts[(i + 1) % len(texts)], len(t) // 2
        assert got[i]["near_next"] == pytest.approx(plain_likeness(t, nxt), abs=1e-12)
        assert got[i]["near_edited"] == pytest.approx(plain_likeness(t, t[: len(t) - h] + nxt[:h]), abs=1e-12)
