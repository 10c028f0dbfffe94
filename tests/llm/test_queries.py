"""The registered queries over a small folder of tables: the digest columns that they derive from the operators."""

import hashlib
import random
import zlib
from collections import Counter

import pytest

from quillspark.llm import packing, queries, secret_scan, sharding
from quillspark.llm.queries import QUERIES

from . import brute
from .conftest import prose, rows

PAGE = "<html><body><nav><a href=/>Home</a></nav><article><h1>Title</h1><p>First part of the text, which is long enough.</p><p>And &eacute;t a second one, with more words in it.</p></article><footer>&copy; x</footer></body></html>"


#: Passages of documents, short items, copies, nulls, items without words.
ITEMS = [(1, prose(2, 60)), (2, "ONE two"), (3, "the"), (4, None), (5, "?!"), (10, prose(2, 60).upper()), (11, " ".join(prose(9, 50).split(" ")[5:25])), (11, "x" * 400), (None, prose(3, 30)), (12, prose(99, 40)), (13, "a line here a line here a line")]


def _turns():
    r, out = random.Random(5), []
    for conv in [None, *range(60)]:
        for turn in range(r.choice([1, 2, 3, 5, 8])):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            out.append((conv, r.choice([turn, turn, turn, turn + 1, None]), role, r.choice(["Yes.", "No", " \t", None, f"Text {turn}!", "What?  \n", "a.b"])))
    return out + out[:9] + [(7, None, "user", "Yes.")] * 5


TURNS = _turns()


def _vectors():
    r = random.Random(6)
    centres = [[r.gauss(0, 1) for _ in range(6)] for _ in range(3)]
    out = [(i, [c + r.gauss(0, 0.5) for c in r.choice(centres)], r.randrange(4)) for i in range(900)]
    out += [(901, None, 1), (902, [1.0] * 6, None), (903, [1.0, None, 1.0, 0.0, 0.0, 0.0], 1), (904, [float("nan")] * 6, 1), (905, [float("inf")] + [0.0] * 5, 1), (906, [], 2), (907, [0.5, 0.5], 2), (100, [0.25] * 6, 3), (None, [1.0] * 6, 2)]
    return out + out[:3] + [(950 + i, [0.5] * 6, i % 3) for i in range(60)]


VECTORS = _vectors()


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    docs.repartition(3).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "v", "")], "page_id long, url string, html string").write.parquet(str(path / "pages.parquet"))
    spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("n_words", queries.F.lit("clash")).write.parquet(str(path / "benchmark.parquet"))
    spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("at", queries.F.lit("clash")).repartition(3).write.parquet(str(path / "conversations.parquet"))
    spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>, label int").withColumn("cell", queries.F.lit("clash")).repartition(3).write.parquet(str(path / "embeddings.parquet"))
    return str(path)


def run(name, spark, folder):
    df = QUERIES[name](spark, folder)
    return df.columns, [r.asDict(recursive=True) for r in df.collect()]


TEXTS = [(i, t or "", s) for i, t, _, s, _ in rows()]


def test_fingerprints(spark, folder):
    columns, got = run("op1_fingerprints", spark, folder)
    assert columns[:7] == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert Counter((r["doc_id"], r["n_chars"]) for r in got) == Counter((i, len(t)) for i, t, _ in TEXTS)
    by_text: dict = {}
    text = {i: t for i, t, _ in TEXTS if i != 100}
    for r in got:
        if r["doc_id"] != 100:
            by_text.setdefault(text[r["doc_id"]], set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())


def test_packing(spark, folder):
    _, got = run("op2_best_fit_packing", spark, folder)
    assert Counter(r["doc_id"] for r in got if r["piece"] == 0) == Counter(i for i, _, _ in TEXTS)
    assert sum(r["words"] for r in got) == sum(len(brute.WORD.findall(t)) for _, t, _ in TEXTS) and max(r["words"] for r in got) <= packing.CAPACITY


def test_ngram_join(spark, folder):
    _, got = run("op3_ngram_jaccard_join", spark, folder)
    assert Counter((r["doc_id"], r["n_shingles"]) for r in got) == Counter((i, len(brute.shingles(t))) for i, t, _ in TEXTS)
    assert {r["doc_id"]: r["component_id"] for r in got} == brute.components([(i, t) for i, t, _ in TEXTS])


def test_token_files(spark, folder):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    _, got = run("op4_token_files", spark, folder)
    crc = lambda t: zlib.crc32(b"".join(x.to_bytes(4, "little") for x in [*library.encode(t, add_special_tokens=False).ids, 2]))
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in got) == Counter((i, crc(t)) for i, t, _ in TEXTS)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == sorted(i for i, _, _ in TEXTS)


def test_secrets(spark, folder):
    columns, got = run("op5_secret_scan", spark, folder)
    assert columns[:6] == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    want = Counter()
    for i, t, _ in TEXTS:
        base = brute.base_spans(t)
        kinds = Counter(x.split(":")[0] for x in base.split(",") if x)
        want[i, kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(base.encode()).hexdigest()] += 1
    assert Counter(tuple(r[c] for c in ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")) for r in got) == want
    for r in got:
        spans = [x.split(":") for x in r["spans"].split(",") if x]
        assert {k for k, _, _ in spans} <= set(secret_scan.KINDS) and [int(a) for _, a, _ in spans] == sorted(int(a) for _, a, _ in spans)


def test_mixing(spark, folder):
    _, got = run("op6_source_mixing", spark, folder)
    sizes: Counter = Counter()
    for _, t, s in TEXTS:
        sizes[s] += len(brute.WORD.findall(t))
    target = brute.targets(sizes)
    assert Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6)) for r in got) == Counter((i, len(brute.WORD.findall(t)), sizes[s], round(target[s], 6)) for i, t, s in TEXTS)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)


def test_quality(spark, folder):
    _, got = run("op7_quality_rules", spark, folder)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter((r["doc_id"], *(r[c] for c in names)) for r in got) == Counter((i, *brute.quality(t)) for i, t, _ in TEXTS)


def test_substring_dedup(spark, folder):
    _, got = run("op8_substring_dedup", spark, folder)
    want = brute.repeats([(i, t) for i, t, _ in TEXTS])
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert Counter(tuple(r[c] for c in names) for r in got) == Counter((TEXTS[k][0], *v) for k, v in want.items())
    assert len(got) == len(TEXTS)


@pytest.mark.parametrize("parts", [1, 3, 5])
def test_repeated_ids_do_not_depend_on_the_files(spark, parts):
    from quillspark.llm import substring_dedup

    shared = prose(70, 80)
    rows_ = [(1, prose(71 + k, 20) + shared + prose(90 + k, 15)) for k in range(6)] + [(None, shared), (None, shared + " x"), (1, None), (0, prose(5, 9)), (1, shared), (1, shared)]
    random.Random(parts).shuffle(rows_)
    got = substring_dedup.repeats(spark.createDataFrame(rows_, "doc_id long, text string").repartition(parts)).collect()
    want = brute.repeats(rows_)
    assert Counter((r.doc_id, r.n_bytes, len(r.removed), r.kept_sha256) for r in got) == Counter((rows_[k][0], v[0], v[2], v[3]) for k, v in want.items())


def test_html(spark, folder):
    columns, got = run("op9_html_extraction", spark, folder)
    assert columns[:4] == ["page_id", "url", "text", "n_chars"]
    text = "Title\nFirst part of the text, which is long enough.\nAnd ét a second one, with more words in it."
    assert sorted((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in got if r["url"]) == [(1, "u", text, len(text)), (3, "v", "", 0)]


def plain_shard(key, n, seed=0):
    """The shard of the largest hash, by the xxhash library: each part is hashed with what came before as its seed."""
    import xxhash

    def mark(j):
        h = 42
        for part in (seed.to_bytes(4, "little"), j.to_bytes(4, "little"), *([] if key is None else [key.to_bytes(8, "little", signed=True)])):
            h = xxhash.xxh64_intdigest(part, h)
        return h - (h >> 63 << 64)

    return max(range(n), key=lambda j: (mark(j), -j))


def test_sharding(spark, folder):
    _, got = run("op10_sharding", spark, folder)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"]) for r in got) == Counter((i, len(t.encode()) + 1, zlib.crc32(t.encode()), "key") for i, t, _ in TEXTS)
    assert all(r["grown_shard"] in (r["shard"], 16) for r in got)
    for k in range(16):
        own = [r["slot"] for r in got if r["shard"] == k]
        assert sorted(own) == list(range(len(own)))
    assert all(r["shard"] == plain_shard(r["doc_id"], 16) and r["grown_shard"] == plain_shard(r["doc_id"], 17) for r in got)
    keys = [None, -(2**63), 2**63 - 1, *range(-40, 40)]
    put = spark.createDataFrame([(k,) for k in keys], "k long").select("k", sharding.shard_of(queries.F.col("k"), 16).alias("s")).collect()
    assert all(r["s"] == plain_shard(r["k"], 16) for r in put)


def test_decontamination(spark, folder):
    columns, got = run("op11_decontamination", spark, folder)
    assert columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = Counter((i, *brute.contamination(t, ITEMS)) for i, t, _ in TEXTS)
    assert Counter(tuple(r[c] for c in columns) for r in got) == want and sum(r["contaminated"] for r in got) > 5


def test_conversation_repair(spark, folder):
    columns, got = run("op12_conversation_repair", spark, folder)
    assert columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(str, (tuple(r.values()) for r in got))) == sorted(map(str, ((c, *brute.repaired(rows)) for c, rows in brute.damaged(TURNS).items())))


def test_hard_negatives(spark, folder):
    columns, got = run("op13_hard_negatives", spark, folder)
    assert columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute.hard_negatives(VECTORS)
    assert Counter(tuple(r[c] for c in columns) for r in got) == Counter(want) and len(want) > 100


def test_every_query_is_here():
    assert set(queries.ORACLE) <= set(QUERIES) and sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
