"""N-gram Jaccard join by a token-group matrix.

Documents are sets of distinct word shingles. A shingle that only one document
has can't be shared, so counts over all documents leave few candidates: those
with enough shared shingles. Candidates with one least shingle form a group;
the group's token union bounds what a document can share with its members, and
only groups that pass are opened: their members' incidence matrix gives every
overlap exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir
from .components import components
from .word_hash import mixed, word_hashes

#: Words in a shingle; likeness of a link, as a share of SCALE.
WORDS, SHARE, SCALE = 5, 75, 100
#: Tokens and bytes to a chunk of documents, documents at most; members to a block of a group.
CHUNK_BYTES, CHUNK_DOCS, MEMBERS = 4 << 20, 4096, 256
#: Places that the rows of one group are counted in.
SALTS = 64
#: Bytes of text to a bucket of tokens, about, and the bits of a token below its bucket.
BUCKET_BYTES, TAIL = 4 << 20, 40

_PLACE = np.random.default_rng(20240301).integers(0, 1 << 64, WORDS, dtype=np.uint64) | np.uint64(1)
_SALT = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(document index, shingle hash), distinct, by document then hash; words by ASCII white space, A-Z lowered."""
    doc, word = word_hashes(texts)
    if not len(doc):
        return doc, word
    n = np.bincount(doc, minlength=len(texts))
    at = np.flatnonzero(doc[: len(doc) - WORDS + 1] == doc[WORDS - 1 :]) if len(doc) >= WORDS else np.zeros(0, np.int64)
    total = np.zeros(len(at), np.uint64)
    for k in range(WORDS):
        total += word[at + k] * _PLACE[k]
    short = np.flatnonzero((n > 0) & (n < WORDS))
    first_word = np.cumsum(n) - n
    whole = n[short].astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
    for k in range(WORDS - 1):
        has = n[short] > k
        whole[has] += word[first_word[short[has]] + k] * _PLACE[k]
    docs, hashes = np.concatenate([doc[at], short]), mixed(np.concatenate([total, whole]))
    by = np.argsort(hashes)
    by = by[np.argsort(docs[by].astype(np.uint16), kind="stable")] if len(texts) <= 1 << 16 else np.lexsort((hashes, docs))
    docs, hashes = docs[by], hashes[by]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])
    return docs[new], hashes[new]


def _tails(tokens: np.ndarray) -> bytes:
    return np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _from_tails(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


_DEALT = "bucket long, chunk long, tokens binary, counts binary"


def _deal(bits: int):
    """Chunks of documents as a row of tokens for each bucket, and a row (bucket -1 - chunk) of ids, sizes and set hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        ids: list = []
        texts: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            docs, hashes = shingles(texts)
            n = np.bincount(docs, minlength=len(texts)).astype("<i8")
            edge = np.cumsum(n) - n
            some = n > 0
            keys = np.zeros((len(texts), 2), np.uint64)
            if some.any():
                keys[some, 0] = np.add.reduceat(hashes, edge[some])
                keys[some, 1] = np.add.reduceat(mixed(hashes ^ _SALT), edge[some])
            bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
            tail = (hashes >> np.uint64(64 - bits - TAIL)) & np.uint64((1 << TAIL) - 1)
            by = np.argsort(bucket.astype(np.uint16) if bits <= 16 else bucket, kind="stable")
            counts = np.bincount(bucket * len(texts) + docs, minlength=len(texts) << bits).reshape(-1, len(texts)) if (len(texts) << bits) < 1 << 24 else None
            ends = np.searchsorted(bucket[by], np.arange((1 << bits) + 1))
            rows: list[tuple] = []
            for b in np.flatnonzero(np.diff(ends)):
                mine = by[ends[b] : ends[b + 1]]
                per = counts[b] if counts is not None else np.bincount(docs[mine], minlength=len(texts))
                rows.append((int(b), chunk, _tails(tail[mine]), per.astype("<u2").tobytes() if per.max() < 1 << 16 else per.astype("<u4").tobytes()))
            meta = np.array([0 if i is None else i for i in ids], "<i8").tobytes() + np.array([i is None for i in ids], np.uint8).tobytes()
            rows.append((-1 - chunk, chunk, meta, n.tobytes() + keys.astype("<u8").tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "chunk", "tokens", "counts"])

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                ids.append(i)
                texts.append(t or b"")
                size += len(texts[-1])
                if size >= CHUNK_BYTES or len(ids) >= CHUNK_DOCS:
                    yield flush()
                    ids, texts, size, chunk = [], [], 0, chunk + 1
        if ids:
            yield flush()

    return run


_SHARED = "chunk long, bucket long, tokens binary, docs binary, ranks binary"


def _shared(key: tuple, table: pa.Table) -> pa.Table:
    """Of a bucket's tokens, those that two documents or more have, back to each chunk with a rank by count."""
    schema = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("tokens", pa.binary()), ("docs", pa.binary()), ("ranks", pa.binary())])
    bucket = key[0].as_py()
    rows = table.to_pylist()
    if bucket < 0:  # ids and sizes go on as they are
        return pa.Table.from_pylist([{"chunk": r["chunk"], "bucket": -1, "tokens": r["tokens"], "docs": r["counts"], "ranks": b""} for r in rows], schema)
    parts = [_from_tails(r["tokens"]) for r in rows]
    tokens = np.concatenate(parts)
    by = np.argsort(tokens, kind="stable")
    edge = np.flatnonzero(np.diff(tokens[by], prepend=tokens[by[0]] ^ np.uint64(1)))
    many = np.diff(np.append(edge, len(tokens)))
    df = np.empty(len(tokens), np.int64)
    df[by] = np.repeat(many, many)
    rank = np.minimum(255, (8 * np.log2(df)).astype(np.int64)).astype(np.uint8)
    out, at = [], 0
    for r, part in zip(rows, parts, strict=True):
        own = slice(at, at + len(part))
        at += len(part)
        keep = df[own] > 1
        if keep.any():
            raw = r["counts"]
            # a document's count in a bucket fits 16 bits but for huge texts; the sum tells which was written
            per = np.frombuffer(raw, "<u2")
            if per.sum() != len(part):
                per = np.frombuffer(raw, "<u4")
            docs = np.repeat(np.arange(len(per)), per)
            out.append({"chunk": r["chunk"], "bucket": bucket, "tokens": _tails(part[keep]), "docs": docs[keep].astype("<u2").tobytes(), "ranks": rank[own][keep].tobytes()})
    return pa.Table.from_pylist(out, schema)


_DOCS = "doc_id long, n long, key_a long, key_b long, tokens binary, least long, n_first int"


def _candidates(key: tuple, table: pa.Table) -> pa.Table:
    """A row for each document of a chunk; tokens, rarest first, for those with enough shared ones."""
    rows = table.to_pylist()
    meta = next(r for r in rows if r["bucket"] < 0)
    count = len(meta["tokens"]) // 9
    ids, null = np.frombuffer(meta["tokens"][: 8 * count], "<i8"), np.frombuffer(meta["tokens"][8 * count :], np.uint8) > 0
    n = np.frombuffer(meta["docs"][: 8 * count], "<i8")
    keys = np.frombuffer(meta["docs"][8 * count :], "<i8").reshape(-1, 2)
    rest = [r for r in rows if r["bucket"] >= 0]
    if rest:
        docs = np.concatenate([np.frombuffer(r["docs"], "<u2") for r in rest]).astype(np.int64)
        tokens = np.concatenate([_from_tails(r["tokens"]) | np.uint64(r["bucket"] << TAIL) for r in rest])
        ranks = np.concatenate([np.frombuffer(r["ranks"], np.uint8) for r in rest])
    else:
        docs, tokens, ranks = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint8)
    have = np.bincount(docs, minlength=count)
    need = -(-n * SHARE // SCALE)
    good = (have >= need) & (n > 0) & ~null
    mine = good[docs]
    docs, tokens, ranks = docs[mine], tokens[mine], ranks[mine]
    by = np.lexsort((tokens, ranks, docs))
    docs, tokens = docs[by], tokens[by]
    ends = np.searchsorted(docs, np.arange(count + 1))
    blobs, least, first = [None] * count, [None] * count, [None] * count
    for d in np.flatnonzero(good):
        own = tokens[ends[d] : ends[d + 1]]
        blobs[d] = own.astype("<u8").tobytes()
        least[d] = int(mixed(own).min().astype(np.int64))
        first[d] = int(len(own) - need[d] + 1)
    return pa.table([pa.array(ids, pa.int64(), mask=null), pa.array(n, pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(blobs, pa.binary()), pa.array(least, pa.int64()), pa.array(first, pa.int32())], names=["doc_id", "n", "key_a", "key_b", "tokens", "least", "n_first"])


# --------------------------------------------------------------- the matrix

def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """The number of common tokens of every set of a with every set of b."""
    flat = np.concatenate([*a, *b])
    seen, code = np.unique(flat, return_inverse=True)
    row = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in [*a, *b]])
    often = np.bincount(code) > 1
    column = np.cumsum(often) - 1
    keep = often[code]
    row, column = row[keep], column[code[keep]]
    out = np.zeros((len(a), len(b)), np.float32)
    width = max(256, (8 << 20) // max(1, len(a) + len(b)))
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    for lo in range(0, int(often.sum()), width):
        i, j = np.searchsorted(column, [lo, lo + width])
        m = np.zeros((len(a) + len(b), width), np.float32)
        m[row[i:j], column[i:j] - lo] = 1
        out += m[: len(a)] @ m[len(a) :].T
    return out.astype(np.int64)


def _roots(n: int, pairs: np.ndarray) -> np.ndarray:
    """The least index that each of n reaches by the pairs."""
    root = np.arange(n)
    while len(pairs):
        lo = np.minimum(root[pairs[:, 0]], root[pairs[:, 1]])
        new = root.copy()
        np.minimum.at(new, root[pairs[:, 0]], lo)
        np.minimum.at(new, root[pairs[:, 1]], lo)
        np.minimum.at(new, pairs[:, 0], lo)
        np.minimum.at(new, pairs[:, 1], lo)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


_LINKS = "a long, b long, outside boolean"


def _open(key: tuple, table: pa.Table) -> pa.Table:
    """Links of a block of a group (side 0) with itself and a block of visitors or the group's hub (side 1).

    The block's token union bounds a visitor's overlap first. Returned are a
    spanning forest, as stars around least documents of the block, and, for the
    tasks with the hub of a group of more than one block (`mode` 2), which of
    the block's documents the hub's main class does not reach.
    """
    rows = table.sort_by([("side", "ascending"), ("doc_id", "ascending")])
    side, ids, n = rows["side"].to_numpy(), rows["doc_id"].to_numpy(), rows["n"].to_numpy()
    sets = [np.frombuffer(x.as_py(), "<u8") for x in rows["tokens"]]
    mode = rows["mode"][0].as_py()
    hub = mode > 0
    own = np.flatnonzero(side == 0)
    other = np.flatnonzero(side == 1)
    if len(other) and len(own) and not hub:
        union = np.unique(np.concatenate([sets[i] for i in own]))
        need = -(-n[other] * SHARE // SCALE)
        bound = np.array([np.isin(sets[i], union, assume_unique=True).sum() for i in other])
        other = other[bound >= need]
    order = np.concatenate([other, own]) if hub else np.concatenate([own, other])
    ids, n, sets = ids[order], n[order], [sets[i] for i in order]
    n_own = len(own)
    empty = pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.bool_())], names=["a", "b", "outside"])
    if len(order) < 2:
        return empty
    if hub or not len(other):  # all with all
        common = overlaps(sets, sets)
        linked = 7 * common >= 3 * (n[:, None] + n[None, :]) if (SHARE, SCALE) == (75, 100) else (SCALE + SHARE) * common >= SHARE * (n[:, None] + n[None, :])
        pairs = np.argwhere(np.triu(linked, 1))
    else:
        if not n_own:
            return empty
        common = overlaps(sets[:n_own], sets[n_own:])
        linked = (SCALE + SHARE) * common >= SHARE * (n[:n_own, None] + n[None, n_own:])
        pairs = np.argwhere(linked)
        pairs[:, 1] += n_own
    root = _roots(len(order), pairs)
    mine = np.ones(len(order), bool)
    outside: list[int] = []
    if mode == 2:
        n_hub = len(other) or n_own
        alone = _roots(n_hub, pairs[(pairs < n_hub).all(1)])
        main = np.bincount(alone).argmax()
        reached = root == root[main]
        mine[: len(other)] = False
        outside = ids[len(other) :][~reached[len(other) :]].tolist()
    # stars around the block's own least document of a class, and a link from there to each class that the hub's documents form alone
    a, b = [], []
    star = np.full(len(order), len(order))
    np.minimum.at(star, root[mine], np.flatnonzero(mine))
    for i in np.flatnonzero(mine):
        if star[root[i]] != i:
            a.append(ids[i])
            b.append(ids[star[root[i]]])
    if hub and len(other):
        for r in np.unique(alone):
            if star[root[r]] < len(order):
                a.append(ids[star[root[r]]])
                b.append(ids[r])
    a, b = [*a, *outside], [*b, *outside]
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([False] * (len(a) - len(outside)) + [True] * len(outside), pa.bool_())], names=["a", "b", "outside"])


def _counted(df: DataFrame, key: str, out: str) -> DataFrame:
    """df with the number of rows of each key; rows of one key meet in SALTS places, so that no task holds a large group."""
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(F.lit(key), "doc_id"), F.lit(SALTS)))
    counts = salted.groupBy(key, "__salt").agg(F.count("*").alias("__c"))
    counts = counts.select(key, "__salt", F.sum("__c").over(Window.partitionBy(key)).alias(out))
    return salted.join(counts, [key, "__salt"]).drop("__salt")


def join(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of df.

    Two documents link when SCALE * common >= SHARE * union; component_id is
    the least id that a document reaches. A text without words has no
    shingles and links with nothing; so does a row with a null id, whose
    component is null. Rows with one id are one document, which has the links
    of all its texts; each row keeps its own n_shingles. An empty table
    gives an empty one. Tokens are 40 bits beside the bits of their bucket;
    within one pair of documents two tokens agree by chance about once in 1e9.
    """
    spark = df.sparkSession
    shared_dir(spark)
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    weight = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    bits = max(6, min(20, int(weight // BUCKET_BYTES).bit_length()))
    dealt = docs.mapInArrow(_deal(bits), _DEALT)
    shared = dealt.groupBy("bucket").applyInArrow(_shared, _SHARED)
    known = shared.groupBy("chunk").applyInArrow(_candidates, _DOCS).checkpoint()
    tried = known.where("tokens is not null")

    # equal sets are one class, which its least id stands for
    same = ["key_a", "key_b", "n"]
    salted = tried.select("doc_id", *same).withColumn("salt", F.pmod(F.xxhash64(F.lit("same"), "doc_id"), F.lit(SALTS)))
    each, whole = salted.groupBy(*same, "salt").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), Window.partitionBy(*same)
    classes = each.select(*same, "salt", F.min("rep").over(whole).alias("rep"), F.sum("copies").over(whole).alias("copies")).where("copies > 1")
    copies = salted.join(classes, [*same, "salt"]).select("doc_id", *same, "rep").distinct().checkpoint()
    alone = tried.join(copies.where("doc_id <> rep").select("doc_id", *same), ["doc_id", *same], "left_anti").dropDuplicates(["doc_id", *same]).select("doc_id", "n", "tokens", "least", "n_first")

    # groups by least token, in blocks of about MEMBERS
    members = _counted(alone, "least", "m")
    blocks = lambda m: F.ceil(m / MEMBERS)
    members = members.withColumn("blocks", blocks(F.col("m"))).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks"))).checkpoint()
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))

    def row(frame: DataFrame, group, block, visit, side: int, mode) -> DataFrame:
        return frame.select(group.alias("g"), block.cast("long").alias("i"), visit.cast("long").alias("j"), F.lit(side).alias("side"), "doc_id", "n", "tokens", mode.alias("mode"))

    # first each block with the hub, block 0 of its group
    g, none = F.col("least"), F.lit(-1)
    first = row(members.where("m > 1"), g, F.col("block"), none, 0, F.when(F.col("blocks") > 1, 2).otherwise(1))
    hubs = members.where("blocks > 1 and block = 0").withColumn("to", F.explode(F.sequence(F.lit(1).cast("long"), F.col("blocks") - 1)))
    first = first.unionByName(row(hubs, g, F.col("to"), none, 1, F.lit(2)))
    opened = first.groupBy("g", "i", "j").applyInArrow(_open, _LINKS).checkpoint()
    late = opened.where("outside").select(F.col("a").alias("doc_id")).distinct()

    # then visitors: documents that their group's main class doesn't reach, and groups that share a rare token
    fronts = members.select("least", "m", F.explode(F.expr("transform(sequence(0, n_first - 1), i -> substring(tokens, 8 * i + 1, 8))")).alias("t")).distinct()
    left, right = fronts.alias("x"), fronts.alias("y")
    smaller = F.struct(F.col("x.m"), F.col("x.least")) < F.struct(F.col("y.m"), F.col("y.least"))
    meets = left.join(right, (F.col("x.t") == F.col("y.t")) & smaller).select(F.col("x.least").alias("least"), F.col("x.m").alias("x_m"), F.col("y.least").alias("g"), blocks(F.col("y.m")).alias("g_blocks")).distinct()
    # a group's blocks are looked up one by one
    meets = meets.withColumn("block", upto(blocks(F.col("x_m")))).drop("x_m")
    visitors = members.join(meets, ["least", "block"]).select("g", "g_blocks", "doc_id", "n", "tokens")
    visitors = visitors.unionByName(members.join(late, "doc_id").select(F.col("least").alias("g"), F.col("blocks").alias("g_blocks"), "doc_id", "n", "tokens")).checkpoint()
    guests = visitors.groupBy("g", "g_blocks").agg(F.ceil(F.count("*") / MEMBERS).alias("parts"))
    seated = _counted(visitors, "g", "v").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("v") / MEMBERS))).withColumn("to", upto(F.col("g_blocks")))
    hosts = members.join(guests.select(F.col("g").alias("least"), "parts", upto(F.col("g_blocks")).alias("block")), ["least", "block"]).withColumn("part", upto(F.col("parts")))
    second = row(hosts, g, F.col("block"), F.col("part"), 0, F.lit(0)).unionByName(row(seated, F.col("g"), F.col("to"), F.col("part"), 1, F.lit(0)))
    met = second.groupBy("g", "i", "j").applyInArrow(_open, _LINKS)

    reps = known.select("doc_id", *same).join(copies, ["doc_id", *same], "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep"))
    # the texts of one id are linked by it
    texts = reps.where("doc_id is not null").select("doc_id", "rep").distinct()
    several = texts.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high")
    by_id = texts.join(several, "doc_id").where("rep <> low").select(F.col("low").alias("a"), F.col("rep").alias("b"))
    links = opened.where("not outside").select("a", "b").unionByName(met.select("a", "b")).unionByName(by_id)
    found = components(links)
    out = reps.join(found, reps["rep"] == found["node"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
