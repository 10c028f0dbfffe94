"""Vectors of a corpus's texts from its own words, in packed parts: what subwords.embed() gives with subwords.train(), without a row for each pair, piece or use of a word.

Words are dealt to sides by a hash and stand in a side by their bytes; a side's
vectors are one matrix. Matrices go to the tasks that hold the pairs, pieces or
texts of a part and are added up there, so that a vector moves as often as there
are parts (PARTED words to each), not as often as its word has neighbours, pieces and texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import subwords as S
from .shared import kept

#: Words whose vectors a task holds at once, about, and parts at least.
PARTED, PARTS = 1_000_000, 4


def _put(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def _matrix(v: bytes, wide: int) -> np.ndarray:
    return np.frombuffer(v, np.float32).reshape(-1, wide)


def _mapped(df: DataFrame, fn, schema: pa.Schema, ddl: str) -> DataFrame:
    """fn(row) -> a row, for rows of packed parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                out = fn(r)
                yield _put({k: [x] for k, x in out.items()}, schema)

    return df.mapInArrow(run, ddl)


_KEPT = pa.schema([("kind", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("gaps", pa.binary()), ("n", pa.binary()), ("names", pa.binary())])
_SIDE = pa.schema([("side", pa.int32()), ("n", pa.binary()), ("v", pa.binary())])
_SIDE_DDL = "side int, n binary, v binary"


def _summed(blocks: DataFrame) -> DataFrame:
    """Blocks added up: kind 1 has a block's pairs by their numbers in their sides and counts, kind 0 a side's words and sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, j, r, a, c, _, low, high, n in S._blocks_of(batches):
            if i == j:
                yield _put({"kind": [0], "i": [i], "j": [i], "gaps": [None], "n": [S._thin(a)], "names": [S._names(r)]}, _KEPT)
                n = np.where(low == high, 2 * n, n)
            yield _put({"kind": [1], "i": [i], "j": [j], "gaps": [S._thin(np.diff(low * len(c) + high, prepend=0))], "n": [S._thin(n)], "names": [None]}, _KEPT)

    return blocks.mapInArrow(run, "kind int, i int, j int, gaps binary, n binary, names binary")


def _signs(table: DataFrame, wide: int, seed: int) -> DataFrame:
    """Each side's first matrix: random signs of its words, and ones."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                names = S._read(r["names"])
                for s in range(0, len(names), S.SENT):
                    part = names[s : s + S.SENT]
                    n = [r["n"] if not s and not k else None for k in range(len(part))]
                    yield pa.RecordBatch.from_arrays([pa.array([r["i"]] * len(part), pa.int32()), pa.array(n, pa.binary()), pa.array(part, pa.binary()).cast(pa.string())], names=["side", "n", "word"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, held = None, None, []
        for b in batches:
            flat = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(b.num_rows, -1)
            side, sums = b.column("side").to_numpy(), b.column("n")
            cuts = [0, *(np.flatnonzero(np.diff(side)) + 1).tolist(), b.num_rows]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if s == e:
                    continue
                if held and side[s] != at:
                    yield _put({"side": [at], "n": [n], "v": [b"".join(held)]}, _SIDE)
                    held = []
                if not held:
                    at, n = int(side[s]), sums[s].as_py()
                held.append(flat[s:e].tobytes())
        if held:
            yield _put({"side": [at], "n": [n], "v": [b"".join(held)]}, _SIDE)

    sign = F.transform(F.sequence(F.lit(0), F.lit(wide - 1)), lambda i: F.when(F.xxhash64(F.lit(seed), "word", i) % 2 == 0, 1.0).otherwise(-1.0))
    named = table.where("kind = 0").select("i", "n", "names").mapInArrow(words, "side int, n binary, word string")
    return named.select("side", "n", F.concat(sign, F.array(F.lit(1.0))).alias("v")).mapInArrow(packed, _SIDE_DDL)


def _times(table: DataFrame, q: DataFrame, parts: int, wide: int, total: int, least: int) -> DataFrame:
    """The matrix of associations times the sides' matrices: a task has the sums of its part's words, and all matrices come to it one by one."""
    of = lambda c: F.pmod(c, F.lit(parts)).alias("p")
    none = F.lit(None).cast("binary")
    own = q.select(of(F.col("side")), F.lit(-1).alias("at"), F.lit(0).alias("kind"), F.col("side").alias("i"), F.lit(-1).alias("j"), none.alias("gaps"), "n", none.alias("v"))
    sides = q.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("p"), F.col("side").alias("at"), F.lit(0).alias("kind"), F.lit(-1).alias("i"), F.col("side").alias("j"), none.alias("gaps"), "n", "v")
    pairs = table.where("kind = 1")
    there = pairs.select(of(F.col("i")), F.col("j").alias("at"), F.lit(1).alias("kind"), "i", "j", "gaps", "n", none.alias("v"))
    back = pairs.where("i <> j").select(of(F.col("j")), F.col("i").alias("at"), F.lit(2).alias("kind"), "i", "j", "gaps", "n", none.alias("v"))
    rows = own.unionByName(sides).unionByName(there).unionByName(back)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, out, told, a, v = None, {}, {}, {}, None, None

        def done():
            for s, n in told.items():
                yield _put({"side": [s], "n": [n], "v": [out[s].tobytes()]}, _SIDE)

        def add(to: np.ndarray, own: np.ndarray, other: np.ndarray, x: np.ndarray):
            for s in range(0, len(own), S.STRETCH):
                o = own[s : s + S.STRETCH]
                first = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
                to[o[first]] += np.add.reduceat(x[s : s + S.STRETCH, None] * v[other[s : s + S.STRETCH]], first, axis=0)

        for b in batches:
            for k in range(b.num_rows):
                r = {c: b.column(c)[k].as_py() for c in b.schema.names}
                if at is not None and at != r["p"]:
                    yield from done()
                    held, out, told = {}, {}, {}
                at = r["p"]
                if not r["kind"]:
                    n = S._full(r["n"]).astype(float)
                    if r["j"] < 0:
                        told[r["i"]], held[r["i"]], out[r["i"]] = r["n"], n, np.zeros((len(n), wide), np.float32)
                    else:
                        a, v = n, _matrix(r["v"], wide)
                    continue
                c, d = (held[r["i"]], a) if r["kind"] == 1 else (a, held[r["j"]])
                key, n = np.cumsum(S._full(r["gaps"])), S._full(r["n"])
                low, high = key // len(d), key % len(d)
                ratio = n * float(total) / (c[low] * d[high])
                on = (n >= least) & (ratio > 1)
                low, high, x = low[on], high[on], np.log(ratio[on])
                if r["kind"] == 1:
                    add(out[r["i"]], low, high, x)
                if r["kind"] == 2 or r["i"] == r["j"]:
                    by = np.argsort(high, kind="stable")
                    if r["i"] == r["j"]:  # a word beside itself is one entry
                        by = by[low[by] != high[by]]
                    add(out[r["j"]], high[by], low[by], x[by])
        if at is not None:
            yield from done()

    return rows.repartitionById(parts, F.col("p")).sortWithinPartitions("p", "at", "kind").mapInArrow(run, _SIDE_DDL)


def _added(made: DataFrame) -> DataFrame:
    """The sums of a side's matrices."""

    def added(t: pa.Table) -> pa.Table:
        v = np.zeros(len(t["v"][0].as_py()) // 4, np.float64)
        for x in t["v"]:
            v += np.frombuffer(x.as_buffer(), np.float32)
        return pa.Table.from_batches([_put({"side": [t["side"][0].as_py()], "n": [t["n"][0].as_py()], "v": [v.astype(np.float32).tobytes()]}, _SIDE)])

    return made.groupBy("side").applyInArrow(added, _SIDE_DDL)


def _gram(df: DataFrame, left: str, right: str, wide: int) -> np.ndarray:
    """The square of left^T right over all sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((wide, wide))
        for b in batches:
            for x, y in zip(b.column("l"), b.column("r"), strict=True):
                x, y = (_matrix(z.as_buffer(), wide) for z in (x, y))
                for s in range(0, len(x), S.SENT):
                    total += x[s : s + S.SENT].astype(float).T @ y[s : s + S.SENT].astype(float)
        yield pa.RecordBatch.from_pydict({"m": [total.tobytes()]}, pa.schema([("m", pa.binary())]))

    return sum((np.frombuffer(r["m"]).reshape(wide, wide) for r in df.select(F.col(left).alias("l"), F.col(right).alias("r")).mapInArrow(run, "m binary").collect()), np.zeros((wide, wide)))


def _turned(df: DataFrame, by: np.ndarray, wide: int, at: int = 0) -> DataFrame:
    """The sides' matrices, without columns from `at` on, times a small one."""
    return _mapped(df.select("side", "n", "v"), lambda r: r | {"v": (_matrix(r["v"], wide)[:, : at or wide].astype(float) @ by).astype(np.float32).tobytes()}, _SIDE, _SIDE_DDL)


def word_matrices(df: DataFrame, text: str, dims: int = 300, window: int = 5, least: int = 1, rounds: int = 3, seed: int = 42, part: int = S.PART) -> tuple[DataFrame | None, int]:
    """((side, names, known, v): subwords.word_vectors() of df's associations, a row for each side; known has which of its words have any; None without pairs. How many parts the words take.)"""
    blocks, total = S._blocked(df, text, window, part)
    if not total:
        return None, PARTS
    table, wide = kept(_summed(blocks)), dims + S.SPARE
    count = sum(r["k"] for r in _mapped(table.where("kind = 0").select("names"), lambda r: {"k": len(S._read(r["names"]))}, pa.schema([("k", pa.int64())]), "k long").collect())
    parts = max(PARTS, -(-count // PARTED))
    made = kept(_times(table, _signs(table, wide, seed), parts, wide + 1, total, least))
    known = kept(_mapped(made.select("side", "v"), lambda r: {"side": r["side"], "known": np.packbits(_matrix(r["v"], wide + 1)[:, -1] > 0).tobytes()}, pa.schema([("side", pa.int32()), ("known", pa.binary())]), "side int, known binary"))
    q = kept(_turned(made, np.eye(wide), wide + 1, wide), made)
    for k in range(rounds):
        if k:
            q = kept(_times(table, q, parts, wide, total, least), q)
        size, axes = np.linalg.eigh(_gram(q, "v", "v", wide))
        keep = size > max(size.max(initial=0.0), 0.0) * 1e-12
        q = kept(_turned(q, axes * np.where(keep, 1 / np.sqrt(np.where(keep, size, 1.0)), 0.0), wide), q)
    image = kept(_times(table, q, parts, wide, total, least))
    sizes, axes = np.linalg.eigh(_gram(q.join(image.select("side", F.col("v").alias("u")), "side"), "v", "u", wide))
    order = np.argsort(-np.abs(sizes), kind="stable")[:dims]
    last = _turned(q, axes[:, order] * np.sqrt(np.abs(sizes[order])), wide).select("side", "v")
    return kept(table.where("kind = 0").select(F.col("i").alias("side"), "names").join(known, "side").join(last, "side"), table, known, q, image), parts


class _Parts(dict):
    """The part of a piece by its first three characters, so that all that begin at a place are in one."""

    def __init__(self, parts: int):
        self.parts = parts

    def __missing__(self, head: str) -> int:
        self[head] = part = zlib.crc32(head.encode()) % self.parts
        return part


def pieces(word: str, of: dict | None = None, part: int = 0) -> set[str]:
    """subwords.pieces() of a word, those of one part."""
    whole, out = f"<{word}>", set()
    for i in range(len(whole) - S.SHORTEST + 1):
        if of is None or of[whole[i : i + S.SHORTEST]] == part:
            out.update(whole[i : i + n] for n in range(S.SHORTEST, S.LONGEST + 1) if i + n <= len(whole))
            if not i:
                out.add(whole)
    return out


def _by(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by which equal numbers stand together, and where each begins."""
    by = np.argsort(own, kind="stable")
    return by, np.flatnonzero(np.r_[True, own[by][1:] != own[by][:-1]][: len(own)])


#: Sides of the words that texts ask for, to a part.
FINE = 8


def _units(model: DataFrame, asked: DataFrame, parts: int, dims: int) -> DataFrame:
    """(side, n: its words, v): each word's mean of its pieces' vectors, weighed by 1 / their words, of length 1; a piece's vector and words stay in the one task of its part."""
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("g")
    none = F.lit(None).cast("binary")
    rows = model.select(every, F.lit(0).alias("kind"), "side", "names", "known", "v").unionByName(asked.select(every, F.lit(1).alias("kind"), "side", F.col("rows").alias("names"), none.alias("known"), none.alias("v")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, number, sums, n, mean, of = None, {}, None, None, None, _Parts(parts)
        for b in batches:
            for k in range(b.num_rows):
                r = {c: b.column(c)[k].as_py() for c in b.schema.names}
                g, names = r["g"], [w.decode() for w in S._read(r["names"])]
                if g != at:
                    at, number, mean = g, {}, None
                    sums, n = np.zeros((1 << 16, dims)), np.zeros(1 << 16)
                if not r["kind"]:
                    known = np.unpackbits(np.frombuffer(r["known"], np.uint8), count=len(names)).tolist()
                    found = [(number.setdefault(p, len(number)), i) for i, w in enumerate(names) if known[i] for p in pieces(w, of, g)]
                    if found:
                        own, word = np.array(found, np.int64).T
                        while len(number) > len(n):
                            sums, n = np.concatenate([sums, np.zeros_like(sums)]), np.concatenate([n, np.zeros_like(n)])
                        v = _matrix(r["v"], dims)
                        for s in range(0, len(own), S.STRETCH):
                            by, first = _by(own[s : s + S.STRETCH])
                            to = own[s : s + S.STRETCH][by[first]]
                            sums[to] += np.add.reduceat(v[word[s : s + S.STRETCH][by]].astype(float), first, axis=0)
                            n[to] += np.diff(first, append=len(by))
                    continue
                if mean is None:
                    sums /= np.maximum(n, 1)[:, None] ** 2
                    mean = sums
                found = [(number[p], i) for i, w in enumerate(names) for p in pieces(w, of, g) if p in number]
                v = np.zeros((len(names), dims))
                if found:
                    own, word = np.array(found, np.int64).T
                    for s in range(0, len(own), S.STRETCH):
                        w = word[s : s + S.STRETCH]
                        first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
                        v[w[first]] += np.add.reduceat(mean[own[s : s + S.STRETCH]], first, axis=0)
                yield _put({"side": [r["side"]], "n": [r["names"]], "v": [v.astype(np.float32).tobytes()]}, _SIDE)

    def unit(r: dict) -> dict:
        v = _matrix(r["v"], dims).astype(float)
        size = np.sqrt((v * v).sum(axis=1, keepdims=True))
        return r | {"v": (v / np.where(size > 0, size, 1.0)).astype(np.float32).tobytes()}

    return _mapped(_added(rows.repartitionById(parts, F.col("g")).sortWithinPartitions("g", "kind").mapInArrow(run, _SIDE_DDL)), unit, _SIDE, _SIDE_DDL)


_USE = pa.schema([("g", pa.int32()), ("kind", pa.int32()), ("chunk", pa.int64()), ("size", pa.int64()), ("keys", pa.binary()), ("names", pa.binary()), ("gaps", pa.binary()), ("n", pa.binary())])
_USE_DDL = "g int, kind int, chunk long, size long, keys binary, names binary, gaps binary, n binary"


def _uses(said: DataFrame, parts: int, sides: int) -> DataFrame:
    """Texts (key, w) in chunks: for each part of the words how often each text has which of them."""

    def chunk(number: int, keys: list[str], lists: pa.ListArray) -> Iterator[pa.RecordBatch]:
        coded = lists.flatten().dictionary_encode()
        names = np.array([w.encode() for w in coded.dictionary.to_pylist()] or [b""], object)
        part = np.array([zlib.crc32(w) % sides % parts for w in names])
        text, word = np.repeat(np.arange(len(lists)), S.pc.list_value_length(lists).to_numpy()), coded.indices.to_numpy().astype(np.int64)
        for g in range(parts):
            of = part[word] == g
            own, at = np.unique(word[of], return_inverse=True)
            use, n = np.unique(text[of] * max(1, len(own)) + at, return_counts=True)
            # the keys go with the first part
            yield _put({"g": [g], "kind": [1], "chunk": [number], "size": [len(lists)], "keys": [None if g else S._zip("\n".join(keys).encode())], "names": [S._names(names[own].tolist())], "gaps": [S._thin(np.diff(use, prepend=0))], "n": [S._thin(n)]}, _USE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            lists, keys, at = b.column("w"), b.column("key"), 0
            ends = np.cumsum(S.pc.list_value_length(lists).to_numpy())
            while at < len(lists):
                upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + S.CHUNK, "right")))
                yield from chunk(number, keys.slice(at, upto - at).to_pylist(), lists.slice(at, upto - at))
                at, number = upto, number + 1

    return said.mapInArrow(run, _USE_DDL)


def _texts(units: DataFrame, uses: DataFrame, parts: int, dims: int) -> DataFrame:
    """(key, v): each text's mean of its words' vectors."""
    none = F.lit(None).cast("binary")
    held = units.select(F.pmod("side", F.lit(parts)).cast("int").alias("g"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("chunk"), F.lit(0).cast("long").alias("size"), none.alias("keys"), F.col("n").alias("names"), none.alias("gaps"), F.col("v").alias("n"))
    out = pa.schema([("chunk", pa.int64()), ("keys", pa.binary()), ("v", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, number, parts_of, v = None, {}, [], None
        for b in batches:
            for k in range(b.num_rows):
                r = {c: b.column(c)[k].as_py() for c in b.schema.names}
                if r["g"] != at:
                    at, number, parts_of, v = r["g"], {}, [], None
                if not r["kind"]:
                    for w in S._read(r["names"]):
                        number[w] = len(number)
                    parts_of.append(_matrix(r["n"], dims))
                    continue
                if v is None and parts_of:
                    v = np.concatenate(parts_of)
                    v, parts_of = np.concatenate([v, (v != 0).any(axis=1, keepdims=True)], axis=1), []
                total = np.zeros((r["size"], dims + 1))
                use, n = np.cumsum(S._full(r["gaps"])), S._full(r["n"])
                if len(use):
                    words = np.array([number[w] for w in S._read(r["names"])])
                    text, word = use // len(words), words[use % len(words)]
                    for s in range(0, len(text), S.STRETCH):
                        t = text[s : s + S.STRETCH]
                        first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
                        total[t[first]] += np.add.reduceat(n[s : s + S.STRETCH, None] * v[word[s : s + S.STRETCH]], first, axis=0)
                yield _put({"chunk": [r["chunk"]], "keys": [r["keys"]], "v": [total.astype(np.float32).tobytes()]}, out)

    def whole(t: pa.Table) -> pa.Table:
        keys = next(k.as_py() for k in t["keys"] if k.is_valid)
        v = sum(_matrix(x.as_buffer(), dims + 1).astype(float) for x in t["v"])
        v = v[:, :-1] / np.maximum(v[:, -1:], 1)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, dims), pa.int32()), pa.array(v.ravel()))
        return pa.table([pa.array(S._unzip(keys).decode().split("\n")), lists], names=["key", "v"])

    rows = held.unionByName(uses).repartitionById(parts, F.col("g")).sortWithinPartitions("g", "kind")
    return rows.mapInArrow(run, "chunk long, keys binary, v binary").groupBy("chunk").applyInArrow(whole, "key string, v array<double>")


def embed(df: DataFrame, text: str, out: str, dims: int = 300, window: int = 5, least: int = 1, rounds: int = 3, seed: int = 42) -> DataFrame:
    """df with `out`: subwords.embed() of its texts by a model that subwords.train() makes of them; numbers have the precision of four bytes."""
    key = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    model, parts = word_matrices(df, text, dims, window, least, rounds, seed)
    zero = F.array_repeat(F.lit(0.0), dims)
    if model is None:
        return df.withColumn(out, zero)
    said, sides = df.select(key.alias("key"), S.words(F.col(text)).alias("w")), parts * FINE
    words = said.select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("a"))
    units = kept(_units(model, S._packed_sides(words, sides), parts, dims), model)
    texts = kept(_texts(units, _uses(said, parts, sides), parts, dims), units)
    texts = texts.groupBy("key").agg(F.first("v").alias("__v")).withColumnRenamed("key", "__key")
    return df.withColumn("__key", key).join(texts, "__key", "left").withColumn(out, F.coalesce("__v", zero)).drop("__key", "__v")
