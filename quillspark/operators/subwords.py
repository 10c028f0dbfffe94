"""Text vectors from subwords, trained on a corpus: misspelt, inflected and unseen names get vectors near their kin.

Words are known by the words around them: counts of pairs, their positive mutual
information, and that matrix's leading part by subspace iteration, where a round
multiplies blocks of the matrix by the vectors of their side and sums by word. A piece of a word (3 to 6 characters, and the whole
word) has the mean of the vectors of the words that hold it; a text has the mean
of its words, and a word, seen or not, that of its pieces.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import checkpoints

#: Characters of the pieces of a word.
SHORTEST, LONGEST = 3, 6
#: Directions that the iteration carries beyond those that are asked for.
SPARE = 10


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def pieces(word: Column) -> Column:
    """The distinct pieces of <word>, itself included."""
    whole = F.concat(F.lit("<"), word, F.lit(">"))
    of = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(whole) - n + 1, F.lit(1))), lambda i: F.substring(whole, i, F.lit(n)))
    cut = F.flatten(F.array(*(of(n) for n in range(SHORTEST, LONGEST + 1))))
    return F.array_union(F.filter(cut, lambda p: F.length(p) >= SHORTEST), F.array(whole))


def pair_counts(df: DataFrame, text: str, window: int = 5) -> DataFrame:
    """(word, context, n): how often two words stand within `window` words of each other in a text; both directions, a word beside itself too.

    A text's pairs are made and counted where it is read, and only counts are
    shuffled. Texts are whole; null and one-word texts give none.
    """
    w = df.select(words(F.col(text)).alias("w")).where(F.size("w") > 1)
    at = w.select("w", F.posexplode("w").alias("i", "word"))
    # slice counts from 1: the window's words after place i
    near = at.select("word", F.explode(F.slice("w", F.col("i") + 2, F.lit(window))).alias("context"))
    one_way = near.groupBy("word", "context").agg(F.count("*").alias("n"))
    both = one_way.unionByName(one_way.select(F.col("context").alias("word"), F.col("word").alias("context"), "n"))
    return both.groupBy("word", "context").agg(F.sum("n").alias("n"))


def associations(pairs: DataFrame, least: int = 1) -> DataFrame:
    """(word, context, x): the mutual information of pairs seen `least` times or more, where it is over 0."""
    margin = pairs.groupBy("word").agg(F.sum("n").alias("a"))
    total = pairs.agg(F.sum("n").alias("total"))
    # a table of one row
    joined = pairs.where(F.col("n") >= least).join(margin, "word").join(margin.select(F.col("word").alias("context"), F.col("a").alias("b")), "context").join(F.broadcast(total))
    x = F.log(F.col("n") * F.col("total").cast("double") / (F.col("a").cast("double") * F.col("b")))
    return joined.select("word", "context", x.alias("x")).where("x > 0")


#: Words of texts whose pairs a task counts at once, and places near words that a block of the table has, about.
CHUNK, PART = 3_000_000, 4_000_000
_ZSTD = pa.Codec("zstd", compression_level=5)


def _zip(x: bytes) -> bytes:
    return _ZSTD.compress(x, asbytes=True)


def _unzip(x: bytes) -> bytes:
    return pa.CompressedInputStream(pa.py_buffer(x), "zstd").read()


def _thin(x: np.ndarray) -> bytes:
    """Numbers from 0 on, mostly small, in few bytes: all lowest bytes first, then the next."""
    return _zip(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _full(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_unzip(x), np.uint8).reshape(8, -1).T).view("<u8").ravel().astype(np.int64)


def _names(words: list[bytes]) -> bytes:
    # words have no line ends
    return _zip(b"\n".join(words))


def _read(names: bytes) -> list[bytes]:
    return _unzip(names).split(b"\n")


_TABLE = "i int, j int, kind int, rows binary, columns binary, gaps binary, n binary"
_ARROW = pa.schema([(c, pa.int32()) for c in ("i", "j", "kind")] + [(c, pa.binary()) for c in ("rows", "columns", "gaps", "n")])


def _counted(sides: int, window: int):
    """Texts as lists of words -> blocks of their pairs: either direction's counts as one, sorted, by the distances of their numbers."""

    def block(i: int, j: int, low: np.ndarray, high: np.ndarray, n: np.ndarray, names: np.ndarray) -> tuple:
        r, low = np.unique(low, return_inverse=True)
        c, high = np.unique(high, return_inverse=True)
        at = low * len(c) + high
        return i, j, 1, _names(names[r].tolist()), _names(names[c].tolist()), _thin(np.diff(at, prepend=0)), _thin(n)

    def chunk(lists: pa.ListArray) -> Iterator[pa.RecordBatch]:
        coded = lists.flatten().dictionary_encode()
        names = [w.encode() for w in coded.dictionary.to_pylist()]
        side = np.array([zlib.crc32(w) % sides for w in names], np.int64)
        # numbers by side and word, so that a block's pairs are sorted as they are
        order = np.array(sorted(range(len(names)), key=lambda k: (side[k], names[k])), np.int64)
        number = np.empty(len(names), np.int64)
        number[order] = np.arange(len(names))
        names, side = np.array(names, object)[order], side[order]
        word, text = number[coded.indices.to_numpy()], np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
        keys = []
        for k in range(1, window + 1):
            a, b = word[:-k], word[k:]
            same = text[:-k] == text[k:]
            keys.append((np.minimum(a, b) * len(names) + np.maximum(a, b))[same])
        keys = np.concatenate(keys)
        keys.sort()
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
        n, keys = np.diff(first, append=len(keys)), keys[first]
        low, high = keys // len(names), keys % len(names)
        of = side[low] * sides + side[high]
        by = np.argsort(of, kind="stable")
        cuts = np.r_[np.flatnonzero(np.r_[True, np.diff(of[by]) > 0][: len(by)]), len(by)]
        made = [block(*divmod(int(of[x[0]]), sides), low[x], high[x], n[x], names) for x in (by[s:e] for s, e in zip(cuts[:-1], cuts[1:], strict=True))]
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), _ARROW, strict=True)], schema=_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            lists = b.column("w")
            ends = np.cumsum(pc.list_value_length(lists).to_numpy())
            at = 0
            while at < len(lists):
                # as many whole texts as a chunk has room for, one at least
                upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK - size, "right")))
                held.append(lists.slice(at, upto - at))
                size += int(ends[upto - 1] - (ends[at - 1] if at else 0))
                at = upto
                if size >= CHUNK or at < len(lists):
                    yield from chunk(pa.concat_arrays(held))
                    held, size = [], 0
        if held:
            yield from chunk(pa.concat_arrays(held))

    return run


def _packed_sides(margin: DataFrame, sides: int) -> DataFrame:
    """(side, rows, n): the words of each side with their numbers `a`, packed."""

    def sided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            side = pa.array([zlib.crc32(w.encode()) % sides for w in b.column("word").to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([side, *b.columns], names=["side", "word", "a"])

    def packed(t: pa.Table) -> pa.Table:
        rows = sorted(zip((w.encode() for w in t["word"].to_pylist()), t["a"].to_pylist(), strict=True))
        return pa.table({"side": t["side"].slice(0, 1), "rows": pa.array([_names([w for w, _ in rows])], pa.binary()), "n": pa.array([_thin(np.array([a for _, a in rows]))], pa.binary())})

    return margin.mapInArrow(sided, "side int, word string, a long").groupBy("side").applyInArrow(packed, "side int, rows binary, n binary")


def _sums(margin: DataFrame, sides: int) -> DataFrame:
    """The words of each side with their sums, packed, for each block of the side."""
    own = _packed_sides(margin, sides).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(sides - 1))))
    none = F.lit(None).cast("binary")
    return own.select(F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), F.when(F.col("side") <= F.col("other"), -2).otherwise(-1).alias("kind"), "rows", none.alias("columns"), none.alias("gaps"), "n")


def _blocked(df: DataFrame, text: str, window: int, part: int) -> tuple[DataFrame, int]:
    """(the table of pairs of df's texts as packed blocks, a block's rows beside each other and its sums of words first; the sum of all)."""
    w = df.select(words(F.col(text)).alias("w")).where(F.size("w") > 1)
    at = w.select(F.posexplode("w").alias("i", "word"), F.size("w").alias("k"))
    near = F.least("i", F.lit(window)) + F.least(F.col("k") - 1 - F.col("i"), F.lit(window))
    checkpoints(df.sparkSession)
    margin = at.groupBy("word").agg(F.sum(near).alias("a")).checkpoint()
    total = margin.agg(F.sum("a")).first()[0] or 0
    sides = max(SIDES, math.isqrt(total // max(1, part)) + 1)
    rows = w.mapInArrow(_counted(sides, window), _TABLE).unionByName(_sums(margin, sides))
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), sides * (sides + 1) // 2)
    return rows.repartition(parts, "i", "j").sortWithinPartitions("i", "j", "kind"), total


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(i, j, row words, their sums, column words, their sums, numbers of rows, of columns, counts) of each block of a sorted stream; for i = j the columns are the rows."""
    at, sums, places, keys, counts = None, [], [], [], []

    def whole() -> tuple:
        (r, a), (c, b) = sums[0], sums[-1]
        key, n = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, counts))
        by = np.argsort(key, kind="stable")
        key, n = key[by], n[by]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
        n = np.add.reduceat(n, first) if len(first) else n
        return *at, r, a, c, b, key[first] // len(c), key[first] % len(c), n

    for batch in batches:
        for row in batch.to_pylist():
            if at is not None and at != (row["i"], row["j"]):
                yield whole()
                sums, places, keys, counts = [], [], [], []
            at = row["i"], row["j"]
            if row["kind"] < 0:
                names = _read(row["rows"])
                sums.append((names, _full(row["n"])))
                places.append({w: k for k, w in enumerate(names)})
            else:
                r, c = (np.fromiter(map(p.__getitem__, _read(row[x])), np.int64) for x, p in (("rows", places[0]), ("columns", places[-1])))
                x = np.cumsum(_full(row["gaps"]))
                low, high = r[x // len(c)], c[x % len(c)]
                keys.append(low * len(sums[-1][0]) + high)
                counts.append(_full(row["n"]))
    if at is not None:
        yield whole()


#: Pairs that are sent on at once.
SENT = 1 << 16


def text_associations(df: DataFrame, text: str, window: int = 5, least: int = 1, part: int = PART) -> DataFrame:
    """associations(pair_counts(df, text, window), least), with blocks of counted pairs shuffled instead of a row for each pair.

    A task counts the pairs of some millions of words at once, either direction as
    one, and packs them by the sides of their words: a block has its words once
    and its pairs as sorted numbers, about a byte or two each. The words' sums go
    to the blocks of their side; blocks are added up and their words put back
    where the rows are given out. No row is shuffled for a place or a pair.
    """
    blocks, total = _blocked(df, text, window, part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, j, r, a, c, b, low, high, n in _blocks_of(batches):
            twice = (low == high) if i == j else np.zeros(len(n), bool)
            n = np.where(twice, 2 * n, n)
            ratio = n * float(total) / (a[low].astype(float) * b[high])
            kept = (n >= least) & (ratio > 1)
            low, high, ratio, twice = low[kept], high[kept], ratio[kept], twice[kept]
            r, c = pa.array(r, pa.binary()).cast(pa.string()), pa.array(c, pa.binary()).cast(pa.string())
            for s in range(0, len(low), SENT):
                x, y, z = r.take(pa.array(low[s : s + SENT])), c.take(pa.array(high[s : s + SENT])), pa.array(ratio[s : s + SENT])
                yield pa.RecordBatch.from_arrays([x, y, z], names=["word", "context", "ratio"])
                back = pa.array(~twice[s : s + SENT])
                yield pa.RecordBatch.from_arrays([y.filter(back), x.filter(back), z.filter(back)], names=["word", "context", "ratio"])

    return blocks.mapInArrow(run, "word string, context string, ratio double").select("word", "context", F.log("ratio").alias("x")).where("x > 0")


#: Pairs of a block of the table, and blocks a side at least.
BLOCK, SIDES = 2_000_000, 4


def _side(word: str, sides: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("side"), word), F.lit(sides)).cast("int")


def _blocks(pairs: DataFrame, sides: int) -> DataFrame:
    """(i, j, rows, columns, r, c, x): the table of pairs in sides x sides blocks by its words' hashes, each one row with its words and its entries' numbers, by r."""

    def packed(t: pa.Table) -> pa.Table:
        r, c = (t[k].combine_chunks().dictionary_encode() for k in ("word", "context"))
        r, c = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (r, c))
        n, m = r.indices.to_numpy().astype(np.int32), c.indices.to_numpy().astype(np.int32)
        by = np.argsort(n, kind="stable")
        parts = [n[by].tobytes(), m[by].tobytes(), t["x"].to_numpy()[by].astype(float).tobytes()]
        lists = [pa.array([x.dictionary.to_pylist()], pa.list_(pa.string())) for x in (r, c)]
        return pa.table([pa.array([t[k][0].as_py()], pa.int32()) for k in ("i", "j")] + lists + [pa.array([p], pa.binary()) for p in parts], names=["i", "j", "rows", "columns", "r", "c", "x"])

    dealt = pairs.select(_side("word", sides).alias("i"), _side("context", sides).alias("j"), "word", "context", "x")
    return dealt.groupBy("i", "j").applyInArrow(packed, "i int, j int, rows array<string>, columns array<string>, r binary, c binary, x binary")


#: Entries of a block that are multiplied at once.
STRETCH = 1 << 17


def _times(blocks: DataFrame, vectors: DataFrame, sides: int) -> DataFrame:
    """The matrix of pairs times the rows of vectors: a vector goes to the blocks of its side, not to each pair."""

    def product(block: pa.Table, v: pa.Table) -> pa.Table:
        schema = pa.schema([("word", pa.string()), ("v", pa.list_(pa.float64()))])
        if not block.num_rows or not v.num_rows:
            return schema.empty_table()
        flat = v["v"].combine_chunks()
        flat = flat if isinstance(flat, pa.Array) else pa.concat_arrays(flat.chunks)
        m = flat.flatten().to_numpy(zero_copy_only=False).reshape(v.num_rows, -1)
        places = pc.index_in(pa.array(block["columns"][0].as_py(), pa.string()), value_set=v["word"].combine_chunks())
        m = m[places.to_numpy(zero_copy_only=False).astype(np.int64)]
        r, c, x = (np.frombuffer(block[k][0].as_py(), t) for k, t in (("r", np.int32), ("c", np.int32), ("x", float)))
        names = block["rows"][0].as_py()
        out = np.zeros((len(names), m.shape[1]))
        for s in range(0, len(r), STRETCH):
            own = r[s : s + STRETCH]
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            out[own[first]] += np.add.reduceat(x[s : s + STRETCH, None] * m[c[s : s + STRETCH]], first, axis=0)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, out.shape[1]), pa.int32()), pa.array(out.ravel()))
        return pa.table([pa.array(names, pa.string()), lists], schema=schema)

    told = vectors.select(_side("word", sides).alias("j"), "word", "v").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(sides - 1))))
    made = blocks.groupBy("i", "j").cogroup(told.groupBy("i", "j")).applyInArrow(product, "word string, v array<double>")
    return made.groupBy("word").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v"))


def _gram(a: DataFrame, left: str, right: str, dims: int) -> np.ndarray:
    """The dims x dims matrix of left^T right over all rows; each task sends one of that size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for b in batches:
            x, y = (np.array(b.column(c).to_pylist(), float).reshape(-1, dims) for c in (left, right))
            total += x.T @ y
        yield pa.RecordBatch.from_pydict({"i": list(range(dims)), "v": total.tolist()}, pa.schema([("i", pa.int64()), ("v", pa.list_(pa.float64()))]))

    parts = a.select(left, right).mapInArrow(run, "i long, v array<double>") if left != right else a.select(left).mapInArrow(run, "i long, v array<double>")
    rows = parts.groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v")).orderBy("i").collect()
    return np.array([r["v"] for r in rows], float).reshape(-1, dims)


def _turned(a: DataFrame, by: np.ndarray) -> DataFrame:
    """a's vectors times a small matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.array(b.column("v").to_pylist(), float).reshape(-1, by.shape[0]) @ by
            yield pa.RecordBatch.from_arrays([b.column("word"), pa.array(v.tolist(), pa.list_(pa.float64()))], names=["word", "v"])

    return a.select("word", "v").mapInArrow(run, "word string, v array<double>")


def _upright(a: DataFrame, dims: int) -> DataFrame:
    """Columns that span what a's do, at right angles and of length 1; those beyond a's rank are 0."""
    size, axes = np.linalg.eigh(_gram(a, "v", "v", dims))
    keep = size > max(size.max(initial=0.0), 0.0) * 1e-12
    return _turned(a, axes * np.where(keep, 1 / np.sqrt(np.where(keep, size, 1.0)), 0.0))


def word_vectors(pairs: DataFrame, dims: int = 300, rounds: int = 3, seed: int = 42) -> DataFrame:
    """(word, v array<double> of dims): the leading eigenvectors of the symmetric table of pairs (word, context, x), by the roots of their sizes.

    Subspace iteration from seeded random signs: a round multiplies and squares
    up, each written to the checkpoint folder. What comes to the driver is a square
    of dims + SPARE numbers a side. With fewer words than dims the entries left over are 0.
    An empty table gives no rows.
    """
    checkpoints(pairs.sparkSession)
    pairs, wide = pairs.select("word", "context", "x").checkpoint(), dims + SPARE
    sign = F.transform(F.sequence(F.lit(0), F.lit(wide - 1)), lambda i: F.when(F.xxhash64(F.lit(seed), "word", i) % 2 == 0, 1.0).otherwise(-1.0))
    q = pairs.select("word").distinct().select("word", sign.alias("v"))
    size = pairs.count()
    if not size:
        return q
    sides = max(SIDES, math.isqrt(size // BLOCK) + 1)
    blocks = _blocks(pairs, sides).checkpoint()
    for _ in range(rounds):
        made = _times(blocks, q, sides).checkpoint()
        q = _upright(made, wide).checkpoint()
    # the matrix within the subspace, and its own axes
    image = _times(blocks, q, sides).withColumnRenamed("v", "u")
    sizes, axes = np.linalg.eigh(_gram(q.join(image, "word"), "v", "u", wide))
    order = np.argsort(-np.abs(sizes), kind="stable")[:dims]
    return _turned(q, axes[:, order] * np.sqrt(np.abs(sizes[order])))


def piece_vectors(vectors: DataFrame) -> DataFrame:
    """(piece, v, n): the mean of the vectors of the n words that hold the piece."""
    p = vectors.select(F.explode(pieces(F.col("word"))).alias("piece"), array_to_vector("v").alias("v"))
    return p.groupBy("piece").agg(vector_to_array(Summarizer.mean(F.col("v"))).alias("v"), F.count("*").alias("n"))


def train(df: DataFrame, text: str, dims: int = 300, window: int = 5, least: int = 1, rounds: int = 3, seed: int = 42) -> DataFrame:
    """The table of pieces (piece, v, n) of a corpus; write it to keep it."""
    return piece_vectors(word_vectors(text_associations(df, text, window, least), dims, rounds, seed))


def embed(df: DataFrame, text: str, out: str, model: DataFrame, dims: int = 300) -> DataFrame:
    """df with `out`, the text's vector: the mean of its words' vectors, each of length 1; zeros for null, empty and wholly unknown texts.

    A word's vector is the mean of its pieces', weighed by 1 / n: a piece that few
    words hold says more. Each distinct text and each distinct word is worked
    once; `functools.partial` makes it an embedder of `features.assemble`.
    """
    key = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    said = df.select(key.alias("__key"), words(F.col(text)).alias("w")).dropDuplicates(["__key"])
    uses = said.select("__key", F.explode("w").alias("word")).groupBy("__key", "word").agg(F.count("*").cast("double").alias("times"))
    cut = uses.select("word").distinct().select("word", F.explode(pieces(F.col("word"))).alias("piece"))
    v = model.select("piece", array_to_vector("v").alias("v"), (1 / F.col("n")).alias("weight"))
    mean = cut.join(v, "piece").groupBy("word").agg(vector_to_array(Summarizer.mean(F.col("v"), F.col("weight"))).alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    # a word whose pieces cancel out has no direction
    unit = mean.withColumn("l", length).where("l > 0").select("word", array_to_vector(F.transform("v", lambda x: x / F.col("l"))).alias("v"))
    texts = uses.join(unit, "word").groupBy("__key").agg(vector_to_array(Summarizer.mean(F.col("v"), F.col("times"))).alias("__v"))
    zero = F.array_repeat(F.lit(0.0), dims)
    return df.withColumn("__key", key).join(texts, "__key", "left").withColumn(out, F.coalesce("__v", zero)).drop("__key", "__v")
