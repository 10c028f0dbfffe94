"""Token ids in binary files: canonical length-limited Huffman codes from global counts.

A file image holds a range of documents in ascending order of their key: code
lengths, keys, token counts, and the code bits in independent blocks with the
bit offset of each, so that a table decodes all blocks side by side.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import numbered, shared_dir
from .fingerprint import RANGES, quantiles, range_of
from .word_hash import _BASE, _BYTE, mixed

#: Longest code, tokens to a block, id that ends a document.
LONGEST, BLOCK, END = 20, 256, 2
#: Tokens to a file image, about.
FILE_TOKENS = 500_000
#: Bytes of text to a range of keys, about; there are RANGES ranges at most.
RANGE_BYTES = 1 << 20
MAGIC = b"QSH1"
NULL_KEY = -(2**63)


# ------------------------------------------------------------------ coding

def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Lengths of an optimal code of at most `longest` bits (package-merge); 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << longest:
        raise ValueError(f"{len(used)} ids need codes longer than {longest}")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    n = len(order)
    # level by level: the items are the coins of this level and the pairs of the level before, by weight
    levels, prior = [], np.zeros(0)
    for _ in range(longest):
        both = np.concatenate([weight, prior])
        by = np.argsort(both, kind="stable")
        levels.append(by)
        got = both[by][: len(by) // 2 * 2]
        prior = got[0::2] + got[1::2]
    lengths = np.zeros(n, np.int64)
    take = 2 * n - 2
    for by in reversed(levels):
        chosen = by[:take]
        coins = chosen[chosen < n]
        lengths[coins] += 1
        take = 2 * (take - len(coins))
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each id: by length, then id, counting up."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if not len(order):
        return codes
    width = lengths[order].astype(np.uint64)
    top = int(width.max())
    room = np.uint64(1) << (np.uint64(top) - width)
    start = np.concatenate([[np.uint64(0)], np.cumsum(room)[:-1]]).astype(np.uint64)
    codes[order] = start >> (np.uint64(top) - width)
    return codes


@functools.lru_cache(4)
def decode_table(raw: bytes) -> tuple[np.ndarray, int]:
    """(id << 5 | length for every string of `top` bits, top) of the code lengths of all ids."""
    lengths = np.frombuffer(raw, np.uint8)
    top = max(1, int(lengths.max(initial=0)))
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    table = np.repeat(order.astype(np.int64) << 5 | lengths[order], 1 << (top - lengths[order].astype(np.int64)))
    return np.concatenate([table, np.zeros((1 << top) - len(table), np.int64)]), top


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(bits, bit offset of every block)."""
    width = lengths[ids].astype(np.int64)
    ends = np.cumsum(width)
    at = ends - width
    words = np.zeros(int(ends[-1] + 31) // 32 + 2 if len(ids) else 2, np.uint64)
    slot, shift = at >> 5, 64 - (at & 31) - width
    wide = codes[ids] << shift.astype(np.uint64)
    # codes in one word don't overlap, so their sum is their union
    for part, off in ((wide >> np.uint64(32), 0), (wide & np.uint64(0xFFFFFFFF), 1)):
        words += np.bincount(slot + off, weights=part.astype(np.float64), minlength=len(words)).astype(np.uint64)
    return words.astype(">u4").tobytes(), at[::BLOCK].astype(np.uint64)


def unpack(bits: bytes, offsets: np.ndarray, n: int, lengths: np.ndarray) -> np.ndarray:
    """The ids, all blocks decoded side by side."""
    out = np.zeros((len(offsets), BLOCK), np.uint32)
    if n:
        table, top = decode_table(lengths.tobytes())
        raw = np.frombuffer(bits + b"\0" * (-len(bits) % 4 + 8), ">u4").astype(np.uint64)
        wide = raw[:-1] << np.uint64(32) | raw[1:]
        at, last = offsets.astype(np.int64), len(wide) - 1
        keep, mask = np.uint64(64 - top), np.int64(31)
        for i in range(BLOCK):
            got = table[((wide[np.minimum(at >> 5, last)] << (at & mask).astype(np.uint64)) >> keep).astype(np.int64)]
            out[:, i] = got >> 5
            at += got & mask
    return out.ravel()[:n]


def file_image(keys: np.ndarray, counts: np.ndarray, ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> bytes:
    bits, offsets = pack(ids, lengths, codes)
    parts = [zlib.compress(lengths.tobytes(), 1), keys.astype("<i8").tobytes(), counts.astype("<u4").tobytes(), offsets.astype("<u8").tobytes(), bits]
    head = json.dumps({"documents": len(keys), "tokens": len(ids), "block": BLOCK, "parts": [len(p) for p in parts]}).encode()
    return MAGIC + struct.pack("<I", len(head)) + head + b"".join(parts)


def read_image(image: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, token counts, ids) of a file image."""
    if image[:4] != MAGIC:
        raise ValueError("not a token file")
    (n,) = struct.unpack("<I", image[4:8])
    head, at, parts = json.loads(image[8 : 8 + n]), 8 + n, []
    for size in head["parts"]:
        parts.append(image[at : at + size])
        at += size
    lengths = np.frombuffer(zlib.decompress(parts[0]), np.uint8)
    return np.frombuffer(parts[1], "<i8"), np.frombuffer(parts[2], "<u4"), unpack(parts[4], np.frombuffer(parts[3], "<u8"), head["tokens"], lengths)


# -------------------------------------------------------------- tokenizing

#: Classes of bytes: white space, letter, digit, other ASCII, and what the library has to see in its whole word.
_BLANK, _LETTER, _DIGIT, _OTHER, _ODD = range(5)
_CLASS = np.full(256, _ODD, np.uint8)
_CLASS[0x21:0x7F] = _OTHER
_CLASS[[0x20, *range(0x09, 0x0E)]] = _BLANK
_CLASS[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1)]] = _LETTER
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
_CLASS[ord("'")] = _ODD
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


class PieceTokenizer:
    """Ids of texts by way of their distinct pieces: runs of letters, digits, runs of other characters.

    Right for tokenizers that lower case, drop white space, split these pieces
    and mark the last token of each: word_bpe_49k is one. The library encodes
    each distinct piece once while there is room to keep it; words with
    characters other than ASCII and Latin-1 letters, with an apostrophe or the
    mark of a special token it sees whole. Pieces are kept by a 64-bit hash.
    """

    SLOTS = 1 << 22

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocab = self.library.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.keys, self.codes, self.held = np.zeros(self.SLOTS, np.uint64), np.zeros(self.SLOTS, np.int32), 0
        self.flat, self.starts, self.n, self.used = np.zeros(1 << 20, np.uint32), np.zeros(1 << 20, np.int64), 0, 0

    def _look_up(self, hashes: np.ndarray) -> np.ndarray:
        """The code of each hash, -1 if it isn't kept."""
        at = (hashes & np.uint64(self.SLOTS - 1)).astype(np.int64)
        out = np.full(len(hashes), -1, np.int64)
        left = np.arange(len(hashes))
        while len(left):
            key = self.keys[at[left]]
            hit = key == hashes[left]
            out[left[hit]] = self.codes[at[left[hit]]]
            left = left[~hit & (key != 0)]
            at[left] = (at[left] + 1) & (self.SLOTS - 1)
        return out

    def _keep(self, hashes: np.ndarray, first: int) -> None:
        """Codes from `first` on for distinct new hashes."""
        at = (hashes & np.uint64(self.SLOTS - 1)).astype(np.int64)
        left = np.arange(len(hashes))
        while len(left):
            free = self.keys[at[left]] == 0
            _, one = np.unique(at[left[free]], return_index=True)
            put = left[free][one]
            self.keys[at[put]], self.codes[at[put]] = hashes[put], first + put
            done = np.zeros(len(hashes), bool)
            done[put] = True
            left = left[~done[left]]
            at[left] = (at[left] + 1) & (self.SLOTS - 1)
        self.held += len(hashes)

    def _encode(self, plain: list[bytes], odd: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of plain pieces, then odd words."""
        one_by_one = lambda ps: [e.ids for e in self.library.encode_batch_fast([p.decode() for p in ps], add_special_tokens=False)]
        ids, n = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if plain:
            ids = np.array(self.library.encode(b" ".join(plain).decode(), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            n = np.diff(ends, prepend=0)
            if len(ends) != len(plain) or ends[-1] != len(ids):  # not the kind of tokenizer that joining is right for
                got = one_by_one(plain)
                ids, n = np.array([i for g in got for i in g], np.uint32), np.array([len(g) for g in got])
        if odd:
            got = one_by_one(odd)
            ids, n = np.concatenate([ids, np.array([i for g in got for i in g], np.uint32)]), np.concatenate([n, [len(g) for g in got]])
        return ids, n

    def _grow(self, ids: int, codes: int) -> None:
        if self.used + ids > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(ids, len(self.flat)), np.uint32)])
        if self.n + codes + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros(max(codes + 1, len(self.starts)), np.int64)])

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, end of each text's ids)."""
        joined = b" ".join(texts) + b" "
        raw = np.frombuffer(joined, np.uint8)
        kind = _CLASS[raw]
        low = _LOWER[raw]
        # two-byte Latin-1 letters
        lead = np.flatnonzero(raw[:-1] == 0xC3)
        after = raw[lead + 1]
        good = (after >= 0x80) & (after != 0x97) & (after != 0xB7)
        lead, after = lead[good], after[good]
        kind[lead] = kind[lead + 1] = _LETTER
        low[lead + 1] = np.where(after <= 0x9E, after | 0x20, after)
        special = np.flatnonzero((raw[:-1] == 0x3C) & (raw[1:] == 0x7C))
        kind[special] = _ODD
        before = np.concatenate([np.zeros(1, np.uint8), kind[:-1]])
        inside = kind != _BLANK
        word_start = np.flatnonzero(inside & (before == _BLANK))
        start = inside & ((kind != before) | (kind == _DIGIT))
        odd = np.flatnonzero(kind == _ODD)
        odd_piece = np.zeros(len(raw), bool)
        if len(odd):
            words = np.unique(np.searchsorted(word_start, odd, side="right") - 1)
            blank = np.flatnonzero(~inside)
            lo = word_start[words]
            hi = blank[np.searchsorted(blank, lo)]
            step = np.zeros(len(raw) + 1, np.int8)
            step[lo] += 1
            step[hi] -= 1
            whole = np.cumsum(step[:-1]).astype(bool)
            start[whole] = False
            start[lo] = True
            low[whole] = raw[whole]
            odd_piece[lo] = True
        starts = np.flatnonzero(start)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        at = np.flatnonzero(inside)
        first = np.searchsorted(at, starts)
        lengths = np.diff(np.append(first, len(at)))
        place = np.arange(len(at), dtype=np.int64) - np.repeat(first, lengths)
        powers = np.cumprod(np.full(int(lengths.max()), _BASE, np.uint64))
        hashes = mixed(np.add.reduceat(_BYTE[low[at]] * powers[place], first) + lengths.astype(np.uint64) + np.where(odd_piece[starts], np.uint64(7), np.uint64(0)))
        hashes[hashes == 0] = np.uint64(1)
        code = self._look_up(hashes)
        missing = np.flatnonzero(code < 0)
        n, used = self.n, self.used
        if len(missing):
            new, where, back = np.unique(hashes[missing], return_index=True, return_inverse=True)
            rep = missing[where]
            is_odd = odd_piece[starts[rep]]
            order = np.argsort(is_odd, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            text = low.tobytes()
            cut = [text[a:b] for a, b in zip(starts[rep[order]].tolist(), (starts[rep[order]] + lengths[rep[order]]).tolist(), strict=True)]
            n_plain = int((~is_odd).sum())
            ids, count = self._encode(cut[:n_plain], cut[n_plain:])
            self._grow(len(ids), len(count))
            self.flat[used : used + len(ids)] = ids
            self.starts[n + 1 : n + 1 + len(count)] = used + np.cumsum(count)
            code[missing] = n + rank[back]
            if self.held + len(new) < self.SLOTS // 2:
                self._keep(new[order], n)
                self.n, self.used = n + len(count), used + len(ids)
        lo, size = self.starts[code], self.starts[code + 1] - self.starts[code]
        ends = np.cumsum(size)
        out = self.flat[np.repeat(lo - (ends - size), size) + np.arange(ends[-1])]
        text_ends = np.cumsum([len(t) + 1 for t in texts])
        return out, np.concatenate([[0], ends])[np.searchsorted(starts, text_ends)]


@functools.cache
def _tokenizer(path: str) -> PieceTokenizer:
    """One for each worker process, so that its pieces outlast a task."""
    return PieceTokenizer(path)


def tokenized(df: DataFrame, key: str, text: str, path: str, end: int = END, copy: str | None = None) -> DataFrame:
    """(key, copy, n, ids): copy is a column of whole numbers that is handed on (0 if none is named); ids as little-endian 16- or 32-bit numbers, the end id last; a null text counts as empty."""
    wide = _wide(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        for batch in batches:
            keys, numbers, texts = batch.column(0), batch.column(1), batch.column(2).cast(pa.binary()).to_pylist()
            at = 0
            while at < len(texts):  # long texts: a few MB at a time
                to, size = at, 0
                while to < len(texts) and (size == 0 or size < 2 << 20):
                    size += len(texts[to] or b"")
                    to += 1
                ids, ends = tokenizer.encode([t or b"" for t in texts[at:to]])
                ids = np.insert(ids, ends, end).astype(wide).tobytes()
                n = np.diff(ends, prepend=0) + 1
                size, edges = int(wide[2]), np.cumsum(n)
                blobs = pa.Array.from_buffers(pa.binary(), to - at, [None, pa.py_buffer(np.concatenate([[0], edges * size]).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([keys.slice(at, to - at), numbers.slice(at, to - at), pa.array(n, pa.int64()), blobs], names=["key", "copy", "n", "ids"])
                at = to

    number = (F.col(copy) if copy else F.lit(0)).cast("long").alias("copy")
    return df.select(F.col(key).cast("long").alias("key"), number, text).mapInArrow(run, "key long, copy long, n long, ids binary")


# ------------------------------------------------------------------- files

def write_files(df: DataFrame, key: str, text: str, path: str, out: str, end: int = END) -> DataFrame:
    """Encode df's texts to token files at `out` and return the table of file images (range, file, first_key, tokens, image), in ascending key order.

    Null keys come first, null texts count as empty, rows of one key follow
    each other by a hash of their ids and, where a row has many copies, its
    number among them, so that equal rows too are parted over ranges; columns
    other than the two are not read; repeated rows are each written, and an
    empty table gives no file. A key of -2^63 counts as null. The ids go once to the shared folder, beside the counts that the codes need.
    """
    spark = df.sparkSession
    wide = _wide(path)
    weight = df.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 1).alias("b")).first()["b"] or 0
    n = max(2, min(RANGES, weight // RANGE_BYTES))
    cuts = quantiles(df, key, n)
    ids = tokenized(numbered(df.select(key, text)), key, text, path, end, copy="__copy")
    ids = ids.withColumn("u", F.shiftrightunsigned(F.xxhash64("ids", "copy"), 33))
    ids = ids.withColumn("range", range_of(F.coalesce("key", F.lit(NULL_KEY)), F.col("u"), cuts))
    kept = f"{out}-ids"
    parts = max(1, min(len(cuts) + 1, int(spark.conf.get("spark.sql.shuffle.partitions")) * 2))
    ids.repartition(parts, "range").sortWithinPartitions("range", "key", "u", "ids").drop("u", "copy").write.option("compression", "zstd").mode("overwrite").parquet(kept)
    ids = spark.read.parquet(kept)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << 16, np.int64)
        for batch in batches:
            got = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), wide), minlength=len(seen))
            if len(got) > len(seen):
                seen = np.concatenate([seen, np.zeros(len(got) - len(seen), np.int64)])
            seen += got
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["id", "n"])

    # the vocabulary bounds what the driver gets
    found = ids.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(found["id"].max()) + 1 if len(found) else 1, np.int64)
    counts[found["id"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    lengths = code_lengths(counts)
    codes = canonical(lengths)

    def images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: list = []
        numbers = itertools.count(TaskContext.get().partitionId() << 32)

        def flush() -> Iterator[pa.RecordBatch]:
            keys, ns, blobs = zip(*held, strict=True)
            flat = np.frombuffer(b"".join(blobs), wide)
            image = file_image(np.array([NULL_KEY if k is None else k for k in keys], np.int64), np.array(ns), flat, lengths, codes)
            yield pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([next(numbers)], pa.int64()), pa.array([keys[0]], pa.int64()), pa.array([len(flat)], pa.int64()), pa.array([image], pa.binary())], names=["range", "file", "first_key", "tokens", "image"])
            held.clear()

        place, size = None, 0
        for batch in batches:
            for r, k, n, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (r != place or size + n > FILE_TOKENS):
                    yield from flush()
                    size = 0
                place = r
                held.append((k, n, b))
                size += n
        if held:
            yield from flush()

    made = ids.select("range", "key", "n", "ids").mapInArrow(images, "range int, file long, first_key long, tokens long, image binary")
    made.write.option("compression", "none").mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def _wide(path: str) -> str:
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"


def read_files(files: DataFrame, measure: bool = False) -> DataFrame:
    """The documents of token files: doc_id, n_tokens, start (ids of all documents before) and ids, or their ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, image in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys, counts, ids = read_image(image.as_py())
                ends = np.cumsum(counts.astype(np.int64))
                flat = ids.astype("<u4").tobytes()
                own = [flat[4 * a : 4 * b] for a, b in zip(ends - counts, ends, strict=True)]
                last = pa.array([zlib.crc32(x) for x in own], pa.int64()) if measure else pa.array(own, pa.binary())
                keys = pa.array(keys, pa.int64(), mask=keys == NULL_KEY)
                yield pa.RecordBatch.from_arrays([keys, pa.array(base + ends - counts, pa.int64()), pa.array(counts.astype(np.int64)), last], names=["doc_id", "start", "n_tokens", "last"])

    # a row for each range, and within a range a row for each file: never a row for each document
    within = Window.partitionBy("range").orderBy(F.col("first_key").asc_nulls_first(), "file").rowsBetween(Window.unboundedPreceding, -1)
    info = files.select("range", "first_key", "tokens", "file")
    sums = info.groupBy("range").agg(F.sum("tokens").alias("t")).select("range", F.coalesce(F.sum("t").over(Window.partitionBy().orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    starts = info.select("range", "file", F.coalesce(F.sum("tokens").over(within), F.lit(0)).alias("inside")).join(F.broadcast(sums), "range")
    starts = starts.select("file", (F.col("before") + F.col("inside")).alias("base"))
    placed = files.join(starts, "file").select("base", "image")
    kind = "long" if measure else "binary"
    return placed.mapInArrow(read, f"doc_id long, start long, n_tokens long, last {kind}").withColumnRenamed("last", "ids_crc32" if measure else "ids")


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, from files written to the shared folder and read back."""
    import uuid

    out = f"{shared_dir(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    return read_files(write_files(docs, key, text, path, out), measure=True)
