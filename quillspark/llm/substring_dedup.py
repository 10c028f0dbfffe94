"""Removal of byte strings that occur earlier in the corpus, exact for a given length.

Suffixes are range-partitioned by their leading bytes with sampled splitters,
and each bucket sorts its own by multikey quicksort and finds the strings of
LENGTH bytes that more than one suffix has; suffixes with one lead that lie on
both sides of a splitter are compared across it.

Not every place needs a suffix: of each window of LENGTH bytes the least K-byte
string, by hash, is its lead, so that equal windows have equal leads at the same
distance. A suffix stands for the run of windows that it leads and carries the
bytes of them all. A lead that occurs once in the corpus leads no repeated
window; a count of hashes leaves those out first, where a chance match only
keeps a suffix that the comparison of bytes then finds to be alone.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir
from .word_hash import mixed

#: Bytes of a string that counts as repeated, bytes of a lead, windows that one lead may serve.
LENGTH, K = 100, 36
REACH = LENGTH - K + 1
#: Bytes and documents to a chunk; bytes of text to a bucket of hashes.
CHUNK_BYTES, CHUNK_DOCS, BUCKET_BYTES = 2 << 20, 4096, 4 << 20
#: Bits of a hash that are counted beside those of its bucket, and bits of the bucket at least and most.
TAIL_BITS, LEAST_BITS, MOST_BITS = 40, 6, 20
#: Suffixes to a range, sampled suffixes to a splitter, splitters at most (about 14 MB).
RANGE_ROWS, PER_SPLITTER, SPLITTERS = 40_000, 4, 1 << 18
#: Suffixes that are cut out of a chunk at once.
SLICE = 1 << 17

_random = np.random.default_rng(8)
_BYTE = _random.integers(0, 1 << 64, 256, dtype=np.uint64)
NULL_KEY = -(2**63)

_POWER = {n: np.uint64(pow(0x9E3779B97F4A7C15, n, 1 << 64)) for n in (1, 2, 4, 8, 16, 32, 64)}
#: Places to a block of the scan, whose arrays stay in a core's cache, and the bits of a place in it.
BLOCK, PLACE = 1 << 16, np.uint64((1 << 18) - 1)


def _rolling(data: np.ndarray, size: int) -> np.ndarray:
    """The hash of the `size` bytes at each place, by doubling."""
    by, n = {1: _BYTE[data]}, 1
    while 2 * n <= size:
        h = by[n]
        by[2 * n] = h[: len(h) - n] * _POWER[n] + h[n:]
        n *= 2
    got, done = by[n], n
    while done < size:
        n = 1 << ((size - done).bit_length() - 1)
        tail = by[n][done:]
        got = got[: len(tail)] * _POWER[n] + tail
        done += n
    return got


def _spread(x: np.ndarray) -> np.ndarray:
    """Orders rolling hashes at random, in place."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbours, from each place on."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[: len(x) - step], x[step:])
        done += step
    return x


def leads(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, first window, last window, hash) of every lead of a run of documents that stop at `ends`, ascending.

    A window's lead is the leftmost of its K-byte strings with the least hash,
    which only the window's own bytes decide; a lead's windows are one run.
    """
    windows = len(data) - LENGTH + 1
    none = np.zeros(0, np.int64)
    if windows <= 0:
        return none, none, none, none.astype(np.uint64)
    valid = np.ones(windows, bool)
    for e in ends.tolist():  # windows that run over a document's end are none
        valid[max(0, e - LENGTH + 1) : e] = False
    parts = []
    for b in range(0, windows, BLOCK):
        n = min(BLOCK, windows - b)
        short = _spread(_rolling(data[b : b + n + LENGTH - 1], K))
        least = _sliding_least((short & ~PLACE) | np.arange(len(short), dtype=np.uint64), REACH)
        p = np.flatnonzero(valid[b : b + n])
        at = (least[p] & PLACE).astype(np.int64)
        first = np.flatnonzero(np.diff(at, prepend=-1) != 0)
        last = np.append(first[1:], len(p))[: len(first)] - 1
        parts.append((at[first] + b, p[first] + b, p[last] + b, mixed(short[at[first]])))
    place, lo, hi, h = (np.concatenate(x) for x in zip(*parts, strict=True))
    new = np.diff(place, prepend=-1) != 0  # else a run that goes on over a block's end
    return place[new], lo[new], hi[np.append(np.flatnonzero(new)[1:], len(place))[: new.sum()] - 1], h[new]


# ------------------------------------------------------------------- texts

_TEXTS = "bucket long, chunk long, n long, blob binary"


def _table(rows: list[tuple], names: tuple[str, ...] = ("bucket", "chunk", "n", "blob"), kinds=(pa.int64(), pa.int64(), pa.int64(), pa.binary())) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=list(names))


def tie(text: bytes) -> int:
    """What rows of one id are ordered by: a hash of their text."""
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest()) >> 1


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's rows as compressed chunks, by id within; then by a hash of the text."""
    from pyspark import TaskContext

    chunk, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
    codec = pa.Codec("zstd", 3)

    def made() -> list[pa.RecordBatch]:
        order = sorted(range(len(ids)), key=lambda i: (ids[i], tie(texts[i])))
        raw = pickle.dumps((np.array([ids[i] for i in order], np.int64), [texts[i] for i in order]))
        return _table([(-1, chunk, len(raw), codec.compress(raw, asbytes=True))]).to_batches()

    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            ids.append(NULL_KEY if i is None else i)
            texts.append(t or b"")
            size += len(texts[-1])
            if size >= CHUNK_BYTES or len(ids) >= CHUNK_DOCS:
                yield from made()
                chunk, ids, texts, size = chunk + 1, [], [], 0
    if ids:
        yield from made()


def _opened(n: int, blob: bytes) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """(ids, texts, their ends, all bytes) of a chunk."""
    ids, texts = pickle.loads(pa.Codec("zstd", 3).decompress(blob, n, asbytes=True))
    return ids, texts, np.cumsum([len(t) for t in texts], dtype=np.int64), np.frombuffer(b"".join(texts), np.uint8)


# -------------------------------------------------------- leads that repeat

def _deal(bits: int, tail_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A chunk's distinct hashes, ascending, as a row for each bucket of them."""
        for batch in batches:
            for chunk, n, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                _, _, ends, data = _opened(n, blob.as_py())
                h = np.unique(leads(data, ends)[3])
                cut = np.searchsorted((h >> np.uint64(64 - bits)).astype(np.int64), np.arange((1 << bits) + 1))
                tail = (h >> np.uint64(64 - bits - tail_bits)) & np.uint64((1 << tail_bits) - 1)
                raw = np.ascontiguousarray(tail.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])
                yield from _table([(int(b), chunk, int(cut[b + 1] - cut[b]), raw[cut[b] : cut[b + 1]].tobytes()) for b in np.flatnonzero(np.diff(cut))]).to_batches()

    return run


def _count(key: tuple, table: pa.Table) -> pa.Table:
    """For each chunk's hashes of a bucket a row of bits: more than one chunk has it."""
    n = table["n"].to_numpy()
    raw = np.zeros((int(n.sum()), 8), np.uint8)
    raw[:, :5] = np.frombuffer(b"".join(table["blob"].to_pylist()), np.uint8).reshape(-1, 5)
    tail = raw.view("<u8").ravel()
    by = np.argsort(tail, kind="stable")
    many = np.diff(np.append(np.flatnonzero(np.diff(tail[by], prepend=tail[by[0]] ^ np.uint64(1))), len(tail)))
    repeated = np.empty(len(tail), bool)
    repeated[by] = np.repeat(many > 1, many)
    ends = np.cumsum(n)
    return _table([(key[0].as_py(), c, int(k), np.packbits(repeated[e - k : e]).tobytes()) for c, k, e in zip(table["chunk"].to_pylist(), n, ends, strict=True)])


# ----------------------------------------------------------------- suffixes

def _ragged(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The strings data[start : start + length] as one Arrow array."""
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    at = np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[at].tobytes())])


def _flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a column of strings without nulls."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(a, pa.ChunkedArray):
        a = pa.concat_arrays(a.chunks) if a.num_chunks else pa.array([], pa.binary())
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(a.buffers()[1], "<i4")[a.offset : a.offset + len(a) + 1].astype(np.int64)
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


#: A suffix: its chunk, the id of its document, its place; its lead, the bytes before it and behind it that its windows take in.
#: Or, where `lead` is null, runs of windows of the chunk that occur earlier, in `after`.
_SUFFIX = "chunk long, id long, tie long, place long, lead binary, before binary, after binary"
_SUFFIX_NAMES = ["chunk", "id", "tie", "place", "lead", "before", "after"]


def _runs(starts: np.ndarray, counts: np.ndarray) -> bytes:
    return np.stack([starts, counts], 1).astype("<i4").tobytes()


def _suffixes(key: tuple, table: pa.Table) -> pa.Table:
    """The suffixes of a chunk whose lead repeats; equal ones of a slice once, the rest being covered."""
    rows = table.to_pylist()
    text = next(r for r in rows if r["bucket"] < 0)
    found = sorted((r for r in rows if r["bucket"] >= 0), key=lambda r: r["bucket"])
    ids, texts, ends, data = _opened(text["n"], text["blob"])
    ties = np.array([tie(t) for t in texts], np.int64)
    place, lo, hi, h = leads(data, ends)
    _, back, counts = np.unique(h, return_inverse=True, return_counts=True)
    bits = [np.unpackbits(np.frombuffer(r["blob"], np.uint8), count=r["n"]) for r in found]
    repeated = np.concatenate(bits).astype(bool) if bits else np.zeros(0, bool)
    mine = np.flatnonzero((repeated | (counts > 1))[back]) if len(h) else np.zeros(0, np.int64)
    schema = pa.schema([("chunk", pa.int64()), ("id", pa.int64()), ("tie", pa.int64()), ("place", pa.int64()), ("lead", pa.binary()), ("before", pa.binary()), ("after", pa.binary())])
    out = [schema.empty_table()]
    for s in range(0, len(mine), SLICE):
        p, a, b = (x[mine[s : s + SLICE]] for x in (place, lo, hi))
        same = _ragged(data, a, b - a + LENGTH).dictionary_encode().indices.to_numpy()
        first = np.zeros(len(p), bool)
        first[np.unique(same, return_index=True)[1]] = True
        if not first.all():
            covered = pa.array([_runs(a[~first], (b - a + 1)[~first])], pa.binary())
            out.append(pa.table([pa.array([text["chunk"]]), *[pa.nulls(1, pa.int64())] * 3, pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), covered], schema=schema))
        p, a, b = p[first], a[first], b[first]
        parts = _ragged(data, p, np.full(len(p), K)), _ragged(data, a, p - a), _ragged(data, p + K, b + LENGTH - p - K)
        of = np.searchsorted(ends, p, side="right")
        out.append(pa.table([pa.array(np.full(len(p), text["chunk"])), pa.array(ids[of]), pa.array(ties[of]), pa.array(p), *parts], schema=schema))
    return pa.concat_tables(out)


# ------------------------------------------------------------------- ranges

def _keys(lead: pa.ChunkedArray | pa.Array, ids: np.ndarray, chunks: np.ndarray) -> np.ndarray:
    """The strings by which suffixes are dealt to ranges: lead, then id and chunk in an order of bytes."""
    out = np.zeros((len(ids), K + 16), np.uint8)
    out[:, :K] = _flat(lead)[0].reshape(-1, K)
    out[:, K : K + 8] = (ids.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
    out[:, K + 8 :] = chunks.astype(">i8").view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(out).view(f"S{K + 16}").ravel()


def splitters(keys: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """(ascending splitters, leads that lie on both sides of one) from sampled keys.

    A splitter stands before all suffixes of its lead, unless the sample gives
    the lead to more than one splitter: those part it by id.
    """
    if ranges < 2 or not len(keys):
        return keys[:0], keys[:0].astype(f"S{K}")
    at = np.sort(keys)[np.arange(1, ranges) * len(keys) // ranges]
    raw = np.ascontiguousarray(np.unique(at)).view(np.uint8).reshape(-1, K + 16).copy()
    lead = np.ascontiguousarray(raw[:, :K]).view(f"S{K}").ravel()
    first = np.ones(len(lead), bool)
    first[1:] = lead[1:] != lead[:-1]
    raw[first, K:] = 0
    cuts = np.unique(np.ascontiguousarray(raw).view(f"S{K + 16}").ravel())
    return cuts, np.unique(lead[~first])


def _to_range(cuts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _keys(batch.column("lead"), batch.column("id").to_numpy(), batch.column("chunk").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.searchsorted(cuts, keys, side="right").astype(np.int64))], names=[*_SUFFIX_NAMES, "range"])

    return run


def suffix_order(words: np.ndarray) -> np.ndarray:
    """The order of the rows of a matrix of words, by multikey quicksort: groups that agree so far are sorted by the next word."""
    order = np.argsort(words[:, 0], kind="stable")
    new = np.arange(len(order)) == 0
    for w in range(1, words.shape[1] + 1):
        last = words[order, w - 1]
        new[1:] |= last[1:] != last[:-1]
        alone = new & np.append(new[1:], True)
        left = np.flatnonzero(~alone)
        if w == words.shape[1] or not len(left):
            break
        group = np.cumsum(new)[left]
        rows = order[left]
        order[left] = rows[np.lexsort((words[rows, w], group))]
    return order


def _sorted(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank of each row of bytes, bytes that each row shares with the one before it in that order)."""
    n, width = strings.shape
    order = suffix_order(strings.view(">u8").astype(np.uint64))
    shared = np.zeros(n, np.int64)
    for s in range(1, n, SLICE):
        a, b = strings[order[s : s + SLICE]], strings[order[s - 1 : s - 1 + len(order[s : s + SLICE])]]
        differ = a != b
        shared[s : s + SLICE] = np.where(differ.any(1), differ.argmax(1), width)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    return rank, shared


_FOUND_NAMES = ["chunk", "id", "tie", "start", "window", "runs"]
_FOUND_KINDS = (*[pa.int64()] * 4, pa.binary(), pa.binary())
_FOUND = "chunk long, id long, tie long, start long, window binary, runs binary"


def _by_chunk(chunks: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> pa.Table:
    """A row of runs for each chunk."""
    by = np.argsort(chunks, kind="stable")
    edge = np.flatnonzero(np.diff(chunks[by], prepend=-1))
    if not len(edge):
        return _table([], tuple(_FOUND_NAMES), _FOUND_KINDS)
    rows = [(int(chunks[by[a]]), None, None, None, None, _runs(starts[by[a:b]], counts[by[a:b]])) for a, b in zip(edge, np.append(edge[1:], len(by)), strict=True)]
    return _table(rows, tuple(_FOUND_NAMES), _FOUND_KINDS)


def _compare(both_sides: np.ndarray):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """The windows of a range's suffixes that occur earlier in it, and the others of the leads `both_sides`, one by one.

        Two windows are one string if their leads stand at the same distance d,
        and the suffixes share LENGTH - d bytes from the lead on, and d bytes
        before it. Sorted, and sorted backwards, suffixes that share as much
        are neighbours.
        """
        ids, ties, chunks, place = (table[c].to_numpy() for c in ("id", "tie", "chunk", "place"))
        by = np.lexsort((place, chunks, ties, ids))
        n, ids, ties, chunks, place = len(by), ids[by], ties[by], chunks[by], place[by]
        right, left = np.zeros((n, 104), np.uint8), np.zeros((n, 64), np.uint8)
        right[:, :K] = _flat(table["lead"])[0].reshape(-1, K)[by]
        sizes = []
        for name, into, backwards in (("before", left, True), ("after", right, False)):
            flat, offsets = _flat(table[name])
            size = np.diff(offsets)[by]
            for s in range(0, n, SLICE):
                own = size[s : s + SLICE]
                before = np.cumsum(own) - own
                column = np.arange(own.sum()) - np.repeat(before, own)
                value = flat[np.repeat(offsets[by[s : s + SLICE]], own) + column]
                row = np.repeat(np.arange(s, s + len(own)), own)
                into[row, np.repeat(own, own) - 1 - column if backwards else K + column] = value
            sizes.append(size)
        most, least = sizes[0], LENGTH - K - sizes[1]
        rank_r, shared_r = _sorted(right)
        rank_l, shared_l = _sorted(left)
        covered = np.zeros((n, REACH), bool)  # by start, so that d falls
        for d in range(REACH):
            some = np.flatnonzero((least <= d) & (d <= most))
            if len(some) < 2:
                continue
            string = np.cumsum(shared_r < LENGTH - d)[rank_r[some]] * (n + 1) + np.cumsum(shared_l < d)[rank_l[some]]
            later = np.ones(len(some), bool)
            later[np.unique(string, return_index=True)[1]] = False
            covered[some[later], REACH - 1 - d] = True
        change = np.diff(covered.astype(np.int8), axis=1, prepend=0, append=0)
        row, start = np.nonzero(change == 1)
        stop = np.nonzero(change == -1)[1]
        out = [_by_chunk(chunks[row], place[row] - REACH + 1 + start, stop - start)]
        if len(both_sides):
            lead = np.ascontiguousarray(right[:, :K]).view(f"S{K}").ravel()
            some = np.flatnonzero(np.isin(lead, both_sides))
            whole = np.concatenate([left[some][:, ::-1], right[some]], 1)
            for d in range(REACH):
                on = np.flatnonzero((least[some] <= d) & (d <= most[some]) & ~covered[some, REACH - 1 - d])
                if len(on):
                    cut = np.ascontiguousarray(whole[on, 64 - d : 64 - d + LENGTH])
                    window = _ragged(cut.ravel(), np.arange(len(on)) * LENGTH, np.full(len(on), LENGTH))
                    at = some[on]
                    out.append(pa.table([pa.array(chunks[at]), pa.array(ids[at]), pa.array(ties[at]), pa.array(place[at] - d), window, pa.nulls(len(on), pa.binary())], names=_FOUND_NAMES))
        return pa.concat_tables(out)

    return run


def _late(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield from _by_chunk(batch.column(0).to_numpy(), batch.column(1).to_numpy(), np.ones(batch.num_rows, np.int64)).to_batches()


# ------------------------------------------------------------------ results

_REMOVED = "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept_sha256 string"


def _last(key: tuple, table: pa.Table) -> pa.Table:
    """A chunk's documents with what its runs of windows cover."""
    rows = table.to_pylist()
    text = next(r for r in rows if r["bucket"] < 0)
    ids, texts, ends, data = _opened(text["n"], text["blob"])
    runs = np.frombuffer(b"".join(r["blob"] for r in rows if r["bucket"] >= 0), "<i4").reshape(-1, 2).astype(np.int64)
    step = np.zeros(len(data) + 1, np.int32)
    np.add.at(step, runs[:, 0], 1)
    np.add.at(step, runs.sum(1) - 1 + LENGTH, -1)
    covered = np.cumsum(step[:-1]) > 0
    change = np.flatnonzero(np.diff(covered.astype(np.int8), prepend=0, append=0))
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    for a, b in zip(change[::2].tolist(), change[1::2].tolist(), strict=True):  # a run of bytes may go on over documents' ends
        k = int(np.searchsorted(ends, a, side="right"))
        while a < b:
            start, to = int(ends[k]) - len(texts[k]), min(b, int(ends[k]))
            if to > a:
                spans[k].append((a - start, to - start))
            a, k = to, k + 1
    digests = []
    for t, own in zip(texts, spans, strict=True):
        digest, at = hashlib.sha256(), 0
        for a, b in own:
            digest.update(t[at:a])
            at = b
        digest.update(t[at:])
        digests.append(digest.hexdigest())
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    removed = pa.array([[{"start": a, "end": b} for a, b in own] for own in spans], kind)
    return pa.table([pa.array(ids, mask=ids == NULL_KEY), pa.array([len(t) for t in texts], pa.int64()), removed, pa.array(digests, pa.string())], names=["doc_id", "n_bytes", "removed", "kept_sha256"])


def repeats(df: DataFrame, key: str = "doc_id", text: str = "text", range_rows: int = RANGE_ROWS, tail_bits: int = TAIL_BITS) -> DataFrame:
    """(doc_id, n_bytes, removed, kept_sha256) for every row of df, other columns left behind.

    removed: the maximal runs of bytes that a string of LENGTH bytes covers
    which also starts earlier, in a row of smaller key or before in the same
    row. Strings are compared by their bytes. Null keys come first (and -2^63
    counts as null); rows of one key follow each other by a hash of their text,
    wherever they are read, and wholly equal rows stand for each other; null and
    empty texts have no bytes. An empty table gives an empty one. df is read for
    its size, then once more to a table in the shared folder.
    """
    spark = df.sparkSession
    place = f"{shared_dir(spark)}/substrings-{uuid.uuid4().hex}"

    def kept(made: DataFrame, name: str, codec: str) -> DataFrame:
        made.write.option("compression", codec).mode("overwrite").parquet(f"{place}/{name}")
        return spark.read.parquet(f"{place}/{name}")

    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    weight = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    bits = max(LEAST_BITS, min(MOST_BITS, int(weight // BUCKET_BYTES).bit_length()))
    texts = kept(docs.mapInArrow(_chunked, _TEXTS), "texts", "none")
    counted = texts.mapInArrow(_deal(bits, tail_bits), _TEXTS).groupBy("bucket").applyInArrow(_count, _TEXTS)
    suffixes = kept(counted.unionByName(texts).groupBy("chunk").applyInArrow(_suffixes, _SUFFIX), "suffixes", "zstd")
    own = suffixes.where("lead is not null")
    n = own.count()
    ranges = max(1, min(SPLITTERS, n // range_rows))
    rate = max(1, n // (ranges * PER_SPLITTER))
    sample = own.where(F.pmod(F.xxhash64("chunk", "place"), F.lit(rate)) == 0).select("lead", "id", "chunk").toArrow() if ranges > 1 else None
    cuts, both_sides = splitters(_keys(sample["lead"], sample["id"].to_numpy(), sample["chunk"].to_numpy()), ranges) if sample else splitters(np.zeros(0, f"S{K + 16}"), 1)
    found = kept(own.mapInArrow(_to_range(cuts), f"{_SUFFIX}, range long").groupBy("range").applyInArrow(_compare(both_sides), _FOUND), "found", "zstd")
    covers = [suffixes.where("lead is null").select("chunk", F.col("after").alias("runs")), found.where("window is null").select("chunk", "runs")]
    if len(both_sides):
        # at most one of each string a range: few enough for one task
        order = Window.partitionBy("window").orderBy("id", "tie", "chunk", "start")
        late = found.where("window is not null").withColumn("i", F.row_number().over(order)).where("i > 1")
        covers.append(late.select("chunk", "start").mapInArrow(_late, _FOUND).select("chunk", "runs"))
    rows = texts
    for c in covers:
        rows = rows.unionByName(c.select(F.lit(0).cast("long").alias("bucket"), "chunk", F.lit(0).cast("long").alias("n"), F.col("runs").alias("blob")))
    return rows.groupBy("chunk").applyInArrow(_last, _REMOVED)


def cut(df: DataFrame, removed: DataFrame, key: str = "doc_id", text: str = "text", out: str = "kept") -> DataFrame:
    """df with the bytes of its text that stay, from the runs that repeats() gave; keys are unique here."""
    got = df.join(removed.select(F.col("doc_id").alias("__k"), "removed"), F.col(key).eqNullSafe(F.col("__k")), "left")
    raw = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("removed", lambda x: x["end"]))
    ends = F.concat(F.transform("removed", lambda x: x["start"]), F.array(F.octet_length(raw).cast("long")))
    hexed = F.array_join(F.zip_with(starts, ends, lambda a, b: F.hex(F.substring(raw, (a + 1).cast("int"), (b - a).cast("int")))), "")
    return got.withColumn(out, F.unhex(hexed)).drop("__k", "removed")
