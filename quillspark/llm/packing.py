"""Best-fit packing of documents into bins of equal capacity, under conflicts.

Rows are dealt by a seeded hash to groups of bounded size. In a group, the
largest first, each piece goes to the bin with the least room that holds it;
bins stand in the order of their room and carry bitmaps of the sources and
duplicate clusters in them, and the search moves on to the next larger room
until a bin is compatible.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_words, words

#: Words to a bin, documents of one source in it at most, rows to a group.
CAPACITY, PER_SOURCE, GROUP = 2048, 2, 2048


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int = CAPACITY, per_source: int = PER_SOURCE) -> list[tuple[int, int, int, int]]:
    """(row, piece, bin, start) of each piece, rows in the given order.

    A row longer than a bin gives bins that it fills alone, then a rest.
    """
    out: list[tuple[int, int, int, int]] = []
    bit: dict = {}
    # by bin: clusters in it; per_source planes of sources, plane k for those with more than k documents
    have: list[list[int]] = []
    rooms: list[tuple[int, int]] = []
    for row, size in enumerate(sizes):
        piece = 0
        while size > capacity:
            out.append((row, piece, len(have), 0))
            have.append([-1, *[-1] * per_source])
            size, piece = size - capacity, piece + 1
        c, s = 1 << bit.setdefault(("c", clusters[row]), len(bit)), 1 << bit.setdefault(("s", sources[row]), len(bit))
        at = bisect_left(rooms, (size, -1))
        while at < len(rooms) and (have[rooms[at][1]][0] & c or have[rooms[at][1]][per_source] & s):
            at += 1
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            room, b = capacity, len(have)
            have.append([0] * (per_source + 1))
        out.append((row, piece, b, capacity - room))
        mine = have[b]
        mine[0] |= c
        for k in range(1, per_source + 1):
            if not mine[k] & s:
                mine[k] |= s
                break
        insort(rooms, (room - size, b))
    return out


def pack(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", capacity: int = CAPACITY, per_source: int = PER_SOURCE, group: int = GROUP, seed: int = 0) -> DataFrame:
    """(key, size, cluster, piece, bin_group, bin, start, words): the words of every row of df in bins.

    A bin (bin_group, bin) holds `capacity` words, of one cluster of equal texts
    (white space and case apart) one document, and of one source per_source
    documents. Null sources are one source; a text without words takes no room
    but has a place; repeated rows are placed each. Empty tables give none.
    Texts stay in the scan: only sizes and hashes move.
    """
    t = F.col(text)
    rows = df.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), n_words(t).alias("size"), F.xxhash64(F.lower(F.array_join(words(t), " "))).alias("cluster"), F.xxhash64(F.lit(seed), *df.columns).alias("h"))
    groups = max(1, -(-df.count() // group))
    # equal rows have one hash: their number among themselves spreads them, and neither depends on the files
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("n")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("n")
    rows = rows.withColumn("bin_group", F.pmod(F.xxhash64("h", "copy"), F.lit(groups)).cast("int"))
    kind = df.schema[key].dataType.simpleString()

    def place(got: pa.Table) -> pa.Table:
        got = got.sort_by([("size", "descending"), ("key", "ascending"), ("h", "ascending"), ("copy", "ascending")])
        sizes = got["size"].to_pylist()
        put = best_fit(sizes, got["source"].to_pylist(), got["cluster"].to_pylist(), capacity, per_source)
        i = pa.array([p[0] for p in put], pa.int64())
        out = got.select(["key", "size", "cluster", "bin_group"]).take(i)
        left = [min(capacity, sizes[r] - p * capacity) for r, p, _, _ in put]
        for name, column in (("piece", [p[1] for p in put]), ("bin", [p[2] for p in put]), ("start", [p[3] for p in put]), ("words", left)):
            out = out.append_column(name, pa.array(column, pa.int64()))
        return out

    packed = rows.groupBy("bin_group").applyInArrow(place, f"key {kind}, size long, cluster long, bin_group int, piece long, bin long, start long, words long")
    return packed.withColumnRenamed("key", key)
