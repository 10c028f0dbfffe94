"""Sharding by a two-pass external shuffle.

Pass one scatters records into buckets of bounded size by seeded hashes of
their key; pass two shuffles each bucket by Fisher-Yates and writes it.  A
record's shard is the one whose seeded hash of the key is largest, so one more
shard takes records only into itself (law `key`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, shared_dir

#: Bytes of records that a bucket holds on average.
BUCKET_BYTES = 4 << 20


def shard_of(key: Column, shards: int, seed: int = 0) -> Column:
    """The shard whose hash of (seed, shard, key) is largest; equal keys, null too, share one."""
    marks = F.array(*(F.xxhash64(F.lit(seed), F.lit(j), key) for j in range(shards)))
    return (F.array_position(marks, F.array_max(marks)) - 1).cast("int")


def shard(df: DataFrame, key: str, shards: int = 16, text: str = "text", seed: int = 0, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """df with shard, bucket (within the shard) and slot, the record's place in its shard, gapless from 0.

    A record with a null key goes where null hashes to; null texts count no
    bytes; repeated rows are each placed, over all buckets of their shard;
    columns of df with those names are replaced. An empty table gives an empty
    one. The number of buckets follows the bytes of the table.
    """
    shared_dir(df.sparkSession)
    df = df.drop("shard", "bucket", "slot")
    size = F.coalesce(F.octet_length(text), F.lit(0)) + 1
    weight = df.agg(F.sum(size).alias("b")).first()["b"] or 0
    buckets = max(1, -(-weight // (shards * bucket_bytes)))
    rows = numbered(df)
    # rows of one key or text are spread over buckets, as a bucket is drawn from the whole row and its number among its copies
    whole = F.xxhash64(F.lit(seed + 1), *df.columns, "__copy")
    at = [shard_of(F.col(key), shards, seed).alias("__shard"), F.pmod(whole, F.lit(buckets)).cast("int").alias("__bucket")]
    dealt = rows.select(F.struct(*df.columns).alias("__row"), *at, F.xxhash64(F.lit(seed + 2), *df.columns, "__copy").alias("__h"))
    parts = max(1, min(shards * buckets, 100_000))
    # one array of a bucket's records, in an order that does not depend on the tasks, then Fisher-Yates
    gathered = dealt.repartition(parts, "__shard", "__bucket").groupBy("__shard", "__bucket").agg(F.sort_array(F.collect_list(F.struct("__h", "__row"))).alias("__rows"))
    mixed = gathered.sortWithinPartitions("__shard", "__bucket").select("__shard", "__bucket", F.shuffle("__rows", F.lit(seed)).alias("__rows"))
    counts = rows.select(*at).groupBy("__shard", "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__shard", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    placed = mixed.join(starts, ["__shard", "__bucket"]).select("__shard", "__bucket", "__start", F.posexplode("__rows").alias("__i", "__x"))
    return placed.select(*(F.col("__x.__row").getField(c).alias(c) for c in df.columns), F.col("__shard").alias("shard"), F.col("__bucket").alias("bucket"), (F.col("__start") + F.col("__i")).cast("long").alias("slot"))


def write_shards(df: DataFrame, key: str, path: str, shards: int = 16, **options) -> None:
    """The shards as Parquet folders shard=0..; rows carry their slot."""
    shard(df, key, shards, **options).write.partitionBy("shard").mode("overwrite").parquet(path)
