"""The folder that a cluster's driver and executors share, groups read in a row, and ranks within groups of any size."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def checkpoints(spark: SparkSession) -> None:
    """Sets a checkpoint folder where the session names none, as in tests; a cluster has to name one."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        place = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not place:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            import tempfile

            place = tempfile.mkdtemp(prefix="quillspark-")
        sc.setCheckpointDir(place)


def kept(df: DataFrame, *gone: DataFrame) -> DataFrame:
    """df from a table in the shared folder: a checkpoint in columns, a fraction of the bytes of its rows.

    The shuffles behind it are given up once it stands, and so are tables of
    earlier calls that nothing reads any more, `gone`.
    """
    spark = df.sparkSession
    checkpoints(spark)
    place = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    was = spark.conf.get(GIVE_UP, None)
    spark.conf.set(GIVE_UP, "true")
    try:
        df.write.parquet(place)
    finally:
        spark.conf.unset(GIVE_UP) if was is None else spark.conf.set(GIVE_UP, was)
    out = spark.read.schema(df.schema).parquet(place)
    for old in gone:
        _delete(spark, old._kept)
    out._kept = place
    return out


def _delete(spark: SparkSession, place: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Whether Spark deletes a query's shuffle files where it ends.
GIVE_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that a batch of results has before it is sent on.
BATCH = 10_000


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by its keys to a set number of tasks: rows that take long each are few bytes, by which Spark would put them into few tasks."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # by a hash of its own: rows that lie by these keys already would not be dealt again
    return df.repartition(parts, F.xxhash64(*keys))


#: Rows to a task where joins and groups sort them.
ROWS = 100_000


def tasks(*tables: DataFrame, rows: int | None = None) -> int:
    """How many tasks to deal the largest table to, ROWS to each if not given: they grow in number with it, not in size."""
    spark = tables[0].sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, *(-(-t.count() // (rows or ROWS)) for t in tables))


def by_group(df: DataFrame, key: str, order: list[str], fn: Callable[[object, list[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """fn(key, rows) -> rows of `schema` for each group of df, whose rows are its columns without the key, in order.

    Groups follow each other in one stream of sorted rows, so that many small
    ones cost little beside fn; one group at a time is held.
    """
    columns = [c for c in df.columns if c != key]
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def made(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) if rows else [()] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, out = None, [], []
        for b in batches:
            for k, *row in zip(b.column(key).to_pylist(), *(b.column(c).to_pylist() for c in columns), strict=True):
                if held and k != at:
                    out.extend(fn(at, held))
                    held = []
                    if len(out) >= BATCH:
                        yield made(out)
                        out = []
                at = k
                held.append(tuple(row))
        if held:
            out.extend(fn(at, held))
        yield made(out)

    return dealt(df, key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def hash_ranked(df: DataFrame, group: Column, key: str, seed: int, out: str) -> DataFrame:
    """df with each row's rank, from 0, within its group by a seeded hash of the key.

    Rows are ranked in as many stretches of the hash as the root of the table,
    then the stretches' counts are summed up: no window holds a group.
    """
    n = max(1, math.isqrt(df.count()))
    h = F.xxhash64(F.lit(seed), key)
    # the hash in ascending order, unsigned, so that stretches follow each other
    marked = df.withColumn("__g", group).withColumn("__h", F.shiftrightunsigned(h, 1)).withColumn("__c", F.floor(F.shiftrightunsigned(h, 33) * n / F.lit(1 << 31)))
    counts = marked.groupBy("__g", "__c").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__g").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("__g").alias("__g2"), F.col("__c").alias("__c2"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = marked.withColumn("__i", F.row_number().over(Window.partitionBy("__g", "__c").orderBy("__h", key)) - 1)
    got = inside.join(starts, inside["__g"].eqNullSafe(starts["__g2"]) & (inside["__c"] == starts["__c2"]))
    return got.withColumn(out, F.col("__start") + F.col("__i")).drop("__g", "__h", "__c", "__g2", "__c2", "__start", "__i")
