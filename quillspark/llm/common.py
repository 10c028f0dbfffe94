"""Column helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the white space between words.
WHITE = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once.

    Catalyst copies a projected column into every place that uses it, lambdas
    included, where it would run again for each element; a lambda's own
    variable is never copied.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def _before(values: Column, fold: Callable[[Column], Column], join: Callable[[Column, Column], Column], block: int) -> Column:
    """fold of what stands before each element, in blocks, so that long arrays take n * block steps."""
    b = F.lit(block)

    def by_block(v: Column) -> Column:
        folds = F.when(F.size(v) > 0, F.transform(F.sequence(F.lit(0), ((F.size(v) - 1) / b).cast("int")), lambda i: fold(F.slice(v, i * b + 1, b)))).otherwise(F.array().cast("array<bigint>"))
        starts = let(folds, lambda s: F.transform(s, lambda _, i: fold(F.slice(s, F.lit(1), i))))
        return let(starts, lambda s: F.transform(v, lambda _, i: join(F.get(s, (i / b).cast("int")), fold(F.slice(v, i - i % b + 1, i % b)))))

    return let(values, by_block)


def prefix_sums(values: Column, block: int = 256) -> Column:
    """Exclusive running sums of an array."""
    return _before(values, total, lambda a, x: a + x, block)


def prefix_most(values: Column, block: int = 256) -> Column:
    """Exclusive running maxima of an array of numbers from 0; 0 at the start."""
    return _before(values, lambda v: F.coalesce(F.array_max(v).cast("long"), F.lit(0).cast("long")), F.greatest, block)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it; set here only where it is unset, as in tests."""
    sc = spark.sparkContext
    if found := sc._jsc.sc().getCheckpointDir():
        if found.isDefined():
            return found.get()
    place = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not place:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        place = tempfile.mkdtemp(prefix="quillspark-")
    sc.setCheckpointDir(place)
    return place


#: At most so many different rows are numbered copy by copy (16 MB of hashes), those with more copies than a 2^20th of the table, and FEW.
NUMBERED, FEW = 1 << 20, 16
#: Copies that one array holds while they are laid out.
AT_ONCE = 4096


def numbered(df: DataFrame, out: str = "__copy") -> DataFrame:
    """df with `out`, a number from 1 that tells a row's copies apart where it has many, else 1.

    Rows with many copies are counted and laid out again, AT_ONCE to a row that
    is dealt on its own, so that neither the order of files nor one task decides.
    """
    shared_dir(df.sparkSession)
    marked = df.withColumn("__equal", F.xxhash64(*df.columns))
    many = max(FEW, df.count() // NUMBERED)
    often = marked.groupBy("__equal").count().where(F.col("count") > many).select("__equal").checkpoint()
    one = F.lit(1).cast("long")
    if not often.count():
        return df.withColumn(out, one)
    # at most NUMBERED hashes, as each stands for a NUMBERED-th of the rows
    rest = marked.join(F.broadcast(often), "__equal", "left_anti").withColumn(out, one)
    counted = marked.join(F.broadcast(often), "__equal", "left_semi").groupBy(*df.columns).agg(F.count("*").alias("__n"))
    blocks = counted.withColumn("__block", F.explode(F.sequence(F.lit(0), F.floor((F.col("__n") - 1) / AT_ONCE))))
    blocks = blocks.withColumn("__deal", F.xxhash64(*df.columns, "__block")).repartition("__deal")
    first = F.col("__block") * AT_ONCE
    copies = blocks.withColumn(out, F.explode(F.sequence(first + 1, F.least(first + AT_ONCE, F.col("__n")))))
    return rest.select(*df.columns, out).unionByName(copies.select(*df.columns, out))
