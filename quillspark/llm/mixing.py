"""Mixing sources to target weights by a low-discrepancy schedule.

Golden-ratio points go through the sources' cumulative targets; a source's
slots are ranked, and the k-th takes the k-th block of equal words of that
source's shuffled stream, which repeats the source up to three times.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, n_words, shared_dir, words

#: Words in a block; the most times that a document is used.
BLOCK, REPEATS = 64, 3
#: Up to so many sources (about 1 MB), their targets are broadcast; beyond, they are joined by shuffles.
FEW_SOURCES = 10_000
GOLDEN = 0.6180339887498949
#: Column that names the source: null sorts last, names by code point.
SRC = "__src"


def _source(column: Column) -> Column:
    return F.coalesce(F.concat(F.lit("a"), column.cast("string")), F.lit("z"))


def running(df: DataFrame, chunk: Column, order: list, value: Column, out: str) -> DataFrame:
    """df with the exclusive running sum of value per source in the order (chunk, order): within chunks, then over the chunks' sums.

    With as many chunks as the root of the rows, neither window holds more
    than about the root, whatever one source's share.
    """
    df = df.withColumn("__c", chunk).withColumn("__v", value)
    inner = Window.partitionBy(SRC, "__c").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(SRC).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(SRC, "__c").agg(F.sum("__v").alias("__s"))
    starts = sums.select(SRC, "__c", F.coalesce(F.sum("__s").over(outer), F.lit(0)).alias("__start"))
    inside = df.withColumn("__in", F.coalesce(F.sum("__v").over(inner), F.lit(0)))
    return inside.join(starts, [SRC, "__c"]).withColumn(out, F.col("__start") + F.col("__in")).drop("__c", "__v", "__in", "__start")


def _chunks(rows: int) -> int:
    return max(1, math.isqrt(rows))


def sizes(df: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """key, source, size and, to tell rows apart, a hash of the row and a number among equal rows."""
    rows = df.select(F.col(key), _source(F.col(source)).alias(SRC), n_words(F.col(text)).alias("size"), F.xxhash64(*df.columns).alias("__tie"))
    equal = rows.groupBy(*rows.columns).agg(F.count("*").cast("int").alias("__n"))
    return equal.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n")))).drop("__n")


def targets(sized: DataFrame) -> DataFrame:
    """source, source_size, target: weights 1, 2, 3, repeating by code point, null last.

    Targets stop at REPEATS times their source's size; the level of the others
    rises until all words are shared. A source is one row here, so the ordered
    windows without a key hold sources, not documents.
    """
    per = sized.groupBy(SRC).agg(F.sum("size").cast("long").alias("source_size"))
    per = per.withColumn("w", ((F.row_number().over(Window.partitionBy().orderBy(SRC)) - 1) % 3 + 1).cast("double")).withColumn("most", REPEATS * F.col("source_size").cast("double"))
    # sources fill up in the order of most / w; the level is that at which the first that stays open stays so
    fill = Window.partitionBy().orderBy(F.col("most") / F.col("w"), SRC)
    before, rest, every = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    left = F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    per = per.withColumn("level", F.greatest(F.lit(0.0), left) / F.sum("w").over(rest)).withColumn("open", F.col("level") * F.col("w") <= F.col("most"))
    level = F.min(F.when(F.col("open"), F.struct((F.col("most") / F.col("w")).alias("r"), "level"))).over(every)["level"]
    return per.withColumn("level", level).select(SRC, "source_size", F.least(F.col("most"), F.coalesce(F.col("level"), F.lit(0.0)) * F.col("w")).alias("target"))


def schedule(shares: DataFrame, n_words: int, block: int) -> DataFrame:
    """slot, source, k: a slot takes its source's k-th block; slots follow golden-ratio points through the cumulative targets."""
    slots = max(1, round(n_words / block))
    every = Window.partitionBy()
    upto, whole, last = F.sum("target").over(every.orderBy(SRC)), F.sum("target").over(every), F.max(SRC).over(every)
    ranges = shares.where("target > 0").select(SRC, ((upto - F.col("target")) / whole).alias("lo"), F.when(F.col(SRC) == last, 2.0).otherwise(upto / whole).alias("hi"))
    # a range join on equal cells of [0, 1): a cell meets the few ranges that it overlaps, and a wide range has many cells
    cells = 4096
    cell = lambda x: F.least(F.floor(x * cells), F.lit(cells - 1).cast("long"))
    spread = ranges.withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))))
    low, high = F.col("id") % (1 << 20), F.floor(F.col("id") / (1 << 20))  # each product stays small, so that its fraction is exact enough
    turn = (low + 0.5) * GOLDEN + high * math.fmod((1 << 20) * GOLDEN, 1)
    points = shares.sparkSession.range(slots).select(F.col("id").alias("slot"), (turn - F.floor(turn)).alias("u")).withColumn("cell", cell(F.col("u")))
    got = points.join(spread, "cell").where("u >= lo and u < hi").select("slot", SRC)
    return running(got, F.floor(F.col("slot") / (slots // _chunks(slots) + 1)), ["slot"], F.lit(1).cast("long"), "k")


def blocks(sized: DataFrame, key: str, shares: DataFrame, rows: int, block: int, seed: int) -> DataFrame:
    """A row for each piece of a document in a block, with epoch, k, from_word and to_word.

    A source's documents follow each other by a seeded hash, another in each of
    as many rounds as its target may need.
    """
    need = F.ceil((F.col("target") + 8 * block) / F.greatest(F.col("source_size"), F.lit(1)))
    rounds = F.sequence(F.lit(0), F.greatest(F.least(need, F.lit(REPEATS)) - 1, F.lit(0)).cast("int"))
    used = sized.where("size > 0").join(shares, SRC).withColumn("epoch", F.explode(rounds)).drop("target", "source_size")
    used = used.withColumn("__h", F.xxhash64(F.lit(seed), "epoch", key, "__tie", "__copy"))
    n = _chunks(rows)
    used = running(used, F.col("epoch") * n + F.pmod("__h", F.lit(n)).cast("int"), ["__h", key, "__tie", "__copy"], F.col("size"), "__at")
    first, last = F.floor(F.col("__at") / block), F.floor((F.col("__at") + F.col("size") - 1) / block)
    used = used.withColumn("k", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.col("k") * block - F.col("__at"), F.lit(0))
    hi = F.least((F.col("k") + 1) * block - F.col("__at"), F.col("size"))
    return used.select(key, "__tie", "__copy", "epoch", SRC, "k", lo.cast("long").alias("from_word"), hi.cast("long").alias("to_word"))


def mix(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", block: int = BLOCK, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pieces, sized, shares): the pieces that the mix takes, with slot; every row's size; the sources' targets.

    A null text counts no words, and null is a source of its own, last. Equal
    rows are numbered and taken each for itself. An empty table gives empty
    results. The sizes, without texts, are written once to the shared folder.
    """
    shared_dir(df.sparkSession)
    sized = sizes(df, key, source, text).checkpoint()
    shares = targets(sized).checkpoint()
    about = sized.agg(F.sum("size").alias("words"), F.count("*").alias("rows")).first()
    few = F.broadcast(shares) if shares.count() <= FEW_SOURCES else shares
    slots = schedule(shares, about["words"] or 0, block)
    taken = blocks(sized, key, few, about["rows"], block, seed).join(slots, [SRC, "k"])
    return taken, sized.join(few, SRC), shares


def takes(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", block: int = BLOCK, seed: int = 0) -> DataFrame:
    """key, size, source_size, target, taken for every row of df."""
    pieces, sized, _ = mix(df, key, source, text, block, seed)
    none = sized.select(key, "__tie", "__copy", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    took = pieces.select(key, "__tie", "__copy", *(F.lit(None).cast(t).alias(c) for c, t in (("size", "long"), ("source_size", "long"), ("target", "double"))), (F.col("to_word") - F.col("from_word")).alias("taken"))
    out = none.unionByName(took).groupBy(key, "__tie", "__copy").agg(*(F.max(c).alias(c) for c in ("size", "source_size", "target")), F.sum("taken").cast("long").alias("taken"))
    return out.drop("__tie", "__copy")


def mixed(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", block: int = BLOCK, seed: int = 0) -> DataFrame:
    """The rows of the mix with df's columns: a row for each round that takes some of a document, its text cut to the words taken then."""
    pieces, _, _ = mix(df, key, source, text, block, seed)
    part = pieces.groupBy(F.col(key).alias("__key"), "__tie", "__copy", "epoch").agg(F.min("from_word").alias("__from"), F.max("to_word").alias("__to"))
    # equal rows differ in no column, so that one of them stands for all and is repeated by their uses
    rows = df.withColumn("__tie", F.xxhash64(*df.columns)).dropDuplicates([key, "__tie"])
    got = rows.join(part, rows[key].eqNullSafe(part["__key"]) & (rows["__tie"] == part["__tie"])).drop(part["__tie"])
    n = F.col("__to") - F.col("__from")
    cut = lambda w: F.when((F.col("__from") == 0) & (n == F.size(w)), F.col(text)).otherwise(F.array_join(F.slice(w, (F.col("__from") + 1).cast("int"), n.cast("int")), " "))
    got = got.withColumn("__new", let(words(F.col(text)), cut))
    return got.select(*(F.col("__new").alias(c) if c == text else F.length("__new").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in df.columns))
