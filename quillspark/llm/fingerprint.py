"""Document fingerprints: a homomorphic hash of the multiset of a text's paragraphs.

A paragraph's pieces hash to wide vectors, and a text's fingerprint is their
sum: lanes modulo 2^62 that tell multisets apart, and lanes of one bit, kept
modulo 2^32 two to a number, whose centred counts make likeness a cosine.
Sums do not depend on order, and adding or taking away a paragraph adds or
takes away its vector.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import let, numbered

#: A piece ends after a line break or a sentence's end; every paragraph ends in one line break.
PIECE = r"(?<=\n|[.!?]\x20)"
EQUAL = 2
SEEDS = 3
LANES = 1 << 32 | 1
M62, M32 = (1 << 62) - 1, (1 << 32) - 1


def pieces(text: Column) -> Column:
    return F.filter(F.split(F.concat(F.coalesce(text, F.lit("")), F.lit("\n")), PIECE), lambda p: p != "")


def vector(text: Column) -> Column:
    """The fingerprint as an array of longs: the count of pieces, EQUAL wide lanes, then packed bit lanes."""

    def packed(h: Column) -> Column:
        lane = lambda x, s: F.call_function("shiftright", x, s).bitwiseAND(F.lit(LANES))
        # a text has fewer than 2^31 pieces, so that no lane runs over into the next
        return F.transform(F.sequence(F.lit(0), F.lit(31)), lambda s: F.aggregate(h, F.lit(0).cast("long"), lambda a, x: a + lane(x, s)))

    def summed(p: Column) -> Column:
        hashed = lambda k: F.transform(p, lambda x: F.xxhash64(F.lit(k), x))
        wide = [F.aggregate(hashed(100 + k), F.lit(0).cast("long"), lambda a, x: (a + x.bitwiseAND(F.lit(M62))).bitwiseAND(F.lit(M62))) for k in range(EQUAL)]
        lanes = [let(hashed(k), packed) for k in range(SEEDS)]
        return F.concat(F.array(F.size(p).cast("long"), *wide), *lanes)

    return let(pieces(text), summed)


def text_form(v: Column) -> Column:
    """The fingerprint as hex numbers."""
    return F.array_join(F.transform(v, F.hex), ".")


def added(a: Column, b: Column) -> Column:
    """The fingerprint of both multisets together."""
    return F.transform(F.zip_with(a, b, lambda x, y: F.struct(x.alias("a"), y.alias("b"))), lambda z, i: _plus(z["a"], z["b"], i))


def removed(a: Column, b: Column) -> Column:
    """The fingerprint of a's multiset without b's."""
    return F.transform(F.zip_with(a, b, lambda x, y: F.struct(x.alias("a"), y.alias("b"))), lambda z, i: _minus(z["a"], z["b"], i))


def _lanes(x: Column) -> list[Column]:
    return [F.shiftright(x, 32 * j).bitwiseAND(F.lit(M32)) for j in range(2)]


def _joined(parts: list[Column]) -> Column:
    return sum((F.shiftleft(p.bitwiseAND(F.lit(M32)), 32 * j) for j, p in enumerate(parts)), F.lit(0).cast("long"))


def _plus(x: Column, y: Column, i: Column) -> Column:
    lanes = _joined([a + b for a, b in zip(_lanes(x), _lanes(y), strict=True)])
    return F.when(i <= EQUAL, (x + y).bitwiseAND(F.lit(M62))).otherwise(lanes)


def _minus(x: Column, y: Column, i: Column) -> Column:
    lanes = _joined([a - b for a, b in zip(_lanes(x), _lanes(y), strict=True)])
    return F.when(i <= EQUAL, (x - y).bitwiseAND(F.lit(M62))).otherwise(lanes)


def centred(v: Column) -> Column:
    """The bit lanes as counts of ones less zeros; right up to 2^32 pieces in a multiset."""
    n = F.get(v, F.lit(0))
    lanes = F.flatten(F.transform(F.slice(v, EQUAL + 2, 32 * SEEDS), lambda x: F.array(*_lanes(x))))
    return let(n, lambda m: F.transform(lanes, lambda c: (2 * c - m).cast("double")))


def likeness(a: Column, b: Column) -> Column:
    """Cosine of the centred lanes, from 0 to 1: near the share of common paragraphs; 1 for equal fingerprints."""

    def cosine(s: Column) -> Column:
        dot = F.aggregate(F.zip_with(s["a"], s["b"], lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
        norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda t, x: t + x * x))
        both = norm(s["a"]) * norm(s["b"])
        return F.when(both > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot / both))).otherwise(F.lit(0.0))

    return F.when(a == b, F.lit(1.0)).otherwise(let(F.struct(centred(a).alias("a"), centred(b).alias("b")), cosine))


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """df with the fingerprint vector of each text in `out` (replaced if df has it).

    A null text counts as empty; an empty text is one empty paragraph. Equal
    texts, and texts of the same paragraphs in another order, have equal
    fingerprints. Repeated rows are each hashed.
    """
    return df.select(*(df[c] for c in df.columns if c != out), vector(F.col(text)).alias(out))


# ------------------------------------------------------------ next documents

#: Ranges of the key that neighbours are looked up in, at most; each range's first key goes to the driver.
RANGES = 2048


def with_next(df: DataFrame, key: str, carry: list[str], out: str, tie: list[str] | None = None) -> DataFrame:
    """df with a struct `out` of the columns `carry` of the next row by key, ascending; after the last row, of the first.

    Rows are dealt to about RANGES ranges of the key, so that rows move once; the
    first row of each range also goes to the range before. Null keys come
    first; rows of one key follow each other by a hash of the columns `tie` (the
    carried ones), which also parts a key with more rows than a range holds. A
    number of equal rows among `tie` parts those too.
    """
    low = -(2**63)
    level = F.coalesce(F.col(key).cast("long"), F.lit(low))
    dealt = df.withColumn("__level", level).withColumn("__u", F.shiftrightunsigned(F.xxhash64(*(tie or carry)), 33))
    cuts = quantiles(df, key, RANGES)
    dealt = dealt.withColumn("__p", range_of(F.col("__level"), F.col("__u"), cuts))
    # level and u as one number, which needs no sort to take the least of
    both = F.col("__level").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("__u")
    firsts = {r["p"]: divmod(int(r["f"]), 1 << 31) for r in dealt.groupBy(F.col("__p").alias("p")).agg(F.min(both).alias("f")).collect()}
    order = sorted(firsts)
    if not order:
        return df.withColumn(out, F.struct(*carry))
    back = {p: order[i - 1] for i, p in enumerate(order)}
    ranges = range(order[-1] + 1)
    known = lambda of: F.get(_longs([of(p) if p in firsts else 0 for p in ranges]), F.col("__p"))
    before = known(lambda p: back[p]).cast("int")
    first = (F.col("__level") == known(lambda p: firsts[p][0])) & (F.col("__u") == known(lambda p: firsts[p][1]))
    own = F.struct(F.col("__p").alias("p"), F.lit(0).alias("late"))
    copies = F.when(first, F.array(own, F.struct(before.alias("p"), F.lit(1).alias("late")))).otherwise(F.array(own))
    w = Window.partitionBy("__at.p").orderBy("__at.late", "__level", "__u", *carry)
    spread = dealt.withColumn("__at", F.explode(copies))
    return spread.withColumn(out, F.lead(F.struct(*carry)).over(w)).where("__at.late = 0").drop("__at", "__p", "__level", "__u")


def quantiles(df: DataFrame, key: str, n: int) -> list[int]:
    """At most n - 1 cuts that part the keys about evenly, ascending; a key of many rows is several cuts; null keys count as -2^63."""
    at = ", ".join(str(i / n) for i in range(1, n))
    return sorted(df.agg(F.expr(f"percentile_approx(coalesce(cast(`{key}` as bigint), -9223372036854775808L), array({at}), 20000)").alias("q")).first()["q"] or []) if n > 1 else []


def _longs(values: list[int]) -> Column:
    """A constant array: one literal that the optimizer folds, not an expression for each entry."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def range_of(level: Column, u: Column, cuts: list[int], step: int = 45) -> Column:
    """The range of a row by its key (null as -2^63) and, where one key is several cuts, by u, a number below 2^31: in their order."""
    if not cuts:
        return F.lit(0)
    flat = sorted(set(cuts))
    times = [cuts.count(c) if len(flat) < len(cuts) else 1 for c in flat]
    first = [0]
    for t in times:
        first.append(first[-1] + t)
    # the number of cuts at or below the key, found in two steps
    near = F.size(F.filter(_longs(flat[::step]), lambda c: c <= level))
    place = F.when(near <= 0, F.lit(0)).otherwise(let(near, lambda m: (m - 1) * step + F.size(F.filter(F.slice(_longs(flat), (m - 1) * step + 1, F.lit(step)), lambda c: c <= level))))
    if len(flat) == len(cuts):
        return place.cast("int")

    def parted(i: Column) -> Column:
        n = F.get(_longs([1, *times]), i)
        inside = F.when(F.get(_longs([0, *flat]), i) == level, F.floor(u * n / F.lit(1 << 31))).otherwise(n - 1)
        return (F.get(_longs([0, *(f + 1 for f in first[:-1])]), i) + inside).cast("int")

    return let(place, parted)


def edited_with_next(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of a table (doc_id, text).

    Rows of one id follow each other by a hash of their text and, where a row has
    many copies, its number among them: the order of files doesn't matter, and
    equal rows are in as many ranges as their share of the table.
    """
    t = numbered(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    t = fingerprints(t)
    near = with_next(t, "doc_id", ["text", "fingerprint"], "next", tie=["text", "__copy"])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring(F.col("next.text"), F.lit(1), half))
    near = near.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.col("fingerprint").alias("own_fp"), F.col("next.fingerprint").alias("next_fp"), let(edited, lambda e: F.struct(F.sha2(e, 256).alias("sha"), vector(e).alias("fp"))).alias("edited"))
    return near.select(
        "doc_id",
        "n_chars",
        F.col("edited.sha").alias("edited_sha256"),
        text_form(F.col("own_fp")).alias("fingerprint"),
        text_form(F.col("edited.fp")).alias("edited_fingerprint"),
        likeness(F.col("own_fp"), F.col("edited.fp")).alias("near_edited"),
        likeness(F.col("own_fp"), F.col("next_fp")).alias("near_next"),
    )
