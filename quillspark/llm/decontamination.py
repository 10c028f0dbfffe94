"""Benchmark decontamination by winnowing.

Of every span of n words that a document and an item may share, both keep the
least hash of its k-word grams: two spans of equal words keep equal hashes, so
a join of the kept ones finds every shared span. A document's neighbouring
spans keep one gram for a run of them, so about 2 rows for n - k + 2 words go
into that join. Runs that meet an item's hash are extended: each of their spans
is compared, by a hash of all its words, with the spans that items have.

Items of fewer than n words are spans of their own length, winnowed alike.
Everything is built-in functions; texts stay in the scan, hashes move.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, shared_dir

#: Words to a span.
SPAN = 10
#: Spans of all items up to which they are sent to every executor (some 50 bytes each); more are joined by a shuffle.
BROADCAST_SPANS = 1 << 19
#: Fixed value: what stands between words.
BETWEEN = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text as they stand; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def hashed(text: Column) -> Column:
    """The hashes of a text's words, A-Z lowered; in a word of ASCII alone that is what lower() does, at a tenth of the time."""
    low = lambda w: F.when(F.octet_length(w) == F.char_length(w), F.lower(w)).otherwise(F.translate(w, _UPPER, _LOWER))
    return F.transform(words(text), lambda w: F.xxhash64(low(w)))


def _gram(word: Callable[[int], Column], k: int) -> Column:
    """The hash of k words in a row: their own hashes, each turned by its place."""
    turned = lambda x, j: F.shiftleft(x, j).bitwiseOR(F.shiftrightunsigned(x, 64 - j)) if j else x
    return reduce(lambda a, x: a.bitwiseXOR(x), (turned(word(j), 7 * j) for j in range(k)))


def _grams(hashes: Column, k: int) -> Column:
    """The hash of every k words in a row."""
    if k == 1:
        return hashes
    at = F.when(F.size(hashes) >= k, F.sequence(F.lit(0), F.size(hashes) - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: _gram(lambda j: F.get(hashes, i + j), k))


def spans(hashes: Column, n: int) -> Column:
    """(kept, whole) of every n words in a row of a text's word hashes: the least hash of its k-word grams, and a hash of all its words."""
    k = (n + 1) // 2

    def both(g: Column) -> Column:
        at = F.when(F.size(g) > n - k, F.sequence(F.lit(0), F.size(g) - (n - k) - 1)).otherwise(F.array().cast("array<int>"))
        least = lambda i: F.least(*(F.get(g, i + j) for j in range(n - k + 1))) if n > k else F.get(g, i)
        # the first and the last gram hold every word
        return F.transform(at, lambda i: F.struct(least(i).alias("kept"), F.xxhash64(F.get(g, i), F.get(g, i + (n - k)), F.lit(n)).alias("whole")))

    return let(_grams(hashes, k), both)


def runs(hashes: Column, n: int) -> Column:
    """(kept, at, wholes): the spans of a text, those in a row that keep one gram's hash together."""

    def parted(s: Column) -> Column:
        where = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(F.array().cast("array<int>"))
        first = F.filter(where, lambda i: (i == 0) | (F.get(s, i)["kept"] != F.get(s, F.greatest(i - 1, F.lit(0)))["kept"]))
        whole = lambda i, to: F.transform(F.slice(s, i + 1, to - i), lambda x: x["whole"])
        return let(first, lambda f: F.transform(f, lambda i, j: F.struct(F.get(s, i)["kept"].alias("kept"), i.alias("at"), whole(i, F.coalesce(F.get(f, j + 1), F.size(s))).alias("wholes"))))

    return let(spans(hashes, n), parted)


def _spread(docs: DataFrame, key: str, text: str, lengths: list[int]) -> DataFrame:
    """(key, t, at, n, kept, whole): a row for each span of each text, and one of n = 0 behind its last word.

    A row has the word's hash and those behind it; it, and all that follows,
    joins with broadcast tables included, is compiled code.
    """
    longest = lengths[-1]
    own = docs.select(F.col(key).alias("key"), _name(text).alias("t"), F.concat(hashed(F.col(text)), F.array(F.lit(None).cast("long"))).alias("h"))
    # outer: else the optimizer asks for its size first, and makes the array once more for that
    at = own.select("key", "t", "h", F.posexplode_outer("h").alias("at", "h0"))
    rows = at.select("key", "t", "at", "h0", *(F.get("h", F.col("at") + j).alias(f"h{j}") for j in range(1, longest)))

    def span(n: int) -> list[Column]:
        k = (n + 1) // 2
        gram = [_gram(lambda j, i=i: F.col(f"h{i + j}"), k) for i in range(n - k + 1)]
        return [(F.least(*gram) if len(gram) > 1 else gram[0]).alias("kept"), F.xxhash64(gram[0], gram[-1], F.lit(n)).alias("whole")]

    end = F.col("h0").isNull()
    if len(lengths) == 1:
        return rows.where(end | F.col(f"h{longest - 1}").isNotNull()).select("key", "t", "at", F.when(end, 0).otherwise(longest).alias("n"), *span(longest))
    behind = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("kept"), F.lit(0).cast("long").alias("whole"))
    every = F.array(F.when(end, behind), *(F.when(F.col(f"h{n - 1}").isNotNull(), F.struct(F.lit(n).alias("n"), *span(n))) for n in lengths))
    return rows.select("key", "t", "at", F.explode(every).alias("s")).where("s is not null").select("key", "t", "at", "s.*")


def _name(text: str) -> Column:
    whole = F.coalesce(text, F.lit(""))
    return F.struct(F.xxhash64(whole).alias("a"), F.xxhash64(F.lit(7), whole).alias("b"))


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text", span: int = SPAN, most: int = BROADCAST_SPANS) -> DataFrame:
    """(key, n_words, n_hit, n_items, items_sha256, contaminated) of every row of docs.

    A span of an item is `span` words in a row, or the whole of a shorter item;
    a document's word is hit if it stands in a span that an item has. n_items
    counts the items with such spans, and the hash is of their ids as strings,
    sorted and joined by commas. Null and empty texts have no words, are hit by
    nothing and hit nothing; items without words likewise. Equal texts share
    their hits, whatever their ids, and repeated rows are each returned. Rows of
    one item id are one item; a null id is written as an empty string. Empty
    tables on either side leave every document clean. Other columns are not
    looked at.

    Texts are told apart by 128 bits, spans by the two hashes of 64 bits that
    must agree.
    """
    shared_dir(docs.sparkSession)
    id_text = F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item")
    # items of equal words are one class, found together and listed together
    told = items.select(id_text, hashed(F.col(text)).alias("h")).where("size(h) > 0")
    told = told.select("item", "h", F.xxhash64("h").alias("class"), F.least(F.size("h"), F.lit(span)).alias("n"))
    lists = told.groupBy("class").agg(F.sort_array(F.collect_set("item")).alias("ids"))
    forms = told.groupBy("class", "n").agg(F.first("h").alias("h"))
    lengths = sorted(r["n"] for r in forms.select("n").distinct().collect())
    if not lengths:
        return docs.select(key, F.size(words(F.col(text))).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.sha2(F.lit(""), 256).alias("items_sha256"), F.lit(False).alias("contaminated"))
    own = None  # at most `span` lengths
    for n in lengths:
        part = forms.where(F.col("n") == n).select("class", F.lit(n).alias("n"), F.explode(spans(F.col("h"), n)).alias("s")).select("class", "n", "s.*").distinct()
        own = part if own is None else own.unionByName(part)
    own = own.checkpoint()
    known = own.select("n", "kept", "whole").distinct()
    prints = own.select("n", "kept").distinct()
    if known.count() <= most:
        end = F.col("n") == 0
        met = _spread(docs, key, text, lengths).join(F.broadcast(prints.withColumn("__p", F.lit(True))), ["n", "kept"], "left").where(end | F.col("__p"))
        met = met.join(F.broadcast(known.withColumn("__k", F.lit(True))), ["n", "kept", "whole"], "left").where(end | F.col("__k")).select("key", "t", "at", "n", "kept", "whole").checkpoint()
        rows, met = met.where("n = 0").select(F.col("key").alias(key), "t", F.col("at").cast("long").alias("n_words")), met.where("n > 0").drop("key")
    else:
        of = lambda n: F.transform(runs(F.col("h"), n), lambda r: F.struct(F.lit(n).alias("n"), r["kept"].alias("kept"), r["at"].alias("at"), r["wholes"].alias("wholes")))
        met = docs.select(_name(text).alias("t"), hashed(F.col(text)).alias("h")).select("t", F.explode(F.flatten(F.array(*(of(n) for n in lengths)))).alias("r")).select("t", "r.*")
        met = met.join(prints, ["n", "kept"], "left_semi").select("t", "n", "kept", "at", F.posexplode("wholes").alias("i", "whole"))
        met = met.select("t", "n", "kept", "whole", (F.col("at") + F.col("i")).alias("at")).join(known, ["n", "kept", "whole"])
        rows = docs.select(F.col(key), _name(text).alias("t"), F.size(words(F.col(text))).cast("long").alias("n_words"))
    # a text's copies give its hits again
    hits = met.select("t", "at", "n", "kept", "whole").distinct().checkpoint()

    place = F.struct(F.col("at").alias("at"), (F.col("at") + F.col("n")).alias("to"))
    covered = F.aggregate(
        F.sort_array("places"),
        F.struct(F.lit(0).alias("to"), F.lit(0).alias("n")),
        lambda a, x: F.struct(F.greatest(a["to"], x["to"]).alias("to"), (a["n"] + F.greatest(F.lit(0), x["to"] - F.greatest(a["to"], x["at"]))).alias("n")),
        lambda a: a["n"].cast("long"),
    )
    # texts with the same set of spans hold the same items: the list is made once for each set
    name = F.xxhash64("n", "kept", "whole")
    per_text = hits.groupBy("t").agg(F.collect_set(place).alias("places"), F.sort_array(F.collect_set(name)).alias("names"))
    per_text = per_text.select("t", covered.alias("n_hit"), F.struct(F.xxhash64("names").alias("a"), F.xxhash64(F.lit(7), "names").alias("b")).alias("set"), "names").checkpoint()
    sets = per_text.groupBy("set").agg(F.first("names").alias("names")).select("set", F.explode("names").alias("name"))
    classes = sets.join(own.select(name.alias("name"), "class"), "name").select("set", "class").distinct()
    listed = classes.join(lists, "class").groupBy("set").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))
    listed = listed.select("set", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"))
    found = per_text.select("t", "n_hit", "set").join(listed, "set").drop("set")
    return rows.join(found, "t", "left").select(
        key,
        "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )
