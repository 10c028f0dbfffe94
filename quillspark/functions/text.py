"""Column functions over code and names: sanitisers, callees, tokens, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sanitize(source: Column) -> Column:
    """Magic, shell and help lines emptied; line numbers hold."""
    out = F.regexp_replace(source, r"(?m)^[ \t]*[%!].*", "")
    return F.regexp_replace(out, r"(?m)^[ \t]*\?.*|.*\?[ \t]*$", "")


def strip_jupyter(source: Column) -> Column:
    """Lines that start with %, ! or '# In[' dropped."""
    return F.array_join(F.filter(F.split(source, "\n"), lambda x: ~F.ltrim(x).rlike(r"^(%|!|# In\[)")), "\n")


def comment_magics(source: Column) -> Column:
    """Magic and shell lines turned into comments."""
    return F.regexp_replace(source, r"(?m)^([ \t]*)([%!])", "$1# $2")


def callee(code: Column) -> Column:
    """The name before the first bracket: the last part between dots and square brackets that isn't blank."""
    head = F.substring_index(F.trim(F.coalesce(code, F.lit(""))), "(", 1)
    parts = F.filter(F.split(head, r"[.\[]"), lambda p: F.trim(p) != "")
    return F.when(F.size(parts) > 0, F.trim(F.element_at(parts, -1))).otherwise("")


def leaf_callee(code: Column) -> Column:
    """The last name before a bracket that opens outside all others, however deep they nest.

    A fold over the pieces between brackets keeps the depth and the name before
    the last bracket that opened at depth 0; a bracket that closes nothing is text.
    """
    text = F.coalesce(code, F.lit(""))
    pieces = F.regexp_extract_all(text, F.lit(r"[()]|[^()]+"), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("before"), F.lit("").alias("name"))

    def step(s: Column, p: Column) -> Column:
        named = F.regexp_extract(s["before"], r"(?s)([\p{L}\p{N}_]+)\s*$", 1)
        opens, closes = p == "(", p == ")"
        depth = F.when(opens, s["depth"] + 1).when(closes, F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"])
        before = F.when(opens | closes, F.lit("")).when(s["depth"] == 0, p).otherwise(s["before"])
        name = F.when(opens & (s["depth"] == 0) & (named != ""), named).otherwise(s["name"])
        return F.struct(depth.alias("depth"), before.alias("before"), name.alias("name"))

    return F.aggregate(pieces, start, step, lambda s: s["name"])


def tokens(name: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")


def has_token(name: Column, words: list[str]) -> Column:
    return F.arrays_overlap(tokens(name), F.array(*map(F.lit, words)))


def ends_with_any(name: Column, suffixes: list[str]) -> Column:
    return name.rlike("(" + "|".join(suffixes) + ")$")


def djb2(source: Column) -> Column:
    """djb2 over UTF-16 code units in 32 bits, signed, in base 36."""
    digits = F.hex(F.encode(F.coalesce(source, F.lit("")), "UTF-16BE"))
    n = F.length(digits) / 4
    units = F.when(n > 0, F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: F.conv(F.substring(digits, i * 4 + 1, F.lit(4)), 16, 10).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    value = F.aggregate(units, F.lit(5381).cast("long"), lambda a, x: (a * 33 + x).bitwiseAND(F.lit(0xFFFFFFFF)))
    signed = F.when(value >= 0x80000000, value - 0x100000000).otherwise(value)
    return F.when(signed < 0, F.concat(F.lit("-"), F.lower(F.conv((-signed).cast("string"), 10, 36)))).otherwise(F.lower(F.conv(signed.cast("string"), 10, 36)))


def md5_mod(text: Column, modulus: int = 10_000) -> Column:
    """md5 as one number, modulo; folded over four 32-bit parts."""
    h = F.md5(text)
    part = lambda i: F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long")
    step = (1 << 32) % modulus
    out = part(0) % modulus
    for i in (1, 2, 3):
        out = (out * step + part(i)) % modulus
    return out


def literal_tokens(text: Column) -> Column:
    """Words of an identifier, camel case taken apart, lower case."""
    apart = F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(apart), r"[^a-z0-9]+"), lambda t: t != "")
