"""Secret scan: pattern spans, and spans of tokens that pass a battery of randomness tests.

One projection per document, built-in functions only.  A pattern's spans come
from its matches and the gaps between them, so positions need no user code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, prefix_most, prefix_sums

#: The base patterns, in the order of their kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # the whole run, as a shorter run holds no longer match
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")

#: Runs of key characters long enough to test, with a digit and a letter.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
#: Share of random tokens that the battery may turn away; expected symbols to a bin of the alphabet.
ALPHA, PER_BIN = 1e-3, 5
#: False-discovery rate per document. Under the null, names and paths, the battery's statistic has this mean and deviation
#: for each character: the least that hold for 20,000 identifiers and paths of Python's library at all lengths, with room for others.
FDR, NAMED_MEAN, NAMED_DEVIATION = 0.01, 1.3, 0.36

_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encodings by pattern, narrowest first, and their alphabets.
ENCODINGS = [
    (r"^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    (r"^[0-9a-f]+$", _DIGITS + "abcdef"),
    (r"^[A-Z2-7]+$", _UPPER + "234567"),
    (r"^[A-Z0-9]+$", _DIGITS + _UPPER),
    (r"^[a-z0-9]+$", _DIGITS + _LOWER),
    (r"^[A-Za-z0-9]+$", _UPPER + _LOWER + _DIGITS),
    (r"", _UPPER + _LOWER + _DIGITS + "+/"),
]


def _shares(alphabet: str) -> list[float]:
    """Shares of upper case, lower case, digits and others in an alphabet."""
    return [sum(c in group for c in alphabet) / len(alphabet) for group in (_UPPER, _LOWER, _DIGITS, "+/")]


def _spans(text: Column, pattern: str, kind: int, long_enough: Column | None = None) -> Column:
    """Array of (start, kind, end) of the leftmost non-overlapping matches."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(h: Column) -> Column:
        lens = F.zip_with(F.transform(gaps, F.length), F.transform(h, F.length), lambda g, n: F.struct(g.alias("g"), F.coalesce(n, F.lit(0)).alias("n")))

        def at(v: Column) -> Column:
            before = prefix_sums(F.transform(v, lambda x: x["g"] + x["n"]))
            ends = F.transform(h, lambda x, i: F.struct(F.get(v, i)["g"].alias("g"), F.get(v, i)["n"].alias("n")))
            return F.zip_with(before, ends, lambda b, x: F.when(x.isNotNull(), F.struct((b + x["g"]).cast("long").alias("start"), F.lit(kind).alias("kind"), (b + x["g"] + x["n"]).cast("long").alias("end"))))

        return F.filter(let(lens, at), lambda x: x.isNotNull())

    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    found = let(hits, placed)
    if long_enough is not None:
        found = F.filter(F.zip_with(found, long_enough, lambda s, ok: F.when(ok, s)), lambda x: x.isNotNull())
    return found, none


def _upper_tail(z: Column) -> Column:
    """1 - the normal distribution at z, by a logistic of a cubic."""
    return 1 / (1 + F.exp(F.least(F.lit(700.0), 1.5976 * z + 0.07056 * z * z * z)))


def _two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * _upper_tail(F.abs(z)))


def _randomness(token: Column) -> Column:
    """(p_random, p_named): how likely a random token has a battery's statistic as large, and a name one as small.

    The token's encoding is the narrowest that holds it, padding apart. Its
    symbols are tested for uniformity by chi-squared, over bins of the alphabet
    that expect PER_BIN symbols or more; its changes of class (runs) and its
    serial correlation are tested two-sided. Fisher's sum of the three is the statistic.
    """
    bare = F.rtrim(token, F.lit("="))
    shape = lambda t: F.coalesce(*(F.when(t.rlike(p) if p else F.lit(True), F.struct(F.lit(a).alias("a"), F.array(*map(F.lit, _shares(a))).alias("p"))) for p, a in ENCODINGS))

    def indexed(x: Column) -> Column:
        n, size = F.length(x["t"]), F.length(x["s"]["a"])
        plain = F.when(size == 64, F.translate(x["t"], "-_=", "+//")).otherwise(x["t"])
        at = F.transform(F.sequence(F.lit(1), n), lambda i: F.call_function("instr", x["s"]["a"], F.substring(plain, i, F.lit(1))) - 1)
        return F.struct(at.alias("c"), n.alias("n"), size.alias("size"), x["s"]["a"].alias("a"), x["s"]["p"].alias("p"))

    def battery(x: Column) -> Column:
        c, n, size, p = x["c"], x["n"], x["size"], x["p"]
        bins = F.greatest(F.lit(2), F.least(size, F.floor(n / PER_BIN).cast("int")))
        first = lambda b: F.ceil(b * size / bins)

        def part(b: Column) -> Column:
            expected = n * (first(b + 1) - first(b)) / size
            seen = F.size(F.filter(c, lambda s: F.floor(s * bins / size) == b))
            return (seen - expected) * (seen - expected) / expected

        chi = F.aggregate(F.transform(F.sequence(F.lit(0), bins - 1), part), F.lit(0.0), lambda t, y: t + y)
        free = (bins - 1).cast("double")
        z_chi = (F.pow(chi / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
        kinds = F.transform(c, lambda s: F.ascii(F.substring(x["a"], s + 1, F.lit(1))))
        kinds = F.transform(kinds, lambda k: F.when(k.between(65, 90), 0).when(k.between(97, 122), 1).when(k.between(48, 57), 2).otherwise(3))
        same = F.aggregate(p, F.lit(0.0), lambda t, y: t + y * y)
        changes = let(kinds, lambda k: F.size(F.filter(F.zip_with(F.slice(k, F.lit(1), n - 1), F.slice(k, F.lit(2), n - 1), lambda u, v: u != v), lambda y: y)))
        z_runs = (changes - (n - 1) * (1 - same)) / F.sqrt((n - 1) * same * (1 - same))
        mean = F.aggregate(c, F.lit(0.0), lambda t, y: t + y) / n

        def serial(d: Column) -> Column:
            var = F.aggregate(d, F.lit(0.0), lambda t, y: t + y * y)
            lag = F.aggregate(F.zip_with(F.slice(d, F.lit(1), n - 1), F.slice(d, F.lit(2), n - 1), lambda u, v: u * v), F.lit(0.0), lambda t, y: t + y)
            return F.when(var > 0, (lag / var + 1.0 / n) * F.sqrt(n.cast("double"))).otherwise(F.lit(99.0))

        z_serial = let(let(mean, lambda m: F.transform(c, lambda y: y - m)), serial)
        ln = lambda q: F.log(F.greatest(q, F.lit(1e-12)))
        joint = -2 * (ln(_upper_tail(z_chi)) + ln(_two_sided(z_runs)) + ln(_two_sided(z_serial)))
        p_random = lambda y: F.exp(-y / 2) * (1 + y / 2 + y * y / 8)
        return let(joint, lambda y: F.struct(p_random(y).alias("p_random"), _upper_tail((NAMED_MEAN * n - y) / (NAMED_DEVIATION * n)).alias("p_named")))

    return let(let(let(bare, lambda t: F.struct(t.alias("t"), shape(t).alias("s"))), indexed), battery)


def _random_spans(text: Column, base: Column) -> Column:
    """Spans of tokens that the battery finds random, under Benjamini-Hochberg over the text's tokens.

    The null of the discovery step is a name or path, under which the battery's
    statistic grows with the token's length: a longer token may depart
    further from the alphabet and still be found, a short one has to fit well.
    """
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    places, none = _spans(text, TOKEN, KINDS.index("random"))
    mixed = lambda t: t.rlike("[0-9]") & t.rlike("[A-Za-z]")
    tried = F.filter(F.zip_with(places, tokens, lambda s, t: F.struct(s.alias("s"), t.alias("t"))), lambda x: mixed(x["t"]) & ~F.exists(base, lambda b: (b["start"] < x["s"]["end"]) & (x["s"]["start"] < b["end"])))

    def discovered(scored: Column) -> Column:
        ps = F.sort_array(F.transform(scored, lambda x: x["r"]["p_named"]))
        bar = F.array_max(F.transform(ps, lambda p, i: F.when(p <= FDR * (i + 1) / F.size(scored), p)))
        return let(F.coalesce(bar, F.lit(-1.0)), lambda b: F.transform(F.filter(scored, lambda x: (x["r"]["p_named"] <= b) & (x["r"]["p_random"] >= ALPHA)), lambda x: x["s"]))

    scored = F.transform(tried, lambda x: F.struct(x["s"].alias("s"), _randomness(x["t"]).alias("r")))
    return F.when(text.rlike(TOKEN), let(scored, discovered)).otherwise(none)


def _base_spans(text: Column) -> Column:
    """The base spans by start, then kind."""
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    assign, none = _spans(text, ASSIGN, 0, F.transform(values, lambda v: F.length(v) >= 12))
    parts = [F.when(text.rlike(ASSIGN), assign).otherwise(none)]
    for kind, pattern in ((1, ACCESS), (2, HEX)):
        parts.append(F.when(text.rlike(pattern), _spans(text, pattern, kind)[0]).otherwise(none))
    return F.sort_array(F.concat(*parts))


def scan(df: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """df with a column `out`: all spans, array of (start, kind, end), by start, then kind's place in KINDS.

    Null and empty texts have none; repeated rows are each scanned; a column
    of df with that name is replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    found = let(_base_spans(t), lambda b: F.struct(b.alias("base"), F.sort_array(F.concat(b, _random_spans(t, b))).alias("spans")))
    return df.select(*(df[c] for c in df.columns if c != out), found["spans"].alias(out))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask(df: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """df with each secret in the text replaced by a mark; overlapping spans become one mark, and n_chars follows."""
    found = scan(df.withColumn("__text", F.coalesce(F.col(text), F.lit(""))), "__text", "__spans")

    def cut(s: Column) -> Column:
        reach = prefix_most(F.transform(s, lambda x: x["end"]))
        between = lambda a, b: F.substring(F.col("__text"), (a + 1).cast("int"), (b - a).cast("int"))
        pieces = F.zip_with(s, reach, lambda x, r: F.when(x["start"] >= r, F.concat(between(r, x["start"]), F.lit(mark))).otherwise(F.lit("")))
        last = F.array_max(F.transform(s, lambda x: x["end"]))
        return F.concat(F.array_join(pieces, ""), between(last, F.length("__text")))

    new = F.when(F.size("__spans") > 0, let(F.col("__spans"), cut)).otherwise(F.col(text))
    got = found.withColumn("__new", new)
    return got.select(*(F.col("__new").alias(c) if c == text else F.when(F.size("__spans") > 0, F.length("__new").cast("long")).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in df.columns))
