"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a built-in expression over the document's own text, so a
document is judged in the task that scanned it: no shuffle, no user function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, let, total

#: Characters that count as symbols, and the words of the window.
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8

#: Function words of the corpus's languages.
STOP_WORDS = (
    "the of and to in a is that it for on as with was be by this are at or"
    " der die das und zu den von mit ein eine ist im auf des dem für"
    " le la les de des un une et que en du qui pour dans par sur au"
    " el los las del que y un una por con su es se lo al"
).split()

#: (measure, least, most): a document is kept when each measure lies in its range; None leaves a side open.
THRESHOLDS: list[tuple[str, float | None, float | None]] = [
    ("words", 20, None),
    ("repeat_word_ratio", None, 0.30),
    ("mean_word_length", 2.0, 14.0),
    ("symbol_word_ratio", None, 0.25),
    ("stop_words", 1, None),
    ("dup_line_ratio", None, 0.50),
    ("upper_ratio", None, 0.50),
    ("bang_word_ratio", None, 0.30),
    ("run_word_ratio", None, 0.50),
]


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of eight words found twice or more in the text.

    Windows are compared by a 64-bit hash of their words; two different windows
    of one text of a million words agree by chance once in 3e7 texts.
    """
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))

    def covered(sorted_: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(sorted_, i)["h"] == x["h"], F.lit(False))
        at = F.transform(F.filter(sorted_, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"])
        return let(F.sort_array(at), lambda p: total(F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))))

    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(pairs, covered))

    return F.when(F.size(words) > WINDOW, let(hashes, count)).otherwise(F.lit(0).cast("long"))


def _measured(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    stop = F.array(*map(F.lit, sorted(set(STOP_WORDS))))
    ws = F.filter(F.split(text, WHITE), lambda w: w != "")

    def with_words(w: Column) -> Column:
        return let(
            lines,
            lambda ln: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                (F.size(ln) - F.size(F.array_distinct(ln))).cast("long").alias("n_dup_lines"),
                repeated_words(w).alias("n_repeat_words"),
                F.size(ln).cast("long").alias("n_lines"),
                F.size(F.array_intersect(F.transform(w, F.lower), stop)).cast("long").alias("n_stop_words"),
                (F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}", ""))).cast("long").alias("n_upper"),
                F.size(F.filter(w, lambda x: x.endswith("!!"))).cast("long").alias("n_bang_words"),
                F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1))).cast("long").alias("n_run_words"),
            ),
        )

    return let(ws, with_words)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


MEASURES = {
    "words": lambda m: m["n_words"],
    "repeat_word_ratio": lambda m: _ratio(m["n_repeat_words"], m["n_words"]),
    "mean_word_length": lambda m: _ratio(m["word_chars"], m["n_words"]),
    "symbol_word_ratio": lambda m: _ratio(m["n_symbols"], m["n_words"]),
    "stop_words": lambda m: m["n_stop_words"],
    "dup_line_ratio": lambda m: _ratio(m["n_dup_lines"], m["n_lines"]),
    "upper_ratio": lambda m: _ratio(m["n_upper"], m["word_chars"]),
    "bang_word_ratio": lambda m: _ratio(m["n_bang_words"], m["n_words"]),
    "run_word_ratio": lambda m: _ratio(m["n_run_words"], m["n_words"]),
}


def compile_rules(measured: Column, table=None) -> Column:
    """One boolean expression for the whole table."""
    verdict = F.lit(True)
    for name, least, most in table or THRESHOLDS:
        value = MEASURES[name](measured)
        if least is not None:
            verdict = verdict & (value >= least)
        if most is not None:
            verdict = verdict & (value <= most)
    return verdict


def score(df: DataFrame, text: str = "text", table=None, prefix: str = "") -> DataFrame:
    """df's columns, then n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    Null and empty texts count as no words and fail. Input columns with those
    names are replaced. Repeated rows are each judged; an empty table gives none.
    """
    out = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    keep = [c for c in df.columns if c not in {*(prefix + o for o in out), prefix + "base_failed", prefix + "kept"}]
    base = lambda m: (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
    judged = let(
        _measured(F.coalesce(F.col(text), F.lit(""))),
        lambda m: F.struct(*(m[o].alias(o) for o in out), base(m).alias("base_failed"), (~base(m) & compile_rules(m, table)).alias("kept")),
    )
    got = df.select(*(df[c] for c in keep), judged.alias("__quality"))
    return got.select(*keep, *(F.col(f"__quality.{o}").alias(prefix + o) for o in [*out, "base_failed", "kept"]))


def keep_good(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of df that pass, with df's own columns."""
    return score(df, text, prefix="__q_").where("__q_kept").select(*df.columns)
