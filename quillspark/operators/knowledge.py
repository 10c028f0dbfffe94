"""Knowledge bases of APIs: loading, lookup, labels, matching by spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import leaf_callee, tokens

_KB = "library string, module string, caller string, api string, inputs array<string>, outputs array<string>, ord long"


def literal_list(text: Column) -> Column:
    """The strings of a list literal; null and other text give an empty array."""
    return F.coalesce(F.transform(F.regexp_extract_all(text, F.lit(r"""'([^']*)'|"([^"]*)\""""), F.lit(0)), lambda x: F.substring(x, F.lit(2), F.length(x) - 2)), F.array().cast("array<string>"))


def load(spark: SparkSession, path: str) -> DataFrame:
    """A knowledge base of CSV files(Library, Module, Caller, API Name, Inputs, Outputs), in file order."""
    raw = spark.read.csv(path, header=True, schema="library string, module string, caller string, api string, inputs string, outputs string", quote='"', escape='"')
    return raw.withColumn("inputs", literal_list(F.col("inputs"))).withColumn("outputs", literal_list(F.col("outputs"))).withColumn("ord", F.monotonically_increasing_id())


def with_fallbacks(kb: DataFrame, rows: list[tuple]) -> DataFrame:
    """kb with rows that always stand at its end."""
    return kb.unionByName(kb.sparkSession.createDataFrame(rows, _KB))


def signature_label(inputs: Column, outputs: Column, caller: Column) -> Column:
    """The class of an API by what it takes and gives."""
    has = lambda a, *w: F.arrays_overlap(a, F.array(*map(F.lit, w)))
    path = has(inputs, "file_path", "file_paths")
    taken = F.array_compact(F.array_append(inputs, F.nullif(caller, F.lit(""))))
    return (
        F.when(has(outputs, "model artifact", "data_artifact") | (path & (F.size(outputs) == 0)), 4)
        .when(path | ((F.size(taken) == 0) & has(outputs, "data", "features", "labels", "target")), 1)
        .when(has(outputs, "predictions", "model", "trained_model"), 0)
        .when(has(outputs, "metric", "metric results", "multi_confusion_matrix"), F.when(has(taken, "predictions", "labels", "model", "trained_model"), 0).otherwise(3))
        .when(has(outputs, "display_object"), 3)
        .when(has(outputs, "data", "features", "data transformer", "data splitter", "tokenized data", "shuffled arrays", "document-term matrix") & has(taken, "features", "data", "labels", "raw text documents", "transformer definitions", "hyperparameter", "arrays", "data transformer"), 2)
        .otherwise(5)
    )


def index(kb: DataFrame, fallback: bool = True) -> DataFrame:
    """(api, library, label): per (api, library) where all rows agree, and library '*' where all rows of the api do. kb has api, library, label."""
    rows = kb.where("coalesce(api, '') <> ''").select(F.element_at(F.split("api", r"\."), -1).alias("api"), "library", "label")
    one = F.countDistinct("label") == 1
    lib = rows.where("coalesce(library, '') <> ''").groupBy("api", "library").agg(one.alias("__one"), F.min("label").alias("label")).where("__one").drop("__one")
    if not fallback:
        return lib
    return lib.unionByName(rows.groupBy("api").agg(one.alias("__one"), F.min("label").alias("label")).where("__one").select("api", F.lit("*").alias("library"), "label"))


#: The index is as long as the APIs that libraries have; up to so many rows (some MB) it is broadcast.
FEW = 200_000


def label(nodes: DataFrame, kb_index: DataFrame) -> DataFrame:
    """nodes(nb_id, node_id, code, base_inputs) with kb_label: that of the outermost call's API in a library of its provenance, else of the API alone."""
    idx = F.broadcast(kb_index) if kb_index.limit(FEW + 1).count() <= FEW else kb_index
    n = nodes.withColumn("__api", leaf_callee(F.col("code")))
    libs = n.select("nb_id", "node_id", "__api", F.explode(tokens(F.concat_ws(" ", "base_inputs", "code"))).alias("library"))
    exact = libs.join(idx.withColumnRenamed("api", "__api"), ["__api", "library"]).groupBy("nb_id", "node_id").agg(F.min("label").alias("__l"))
    any_ = idx.where("library = '*'").select(F.col("api").alias("__api"), F.col("label").alias("__a"))
    return n.join(exact, ["nb_id", "node_id"], "left").join(any_, "__api", "left").withColumn("kb_label", F.coalesce("__l", "__a")).drop("__api", "__l", "__a")


def kb_first(nodes: DataFrame, kb_index: DataFrame, client) -> DataFrame:
    """Labels by the knowledge base, and by client(DataFrame of the rest) -> (nb_id, node_id, label) for what it lacks."""
    known = label(nodes, kb_index)
    rest = client(known.where("kb_label is null").drop("kb_label")).select("nb_id", "node_id", F.col("label").alias("__c"))
    return known.join(rest, ["nb_id", "node_id"], "left").withColumn("predicted_label", F.coalesce("kb_label", "__c")).drop("__c")


def look_up(asked: DataFrame, kb: DataFrame) -> DataFrame:
    """asked(ask_id, library, module, caller, api; null: any, but a null caller or api asks for rows without) with the first row's inputs and outputs.

    The caller is matched strictly where some row of the library and module has it, else rows without caller stand.
    """
    none = lambda c: F.coalesce(F.col(c), F.lit(""))
    # a row answers under its library or any, its module or any; without an api it answers the null api, too
    either = lambda c: F.explode(F.array(none(c), F.lit(None).cast("string")))
    api = F.explode(F.array_distinct(F.array(none("api"), F.col("api"))))
    first = F.min(F.struct("ord", "inputs", "outputs"))
    # one row of a key before it is copied
    k = kb.groupBy("library", "module", "caller", "api").agg(first.alias("__f"))
    k = k.select(either("library").alias("library"), "module", "caller", "api", "__f").select("library", either("module").alias("module"), "caller", "api", "__f")
    k = k.select("library", "module", "caller", api.alias("api"), "__f").groupBy("library", "module", "caller", "api").agg(F.min("__f").alias("__f"))
    # nulls are values of the key
    key = lambda *cols: F.to_json(F.array(*cols))
    callers = kb.where("caller is not null").select("library", "module", "caller").distinct()
    callers = callers.select(either("library").alias("library"), "module", "caller").select("library", either("module").alias("module"), "caller")
    callers = callers.select(key("library", "module", "caller").alias("__k")).distinct().withColumn("__s", F.lit(True))
    a = asked.withColumn("__k", key("library", "module", "caller")).join(callers, "__k", "left").withColumn("__caller", F.when(F.col("__s"), F.col("caller"))).drop("__k", "__s")
    a = a.withColumn("__k", key("library", "module", "__caller", "api")).drop("__caller").join(k.select(key("library", "module", "caller", "api").alias("__k"), "__f"), "__k", "left")
    empty = F.array().cast("array<string>")
    return a.withColumn("inputs", F.coalesce("__f.inputs", empty)).withColumn("outputs", F.coalesce("__f.outputs", empty)).drop("__k", "__f")


def back_query(asked: DataFrame, kb: DataFrame) -> DataFrame:
    """asked(ask_id, api, outputs) with the inputs of the first row of the api whose outputs agree as far as both go; a null output agrees with all."""
    k = kb.select(F.col("api").alias("k_api"), F.col("inputs").alias("k_inputs"), F.col("outputs").alias("k_outputs"), "ord")
    fits = F.forall(F.zip_with("outputs", "k_outputs", lambda a, b: a.isNull() | b.isNull() | (a == b)), lambda x: x)
    both = asked.join(k, F.col("api").isNull() | (F.col("api") == F.coalesce("k_api", F.lit("")))).where(F.col("outputs").isNull() | fits)
    first = both.withColumn("__r", F.row_number().over(Window.partitionBy("ask_id").orderBy("ord"))).where("__r = 1").select("ask_id", "k_inputs")
    return asked.join(first, "ask_id", "left").withColumn("inputs", F.coalesce("k_inputs", F.array().cast("array<string>"))).drop("k_inputs")


def learned(labels: DataFrame) -> DataFrame:
    """(library, api, label): the most frequent label of each; of equals the first seen (ord)."""
    c = labels.groupBy("library", "api", "label").agg(F.count("*").alias("n"), F.min("ord").alias("o"))
    w = Window.partitionBy("library", "api").orderBy(F.col("n").desc(), "o")
    return c.withColumn("__r", F.row_number().over(w)).where("__r = 1").select("library", "api", "label")


def span(line: Column, column: Column) -> Column:
    """A place in text as one number."""
    return line * 2000 + column


def _overlaps(asked: DataFrame, gold: DataFrame, least: float, cell: float) -> DataFrame:
    """(ask_id, gold_id, ord, overlap) of spans that overlap by `least`, once for each cell of the line that both lie on."""
    cells = lambda df, s, e: df.withColumn("__c", F.explode(F.sequence(F.floor(F.col(s) / cell), F.floor(F.col(e) / cell))))
    a = cells(asked.select("ask_id", "nb_id", "s", "e"), "s", "e")
    g = cells(gold.select("nb_id", "gold_id", F.col("s").alias("gs"), F.col("e").alias("ge"), "ord"), "gs", "ge")
    share = (F.least("e", "ge") - F.greatest("s", "gs")) / F.least(F.col("e") - F.col("s"), F.col("ge") - F.col("gs"))
    return a.join(g, ["nb_id", "__c"]).where("gs < e and s < ge").select("ask_id", "gold_id", "ord", share.alias("overlap")).where(F.col("overlap") >= least)


def match_spans(asked: DataFrame, gold: DataFrame, least: float = 0.5, cell: float = 2000.0) -> DataFrame:
    """(ask_id, gold_id, overlap): the gold span that overlaps most, in shares of the shorter, if by `least`; of equals the first (ord).

    asked(ask_id, nb_id, s, e) and gold(gold_id, nb_id, s, e, ord): a range
    join within a notebook on cells of the line. The best of a span is a least
    value, so that only one row for each and task moves after the join.
    """
    best = F.min(F.struct((-F.col("overlap")).alias("o"), "ord", "gold_id", "overlap"))
    return _overlaps(asked, gold, least, cell).groupBy("ask_id").agg(best.alias("x")).select("ask_id", "x.gold_id", "x.overlap")


def match_nodes(asked: DataFrame, gold: DataFrame, least: float = 0.5, cell: float = 2000.0) -> DataFrame:
    """(ask_id, gold_id): the gold node whose span overlaps most, else the first whose code is the asked id's name.

    asked(ask_id, nb_id, s, e) may have null spans; gold also has `code`. Both
    ways give candidates, of which each asked id takes the least.
    """
    spans = _overlaps(asked.where("s is not null and e > s"), gold.where("s is not null and e > s"), least, cell)
    # the first of a name before it is joined
    first = gold.where("code <> ''").groupBy("nb_id", F.trim("code").alias("code")).agg(F.min_by(F.struct("gold_id", "ord"), "ord").alias("x"))
    named = asked.select("ask_id", "nb_id", F.substring_index("ask_id", ":", 1).alias("code")).join(first, ["nb_id", "code"])
    found = spans.select("ask_id", F.lit(1).alias("way"), (-F.col("overlap")).alias("o"), "ord", "gold_id").unionByName(named.select("ask_id", F.lit(2).alias("way"), F.lit(None).alias("o"), "x.ord", "x.gold_id"))
    return found.groupBy("ask_id").agg(F.min(F.struct("way", "o", "ord", "gold_id")).alias("x")).select("ask_id", "x.gold_id")


def project_edges(edges: DataFrame, matches: DataFrame) -> DataFrame:
    """Edges among asked ids as distinct edges among their gold ids."""
    m = matches.select(F.col("ask_id"), F.col("gold_id"))
    s = edges.join(m.withColumnsRenamed({"ask_id": "src", "gold_id": "gold_src"}), "src").join(m.withColumnsRenamed({"ask_id": "dst", "gold_id": "gold_dst"}), "dst")
    return s.where("gold_src <> gold_dst").select("nb_id", "gold_src", "gold_dst").distinct()
