"""Corpus mining: sampling, pairs, balance, folds, counts."""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import checkpoints, hash_ranked

from ..functions.text import md5_mod

KINDS = ["DATA", "IMPORT", "FUNCTION_DEF", "CLASS_DEF", "FILE_ARTIFACT", "OPAQUE"]


def sample(df: DataFrame, name: str, require_libraries: bool = False) -> DataFrame:
    """df(success, error_type, edge_count, loc, ml_semantics, matched_libraries, <name>) with kept and reason, by fixed rules and an md5 draw."""
    density = F.col("edge_count") / F.greatest("loc", F.lit(1))
    p = md5_mod(F.col(name)) / 10000.0
    said = F.format_string("%.3f", density)
    few, has_libs = F.col("edge_count") < 5, F.size(F.coalesce("matched_libraries", F.array().cast("array<string>"))) > 0
    small, mid = F.col("edge_count") < 50, F.col("edge_count") <= 250
    out = F.when(~F.col("success"), F.struct(F.lit(False).alias("kept"), F.concat(F.lit("Failed: "), F.coalesce("error_type", F.lit("None"))).alias("reason")))
    put = lambda cond, keep, why: out.when(cond, F.struct(keep.alias("kept"), why.alias("reason")))
    out = put(few, F.lit(False), F.lit("Dropped: Too Few Edges (<5)"))
    if require_libraries:
        out = put(~has_libs, F.lit(False), F.lit("Dropped: Target Library Not Imported"))
        out = put(F.lit(True), F.lit(True), F.concat(F.lit("Kept: Target Library ("), F.array_join(F.array_sort("matched_libraries"), ","), F.lit(")")))
    out = put(F.col("ml_semantics"), F.lit(True), F.concat(F.lit("Kept: ML Semantics (Density: "), said, F.lit(")")))
    out = put(density < 0.05, F.lit(False), F.concat(F.lit("Dropped: Low Density ("), said, F.lit(")")))
    for cond, share, label in ((small, 0.3, "Small Graph"), (mid, 0.8, "Mid Graph"), (F.lit(True), 0.5, "Large Graph")):
        keep = p < share
        out = put(cond, keep, F.when(keep, f"Kept: {label} ({int(share * 100)}%)").otherwise(f"Dropped: {label} Sample"))
    return df.withColumn("__s", out).withColumn("kept", F.col("__s.kept")).withColumn("reason", F.col("__s.reason")).drop("__s")


def candidate_pairs(cells: DataFrame, edges: DataFrame, window: int = 5, cap: int = 30, seed: int = 42) -> DataFrame:
    """(nb_id, a, b, related): dependency pairs, each ambiguous candidate with its reader, and a seeded draw of `cap` near pairs that aren't related."""
    named = edges.select("nb_id", F.col("src_cell").alias("a"), F.col("dst_cell").alias("b")).unionByName(edges.select("nb_id", F.explode("candidate_def_cells").alias("a"), F.col("dst_cell").alias("b"))).where("a <> b").distinct()
    x = cells.select("nb_id", F.col("cell_id").alias("a"), F.col("document_index").alias("i"))
    y = cells.select("nb_id", F.col("cell_id").alias("b"), F.col("document_index").alias("j"))
    # a range join within a notebook, by the few places that a window has
    near = x.withColumn("j", F.explode(F.sequence(F.col("i") + 1, F.col("i") + window))).join(y, ["nb_id", "j"]).select("nb_id", "a", "b")
    near = near.join(named, ["nb_id", "a", "b"], "left_anti").join(named.select("nb_id", F.col("b").alias("a"), F.col("a").alias("b")), ["nb_id", "a", "b"], "left_anti")
    draw = F.row_number().over(Window.partitionBy("nb_id").orderBy(F.xxhash64(F.lit(seed), "a", "b"), "a", "b"))
    return named.withColumn("related", F.lit(True)).unionByName(near.withColumn("__r", draw).where(F.col("__r") <= cap).select("nb_id", "a", "b", F.lit(False).alias("related")))


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def pair_features(cells: DataFrame, edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs(nb_id, a, b) with features: eight figures of each cell, their difference, distance in the document, kinds of edges, reverse edge, provides, consumes, ambiguous."""
    i = edges.groupBy("nb_id", F.col("dst_cell").alias("cell_id")).agg(F.count("*").alias("n_in"))
    o = edges.groupBy("nb_id", F.col("src_cell").alias("cell_id")).agg(F.count("*").alias("n_out"))
    n = F.greatest(F.count("*").over(Window.partitionBy("nb_id")), F.lit(2))
    c = cells.join(i, ["nb_id", "cell_id"], "left").join(o, ["nb_id", "cell_id"], "left").withColumn("n", n)
    flag = lambda x: F.coalesce(F.col(x), F.lit(False)).cast("double")
    v = F.array(F.size("defined_names").cast("double"), F.size("free_uses").cast("double"), F.size("undefined_uses").cast("double"), flag("has_opaque_effects"), flag("parse_error"), F.log1p("n_lines"), F.coalesce("n_in", F.lit(0)).cast("double"), F.coalesce("n_out", F.lit(0)).cast("double"))
    c = c.select("nb_id", "cell_id", v.alias("v"), "document_index", "defined_names", "free_uses", "n")
    side = lambda s: c.select("nb_id", *(F.col(x).alias(s if x == "cell_id" else f"{s}_{x}") for x in c.columns if x != "nb_id"))
    e = edges.groupBy("nb_id", F.col("src_cell").alias("a"), F.col("dst_cell").alias("b")).agg(F.collect_set("kind").alias("kinds"), F.max(F.col("ambiguous").cast("double")).alias("amb"))
    back = edges.select("nb_id", F.col("dst_cell").alias("a"), F.col("src_cell").alias("b")).distinct().withColumn("rev", F.lit(1.0))
    p = pairs.join(side("a"), ["nb_id", "a"]).join(side("b"), ["nb_id", "b"]).join(e, ["nb_id", "a", "b"], "left").join(back, ["nb_id", "a", "b"], "left")
    kinds = [F.coalesce(F.array_contains("kinds", k).cast("double"), F.lit(0.0)) for k in KINDS]
    rest = F.array((F.col("b_document_index") - F.col("a_document_index")) / (F.col("a_n") - 1), *kinds, F.coalesce("rev", F.lit(0.0)), jaccard(F.col("a_defined_names"), F.col("b_free_uses")), jaccard(F.col("b_defined_names"), F.col("a_free_uses")), F.coalesce("amb", F.lit(0.0)))
    return p.select(*pairs.columns, F.concat("a_v", "b_v", F.zip_with("a_v", "b_v", lambda x, y: x - y), rest).alias("features"))


def pair_labels(pairs: DataFrame, order: DataFrame, trusted: float = 1.0, plain: float = 0.3) -> DataFrame:
    """pairs with label (a ran before b by order(nb_id, item, rank)) and weight (related pairs count `trusted`)."""
    x = order.select("nb_id", F.col("item").alias("a"), F.col("rank").alias("ra"))
    y = order.select("nb_id", F.col("item").alias("b"), F.col("rank").alias("rb"))
    got = pairs.join(x, ["nb_id", "a"]).join(y, ["nb_id", "b"])
    return got.withColumn("label", (F.col("ra") < F.col("rb")).cast("double")).withColumn("weight", F.when(F.col("related"), trusted).otherwise(plain)).drop("ra", "rb")


def supervised(cells: DataFrame, least: int = 3) -> DataFrame:
    """(nb_id, valid, linear): enough executed cells with distinct counts; counts in document order."""
    before = F.lag("execution_count").over(Window.partitionBy("nb_id").orderBy("document_index"))
    c = cells.where("execution_count is not null").withColumn("up", F.col("execution_count") > before)
    return c.groupBy("nb_id").agg(((F.count("*") >= least) & (F.countDistinct("execution_count") == F.count("*"))).alias("valid"), F.coalesce(F.bool_and("up"), F.lit(True)).alias("linear"))


def linear_extensions(cells: DataFrame, edges: DataFrame, n: int = 1, seed: int = 0) -> DataFrame:
    """(nb_id, draw, cell_id, rank): random orders that edges allow, one sequential draw per notebook."""
    from .cells import _kahn, _per_notebook

    kind, rows = _per_notebook(cells, edges)

    def per(table: pa.Table) -> pa.Table:
        import random

        got = table.to_pylist()
        names = sorted(r["dst"] for r in got if r["src"] is None)
        out: dict = {}
        for r in got:
            if r["src"] is not None:
                out.setdefault(r["src"], []).append(r["dst"])
        result = []
        for d in range(n):
            rnd = random.Random(f"{seed}:{got[0]['nb_id']}:{d}")
            degree: dict = {}
            for bs in out.values():
                for b in bs:
                    degree[b] = degree.get(b, 0) + 1
            result += [(d, c, i) for i, c in enumerate(_kahn({c: rnd.random() for c in names}, out, degree))]
        nb = pa.array([got[0]["nb_id"]] * len(result), table.schema.field("nb_id").type)
        return pa.table([nb, *(pa.array(x, t) for x, t in zip(zip(*result, strict=True), (pa.int64(), pa.string(), pa.int64()), strict=True))], names=["nb_id", "draw", "cell_id", "rank"])

    return rows.groupBy("nb_id").applyInArrow(per, f"nb_id {kind}, draw long, cell_id string, rank long")


def undersample(df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """As many rows of each class as the rarest has, by a seeded hash of the key."""
    least = df.groupBy(label).agg(F.count("*").alias("n")).agg(F.min("n").alias("__least"))
    return hash_ranked(df, F.col(label), key, seed, "__r").crossJoin(F.broadcast(least)).where("__r < __least").drop("__r", "__least")


def class_weights(df: DataFrame, label: str, classes: int, most: float = 5.0, root: bool = False) -> DataFrame:
    """(label, weight) of every class 0..classes-1: inverse frequency (its root), to mean 1, clipped; 1 before that for absent ones."""
    counts = df.groupBy(F.col(label).cast("int").alias("label")).agg(F.count("*").alias("c"))
    every = df.sparkSession.range(classes).select(F.col("id").cast("int").alias("label")).join(counts, "label", "left")
    w = Window.partitionBy()
    raw = F.when(F.col("c") > 0, F.sum("c").over(w) / (classes * F.col("c"))).otherwise(1.0)
    out = every.withColumn("raw", F.sqrt(raw) if root else raw)
    return out.select("label", F.least(F.col("raw") / F.avg("raw").over(w), F.lit(most)).alias("weight"))


def folds(items: DataFrame, key: str, stratum: str, k: int = 5, seed: int = 42) -> DataFrame:
    """items with fold: dealt in turn within each stratum in a seeded order; over all items alike if some stratum has fewer than k."""
    small = items.groupBy(stratum).agg(F.count("*").alias("n")).agg(F.min("n").alias("n")).first()["n"]
    group = F.lit("") if small is None or small < k else F.col(stratum).cast("string")
    return hash_ranked(items, group, key, seed, "__r").withColumn("fold", (F.col("__r") % k).cast("int")).drop("__r")


#: What of a notebook's source shows that it trains or applies models.
ML_SOURCE = r"\b(sklearn|torch|tensorflow|keras|xgboost|lightgbm|catboost|tensor|polars|pyspark)\b|\.fit\(|\.predict\(|\.evaluate\(|\.backward\(|\.transpose\(|\.reshape\("


def validate(cells: DataFrame, targets: list[str] | None = None) -> DataFrame:
    """(nb_id, success, error_type, edge_count, node_count, lines_of_code, contains_ml_semantics, matched_libraries) of cells(nb_id, cell_id, document_index, source).

    Blank cells don't count; a notebook of blank cells is an EmptyNotebook, and
    one with a cell that doesn't parse fails with the error's name. Libraries
    are the imported roots among `targets`, in lower case, sorted.
    """
    from ..ir import build

    code = cells.where(F.col("source").rlike(r"\S"))
    lines = F.size(F.split(F.regexp_replace("source", r"(\r\n|\r|\n)$", ""), r"\r\n|\r|\n"))
    read = code.groupBy("nb_id").agg(F.sum(lines).cast("long").alias("lines_of_code"), F.bool_or(F.col("source").rlike(ML_SOURCE)).alias("contains_ml_semantics"))
    records = build.parse(code)
    made = records.groupBy("nb_id").agg(F.count_if(F.col("rec") == "edge").alias("edge_count"), F.count_if(F.col("rec") == "node").alias("node_count"), F.max(F.when(F.col("rec") == "error", F.substring_index("error", ":", 1))).alias("error_type"))
    wanted = [t.lower() for t in targets or []]
    roots = imports(code).select("nb_id", F.lower("root").alias("root")).where(F.col("root").isin(*wanted)) if wanted else imports(code).select("nb_id", "root").limit(0)
    matched = roots.groupBy("nb_id").agg(F.array_sort(F.collect_set("root")).alias("matched_libraries"))
    out = cells.select("nb_id").distinct()
    for more in (read, made, matched):
        out = out.join(more, "nb_id", "left")
    error = F.when(F.col("lines_of_code").isNull(), "EmptyNotebook").otherwise(F.col("error_type"))
    count = lambda c: F.when(error.isNull(), F.coalesce(c, F.lit(0))).otherwise(F.lit(0)).cast("long").alias(c)
    return out.select(
        "nb_id", error.isNull().alias("success"), error.alias("error_type"), count("edge_count"), count("node_count"),
        F.coalesce("lines_of_code", F.lit(0)).cast("long").alias("lines_of_code"), F.coalesce("contains_ml_semantics", F.lit(False)).alias("contains_ml_semantics"),
        F.coalesce("matched_libraries", F.array().cast("array<string>")).alias("matched_libraries"),
    )


#: What a notebook can be flagged as.
FLAGS = ("bug_in_dataflow", "needs_review", "not_relevant")


def flag(registry: DataFrame, updates: DataFrame) -> DataFrame:
    """registry(notebook, flag) after updates(notebook, flag, ord): the last update of a notebook wins, a null flag takes it out; unknown flags raise."""
    known = F.col("flag").isNull() | F.col("flag").isin(*FLAGS)
    checked = updates.withColumn("flag", F.when(known, F.col("flag")).otherwise(F.raise_error(F.concat(F.lit("no such flag: "), "flag"))))
    last = checked.groupBy("notebook").agg(F.max_by(F.struct("flag"), "ord").alias("f")).select("notebook", F.col("f.flag").alias("flag"))
    return registry.select("notebook", "flag").join(last, "notebook", "left_anti").unionByName(last.where("flag is not null"))


def top_missing(calls: DataFrame, known: DataFrame, k: int = 20) -> DataFrame:
    """(library, api, n): the most frequent calls that the knowledge base lacks."""
    return calls.join(known.select("library", "api").distinct(), ["library", "api"], "left_anti").groupBy("library", "api").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "library", "api").limit(k)


def coverage(calls: DataFrame, known: DataFrame) -> DataFrame:
    """(covered): share of calls in the knowledge base."""
    k = known.select("library", "api").distinct().withColumn("__k", F.lit(1.0))
    return calls.join(k, ["library", "api"], "left").agg(F.avg(F.coalesce("__k", F.lit(0.0))).alias("covered"))


def evolve(known: DataFrame, proposed: DataFrame, calls: DataFrame) -> DataFrame:
    """known with proposals (no null api, the first of a signature) if they raise the coverage; else known."""
    new = known.withColumn("__g", F.lit(0)).unionByName(proposed.where("api is not null").withColumn("__g", F.lit(1)))
    r = F.row_number().over(Window.partitionBy("library", "module", "caller", "api").orderBy("__g", "ord"))
    new = new.withColumn("__r", r).where("__r = 1").drop("__r", "__g")
    return new if coverage(calls, new).first()["covered"] > coverage(calls, known).first()["covered"] else known


def relabel(nodes: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with labels corrected by rules(api, label), counts of old and new labels)."""
    out = nodes.join(rules.withColumnRenamed("label", "__l"), "api", "left").withColumn("new_label", F.coalesce("__l", "label")).drop("__l")
    return out, out.groupBy(F.col("label").alias("old_label"), "new_label").agg(F.count("*").alias("n"))


def next_item(items: DataFrame, gone: DataFrame, current: DataFrame) -> DataFrame:
    """(item, next_item) for current items: the next in name order among those left, round to the first.

    Names are dealt to ranges, and each range looks into itself; only a range's
    first name goes by way of the driver, one for each shuffle partition.
    """
    spark = items.sparkSession
    checkpoints(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    left = items.select("item").distinct().join(gone.select("item"), "item", "left_anti")
    dealt = left.repartitionByRange(parts, "item").select("item", F.spark_partition_id().alias("__p")).checkpoint()
    firsts = {r["__p"]: r["f"] for r in dealt.groupBy("__p").agg(F.min("item").alias("f")).collect()}
    order = sorted(firsts)
    follow = [(p, firsts[order[(i + 1) % len(order)]]) for i, p in enumerate(order)]
    edge = spark.createDataFrame(follow, "__p int, __f string")
    w = Window.partitionBy("__p").orderBy("item")
    ring = dealt.withColumn("__l", F.lead("item").over(w)).join(F.broadcast(edge), "__p").select("item", F.coalesce("__l", "__f").alias("next_item"))
    first = F.lit(firsts[order[0]] if order else None)
    return current.select("item").join(ring, "item", "left").select("item", F.coalesce("next_item", first).alias("next_item"))


def month_ranges(start: str, end: str, spark) -> DataFrame:
    """(first_day, last_day) of the months of a scan."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 month"))).alias("first_day")).withColumn("last_day", F.last_day("first_day"))


def per_repo(found: DataFrame, cap: int) -> DataFrame:
    """Search results(repo, path) without repeats, the first `cap` paths of each repository (the feature's own limit)."""
    w = Window.partitionBy("repo").orderBy("path")
    return found.dropDuplicates(["repo", "path"]).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= cap).drop("__r")


# ---------------------------------------------------------- code statistics

_COUNTS = "loops for_else while_else branches match_cases list_comp dict_comp set_comp gen_expr try_except with_blocks async_functions awaits max_nesting_depth".split()
_LOOPS = (ast.For, ast.AsyncFor, ast.While)
_COMPREHENSIONS = {ast.ListComp: "list_comp", ast.DictComp: "dict_comp", ast.SetComp: "set_comp", ast.GeneratorExp: "gen_expr"}


def complexity_of(source: str) -> dict[str, int] | None:
    """Fourteen counts of a source's constructs; null if it doesn't parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return None
    got = dict.fromkeys(_COUNTS, 0)
    todo: list[tuple[ast.AST, int]] = [(tree, 0)]
    while todo:
        node, depth = todo.pop()
        kind, opens = type(node), True
        if kind in _LOOPS:
            got["loops"] += 1
            if node.orelse:
                got["while_else" if kind is ast.While else "for_else"] += 1
        elif kind is ast.If:
            got["branches"] += 1
        elif kind is ast.Match:
            got["match_cases"] += len(node.cases)
        elif kind in _COMPREHENSIONS:
            got[_COMPREHENSIONS[kind]] += 1
        elif kind is ast.Try:
            got["try_except"] += 1
        elif kind in (ast.With, ast.AsyncWith):
            got["with_blocks"] += 1
        else:
            opens = False
            got["async_functions"] += kind is ast.AsyncFunctionDef
            got["awaits"] += kind is ast.Await
        got["max_nesting_depth"] = max(got["max_nesting_depth"], depth + opens)
        todo.extend((c, depth + opens) for c in ast.iter_child_nodes(node))
    return got


def complexity(cells: DataFrame) -> DataFrame:
    """(nb_id, the fourteen counts) summed over the cells that parse; the depth is the most."""

    def run(batches):
        for b in batches:
            got = [complexity_of(s or "") for s in b.column("source").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("nb_id"), *(pa.array([None if g is None else g[c] for g in got], pa.int64()) for c in _COUNTS)], names=["nb_id", *_COUNTS])

    kind = cells.schema["nb_id"].dataType.simpleString()
    per = cells.select("nb_id", "source").mapInArrow(run, f"nb_id {kind}, " + ", ".join(f"{c} long" for c in _COUNTS))
    return per.groupBy("nb_id").agg(*((F.max if c == "max_nesting_depth" else F.sum)(c).alias(c) for c in _COUNTS))


def imports_of(source: str) -> list[tuple[str, str, str]]:
    """(root library, module, name bound) of each import."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            out += [(a.name.split(".")[0], a.name, a.asname or a.name.split(".")[0]) for a in node.names]
        elif isinstance(node, ast.ImportFrom) and node.module:
            out += [(node.module.split(".")[0], f"{node.module}.{a.name}", a.asname or a.name) for a in node.names]
    return out


def imports(cells: DataFrame) -> DataFrame:
    """(nb_id, cell_id, root, module, alias) of every import."""

    def run(batches):
        for b in batches:
            rows = [(n, c, *i) for n, c, s in zip(*(b.column(x).to_pylist() for x in ("nb_id", "cell_id", "source")), strict=True) for i in imports_of(s or "")]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field("nb_id").type), *(pa.array(c, pa.string()) for c in cols[1:])], names=["nb_id", "cell_id", "root", "module", "alias"])

    kind = cells.schema["nb_id"].dataType.simpleString()
    return cells.select("nb_id", "cell_id", "source").mapInArrow(run, f"nb_id {kind}, cell_id string, root string, module string, alias string")


def import_summary(found: DataFrame) -> DataFrame:
    """(nb_id, roots, n_imports): libraries in lower case, sorted."""
    return found.groupBy("nb_id").agg(F.array_sort(F.collect_set(F.lower("root"))).alias("roots"), F.count("*").alias("n_imports"))
