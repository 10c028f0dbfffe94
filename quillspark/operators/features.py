"""Feature operators: figures of each CALL node from its notebook's graph."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..taxonomy import DATA_PATH, FAMILIES
from . import graphs
from .centrality import centrality  # noqa: F401, a feature like the others
from .shared import by_group, checkpoints

#: Groups of a feature vector in order, and their widths.
GROUPS = [("code_emb", 300), ("api_emb", 300), ("lib_emb", 300), ("degree", 2), ("cell_pos", 1), ("neighbor", 2), ("lib_category", 6), ("lineage_struct", 10), ("semantic_anchor", 3), ("centrality", 5)]
#: The names of the presets and their groups.
PRESETS = {
    "standard": "code_emb degree cell_pos neighbor lineage_struct",
    "emb_rich": "code_emb api_emb lib_emb degree cell_pos neighbor lib_category lineage_struct semantic_anchor",
    "all": "code_emb api_emb lib_emb degree cell_pos neighbor lib_category lineage_struct semantic_anchor centrality",
    "emb_only": "code_emb",
    "api_lib": "api_emb lib_emb",
    "api29": "api_emb degree cell_pos neighbor lib_category lineage_struct semantic_anchor centrality",
    "api24": "api_emb degree cell_pos neighbor lib_category lineage_struct semantic_anchor",
    "struct_only": "degree cell_pos neighbor lineage_struct",
}
STANDARD = PRESETS["standard"].split()
MODEL_APIS = "fit fit_predict predict predict_proba predict_log_proba score cross_val_score cross_validate evaluate partial_fit".split()


def layout(groups: list[str]) -> list[tuple[str, int, int]]:
    """(group, start, end) of the chosen groups in a vector."""
    out, at = [], 0
    for name, width in GROUPS:
        if name in groups:
            out.append((name, at, at + width))
            at += width
    return out


def groups_of(width: int) -> list[str]:
    """The groups that make up a vector of this width: a preset's, or the standard ones as far as they go; standard for any other width."""
    partial = [STANDARD[:n] for n in range(1, len(STANDARD))]
    named = [n.split() for n in PRESETS.values()] + [["code_emb", "api_emb", "lib_emb"]] + partial
    return next((n for n in named if sum(w for g, w in GROUPS if g in n) == width), STANDARD)


def cell_positions(nodes: DataFrame) -> DataFrame:
    """(nb_id, cell_id, position): cells in the order of their first node, from 0 to 1."""
    first = nodes.groupBy("nb_id", "cell_id").agg(F.min("ord").alias("o"))
    w = Window.partitionBy("nb_id")
    return first.select("nb_id", "cell_id", ((F.row_number().over(w.orderBy("o", "cell_id")) - 1) / F.greatest(F.count("*").over(w) - 1, F.lit(1))).alias("position"))


def neighbours(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(nb_id, node_id, n_variables, n_literals, path_literal) of distinct predecessors of CALL nodes."""
    e = graphs.with_ends(edges.select("nb_id", "src", "dst").distinct(), nodes, "struct_type", "code", "label")
    text = F.coalesce(F.nullif("src_code", F.lit("")), "src_label")
    got = e.where("dst_struct_type = 9").groupBy("nb_id", F.col("dst").alias("node_id")).agg(
        F.count_if(F.col("src_struct_type") == 0).alias("n_variables"),
        F.count_if(F.col("src_struct_type") == 8).alias("n_literals"),
        F.coalesce(F.bool_or((F.col("src_struct_type") == 8) & text.rlike(DATA_PATH)), F.lit(False)).alias("path_literal"),
    )
    calls = nodes.where("struct_type = 9").select("nb_id", "node_id").join(got, ["nb_id", "node_id"], "left")
    return calls.select("nb_id", "node_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_variables", "n_literals")), F.coalesce("path_literal", F.lit(False)).alias("path_literal"))


def families(text: Column) -> list[Column]:
    """A flag for each library family whose words the text holds."""
    words = F.split(F.lower(text), "[^a-z0-9_]+")
    return [F.arrays_overlap(words, F.array(*map(F.lit, names))).cast("int").alias(f"lib_{k}") for k, names in FAMILIES.items()]


def loaders(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Structural loaders: CALL nodes without variable inputs that a data path feeds."""
    return neighbours(nodes, edges).where("n_variables = 0 and path_literal").select("nb_id", "node_id")


def source_reach(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes' (nb_id, node_id, from_source, n_sources, depth)."""
    got = graphs.hops(edges, loaders(nodes, edges))
    return nodes.select("nb_id", "node_id").join(got, ["nb_id", "node_id"], "left").select("nb_id", "node_id", F.col("depth").isNotNull().alias("from_source"), F.coalesce("n_seeds", F.lit(0)).cast("long").alias("n_sources"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"))


def api_name(label: Column, code: Column) -> Column:
    """The API that a node calls: of a 'call x' or 'method x' label, else the callee of the code."""
    from ..functions.text import callee

    named = F.regexp_extract(F.trim(label), r"(?i)^(?:call|method)\s+(\S.*)$", 1)
    return F.lower(F.when(named != "", F.trim(named)).otherwise(callee(F.coalesce(F.nullif(code, F.lit("")), label))))


def semantic_reach(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(nb_id, node_id, from_load, to_model): reached from a load call; reaching a model call; both inclusive."""
    api = api_name(F.col("label"), F.col("code"))
    calls = nodes.where("struct_type = 9").select("nb_id", "node_id", api.alias("api"))
    load = calls.where(F.col("api").rlike("^(read_|scan_|fetch_|load_)") | F.col("api").isin("loadtxt", "genfromtxt", "imread", "load")).select("nb_id", "node_id")
    model = calls.where(F.col("api").isin(*MODEL_APIS)).select("nb_id", "node_id")
    down = graphs.reached(edges, load).unionByName(load).distinct().withColumn("a", F.lit(True))
    up = graphs.reached(edges, model, backwards=True).unionByName(model).distinct().withColumn("b", F.lit(True))
    return nodes.select("nb_id", "node_id").join(down, ["nb_id", "node_id"], "left").join(up, ["nb_id", "node_id"], "left").select("nb_id", "node_id", F.coalesce("a", F.lit(False)).alias("from_load"), F.coalesce("b", F.lit(False)).alias("to_model"))


def supervised_fit(label: Column, code: Column) -> Column:
    return (api_name(label, code).isin("fit", "fit_predict") & code.rlike(r"\.fit\w*\s*\([^)]*,")).cast("int")


def assignment(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(nb_id, node_id, in_assign): 1 if the first variable or sink that a walk through CALL nodes meets is a variable, 0 a sink, 0.5 neither."""
    kind = nodes.schema["nb_id"].dataType.simpleString()
    e = graphs.with_ends(edges, nodes, "struct_type").select("nb_id", "src", "dst", "ord", "src_struct_type", "dst_struct_type")
    lone = nodes.where("struct_type = 9").select("nb_id", F.col("node_id").alias("src"), F.lit(None).cast("string").alias("dst"), F.lit(0).cast("long").alias("ord"), F.lit(9).alias("src_struct_type"), F.lit(-1).alias("dst_struct_type"))

    def per(nb, ways: list[tuple]) -> list[tuple]:
        out: dict = {}
        kinds: dict = {}
        for src, dst, _, of_src, of_dst in ways:
            kinds[src] = of_src
            if dst is not None:
                kinds[dst] = of_dst
                out.setdefault(src, []).append(dst)
        rows = []
        for n in sorted(k for k, t in kinds.items() if t == 9):
            seen: set = set()
            todo = list(out.get(n, ()))
            verdict = 0.5
            for s in todo:
                if s in seen:
                    continue
                seen.add(s)
                if kinds[s] == 0 or (kinds[s] == 4 and s.startswith("sink_")):
                    verdict = 1.0 if kinds[s] == 0 else 0.0
                    break
                if kinds[s] == 9:
                    todo.extend(out.get(s, ()))
            rows.append((nb, n, verdict))
        return rows

    return by_group(e.unionByName(lone.select(*(F.col(c).cast(t) for c, t in e.dtypes))), "nb_id", ["ord"], per, f"nb_id {kind}, node_id string, in_assign double")


#: The structural features in order.
STRUCTURE = "is_sink n_successor_ops is_source path_literal_input struct_loader from_data_source n_source_ancestors depth_from_source output_reuse in_assign".split()


def structure(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The ten structural features of each CALL node."""
    d = graphs.degrees(nodes, edges)
    kinds = nodes.select("nb_id", "node_id", "struct_type")
    one = edges.select("nb_id", F.col("src").alias("node_id"), F.col("dst").alias("mid"))
    two = one.join(edges.select("nb_id", F.col("src").alias("mid"), F.col("dst").alias("end")), ["nb_id", "mid"]).join(kinds.withColumnRenamed("node_id", "end"), ["nb_id", "end"])
    after = two.groupBy("nb_id", "node_id").agg(F.count("*").alias("reuse"), F.count_if(F.col("struct_type").isin(9)).alias("ops"))
    out = nodes.where("struct_type = 9").select("nb_id", "node_id")
    for more in (d.select("nb_id", "node_id", "out_degree"), after, neighbours(nodes, edges), source_reach(nodes, edges), assignment(nodes, edges)):
        out = out.join(more, ["nb_id", "node_id"], "left")
    c = lambda name: F.coalesce(F.col(name), F.lit(0))
    share = lambda name, k: F.least(c(name) / k, F.lit(1.0))
    flag = lambda cond: F.when(cond, 1.0).otherwise(0.0)
    return out.select(
        "nb_id", "node_id", flag(c("out_degree") == 0).alias("is_sink"), share("ops", 5.0).alias("n_successor_ops"), flag(c("n_variables") == 0).alias("is_source"), flag(F.col("path_literal")).alias("path_literal_input"),
        flag((c("n_variables") == 0) & F.col("path_literal")).alias("struct_loader"), flag(F.col("from_source")).alias("from_data_source"), share("n_sources", 3.0).alias("n_source_ancestors"), share("depth", 8.0).alias("depth_from_source"), share("reuse", 5.0).alias("output_reuse"), F.coalesce("in_assign", F.lit(0.5)).alias("in_assign"),
    )


def embed(df: DataFrame, text: str, out: str, width: int = 300) -> DataFrame:
    """A hashed word vector for each text, normed; the zero vector for none.

    It takes the place of a model download: each distinct text is embedded once.
    """
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")
    at = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(width)).cast("int"))
    distinct = df.select(text).distinct().withColumn("__at", at)
    counts = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.size(F.filter("__at", lambda x: x == i)).cast("double"))
    vec = distinct.withColumn("__v", counts).withColumn("__norm", F.sqrt(F.aggregate("__v", F.lit(0.0), lambda a, x: a + x * x)))
    vec = vec.select(F.col(text).alias("__t"), F.transform("__v", lambda x: F.when(F.col("__norm") > 0, x / F.col("__norm")).otherwise(0.0)).alias(out))
    return df.join(vec, df[text].eqNullSafe(vec["__t"]), "left").drop("__t")


def assemble(nodes: DataFrame, edges: DataFrame, groups: list[str], embed_text=None) -> DataFrame:
    """(nb_id, node_id, features array<double>) of each CALL node: the groups' figures at the places of `layout(groups)`.

    Only the tables that a group needs are made. embed_text(df, text, out) embeds
    the code, the API's name and `base_inputs` (empty where the nodes have no such
    column); `embed` unless given. Unknown groups, and vectors that an embedder
    makes in another width, are errors. A node whose cell is null stands in the
    middle (0.5); a figure that a node lacks is 0; repeated nodes are an error of
    the caller. No nodes give no rows.
    """
    unknown = set(groups) - {n for n, _ in GROUPS}
    if unknown:
        raise ValueError(f"no such feature groups: {sorted(unknown)}")
    put, key = embed_text or embed, ["nb_id", "node_id"]
    # each group reads them, some often
    checkpoints(nodes.sparkSession)
    nodes, edges = nodes.checkpoint(), edges.checkpoint()
    base = F.coalesce(F.col("base_inputs"), F.lit("")) if "base_inputs" in nodes.columns else F.lit("")
    code = F.coalesce(F.nullif("code", F.lit("")), "label", F.lit(""))
    text = {"code_emb": code, "api_emb": F.coalesce(api_name(F.col("label"), F.col("code")), F.lit("")), "lib_emb": base}
    out = nodes.where("struct_type = 9").select(*key, "cell_id", "label", "code", base.alias("__base"), *(text[g].alias(f"__text_{g}") for g in text if g in groups))
    for g in text:
        if g in groups:
            out = put(out, f"__text_{g}", g).drop(f"__text_{g}")
    more = {
        "degree": lambda: graphs.degrees(nodes, edges).select(*key, F.array("in_degree", "out_degree").alias("degree")),
        "neighbor": lambda: neighbours(nodes, edges).select(*key, F.array("n_variables", "n_literals").alias("neighbor")),
        "lineage_struct": lambda: structure(nodes, edges).select(*key, F.array(*STRUCTURE).alias("lineage_struct")),
        "semantic_anchor": lambda: semantic_reach(nodes, edges).select(*key, F.array(F.col("from_load").cast("double"), F.col("to_model").cast("double")).alias("semantic_anchor")),
        "centrality": lambda: centrality(nodes, edges).select(*key, F.array("in_degree", "out_degree", "betweenness", "pagerank", "clustering").alias("centrality")),
    }
    for g, make in more.items():
        if g in groups:
            out = out.join(make(), key, "left")
    if "cell_pos" in groups:
        at = cell_positions(nodes.where("cell_id is not null and cell_id <> ''"))
        out = out.join(at, ["nb_id", "cell_id"], "left").withColumn("cell_pos", F.array(F.coalesce("position", F.lit(0.5))))
    if "lib_category" in groups:
        out = out.withColumn("lib_category", F.array(*families(F.concat_ws(" ", "__base", "label", "code"))))
    if "semantic_anchor" in groups:
        fit = F.coalesce(supervised_fit(F.col("label"), F.col("code")), F.lit(0)).cast("double")
        out = out.withColumn("semantic_anchor", F.concat("semantic_anchor", F.array(fit)))
    parts = []
    for g, start, end in layout(groups):
        part = F.transform(F.col(g).cast("array<double>"), lambda x: F.coalesce(x, F.lit(0.0)))
        wrong = F.raise_error(F.concat(F.lit(f"{g} has to be {end - start} wide, not "), F.size(g).cast("string"))).cast("array<double>")
        parts.append(F.when(F.col(g).isNull(), F.array_repeat(F.lit(0.0), end - start)).when(F.size(g) == end - start, part).otherwise(wrong))
    return out.select(*key, (F.concat(*parts) if parts else F.array().cast("array<double>")).alias("features"))


def zscore(df: DataFrame, vector: str, eps: float = 1e-8) -> DataFrame:
    """df with the vector's entries less their mean over their population deviation; deviations under eps count as 1.

    Means need one aggregate over positions; the table of positions is as long
    as the vector, so it is broadcast.
    """
    at = df.select(F.posexplode(vector).alias("i", "x"))
    s = at.groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("d"))
    table = s.agg(F.sort_array(F.collect_list(F.struct("i", "m", F.when(F.col("d") < eps, 1.0).otherwise(F.col("d")).alias("d")))).alias("__s"))
    return df.crossJoin(F.broadcast(table)).withColumn(vector, F.zip_with(vector, "__s", lambda x, s: (x - s["m"]) / s["d"])).drop("__s")


def encode(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with `side` and dense `index` per notebook and side, edges by relation): operations and variables, each relation with its reverse."""
    side = F.when(F.col("struct_type") == 9, "operation").otherwise("variable")
    placed = nodes.withColumn("side", side).withColumn("index", (F.row_number().over(Window.partitionBy("nb_id", "side").orderBy("ord", "node_id")) - 1).cast("long"))
    e = graphs.with_ends(edges, placed, "side", "index").where("src_side <> dst_side")
    fore = e.select("nb_id", F.concat_ws("-", "src_side", "dst_side").alias("relation"), F.col("src_index").alias("a"), F.col("dst_index").alias("b"))
    back = e.select("nb_id", F.concat_ws("-", F.lit("rev"), "src_side", "dst_side").alias("relation"), F.col("dst_index").alias("a"), F.col("src_index").alias("b"))
    return placed, fore.unionByName(back)


def line_graph(edges: DataFrame) -> DataFrame:
    """(nb_id, a, b): edges as nodes, an edge between those that meet head to tail, by their `ord`."""
    x = edges.select("nb_id", F.col("dst").alias("at"), F.col("ord").alias("a"))
    y = edges.select("nb_id", F.col("src").alias("at"), F.col("ord").alias("b"))
    return x.join(y, ["nb_id", "at"]).select("nb_id", "a", "b").where("a <> b")


def negative_edges(nodes: DataFrame, edges: DataFrame, seed: int = 0, tries: int = 4) -> DataFrame:
    """(nb_id, ord, src, dst): for each edge a pair of the notebook's nodes without an edge, by a seeded hash, if one of `tries` draws finds one."""
    placed = nodes.select("nb_id", "node_id", (F.row_number().over(Window.partitionBy("nb_id").orderBy("ord", "node_id")) - 1).alias("i"))
    size = placed.groupBy("nb_id").agg(F.count("*").alias("n"))
    pick = lambda salt: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "nb_id", "ord", "try"), F.col("n"))
    drawn = edges.select("nb_id", "ord", F.explode(F.sequence(F.lit(1), F.lit(tries))).alias("try")).join(size, "nb_id").select("nb_id", "ord", "try", pick("src").alias("a"), pick("dst").alias("b")).where("a <> b")
    named = drawn.join(placed.select("nb_id", F.col("i").alias("a"), F.col("node_id").alias("src")), ["nb_id", "a"]).join(placed.select("nb_id", F.col("i").alias("b"), F.col("node_id").alias("dst")), ["nb_id", "b"])
    free = named.join(edges.select("nb_id", "src", "dst"), ["nb_id", "src", "dst"], "left_anti")
    return free.groupBy("nb_id", "ord").agg(F.min_by(F.struct("src", "dst"), "try").alias("p")).select("nb_id", "ord", "p.src", "p.dst")


def two_way(edges: DataFrame) -> DataFrame:
    return edges.select("nb_id", "src", "dst").unionByName(edges.select("nb_id", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
