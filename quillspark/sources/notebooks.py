"""Sources and sinks: notebooks, scripts, graph payloads, trace payloads, annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_CELL = "cells array<string>"


def scan(spark: SparkSession, path: str, pattern: str = "*.ipynb") -> DataFrame:
    """(nb_id, document_index, cell_id, cell_type, source, execution_count) of notebook files below path; files that aren't JSON give none.

    source may be a string or an array of lines; a missing id is
    fallback-<place among all cells>. document_index counts all cells.
    """
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True).withColumn("nb_id", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))
    return cells_of(raw)


def cells_of(raw: DataFrame) -> DataFrame:
    """The cells of notebooks (nb_id, value), value their JSON."""
    cells = raw.select("nb_id", F.posexplode(F.from_json("value", _CELL)["cells"]).alias("document_index", "raw")).select("nb_id", "document_index", F.try_parse_json("raw").alias("v"))
    text = lambda p: F.try_variant_get("v", p, "string")
    lines = F.try_variant_get("v", "$.source", "array<string>")
    return cells.select("nb_id", "document_index", F.coalesce(text("$.id"), F.concat(F.lit("fallback-"), F.col("document_index").cast("string"))).alias("cell_id"), text("$.cell_type").alias("cell_type"), F.coalesce(F.array_join(lines, ""), text("$.source"), F.lit("")).alias("source"), F.try_variant_get("v", "$.execution_count", "int").alias("execution_count"))


def code_cells(cells: DataFrame, greedy: bool = True) -> DataFrame:
    """Code cells that aren't blank; not greedy: executed ones only, their execution count for order."""
    c = cells.where("cell_type = 'code'").where(F.trim(F.regexp_replace("source", r"\s", "")) != "")
    return c.withColumn("rank", F.col("document_index")) if greedy else c.where("execution_count > 0").withColumn("rank", F.col("execution_count"))


def execution_graph(cells: DataFrame) -> DataFrame:
    """(nb_id, src, dst): each code cell and the next in rank order."""
    before = F.lag("cell_id").over(Window.partitionBy("nb_id").orderBy("rank", "document_index"))
    return cells.select("nb_id", before.alias("src"), F.col("cell_id").alias("dst")).where("src is not null")


def notebook_code(cells: DataFrame) -> DataFrame:
    """(nb_id, code, loc): cells' sources in rank order, and lines that aren't blank."""
    code = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "document_index", "source"))), lambda x: x["source"]), "\n")
    return cells.groupBy("nb_id").agg(code.alias("code")).withColumn("loc", F.size(F.filter(F.split("code", "\n"), lambda x: F.trim(x) != "")))


def windows(cells: DataFrame, n: int) -> DataFrame:
    """(nb_id, start, sources): every run of n cells in rank order."""
    w = Window.partitionBy("nb_id").orderBy("rank", "document_index")
    return cells.select("nb_id", (F.row_number().over(w) - 1).alias("start"), F.collect_list("source").over(w.rowsBetween(0, n - 1)).alias("sources")).where(F.size("sources") == n)


def scripts(spark: SparkSession, path: str) -> DataFrame:
    """(nb_id, cell_id, document_index, source) of Python files below path, one cell each."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.py").text(path, wholetext=True)
    return raw.select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("nb_id"), F.lit("script00").alias("cell_id"), F.lit(0).alias("document_index"), F.col("value").alias("source"))


_DATA = "id string, label string, node_type int, cell_id string, code string, base_inputs string, source string, target string, edge_type int, domain_label string, predicted_label int"


def elements(payloads: DataFrame, column: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of graph payloads (nb_id, JSON): an object with elements or a bare list; what has a source is an edge, whose label is NOT_RELEVANT by default.

    Unknown keys are not read. Edges with an end that is no node are dropped.
    """
    body = F.coalesce(F.from_json(column, f"elements array<struct<data: struct<{_typed(_DATA)}>>>")["elements"], F.from_json(column, f"array<struct<data: struct<{_typed(_DATA)}>>>"))
    e = payloads.select("nb_id", F.posexplode(body).alias("ord", "e")).select("nb_id", "ord", "e.data.*")
    nodes = e.where("source is null and target is null and id is not null").withColumnRenamed("id", "node_id").drop("source", "target", "edge_type")
    edges = e.where("source is not null and target is not null").withColumnsRenamed({"source": "src", "target": "dst"}).withColumn("domain_label", F.coalesce("domain_label", F.lit("NOT_RELEVANT"))).drop("id", "node_type", "base_inputs")
    known = nodes.select("nb_id", "node_id")
    edges = edges.join(known.withColumnRenamed("node_id", "src"), ["nb_id", "src"], "left_semi").join(known.withColumnRenamed("node_id", "dst"), ["nb_id", "dst"], "left_semi")
    return nodes, edges


def checked_elements(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """(nb_id, ord, kind, id, source, target, label, node_type, error) of graph payloads of any shape: a row for each element, malformed ones too.

    A payload is a VARIANT, of which only the keys named here are taken; what
    else a user interface keeps in an element (position, classes, nested data) is
    never cast or carried. kind is 'edge' where there is a source or a target,
    else 'node'; ids that are numbers count as text. Errors: 'payload' (null, not
    JSON, or without a list of elements: one row, ord null), 'element' (not an
    object, or without an object as data), 'id' (a node's), 'end' (an edge with one
    end), 'type' (node_type is there and no whole number); a row with an error
    keeps what could be read. A payload with an empty list has no row.
    """
    v = payloads.select("nb_id", F.try_parse_json(column).alias("v"))
    many = F.coalesce(F.try_variant_get("v", "$.elements", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"))
    good = v.select("nb_id", many.alias("es")).select("nb_id", F.posexplode(F.coalesce("es", F.array(F.lit(None).cast("variant")))).alias("ord", "e"), F.col("es").isNotNull().alias("listed"))
    data = good.withColumn("d", F.try_variant_get("e", "$.data", "variant")).withColumn("d", F.when(F.schema_of_variant("d").startswith("OBJECT"), F.col("d")))
    read = lambda key, kind: F.try_variant_get("d", f"$.{key}", kind).alias(key)
    rows = data.select("nb_id", F.when(F.col("listed"), F.col("ord").cast("long")).alias("ord"), "listed", F.col("d").isNotNull().alias("whole"), *(read(k, "string") for k in ("id", "source", "target", "label")), read("node_type", "long"), F.try_variant_get("d", "$.node_type", "string").alias("__type"))
    edge = F.col("source").isNotNull() | F.col("target").isNotNull()
    error = F.when(~F.col("listed"), "payload").when(~F.col("whole"), "element").when(edge & (F.col("source").isNull() | F.col("target").isNull()), "end").when(~edge & F.col("id").isNull(), "id").when(F.col("node_type").isNull() & F.col("__type").isNotNull(), "type")
    return rows.withColumn("kind", F.when(F.col("whole"), F.when(edge, "edge").otherwise("node"))).withColumn("error", error).select("nb_id", "ord", "kind", "id", "source", "target", "label", "node_type", "error")


def _typed(ddl: str) -> str:
    return ", ".join(": ".join(f.strip().split(" ")) for f in ddl.split(","))


def canonical_label(label: Column) -> Column:
    """Labels of annotations: artifact export counts as export."""
    return F.when(label == 6, 4).otherwise(label)


def grouped_elements(payloads: DataFrame, column: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of payloads whose elements name their group; nodes with a dense index per notebook."""
    e = payloads.select("nb_id", F.posexplode(F.from_json(column, "elements array<struct<group: string, data: struct<id: string, label: string, source: string, target: string>>>")["elements"]).alias("ord", "e"))
    nodes = e.where("e.group = 'nodes'").select("nb_id", F.col("e.data.id").alias("node_id"), F.col("e.data.label").alias("label"), (F.row_number().over(Window.partitionBy("nb_id").orderBy("ord")) - 1).alias("index"))
    return nodes, e.where("e.group = 'edges'").select("nb_id", F.col("e.data.source").alias("src"), F.col("e.data.target").alias("dst"), F.col("e.data.label").alias("label"))


def to_elements(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(nb_id, payload): a graph as one JSON object of elements, nodes first, each in its order."""
    n = nodes.select("nb_id", F.lit(0).alias("part"), "ord", F.to_json(F.struct(F.struct(F.col("node_id").alias("id"), *(c for c in nodes.columns if c not in ("nb_id", "node_id", "ord"))).alias("data"))).alias("e"))
    e = edges.select("nb_id", F.lit(1).alias("part"), "ord", F.to_json(F.struct(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), *(c for c in edges.columns if c not in ("nb_id", "src", "dst", "ord"))).alias("data"))).alias("e"))
    every = F.transform(F.array_sort(F.collect_list(F.struct("part", "ord", "e"))), lambda x: x["e"])
    return n.unionByName(e).groupBy("nb_id").agg(F.concat(F.lit('{"elements":['), F.array_join(every, ","), F.lit("]}")).alias("payload"))


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A saved graph; an error where a node has no type or an edge no code or type. Missing labels are the node's name."""
    nodes, edges = spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
    node_type = "node_type" if "node_type" in nodes.columns else "struct_type"
    if not nodes.where(F.col(node_type).isNull()).isEmpty():
        raise ValueError("a node has no type")
    if not edges.where("raw_code is null or edge_type is null").isEmpty():
        raise ValueError("an edge has no code or type")
    return nodes.withColumn("label", F.coalesce("label", "node_id")), edges


def combined(**corpora: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(notebooks, annotations) of several corpora, ids prefixed by the corpus, without those that lack their partner."""
    a = b = None
    for name, (notebooks, annotations) in corpora.items():
        key = F.concat(F.lit(f"{name}__"), F.col("nb_id"))
        n, m = notebooks.withColumn("nb_id", key), annotations.withColumn("nb_id", key)
        a, b = (n, m) if a is None else (a.unionByName(n), b.unionByName(m))
    return a.join(b.select("nb_id"), "nb_id", "left_semi"), b.join(a.select("nb_id"), "nb_id", "left_semi")


def folders(spark: SparkSession, path: str) -> DataFrame:
    """(folder, n_notebooks, n_json): folders of a competition dump with what they hold."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    folder, kind = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1), F.regexp_extract("path", r"\.([a-z]+)$", 1)
    return f.groupBy(folder.alias("folder")).agg(F.count_if(kind == "ipynb").alias("n_notebooks"), F.count_if(kind == "json").alias("n_json"))


def registry(found: DataFrame) -> DataFrame:
    """(repo, paths): search results by repository."""
    return found.groupBy("repo").agg(F.array_sort(F.collect_set("path")).alias("paths"))


def pending(notebooks: DataFrame, done: DataFrame) -> DataFrame:
    """Notebooks without a result yet, for a run that goes on."""
    return notebooks.join(done.select("nb_id"), "nb_id", "left_anti")
