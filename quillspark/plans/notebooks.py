"""Queries from source text on: cells whose code is made of the rows of `events`, parsed, bound and related.

A user is a notebook and an event a cell; what a cell's code defines, reads,
opens and relates follows from the template, so that SQL can state it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..ir import build, programs, wir
from ..operators import cells as C
from ..operators import features, graphs, knowledge, leakage, mining
from ..operators.shared import checkpoints
from . import bindings as B
from .registry import query

_ROWS = f"""select user_id as nb_id, 'c' || cast(event_id as string) as cell_id, cast(seq as int) as document_index, cast(case when event_id % 50 = 49 then 10 else event_id % 10 end as int) as k,
  cast(seq as string) as s, cast(greatest(seq - 1, 0) as string) as p, cast(event_id % 3 as string) as f from ({B._EV}) e"""

#: A cell's code by k: loader, method, call, export, function, update, magic line, import, loop, use of a function; cells of k = 10 don't parse.
CODE = f"""
select *, case k when 0 then 'd' || s || ' = pd.read_csv("f' || f || '.csv")' when 1 then 'd' || s || ' = d' || p || '.dropna()' when 2 then 'm' || s || ' = fit(d' || p || ', y)'
  when 3 then 'd' || p || '.to_csv("f' || f || '.csv")' when 4 then 'def g' || s || '(a):' || chr(10) || '    return a + d' || p when 5 then 'd' || s || ' += 1'
  when 6 then '%time d' || s || chr(10) || 'x' || s || ' = 1' when 7 then 'import lib' || f || '.sub as l' || s when 8 then 'for i in d' || p || ':' || chr(10) || '    k' || s || ' = [j for j in i]'
  when 9 then 'w' || s || ' = g' || p || '(y)' || chr(10) || '# note' else 'x = (' end as source from ({_ROWS}) r"""
D_CODE = B.duck(CODE)


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CODE, events=B.table(spark, sf_dir, "events"))


def _per_template(columns: str, rows: list[tuple]) -> str:
    """SQL of a row of values for each cell of each template: (k, values...)."""
    return " union all ".join(f"select nb_id, cell_id, document_index, {', '.join(f'{v} as {c}' for v, c in zip(values, columns.split(), strict=True))} from code where k = {k}" for k, *values in rows)


_DEFS = _per_template("name kind lineno", [(0, "'d' || s", "'assign'", 1), (1, "'d' || s", "'assign'", 1), (2, "'m' || s", "'assign'", 1), (4, "'g' || s", "'function'", 1), (5, "'d' || s", "'assign'", 1), (6, "'x' || s", "'assign'", 2), (7, "'l' || s", "'import'", 1), (8, "'i'", "'assign'", 1), (8, "'k' || s", "'assign'", 2), (9, "'w' || s", "'assign'", 1)])
_USES = _per_template("name lineno deferred via", [(0, "'pd'", 1, "false", "null"), (1, "'d' || p", 1, "false", "null"), (2, "'fit'", 1, "false", "null"), (2, "'d' || p", 1, "false", "null"), (2, "'y'", 1, "false", "null"), (3, "'d' || p", 1, "false", "null"), (4, "'d' || p", 2, "true", "'g' || s"), (8, "'d' || p", 1, "false", "null"), (9, "'g' || p", 1, "false", "null"), (9, "'y'", 1, "false", "null")])
_IO = _per_template("path mode lineno", [(0, "'f' || f || '.csv'", "'read'", 1), (3, "'f' || f || '.csv'", "'write'", 1)])
_WITH = f"with code as ({D_CODE}), defs as ({_DEFS}), uses as ({_USES}), io as ({_IO})"


# -------------------------------------------------------------- source text

@query(f"{_WITH} select cell_id, case when k = 6 then chr(10) || 'x' || s || ' = 1' else source end as clean, case when k = 6 then 'x' || s || ' = 1' else source end as stripped, case when k = 6 then '# ' || source else source end as commented from code")
def source_lines(spark, sf_dir):
    return code(spark, sf_dir).select("cell_id", text.sanitize(F.col("source")).alias("clean"), text.strip_jupyter(F.col("source")).alias("stripped"), text.comment_magics(F.col("source")).alias("commented"))


_HASH = "list_reduce(list_transform(range(0, length(source) + 1), lambda i: case when i = 0 then 5381::bigint else unicode(source[i])::bigint end), lambda a, x: (a * 33 + x) & 4294967295)"


@query(f"{_WITH}, h as (select cell_id, {_HASH} as h from code), g as (select cell_id, case when h >= 2147483648 then h - 4294967296 else h end as h from h) select cell_id, case when h < 0 then '-' else '' end || lower(to_base(abs(h), 36)) as hash from g")
def source_hashes(spark, sf_dir):
    return code(spark, sf_dir).select("cell_id", text.djb2(F.col("source")).alias("hash"))


@query(f"{_WITH} select cell_id from code where k <> 10")
def source_parses(spark, sf_dir):
    return build.parses(code(spark, sf_dir)).select("cell_id")


_TYPES = {"Assign": "0 1 2 6 8 9", "Call": "0 1 2 3 9", "Attribute": "0 1 3", "Name": "0 0 1 1 2 2 2 2 3 4 4 5 6 8 8 8 8 8 8 9 9 9", "FunctionDef": "4", "AugAssign": "5", "Import": "7", "For": "8", "ListComp": "8", "Constant": "0 3 5 6"}
_TYPE_ROWS = " union all ".join(f"select nb_id, '{t}' as type from code where k = {k}" for t, ks in _TYPES.items() for k in ks.split())


@query(f"{_WITH} select nb_id, type, count(*) as n from ({_TYPE_ROWS}) t group by 1, 2")
def source_tree(spark, sf_dir):
    return build.ast_nodes(code(spark, sf_dir)).where(F.col("type").isin(*_TYPES)).groupBy("nb_id", "type").agg(F.count("*").alias("n"))


@query(f"{_WITH} select nb_id, cell_id, 'lib' || f as root, 'lib' || f || '.sub' as module, 'l' || s as alias from code where k = 7")
def source_imports(spark, sf_dir):
    return mining.imports(code(spark, sf_dir).withColumn("source", text.sanitize(F.col("source"))))


@query(f"{_WITH} select nb_id, array_to_string(list_sort(list(distinct 'lib' || f)), ',') as roots, count(*) as n_imports from code where k = 7 group by 1")
def source_import_summary(spark, sf_dir):
    found = mining.imports(code(spark, sf_dir))
    return mining.import_summary(found).select("nb_id", F.array_join("roots", ",").alias("roots"), "n_imports")


@query(f"{_WITH} select nb_id, case when reads > 0 then loops end as loops, case when reads > 0 then loops end as list_comp, case when reads > 0 then 0::bigint end as try_except, case when reads > 0 then 0::bigint end as with_blocks, case when reads > 0 then case when loops > 0 then 2 else 0 end::bigint end as deepest from (select nb_id, count(*) filter (k not in (6, 10)) as reads, count(*) filter (k = 8) as loops from code group by 1)")
def source_complexity(spark, sf_dir):
    return mining.complexity(code(spark, sf_dir)).select("nb_id", "loops", "list_comp", "try_except", "with_blocks", F.col("max_nesting_depth").alias("deepest"))


# ------------------------------------------------------------------ symbols

def _symbols(spark, sf_dir):
    checkpoints(spark)
    c = code(spark, sf_dir)
    return (c, *build.symbols(c, keep=True))  # parsed once for its three tables


@query(f"{_WITH} select nb_id, cell_id, name, kind, lineno from defs")
def symbol_definitions(spark, sf_dir):
    return _symbols(spark, sf_dir)[1]


@query(f"{_WITH} select nb_id, cell_id, name, lineno, deferred, via from uses")
def symbol_uses(spark, sf_dir):
    return _symbols(spark, sf_dir)[2]


_PAIRS = "p as (select u.nb_id, u.cell_id as dst_cell, u.name, d.cell_id as src_cell, d.document_index as si, u.document_index as di from uses u join defs d on u.nb_id = d.nb_id and u.name = d.name and u.cell_id <> d.cell_id where not u.deferred)"


@query(f"{_WITH}, {_PAIRS} select nb_id, src_cell, dst_cell, name, n > 1 as ambiguous, si >= di as out_of_order, 1.0::double / n as confidence from (select *, count(*) over (partition by nb_id, dst_cell, name) as n, row_number() over (partition by nb_id, dst_cell, name order by (si < di) desc, case when si < di then -si else si end) as rn from p) where rn = 1")
def symbol_bindings(spark, sf_dir):
    c, d, u, _ = _symbols(spark, sf_dir)
    return C.symbol_edges(c, d, u).select("nb_id", "src_cell", "dst_cell", "name", "ambiguous", "out_of_order", "confidence")


@query(f"{_WITH} select distinct u.nb_id, u.cell_id, u.name from uses u where not exists (select 1 from defs d where d.nb_id = u.nb_id and d.name = u.name and d.cell_id <> u.cell_id)")
def symbol_undefined(spark, sf_dir):
    return C.undefined(*_symbols(spark, sf_dir)[:3])


@query(f"{_WITH}, t as (select *, lag(cell_id) over w as before, lag(k) over w as bk, lead(cell_id) over w as behind, lead(k) over w as nk from code window w as (partition by nb_id order by document_index)) select nb_id, before as src_cell, case when nk = 9 then behind else cell_id end as dst_cell, 'd' || p as name, case when nk = 9 then 1.0 else 0.7 end::double as confidence from t where k = 4 and bk in (0, 1, 5)")
def symbol_deferred(spark, sf_dir):
    c, d, u, _ = _symbols(spark, sf_dir)
    return C.deferred_edges(c, d, u).select("nb_id", "src_cell", "dst_cell", "name", "confidence")


@query(f"{_WITH} select nb_id, cell_id, path, mode, lineno from io")
def file_accesses(spark, sf_dir):
    return build.file_io(code(spark, sf_dir)).select("nb_id", "cell_id", "path", "mode", "lineno")


@query(f"{_WITH}, w as (select nb_id, path, cell_id, count(*) over (partition by nb_id, path) as n from io where mode = 'write') select w.nb_id, w.cell_id as src_cell, r.cell_id as dst_cell, w.path as name, round(0.6::double / w.n, 9) as confidence from w join io r on r.nb_id = w.nb_id and r.path = w.path and r.mode = 'read'")
def file_artifacts(spark, sf_dir):
    return C.file_edges(build.file_io(code(spark, sf_dir))).select("nb_id", "src_cell", "dst_cell", "name", F.round("confidence", 9).alias("confidence"))


# ----------------------------------------------------------------- dataflow

def _records(spark, sf_dir) -> DataFrame:
    checkpoints(spark)
    return build.parse(code(spark, sf_dir), inline=False, skip_bad=True).checkpoint()


@query(f"{_WITH} select nb_id, cell_id, count(*) as n from code where k in (0, 1, 2, 3, 5, 9) group by 1, 2")
def flow_calls(spark, sf_dir):
    return build.nodes(_records(spark, sf_dir)).where("struct_type = 9").groupBy("nb_id", "cell_id").agg(F.count("*").alias("n"))


@query(f"{_WITH} select nb_id, cell_id, count(*) as n from code where k in (0, 1, 2, 3, 5, 9) group by 1, 2")
def flow_outputs(spark, sf_dir):
    r = _records(spark, sf_dir)
    calls = build.nodes(r).where("struct_type = 9").select("nb_id", F.col("node_id").alias("src"))
    return build.edges(r).where("edge_type = 2").join(calls, ["nb_id", "src"], "left_semi").groupBy("nb_id", "cell_id").agg(F.count("*").alias("n"))


@query(f"{_WITH} select nb_id, cell_id, case k when 3 then 'f' || f || '.csv' when 0 then 'f' || f || '.csv' else '1' end as literal from code where k in (0, 3, 5, 6)")
def flow_literals(spark, sf_dir):
    return build.nodes(_records(spark, sf_dir)).where("struct_type = 8").select("nb_id", "cell_id", F.col("code").alias("literal"))


_OWN = "select *, lag(cell_id) over w as before, lag(k) over w as bk from code window w as (partition by nb_id order by document_index)"


# a statement that calls a method of d0 leaves a version of it, which the second cell (it also names d0) takes up
@query(f"{_WITH}, t as ({_OWN}) select nb_id, before as src_cell, cell_id as dst_cell, 'd' || p || ' ' || before || ' 1' as name from t where k in (1, 2, 3, 8) and (bk in (0, 1, 5) or (document_index = 1 and bk = 3))")
def flow_cross_cells(spark, sf_dir):
    r, c = _records(spark, sf_dir), code(spark, sf_dir)
    found = C.cross_cell_index(build.nodes(r), build.edges(r), c).where("def_node rlike '^d[0-9]+_' and edge_type in (0, 1)")
    # variable, cell and line: a label has the last two only where the cell's id is not of 8 characters
    name = F.concat_ws(" ", F.substring_index("def_node", "_", 1), "src_cell", F.col("def_lineno").cast("string"))
    return found.select("nb_id", "src_cell", "dst_cell", name.alias("name"))


@query(f"{_WITH}, n as (select nb_id, not bool_or(k = 10) as success, cast(sum(case when k in (4, 6, 8, 9) then 2 else 1 end) as bigint) as lines_of_code, coalesce(array_to_string(list_sort(list(distinct 'lib' || f) filter (where k = 7 and f <> '1')), ','), '') as libraries from code group by 1) select nb_id, success, case when not success then 'SyntaxError' end as error_type, lines_of_code, false as contains_ml_semantics, libraries from n")
def mining_validate(spark, sf_dir):
    got = mining.validate(code(spark, sf_dir), ["LIB0", "lib2", "numpy"])
    return got.select("nb_id", "success", "error_type", "lines_of_code", "contains_ml_semantics", F.array_join("matched_libraries", ",").alias("libraries"))


def _store(spark, sf_dir) -> tuple[str, int]:
    """A store of the users' notebooks in the shared folder, in two parts, and how many places it has."""
    import uuid

    from ..sources import store

    checkpoints(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/store-{uuid.uuid4().hex}"
    c = code(spark, sf_dir)
    for part in (0, 1):
        store.add(c.where(F.pmod("nb_id", F.lit(2)) == part), path, part)
    return path, len(store.names(path))


@query(f"{_WITH} select nb_id, cell_id, cast(row_number() over (partition by nb_id order by document_index) - 1 as integer) as document_index, source from code")
def source_store(spark, sf_dir):
    from ..sources import notebooks, store

    path, size = _store(spark, sf_dir)
    # in two reads, the second from where the first ends
    half = size // 2
    raw = store.load(spark, path, end=half).unionByName(store.load(spark, path, start=half)).where("error is null")
    cells = notebooks.cells_of(raw.select(F.get_json_object("content", "$.name").cast("long").alias("nb_id"), F.col("content").alias("value")))
    return cells.select("nb_id", "cell_id", "document_index", "source")


@query(f"{_WITH}, n as (select nb_id, not bool_or(k = 10) as success, cast(sum(case when k in (4, 6, 8, 9) then 2 else 1 end) as bigint) as loc, coalesce(array_to_string(list_sort(list(distinct 'lib' || f) filter (where k = 7 and f <> '1')), ','), '') as libraries from code group by 1) select success, case when not success then 'SyntaxError' end as error_type, loc, false as ml_semantics, libraries, count(*) as notebooks from n group by all")
def mining_ledger(spark, sf_dir):
    from ..operators import ledger
    from ..sources import store

    path, size = _store(spark, sf_dir)
    book = ledger.Ledger(spark, f"{path}-ledger")
    judge = lambda notebooks: ledger.entries(notebooks, ["LIB0", "lib2", "numpy"])
    ledger.mine(lambda a, b: store.load(spark, path, start=a, end=b, tasks=spark.sparkContext.defaultParallelism), size, judge, book, step=max(1, -(-size // 3)))
    return book.rows().groupBy("success", "error_type", "loc", "ml_semantics", F.array_join("matched_libraries", ",").alias("libraries")).agg(F.count("*").alias("notebooks"))


#: A user's notebook is one of the seeded programs.
_SEEDED = "select distinct user_id as nb_id, cast(user_id % 24 as int) as kind from {events}"


@query(f"select nb_id, leakage_class from (select nb_id, case kind % 6 {' '.join(f'when {i} then {d!r}' for i, d in enumerate(programs.DEFECTS))} end as leakage_class from ({B.duck(_SEEDED)}) s) where leakage_class <> 'clean'")
def leakage_seeded(spark, sf_dir):
    checkpoints(spark)
    kinds = [(s, d) for s in programs.STACKS for d in programs.DEFECTS]
    sources = spark.createDataFrame([(i, programs.program(s, d)) for i, (s, d) in enumerate(kinds)], "kind int, source string")
    users = spark.sql(_SEEDED, events=B.table(spark, sf_dir, "events"))
    corpus = users.join(F.broadcast(sources), "kind").select("nb_id", F.lpad(F.col("nb_id").cast("string"), 8, "0").alias("cell_id"), F.lit(0).alias("document_index"), "source")
    records = build.parse(corpus).checkpoint()
    nodes = build.nodes(records).withColumn("node_type", F.col("struct_type"))
    return leakage.findings(nodes, build.edges(records)).select("nb_id", "leakage_class").distinct()


# -------------------------------------------------------- process relations

def _relations(spark, sf_dir) -> DataFrame:
    prs = wir.process_relations(code(spark, sf_dir).select(F.col("cell_id").alias("nb_id"), "source"))
    bare = lambda c: F.regexp_replace(c, "^([^:]*):.*$", "$1")
    return prs.select("nb_id", *(bare(F.col(c)).alias(c) for c in ("input", "caller", "op", "output")))


_PRS = _per_template(
    "input caller op output",
    [(0, "'f' || f || '.csv'", "'pd'", "'read_csv'", "'d' || s"), (1, "null", "'d' || p", "'dropna'", "'d' || s"), (2, "'d' || p", "null", "'fit'", "'m' || s"), (2, "'y'", "null", "'fit'", "'m' || s"), (3, "'f' || f || '.csv'", "'d' || p", "'to_csv'", "'to_csv'"), (7, "'lib' || f || '.sub'", "null", "'ImportAs'", "'l' || s"), (8, "'d' || p", "null", "'For'", "'i'"), (9, "'y'", "null", "'g' || p", "'w' || s")],
)


@query(f"{_WITH}, pr as ({_PRS}) select cell_id as nb_id, input, caller, op, output from pr")
def process_relations(spark, sf_dir):
    return _relations(spark, sf_dir)


@query(f"{_WITH}, pr as ({_PRS}) select distinct cell_id as nb_id, input as src, op as dst, 1 as edge_type from pr where input is not null union select cell_id, caller, op, 0 from pr where caller is not null union select cell_id, op, output, 2 from pr")
def process_edges(spark, sf_dir):
    return wir.edges(_relations(spark, sf_dir))


# ------------------------------------------------------ spans, flags, draws

_SPANS = "select l_orderkey as nb_id, 'p' || cast(l_partkey as string) || ':' || cast(l_linenumber as string) || ':' || cast(l_orderkey as string) as ask_id, case when l_linenumber % 2 = 0 then l_linenumber * 1000.0 end as s, case when l_linenumber % 2 = 0 then l_linenumber * 1000.0 + 500 end as e, 'p' || cast(l_partkey as string) as code, l_linenumber as ord from {lineitem}"
_D_SPANS = _SPANS.format(lineitem="lineitem")


@query(f"with a as ({_D_SPANS}), g as (select nb_id, 'g' || ask_id as gold_id, s + 300 as s, e + 300 as e, code, ord from a where ord in (1, 2, 3)), o as (select a.ask_id, g.gold_id, g.ord, case when g.s < a.e and a.s < g.e and 5 * (least(a.e, g.e) - greatest(a.s, g.s)) >= 2.5 * 500 then 1 when g.code = a.code then 2 end as way from a join g on g.nb_id = a.nb_id) select ask_id, gold_id from (select *, row_number() over (partition by ask_id order by way, ord) as rn from o where way is not null) where rn = 1")
def kb_match_nodes(spark, sf_dir):
    """Spans of gold nodes lie 300 of 500 places off, so that names decide."""
    a = spark.sql(_SPANS, lineitem=B.table(spark, sf_dir, "lineitem"))
    gold = a.where("ord in (1, 2, 3)").select("nb_id", F.concat(F.lit("g"), "ask_id").alias("gold_id"), (F.col("s") + 300).alias("s"), (F.col("e") + 300).alias("e"), "code", "ord")
    return knowledge.match_nodes(a, gold)


@query("select case when o_orderkey % 3 = 0 then 'needs_review' else 'not_relevant' end as flag, count(*) as n from orders where o_orderkey % 7 <> 1 and (o_orderkey % 3 = 0 or o_orderkey % 2 = 0) group by 1")
def mining_flags(spark, sf_dir):
    o = B.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("notebook"))
    old = o.where("notebook % 2 = 0").withColumn("flag", F.lit("not_relevant"))
    new = o.where("notebook % 3 = 0").select("notebook", F.lit("needs_review").alias("flag"), F.lit(1).alias("ord"))
    gone = o.where("notebook % 7 = 1").select("notebook", F.lit(None).cast("string").alias("flag"), F.lit(2).alias("ord"))
    return mining.flag(old, new.unionByName(gone)).groupBy("flag").agg(F.count("*").alias("n"))


@query(f"{B.D_GRAPH} select 0::bigint as real, 0::bigint as loops, true as enough")
def feature_negative_edges(spark, sf_dir):
    """Of the drawn pairs: how many are edges, how many are loops, whether nine edges in ten have one."""
    n, e = B.graph(spark, sf_dir)
    drawn = features.negative_edges(n, e)
    real = drawn.join(e.select("nb_id", "src", "dst").distinct().withColumn("r", F.lit(1)), ["nb_id", "src", "dst"], "left")
    got = real.agg(F.count("r").alias("real"), F.count_if(F.col("src") == F.col("dst")).alias("loops"), F.count("*").alias("n"))
    return got.crossJoin(e.agg(F.count("*").alias("m"))).select("real", "loops", (F.col("n") >= 0.9 * F.col("m")).alias("enough"))


# -------------------------------------------------------------- large graphs

@query(f"{B.D_GRAPH}, f as (select nb_id, node_id as seed, node_id as node, 0 as depth from nodes where struct_type = 1 union select f.nb_id, f.seed, e.dst, f.depth + 1 from f join edges e on e.nb_id = f.nb_id and e.src = f.node) select nb_id, seed, node, min(depth) as depth from f group by 1, 2, 3")
def graph_frontier(spark, sf_dir):
    """Depths from sign-ups on: the way for graphs without a bound on their size."""
    checkpoints(spark)
    n, e = B.graph(spark, sf_dir)
    return graphs.closure_frontier(e, n.where("struct_type = 1"))
