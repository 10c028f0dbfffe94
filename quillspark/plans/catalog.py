"""Every registered query of the reference's operators over the driver's tables, with the SQL that DuckDB answers it by."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import cells as C
from ..operators import features, graphs, knowledge, leakage, lineage, metrics, mining, node_walks, refine
from ..operators import trace as T
from . import bindings as B
from . import notebooks  # noqa: F401, registers its queries
from .registry import ORACLE, QUERIES, query

__all__ = ["ORACLE", "QUERIES"]

def _checkpoints(df) -> None:
    from ..operators.shared import checkpoints

    checkpoints(df.sparkSession)


def on_graph(name: str, make, sql: str | None = None) -> None:
    """A query of make(nodes, edges)."""
    f = lambda spark, sf_dir: make(*B.graph(spark, sf_dir))
    f.__name__ = name
    query(f"{B.D_GRAPH} {sql}" if sql else None)(f)


# ------------------------------------------------------------------- traces

@query(f"select nb_id, seq, cell_id, case when b is null then 'first' when b = source_hash then 'identical' else 'edited' end as rerun_kind from (select *, lag(source_hash) over (partition by nb_id, cell_id order by seq) as b from ({B.D_TRACE}))")
def trace_rerun_kind(spark, sf_dir):
    return T.rerun_kinds(B.trace(spark, sf_dir)[0]).select("nb_id", "seq", "cell_id", "rerun_kind")


@query(f"select nb_id, cell_id, max(seq) as last_seq, cast(row_number() over (partition by nb_id order by max(seq)) - 1 as bigint) as rank from ({B.D_TRACE}) group by 1, 2")
def trace_observed_order(spark, sf_dir):
    return T.observed_order(B.trace(spark, sf_dir)[0]).select("nb_id", "cell_id", "last_seq", F.col("rank").cast("long").alias("rank"))


@query(f"select nb_id, seq, document_index < coalesce(max(document_index) over (partition by nb_id order by seq rows between unbounded preceding and 1 preceding), -1) as out_of_doc_order from ({B.D_TRACE})")
def trace_out_of_order(spark, sf_dir):
    return T.out_of_order(B.trace(spark, sf_dir)[0]).select("nb_id", "seq", "out_of_doc_order")


@query(f"with t as ({B.D_TRACE}), l as ({B.D_LINKS}) select t.nb_id, t.seq, coalesce(array_to_string(list_sort(list(distinct l.name) filter (where l.name is not null and not exists (select 1 from t p where p.nb_id = t.nb_id and p.cell_id = l.src_cell and p.seq < t.seq))), ','), '') as stale from t left join l on t.nb_id = l.nb_id and t.cell_id = l.dst_cell group by 1, 2")
def trace_stale_inputs(spark, sf_dir):
    return T.stale_inputs(*B.trace(spark, sf_dir)).select("nb_id", "seq", F.array_join("stale_input_names", ",").alias("stale"))


@query(f"with t as (select nb_id, cell_id, max(seq) as q from ({B.D_TRACE}) group by 1, 2), l as ({B.D_LINKS}) select l.nb_id, l.src_cell, l.dst_cell, l.name, case when s.q is null then 'missing-upstream' else 'reversed' end as violation from l join t d on l.nb_id = d.nb_id and l.dst_cell = d.cell_id left join t s on l.nb_id = s.nb_id and l.src_cell = s.cell_id where s.q is null or s.q > d.q")
def trace_violations(spark, sf_dir):
    return T.violations(*B.trace(spark, sf_dir)).drop("session_id")


@query(f"with o as (select nb_id, cell_id, min(document_index) as d, max(seq) as q from ({B.D_TRACE}) group by 1, 2) select u.nb_id, t.tau from (select distinct nb_id from o) u left join (select x.nb_id, avg(case when x.d < y.d then 1.0 else -1.0 end) as tau from o x join o y on x.nb_id = y.nb_id and x.q < y.q group by 1) t using (nb_id)")
def trace_kendall_tau(spark, sf_dir):
    ev, _ = B.trace(spark, sf_dir)
    a = T.observed_order(ev).select("nb_id", "session_id", F.col("cell_id").alias("item"), "rank")
    b = ev.groupBy("nb_id", "session_id", F.col("cell_id").alias("item")).agg(F.min("document_index").alias("rank"))
    return T.kendall_tau(a, b).select("nb_id", "tau")


def _trace_cells(ev):
    """Current cells: all event types but errors; every third user's last source was changed."""
    c = ev.select("nb_id", "cell_id", "document_index").distinct().where("cell_id <> 'error'")
    return c.withColumn("source", F.concat("cell_id", F.lit(""))).withColumn("is_dirty", (F.col("nb_id") + F.col("document_index")) % 4 == 0)


@query(f"with t as ({B.D_TRACE}), c as (select distinct nb_id, cell_id, (nb_id + document_index) % 4 = 0 as dirty from t where cell_id <> 'error'), own as (select nb_id, cell_id, case when dirty then 'edited' else 'fresh' end as f from c), l as ({B.D_LINKS}), recur as (select nb_id, src_cell as s, dst_cell as d from l union select x.nb_id, x.src_cell, y.dst_cell from l x join l y on x.nb_id = y.nb_id and x.dst_cell = y.src_cell union select x.nb_id, x.src_cell, z.dst_cell from l x join l y on x.nb_id = y.nb_id and x.dst_cell = y.src_cell join l z on y.nb_id = z.nb_id and y.dst_cell = z.src_cell) select own.nb_id, own.cell_id, case when f = 'fresh' and exists (select 1 from recur r join own a on r.nb_id = a.nb_id and r.s = a.cell_id where r.nb_id = own.nb_id and r.d = own.cell_id and a.f <> 'fresh') then 'stale-input' else f end as freshness from own")
def trace_freshness(spark, sf_dir):
    ev, links = B.trace(spark, sf_dir)
    last = ev.groupBy("nb_id", "cell_id").agg(F.max_by("source_hash", "seq").alias("now"))
    c = _trace_cells(ev).join(last, ["nb_id", "cell_id"])
    return T.freshness(ev, c, links, F.col("now"))


@query(f"with t as ({B.D_TRACE}) select nb_id, cell_id, 'msg' as defined_names, 'msg' as names from t where cell_id = 'error' group by 1, 2")
def trace_deleted_reads(spark, sf_dir):
    ev, _ = B.trace(spark, sf_dir)
    defined = ev.select("nb_id", "source_hash").distinct().withColumn("name", F.lit("msg"))
    undefined = ev.select("nb_id").distinct().withColumn("name", F.lit("msg"))
    got = T.deleted_reads(ev, _trace_cells(ev), defined, undefined)
    return got.select("nb_id", "cell_id", F.array_join("defined_names", ",").alias("defined_names"), F.array_join("names", ",").alias("names"))


@query("select user_id as nb_id, event_id, sum(case when event_type = 'signup' or lag_kernel <> kernel or (n = 1 and lag_n > 1) then 1 else 0 end) over (partition by user_id order by seq) as session_no from (select *, lag(kernel) over w as lag_kernel, lag(n) over w as lag_n from (select user_id, event_id, event_type, row_number() over (partition by user_id order by ts, event_id) as seq, event_id % 2 as kernel, cast(floor(value) as bigint) % 4 as n from events) window w as (partition by user_id order by seq))")
def trace_sessions(spark, sf_dir):
    ev = spark.sql("select user_id as nb_id, event_id, event_type = 'signup' as restart, row_number() over (partition by user_id order by ts, event_id) as seq, event_id % 2 as kernel_id, cast(floor(value) as bigint) % 4 as execution_count from {e}", e=B.table(spark, sf_dir, "events"))
    return T.sessionize(ev).select("nb_id", "event_id", "session_no")


_STREAM = """select user_id as nb_id, event_id as seq, event_type as cell_id, cast(case event_type when 'signup' then 0 when 'view' then 1 when 'click' then 2 when 'purchase' then 3 else 4 end as int) as document_index, cast(cast(floor(value) as bigint) % 4 as int) as execution_count, cast(event_id % 2 as string) as kernel_id, event_type = 'signup' as restart, md5(props) as source_hash, cast(ts as timestamp) as ts from {events}"""


@query(f"""with e as ({B.duck(_STREAM)}), b as (select *, lag(seq) over w is not null and (restart or kernel_id <> lag(kernel_id) over w or (execution_count = 1 and lag(execution_count) over w > 1) or epoch_ms(ts) - epoch_ms(lag(ts) over w) > 21600000) as fresh from e window w as (partition by nb_id order by seq)),
s as (select *, cast(sum(cast(fresh as int)) over (partition by nb_id order by seq) as bigint) as session_no from b)
select nb_id, seq, session_no, case when h is null then 'first' when h = source_hash then 'identical' else 'edited' end as rerun_kind, coalesce(most > document_index, false) as out_of_doc_order
from (select *, lag(source_hash) over (partition by nb_id, session_no, cell_id order by seq) as h, max(document_index) over (partition by nb_id, session_no order by seq rows between unbounded preceding and 1 preceding) as most from s)""")
def stream_sessions(spark, sf_dir):
    """The whole table as a stream of one batch, through state."""
    import uuid

    from ..streaming import trace as S

    _checkpoints(B.table(spark, sf_dir, "events"))
    place = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"
    events = spark.readStream.schema(B.table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    provider, rocks = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, rocks)
    try:
        live = S.live(spark.sql(_STREAM, events=events), idle_ms=6 * 3600_000)
        live.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/ck").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before) if before else spark.conf.unset(provider)
    return spark.read.parquet(f"{place}/out").where("kind = 'event'").select("nb_id", "seq", "session_no", "rerun_kind", "out_of_doc_order")


# ------------------------------------------------------------------- graphs

on_graph("graph_closure", lambda n, e: graphs.closure(e), "select nb_id, src, dst from r")
on_graph("graph_degrees", lambda n, e: graphs.degrees(n, e).select("nb_id", "node_id", "in_degree", "out_degree"), "select nb_id, node_id, (select count(*) from edges e where e.nb_id = n.nb_id and e.dst = n.node_id) as in_degree, (select count(*) from edges e where e.nb_id = n.nb_id and e.src = n.node_id) as out_degree from nodes n")
on_graph("graph_drop_isolated", lambda n, e: graphs.drop_isolated(n, e).select("nb_id", "node_id"), "select nb_id, node_id from nodes n where exists (select 1 from edges e where e.nb_id = n.nb_id and (e.src = n.node_id or e.dst = n.node_id))")
on_graph("graph_drop_redundant", lambda n, e: graphs.drop_redundant(e).select("nb_id", "ord"), "select nb_id, ord from (select *, count(*) over (partition by nb_id, src, dst) as c from edges) where not (c > 1 and edge_type = 1 and contains(lower(src), label))")
on_graph("graph_drop_import_ends", lambda n, e: graphs.drop_import_ends(n, e).select("nb_id", "node_id"), "select nb_id, node_id from nodes n where not ((select count(*) from edges e where e.nb_id = n.nb_id and e.src = n.node_id) = 0 and (select count(*) from edges e where e.nb_id = n.nb_id and e.dst = n.node_id) = 1 and exists (select 1 from edges e join nodes p on p.nb_id = e.nb_id and p.node_id = e.src where e.nb_id = n.nb_id and e.dst = n.node_id and p.struct_type = 1))")
_WEAK = ", b as (select nb_id, src as a, dst as z from edges union select nb_id, dst, src from edges), w as (select nb_id, node_id as a, node_id as z from nodes union select w.nb_id, w.a, b.z from w join b on w.nb_id = b.nb_id and w.z = b.a)"
on_graph("graph_components", graphs.weak_components, f"{_WEAK} select nb_id, a as node_id, min(z) as component from w group by 1, 2")
on_graph("graph_labelled_components", lambda n, e: graphs.labelled_components(n, e, F.col("predicted_label") == 1).select("nb_id", "node_id"), f"{_WEAK} select distinct w.nb_id, w.a as node_id from w join edges e on e.nb_id = w.nb_id and e.src = w.z and e.predicted_label = 1")
on_graph(
    "graph_rewire",
    lambda n, e: graphs.rewire(e, n.where("event_id % 4 = 0").select("nb_id", "node_id")),
    ", g as (select nb_id, node_id from nodes where event_id % 4 = 0), i as (select nb_id, node_id as a, node_id as z from g union select i.nb_id, i.a, e.dst from i join edges e on e.nb_id = i.nb_id and e.src = i.z join g on g.nb_id = e.nb_id and g.node_id = e.dst) select distinct i.nb_id, p.src, s.dst from i join edges p on p.nb_id = i.nb_id and p.dst = i.a join edges s on s.nb_id = i.nb_id and s.src = i.z where not exists (select 1 from g where g.nb_id = p.nb_id and g.node_id = p.src) and not exists (select 1 from g where g.nb_id = s.nb_id and g.node_id = s.dst)",
)
on_graph(
    "graph_spread_types",
    lambda n, e: graphs.spread_types(n, e).select("nb_id", "node_id", "struct_type"),
    ", s as (select distinct e.nb_id, e.dst as node_id from edges e where predicted_label = 1), t as (select * from s union select t.nb_id, e.dst from t join edges e on e.nb_id = t.nb_id and e.src = t.node_id and e.predicted_label = 2) select n.nb_id, n.node_id, case when t.node_id is null then n.struct_type else 2 end as struct_type from nodes n left join t on t.nb_id = n.nb_id and t.node_id = n.node_id",
)
on_graph(
    "graph_prune",
    lambda n, e: graphs.prune(n, e, (9,)).select("nb_id", "node_id"),
    ", k as (select nb_id, node_id from nodes where struct_type = 9 union select r.nb_id, r.src from r join nodes n on n.nb_id = r.nb_id and n.node_id = r.dst and n.struct_type = 9) select distinct k.nb_id, k.node_id from k join edges e on e.nb_id = k.nb_id and k.node_id in (e.src, e.dst) join k o on o.nb_id = e.nb_id and o.node_id = case when e.src = k.node_id then e.dst else e.src end",
)
on_graph("graph_ego", lambda n, e: graphs.ego(e, n.where("event_id % 20 = 0"), 2), f"{_WEAK.split(', w as')[0]}, c as (select nb_id, node_id from nodes where event_id % 20 = 0) select nb_id, node_id as centre, node_id from c union select c.nb_id, c.node_id, b.z from c join b on b.nb_id = c.nb_id and b.a = c.node_id union select c.nb_id, c.node_id, y.z from c join b x on x.nb_id = c.nb_id and x.a = c.node_id join b y on y.nb_id = c.nb_id and y.a = x.z")
on_graph("graph_around_variable", lambda n, e: graphs.around_variable(e, n.where("struct_type = 0")), ", s as (select nb_id, node_id from nodes where struct_type = 0) select nb_id, node_id as seed, node_id from s union select r.nb_id, r.src, r.dst from r join s on s.nb_id = r.nb_id and s.node_id = r.src union select r.nb_id, r.dst, r.src from r join s on s.nb_id = r.nb_id and s.node_id = r.dst")
on_graph("graph_to_simple", lambda n, e: graphs.to_simple(e).select("nb_id", "src", "dst", "ord"), "select nb_id, case when i > 1 then dst || '_intermediate_' || (i - 1) else src end as src, case when i < c then dst || '_intermediate_' || i else dst end as dst, ord from (select *, row_number() over (partition by nb_id, src, dst order by ord) as i, count(*) over (partition by nb_id, src, dst) as c from edges)")
#: Node by node in their order: edges go forwards here, so that one sweep is all.
_HISTORY = """, m as (select *, row_number() over (partition by nb_id order by ord) as i from nodes), pe as (select nb_id, src, dst, min(ord) as o from edges group by 1, 2, 3),
ps as (select d.nb_id, d.i, list({'j': s.i, 'lib': case when s.struct_type = 1 then s.label end, 'step': case when s.struct_type in (3, 6, 9) and d.struct_type not in (3, 6, 9) then s.label || '>' || d.label || '>' || s.code end} order by o) as ps from pe join m s on s.nb_id = pe.nb_id and s.node_id = pe.src join m d on d.nb_id = pe.nb_id and d.node_id = pe.dst group by 1, 2),
w as (select distinct nb_id, cast(0 as bigint) as i, cast([] as varchar[][]) as h, cast([] as varchar[][]) as l from m
  union all select m.nb_id, m.i,
    list_append(h, list_reduce(list_prepend(cast([] as varchar[]), list_transform(coalesce(flatten(list_transform(ps, lambda p: list_concat(h[p.j], case when p.step is null then cast([] as varchar[]) else [p.step] end))), []), lambda x: [x])), lambda a, x: case when list_contains(a, x[1]) then a else list_concat(a, x) end)),
    list_append(l, coalesce(list_sort(list_distinct(flatten(list_transform(ps, lambda p: list_concat(l[p.j], case when p.lib is null then cast([] as varchar[]) else [p.lib] end))))), cast([] as varchar[])))
  from w join m on m.nb_id = w.nb_id and m.i = w.i + 1 left join ps on ps.nb_id = m.nb_id and ps.i = m.i)
select m.nb_id, m.node_id, case when len(w.l[m.i]) > 0 then array_to_string(w.l[m.i], ', ') end as base_inputs, array_to_string(w.h[m.i], ';') as history from m join w on w.nb_id = m.nb_id and w.i = m.i"""
_listed = lambda: F.array_join(F.transform("transform_history", lambda s: F.concat_ws(">", s["operation"], s["target_node"], s["transform_code"])), ";").alias("history")
on_graph("graph_provenance", lambda n, e: graphs.provenance(n, e).select("nb_id", "node_id", "base_inputs", _listed()), _HISTORY)
on_graph("graph_context", lambda n, e: graphs.context(n, e).select("nb_id", "node_id", *(F.coalesce(F.array_join(c, ","), F.lit("")).alias(c) for c in ("inputs", "libraries", "outputs"))))

# ----------------------------------------------------------------- features

on_graph("feature_cell_positions", lambda n, e: features.cell_positions(n), "select nb_id, cell_id, (row_number() over (partition by nb_id order by o, cell_id) - 1) / greatest(count(*) over (partition by nb_id) - 1, 1) as position from (select nb_id, cell_id, min(ord) as o from nodes group by 1, 2)")
_NEIGHBOURS = "select n.nb_id, n.node_id, count(*) filter (where p.struct_type = 0) as n_variables, count(*) filter (where p.struct_type = 8) as n_literals, coalesce(bool_or(p.struct_type = 8 and regexp_matches(p.code, '\\.csv')), false) as path_literal from nodes n left join d on d.nb_id = n.nb_id and d.dst = n.node_id left join nodes p on p.nb_id = d.nb_id and p.node_id = d.src where n.struct_type = 9 group by 1, 2"
on_graph("feature_neighbours", features.neighbours, f", d as (select distinct nb_id, src, dst from edges) {_NEIGHBOURS}")
_LOADERS = ", s as (select n.nb_id, n.node_id from nodes n join edges e on e.nb_id = n.nb_id and e.dst = n.node_id join nodes p on p.nb_id = e.nb_id and p.node_id = e.src where n.struct_type = 9 group by 1, 2 having bool_or(p.struct_type = 8 and contains(p.code, '.csv')) and not bool_or(p.struct_type = 0))"
_HOPS = ", h as (select nb_id, node_id, cast(0 as bigint) as d from s union select h.nb_id, e.dst, h.d + 1 from h join edges e on e.nb_id = h.nb_id and e.src = h.node_id)"
_SOURCES = "select n.nb_id, n.node_id, m.d is not null as from_source, (select count(*) from s join r on r.nb_id = s.nb_id and r.src = s.node_id where s.nb_id = n.nb_id and r.dst = n.node_id and r.src <> r.dst) as n_sources, coalesce(m.d, 0) as depth from nodes n left join (select nb_id, node_id, min(d) as d from h group by 1, 2) m on m.nb_id = n.nb_id and m.node_id = n.node_id"
on_graph("feature_source_reach", features.source_reach, f"{_LOADERS}{_HOPS} {_SOURCES}")
_ANCHORS = ", l as (select nb_id, node_id from nodes where struct_type = 9 and event_id % 8 = 0), m as (select nb_id, node_id from nodes where struct_type = 9 and event_id % 8 in (1, 2))"
_SEMANTIC = "select n.nb_id, n.node_id, exists (select 1 from l where l.nb_id = n.nb_id and l.node_id = n.node_id) or exists (select 1 from r join l on l.nb_id = r.nb_id and l.node_id = r.src where r.nb_id = n.nb_id and r.dst = n.node_id) as from_load, exists (select 1 from m where m.nb_id = n.nb_id and m.node_id = n.node_id) or exists (select 1 from r join m on m.nb_id = r.nb_id and m.node_id = r.dst where r.nb_id = n.nb_id and r.src = n.node_id) as to_model from nodes n"
on_graph("feature_semantic_reach", features.semantic_reach, f"{_ANCHORS} {_SEMANTIC}")
_FAMILIES = "select nb_id, node_id, cast(event_id % 8 = 0 or label = 'pandas' or contains(label, 'csv') or event_id % 8 = 3 as int) as lib_data_io, 0 as lib_ml_classic, 0 as lib_deep_learning, cast(event_id % 8 = 6 as int) as lib_viz, 0 as lib_persistence, 0 as lib_sys_env from nodes"
on_graph("feature_families", lambda n, e: n.select("nb_id", "node_id", *features.families(F.concat_ws(" ", "label", "code"))), _FAMILIES)
#: No node is a sink by name in these graphs: a walk through CALL nodes meets a variable or nothing.
_STRUCTURE = f"""{_LOADERS}{_HOPS}, src as ({_SOURCES}), d as (select distinct nb_id, src, dst from edges), nbr as ({_NEIGHBOURS}),
tw as (select a.nb_id, a.src as node_id, count(*) as reuse, count(*) filter (where k.struct_type = 9) as ops from edges a join edges b on a.nb_id = b.nb_id and a.dst = b.src join nodes k on k.nb_id = b.nb_id and k.node_id = b.dst group by 1, 2),
ca as (select e.nb_id, e.src as node_id, e.dst, k.struct_type from edges e join nodes c on c.nb_id = e.nb_id and c.node_id = e.src and c.struct_type = 9 join nodes k on k.nb_id = e.nb_id and k.node_id = e.dst
  union select ca.nb_id, ca.node_id, e.dst, k.struct_type from ca join edges e on e.nb_id = ca.nb_id and e.src = ca.dst join nodes k on k.nb_id = e.nb_id and k.node_id = e.dst where ca.struct_type = 9),
va as (select distinct nb_id, node_id from ca where struct_type = 0), oe as (select distinct nb_id, src as node_id from edges),
st as (select nbr.nb_id, nbr.node_id, case when oe.node_id is null then 1.0::double else 0 end as is_sink, least(coalesce(ops, 0) / 5::double, 1) as n_successor_ops, case when n_variables = 0 then 1.0::double else 0 end as is_source, path_literal::int::double as path_literal_input,
  case when n_variables = 0 and path_literal then 1.0::double else 0 end as struct_loader, from_source::int::double as from_data_source, least(n_sources / 3::double, 1) as n_source_ancestors, least(depth / 8::double, 1) as depth_from_source, least(coalesce(reuse, 0) / 5::double, 1) as output_reuse, case when va.node_id is null then 0.5::double else 1 end as in_assign
  from nbr left join oe using (nb_id, node_id) left join tw using (nb_id, node_id) left join src using (nb_id, node_id) left join va using (nb_id, node_id))"""
on_graph("feature_structure", features.structure, f"{_STRUCTURE} select * from st")
_PLAIN = "degree cell_pos neighbor lib_category lineage_struct semantic_anchor".split()
on_graph(
    "feature_vectors",
    lambda n, e: features.assemble(n, e, _PLAIN).select("nb_id", "node_id", F.posexplode("features").alias("dim", "value")).select("nb_id", "node_id", F.col("dim").cast("long").alias("dim"), F.round("value", 9).alias("value")),
    f"""{_STRUCTURE}{_ANCHORS}, se as ({_SEMANTIC}), fa as ({_FAMILIES}), cp as (select nb_id, cell_id, (row_number() over (partition by nb_id order by o, cell_id) - 1) / greatest(count(*) over (partition by nb_id) - 1, 1) as pos from (select nb_id, cell_id, min(ord) as o from nodes group by 1, 2)),
ind as (select nb_id, dst as node_id, count(*) as n from edges group by 1, 2), outd as (select nb_id, src as node_id, count(*) as n from edges group by 1, 2),
x as (select n.nb_id, n.node_id, [coalesce(ind.n, 0)::double, coalesce(outd.n, 0), cp.pos, nbr.n_variables, nbr.n_literals, fa.lib_data_io, fa.lib_ml_classic, fa.lib_deep_learning, fa.lib_viz, fa.lib_persistence, fa.lib_sys_env, {', '.join('st.' + c for c in features.STRUCTURE)}, se.from_load::int, se.to_model::int, (n.event_id % 8 = 1)::int] as v
  from nodes n join nbr using (nb_id, node_id) join st using (nb_id, node_id) join fa using (nb_id, node_id) join se using (nb_id, node_id) join cp on cp.nb_id = n.nb_id and cp.cell_id = n.cell_id left join ind on ind.nb_id = n.nb_id and ind.node_id = n.node_id left join outd on outd.nb_id = n.nb_id and outd.node_id = n.node_id)
select nb_id, node_id, unnest(range(24)) as dim, round(unnest(v), 9) as value from x""",
)
#: Thirty rounds of PageRank, each a row for every node; triangles of pairs by how many edges they have.
_CENTRAL = """, d as (select distinct nb_id, src, dst from edges), sz as (select nb_id, count(*) as n from nodes group by 1), o as (select nb_id, src, count(*) as o from d group by 1, 2),
t as (select d.nb_id, d.src, d.dst, 1.0::double / o.o as w from d join o using (nb_id, src) union all select nb_id, node_id, node_id, 0.0::double from nodes),
pr as (select n.nb_id, node_id, 0 as k, 1.0::double / n as x from nodes n join sz using (nb_id)
  union all select q.nb_id, t.dst, q.k + 1, 0.85 * (sum(q.x * t.w) + max(q.loose) / max(q.n)) + 0.15 / max(q.n) from (select p.nb_id, p.node_id, p.k, p.x, sz.n, sum(case when o.o is null then p.x else 0 end) over (partition by p.nb_id) as loose from pr p join sz using (nb_id) left join o on o.nb_id = p.nb_id and o.src = p.node_id) q join t on t.nb_id = q.nb_id and t.src = q.node_id where q.k < 30 group by q.nb_id, t.dst, q.k),
u as (select nb_id, least(src, dst) as a, greatest(src, dst) as b, count(*) as w from d where src <> dst group by 1, 2, 3), v as (select nb_id, a, b, w from u union all select nb_id, b, a, w from u),
tot as (select nb_id, a as node_id, sum(w) as total, count(*) filter (w = 2) as mutual from v group by 1, 2),
tri as (select x.nb_id, x.a as node_id, sum(x.w * y.w * z.w) as made from v x join v y on x.nb_id = y.nb_id and x.a = y.a and x.b < y.b join u z on z.nb_id = x.nb_id and z.a = x.b and z.b = y.b group by 1, 2),
di as (select nb_id, dst as node_id, count(*) as c from edges group by 1, 2), oo as (select nb_id, src as node_id, count(*) as c from edges group by 1, 2)
select n.nb_id, n.node_id, coalesce(di.c, 0)::double / greatest(sz.n - 1, 1) as in_degree, coalesce(oo.c, 0)::double / greatest(sz.n - 1, 1) as out_degree, round(pr.x, 9) as pagerank, round(case when total * (total - 1) - 2 * mutual > 0 then coalesce(made, 0)::double / (total * (total - 1) - 2 * mutual) else 0 end, 9) as clustering
from nodes n join sz using (nb_id) join pr on pr.nb_id = n.nb_id and pr.node_id = n.node_id and pr.k = 30 left join tot on tot.nb_id = n.nb_id and tot.node_id = n.node_id left join tri on tri.nb_id = n.nb_id and tri.node_id = n.node_id left join di on di.nb_id = n.nb_id and di.node_id = n.node_id left join oo on oo.nb_id = n.nb_id and oo.node_id = n.node_id"""
on_graph("feature_centrality", lambda n, e: features.centrality(n, e, rounds=30, tol=0, error=0.2).select("nb_id", "node_id", "in_degree", "out_degree", F.round("pagerank", 9).alias("pagerank"), F.round("clustering", 9).alias("clustering")), _CENTRAL)
on_graph("feature_betweenness", lambda n, e: features.centrality(n, e).select("nb_id", "node_id", "betweenness"))
_WALKS = """, nx as (select nb_id, src, dst, row_number() over (partition by nb_id, src order by dst) - 1 as i, count(*) over (partition by nb_id, src) as n from (select distinct nb_id, src, dst from edges)),
w as (select nb_id, node_id as start, k as walk, 0 as step, node_id from nodes, (values (1), (2)) t(k) union all
select w.nb_id, w.start, w.walk, w.step + 1, nx.dst from w join nx on w.nb_id = nx.nb_id and w.node_id = nx.src and nx.i = ('0x' || substr(md5(concat_ws('|', 42, w.nb_id, w.start, w.walk, w.step + 1, 0)), 1, 12))::bigint % nx.n where w.step < 5)"""
on_graph("graph_walks", lambda n, e: node_walks.random_walks(n, e, 5, 2).withColumns({c: F.col(c).cast("long") for c in ("walk", "step")}), f"{_WALKS} select nb_id, start, cast(walk as bigint) as walk, cast(step as bigint) as step, node_id from w")
on_graph("feature_walk_embedding", lambda n, e: node_walks.embed(node_walks.path_grams(node_walks.walk_paths(n, e, 5, 2), 2), 8).select("nb_id", "node_id", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value")), f"""{_WALKS}, g as (select a.nb_id, a.node_id, b.node_id as context, count(*) as n from w a join w b on a.nb_id = b.nb_id and a.start = b.start and a.walk = b.walk and abs(a.step - b.step) between 1 and 2 group by 1, 2, 3),
x as (select nb_id, node_id, context, greatest(0.0::double, ln(n * sum(n) over (partition by nb_id) / (sum(n) over (partition by nb_id, node_id)::double * sum(n) over (partition by nb_id, context)))) as x from g)
select nb_id, node_id, dim, round(sum(x * case when ('0x' || substr(md5(concat_ws('|', 42, context, dim)), 1, 12))::bigint % 2 = 0 then 1 else -1 end) / sqrt(8), 6) as value from x, range(8) t(dim) group by 1, 2, 3""")
on_graph("feature_supervised_fit", lambda n, e: n.where("struct_type = 9").select("nb_id", "node_id", features.supervised_fit(F.col("label"), F.col("code")).alias("supervised_fit")), "select nb_id, node_id, cast(event_id % 8 = 1 as int) as supervised_fit from nodes where struct_type = 9")
on_graph("feature_encoding", lambda n, e: features.encode(n, e)[1].groupBy("nb_id", "relation").agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b")), ", p as (select nb_id, node_id, case when struct_type = 9 then 'operation' else 'variable' end as side, row_number() over (partition by nb_id, struct_type = 9 order by ord) - 1 as i from nodes), x as (select e.nb_id, s.side || '-' || d.side as rel, s.i as a, d.i as b from edges e join p s on s.nb_id = e.nb_id and s.node_id = e.src join p d on d.nb_id = e.nb_id and d.node_id = e.dst where s.side <> d.side) select nb_id, relation, count(*) as n, cast(sum(a) as bigint) as a, cast(sum(b) as bigint) as b from (select nb_id, rel as relation, a, b from x union all select nb_id, 'rev-' || rel, b, a from x) group by 1, 2")
on_graph("feature_line_graph", lambda n, e: features.line_graph(e), "select x.nb_id, x.ord as a, y.ord as b from edges x join edges y on x.nb_id = y.nb_id and x.dst = y.src where x.ord <> y.ord")


@query("select vec_id, round((embedding[1]::double - m) / d, 6) as x1 from embeddings, (select avg(embedding[1]::double) as m, case when stddev_pop(embedding[1]::double) < 1e-8 then 1.0 else stddev_pop(embedding[1]::double) end as d from embeddings)")
def feature_zscore(spark, sf_dir):
    e = B.table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return features.zscore(e, "v").select("vec_id", F.round(F.get("v", F.lit(0)), 6).alias("x1"))


@query(r"""with w as (select list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from documents where text is not null),
o as (select w[i] as word, unnest(w[i + 1:i + 5]) as context from (select w, unnest(range(1, len(w))) as i from w)), p as (select word, context, sum(n) as n from (select word, context, count(*) as n from o group by 1, 2 union all select context, word, count(*) from o group by 1, 2) group by 1, 2),
m as (select word, sum(n) as a from p group by 1), x as (select p.word, context, ln(n::double * (select sum(n) from p) / (m.a::double * b.a)) as x from p join m on m.word = p.word join m b on b.word = p.context)
select word, context, round(x, 6) as x from x where x > 0""")
def feature_word_associations(spark, sf_dir):
    from ..operators import subwords

    return subwords.text_associations(B.table(spark, sf_dir, "documents"), "text").withColumn("x", F.round("x", 6))


@query()
def feature_text_vectors(spark, sf_dir):
    from ..operators import text_vectors

    docs = B.table(spark, sf_dir, "documents").select("doc_id", "text")
    return text_vectors.embed(docs, "text", "embedding", 32, rounds=2).select("doc_id", "embedding")


#: A tree that asks for entry 1, then 2 on the left; on the right 3, then 1 again. Thresholds are means, values the labels' mean.
_TREE = """with x as (select vec_id, label, cast(embedding[{i}] as double) as a, cast(embedding[{i1}] as double) as b, cast(embedding[{i2}] as double) as c from embeddings where label is not null and embedding[{i}] is not null and embedding[{i1}] is not null and embedding[{i2}] is not null),
t as (select avg(a) as ta, avg(b) as tb, avg(c) as tc, avg(a) + stddev_pop(a) as ta2 from x),
p as (select x.*, ta, tb, tc, ta2, case when a <= ta then 1 else 2 end as n1, case when a <= ta then case when b <= tb then 3 else 4 end else case when c <= tc then 5 else 6 end end as n2, case when a > ta and c > tc then case when a <= ta2 then 7 else 8 end end as n3 from x cross join t),
ag as (select 0 as node, count(*) as n, avg(label) as v from p union all select n1, count(*), avg(label) from p group by n1 union all select n2, count(*), avg(label) from p group by n2 union all select n3, count(*), avg(label) from p where n3 is not null group by n3),
tr as (select cast(0 as bigint) as tree, cast(ag.node as bigint) as node, case ag.node when 0 then 0 when 1 then 1 when 2 then 2 when 6 then 0 end as feature, case ag.node when 0 then ta when 1 then tb when 2 then tc when 6 then ta2 end as threshold,
  cast(case ag.node when 0 then 1 when 1 then 3 when 2 then 5 when 6 then 7 end as bigint) as {left}, cast(case ag.node when 0 then 2 when 1 then 4 when 2 then 6 when 6 then 8 end as bigint) as {right}, cast(n as double) as cover, cast(v as double) as value from ag cross join t)"""
_D_TREE = _TREE.replace("with x as", "with recursive x as").format(i=1, i1=2, i2=3, left="l", right="r")


@query(f"""{_D_TREE}, s as (select s, s & 1 > 0 as s0, s & 2 > 0 as s1, s & 4 > 0 as s2 from range(8) q(s)),
w as (select vec_id, a, b, c, s.*, cast(0 as bigint) as node, 1.0::double as w from x, s union all
  select w.vec_id, w.a, w.b, w.c, w.s, w.s0, w.s1, w.s2, k.node, w.w * case when [w.s0, w.s1, w.s2][t.feature + 1] then 1 else k.cover / t.cover end from w join tr t on t.node = w.node join tr k on k.node in (t.l, t.r)
  where not [w.s0, w.s1, w.s2][t.feature + 1] or (case when [w.a, w.b, w.c][t.feature + 1] <= t.threshold then t.l else t.r end) = k.node),
g as (select vec_id, s, sum(w * value) as g from w join tr using (node) where tr.l is null group by 1, 2)
select y.vec_id, i as dim, round(sum((y.g - z.g) * case bit_count(z.s::bigint) when 1 then 1 / 6::double else 1 / 3::double end), 9) as value from g y join range(3) d(i) on y.s & (1 << i) > 0 join g z on z.vec_id = y.vec_id and z.s = y.s - (1 << i) group by 1, 2""")
def label_tree_attributions(spark, sf_dir):
    from ..operators import attribution

    e = B.table(spark, sf_dir, "embeddings")
    text = _TREE.replace("from embeddings", "from {embeddings}").replace("{embeddings}", "\0").format(i=0, i1=1, i2=2, left="left", right="right").replace("\0", "{embeddings}")
    leaves = attribution.leaf_paths(spark.sql(f"{text} select * from tr", embeddings=e))
    x = spark.sql(f"{text} select vec_id, array(a, b, c) as features from x", embeddings=e)
    return attribution.attribute(x, leaves).select("vec_id", F.posexplode("attributions").alias("dim", "value")).select("vec_id", F.col("dim").cast("long").alias("dim"), F.round("value", 9).alias("value"))


# --------------------------------------------------------------- refinement

def refined(name: str, rules: list, columns: list[str], sql: str | None = None) -> None:
    def make(n, e):
        state = refine.begin(n)
        for rule in rules:
            state = rule(state, e)
        return state.select("nb_id", "node_id", *columns)

    on_graph(name, make, sql)


_TYPE = "coalesce(domain_type, struct_type)"
_LBL = "case predicted_label when 0 then 'MODEL_OPERATION' when 1 then 'DATA_IMPORT_EXTRACTION' when 2 then 'DATA_TRANSFORM' when 3 then 'EDA' when 4 then 'DATA_EXPORT' when 5 then 'NOT_RELEVANT' end"
_BASE = f", b as (select *, {_TYPE} as t, {_TYPE} = 9 and predicted_label is not null as op from nodes), s0 as (select *, t = 2 or (op and predicted_label = 1) as dataset, (domain_node and t = 4) or (op and predicted_label = 0) as model, case when op then {_LBL} end as new_label from b)"
refined("refine_base_truth", [refine.base_truth], ["dataset", "model", "new_label"], f"{_BASE} select nb_id, node_id, dataset, coalesce(model, false) as model, new_label from s0")
_SEED = f"{_BASE}, s1 as (select * replace (dataset or (t = 9 and event_id % 8 = 0) as dataset, model or (t = 9 and event_id % 8 in (1, 2)) as model, case when t = 9 and coalesce(confidence, 1) < 0.6 and event_id % 8 = 0 then 'DATA_IMPORT_EXTRACTION' when t = 9 and coalesce(confidence, 1) < 0.6 and event_id % 8 in (1, 2) then 'MODEL_OPERATION' else new_label end as new_label) from s0)"
refined("refine_static_seeds", [refine.base_truth, refine.static_seeds], ["dataset", "model", "new_label"], f"{_SEED} select nb_id, node_id, dataset, model, new_label from s1")
_RUN = "predicted_label = 5 and t = 9 and coalesce(confidence, 1) < 0.6 and coalesce(margin, 1) < 0.12 and runner_up <> 5"
refined("refine_relevance", [refine.base_truth, refine.relevance], ["new_predicted", "new_label"], f"{_BASE} select nb_id, node_id, case when x then runner_up end as new_predicted, case when x then {_LBL.replace('predicted_label', 'runner_up')} else new_label end as new_label from (select *, coalesce({_RUN} and exists (select 1 from r join s0 a on a.nb_id = r.nb_id and a.node_id = r.src where r.nb_id = s0.nb_id and r.dst = s0.node_id and a.t = 9 and a.predicted_label = 1), false) as x from s0)")
refined("refine_backward_source", [refine.base_truth, refine.backward_source], ["new_predicted"], f"{_BASE} select nb_id, node_id, case when coalesce({_RUN} and exists (select 1 from r join s0 a on a.nb_id = r.nb_id and a.node_id = r.dst where r.nb_id = s0.nb_id and r.src = s0.node_id and a.t = 9 and a.predicted_label = 2 and coalesce(a.confidence, 0) >= 0.6) and not exists (select 1 from edges i join edges j on j.nb_id = i.nb_id and j.dst = i.src join s0 h on h.nb_id = j.nb_id and h.node_id = j.src and h.t = 9 where i.nb_id = s0.nb_id and i.dst = s0.node_id), false) then runner_up end as new_predicted from s0")
refined("refine_backward_features", [refine.base_truth, refine.backward_features], ["dataset", "new_type"], f"{_BASE}, x as (select *, t in (0, 4) and exists (select 1 from edges e join s0 h on h.nb_id = e.nb_id and h.node_id = e.dst where e.nb_id = s0.nb_id and e.src = s0.node_id and h.new_label = 'MODEL_OPERATION') as f from s0) select nb_id, node_id, dataset or f as dataset, case when f then 9 end as new_type from x")
refined("refine_forward", [refine.base_truth, refine.forward_datasets, refine.forward_models], ["dataset", "model"], f"{_BASE}, x as (select *, t in (0, 4) and exists (select 1 from edges e join s0 h on h.nb_id = e.nb_id and h.node_id = e.src where e.nb_id = s0.nb_id and e.dst = s0.node_id and h.new_label = 'DATA_IMPORT_EXTRACTION') as f, t in (0, 4) and exists (select 1 from edges e join s0 h on h.nb_id = e.nb_id and h.node_id = e.src where e.nb_id = s0.nb_id and e.dst = s0.node_id and h.new_label = 'MODEL_OPERATION') as g from s0) select nb_id, node_id, dataset or f as dataset, model or g as model from x")
refined("refine_evaluation", [refine.base_truth, refine.static_seeds, refine.evaluation], ["new_label", "new_predicted"], f"{_SEED}, x as (select *, t in (3, 6, 9) and coalesce(confidence, 1) < 0.6 and coalesce(new_label, '') <> 'MODEL_OPERATION' and exists (select 1 from edges e join s1 p on p.nb_id = e.nb_id and p.node_id = e.src where e.nb_id = s1.nb_id and e.dst = s1.node_id and p.model) and exists (select 1 from edges e join s1 p on p.nb_id = e.nb_id and p.node_id = e.src where e.nb_id = s1.nb_id and e.dst = s1.node_id and p.dataset) as v from s1) select nb_id, node_id, case when v then 'EDA' else new_label end as new_label, case when v then 3 end as new_predicted from x")
refined("refine_artifacts", [refine.artifacts], ["new_label", "new_type"], f", x as (select *, {_TYPE} as t, {_TYPE} in (3, 6, 9) and coalesce(confidence, 1) < 0.6 and event_id % 8 = 3 as a from nodes) select nb_id, node_id, case when a then 'DATA_EXPORT' end as new_label, case when t not in (3, 6, 9) and exists (select 1 from edges e join x p on p.nb_id = e.nb_id and p.node_id = e.src and p.a where e.nb_id = x.nb_id and e.dst = x.node_id) then 11 end as new_type from x")
refined("refine_dead_code", [refine.base_truth, refine.dead_code], ["dead"], f"{_BASE} select nb_id, node_id, t in (3, 6, 9) and coalesce(new_label, 'NOT_RELEVANT') = 'NOT_RELEVANT' and not exists (select 1 from edges e where e.nb_id = s0.nb_id and e.src = s0.node_id) as dead from s0")
refined("refine_simple_leakage", [refine.base_truth, refine.simple_leakage], ["leak"])


@query()
def refine_default(spark, sf_dir):
    n, e = B.graph(spark, sf_dir)
    # what the rules read
    n = n.select("nb_id", "node_id", "struct_type", "domain_type", "domain_node", "code", "predicted_label", "runner_up", "confidence", "margin")
    return refine.refine(n, e.select("nb_id", "src", "dst")).select("nb_id", "node_id", "node_type", "domain_node", "domain_label", "predicted_label", "has_leakage", "is_dead_code")


# ------------------------------------------------------- lineage and leakage

_MACRO = f", m as (select nb_id, node_id, {_TYPE} as t from nodes where {_TYPE} in (2, 4)), me as (select e.nb_id, e.src, e.dst, a.t as ta, b.t as tb from edges e join m a on a.nb_id = e.nb_id and a.node_id = e.src join m b on b.nb_id = e.nb_id and b.node_id = e.dst where e.src <> e.dst)"
on_graph(
    "lineage_tuples",
    lambda n, e: lineage.tuples(n.withColumn("node_type", F.coalesce("domain_type", "struct_type")).where("node_type in (2, 4)"), graphs.with_ends(e, n.withColumn("node_type", F.coalesce("domain_type", "struct_type")), "node_type").where("src_node_type in (2, 4) and dst_node_type in (2, 4)").select("nb_id", "src", "dst")),
    f"{_MACRO} select nb_id, '<D, D>' as tuple_type, src as subject_id, dst as object_id from me where ta = 2 and tb = 2 union select nb_id, '<M, D>', dst, src from me where ta = 2 and tb = 4 union select nb_id, '<M, D>', src, dst from me where ta = 4 and tb = 2 union select nb_id, '<D, Empty>', node_id, 'Empty' from m where t = 2 and not exists (select 1 from me where me.nb_id = m.nb_id and me.src = m.node_id)",
)
on_graph("lineage_routes", lambda n, e: lineage.route(n.withColumn("node_type", F.coalesce("domain_type", "struct_type")), e).select("nb_id", "src", "dst", F.array_join("operations", "|").alias("operations"), "predicted_label"))
on_graph("lineage_project", lambda n, e: _checkpoints(n) or lineage.project(n.withColumn("node_type", F.coalesce("domain_type", "struct_type")), e)[0].select("nb_id", "node_id", "node_type", F.size("transform_history").alias("n_steps"), F.size("occurrences").alias("n_occurrences")))
on_graph(
    "lineage_gold_tuples",
    lambda n, e: lineage.gold_tuples(n, e.withColumn("label", F.col("predicted_label"))),
    ", i as (select distinct nb_id, dst as n from edges where predicted_label = 1), t as (select * from i where not exists (select 1 from r join i o on o.nb_id = r.nb_id and o.n = r.src where r.nb_id = i.nb_id and r.dst = i.n and r.src <> i.n)), "
    "own as (select nb_id, n as s, n as d from t union select r.nb_id, r.src, r.dst from r join t on t.nb_id = r.nb_id and t.n = r.src), z as (select distinct nb_id, dst as d, case when predicted_label = 0 then '<M, D>' else '<D, D>' end as k from edges where predicted_label in (0, 4)), "
    "h as (select own.nb_id, k, s, own.d from own join z on z.nb_id = own.nb_id and z.d = own.d where s <> own.d) select distinct nb_id, k as tuple_type, case when k = '<M, D>' then d else s end as subject_id, case when k = '<M, D>' then s else d end as object_id from h union select nb_id, '<D, Empty>', n, 'Empty' from t where not exists (select 1 from h where h.nb_id = t.nb_id and h.s = t.n)",
)


@query()
def leakage_findings(spark, sf_dir):
    from ..operators.shared import checkpoints

    checkpoints(spark)
    n, e = B.graph(spark, sf_dir)
    return leakage.findings(n.withColumn("node_type", F.col("struct_type")), e)


on_graph("leakage_split_outputs", lambda n, e: leakage.split_outputs(n, e, leakage.hubs(n.withColumn("node_type", F.col("struct_type")), e).where("is_split")), ", o as (select e.nb_id, e.src as split, e.dst as node_id, e.ord, d.label from edges e join nodes s on s.nb_id = e.nb_id and s.node_id = e.src and s.struct_type = 9 and s.event_id % 8 = 4 join nodes d on d.nb_id = e.nb_id and d.node_id = e.dst where e.edge_type = 2), q as (select *, case label when 'x_test' then 'test' when 'y_train' then 'train' end as nm, (row_number() over (partition by nb_id, split order by ord) - 1) % 2 as i from o), z as (select *, count(nm) over (partition by nb_id, split) as c from q) select nb_id, split, node_id, case when c > 0 then nm when i = 0 then 'train' else 'test' end as role from z where c = 0 or nm is not null")
on_graph("leakage_hubs", lambda n, e: leakage.hubs(n.withColumn("node_type", F.col("struct_type")), e).select("nb_id", "node_id", "callee", "is_split", "is_metric"), "select nb_id, node_id, case event_id % 8 when 0 then 'read_csv' when 1 then 'fit' when 2 then 'predict' when 3 then 'to_csv' when 4 then 'train_test_split' when 5 then 'fit_transform' when 6 then 'plot' else 'merge' end as callee, event_id % 8 = 4 as is_split, false as is_metric from nodes where struct_type = 9")

# -------------------------------------------------------------------- cells


def on_cells(name: str, make, sql: str | None = None) -> None:
    f = lambda spark, sf_dir: make(*B.cells(spark, sf_dir))
    f.__name__ = name
    query(f"{B.D_SYMBOLS} {sql}" if sql else None)(f)


on_cells("cell_symbol_edges", lambda c, d, u: C.symbol_edges(c, d, u).select("nb_id", "src_cell", "dst_cell", "name", "ambiguous", "out_of_order", "confidence"), "select nb_id, src_cell, dst_cell, name, ambiguous, out_of_order, confidence from symbol")
on_cells("cell_undefined_uses", C.undefined, "select distinct u.nb_id, u.cell_id, u.name from uses u where not exists (select 1 from p where p.nb_id = u.nb_id and p.dst_cell = u.cell_id and p.name = u.name)")
on_cells("cell_ambiguities", lambda c, d, u: C.ambiguities(C.symbol_edges(c, d, u)).select("nb_id", "dst_cell", "name", F.size("candidate_def_cells").cast("long").alias("n")), "select nb_id, dst_cell, name, count(*) as n from p group by 1, 2, 3 having count(*) > 1")
on_cells("cell_attributes", lambda c, d, u: C.attributes(c, d, u).select("nb_id", "cell_id", "has_opaque_effects", F.size("free_uses").cast("long").alias("n_uses"), "source_hash"), "select c.nb_id, c.cell_id, false as has_opaque_effects, (select count(*) from uses u where u.nb_id = c.nb_id and u.cell_id = c.cell_id) as n_uses, substr(sha1(c.source), 1, 12) as source_hash from cells c")
on_cells(
    "cell_states",
    lambda c, d, u: C.cell_states(c, C.symbol_edges(c, d, u), C.undefined(c, d, u)),
    ", e as (select s.nb_id, s.src_cell, s.dst_cell, a.document_index as si, b.document_index as di, a.execution_count as sc, b.execution_count as dc from symbol s join cells a on a.nb_id = s.nb_id and a.cell_id = s.src_cell join cells b on b.nb_id = s.nb_id and b.cell_id = s.dst_cell), g as (select nb_id, dst_cell as cell_id, bool_or(si > di) as reorder, bool_or(coalesce(sc > dc, false)) as late, bool_or(dc is not null and sc is null) as missing from e group by 1, 2), o as (select c.*, coalesce(g.reorder, false) as reorder, coalesce(g.late, false) as late, coalesce(g.missing, false) as missing from cells c left join g on g.nb_id = c.nb_id and g.cell_id = c.cell_id), s0 as (select nb_id, cell_id from o where late or (is_dirty and execution_count is not null)), h as (select * from s0 union select e.nb_id, e.dst_cell from s0 join e on e.nb_id = s0.nb_id and e.src_cell = s0.cell_id union select e2.nb_id, e2.dst_cell from s0 join e on e.nb_id = s0.nb_id and e.src_cell = s0.cell_id join e e2 on e2.nb_id = e.nb_id and e2.src_cell = e.dst_cell union select e3.nb_id, e3.dst_cell from s0 join e on e.nb_id = s0.nb_id and e.src_cell = s0.cell_id join e e2 on e2.nb_id = e.nb_id and e2.src_cell = e.dst_cell join e e3 on e3.nb_id = e2.nb_id and e3.src_cell = e2.dst_cell union select e4.nb_id, e4.dst_cell from s0 join e on e.nb_id = s0.nb_id and e.src_cell = s0.cell_id join e e2 on e2.nb_id = e.nb_id and e2.src_cell = e.dst_cell join e e3 on e3.nb_id = e2.nb_id and e3.src_cell = e2.dst_cell join e e4 on e4.nb_id = e3.nb_id and e4.src_cell = e3.dst_cell) select o.nb_id, o.cell_id, case when o.execution_count is null then 'unexecuted' when o.missing then 'missing-deps' when o.is_dirty then 'dirty' when h.cell_id is not null then 'stale' else 'fresh' end as status, exists (select 1 from uses u where u.nb_id = o.nb_id and u.cell_id = o.cell_id and not exists (select 1 from p where p.nb_id = u.nb_id and p.dst_cell = u.cell_id and p.name = u.name)) as hidden_state_risk, o.reorder as unsafe_reorder from o left join (select distinct * from h) h on h.nb_id = o.nb_id and h.cell_id = o.cell_id",
)
on_cells("cell_predicted_order", lambda c, d, u: C.predict_order(C.attributes(c, d, u), C.symbol_edges(c, d, u)))
on_cells(
    "cell_minimal_constraints",
    lambda c, d, u: C.minimal_constraints(C.symbol_edges(c, d, u)).select("nb_id", "src_cell", "dst_cell"),
    ", q as (select distinct nb_id, src_cell as a, dst_cell as b from symbol), y as (with recursive y as (select nb_id, a, b from q union select y.nb_id, y.a, q.b from y join q on q.nb_id = y.nb_id and q.a = y.b) select * from y), o as (select distinct nb_id from y where a = b) "
    "select nb_id, a as src_cell, b as dst_cell from q where nb_id in (select nb_id from o) or not exists (select 1 from q x join y on y.nb_id = x.nb_id and y.a = x.b where x.nb_id = q.nb_id and x.a = q.a and x.b <> q.b and y.b = q.b)",
)
on_cells("cell_candidate_pairs", lambda c, d, u: mining.candidate_pairs(c, C.symbol_edges(c, d, u)).groupBy("nb_id", "related").agg(F.count("*").alias("n")))
on_cells("cell_supervision", lambda c, d, u: mining.supervised(c), "select nb_id, count(execution_count) >= 3 and count(distinct execution_count) = count(execution_count) as valid, bool_and(coalesce(b is null or execution_count > b, true)) as linear from (select *, lag(execution_count) over (partition by nb_id order by document_index) as b from cells where execution_count is not null) group by 1")
on_cells("text_sanitized", lambda c, d, u: c.select("nb_id", "cell_id", F.length(text.sanitize("source")).alias("n")), r"select nb_id, cell_id, cast(length(regexp_replace(regexp_replace(source, '(?m)^[ \t]*[%!].*', '', 'g'), '(?m)^[ \t]*\?.*|.*\?[ \t]*$', '', 'g')) as int) as n from cells")

# ------------------------------------------------- metrics, mining, knowledge

_PRED = "select d.doc_id, l.quality as g, case when d.n_chars >= 400 then 1 else 0 end as p from labels l join documents d using (doc_id)"


@query(f"with x as ({_PRED}), c as (select label, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn from (select g as label, cast(g = p as int) as tp, 0 as fp, cast(g <> p as int) as fn from x union all select p, 0, 1, 0 from x where g <> p) group by rollup(label)), q as (select *, tp / nullif(tp + fp, 0) as a, tp / nullif(tp + fn, 0) as b from c) select label, cast(tp as bigint) as tp, cast(fp as bigint) as fp, cast(fn as bigint) as fn, round(coalesce(a, 0), 9) as precision, round(coalesce(b, 0), 9) as recall, round(coalesce(2 * a * b / nullif(a + b, 0), 0), 9) as f1 from q")
def metric_nodes(spark, sf_dir):
    x = B.table(spark, sf_dir, "labels").join(B.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    x = x.select(F.lit(0).alias("nb_id"), F.col("doc_id").alias("node_id"), "quality", F.when(F.col("n_chars") >= 400, 1).otherwise(0).alias("p"))
    got = metrics.node_scores(x.withColumn("label", F.col("quality")), x.withColumn("label", F.col("p")))
    return got.select("label", "tp", "fp", "fn", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


@query("with x as (select l_returnflag as t, l_orderkey as a, l_partkey as b, l_linenumber as n from lineitem), g as (select distinct t, a, b from x where n <= 4), f as (select distinct t, a, b from x where n >= 3), u as (select t, g.a is not null as gi, f.a is not null as fi from g full join f using (t, a, b)) select t, count(*) filter (where gi and fi) as tp, count(*) filter (where fi and not gi) as fp, count(*) filter (where gi and not fi) as fn from u group by rollup(t)")
def metric_tuples(spark, sf_dir):
    x = B.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("t"), F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b"), "l_linenumber")
    return metrics.set_scores(x.where("l_linenumber <= 4"), x.where("l_linenumber >= 3"), ["t", "a", "b"], "t").select("t", "tp", "fp", "fn")


@query("select event_type, round(avg(v), 6) as mean, round(coalesce(stddev_samp(v), 0), 6) as std, count(v) as n from (select event_type, user_id % 5 as fold, avg(value) as v from events group by 1, 2) group by 1")
def metric_folds(spark, sf_dir):
    f = B.table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 5).alias("fold")).agg(F.avg("value").alias("v"))
    return metrics.fold_summary(f, ["event_type"], "v").select("event_type", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")


@query("with p as (select n_chars as x, octet_length(encode(text)) as y from documents), b as (select quantile_cont(x, 0.02) as lo, quantile_cont(x, 0.98) as hi, quantile_cont(y, 0.98) as top from p), k as (select log10(x) as x, log10(y) as y from p, b where x between lo and hi and y <= top and x > 0 and y > 0) select round(regr_slope(y, x), 6) as slope, round(regr_intercept(y, x), 6) as intercept, count(*) as n from k")
def metric_power_fit(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents").select(F.col("n_chars").alias("x"), F.octet_length("text").cast("long").alias("y"))
    return metrics.power_fit(d, "x", "y").select(F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"), "n")


@query("with c as (select i as label, (select count(*) from embeddings where label = i) as c from range(12) t(i)), r as (select *, case when c > 0 then (select count(*) from embeddings) / (12 * c) else 1.0 end as w from c) select cast(label as int) as label, round(least(w / avg(w) over (), 5.0), 9) as weight from r")
def mining_class_weights(spark, sf_dir):
    return mining.class_weights(B.table(spark, sf_dir, "embeddings"), "label", 12).select("label", F.round("weight", 9).alias("weight"))


@query("select label, (select min(n) from (select count(*) as n from embeddings group by label)) as n from (select distinct label from embeddings)")
def mining_undersample(spark, sf_dir):
    return mining.undersample(B.table(spark, sf_dir, "embeddings").select("vec_id", "label"), "label", "vec_id").groupBy("label").agg(F.count("*").alias("n"))


@query("with e as (select label, count(*) as n from embeddings group by 1), f as (select unnest(range(5)) as fold) select label, cast(fold as int) as fold, n // 5 + cast(fold < n % 5 as bigint) as n from e, f")
def mining_folds(spark, sf_dir):
    return mining.folds(B.table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id", "label").groupBy("label", "fold").agg(F.count("*").alias("n"))


_DOCS = "select doc_id, cast(doc_id % 17 <> 0 as boolean) as success, n_chars // 20 as edge_count, n_chars // 10 as loc, doc_id % 5 = 0 as ml, source || cast(doc_id as string) as name from documents"


@query(f"with d as (select *, ((cast('0x' || substr(md5(name), 1, 8) as bigint) % 10000 * 7296 + cast('0x' || substr(md5(name), 9, 8) as bigint)) % 10000 * 7296 + cast('0x' || substr(md5(name), 17, 8) as bigint)) % 10000 * 7296 + cast('0x' || substr(md5(name), 25, 8) as bigint) as h from ({_DOCS})) select doc_id, case when not success or edge_count < 5 then false when ml then true when edge_count / greatest(loc, 1) < 0.05 then false when edge_count < 50 then h % 10000 < 3000 when edge_count <= 250 then h % 10000 < 8000 else h % 10000 < 5000 end as kept from d")
def mining_sample(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 17 != 0).alias("success"), F.lit("X").alias("error_type"), F.expr("n_chars div 20").alias("edge_count"), F.expr("n_chars div 10").alias("loc"), (F.col("doc_id") % 5 == 0).alias("ml_semantics"), F.array().cast("array<string>").alias("matched_libraries"), F.concat("source", F.col("doc_id").cast("string")).alias("name"))
    return mining.sample(d, "name").select("doc_id", "kept")


def _kb(spark, sf_dir):
    return B.table(spark, sf_dir, "part").select(F.col("p_brand").alias("library"), F.col("p_type").alias("api"), F.when(F.col("p_partkey") % 97 == 0, 5).otherwise(F.length("p_type") % 5).alias("label"), F.col("p_partkey").alias("ord"))


@query("with k as (select p_brand as library, p_type as api, cast(case when p_partkey % 97 = 0 then 5 else length(p_type) % 5 end as int) as label from part) select api, library, min(label) as label from k group by 1, 2 having count(distinct label) = 1 union all select api, '*', min(label) from k group by 1 having count(distinct label) = 1")
def kb_index(spark, sf_dir):
    return knowledge.index(_kb(spark, sf_dir))


@query("select library, api, label from (select p_brand as library, p_type as api, cast(case when p_partkey % 97 = 0 then 5 else length(p_type) % 5 end as int) as label, row_number() over (partition by p_brand, p_type order by count(*) desc, min(p_partkey)) as rn from part group by 1, 2, 3) where rn = 1")
def kb_learned(spark, sf_dir):
    return knowledge.learned(_kb(spark, sf_dir))


@query("with a as (select row_number() over () as i, p_partkey as ask_id, p_brand, p_type from part), k as (select p_brand, p_type, min(p_partkey) as o from part group by 1, 2) select ask_id, cast(o as string) as outputs from a join k using (p_brand, p_type)")
def kb_look_up(spark, sf_dir):
    kb = _kb(spark, sf_dir).select("library", F.lit(None).cast("string").alias("module"), F.lit(None).cast("string").alias("caller"), "api", F.array().cast("array<string>").alias("inputs"), F.array(F.col("ord").cast("string")).alias("outputs"), "ord")
    asked = _kb(spark, sf_dir).select(F.col("ord").alias("ask_id"), "library", F.lit(None).cast("string").alias("module"), F.lit(None).cast("string").alias("caller"), "api")
    return knowledge.look_up(asked, kb).select("ask_id", F.array_join("outputs", ",").alias("outputs"))


_S = "(select distinct l_orderkey as nb_id, l_quantity * 100 as s, l_quantity * 100 + 1 + l_extendedprice % 400 as e from lineitem)"


@query(f"with a as (select row_number() over (order by nb_id, s, e) as ask_id, * from {_S}), g as (select o_orderkey as nb_id, o_orderkey * 10 + i as gold_id, 1000.0 * i as gs, 1000.0 * i + 700 as ge, i as ord from orders, range(5) t(i)), b as (select a.ask_id, g.gold_id, (least(a.e, ge) - greatest(a.s, gs)) / least(a.e - a.s, ge - gs) as overlap, ord from a join g on a.nb_id = g.nb_id and gs < a.e and a.s < ge), c as (select *, row_number() over (partition by ask_id order by overlap desc, ord) as rn from b) select a.nb_id, a.s, c.gold_id, round(c.overlap, 6) as overlap from c join a using (ask_id) where rn = 1 and overlap >= 0.5")
def kb_match_spans(spark, sf_dir):
    a = B.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("nb_id"), (F.col("l_quantity") * 100).alias("s"), (F.col("l_quantity") * 100 + 1 + F.col("l_extendedprice") % 400).alias("e")).distinct()
    a = a.withColumn("ask_id", F.concat_ws("|", "nb_id", "s", "e"))
    g = B.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("nb_id"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("ord"))
    g = g.select("nb_id", (F.col("nb_id") * 10 + F.col("ord")).alias("gold_id"), (F.col("ord") * 1000.0).alias("s"), (F.col("ord") * 1000.0 + 700).alias("e"), "ord")
    got = knowledge.match_spans(a, g)
    return got.join(a, "ask_id").select("nb_id", "s", "gold_id", F.round("overlap", 6).alias("overlap"))


@query("select vec_id, cast(case when i1 = 6 then 4 else i1 end as int) as predicted_label, round(p1, 6) as confidence from (select vec_id, list_position(v, list_max(v)) - 1 as i1, list_max(v)::double as p1 from (select vec_id, embedding as v from embeddings))")
def label_top_two(spark, sf_dir):
    e = B.table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return metrics.top_two(e, "v").select("vec_id", "predicted_label", F.round("confidence", 6).alias("confidence"))


@query("with n as (select source as item from documents group by 1), g as (select item from n where item like 'src1%'), l as (select item, coalesce(lead(item) over (order by item), first_value(item) over (order by item)) as nx from n where item not in (select item from g)) select n.item, coalesce(l.nx, (select min(item) from l)) as next_item from n left join l using (item)")
def mining_next_item(spark, sf_dir):
    n = B.table(spark, sf_dir, "documents").select(F.col("source").alias("item")).distinct()
    return mining.next_item(n, n.where("item like 'src1%'"), n)


@query("select repo, path from (select source as repo, lang || cast(n_chars % 50 as string) as path from documents group by 1, 2) qualify row_number() over (partition by repo order by path) <= 10")
def mining_per_repo(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents").select(F.col("source").alias("repo"), F.concat("lang", (F.col("n_chars") % 50).cast("string")).alias("path"))
    return mining.per_repo(d, 10)


@query("with c as (select p_brand as library, p_type as api from part join lineitem on l_partkey = p_partkey), k as (select distinct p_brand as library, p_type as api from part where p_brand like '%1') select library, api, count(*) as n from c anti join k using (library, api) group by 1, 2 order by 3 desc, 1, 2 limit 20")
def mining_top_missing(spark, sf_dir):
    part = B.table(spark, sf_dir, "part")
    calls = B.table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("library"), F.col("p_type").alias("api"))
    return mining.top_missing(calls, part.where("p_brand like '%1'").select(F.col("p_brand").alias("library"), F.col("p_type").alias("api")))


# ----------------------------------------------------------------- payloads

#: An event as a payload of elements: a node, an edge, what a user interface adds; some broken, some bare lists, some with malformed elements.
PAYLOADS = """select event_id as nb_id, case when event_id % 13 = 0 then substr(p, 1, 40) when event_id % 17 = 0 then e when event_id % 19 = 0 then '{{"items":[]}}' else p end as payload from (select event_id, e, '{{"style":{{"zoom":2}},"elements":' || e || '}}' as p from (
select event_id, '[{{"group":"nodes","position":{{"x":1.5,"y":[2,3]}},"data":{{"id":' || case when event_id % 7 = 0 then cast(event_id as string) else '"n' || cast(event_id as string) || '"' end || ',"label":"' || event_type || '","node_type":' || case when event_id % 11 = 0 then '"call"' else cast(event_id % 9 as string) end || ',"ui":' || props || '}}}},' ||
case when event_id % 5 = 0 then '"note",' else '' end || case when event_id % 3 = 0 then '{{"data":{{"label":"no id"}}}},{{"data":[1]}},' else '' end ||
'{{"data":{{"source":"n' || cast(event_id as string) || '"' || case when event_id % 4 = 0 then '' else ',"target":"u' || cast(user_id as string) || '"' end || ',"classes":"wide"}}}}]' as e from {events}) a) b"""


@query(f"""with p as ({B.duck(PAYLOADS)}), j as (select nb_id, case when json_valid(payload) then payload::json end as v from p),
l as (select nb_id, case when json_type(v) = 'ARRAY' then v when json_type(v, '$.elements') = 'ARRAY' then json_extract(v, '$.elements') end as es from j),
x as (select nb_id, i as ord, json_extract(es, '$[' || i || ']') as e from l, range(json_array_length(es)::bigint) t(i) where es is not null),
d as (select nb_id, ord, case when json_type(e, '$.data') = 'OBJECT' then json_extract(e, '$.data') end as d from x),
k as (select nb_id, ord, d is not null as whole, d ->> '$.id' as id, d ->> '$.source' as source, d ->> '$.target' as target, d ->> '$.label' as label, try_cast(d ->> '$.node_type' as bigint) as node_type, d ->> '$.node_type' as t from d)
select nb_id, ord, case when not whole then null when source is not null or target is not null then 'edge' else 'node' end as kind, id, source, target, label, node_type,
case when not whole then 'element' when (source is null) <> (target is null) then 'end' when source is null and id is null then 'id' when node_type is null and t is not null then 'type' end as error from k
union all select nb_id, null, null, null, null, null, null, null, 'payload' from l where es is null""")
def source_elements(spark, sf_dir):
    from ..sources.notebooks import checked_elements

    return checked_elements(spark.sql(PAYLOADS, events=B.table(spark, sf_dir, "events")))
