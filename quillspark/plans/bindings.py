"""The driver's tables as notebooks: SQL text that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import tasks

_EV = """select event_id, user_id, event_type, props, value, row_number() over (partition by user_id order by ts, event_id) - 1 as seq from {events}"""

#: A notebook is a user; an event is a node.
NODES = f"""
select user_id as nb_id, 'n' || cast(event_id as string) as node_id, cast(seq as bigint) as ord, event_id, event_type,
  case event_type when 'view' then 0 when 'click' then 9 when 'purchase' then 4 when 'signup' then 1 else 8 end as struct_type,
  case when event_id % 11 = 0 then 2 when event_id % 13 = 0 then 4 end as domain_type, event_id % 5 = 0 as domain_node,
  case event_id % 8 when 0 then 'pd.read_csv("a.csv")' when 1 then 'model.fit(x, y)' when 2 then 'model.predict(x)' when 3 then 'df.to_csv("o.csv")' when 4 then 'train_test_split(x)' when 5 then 'StandardScaler().fit_transform(x)' when 6 then 'plt.plot(x)' else 'df.merge(b)' end as code,
  case event_id % 6 when 0 then 'x_test' when 1 then 'y_train' when 2 then 'df' when 3 then 'pandas' when 4 then 'data.csv' else 'model' end as label,
  'c' || cast(seq % 5 as string) as cell_id,
  cast(case when event_id % 7 = 0 then null else event_id % 6 end as int) as predicted_label, cast((event_id + 2) % 6 as int) as runner_up,
  case when event_id % 9 = 0 then null else cast(event_id * 37 % 100 as double) / 100 end as confidence, cast(event_id * 13 % 30 as double) / 100 as margin
from ({_EV}) e"""

#: Edges to the next event, two times in three, and to the next of the same type.
EDGES = """
select nb_id, src, dst, ord, cast(ord % 3 as int) as edge_type, case when ord % 4 = 0 then 'n' else 'zz' end as label, cast(ord % 6 as int) as predicted_label from (
  select nb_id, lag(node_id) over (partition by nb_id order by ord) as src, node_id as dst, ord * 2 as ord, event_id % 3 as keep from ({nodes}) a
  union all
  select nb_id, lag(node_id) over (partition by nb_id, event_type order by ord) as src, node_id as dst, ord * 2 + 1 as ord, 1 as keep from ({nodes}) b) u
where src is not null and keep <> 0"""

#: A user's events as a session; a cell is an event type.
TRACE = f"""
select user_id as nb_id, 's' as session_id, cast(seq as bigint) as seq, event_type as cell_id, cast(case event_type when 'signup' then 0 when 'view' then 1 when 'click' then 2 when 'purchase' then 3 else 4 end as int) as document_index, md5(props) as source_hash from ({_EV}) e"""
LINKS = """select nb_id, s as src_cell, d as dst_cell, n as name from (select distinct user_id as nb_id from {events}) u cross join (select 'signup' as s, 'view' as d, 'acct' as n union all select 'view', 'click', 'page' union all select 'click', 'purchase', 'item' union all select 'error', 'view', 'log') l"""

#: A conversation as a notebook, a turn as a cell; its first word is defined, all others are used.
CELLS = """select conv_id as nb_id, 't' || cast(turn as string) as cell_id, cast(turn as int) as document_index, text as source, cast(case when turn % 4 = 3 then null else (turn * 7) % 5 end as int) as execution_count, turn % 3 = 1 as is_dirty, false as parse_error from {conversations}"""


def duck(sql: str) -> str:
    return sql.format(events="events", conversations="conversations", nodes="{nodes}")


D_NODES = duck(NODES)
D_EDGES = EDGES.format(nodes=D_NODES)
D_TRACE, D_LINKS, D_CELLS = duck(TRACE), duck(LINKS), duck(CELLS)
D_GRAPH = f"with recursive nodes as ({D_NODES}), edges as ({D_EDGES}), r as (select nb_id, src, dst from edges union select r.nb_id, r.src, e.dst from r join edges e on r.nb_id = e.nb_id and r.dst = e.src)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Events to a task where they lie by user.
EVENTS = 100_000


def by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events, a user's in one task; tasks grow in number with the table, not in size: windows, edges and walks of a user sort their rows side by side there."""
    ev = table(spark, sf_dir, "events")
    return ev.repartition(tasks(ev, rows=EVENTS), "user_id")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(NODES, events=by_user(spark, sf_dir))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(EDGES.replace("({nodes})", "{nodes}"), nodes=nodes(spark, sf_dir))


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return nodes(spark, sf_dir), edges(spark, sf_dir)


def trace(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ev = table(spark, sf_dir, "events")
    return spark.sql(TRACE, events=ev), spark.sql(LINKS, events=ev)


def cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells, defs, uses)."""
    c = spark.sql(CELLS, conversations=table(spark, sf_dir, "conversations"))
    words = F.filter(F.split(F.lower("source"), "[^a-z]+"), lambda w: w != "")
    w = c.select("nb_id", "cell_id", words.alias("w"))
    defs = w.where("size(w) > 0").select("nb_id", "cell_id", F.get("w", F.lit(0)).alias("name"), F.lit("assign").alias("kind"), F.lit(1).alias("lineno"))
    uses = w.select("nb_id", "cell_id", F.explode(F.array_distinct(F.slice("w", 2, F.size("w")))).alias("name")).select("*", F.lit(2).alias("lineno"), F.lit(False).alias("deferred"), F.lit(None).cast("string").alias("via"))
    # a cell doesn't use what it defines
    uses = uses.join(defs.select("nb_id", "cell_id", "name"), ["nb_id", "cell_id", "name"], "left_anti")
    return c, defs, uses


D_SYMBOLS = f"""with cells as ({D_CELLS}), w as (select nb_id, cell_id, document_index, list_filter(regexp_split_to_array(lower(source), '[^a-z]+'), lambda x: x <> '') as w from cells),
defs as (select nb_id, cell_id, document_index, w[1] as name from w where len(w) > 0),
uses as (select distinct u.nb_id, u.cell_id, u.document_index, u.name from (select nb_id, cell_id, document_index, unnest(w[2:]) as name from w) u anti join defs d on u.nb_id = d.nb_id and u.cell_id = d.cell_id and u.name = d.name),
p as (select u.nb_id, u.cell_id as dst_cell, u.name, d.cell_id as src_cell, d.document_index as si, u.document_index as di from uses u join defs d on u.nb_id = d.nb_id and u.name = d.name and u.cell_id <> d.cell_id),
symbol as (select nb_id, src_cell, dst_cell, name, n > 1 as ambiguous, si >= di as out_of_order, 1.0::double / n as confidence from (select *, count(*) over (partition by nb_id, dst_cell, name) as n, row_number() over (partition by nb_id, dst_cell, name order by (si < di) desc, case when si < di then -si else si end) as rn from p) where rn = 1)"""
