"""Execution-trace analytics over events(nb_id, session_id, seq, cell_id, document_index, source_hash, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import djb2
from . import graphs

_S = ["nb_id", "session_id"]


def parse(payloads: DataFrame, column: str = "payload") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sessions, events, sources) of trace payloads (nb_id, JSON), tolerant: what isn't of its type becomes null or its default.

    Events without a cell_id are dropped; a missing seq is the event's place
    among those kept, a missing session id session_<place>.
    """
    schema = "sessions array<string>, sources map<string,string>"
    p = payloads.select("nb_id", F.from_json(column, schema).alias("p"))
    s = p.select("nb_id", F.posexplode("p.sessions").alias("i", "raw")).select("nb_id", "i", F.parse_json("raw").alias("v"))
    text = lambda v, path: F.try_variant_get(v, path, "string")
    sid = F.coalesce(F.nullif(text("v", "$.session_id"), F.lit("")), F.concat(F.lit("session_"), F.col("i").cast("string")))
    s = s.select("nb_id", sid.alias("session_id"), text("v", "$.kernel_id").alias("kernel_id"), F.coalesce(text("v", "$.started_at"), F.lit("")).alias("started_at"), text("v", "$.ended_reason").alias("ended_reason"), F.try_variant_get("v", "$.events", "array<variant>").alias("events"))
    e = s.select("nb_id", "session_id", F.posexplode("events").alias("k", "v")).where(text("v", "$.cell_id").isNotNull())
    place = F.row_number().over(Window.partitionBy(*_S).orderBy("k")) - 1
    events = e.select(
        "nb_id", "session_id", F.coalesce(F.try_variant_get("v", "$.seq", "int"), place).alias("seq"), text("v", "$.cell_id").alias("cell_id"), F.coalesce(F.try_variant_get("v", "$.document_index", "int"), F.lit(-1)).alias("document_index"),
        F.try_variant_get("v", "$.execution_count", "int").alias("execution_count"), F.coalesce(text("v", "$.source_hash"), F.lit("")).alias("source_hash"), F.coalesce(text("v", "$.timestamp"), F.lit("")).alias("timestamp"), F.try_variant_get("v", "$.success", "boolean").alias("success"),
    )
    sources = p.select("nb_id", F.explode("p.sources").alias("source_hash", "source"))
    return s.drop("events"), events, sources


def observed_order(events: DataFrame) -> DataFrame:
    """(nb_id, session_id, cell_id, last_seq, rank): cells by their last execution."""
    last = events.groupBy(*_S, "cell_id").agg(F.max("seq").alias("last_seq"))
    return last.withColumn("rank", F.row_number().over(Window.partitionBy(*_S).orderBy("last_seq", "cell_id")) - 1)


def kendall_tau(a: DataFrame, b: DataFrame) -> DataFrame:
    """(nb_id, session_id, tau) over the items of both orders (nb_id, session_id, item, rank); null under two items."""
    both = a.select(*_S, "item", F.col("rank").alias("ra")).join(b.select(*_S, "item", F.col("rank").alias("rb")), [*_S, "item"])
    x, y = both.alias("x"), both.alias("y")
    pairs = x.join(y, [F.col("x.nb_id") == F.col("y.nb_id"), F.col("x.session_id") == F.col("y.session_id"), F.col("x.ra") < F.col("y.ra")])
    tau = pairs.groupBy(F.col("x.nb_id").alias("nb_id"), F.col("x.session_id").alias("session_id")).agg(F.avg(F.when(F.col("x.rb") < F.col("y.rb"), 1.0).otherwise(-1.0)).alias("tau"))
    return a.select(*_S).distinct().join(tau, _S, "left")


def rerun_kinds(events: DataFrame) -> DataFrame:
    """events with rerun_kind: first, identical or edited against the cell's execution before."""
    before = F.lag("source_hash").over(Window.partitionBy(*_S, "cell_id").orderBy("seq"))
    return events.withColumn("rerun_kind", F.when(before.isNull(), "first").when(before == F.col("source_hash"), "identical").otherwise("edited"))


def out_of_order(events: DataFrame) -> DataFrame:
    """events with out_of_doc_order: a cell runs after one further down has run."""
    most = F.max("document_index").over(Window.partitionBy(*_S).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return events.withColumn("out_of_doc_order", (F.col("document_index") >= 0) & (F.col("document_index") < F.coalesce(most, F.lit(-1))))


def stale_inputs(events: DataFrame, cell_edges: DataFrame) -> DataFrame:
    """events with stale_input_names: names whose defining cell had not run by then, sorted."""
    first = events.groupBy(*_S, F.col("cell_id").alias("src_cell")).agg(F.min("seq").alias("first_seq"))
    need = events.select(*_S, "seq", F.col("cell_id").alias("dst_cell")).join(cell_edges.select("nb_id", "src_cell", "dst_cell", "name").distinct(), ["nb_id", "dst_cell"])
    late = need.join(first, [*_S, "src_cell"], "left").where("first_seq is null or first_seq >= seq")
    names = late.groupBy(*_S, "seq").agg(F.array_sort(F.collect_set("name")).alias("stale_input_names"))
    return events.join(names, [*_S, "seq"], "left").withColumn("stale_input_names", F.coalesce("stale_input_names", F.array().cast("array<string>")))


def violations(events: DataFrame, cell_edges: DataFrame) -> DataFrame:
    """(nb_id, session_id, src_cell, dst_cell, name, violation): edges into executed cells whose source never ran, or ran last later."""
    last = observed_order(events).select(*_S, "cell_id", "last_seq")
    d = cell_edges.select("nb_id", "src_cell", "dst_cell", "name").join(last.withColumnRenamed("cell_id", "dst_cell").withColumnRenamed("last_seq", "d"), ["nb_id", "dst_cell"])
    s = d.join(last.withColumnRenamed("cell_id", "src_cell").withColumnRenamed("last_seq", "s"), [*_S, "src_cell"], "left")
    kind = F.when(F.col("s").isNull(), "missing-upstream").when(F.col("s") > F.col("d"), "reversed")
    return s.withColumn("violation", kind).where("violation is not null").select(*_S, "src_cell", "dst_cell", "name", "violation")


def deleted_reads(events: DataFrame, cells: DataFrame, defined: DataFrame, undefined: DataFrame) -> DataFrame:
    """(nb_id, session_id, cell_id, source_hash, defined_names, names) for cells run but gone.

    defined has (nb_id, source_hash, name) of the stored sources, undefined
    (nb_id, name) that current cells read and no current cell defines.
    """
    first = events.join(cells.select("nb_id", "cell_id"), ["nb_id", "cell_id"], "left_anti").groupBy(*_S, "cell_id").agg(F.min_by("source_hash", "seq").alias("source_hash"))
    d = defined.groupBy("nb_id", "source_hash").agg(F.array_sort(F.collect_set("name")).alias("defined_names"))
    u = undefined.groupBy("nb_id").agg(F.collect_set("name").alias("__u"))
    none = F.array().cast("array<string>")
    return first.join(d, ["nb_id", "source_hash"], "left").join(u, "nb_id", "left").select(*_S, "cell_id", F.when(F.col("defined_names").isNotNull(), F.col("source_hash")).alias("source_hash"), F.coalesce("defined_names", none).alias("defined_names"), F.array_sort(F.array_intersect(F.coalesce("defined_names", none), F.coalesce("__u", none))).alias("names"))


def freshness(events: DataFrame, cells: DataFrame, cell_edges: DataFrame, current: Column | None = None) -> DataFrame:
    """(nb_id, cell_id, freshness): unexecuted, edited, stale-input (behind a cell that isn't fresh) or fresh, of one session per notebook."""
    last = events.groupBy("nb_id", "cell_id").agg(F.max_by("source_hash", "seq").alias("last_hash"))
    now = djb2(F.col("source")) if current is None else current
    state = F.when(F.col("last_hash").isNull(), "unexecuted").when(F.coalesce("is_dirty", F.lit(False)) | (F.col("last_hash") != F.col("__now")), "edited").otherwise("fresh")
    own = cells.withColumn("__now", now).join(last, ["nb_id", "cell_id"], "left").select("nb_id", "cell_id", state.alias("freshness"))
    r = graphs.closure(cell_edges.select("nb_id", F.col("src_cell").alias("src"), F.col("dst_cell").alias("dst")))
    bad = own.where("freshness <> 'fresh'").select("nb_id", F.col("cell_id").alias("src"))
    below = r.join(bad, ["nb_id", "src"], "left_semi").select("nb_id", F.col("dst").alias("cell_id")).distinct().withColumn("__b", F.lit(True))
    return own.join(below, ["nb_id", "cell_id"], "left").select("nb_id", "cell_id", F.when((F.col("freshness") == "fresh") & F.col("__b"), "stale-input").otherwise(F.col("freshness")).alias("freshness"))


def replay_set(fresh: DataFrame, cell_edges: DataFrame, order: DataFrame, targets: DataFrame) -> DataFrame:
    """(nb_id, target, cell_id, step): cells to run again so that the target is fresh, in a valid order."""
    r = graphs.closure(cell_edges.select("nb_id", F.col("src_cell").alias("src"), F.col("dst_cell").alias("dst")))
    need = r.join(targets.select("nb_id", F.col("cell_id").alias("dst")), ["nb_id", "dst"], "left_semi").select("nb_id", F.col("dst").alias("target"), F.col("src").alias("cell_id"))
    need = need.unionByName(targets.select("nb_id", F.col("cell_id").alias("target"), "cell_id")).distinct()
    stale = need.join(fresh.where("freshness <> 'fresh'").select("nb_id", "cell_id"), ["nb_id", "cell_id"], "left_semi").join(order.select("nb_id", "cell_id", "rank"), ["nb_id", "cell_id"])
    return stale.select("nb_id", "target", "cell_id", (F.row_number().over(Window.partitionBy("nb_id", "target").orderBy("rank")) - 1).alias("step"))


def risks(cell_edges: DataFrame, events: DataFrame, deleted: DataFrame, fresh: DataFrame, cells: DataFrame) -> DataFrame:
    """(nb_id, kind, cell_id, detail): why running all cells top to bottom would not rebuild the state, six kinds; none means it would."""
    last = observed_order(events)
    ran = last.select("nb_id", "cell_id").distinct()
    row = lambda df, kind, cell, detail: df.select("nb_id", F.lit(kind).alias("kind"), F.col(cell).alias("cell_id"), detail.alias("detail"))
    out = row(cell_edges.where("out_of_order"), "out-of-order-binding", "dst_cell", F.col("name"))
    out = out.unionByName(row(deleted.where("size(names) > 0"), "deleted-cell-state", "cell_id", F.array_join("names", ", ")))
    pick = cell_edges.where("ambiguous").select("nb_id", "dst_cell", "name", "src_cell", F.explode("candidate_def_cells").alias("cell_id"))
    d = last.select("nb_id", F.col("cell_id").alias("dst_cell"), F.col("rank").alias("d"))
    best = pick.join(d, ["nb_id", "dst_cell"]).join(last.select("nb_id", "cell_id", "rank"), ["nb_id", "cell_id"]).where("rank < d").groupBy("nb_id", "dst_cell", "name").agg(F.max_by("cell_id", "rank").alias("ran"), F.min("src_cell").alias("src_cell"))
    out = out.unionByName(row(best.where("ran <> src_cell"), "ambiguous-binding-divergence", "dst_cell", F.col("name")))
    out = out.unionByName(row(fresh.where("freshness = 'edited'").join(ran, ["nb_id", "cell_id"], "left_semi"), "edited-after-run", "cell_id", F.lit("")))
    used = cell_edges.join(ran.withColumnRenamed("cell_id", "dst_cell"), ["nb_id", "dst_cell"], "left_semi").select("nb_id", F.col("src_cell").alias("cell_id"))
    out = out.unionByName(row(fresh.where("freshness = 'unexecuted'").join(used, ["nb_id", "cell_id"], "left_semi"), "never-executed", "cell_id", F.lit("")))
    return out.unionByName(row(cells.where("has_opaque_effects").join(ran, ["nb_id", "cell_id"], "left_semi"), "opaque-effects", "cell_id", F.lit("")))


def sanitize_sessions(raw: DataFrame) -> DataFrame:
    """Saved sessions with an id, one row per id: the last wins."""
    w = Window.partitionBy("nb_id", "session_id").orderBy(F.col("arrival").desc())
    return raw.where("coalesce(session_id, '') <> ''").withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def merge_sessions(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored sessions, replaced or joined by incoming ones of the same id."""
    return stored.join(incoming.select(*_S), _S, "left_anti").unionByName(incoming)


def sessionize(events: DataFrame) -> DataFrame:
    """events(nb_id, kernel_id, restart, execution_count, seq) with session_no: a new one on restart, another kernel, or a count of 1 after a larger one."""
    w = Window.partitionBy("nb_id").orderBy("seq")
    new = F.coalesce("restart", F.lit(False)) | (F.col("kernel_id") != F.lag("kernel_id").over(w)) | ((F.col("execution_count") == 1) & (F.lag("execution_count").over(w) > 1))
    return events.withColumn("__n", F.coalesce(new, F.lit(False)).cast("int")).withColumn("session_no", F.sum("__n").over(w)).drop("__n")
