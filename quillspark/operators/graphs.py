"""Graph operators over nodes(nb_id, node_id, ord, ...) and edges(nb_id, src, dst, ord, ...), for all notebooks at once.

A notebook's graph is small and the corpus large: what needs a walk runs once
per notebook after one shuffle on nb_id; the rest are joins on (nb_id, node).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from .shared import dealt


class _Graph:
    """The edges (src, dst), marked nodes (src, null) and goals (null, dst) of whole notebooks as numbers, each node with its successors; no edge leaves its notebook.

    Nodes of one notebook follow each other; `bounds` has where each begins.
    """

    def __init__(self, table: pa.Table, backwards: bool = False):
        marks, goals = (np.asarray(pc.is_null(table[c])) for c in ("dst", "src"))
        own = pc.dictionary_encode(table["nb_id"].combine_chunks(), null_encoding="encode")
        self.notebooks, nb = own.dictionary, own.indices.to_numpy().astype(np.int64)
        src, dst = (table[c].combine_chunks().cast(pa.string()) for c in ("src", "dst"))
        every = pa.concat_arrays([src.filter(pa.array(~goals)), dst.filter(pa.array(~marks))]).dictionary_encode()
        k = max(1, len(every.dictionary))
        nodes, code = np.unique(np.concatenate([nb[~goals], nb[~marks]]) * k + every.indices.to_numpy(), return_inverse=True)
        self.n, self.of = len(nodes), nodes // k
        self.names = every.dictionary.take(pa.array(nodes % k))
        self.bounds = np.searchsorted(self.of, np.arange(len(self.notebooks) + 1)).tolist()
        first, second = code[: np.count_nonzero(~goals)], code[np.count_nonzero(~goals) :]
        self.seeds, self.goals = np.unique(first[marks[~goals]]), set(second[goals[~marks]].tolist())
        a, b = first[~marks[~goals]], second[~goals[~marks]]
        a, b = (b, a) if backwards else (a, b)
        ways = np.unique(a * max(1, self.n) + b)
        ends, to = np.searchsorted(ways // max(1, self.n), np.arange(self.n + 1)).tolist(), (ways % max(1, self.n)).tolist()
        self.next = [to[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]

    def before(self) -> list[list[int]]:
        """Each node's predecessors."""
        out: list[list[int]] = [[] for _ in range(self.n)]
        for v, ends in enumerate(self.next):
            for w in ends:
                out[w].append(v)
        return out

    def walk(self, starts, ways: list[list[int]] | None = None) -> list[int]:
        """The nodes that one edge or more leads to from any start, nearest first; by other ways than successors if given."""
        ways = self.next if ways is None else ways
        seen: set[int] = set()
        todo = list(starts)
        for v in todo:
            fresh = [w for w in ways[v] if w not in seen]
            seen.update(fresh)
            todo += fresh
        return todo[len(starts) :]

    def of_start(self) -> list[int]:
        """Each node's number of the first node of its notebook."""
        return np.asarray(self.bounds)[self.of].tolist()

    def ends_first(self) -> list[int]:
        """The nodes so that, cycles apart, each comes behind all that it leads to."""
        out, state = [], bytearray(self.n)
        for root in range(self.n):
            if state[root]:
                continue
            state[root] = 1
            todo = [(root, iter(self.next[root]))]
            while todo:
                v, rest = todo[-1]
                w = next((w for w in rest if not state[w]), None)
                if w is None:
                    out.append(v)
                    todo.pop()
                else:
                    state[w] = 1
                    todo.append((w, iter(self.next[w])))
        return out


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by nb_id in tables of whole notebooks, some to a table."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        ids = b.column("nb_id")
        last = ids[-1]
        # where the batch's last notebook begins
        cut = (pc.index(ids, last) if last.is_valid else pc.index(pc.is_null(ids), True)).as_py()
        if cut:
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = []
        elif held and held[0].column("nb_id")[0].as_py() != last.as_py():
            yield pa.Table.from_batches(held)
            held = []
        held.append(b.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _per_notebook(edges: DataFrame, seeds: DataFrame | None, fn, schema: str, backwards: bool = False, goals: DataFrame | None = None) -> DataFrame:
    """fn(graph) -> columns of `schema`, node numbers for strings, of some whole notebooks at a time after one shuffle on their ids.

    Notebooks follow each other in one stream of sorted rows: many small ones
    are one graph of parts, and cost little beside fn; a large one stands alone.
    """
    kind = edges.schema["nb_id"].dataType.simpleString()
    rows = edges.where("src is not null and dst is not null").select("nb_id", "src", "dst")
    if seeds is not None:
        rows = rows.unionByName(seeds.select("nb_id", F.col("node_id").alias("src"), F.lit(None).cast("string").alias("dst")))
    if goals is not None:
        rows = rows.unionByName(goals.where("node_id is not null").select("nb_id", F.lit(None).cast("string").alias("src"), F.col("node_id").alias("dst")))
    arrow = to_arrow_schema(StructType.fromDDL(f"nb_id {kind}, {schema}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(batches):
            g = _Graph(table, backwards)
            columns = [np.asarray(c, np.int64) for c in fn(g)]
            made = [g.names.take(pa.array(c)) if pa.types.is_string(f.type) else pa.array(c).cast(f.type) for c, f in zip(columns, list(arrow)[1:], strict=True)]
            nb = g.notebooks.take(pa.array(g.of[columns[0]]))
            yield pa.RecordBatch.from_arrays([nb.cast(arrow[0].type), *made], schema=arrow)

    return dealt(rows, "nb_id").sortWithinPartitions("nb_id").mapInArrow(run, f"nb_id {kind}, {schema}")


def closure(edges: DataFrame) -> DataFrame:
    """(nb_id, src, dst): dst can be reached from src.

    All pairs; a notebook of n nodes takes n * n / 8 bytes for its sets. Where
    only what some nodes reach is asked for, take reached() or walks().
    """

    def pairs(g: _Graph):
        sets = [0] * g.n
        order, moved = g.ends_first(), True
        start = g.of_start()
        while moved:  # once, and again only for cycles
            moved = False
            for v in order:
                new, low = sets[v], start[v]
                for w in g.next[v]:
                    new |= sets[w] | 1 << w - low
                moved |= new != sets[v]
                sets[v] = new
        ends = [low + np.flatnonzero(np.unpackbits(np.frombuffer(x.to_bytes(x.bit_length() // 8 + 1, "little"), np.uint8), bitorder="little")) for x, low in zip(sets, start, strict=True)]
        return np.repeat(np.arange(g.n), [len(e) for e in ends]), np.concatenate(ends) if ends else np.zeros(0, np.int64)

    return _per_notebook(edges, None, pairs, "src string, dst string")


def reached(edges: DataFrame, seeds: DataFrame, backwards: bool = False) -> DataFrame:
    """(nb_id, node_id): what one edge or more leads to from any of the seeds (nb_id, node_id), or, backwards, what leads to any of them."""
    return _per_notebook(edges, seeds, lambda g: [g.walk(g.seeds.tolist())], "node_id string", backwards)


def walks(edges: DataFrame, seeds: DataFrame, backwards: bool = False) -> DataFrame:
    """(nb_id, seed, node_id): what one edge or more leads to from each seed, or, backwards, what leads to it."""

    def each(g: _Graph):
        found = [g.walk([s]) for s in g.seeds.tolist()]
        return np.repeat(g.seeds, [len(x) for x in found]), [v for x in found for v in x]

    return _per_notebook(edges, seeds, each, "seed string, node_id string", backwards)


def first_walks(edges: DataFrame, seeds: DataFrame, goals: DataFrame) -> DataFrame:
    """(nb_id, seed, node_id): the goals that one edge or more leads to from each seed that no other seed leads to; such a seed with itself where it leads to no other goal."""

    def each(g: _Graph):
        seeds = g.seeds.tolist()
        below = {v for s in seeds for v in g.walk([s]) if v != s}
        who, found = [], []
        for s in seeds:
            if s not in below:
                ends = [v for v in g.walk([s]) if v != s and v in g.goals] or [s]
                who.append([s] * len(ends))
                found.append(ends)
        return [s for x in who for s in x], [v for x in found for v in x]

    return _per_notebook(edges, seeds, each, "seed string, node_id string", goals=goals)


#: Edges of a notebook that is walked in one task; of larger ones the frontier is joined with the edges.
LARGE = 1_000_000


def depths(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """(nb_id, seed, node, depth): the least number of edges, `depth` at most, from each seed to what it reaches, itself included."""

    def each(g: _Graph):
        who, found, far = [], [], []
        for s in g.seeds.tolist():
            seen = {s: 0}
            todo = [s]
            for v in todo:
                d = seen[v] + 1
                if depth is not None and d > depth:
                    break
                for w in g.next[v]:
                    if w not in seen:
                        seen[w] = d
                        todo.append(w)
            who.append(len(seen))
            found.extend(seen)
            far.extend(seen.values())
        return np.repeat(g.seeds, who), found, far

    return _per_notebook(edges, seeds, each, "seed string, node string, depth int")


def closure_frontier(edges: DataFrame, seeds: DataFrame, depth: int | None = None, large: int = LARGE) -> DataFrame:
    """(nb_id, seed, node, depth) for graphs of any size.

    Notebooks of up to `large` edges are walked in one pass, which moves each
    edge once. In larger ones a frontier is joined with the edges until it is
    empty or `depth` is reached; each round is written to the shared folder, so
    no lineage grows.
    """
    e = edges.select("nb_id", "src", "dst").where("src is not null and dst is not null").distinct().checkpoint()
    own = seeds.select("nb_id", "node_id").distinct()
    big = e.groupBy("nb_id").agg(F.count("*").alias("n")).where(F.col("n") > large).select("nb_id").checkpoint()
    if big.isEmpty():
        return depths(e, own, depth)
    of = lambda df, how: df.join(big.withColumnRenamed("nb_id", "__b"), df["nb_id"].eqNullSafe(F.col("__b")), how)
    return depths(of(e, "left_anti"), of(own, "left_anti"), depth).unionByName(_frontier(of(e, "left_semi").checkpoint(), of(own, "left_semi"), depth))


def _frontier(e: DataFrame, seeds: DataFrame, depth: int | None) -> DataFrame:
    """closure_frontier() of distinct edges by rounds of joins."""
    front = seeds.select("nb_id", F.col("node_id").alias("seed"), F.col("node_id").alias("node"), F.lit(0).alias("depth"))
    seen, d = front, 0
    while depth is None or d < depth:
        d += 1
        step = front.join(e, (front["nb_id"] == e["nb_id"]) & (front["node"] == e["src"])).select(front["nb_id"], "seed", F.col("dst").alias("node"), F.lit(d).alias("depth")).distinct()
        front = step.join(seen.select("nb_id", "seed", "node"), ["nb_id", "seed", "node"], "left_anti").checkpoint()
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def hops(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(nb_id, node_id, depth, n_seeds): least number of edges from any seed, and how many other seeds reach the node."""

    def each(g: _Graph):
        start = g.seeds.tolist()
        far, count = dict.fromkeys(start, 0), dict.fromkeys(start, 0)
        todo = list(start)
        for v in todo:
            for w in g.next[v]:
                if w not in far:
                    far[w], count[w] = far[v] + 1, 0
                    todo.append(w)
        for s in start:
            for v in g.walk([s]):
                count[v] += v != s
        return list(far), list(far.values()), list(count.values())

    return _per_notebook(edges, seeds, each, "node_id string, depth long, n_seeds long")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with in_degree and out_degree, parallel edges counted."""
    both = edges.select("nb_id", F.col("dst").alias("node_id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(edges.select("nb_id", F.col("src").alias("node_id"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    d = both.groupBy("nb_id", "node_id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return nodes.join(d, ["nb_id", "node_id"], "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("in_degree", "out_degree")})


def with_ends(edges: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    """edges with the given columns of both ends, as src_<c> and dst_<c>."""
    s = nodes.select("nb_id", F.col("node_id").alias("src"), *(F.col(c).alias(f"src_{c}") for c in columns))
    d = nodes.select("nb_id", F.col("node_id").alias("dst"), *(F.col(c).alias(f"dst_{c}") for c in columns))
    return edges.join(s, ["nb_id", "src"]).join(d, ["nb_id", "dst"])


def drop_isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select("nb_id", F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    return nodes.join(ends, ["nb_id", "node_id"], "left_semi")


def bypass_branches(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with IF nodes bypassed (every predecessor to every successor), but for those with a LOOP or BRANCH edge going out."""
    ifs = nodes.where("struct_type = 5").select("nb_id", F.col("node_id").alias("x"))
    kept = edges.where("edge_type in (3, 4)").select("nb_id", F.col("src").alias("x")).distinct()
    gone = ifs.join(kept, ["nb_id", "x"], "left_anti")
    into = edges.join(gone, (edges["nb_id"] == gone["nb_id"]) & (edges["dst"] == gone["x"]), "left_semi").select("nb_id", F.col("dst").alias("x"), F.col("src").alias("p")).distinct()
    out = edges.withColumn("x", F.col("src")).join(gone, ["nb_id", "x"])
    made = out.join(into, ["nb_id", "x"]).withColumn("src", F.col("p")).select(*edges.columns)
    rest = edges.join(gone.withColumnRenamed("x", "src"), ["nb_id", "src"], "left_anti").join(gone.withColumnRenamed("x", "dst"), ["nb_id", "dst"], "left_anti").select(*edges.columns)
    return rest.unionByName(made.where("src <> dst"))


def drop_redundant(edges: DataFrame) -> DataFrame:
    """Edges without INPUT edges that run beside another edge and whose label the source's name holds."""
    beside = F.count("*").over(Window.partitionBy("nb_id", "src", "dst")) > 1
    low = F.lower("src")
    named = F.instr(low, F.col("label")) > 0
    spaced = F.instr(low, F.replace("label", F.lit(" "), F.lit("_"))) > 0
    marked = edges.withColumn("__x", beside & (F.col("edge_type") == 1) & (named | spaced | (F.col("label") == "")))
    return marked.where(~F.coalesce("__x", F.lit(False))).drop("__x")


def drop_import_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes without those of one in-edge, from an IMPORT, and none out."""
    d = degrees(nodes, edges)
    from_import = with_ends(edges, nodes, "struct_type").where("src_struct_type = 1").select("nb_id", F.col("dst").alias("node_id")).distinct()
    ends = d.where("out_degree = 0 and in_degree = 1").join(from_import, ["nb_id", "node_id"], "left_semi").select("nb_id", "node_id")
    return nodes.join(ends, ["nb_id", "node_id"], "left_anti")


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(nb_id, node_id, component): the least name that each node is connected with, ends without direction."""
    kind = edges.schema["nb_id"].dataType.simpleString()
    both = nodes.select("nb_id", F.col("node_id").alias("src"), F.col("node_id").alias("dst")).unionByName(edges.select("nb_id", "src", "dst"))

    def per(table: pa.Table) -> pa.Table:
        up: dict = {}

        def find(x):
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for a, b in zip(table["src"].to_pylist(), table["dst"].to_pylist(), strict=True):
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
        names = list(up)
        nb = pa.array([table["nb_id"][0].as_py()] * len(names), table.schema.field("nb_id").type)
        return pa.table([nb, pa.array(names, pa.string()), pa.array([find(x) for x in names], pa.string())], names=["nb_id", "node_id", "component"])

    return both.groupBy("nb_id").applyInArrow(per, f"nb_id {kind}, node_id string, component string")


def labelled_components(nodes: DataFrame, edges: DataFrame, wanted: Column) -> DataFrame:
    """nodes of the components in which some edge meets `wanted`."""
    parts = weak_components(nodes, edges)
    good = parts.join(edges.where(wanted).select("nb_id", F.col("src").alias("node_id")).distinct(), ["nb_id", "node_id"], "left_semi").select("nb_id", "component").distinct()
    keep = parts.join(good, ["nb_id", "component"], "left_semi").select("nb_id", "node_id")
    return nodes.join(keep, ["nb_id", "node_id"], "left_semi")


def rewire(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """(nb_id, src, dst) that bridge the nodes `gone`: from each node before them to each first node behind them."""
    g = gone.select("nb_id", F.col("node_id").alias("g"))
    inside = edges.join(g.withColumnRenamed("g", "src"), ["nb_id", "src"], "left_semi").join(g.withColumnRenamed("g", "dst"), ["nb_id", "dst"], "left_semi")
    reach = closure(inside.select("nb_id", "src", "dst")).unionByName(g.select("nb_id", F.col("g").alias("src"), F.col("g").alias("dst"))).distinct()
    before = edges.join(g.withColumnRenamed("g", "dst"), ["nb_id", "dst"], "left_semi").join(g.withColumnRenamed("g", "src"), ["nb_id", "src"], "left_anti").select("nb_id", F.col("src").alias("p"), F.col("dst").alias("src"))
    after = edges.join(g.withColumnRenamed("g", "src"), ["nb_id", "src"], "left_semi").join(g.withColumnRenamed("g", "dst"), ["nb_id", "dst"], "left_anti").select("nb_id", F.col("src").alias("dst"), F.col("dst").alias("s"))
    return before.join(reach, ["nb_id", "src"]).join(after, ["nb_id", "dst"]).select("nb_id", F.col("p").alias("src"), F.col("s").alias("dst")).distinct()


def spread_types(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with struct_type DATASET for targets of DATA_IMPORT edges not so typed, and what DATA_TRANSFORM edges reach from there."""
    seeds = edges.where("predicted_label = 1").select("nb_id", F.col("dst").alias("node_id")).distinct().join(nodes.where("struct_type <> 2").select("nb_id", "node_id"), ["nb_id", "node_id"])
    along = reached(edges.where("predicted_label = 2"), seeds)
    typed = seeds.unionByName(along).distinct().withColumn("__d", F.lit(True))
    return nodes.join(typed, ["nb_id", "node_id"], "left").withColumn("struct_type", F.when(F.col("__d"), 2).otherwise(F.col("struct_type"))).drop("__d")


def prune(nodes: DataFrame, edges: DataFrame, protected: tuple[int, ...]) -> DataFrame:
    """nodes left when ends of the flow are taken away until none is left but of protected types, then isolated nodes.

    A node stays if it reaches a protected one, or lies on or before a cycle.
    """
    keep = nodes.where(F.col("struct_type").isin(*protected)).select("nb_id", "node_id")

    def staying(g: _Graph):
        before = g.before()
        open_ends, kept = [len(e) for e in g.next], set(g.seeds.tolist())
        todo = [v for v in range(g.n) if not open_ends[v] and v not in kept]
        taken = set(todo)
        for v in todo:
            for p in before[v]:
                open_ends[p] -= 1
                if not open_ends[p] and p not in kept and p not in taken:
                    taken.add(p)
                    todo.append(p)
        return [[v for v in range(g.n) if v not in taken]]

    stay = _per_notebook(edges, keep, staying, "node_id string")
    left = edges.join(stay.withColumnRenamed("node_id", "src"), ["nb_id", "src"], "left_semi").join(stay.withColumnRenamed("node_id", "dst"), ["nb_id", "dst"], "left_semi")
    return drop_isolated(nodes.join(stay, ["nb_id", "node_id"], "left_semi"), left)


def ego(edges: DataFrame, centres: DataFrame, radius: int) -> DataFrame:
    """(nb_id, centre, node_id): nodes within `radius` edges of each centre, whatever their direction."""
    e = edges.select("nb_id", "src", "dst").unionByName(edges.select("nb_id", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    out = centres.select("nb_id", F.col("node_id").alias("centre"), "node_id").distinct()
    for _ in range(radius):
        step = out.join(e.withColumnRenamed("src", "node_id"), ["nb_id", "node_id"]).select("nb_id", "centre", F.col("dst").alias("node_id"))
        out = out.unionByName(step).distinct()
    return out


def around_variable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(nb_id, seed, node_id): the seed, what it reaches and what reaches it."""

    def each(g: _Graph):
        before = g.before()
        found = [{s, *g.walk([s]), *g.walk([s], before)} for s in g.seeds.tolist()]
        return np.repeat(g.seeds, [len(x) for x in found]), [v for x in found for v in x]

    # each pair is made once: no rows of pairs are sorted or compared
    return _per_notebook(edges, seeds, each, "seed string, node_id string")


def to_simple(edges: DataFrame) -> DataFrame:
    """Edges (nb_id, src, dst, ...) with parallel ones made a chain of nodes <dst>_intermediate_<i>."""
    w = Window.partitionBy("nb_id", "src", "dst")
    e = edges.withColumn("__i", F.row_number().over(w.orderBy("ord"))).withColumn("__n", F.count("*").over(w))
    mid = lambda i: F.concat(F.col("dst"), F.lit("_intermediate_"), i.cast("string"))
    a = F.when(F.col("__i") > 1, mid(F.col("__i") - 1)).otherwise(F.col("src"))
    b = F.when(F.col("__i") < F.col("__n"), mid(F.col("__i"))).otherwise(F.col("dst"))
    return e.select(*((a if c == "src" else b if c == "dst" else F.col(c)).alias(c) for c in edges.columns))


#: Sweeps over a notebook's nodes, at most; fixed values: types of nodes that transform, and of imports.
SWEEPS, HUBS, IMPORT = 15, (3, 6, 9), 1
_STEP = pa.struct([("operation", pa.string()), ("target_node", pa.string()), ("transform_code", pa.string())])


def _histories(sweeps: int):
    """Sweeps over a notebook's nodes in their order, each taking from its predecessors, in the order of edges, what has come to them.

    An edge knows how much of its source's lists it has passed on, so each entry
    crosses each edge once, and a node is looked at only while a predecessor has
    more for it.
    """

    def per(table: pa.Table) -> pa.Table:
        table = table.sort_by([("part", "ascending"), ("o", "ascending"), ("a", "ascending"), ("b", "ascending")])
        rows = list(zip(*(table[c].to_pylist() for c in ("part", "a", "b", "code", "kind")), strict=True))
        kept = table.filter(pc.equal(table["part"], 0))
        nodes = {a: (label, code, kind) for part, a, label, code, kind in rows if part == 0}
        into: dict[str, dict[str, list[int]]] = {a: {} for a in nodes}
        for part, a, b, _, _ in rows:
            if part == 1 and a in nodes and b in nodes:
                into[b].setdefault(a, [0, 0])
        steps: dict[str, dict] = {a: {} for a in nodes}
        bases: dict[str, dict] = {a: {} for a in nodes}
        listed: dict[str, tuple[list, list]] = {a: ([], []) for a in nodes}
        for sweep in range(sweeps):
            moved = False
            for node, before in into.items():
                label, _, kind = nodes[node]
                for p, taken in before.items():
                    own = [], []
                    for k in (0, 1):
                        own[k].extend(listed[p][k][taken[k] :])
                        taken[k] = len(listed[p][k])
                    if sweep == 0 and nodes[p][2] == IMPORT:
                        own[1].append(p if nodes[p][0] is None else nodes[p][0])
                    if sweep == 0 and nodes[p][2] in HUBS and kind not in HUBS:
                        own[0].append(("operation" if nodes[p][0] is None else nodes[p][0], node if label is None else label, nodes[p][1] or ""))
                    for k, known in ((0, steps[node]), (1, bases[node])):
                        for x in own[k]:
                            if x not in known:
                                known[x] = True
                                listed[node][k].append(x)
                                moved = True
            if not moved:
                break
        names = kept["a"].to_pylist()
        history = pa.array([[dict(zip(_STEP.names, x, strict=True)) for x in listed[a][0]] for a in names], pa.list_(_STEP))
        base = pa.array([", ".join(sorted(listed[a][1])) if listed[a][1] else None for a in names], pa.string())
        return pa.table([kept["row"], base, history], names=["row", "base_inputs", "transform_history"])

    return per


def provenance(nodes: DataFrame, edges: DataFrame, sweeps: int = SWEEPS) -> DataFrame:
    """nodes with base_inputs (library names, sorted, joined), transform_history (steps in the order in which they come) and n_steps.

    A hub gives a step to each node behind it that is none, an import its name;
    both go on along the edges. Nodes take from their predecessors in place,
    sweep by sweep in the order of nodes, until nothing comes or `sweeps` are
    over, so that what has to go back over many edges may not arrive.
    """
    # a node's row goes with it, so that histories need no join back
    own = nodes.select("nb_id", F.lit(0).alias("part"), F.col("ord").cast("long").alias("o"), F.col("node_id").alias("a"), F.col("label").alias("b"), "code", F.col("struct_type").cast("int").alias("kind"), F.struct(*nodes.columns).alias("row"))
    none = lambda t: F.lit(None).cast(t)
    ways = edges.select("nb_id", F.lit(1).alias("part"), F.col("ord").cast("long").alias("o"), F.col("src").alias("a"), F.col("dst").alias("b"), none("string").alias("code"), none("int").alias("kind"), none(nodes.schema).alias("row"))
    out = StructType.fromDDL("base_inputs string, transform_history array<struct<operation: string, target_node: string, transform_code: string>>")
    found = own.unionByName(ways).groupBy("nb_id").applyInArrow(_histories(sweeps), StructType([StructField("row", nodes.schema), *out]))
    return found.select("row.*", "base_inputs", "transform_history").withColumn("n_steps", F.coalesce(F.size("transform_history"), F.lit(0)).cast("long"))


def context(nodes: DataFrame, edges: DataFrame, most: int = 8) -> DataFrame:
    """(nb_id, node_id, inputs, libraries, outputs): names around each CALL, in the order of edges, `most` at most of each."""
    e = with_ends(edges, nodes, "label", "struct_type")
    pick = lambda rows: F.slice(F.array_distinct(F.transform(F.array_sort(F.collect_list(rows)), lambda x: x["n"])), 1, most)
    into = e.where("dst_struct_type = 9").groupBy("nb_id", F.col("dst").alias("node_id")).agg(
        pick(F.when(F.col("src_struct_type") != 1, F.struct(F.col("ord").alias("o"), F.col("src_label").alias("n")))).alias("inputs"),
        pick(F.when(F.col("src_struct_type") == 1, F.struct(F.col("ord").alias("o"), F.col("src_label").alias("n")))).alias("libraries"),
    )
    out = e.where("src_struct_type = 9").groupBy("nb_id", F.col("src").alias("node_id")).agg(pick(F.struct(F.col("ord").alias("o"), F.col("dst_label").alias("n"))).alias("outputs"))
    return nodes.where("struct_type = 9").select("nb_id", "node_id").join(into, ["nb_id", "node_id"], "left").join(out, ["nb_id", "node_id"], "left")


def filter_relevant(nodes: DataFrame, edges: DataFrame, lineage: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) without import-only ends; for lineage also without components that import no data and with EDA targets bridged, dataset types spread.

    Labels are read from edges here (predicted_label), which callers set from
    nodes or edges as their labeler writes them.
    """
    left = drop_import_ends(nodes, edges)
    ways = edges
    if lineage:
        left = left.join(labelled_components(nodes, edges, F.col("predicted_label") == 1).select("nb_id", "node_id"), ["nb_id", "node_id"], "left_semi")
        eda = edges.where("predicted_label = 3").select("nb_id", F.col("dst").alias("node_id")).distinct()
        new = rewire(edges, eda).select(*(F.col(c) if c in ("nb_id", "src", "dst") else F.lit(None).cast(edges.schema[c].dataType).alias(c) for c in edges.columns))
        left, ways = spread_types(left.join(eda, ["nb_id", "node_id"], "left_anti"), edges), edges.unionByName(new)
    ids = left.select("nb_id", "node_id")
    ways = ways.join(ids.withColumnRenamed("node_id", "src"), ["nb_id", "src"], "left_semi").join(ids.withColumnRenamed("node_id", "dst"), ["nb_id", "dst"], "left_semi")
    return left, ways.select(edges.columns)
