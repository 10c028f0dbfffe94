"""Process relations of a script: (input, caller, operation, output), their graph, annotation and column provenance.

A table says which parts of a syntax node are its operation, its inputs, its
caller and its outputs; a relation stands for each combination of them. Ids
count up over one notebook's tree, and annotation is a worklist whose visits
depend on each other; both run per notebook. Tables of relations and
annotations go on in SQL.
"""

from __future__ import annotations

import ast
from collections import defaultdict, deque
from itertools import product
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sanitize
from ..operators.shared import by_group, checkpoints, dealt


class Relation(NamedTuple):
    input: str | None
    caller: str | None
    op: str | None
    output: str | None


#: The operation, inputs, caller and outputs of each kind of syntax node, as fields of it. `@` is a new
#: name after the node's kind (or what follows), `#` a new name after a field; a kind without an operation only passes names on.
PARTS = {
    "Assign": ("@", "value", "", "targets"),
    "For": ("@", "iter", "", "target"),
    "comprehension": ("@", "iter", "", "target"),
    "Call": ("func", "args keywords", "", "#func.id"),
    "Attribute": ("attr", "", "value", "#attr"),
    "Subscript": ("@", "slice", "value", ""),
    "Slice": ("@", "lower upper step", "", ""),
    "List": ("@", "elts", "", ""),
    "Dict": ("@", "keys values", "", ""),
    "ListComp": ("@", "generators elt", "", ""),
    "IfExp": ("@", "test body orelse", "", ""),
    "Compare": ("ops", "left comparators", "", ""),
    "BinOp": ("op", "left right", "", ""),
    "UnaryOp": ("@", "operand", "", ""),
    "keyword": ("@", "value", "", "#arg"),
    "Lambda": ("@", "", "", ""),
    "Import": ("", "", "", "names"),
    "ImportFrom": ("@", "module", "", "names"),
    "alias": ("@ImportAs", "name", "", "asname"),
    "Name": ("", "", "", "id"),
    "Constant": ("", "", "", "#value"),
    "Tuple": ("", "", "", "elts"),
    "Expr": ("", "", "", "value"),
} | dict.fromkeys("Add Sub Mult Div Mod BitAnd Eq Lt Gt GtE LtE".split(), ("@", "", "", ""))


def bare(name: str | None) -> str:
    return "" if name is None else name.split(":")[0]


class Names:
    """New names: what they are after, and a number that counts up."""

    def __init__(self) -> None:
        self.count = 0

    def __call__(self, after: object = "") -> str:
        self.count += 1
        return f"{after}:id{self.count}".replace("\n", "")


def _values(node: ast.AST, spec: str, new: Names, found: list[Relation]) -> list[str | None]:
    """The names that a part of a node stands for."""
    if spec[:1] == "@":
        return [new(spec[1:] or type(node).__name__)]
    if spec[:1] == "#":
        value = node
        for f in spec[1:].split("."):
            if not hasattr(value, f):
                return []
            value = getattr(value, f)
        return [] if value is None and not isinstance(node, ast.Constant) else [new(value)]
    out: list[str | None] = []
    for f in spec.split():
        value = getattr(node, f)
        for v in value if isinstance(value, list) else [value]:
            if isinstance(v, ast.alias) and isinstance(node, ast.ImportFrom) and not v.asname:
                out.append(v.name)
            elif isinstance(v, ast.AST):
                out += relate(v, new, found)
            elif v is not None:
                out.append(f"{v}:meth" if f == "attr" else str(v))
            elif isinstance(node, ast.Slice):
                out.append(new())
    return out


def relate(node: ast.AST, new: Names, found: list[Relation]) -> list[str | None]:
    """The names that stand for a node's value; its relations go to `found`, those of its parts first."""
    parts = PARTS.get(type(node).__name__)
    if parts is None:
        return [None]
    if isinstance(node, ast.alias) and not node.asname:  # the name itself is bound
        ops, inputs, outputs = [new("ImportAs")], [new(node.name)], [node.name]
        callers: list[str | None] = []
    else:
        ops, inputs, callers, outputs = (_values(node, spec, new, found) for spec in parts)
    if not outputs:
        if not callers and not any(inputs):
            return ops or [None]
        outputs = [new(o) for o in ops]
    found += [Relation(*r) for r in product(inputs or [None], callers or [None], ops, outputs) if r[2] is not None]
    return outputs


def drop_assignments(prs: list[Relation]) -> list[Relation]:
    """Assignments taken out: what made the value makes the variable, too; values without a name of their own go."""
    assigned = [pr for pr in prs if bare(pr.op) == "Assign" and not pr.caller]
    rest = [pr for pr in prs if bare(pr.op) != "Assign" or pr.caller]
    makers: dict = defaultdict(list)
    for pr in rest:
        makers[pr.output].append(pr)
    moved: list[Relation] = []
    for a in assigned:
        given = [m._replace(output=a.output) for m in makers[a.input]]
        moved += given
        makers[a.output] += given
    nameless = {a.input for a in assigned if a.input and ":" in a.input}
    return list(dict.fromkeys([pr for pr in rest if pr.output not in nameless] + moved))


def relations(source: str) -> list[Relation]:
    """The relations of a script as its syntax gives them, each once."""
    found: list[Relation] = []
    new = Names()
    for statement in ast.parse(source).body:
        relate(statement, new, found)
    return list(dict.fromkeys(found))


_PRS = "nb_id {kind}, pr_id long, input string, caller string, op string, output string"


def process_relations(scripts: DataFrame) -> DataFrame:
    """(nb_id, pr_id, input, caller, op, output) of scripts(nb_id, source); scripts that don't parse have none."""
    checkpoints(scripts.sparkSession)
    kind = scripts.schema["nb_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = []
            for nb, source in zip(b.column("nb_id").to_pylist(), b.column("source").to_pylist(), strict=True):
                try:
                    rows += [(nb, k, *pr) for k, pr in enumerate(relations(source or ""))]
                except (SyntaxError, ValueError, RecursionError):
                    continue
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            types = [b.schema.field("nb_id").type, pa.int64(), *[pa.string()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["nb_id", "pr_id", "input", "caller", "op", "output"])

    def settled(nb, rows):
        return [(nb, k, *r) for k, r in enumerate(drop_assignments([Relation(*r[1:]) for r in rows]))]

    read = dealt(scripts.select("nb_id", sanitize(F.col("source")).alias("source")), "nb_id").mapInArrow(run, _PRS.format(kind=kind)).checkpoint()  # read more than once
    met = own_imports(one_call(read)).select("nb_id", "pr_id", *Relation._fields)
    return by_group(met, "nb_id", ["pr_id"], settled, _PRS.format(kind=kind))


def _bare(name: str) -> Column:
    return F.substring_index(name, ":", 1)


def one_call(prs: DataFrame) -> DataFrame:
    """A method's look-up and the call of what it gives as one relation: the call gets the owner, the look-up goes.

    A look-up gives, under its own bare name, what is an operation elsewhere.
    """
    ops = prs.select("nb_id", F.col("op").alias("output")).distinct()
    looks = prs.where(F.col("caller").isNotNull() & (_bare("op") == _bare("output"))).join(ops, ["nb_id", "output"], "left_semi")
    owners = looks.groupBy("nb_id", "output").agg(F.min_by("caller", "pr_id").alias("owner"))
    calls = prs.join(owners.withColumnRenamed("output", "op"), ["nb_id", "op"], "left")
    calls = calls.withColumn("found", F.coalesce("caller", "owner")).join(owners.select("nb_id", "output", F.lit(True).alias("looked")), ["nb_id", "output"], "left")
    return calls.where("caller is null or looked is null").select("nb_id", "pr_id", "input", F.col("found").alias("caller"), "op", "output")


def own_imports(prs: DataFrame) -> DataFrame:
    """What a from-import binds gets a node of its own, which is what later relations are called on; the bare name stays as an operation of that node.

    So no name is an operation and a variable at once. A relation means the last import before it.
    """
    binds = _bare("op") == "ImportFrom"
    name = F.when(binds, F.concat("output", F.lit(":idf"), F.col("pr_id").cast("string")))
    before = Window.partitionBy("nb_id", "met").orderBy("pr_id").rowsBetween(Window.unboundedPreceding, -1)
    met = prs.withColumn("met", F.when(binds, F.col("output")).otherwise(F.col("caller"))).withColumn("own", F.last(name, ignorenulls=True).over(before))
    null = F.lit(None).cast("string")
    row = lambda place, i, c, o, out: F.struct(place.alias("pr_id"), i.alias("input"), c.alias("caller"), o.alias("op"), out.alias("output"))
    at = F.col("pr_id") * 2
    bound = F.array(row(at, F.col("input"), F.col("caller"), F.col("op"), name), row(at + 1, null, name, F.col("output"), null))
    other = F.array(row(at, F.col("input"), F.coalesce("own", "caller"), F.col("op"), F.col("output")))
    return met.select("nb_id", F.explode(F.when(binds, bound).otherwise(other)).alias("r")).select("nb_id", "r.*")


def edges(prs: DataFrame) -> DataFrame:
    """(nb_id, src, dst, edge_type): inputs (1) and callers (0) into operations, operations into outputs (2)."""
    one = lambda a, b, t: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(t).alias("edge_type"))
    # the relations are made once for all three
    every = prs.select("nb_id", F.explode(F.array(one("input", "op", 1), one("caller", "op", 0), one("op", "output", 2))).alias("e")).select("nb_id", "e.*")
    return every.where("src is not null and dst is not null").distinct()


def shared_names(prs: DataFrame) -> DataFrame:
    """(nb_id, name) that are operations and variables both; none where the graph is bipartite."""
    ops = prs.select("nb_id", F.col("op").alias("name"))
    return ops.intersect(prs.select("nb_id", F.explode(F.array("input", "caller", "output")).alias("name")).where("name is not null"))


#: Operations that column provenance follows, whether they exclude columns, and where they lead on.
FOLLOWED = {"drop": (True, "makers"), "iloc": (False, "users"), "Subscript": (False, "makers"), "Slice": (False, "makers"), "List": (False, "makers"), "keyword": (False, "labels")}


def track(prs: list[tuple], annotated: set[str]) -> tuple[set[str], set[str]]:
    """(columns taken, columns left out) by relations around the annotated variables; a column that is left out anywhere is not taken."""
    relations = [Relation(*pr) for pr in prs]
    made, used = defaultdict(list), defaultdict(list)
    for pr in relations:
        made[pr.output].append(pr)
        used[pr.input].append(pr)
    columns: dict[bool, set[str]] = {False: set(), True: set()}
    agenda: list[tuple[Relation, bool | None]] = [(pr, None) for pr in relations if annotated & {pr.input, pr.output}]
    walked = set()
    while agenda:
        pr, exclude = agenda.pop()
        name = bare(pr.op)
        if name not in FOLLOWED:
            continue
        by_default, onwards = FOLLOWED[name]
        step = pr, by_default if exclude is None else exclude
        if step in walked:
            continue
        walked.add(step)
        labels = onwards != "labels" or "label" in (pr.output or "")
        if pr.input is not None and pr.input not in made and labels:  # a constant
            columns[step[1]].add(pr.input)
        elif labels:
            agenda += [(n, step[1]) for n in (used[pr.output] if onwards == "users" else made[pr.input])]
    return columns[False] - columns[True], columns[True]


class Operation(NamedTuple):
    inputs: dict[str, None]
    callers: dict[str, None]
    outputs: dict[str, None]


def annotate(prs: list[tuple], look_up: Callable, back_query: Callable) -> dict[str, list[str]]:
    """Annotations of variables: forward from imports, backward from each annotated input.

    look_up(library, module, caller, api) -> (inputs, outputs); back_query(outputs, api) -> inputs.
    """
    ops: dict[str, Operation] = {}
    makers, takers = defaultdict(dict), defaultdict(dict)  # variable -> operations, in their order
    for pr in prs:
        pr = Relation(*pr)
        op = ops.setdefault(pr.op, Operation({}, {}, {}))
        for kept, v, index in zip(op, (pr.input, pr.caller, pr.output), (takers, takers, makers), strict=True):
            if v is not None:
                kept[v] = index[v][pr.op] = None
    notes: dict[str, dict[str, None]] = defaultdict(dict)
    home: dict[str, tuple] = {}
    done: set[str] = set()

    def note(variables, annotations) -> list[str]:
        pairs = list(zip(variables, annotations, strict=False))
        for v, a in pairs:
            if a:
                notes[v][a] = None
        return [v for v, _ in pairs]

    for seed in (o for o in ops if bare(o) in ("ImportAs", "ImportFrom")):
        library, _, module = bare(next(iter(ops[seed].inputs), None)).partition(".")
        root = library, module or None
        note(ops[seed].outputs, [library] * len(ops[seed].outputs))
        home |= dict.fromkeys(ops[seed].outputs, root)
        agenda = deque([(seed, True)])  # makers of annotated inputs come before what is taken further
        while agenda:
            name, forward = agenda.popleft()
            if name in done:
                continue
            done.add(name)
            op, given, results = ops[name], [], []
            owner = next(iter(op.callers), None)
            if not forward:
                given = back_query([next(iter(notes[v]), None) for v in op.outputs], bare(name))
            else:
                place = home.get(owner, root)
                for v in op.outputs:
                    home.setdefault(v, place)
                if name != seed:
                    tries = (look_up(*place, context, bare(name)) for context in (notes[owner] or [None]))
                    given, results = next((t for t in tries if any(t)), ([], []))
                note(op.outputs, results)
                agenda.extend((n, True) for v in op.outputs for n in takers[v])
            for v in note(op.inputs, given):
                agenda.extendleft((m, False) for m in makers[v])
    return {v: list(a) for v, a in notes.items() if a}


def annotations(prs: DataFrame, kb: list[tuple]) -> DataFrame:
    """(nb_id, name, annotation) per notebook by a knowledge base (library, module, caller, api, inputs, outputs): some hundred rows that travel with the function."""
    kind = prs.schema["nb_id"].dataType.simpleString()

    def look_up(library, module, caller, api):
        rows = [k for k in kb if (library is None or (k[0] or "") == library) and (module is None or (k[1] or "") == module)]
        strict = [k for k in rows if caller is not None and k[2] == caller]
        rows = [k for k in (strict or [k for k in rows if k[2] is None]) if (k[3] or "") == api]
        return (rows[0][4], rows[0][5]) if rows else ([], [])

    def back_query(outputs, api):
        fit = lambda k: all(o is None or o == x for o, x in zip(outputs, k[5], strict=False))
        return next((k[4] for k in kb if (k[3] or "") == api and fit(k)), [])

    def per(nb, rows):
        return [(nb, n, a) for n, al in annotate([r[1:] for r in rows], look_up, back_query).items() for a in al]

    return by_group(prs.select("nb_id", "pr_id", *Relation._fields), "nb_id", ["pr_id"], per, f"nb_id {kind}, name string, annotation string")


def node_types(notes: DataFrame) -> DataFrame:
    """(nb_id, node_id, domain_type): annotated variables as models, datasets or libraries, in that order."""
    a = F.collect_set("annotation")
    has = lambda *w: F.arrays_overlap(F.col("a"), F.array(*map(F.lit, w)))
    kind = F.when(has("model", "trained model", "trained_model"), 4).when(has("data", "features", "labels", "target", "validation features", "validation labels"), 2).otherwise(1)
    return notes.groupBy("nb_id", F.col("name").alias("node_id")).agg(a.alias("a")).select("nb_id", "node_id", kind.alias("domain_type"))


def tuples(prs: DataFrame, types: DataFrame) -> DataFrame:
    """(nb_id, tuple_type, subject_id, object_id) of annotated variables: datasets and models that relations lead from one to the other."""
    from ..operators import graphs, lineage

    reach = graphs.closure(edges(prs))
    anchors = types.where("domain_type in (2, 4)").select("nb_id", "node_id", F.col("domain_type").alias("node_type"))
    ways = graphs.with_ends(reach.where("src <> dst"), anchors, "node_type").select("nb_id", "src", "dst")
    return lineage.tuples(anchors, ways)
