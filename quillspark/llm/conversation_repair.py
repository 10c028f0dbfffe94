"""Conversation repair: the cheapest edits that give a conversation its grammar.

Roles have to read as an optional system turn and then pairs of user and
assistant turns, or nothing at all. Which states of that grammar lead to its end
is held, for each turn and each cost, as a set of bits: the layers of growing
cost lie side by side in one number, so a shift by three or four layers applies
an edit to all of them at once. The first layer that holds the start is the
cost; the least audit is read off forwards, bit by bit.

States: 0 nothing yet, 1 after the system turn, 2 after a user's turn, 3 after
an assistant's. 0 and 3 may end.

A conversation is a run of segments of bounded length. Where it has several,
each gives its costs from state to state, the conversation's segments are
folded backwards, and each segment is traced from every state by itself; so no
task holds the rows of a long conversation, apart from the hash of its text,
which streams.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_dir

#: What an edit costs, by its initial; what an undeleted truncated turn adds.
COST, TRUNCATED = {"D": 4, "I": 3, "K": 0, "R": 3}, 3
#: Layers held for a turn: states of one turn differ by 16 at most, as two inserts and a deletion lead from any to any.
LAYERS = 32
#: Rows to a segment, as a power of two.
SEGMENT = 12
_FAR = 1 << 60
_END = [0, 2 * COST["I"], COST["I"], 0]
#: Fixed value: the white space that is not visible.
WHITE = " \t\n\x0b\x0c\r"
#: Faults.
NONE, BLANK, DUPLICATE, CUT = range(4)


class Register:
    """Sets of (state, target) for LAYERS costs in one number, `targets` bits to a state."""

    def __init__(self, targets: int):
        self.k, self.width = targets, 4 * targets
        every = sum(1 << (c * self.width) for c in range(LAYERS))
        self.full = (1 << (LAYERS * self.width)) - 1
        self.of = [every * (((1 << targets) - 1) << (s * targets)) for s in range(4)]

    def user(self, x: int) -> int:
        x = (x & self.of[2]) >> (2 * self.k)
        return x | x << self.k | x << (3 * self.k)

    def assistant(self, x: int) -> int:
        return (x & self.of[3]) >> self.k

    def system(self, x: int) -> int:
        return (x & self.of[1]) >> self.k

    def either(self, x: int) -> int:
        return self.user(x) | self.assistant(x)

    def inserted(self, x: int) -> int:
        for _ in range(2):
            x |= self.either(x) << (COST["I"] * self.width)
        return x

    def before(self, x: int, initial: str, cut: bool) -> tuple[int, int]:
        """The sets before a turn by those after it, and by how many layers they are moved down."""
        keep = self.user(x) if initial == "u" else self.assistant(x) if initial == "a" else self.system(x) if initial == "s" else 0
        stays = (keep | self.either(x) << (COST["R"] * self.width)) << (TRUNCATED * cut * self.width)
        x = self.inserted(stays | x << (COST["D"] * self.width))
        low = ((x & -x).bit_length() - 1) // self.width
        return (x >> (low * self.width)) & self.full, low


_ONE, _TWO = Register(1), Register(2)


def relation(initials: list[str], cuts: list[bool]) -> list[int]:
    """The least costs from state s to state t over some turns, at 4 * s + t; _FAR where there is no way."""
    n = len(initials)
    out = [_FAR] * 16
    # states 0 and 1 are only left for good, so what ends in them deletes all but a system turn
    out[0] = out[5] = COST["D"] * n
    if systems := [TRUNCATED * c for i, c in zip(initials, cuts, strict=True) if i == "s"]:
        out[1] = COST["D"] * (n - 1) + min(systems)
    x, base = _TWO.inserted(1 << 4 | 2 << 6), 0
    for i, c in zip(reversed(initials), reversed(cuts), strict=True):
        x, low = _TWO.before(x, i, c)
        base += low
    for s in range(4):
        for t in (2, 3):
            if layers := [c for c in range(LAYERS) if x >> (c * 8 + 2 * s + t - 2) & 1]:
                out[4 * s + t] = base + layers[0]
    return out


def trace(initials: list[str], cuts: list[bool], ends: list[int], last: bool, entries: list[int]) -> list[tuple[list[tuple[int, str]], int, str]]:
    """For each state to enter by: (state, edits) of each turn, inserts before it included, the state left in, and inserts at the end.

    `ends` are the costs from each state behind the turns; inserts there are made
    by the next segment unless this is the last. Ties take the least initials.
    """
    least = min(ends)
    x, base = sum(1 << ((e - least) * 4 + s) for s, e in enumerate(ends) if e - least < LAYERS), least
    held = [(x, base)]
    for i, c in zip(reversed(initials), reversed(cuts), strict=True):
        x, low = _ONE.before(x, i, c)
        base += low
        held.append((x, base))
    held.reverse()

    def has(turn: int, state: int, cost: int) -> bool:
        x, base = held[turn]
        return cost >= base and bool(x >> ((cost - base) * 4 + state) & 1)

    out = []
    for entry in entries:
        x, base = held[0]
        state, edits = entry, []
        cost = next((base + c for c in range(LAYERS) if x >> (c * 4 + state) & 1), None)
        if cost is None:
            out.append(([], -1, ""))
            continue
        for turn, (i, c) in enumerate(zip(initials, cuts, strict=True)):
            at, letters = state, ""
            while True:
                to = 3 if state == 2 else 2
                kept = 1 if i == "s" and state == 0 else to if i == ("a" if state == 2 else "u") else None
                if has(turn + 1, state, cost - COST["D"]):
                    letters, cost = letters + "D", cost - COST["D"]
                elif has(turn, to, cost - COST["I"]):
                    letters, cost, state = letters + "I", cost - COST["I"], to
                    continue
                elif kept is not None and has(turn + 1, kept, cost - TRUNCATED * c):
                    letters, cost, state = letters + "K", cost - TRUNCATED * c, kept
                else:
                    letters, cost, state = letters + "R", cost - COST["R"] - TRUNCATED * c, to
                break
            edits.append((at, letters))
        after = ""
        while last and state in (1, 2):
            after, state = after + "I", 3 if state == 2 else 2
        out.append((edits, state, after))
    return out


# ------------------------------------------------------------------ Spark


def ordered(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(c, at, turn, role, text, n): different rows with the number of their copies, in the order of a global place `at`.

    By conversation and turn, nulls first, then role and text; the table is
    written to the shared folder, so places stay as they are.
    """
    t = df.select(
        F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit("")).alias("c"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"),
    )
    t = t.groupBy("c", "turn", "role", "text").agg(F.count("*").alias("n"))
    t = t.withColumn("a", F.xxhash64("text")).withColumn("b", F.xxhash64(F.lit(7), "text")).withColumn("head", F.substring("text", 1, 32))
    by = ["c", "turn", "role", "head", "a", "b"]
    t = t.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    place = f"{shared_dir(df.sparkSession)}/conversations-{uuid.uuid4().hex}"
    t.write.parquet(place)
    return df.sparkSession.read.parquet(place)


def faulted(t: DataFrame) -> DataFrame:
    """(c, at, seg, n, initial, fault) of each row of `ordered`: the first fault of its first copy."""
    seen = t.groupBy("c", "role", "a", "b").agg(F.min("at").alias("first"))
    last = F.substring(F.rtrim("text", F.lit(WHITE)), -1, 1)
    light = t.select("c", "at", "n", "role", "a", "b", last.alias("last"))
    found = light.join(seen, ["c", "role", "a", "b"])
    fault = F.when(F.col("last") == "", F.lit(BLANK)).when(F.col("at") > F.col("first"), F.lit(DUPLICATE)).when(~F.col("last").isin(".", "!", "?"), F.lit(CUT)).otherwise(F.lit(NONE))
    return found.select("c", "at", F.shiftright("at", SEGMENT).alias("seg"), "n", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))


def _turns(got: pa.Table) -> tuple[pa.Table, list[int], list[str], list[bool]]:
    """A segment in order; the places, initials and cuts of turns that need not be deleted."""
    got = got.sort_by("at")
    faults, initials = got["fault"].to_pylist(), got["initial"].to_pylist()
    free = [i for i, f in enumerate(faults) if f in (NONE, CUT)]
    return got, free, [initials[i] for i in free], [faults[i] == CUT for i in free]


def _relate(got: pa.Table) -> pa.Table:
    got, _, initials, cuts = _turns(got)
    return pa.table({"c": got["c"][:1].cast(pa.string()), "seg": got["seg"][:1], "costs": pa.array([relation(initials, cuts)], pa.list_(pa.int64()))})


def _backwards(got: pa.Table) -> pa.Table:
    got = got.sort_by("seg")
    ends, out = list(_END), []
    for costs in reversed(got["costs"].to_pylist()):
        out.append(ends)
        ends = [min(costs[4 * s + t] + ends[t] for t in range(4)) for s in range(4)]
    return pa.table({"c": got["c"], "seg": got["seg"], "ends": pa.array(out[::-1], pa.list_(pa.int64())), "last": [False] * (len(out) - 1) + [True]})


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each row, rows in order, its edits for each state that its segment is entered by, as 'state edits'; with a segment's last row the states left in, with the inserts at its end."""
    names = ["c", "seg", "at", "initial", "fault", "ends", "last"]
    out: list[tuple] = []
    segment: list[tuple] = []

    def close() -> None:
        ends, last = segment[0][5:]
        free = [i for i, r in enumerate(segment) if r[4] in (NONE, CUT)]
        ways = trace([segment[i][3] for i in free], [segment[i][4] == CUT for i in free], ends or _END, ends is None or last, [0] if ends is None else [0, 1, 2, 3])
        edits = [[""] * len(segment) for _ in ways]
        for k, (made, _, _) in enumerate(ways):
            for i, (state, letters) in zip(free, made, strict=False):
                edits[k][i] = f"{state}{letters}"
        rest = [f"{state}{after}" for _, state, after in ways]
        out.extend((r[0], r[2], r[1], list(e), rest if i == len(segment) - 1 else None) for i, (r, e) in enumerate(zip(segment, zip(*edits, strict=True), strict=True)))

    def flush() -> pa.RecordBatch:
        texts = pa.list_(pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), texts, texts), strict=True)], names=["c", "at", "seg", "edits", "rest"])

    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in names), strict=True):
            if segment and segment[0][:2] != row[:2]:
                close()
                segment = []
                if len(out) >= 4096:
                    yield flush()
                    out = []
            segment.append(row)
    if segment:
        close()
    if out:
        yield flush()


def _forwards(got: pa.Table) -> pa.Table:
    got = got.sort_by("seg")
    state, out = 0, []
    for rest in got["rest"].to_pylist():
        out.append(state)
        state = int(rest[state][0])
    return pa.table({"c": got["c"], "seg": got["seg"], "entry": pa.array(out, pa.int32())})


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation of rows that come in order: counts, cost, audit, and the hash of its repaired turns, one turn at a time."""
    now, out = None, []

    def done() -> tuple:
        return now, *counts, cost, "".join(audit), sha.hexdigest()

    def flush() -> pa.RecordBatch:
        kinds = [pa.string(), *[pa.int64()] * 5, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["c", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"])

    def add(edits: str) -> None:
        nonlocal cost
        audit.append(edits)
        cost += sum(COST[e] * edits.count(e) for e in "DIR")

    def put(role: str, text: str) -> None:
        nonlocal empty
        sha.update(("" if empty else "\n").encode() + f"{role}:{text}".encode())
        empty = False

    for batch in batches:
        for c, n, initial, fault, role, text, edits, rest in zip(*(batch.column(k).to_pylist() for k in ("c", "n", "initial", "fault", "role", "text", "edits", "rest")), strict=True):
            if c != now:
                if now is not None:
                    out.append(done())
                    if len(out) >= 1000:
                        yield flush()
                        out = []
                now, counts, cost, audit, sha, empty, before = c, [0, 0, 0, 0], 0, [], hashlib.sha256(), True, None
            counts[3] += (before is not None and before + initial not in ("su", "ua", "au")) + n - 1
            before = initial
            if fault != NONE:
                counts[fault - 1] += n if fault in (BLANK, DUPLICATE) else 1
            if fault in (BLANK, DUPLICATE):
                add("D" * n)
            else:
                # copies of a row that is neither are duplicates of it
                counts[1] += n - 1
                add(edits[1:] + "D" * (n - 1))
                state = int(edits[0])
                for e in edits[1:]:
                    name = "assistant" if state == 2 else "user"
                    if e == "D":
                        continue
                    cost += TRUNCATED * (fault == CUT and e != "I")
                    put(role if e == "K" else name, "" if e == "I" else text)
                    state = 1 if e == "K" and initial == "s" else 3 if state == 2 else 2
            for k in range(len(rest)):
                put("user" if len(rest) - k == 2 else "assistant", "")
            add(rest)
    if now is not None:
        out.append(done())
    if out:
        yield flush()


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation of df.

    Turns follow by number, nulls first, those of one number by role and text;
    null roles and texts are one space. A turn is blank without visible
    characters, else duplicate if its role and text came before, else truncated
    if its last visible character does not end a sentence. Edits cost as in
    COST; the audit is the cheapest edits' initials, of ties the least. gaps is
    how many numbers are missing between the least and the largest. A null
    conversation is one; rows that are wholly equal are copies that follow each
    other; an empty table gives none. Other columns are not looked at.
    """
    t = ordered(df, conv, turn, role, text)
    rows = faulted(t).checkpoint()
    kinds = {"c": "string", "seg": "long"}
    schema = lambda **more: ", ".join(f"{k} {v}" for k, v in (kinds | more).items())
    segments = rows.select("c", "seg").distinct()
    many = segments.groupBy("c").agg(F.count("*").alias("k")).where("k > 1").select("c").checkpoint()
    related = rows.join(many, "c", "left_semi").groupBy("c", "seg").applyInArrow(_relate, schema(costs="array<long>"))
    ends = related.groupBy("c").applyInArrow(_backwards, schema(ends="array<long>", last="boolean"))
    traced = rows.join(ends, ["c", "seg"], "left").repartition("c", "seg").sortWithinPartitions("c", "seg", "at")
    traced = traced.mapInArrow(_traced, "c string, at long, seg long, edits array<string>, rest array<string>").checkpoint()
    entries = traced.where("rest is not null").join(many, "c", "left_semi").groupBy("c").applyInArrow(_forwards, schema(entry="int"))
    way = F.coalesce("entry", F.lit(0))
    picked = traced.join(entries, ["c", "seg"], "left").select("at", F.get("edits", way).alias("edits"), F.substring(F.get("rest", way), 2, 9).alias("rest"))
    last = traced.where("rest is not null").groupBy("c").agg(F.max("at").alias("at")).select("at", F.lit(True).alias("__last"))
    picked = picked.join(last, "at", "left").select("at", "edits", F.when(F.col("__last"), F.col("rest")).otherwise("").alias("rest"))
    whole = t.select("c", "at", "n", "role", "text").join(rows.select("at", "initial", "fault"), "at").join(picked, "at")
    digests = whole.repartition("c").sortWithinPartitions("c", "at").mapInArrow(_in_order, "c string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
    gaps = t.groupBy("c").agg((F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")).alias("gaps"))
    name = df.select(F.col(conv)).distinct().withColumn("c", F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit("")))
    return name.join(digests, "c", "left").join(gaps, "c", "left").select(conv, F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
