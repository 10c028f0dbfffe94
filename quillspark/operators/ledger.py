"""A mining run that can break off and go on: epochs over a store's places, each added to a ledger once.

A ledger is a folder of data and a folder of marks. Mark n is a small file that
names the data in force and how far the run has come; it is put in place under
its final name by one rename that fails if the name is taken. Data that no mark
names does not count, so a run that ends between data and mark leaves nothing
behind but files, and the epoch is done again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Marks after which the ledger's data is rewritten as one.
COMPACT = 64


class Ledger:
    """rows: one for each notebook that was looked at, with its epoch; `kept` says which to keep."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _marks(self) -> list[int]:
        home = self._hadoop.Path(f"{self.path}/marks")
        found = [s.getPath().getName() for s in self._fs.listStatus(home)] if self._fs.exists(home) else []
        return sorted(int(n) for n in found if n.isdigit())

    def state(self) -> dict:
        """The last mark: epoch, next place, counts, and the data in force."""
        marks = self._marks()
        if not marks:
            return {"mark": -1, "epoch": -1, "next": 0, "processed": 0, "kept": 0, "data": []}
        # a mark's file is small: it is read whole
        text = self.spark.read.text(f"{self.path}/marks/{marks[-1]:012d}", wholetext=True).first()["value"]
        return json.loads(text) | {"mark": marks[-1]}

    def _mark(self, state: dict) -> bool:
        """Puts the mark after state's in place; false if another run did."""
        there = self._hadoop.Path(f"{self.path}/marks/{state['mark'] + 1:012d}")
        ready = self._hadoop.Path(f"{self.path}/ready/{uuid.uuid4().hex}")
        out = self._fs.create(ready, False)
        out.write(bytearray(json.dumps({k: v for k, v in state.items() if k != "mark"}).encode()))
        out.close()
        self._fs.mkdirs(there.getParent())
        gateway = self.spark.sparkContext._gateway
        none = gateway.new_array(self._hadoop.Options.Rename, 1)
        none[0] = self._hadoop.Options.Rename.NONE
        context = self._hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(self._fs.makeQualified(ready), self._fs.makeQualified(there), none)
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            self._fs.delete(ready, False)
            return False
        return True

    def rows(self) -> DataFrame | None:
        """The ledger; none before the first epoch."""
        data = self.state()["data"]
        return self.spark.read.parquet(*(f"{self.path}/data/{d}" for d in data)) if data else None

    def _write(self, rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{self.path}/data/{name}")
        return self.spark.read.parquet(f"{self.path}/data/{name}")

    def append(self, rows: DataFrame, epoch: int, following: int | None = None) -> bool:
        """Adds an epoch's rows, once: false, without a look at them, if the epoch is there already."""
        before = self.state()
        if epoch <= before["epoch"]:
            return False
        name = f"e{epoch:09d}-{uuid.uuid4().hex}"
        made = self._write(rows.withColumn("epoch", F.lit(epoch).cast("long")), name)
        n, kept = made.agg(F.count("*"), F.count_if("kept")).first()
        after = before | {"epoch": epoch, "next": before["next"] if following is None else following, "processed": before["processed"] + n, "kept": before["kept"] + kept, "data": [*before["data"], name]}
        if not self._mark(after):
            return self.append(rows, epoch, following)
        if len(after["data"]) >= COMPACT:
            self.compact()
        return True

    def compact(self) -> None:
        """Rewrites the data in force as one; readers of an older mark still have theirs until clean()."""
        before = self.state()
        if len(before["data"]) > 1:
            name = f"c{before['mark']:09d}-{uuid.uuid4().hex}"
            self._write(self.rows(), name)
            self._mark(before | {"data": [name]})

    def clean(self) -> int:
        """Deletes data that the last mark does not name, of broken and rewritten epochs; how many. For when no run is on."""
        home, live = self._hadoop.Path(f"{self.path}/data"), set(self.state()["data"])
        gone = [s.getPath() for s in self._fs.listStatus(home) if s.getPath().getName() not in live] if self._fs.exists(home) else []
        return sum(bool(self._fs.delete(p, True)) for p in gone)

    def writer(self) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: a batch that comes again is not added again."""
        return lambda batch, epoch: None if self.append(batch, epoch) else None


def mine(read: Callable[[int, int], DataFrame], size: int, judge: Callable[[DataFrame], DataFrame], ledger: Ledger, target: int | None = None, step: int = 1000) -> dict:
    """Looks at the places of a store in order until `target` notebooks are kept or none is left; goes on where the ledger ends.

    read(start, end) gives notebooks (idx, line, ...), judge(notebooks) a row for
    each with idx, line and kept. An epoch takes `step` places, at most; the one
    that reaches the target ends with the notebook that does, as one after the
    other would. The ledger's last state.
    """
    while True:
        state = ledger.state()
        if state["next"] >= size or target is not None and state["kept"] >= target:
            return state
        end = min(size, state["next"] + step)
        rows = judge(read(state["next"], end))
        if target is not None:
            rows = rows.checkpoint()
            left = target - state["kept"]
            kept = rows.where("kept").select("idx", "line").orderBy("idx", "line").limit(left).agg(F.count("*").alias("n"), F.max(F.struct("idx", "line")).alias("last")).first()
            if kept["n"] == left:
                at = kept["last"]
                rows = rows.where((F.col("idx") < at["idx"]) | (F.col("idx") == at["idx"]) & (F.col("line") <= at["line"]))
                end = at["idx"] + 1
        ledger.append(rows, state["epoch"] + 1, end)


def entries(notebooks: DataFrame, targets: list[str] | None = None) -> DataFrame:
    """(idx, line, source_id, success, kept, status_reason, edge_count, node_count, loc, density, ml_semantics, matched_libraries) of a store's notebooks: validated, then kept or not by the sampling rules.

    What can't be read is a row that failed by its error.
    """
    from ..sources.notebooks import cells_of
    from . import mining

    names = F.concat_ws(":", "name", F.when(F.col("name").endswith(".jsonl"), F.col("line").cast("string")))
    named = notebooks.withColumn("nb_id", names)
    metrics = mining.validate(cells_of(named.where("error is null").select("nb_id", F.col("content").alias("value"))).where("cell_type = 'code'"), targets)
    rows = named.select("idx", "line", "nb_id", "error").join(metrics, "nb_id", "left")
    failed = F.coalesce("error", "error_type", F.when(F.col("success").isNull(), F.lit("EmptyNotebook")))
    zero = lambda c, new: F.coalesce(c, F.lit(0)).cast("long").alias(new)
    rows = rows.select("idx", "line", F.col("nb_id").alias("source_id"), failed.isNull().alias("success"), failed.alias("error_type"), zero("edge_count", "edge_count"), zero("node_count", "node_count"), zero("lines_of_code", "loc"), F.coalesce("contains_ml_semantics", F.lit(False)).alias("ml_semantics"), F.coalesce("matched_libraries", F.array().cast("array<string>")).alias("matched_libraries"))
    file = F.element_at(F.split("source_id", "/"), -1)
    judged = mining.sample(rows.withColumn("__file", file), "__file", bool(targets))
    return judged.select("idx", "line", "source_id", "success", "kept", F.col("reason").alias("status_reason"), "error_type", "edge_count", "node_count", "loc", F.round(F.col("edge_count") / F.greatest("loc", F.lit(1)), 4).alias("density"), "ml_semantics", "matched_libraries")
