"""Execution events as a stream: sessions, live warnings, upserts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

EVENTS = "nb_id long, seq long, cell_id string, document_index int, execution_count int, kernel_id string, restart boolean, source_hash string, ts timestamp"
_OUT = "kind string, nb_id long, seq long, cell_id string, session_no long, out_of_doc_order boolean, rerun_kind string, events long, cells long"
_SESSION = "session_no long, kernel_id string, last_count int, max_index int, last_seq long, last_ms long, events long"
_CELL = "source_hash string, runs long"
#: How long after its last event a session ends, and a notebook is forgotten.
IDLE_MS, FORGET_MS = 30 * 60_000, 7 * 24 * 3600_000


def read(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A stream of event files."""
    return spark.readStream.format(fmt).schema(EVENTS).load(path)


class Sessions(StatefulProcessor):
    """A notebook's open session: one value, and an entry for each cell that ran in it; timers end it and, later, forget the notebook."""

    def __init__(self, idle_ms: int, forget_ms: int):
        self.idle, self.forget = idle_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", _SESSION)
        self.cells = handle.getMapState("cells", "cell_id string", _CELL)

    def _closed(self, nb, no, events, n) -> tuple:
        return "closed", nb, None, None, no, None, None, events, n

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # each call to the store is a round trip: what is known is read once, what has changed is written once
        known = self.session.get()
        no, kernel, count, most, last, at, events = known or (0, None, 0, -1, -1, None, 0)
        stored = {k[0]: (v[0], v[1]) for k, v in self.cells.iterator()} if events else {}
        cells, kept = dict(stored), True
        frames = list(rows)
        d = (frames[0] if len(frames) == 1 else pd.concat(frames)).sort_values("seq", kind="stable")
        times = (d["ts"].to_numpy().astype("datetime64[ns]").astype(np.int64) // 1_000_000).tolist()
        counts = [0 if pd.isna(n) else int(n) for n in d["execution_count"].tolist()]
        out = []
        for seq, cell, index, n, new_kernel, restart, source, ms in zip(*(d[c].tolist() for c in ("seq", "cell_id", "document_index")), counts, *(d[c].tolist() for c in ("kernel_id", "restart", "source_hash")), times, strict=True):
            if seq <= last:
                continue
            if last >= 0 and (bool(restart) or new_kernel != kernel or (n == 1 and count > 1) or ms - at > self.idle or not events):
                if events:
                    out.append(self._closed(key[0], no, events, len(cells)))
                no, most, events, cells, kept = no + 1, -1, 0, {}, False
            before = cells.get(cell)
            kind = "first" if before is None else "identical" if before[0] == source else "edited"
            cells[cell] = (source, 1 if before is None else before[1] + 1)
            events += 1
            out.append(("event", key[0], int(seq), cell, no, 0 <= index < most, kind, None, None))
            kernel, count, most, last, at = new_kernel, n, max(most, int(index)), int(seq), ms
        if out:
            if stored and not kept:
                self.cells.clear()
            for cell, value in cells.items():
                if not kept or stored.get(cell) != value:
                    self.cells.updateValue((cell,), value)
            self.session.update((no, kernel, count, most, last, at, events))
        if at is not None:
            if known:
                for t in list(self.handle.listTimers()):
                    self.handle.deleteTimer(t)
            self.handle.registerTimer(at + self.idle)
        yield pd.DataFrame(out, columns=_NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.session.exists():
            no, kernel, count, most, last, at, events = self.session.get()
            if expiredTimerInfo.getExpiryTimeInMs() >= at + self.forget:
                self.session.clear()
                self.cells.clear()
            elif events:
                out.append(self._closed(key[0], no, events, sum(1 for _ in self.cells.keys())))
                self.cells.clear()
                # numbers go on, and repeats are still known, until the notebook is forgotten
                self.session.update((no, kernel, count, -1, last, at, 0))
                self.handle.registerTimer(at + self.forget)
        yield pd.DataFrame(out, columns=_NAMES)

    def close(self) -> None:
        pass


_NAMES = [c.strip().split(" ")[0] for c in _OUT.split(",")]


def live(events: DataFrame, late: str = "10 minutes", idle_ms: int = IDLE_MS, forget_ms: int = FORGET_MS) -> DataFrame:
    """Events with their session's number and warnings as they come, and a row of kind `closed` with its counts for each session that ends.

    A session ends on restart, with another kernel, when the count goes back to
    1, or idle_ms after its last event: at the next event if that comes, else by
    a timer of event time, which also drops the session's cells. forget_ms after
    its last event a notebook's number starts anew. Events behind the watermark
    are dropped, and so are events not after the last of their notebook. State
    is a value for each notebook and an entry for each cell of open sessions;
    the session has to keep it in RocksDB (spark.sql.streaming.stateStore.providerClass).
    """
    return events.withWatermark("ts", late).groupBy("nb_id").transformWithStateInPandas(Sessions(idle_ms, forget_ms), _OUT, "Append", "EventTime")


def windowed(events: DataFrame, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Runs per cell and tumbling window; events later than the watermark are dropped, repeats too."""
    e = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["nb_id", "seq"])
    return e.groupBy(F.window("ts", size), "cell_id").agg(F.count("*").alias("runs"))


#: Folders that the session store is dealt to, by a hash of the notebook; a batch rewrites those that it touches.
PLACES = 64


def upsert(spark: SparkSession, path: str):
    """A batch writer that keeps one row per (nb_id, session_id): the incoming one wins. Use with foreachBatch.

    The store is one folder for each of PLACES hashes of the notebook, with a
    folder for each batch that changed it; what a batch does not touch is not
    read. A mark tells that a batch was written to its end: it is skipped when it
    comes again, and one that broke off is written again. Folders but the last
    two of a place are deleted.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        from ..operators.trace import merge_sessions, sanitize_sessions

        if epoch in _entries(spark, f"{path}/done", "e="):
            return
        new = sanitize_sessions(batch).withColumn("place", F.pmod(F.xxhash64("nb_id"), F.lit(PLACES)).cast("int"))
        for r in new.select("place").distinct().orderBy("place").collect():  # at most PLACES
            own, home = new.where(F.col("place") == r["place"]).drop("place"), f"{path}/place={r['place']}"
            before = [v for v in _versions(spark, home) if v < epoch]
            old = spark.read.parquet(f"{home}/v={before[-1]}") if before else own.limit(0)
            merge_sessions(old, own).write.mode("overwrite").parquet(f"{home}/v={epoch}")
            for v in before[:-1]:
                _fs(spark, home)[0].delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{home}/v={v}"), True)
        fs, mark = _fs(spark, f"{path}/done/e={epoch}")
        fs.mkdirs(mark)

    return write


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _entries(spark: SparkSession, path: str, prefix: str) -> list[int]:
    fs, p = _fs(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix))


def _versions(spark: SparkSession, home: str) -> list[int]:
    """A place's batches that were written to their end, ascending."""
    fs, p = _fs(spark, home)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return [v for v in _entries(spark, home, "v=") if fs.exists(path(f"{home}/v={v}/_SUCCESS"))]


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The store: the last batch of each place."""
    return spark.read.parquet(*(f"{path}/place={p}/v={_versions(spark, f'{path}/place={p}')[-1]}" for p in _entries(spark, path, "place=")))
