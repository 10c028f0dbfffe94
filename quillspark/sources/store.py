"""Notebook stores as a Spark source: files of a folder store, read by their place in a registry, in batches or as a stream.

    spark.dataSource.register(NotebookStore)
    spark.read.format("notebook_store").option("registry", list_file).option("start", 500).load(folder)
    spark.readStream.format("notebook_store").load(folder)

A registry is a text file with a name on each line, to which names are only
added; without one the folder's files in the order of their names count, so that
later files have to have later names. A place in it is an offset: a batch read
takes places from `start` to `end`, a stream goes on from the place that its
checkpoint holds, without loss or repeat. Files are read on the executors, each
task a run of places.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..operators.shared import dealt

SCHEMA = "idx long, line long, name string, content string, error string"
_ARROW = pa.schema([("idx", pa.int64()), ("line", pa.int64()), ("name", pa.string()), ("content", pa.string()), ("error", pa.string())])
#: Places to a task; rows to a batch of Arrow; fixed value: file names that count where there is no registry.
TASK, ROWS = 64, 256
KINDS = (".ipynb", ".jsonl")


def _open(path: str):
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


def names(path: str, registry: str | None = None) -> list[str]:
    """The store's names by place: the registry's lines, or the folder's notebooks and JSON lines below it, sorted."""
    import pyarrow.fs as pafs

    if registry:
        fs, at = _open(registry)
        with fs.open_input_stream(at) as f:
            return [x for x in f.read().decode().splitlines() if x.strip()]
    fs, at = _open(path)
    found = fs.get_file_info(pafs.FileSelector(at, recursive=True, allow_not_found=True))
    return sorted(x.path[len(at) :].lstrip("/") for x in found if x.is_file and x.path.endswith(KINDS) and not x.base_name.startswith((".", "_")))


def fault(text: str) -> str | None:
    """What keeps a text from being a notebook; null for nothing."""
    try:
        got = json.loads(text)
    except ValueError:
        return "NotJSON"
    return None if isinstance(got, dict) and isinstance(got.get("cells"), list) else "NotANotebook"


class Places(InputPartition):
    def __init__(self, start: int, chosen: list[str]):
        self.start, self.chosen = start, chosen


def _parted(every: list[str], start: int, end: int, tasks: int = 1) -> list[Places]:
    """Runs of TASK places, shorter ones where that makes fewer than `tasks`: a file can hold many notebooks."""
    step = max(1, min(TASK, (end - start) // tasks))
    return [Places(a, every[a : min(a + step, end)]) for a in range(start, end, step)]


def _read(path: str, places: Places) -> Iterator[pa.RecordBatch]:
    """A row for each notebook; a name that can't be read, or holds none, is a row with an error."""
    fs, top = _open(path)
    rows: list[tuple] = []

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)

    for idx, name in enumerate(places.chosen, places.start):
        try:
            with fs.open_input_stream(f"{top}/{name}") as f:
                text = f.read().decode("utf-8")
        except FileNotFoundError:
            rows.append((idx, 0, name, None, "NotFound"))
            continue
        except (OSError, UnicodeDecodeError) as e:
            rows.append((idx, 0, name, None, type(e).__name__))
            continue
        for line, one in enumerate([x for x in text.split("\n") if x.strip()] if name.endswith(".jsonl") else [text]):
            rows.append((idx, line, name, one, fault(one)))
            if len(rows) >= ROWS:
                yield flush()
                rows = []
    if rows:
        yield flush()


class NotebookStore(DataSource):
    """Options: path, registry, start, end."""

    @classmethod
    def name(cls) -> str:
        return "notebook_store"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> StoreReader:
        return StoreReader(self.options)

    def streamReader(self, schema) -> StoreStream:
        return StoreStream(self.options)


class StoreReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.registry = options["path"], options.get("registry")
        self.start, self.end, self.tasks = int(options.get("start", 0)), options.get("end"), int(options.get("tasks", 1))

    def partitions(self) -> list[Places]:
        every = names(self.path, self.registry)
        end = len(every) if self.end is None else min(len(every), int(self.end))
        return _parted(every, self.start, end, self.tasks) or [Places(0, [])]

    def read(self, partition: Places) -> Iterator[pa.RecordBatch]:
        return _read(self.path, partition)


class StoreStream(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.registry, self.start = options["path"], options.get("registry"), int(options.get("start", 0))

    def initialOffset(self) -> dict:
        return {"place": self.start}

    def latestOffset(self) -> dict:
        return {"place": max(self.start, len(names(self.path, self.registry)))}

    def partitions(self, start: dict, end: dict) -> list[Places]:
        return _parted(names(self.path, self.registry), start["place"], end["place"])

    def read(self, partition: Places) -> Iterator[pa.RecordBatch]:
        return _read(self.path, partition)


def load(spark: SparkSession, path: str, registry: str | None = None, start: int = 0, end: int | None = None, tasks: int = 1) -> DataFrame:
    """(idx, line, name, content, error) of the places from start to end, in `tasks` tasks at least where there are as many places."""
    spark.dataSource.register(NotebookStore)
    options = {"start": str(start), "tasks": str(tasks)} | ({"registry": registry} if registry else {}) | ({"end": str(end)} if end is not None else {})
    return spark.read.format("notebook_store").options(**options).load(path)


def stream(spark: SparkSession, path: str, registry: str | None = None, start: int = 0) -> DataFrame:
    """The store's notebooks as they come."""
    spark.dataSource.register(NotebookStore)
    options = {"start": str(start)} | ({"registry": registry} if registry else {})
    return spark.readStream.format("notebook_store").options(**options).load(path)


def add(cells: DataFrame, path: str, part: int) -> None:
    """Adds the notebooks of cells(nb_id, document_index, cell_id, source, ...) to a store, a line of JSON each, in files whose names follow those of lower parts.

    Spark writes the files, in a folder of their own until they are whole; then
    they get their names.
    """
    cell = F.struct(F.lit("code").alias("cell_type"), F.col("cell_id").alias("id"), "source")
    every = F.transform(F.array_sort(F.collect_list(F.struct("document_index", cell.alias("cell")))), lambda x: x["cell"])
    notebook = F.to_json(F.struct(F.col("nb_id").cast("string").alias("name"), "cells"))
    spark, made = cells.sparkSession, f"{path}/_made-{uuid.uuid4().hex}"
    # in files enough to be read side by side
    dealt(cells.groupBy("nb_id").agg(every.alias("cells")), "nb_id").select(notebook.alias("value")).write.text(made)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(made).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop(f"{path}/part-{part:06d}"))
    for i, name in enumerate(sorted(n for s in fs.listStatus(hadoop(made)) if (n := s.getPath().getName()).startswith("part-"))):
        fs.rename(hadoop(f"{made}/{name}"), hadoop(f"{path}/part-{part:06d}/{i:06d}.jsonl"))
    fs.delete(hadoop(made), True)
