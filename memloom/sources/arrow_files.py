"""Arrow IPC files as a data source: a folder of files, read by slices of record batches and written whole or not at all.

Paths are those of pyarrow's filesystems: local and mounted ones, file:, hdfs:, s3: and gs: where pyarrow can reach them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Rows of a record batch that is written, and record batches that a task reads.
ROWS, BATCHES = 200, 64
COUNTS = "_counts.json"
#: Spark's setting of the rows that it hands to Python at once.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files(path: str) -> list[str]:
    """The folder's files in order of their names; a path that is a file is that one."""
    store, where = place(path)
    info = store.get_file_info(where)
    if info.type == fs.FileType.File:
        return [where]
    return sorted(x.path for x in store.get_file_info(fs.FileSelector(where)) if x.base_name.endswith(".arrow") and not x.base_name.startswith(("_", ".")))


@dataclass
class Slice(InputPartition):
    """Record batches of a file."""

    file: str
    first: int
    last: int


@dataclass
class Written(WriterCommitMessage):
    """A task's file, not yet in its place, its rows, and the rows that it left out."""

    name: str
    rows: int
    filtered: int


class Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.columns = path, [f.name for f in schema.fields]

    def partitions(self) -> list[Slice]:
        """Only footers are opened here."""
        store, out = place(self.path)[0], []
        for file in files(self.path):
            with store.open_input_file(file) as source:
                n = pa.ipc.open_file(source).num_record_batches
            out += [Slice(file, k, min(k + BATCHES, n)) for k in range(0, n, BATCHES)]
        return out

    def read(self, partition: Slice | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's one partition where there are none
            return
        with place(self.path)[0].open_input_file(partition.file) as source:
            held = pa.ipc.open_file(source, options=pa.ipc.IpcReadOptions(included_fields=self._places(source)))
            for k in range(partition.first, partition.last):
                yield held.get_batch(k).select(self.columns)

    def _places(self, source) -> list[int]:
        schema = pa.ipc.open_file(source).schema
        source.seek(0)
        return sorted(schema.get_field_index(c) for c in self.columns)


class Writer(DataSourceArrowWriter):
    """Each task writes a file under a name of its own; the commit names them in order, an abort and what a lost task has left go."""

    def __init__(self, path: str, required: str | None, overwrite: bool):
        self.path, self.required, self.overwrite, self.job = path, required, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        store, where = place(self.path)
        store.create_dir(where, recursive=True)
        name = f"_{self.job}-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        writer, rows, filtered, held, waiting = None, 0, 0, [], 0
        with store.open_output_stream(f"{where}/{name}") as sink:

            def flush(least: int) -> None:
                nonlocal writer, held, waiting
                if not waiting or waiting < least:
                    return
                table = pa.Table.from_batches(held).combine_chunks()
                if writer is None:
                    writer = pa.ipc.new_file(sink, table.schema)
                whole = waiting // ROWS * ROWS if least else waiting
                writer.write_table(table.slice(0, whole), max_chunksize=ROWS)
                held, waiting = table.slice(whole).to_batches(), waiting - whole

            for batch in iterator:
                schema = batch.schema
                if self.required:
                    kept = batch.filter(batch.column(schema.get_field_index(self.required)).is_valid())
                    filtered += batch.num_rows - kept.num_rows
                    batch = kept
                rows += batch.num_rows
                if batch.num_rows:
                    held.append(batch)
                    waiting += batch.num_rows
                flush(ROWS)
            flush(0)
            if writer is not None:
                writer.close()
        return Written(name if rows else "", rows, filtered)

    def _own(self) -> list[str]:
        store, where = place(self.path)
        return [x.path for x in store.get_file_info(fs.FileSelector(where, allow_not_found=True)) if x.base_name.startswith(f"_{self.job}-")]

    def commit(self, messages: list[Written | None]) -> None:
        store, where = place(self.path)
        store.create_dir(where, recursive=True)
        if self.overwrite:
            for file in files(self.path):
                store.delete_file(file)
        done = [m for m in messages if m is not None]
        names = sorted(m.name for m in done if m.name)
        for k, name in enumerate(names):
            store.move(f"{where}/{name}", f"{where}/part-{self.job}-{k:05d}.arrow")
        for file in self._own():
            store.delete_file(file)
        with store.open_output_stream(f"{where}/{COUNTS}") as sink:
            sink.write(json.dumps({"rows": sum(m.rows for m in done), "filtered": sum(m.filtered for m in done)}).encode())

    def abort(self, messages: list[Written | None]) -> None:  # noqa: ARG002
        for file in self._own():
            place(self.path)[0].delete_file(file)


class ArrowFiles(DataSource):
    """Options: path; for writing, required: a column whose null rows are left out and counted."""

    @classmethod
    def name(cls) -> str:
        return "arrow_files"

    def schema(self) -> StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        found = files(self.options["path"])
        if not found:
            raise ValueError(f"no Arrow files in {self.options['path']}")
        with place(self.options["path"])[0].open_input_file(found[0]) as source:
            return from_arrow_schema(pa.ipc.open_file(source).schema)

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:  # noqa: ARG002
        return Writer(self.options["path"], self.options.get("required"), overwrite)


def write_arrow(df: DataFrame, path: str, required: str | None = None) -> tuple[int, int]:
    """Writes the rows as Arrow IPC files in place of what is there: how many, and how many were left out for a null in `required`. Without rows the folder holds counts alone.

    While it writes, Spark hands over ROWS rows at a time, so that a task's Python holds a few of the batches that it writes and not the session's 10,000 rows, however long these are.
    """
    df.sparkSession.dataSource.register(ArrowFiles)
    out = df.write.format("arrow_files").mode("overwrite")
    conf = df.sparkSession.conf
    before = conf.get(BATCH_ROWS)
    conf.set(BATCH_ROWS, ROWS)
    try:
        (out.option("required", required) if required else out).save(path)
    finally:
        conf.set(BATCH_ROWS, before)
    store, where = place(path)
    with store.open_input_stream(f"{where}/{COUNTS}") as source:
        counts = json.loads(source.read())
    return counts["rows"], counts["filtered"]


def read_arrow(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The rows of a folder of Arrow IPC files, or of one; with a schema only its columns are read."""
    spark.dataSource.register(ArrowFiles)
    source = spark.read.format("arrow_files")
    return (source.schema(schema) if schema else source).load(path)
