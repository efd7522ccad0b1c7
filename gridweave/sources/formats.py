"""Formats of one's own, read and written in parallel as Python data sources."""

from __future__ import annotations

import json
import uuid
from abc import ABC, abstractmethod
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs, ipc
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

LISTING = "_files.json"


class TableFormat(ABC):
    """How one file of a format says its schema, is cut into parts, read and written.

    Subclasses say so for one open file; where files lie, which belong to a table, and what happens to them when a task or a job
    fails is settled here, the same for all formats. ``name`` is the data source's, ``suffix`` that of paths. Subclasses live in a module
    that executors can import.
    """

    name: str
    suffix: str

    @abstractmethod
    def schema(self, file: pa.NativeFile) -> pa.Schema: ...

    def parts(self, file: pa.NativeFile) -> int:
        """Into how many parts a file can be cut that are read by themselves."""
        return 1

    @abstractmethod
    def read(self, file: pa.NativeFile, part: int) -> Iterator[pa.RecordBatch]: ...

    @abstractmethod
    def write(self, file: pa.NativeFile, schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> int:
        """Writes all batches, gives the number of rows."""


class ArrowFiles(TableFormat):
    """Arrow IPC files; a part is a record batch."""

    name, suffix = "arrow_files", ".arrow"

    def schema(self, file):
        return ipc.open_file(file).schema

    def parts(self, file):
        return ipc.open_file(file).num_record_batches

    def read(self, file, part):
        yield ipc.open_file(file).get_batch(part)

    def write(self, file, schema, batches):
        rows = 0
        with ipc.new_file(file, schema) as out:
            for batch in batches:
                out.write_batch(batch.cast(schema))
                rows += batch.num_rows
        return rows


@dataclass
class FilePart(InputPartition):
    path: str
    part: int


@dataclass
class Written(WriterCommitMessage):
    path: str
    parts: int
    rows: int


class Folder:
    """A table's folder: its listing names the files that belong to it, so a table changes when its listing is replaced."""

    def __init__(self, path: str):
        self.system, self.root = fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def files(self) -> list[dict]:
        if self.system.get_file_info(self.at(LISTING)).type == fs.FileType.NotFound:
            return []
        with self.system.open_input_stream(self.at(LISTING)) as f:
            return json.loads(f.read())["files"]

    def list_files(self, files: list[dict]) -> None:
        fresh = self.at(f"{LISTING}-{uuid.uuid4().hex}")
        with self.system.open_output_stream(fresh) as f:
            f.write(json.dumps({"files": files}).encode())
        self.system.move(fresh, self.at(LISTING))

    def drop(self, folder: str) -> None:
        if self.system.get_file_info(self.at(folder)).type != fs.FileType.NotFound:
            self.system.delete_dir(self.at(folder))


class _Reader(DataSourceReader):
    def __init__(self, kind: TableFormat, path: str):
        self.kind, self.path = kind, path

    def partitions(self):
        found = [FilePart(f["path"], part) for f in Folder(self.path).files() for part in range(f["parts"])]
        return found or [FilePart("", 0)]

    def read(self, partition):
        if partition.path:
            folder = Folder(self.path)
            with folder.system.open_input_file(folder.at(partition.path)) as file:
                yield from self.kind.read(file, partition.part)


class _Writer(DataSourceArrowWriter):
    """Each task writes one file into the job's folder; the job's commit puts those of the tasks that won into the listing.

    Until then nothing of a job is part of the table; when it fails, its folder goes. Files of tasks that ran twice or
    broke off are no part of a message, and go with the commit.
    """

    def __init__(self, kind: TableFormat, path: str, schema: StructType, overwrite: bool):
        self.kind, self.path, self.overwrite = kind, path, overwrite
        self.schema = to_arrow_schema(schema.toNullable())
        self.job = f"files-{uuid.uuid4().hex}"
        folder = Folder(path)
        folder.system.create_dir(folder.at(self.job), recursive=True)

    def write(self, iterator):
        folder = Folder(self.path)
        name = f"{self.job}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}{self.kind.suffix}"
        with folder.system.open_output_stream(folder.at(name)) as file:
            rows = self.kind.write(file, self.schema, iterator)
        with folder.system.open_input_file(folder.at(name)) as file:
            return Written(name, self.kind.parts(file), rows)

    def commit(self, messages):
        folder = Folder(self.path)
        new = [{"path": m.path, "parts": m.parts, "rows": m.rows} for m in messages if m is not None]
        # A file without rows is kept only if a table would have no file to say its schema.
        old = [] if self.overwrite else folder.files()
        full = [f for f in new if f["rows"]]
        listed = full or ([] if old else new[:1])
        replaced = {f["path"].split("/")[0] for f in folder.files()} if self.overwrite else set()
        kept = {f["path"] for f in listed}
        folder.list_files(old + listed)
        for info in folder.system.get_file_info(fs.FileSelector(folder.at(self.job), allow_not_found=True)):
            if f"{self.job}/{info.base_name}" not in kept:
                folder.system.delete_file(info.path)
        for name in replaced:
            folder.drop(name)

    def abort(self, messages):
        Folder(self.path).drop(self.job)


def data_source(kind: TableFormat) -> type[DataSource]:
    """A data source class for a format."""

    class FormatSource(DataSource):
        @classmethod
        def name(cls):
            return kind.name

        def schema(self):
            folder = Folder(self.options["path"])
            files = folder.files()
            if not files:
                raise ValueError(f"no table of format {kind.name} at {self.options['path']}")
            with folder.system.open_input_file(folder.at(files[0]["path"])) as file:
                return from_arrow_schema(kind.schema(file)).toNullable()  # later files of a table may hold nulls

        def reader(self, schema):
            return _Reader(kind, self.options["path"])

        def writer(self, schema, overwrite):
            return _Writer(kind, self.options["path"], schema, overwrite)

    return FormatSource


def register_format(spark: SparkSession, kind: TableFormat) -> None:
    """Let ``spark.read.format(kind.name)``, :func:`open_table` and :func:`write_table` read and write a format of one's own.

    A table is a folder that all executors share, of one file per task that wrote to it. Overwriting and appending change it all at once, by its
    listing; two jobs that append at the same time are not kept apart. The suffix must not be taken.
    """
    from gridweave.sources.tables import add_format

    spark.dataSource.register(data_source(kind))
    add_format(kind.suffix, kind.name)
