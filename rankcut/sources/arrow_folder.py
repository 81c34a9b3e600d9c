"""Folders of Arrow IPC stream files, as dataset libraries save them, as a Spark data source.

A folder holds ``*.arrow`` files and a ``state.json`` that lists them in order. A file is one partition and is read batch by
batch; only the columns of the schema that Spark asks for leave it. Written files carry names of their own, and the list
is written when all tasks have ended, so files of tasks that were lost or repeated are never read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

NAME = "arrow_folder"
STATE = "state.json"


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path inside it; a path without a scheme is a folder that all machines mount."""
    parts = urlparse(path)
    return (pafs.LocalFileSystem(), parts.path) if parts.scheme in ("", "file") else pafs.FileSystem.from_uri(path)


def data_files(path: str) -> list[str]:
    """The folder's files in their order: as its list says, else all that end in ``.arrow`` by name."""
    fs, root = _filesystem(path)
    listed = fs.get_file_info(f"{root}/{STATE}")
    if listed.type == pafs.FileType.File:
        with fs.open_input_stream(f"{root}/{STATE}") as f:
            return [f"{root}/{x['filename']}" for x in json.loads(f.read())["_data_files"]]
    found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    return sorted(i.path for i in found if i.type == pafs.FileType.File and i.path.endswith(".arrow"))


@dataclass
class _File(InputPartition):
    file: str


@dataclass
class _Written(WriterCommitMessage):
    file: str
    rows: int


class ArrowFolder(DataSource):
    """``spark.read.format("arrow_folder").load(path)``; with ``.schema(...)`` only the named columns are read."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def _path(self) -> str:
        return self.options["path"].rstrip("/")

    def schema(self) -> StructType:
        files = data_files(self._path())
        if not files:
            raise ValueError(f"no Arrow files in {self._path()}")
        fs, _ = _filesystem(self._path())
        with fs.open_input_stream(files[0]) as f, pa.ipc.open_stream(f) as stream:
            return from_arrow_schema(stream.schema)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self._path(), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self._path(), schema, overwrite)


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.wanted = path, schema

    def partitions(self) -> list[InputPartition]:
        return [_File(f) for f in data_files(self.path)]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(self.wanted)
        if not isinstance(partition, _File):  # an empty folder has one partition of nothing
            return
        fs, _ = _filesystem(self.path)
        with fs.open_input_stream(partition.file) as f, pa.ipc.open_stream(f) as stream:
            for batch in stream:
                yield pa.RecordBatch.from_arrays([batch.column(c.name).cast(c.type) for c in target], schema=target)


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool) -> None:
        self.path, self.kept = path, schema
        self.before = [] if overwrite else [f.rpartition("/")[2] for f in data_files(path)]  # on the driver, before any task

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = _filesystem(self.path)
        fs.create_dir(root, recursive=True)
        file, rows = f"data-{uuid.uuid4().hex}.arrow", 0
        target = to_arrow_schema(self.kept)
        with fs.open_output_stream(f"{root}/{file}") as f, pa.ipc.new_stream(f, target) as out:
            for batch in iterator:
                out.write_batch(pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip(batch.columns, target)], schema=target))
                rows += batch.num_rows
        return _Written(file, rows)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _filesystem(self.path)
        done = [m for m in messages if m is not None]
        files = [*self.before, *[m.file for m in done if m.rows]] or [m.file for m in done][:1]
        with fs.open_output_stream(f"{root}/{STATE}") as f:
            f.write(json.dumps({"_data_files": [{"filename": x} for x in files]}).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Files that no list names are never read."""


def read_arrow_folder(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """Rows of an Arrow dataset folder; with ``schema``, only its columns leave the files."""
    spark.dataSource.register(ArrowFolder)
    reader = spark.read.format(NAME)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write_arrow_folder(df: DataFrame, path: str, mode: str = "append") -> None:
    """One Arrow file per task, and the list of them."""
    df.sparkSession.dataSource.register(ArrowFolder)
    df.write.format(NAME).mode(mode).save(path)
