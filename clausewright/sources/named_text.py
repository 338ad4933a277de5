"""A data source that writes rows (file, value) as text files of those names, and reads them back: many files a task, all of them or none.

A task writes into a folder of its own that readers pass over; a commit renames the tasks' folders, an abort removes them.
So there is a folder a task, not one a file, and a task that ran twice leaves one result. Paths are URIs that Arrow's file
systems know (file, s3, gs, hdfs where its library is there), on a folder that driver and executors share.
"""

from __future__ import annotations

import fnmatch
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

# Files beside the folders that one task reads; files, and bytes of them, in a batch.
FILES_A_TASK, FILES_A_BATCH, BYTES_A_BATCH = 500, 500, 4_000_000


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


@dataclass
class _Written(WriterCommitMessage):
    folder: str


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.run = path, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        system, base = _opened(self.path)
        name = uuid.uuid4().hex
        folder = f"{base}/_pending-{self.run}/{name}"
        system.create_dir(folder, recursive=True)
        for row in iterator:
            if row.file is None or "/" in row.file or row.file.startswith((".", "_")):
                raise ValueError(f"{row.file!r} is no file's name")
            with system.open_output_stream(f"{folder}/{row.file}") as out:
                out.write((row.value or "").encode())
        return _Written(name)

    def commit(self, messages: list) -> None:
        system, base = _opened(self.path)
        for message in messages:
            if message is not None:
                system.move(f"{base}/_pending-{self.run}/{message.folder}", f"{base}/part-{message.folder}")
        self._clear(system, base)

    def abort(self, messages: list) -> None:
        self._clear(*_opened(self.path))

    def _clear(self, system: fs.FileSystem, base: str) -> None:
        if system.get_file_info(f"{base}/_pending-{self.run}").type != fs.FileType.NotFound:
            system.delete_dir(f"{base}/_pending-{self.run}")


@dataclass
class _Part(InputPartition):
    folder: str | None
    files: list[str]


class _Reader(DataSourceReader):
    """A folder right below the path is a task, which lists it itself, so the driver sees no more than the first level."""

    def __init__(self, path: str, names: str):
        self.path, self.names = path, names

    def _wanted(self, info: fs.FileInfo) -> bool:
        return info.type == fs.FileType.File and info.size > 0 and not info.base_name.startswith((".", "_")) and fnmatch.fnmatchcase(info.base_name, self.names)

    def partitions(self) -> list[_Part]:
        system, base = _opened(self.path)
        found = sorted(system.get_file_info(fs.FileSelector(base)), key=lambda x: x.path)
        here = [x.path for x in found if self._wanted(x)]
        parts = [_Part(x.path, []) for x in found if x.type == fs.FileType.Directory and not x.base_name.startswith((".", "_"))]
        return (parts + [_Part(None, here[i : i + FILES_A_TASK]) for i in range(0, len(here), FILES_A_TASK)]) or [_Part(None, [])]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        system, _ = _opened(self.path)
        folders, names, values, size = [partition.folder] if partition.folder else [], [], [], 0
        paths = iter(partition.files)
        while True:
            for path in paths:
                with system.open_input_stream(path) as opened:
                    names.append(path.rsplit("/", 1)[-1])
                    values.append(opened.read().decode("utf-8", "replace"))
                size += len(values[-1])
                if len(names) >= FILES_A_BATCH or size >= BYTES_A_BATCH:
                    yield pa.RecordBatch.from_pydict({"file": names, "value": values})
                    names, values, size = [], [], 0
            if not folders:
                break
            inside = system.get_file_info(fs.FileSelector(folders.pop()))
            folders += [x.path for x in inside if x.type == fs.FileType.Directory and not x.base_name.startswith((".", "_"))]
            paths = iter([x.path for x in inside if self._wanted(x)])
        if names:
            yield pa.RecordBatch.from_pydict({"file": names, "value": values})


class NamedText(DataSource):
    """``df.write.format("named_text")`` of (file, value), and ``spark.read`` of it with ``names``, a glob of file names."""

    @classmethod
    def name(cls) -> str:
        return "named_text"

    def schema(self) -> str:
        return "file string, value string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("names", "*"))


def write_named(files: DataFrame, path: str) -> None:
    """Write rows (file, value) below a path; names are used once."""
    files.sparkSession.dataSource.register(NamedText)
    files.select("file", "value").write.format("named_text").mode("append").option("path", path).save()


def read_named(spark, path: str, names: str) -> DataFrame:
    """file, value of all text files below a path whose names match a glob; other files, hidden and empty ones aren't opened.

    Spark's text reader takes milliseconds a file; it is left for file systems that Arrow doesn't know.
    """
    try:
        _opened(path)
    except pa.ArrowInvalid:
        texts = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", names).text(path, wholetext=True)
        return texts.selectExpr("_metadata.file_name as file", "value")
    spark.dataSource.register(NamedText)
    return spark.read.format("named_text").option("path", path).option("names", names).load()
