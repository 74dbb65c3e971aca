"""A data source that writes rows as files of their own: `df.write.format("rawfiles").save(root)`."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import BinaryType, StringType, StructType

NAME = "rawfiles"


@dataclass
class Written(WriterCommitMessage):
    files: int
    size: int


def _file_system(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")


def _safe(rel_path: str) -> str:
    """A path that stays below the root."""
    parts = rel_path.split("/")
    if rel_path.startswith("/") or "" in parts or ".." in parts or "." in parts or "\\" in rel_path:
        raise ValueError(f"not a path below the root: {rel_path!r}")
    return rel_path


class RawFileWriter(DataSourceArrowWriter):
    """A task writes each row under a hidden name, then renames it, so that no reader sees half a
    file. A task that runs again writes the same names with the same bytes."""

    def __init__(self, root: str):
        self.root = root

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, root = _file_system(self.root)
        made: set[str] = set()
        files = size = 0
        for batch in batches:
            for path, content in zip(batch.column("rel_path").to_pylist(), batch.column("content"), strict=True):
                if path is None:
                    raise ValueError("rel_path is null")
                folder, _, name = f"{root.rstrip('/')}/{_safe(path)}".rpartition("/")
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                data = content.as_py() or b""
                hidden = f"{folder}/.{uuid.uuid4().hex}.part"
                with system.open_output_stream(hidden) as out:
                    out.write(data)
                system.move(hidden, f"{folder}/{name}")
                files, size = files + 1, size + len(data)
        return Written(files, size)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """The files of finished tasks are in place already."""

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Files of finished tasks stay: each is whole, and another run writes over it."""


class RawFiles(DataSource):
    """Sink of rel_path (string, below the root, with /) and content (binary). Appends only: a file
    of the same name is replaced, others stay. The root is a path that all executors share."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        return StructType().add("rel_path", StringType()).add("content", BinaryType())

    def writer(self, schema: StructType, overwrite: bool) -> RawFileWriter:
        kinds = {f.name: f.dataType for f in schema}
        if kinds != {"rel_path": StringType(), "content": BinaryType()}:
            raise ValueError("rawfiles takes rel_path string and content binary")
        if overwrite:
            raise ValueError("rawfiles only appends")
        return RawFileWriter(self.options["path"])


def write_files(rows: DataFrame, root: str, rel_path: Column, content: Column) -> str:
    """Writes content (binary, or text as UTF-8; null is empty) of each row to root/rel_path and returns
    root. Runs a job. Of rows with one rel_path any one is left; a null or outside rel_path fails."""
    spark: SparkSession = rows.sparkSession
    spark.dataSource.register(RawFiles)
    slim = rows.select(rel_path.cast("string").alias("rel_path"), content.cast("binary").alias("content"))
    slim.write.format(NAME).mode("append").save(root)
    return root
