"""One binary file per row: the sink behind image folders.

``write_files`` is a Python data source: every task writes its own rows, straight to the folder
named by the caller. A file appears by a rename, whole or not at all, under a name that only its row decides, so a task that
runs again (a lost executor, a speculative copy) puts the same bytes in the same place. The tasks'
commit messages hold counts only; the driver adds them up and leaves ``_SUCCESS.json`` with the
totals as the last act. A folder without it was not written to the end; the same write again
completes it.

Defined cases: a null path or a null content writes nothing and is counted as skipped; two rows
with one path, a path that is empty, absolute or leads out of the folder raise an error; an empty table
leaves a marker with zeros.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from tonality.session import ship_package

MARKER = "_SUCCESS.json"
PENDING = "_pending"  # Spark's readers pass over names that begin with an underscore


def file_system(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder named by path or URI (``/x``, ``file:/x``, ``file:///x``, ``hdfs://...``), and its path there."""
    if root.startswith("file:"):
        return fs.LocalFileSystem(), "/" + root[len("file:"):].lstrip("/")
    if "://" in root:
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), os.path.abspath(root)


def _bad(path: str) -> bool:
    return not path or path.startswith("/") or any(part in ("", ".", "..") for part in path.split("/"))


@dataclass
class Written(WriterCommitMessage):
    files: int
    bytes: int
    skipped: int


class FilesWriter(DataSourceArrowWriter):
    def __init__(self, root: str) -> None:
        self.root = root

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, base = file_system(self.root)
        pending = f"{base}/{PENDING}/{uuid.uuid4().hex}"
        system.create_dir(pending, recursive=True)
        done, folders = Written(0, 0, 0), set()
        for batch in iterator:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                if path is None or content is None:
                    done.skipped += 1
                    continue
                if _bad(path):
                    raise ValueError(f"not a path below the folder: {path!r}")
                folder = os.path.dirname(f"{base}/{path}")
                if folder not in folders:
                    system.create_dir(folder, recursive=True)
                    folders.add(folder)
                with system.open_output_stream(f"{pending}/file") as out:
                    out.write(content)
                system.move(f"{pending}/file", f"{base}/{path}")
                done.files += 1
                done.bytes += len(content)
        return done

    def commit(self, messages: list[Written | None]) -> None:
        system, base = file_system(self.root)
        self._drop_pending(system, base)
        system.create_dir(base, recursive=True)
        sums = {name: sum(getattr(m, name) for m in messages if m) for name in ("files", "bytes", "skipped")}
        with system.open_output_stream(f"{base}/{MARKER}") as out:
            out.write(json.dumps(sums).encode())

    def abort(self, messages: list[Written | None]) -> None:
        self._drop_pending(*file_system(self.root))

    @staticmethod
    def _drop_pending(system: fs.FileSystem, base: str) -> None:
        if system.get_file_info(f"{base}/{PENDING}").type == fs.FileType.Directory:
            system.delete_dir(f"{base}/{PENDING}")


class FilesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tonality_row_files"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"])


def write_files(df: DataFrame, root: str, path_col: str = "path", content_col: str = "content") -> dict[str, int]:
    """Write the bytes in ``content_col`` to ``root/<path_col>``, one file per row; ``files, bytes, skipped``.

    The paths alone are shuffled, to refuse two rows with one path before anything is written.
    """
    spark = df.sparkSession
    ship_package(spark)
    rows = df.select(F.col(path_col).cast("string").alias("path"), F.col(content_col).cast("binary").alias("content"))
    twice = rows.where("path IS NOT NULL AND content IS NOT NULL").groupBy("path").count().where("count > 1").select("path").first()
    if twice:
        raise ValueError(f"several rows have the path {twice.path!r}")
    system, base = file_system(root)
    if system.get_file_info(f"{base}/{MARKER}").type == fs.FileType.File:
        system.delete_file(f"{base}/{MARKER}")  # until this write has ended, the folder is not whole
    spark.dataSource.register(FilesSource)
    rows.write.format(FilesSource.name()).mode("append").save(root)
    return committed(spark, root)


def committed(spark: SparkSession, root: str) -> dict[str, int] | None:
    """The totals of the write that completed the folder; None if none did."""
    system, base = file_system(root)
    if system.get_file_info(f"{base}/{MARKER}").type != fs.FileType.File:
        return None
    with system.open_input_stream(f"{base}/{MARKER}") as f:
        return json.loads(f.read())
