"""Rows as files: a Python data source whose tasks commit.

``rows(name, content)`` are written as one file each below a folder. A task writes into a work folder of its own and
moves its files to their names when all of them are whole; one that fails takes its work folder away, so failed attempts
leave nothing. Moving over a file of the same name replaces it, so a repeated task leaves the same files.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FORMAT = "docflow_files"
WORK = "_work"


@dataclass
class Written(WriterCommitMessage):
    files: int
    bytes: int


class FilesWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def _opened(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path if ":/" in self.path else f"file://{self.path}")

    def write(self, iterator: Iterator) -> Written:
        store, top = self._opened()
        work, names, size = f"{top}/{WORK}/{uuid.uuid4().hex}", [], 0
        try:
            for batch in iterator:
                for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
                    if not name or name.startswith(("/", WORK)) or ".." in name.split("/"):
                        raise ValueError(f"not a file name below the folder: {name!r}")
                    if not names:
                        store.create_dir(work, recursive=True)
                    with store.open_output_stream(f"{work}/{len(names)}") as out:
                        out.write(content or b"")
                    names.append(name)
                    size += len(content or b"")
            for k, name in enumerate(names):
                if "/" in name:
                    store.create_dir(f"{top}/{name.rpartition('/')[0]}", recursive=True)
                store.move(f"{work}/{k}", f"{top}/{name}")
        finally:
            if names:
                store.delete_dir(work)
        return Written(len(names), size)

    def commit(self, messages: list[Written | None]) -> None:
        self._no_work()

    def abort(self, messages: list[Written | None]) -> None:
        self._no_work()

    def _no_work(self) -> None:
        """Work folders of executors that were lost."""
        store, top = self._opened()
        if store.get_file_info(f"{top}/{WORK}").type != fs.FileType.NotFound:
            store.delete_dir(f"{top}/{WORK}")


class FilesSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"])


def write_files(rows: DataFrame, path: str) -> None:
    """Write ``rows(name, content)`` as files below ``path``; names may have folders."""
    rows.sparkSession.dataSource.register(FilesSink)
    rows.select("name", "content").write.format(FORMAT).mode("append").option("path", path).save()
