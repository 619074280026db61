"""Rows as whole text files, one each, which appear together or not at all: reports, transcripts, session logs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FORMAT = "lodestack_files"


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The filesystem of a folder (any that Arrow knows by its scheme) and its path there."""
    if "://" in path or path.startswith("file:"):
        found, place = pafs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
        return found, place.rstrip("/")
    return pafs.LocalFileSystem(), path.rstrip("/")


def read_file(path: str) -> str | None:
    """The text of one small file, None if there is none; works within tasks."""
    folder, _, name = path.rpartition("/")
    files, root = _opened(folder)
    if files.get_file_info(f"{root}/{name}").type == pafs.FileType.NotFound:
        return None
    with files.open_input_stream(f"{root}/{name}") as found:
        return found.read().decode()


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


class _Writer(DataSourceWriter):
    """Tasks write below a hidden folder of this job; the driver moves the files of the attempts that count into place."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.pending = f".pending-{uuid.uuid4().hex}"
        files, root = _opened(path)
        files.create_dir(f"{root}/{self.pending}", recursive=True)

    def write(self, rows: Iterator) -> Written:
        files, root = _opened(self.path)
        folder = f"{root}/{self.pending}/{TaskContext.get().taskAttemptId()}"
        files.create_dir(folder, recursive=False)  # fails in a task that outlives its aborted job
        names = []
        for row in rows:
            name = row["name"]
            if not name or "/" in name or name.startswith("."):
                raise ValueError(f"{name!r} is no name of a file")
            with files.open_output_stream(f"{folder}/{name}") as out:
                out.write((row["text"] or "").encode())
            names.append(name)
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = _opened(self.path)
        done = [m for m in messages if m is not None]
        names = [n for m in done for n in m.names]
        try:
            again = {n for n in names if names.count(n) > 1} if len(set(names)) < len(names) else set()
            there = set() if self.overwrite else {n for n in names if files.get_file_info(f"{root}/{n}").type != pafs.FileType.NotFound}
            if again or there:
                raise ValueError(f"files {sorted(again | there)[:5]} are there twice")
            for m in done:
                for name in m.names:
                    files.move(f"{m.folder}/{name}", f"{root}/{name}")
        finally:
            self._cleared()

    def abort(self, messages: list[Written | None]) -> None:
        self._cleared()

    def _cleared(self) -> None:
        files, root = _opened(self.path)
        if files.get_file_info(f"{root}/{self.pending}").type != pafs.FileType.NotFound:
            files.delete_dir(f"{root}/{self.pending}")


class FileSink(DataSource):
    """Format lodestack_files: rows (name, text) become files below the path; a null text is an empty file.

    Executors write, nothing passes through the driver but names, of which it holds all: meant for thousands of files, not for
    tables. Mode append refuses names that are there already, overwrite replaces them and leaves other files alone."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, text string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite)


def write_files(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write rows (name, text) as files; see FileSink."""
    spark = rows.sparkSession
    spark.dataSource.register(FileSink)
    rows.select(rows["name"].cast("string"), rows["text"].cast("string")).write.format(FORMAT).mode(mode).save(path)
