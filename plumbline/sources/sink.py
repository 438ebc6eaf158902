"""A sink of whole files: each row, or run of rows, is a file of its own.

Spark's own writers make one file a task with a name of their choosing; this
one names every file after its row. A file is written under another name and
then renamed, so it is never there in part, whichever task fails and however
often one is repeated.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from plumbline.sources.shared import store

FILES = "path string, offset long, content binary"

@dataclass
class Written(WriterCommitMessage):
    written: int
    there_before: int


class Files(DataSource):
    """``df.write.format("files")`` for rows of ``FILES``; options ``path`` and ``existing``: keep (the default) or replace."""

    @classmethod
    def name(cls) -> str:
        return "files"

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"], self.options.get("existing", "keep"))


class FilesWriter(DataSourceArrowWriter):
    def __init__(self, root: str, existing: str) -> None:
        if existing not in ("keep", "replace"):
            raise ValueError(f"existing must be keep or replace, not {existing!r}")
        self.root, self.keep = root.rstrip("/"), existing == "keep"
        # Spark's listings leave out what begins with an underscore.
        self.drafts = f"{self.root}/_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = store(self.root)
        drafts = store(self.drafts)[1]
        system.create_dir(drafts, recursive=True)
        draft = f"{drafts}/{TaskContext.get().taskAttemptId()}"
        counts, made = {True: 0, False: 0}, set()
        for path, chunks in _files(iterator):
            final = f"{root}/{path}"
            new = not (self.keep and system.get_file_info(final).type != fs.FileType.NotFound)
            counts[new] += 1
            if new:
                folder = final.rpartition("/")[0]
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(draft) as out:
                    for chunk in chunks:
                        out.write(chunk)
                _renamed(system, draft, final)
            for _ in chunks:
                pass
        return Written(counts[True], counts[False])

    def commit(self, messages: list) -> None:
        self._tidy()

    def abort(self, messages: list) -> None:
        self._tidy()

    def _tidy(self) -> None:
        """Drafts that failed tasks have left; finished files stay, which a repeated run then finds."""
        system, drafts = store(self.drafts)
        if system.get_file_info(drafts).type == fs.FileType.Directory:
            system.delete_dir(drafts)


def _renamed(system: fs.FileSystem, draft: str, final: str) -> None:
    try:
        system.move(draft, final)
    except OSError:
        # Stores that do not rename onto a file: another attempt may have put the same one there.
        with contextlib.suppress(FileNotFoundError):
            system.delete_file(final)
        system.move(draft, final)


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Iterator[bytes]]]:
    """Each file's path and its chunks in order; rows of a path come together."""
    rows = ((path, content) for batch in batches for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()))
    for path, own in groupby(rows, key=lambda r: r[0]):
        yield path, (content or b"" for _, content in own)


def write_files(files: DataFrame, root: str, existing: str = "keep") -> None:
    """Writes rows (path, content, and ``offset`` where a file is in several rows) as files below ``root``.

    Paths are relative. Rows of one path are put together by offset; rows that
    repeat a path and offset are not defined. A null content is an empty file.
    ``existing``: what is there already stays, or is replaced.
    """
    register(files.sparkSession)
    offset = F.col("offset") if "offset" in files.columns else F.lit(0)
    rows = files.select(F.col("path").cast("string").alias("path"), offset.cast("long").alias("offset"), F.col("content").cast("binary").alias("content")).where("path is not null")
    if "offset" in files.columns:
        rows = rows.repartition("path").sortWithinPartitions("path", "offset")
    rows.write.format("files").option("path", root).option("existing", existing).mode("append").save()


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Files)
