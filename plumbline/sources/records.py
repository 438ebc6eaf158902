"""Records with an image, numbered in the order in which their files come: one reader for streams and tables.

The files are Parquet, read in order of their paths below a folder. Only
records whose image is not null count; how many a row group has is in its
footer, so numbers are planned before anything is read, and row groups are
read by different tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from plumbline.sources.shared import store

IMAGE = "image"
#: Rows that leave a task together.
OUT_ROWS = 1024


@dataclass
class RowGroup(InputPartition):
    path: str
    group: int
    first: int


class Records(DataSource):
    """``spark.read`` and ``spark.readStream.format("records")``: ``ordinal`` and the columns of the records, of which ``image`` is not null.

    Options: ``path``; ``columns``, the files' schema as DDL.
    """

    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        return "ordinal bigint, " + self.options["columns"]

    def reader(self, schema) -> RecordReader:
        return RecordReader(self.options["path"], [f.name for f in schema if f.name != "ordinal"])

    def streamReader(self, schema) -> RecordStream:
        return RecordStream(self.options["path"], [f.name for f in schema if f.name != "ordinal"])


class Plan:
    """Files below a folder and how many records with an image their row groups have."""

    def __init__(self, path: str, columns: list[str]) -> None:
        self.path, self.columns = path, columns
        self.counts: dict[str, list[int]] = {}

    def files(self) -> list[str]:
        """In order of their paths; hidden ones are left out."""
        system, root = store(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        return sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith(".parquet") and not any(p[:1] in "._" for p in f.path[len(root) :].split("/") if p))

    def groups(self, path: str) -> list[int]:
        """Records with an image in each row group of a file, which is read once."""
        if path not in self.counts:
            with store(self.path)[0].open_input_file(path) as f:
                reader = pq.ParquetFile(f)
                place = reader.schema_arrow.get_field_index(IMAGE)
                self.counts[path] = [_with_image(reader, i, place) for i in range(reader.metadata.num_row_groups)]
        return self.counts[path]

    def partitions(self, files: list[str], first: int) -> list[RowGroup]:
        out = []
        for path in files:
            for group, n in enumerate(self.groups(path)):
                if n:
                    out.append(RowGroup(path, group, first))
                first += n
        return out

    def read(self, part: RowGroup | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # Spark's part where there are none
            return
        ordinal = part.first
        with store(self.path)[0].open_input_file(part.path) as f:
            for batch in pq.ParquetFile(f).iter_batches(OUT_ROWS, row_groups=[part.group], columns=self.columns):
                kept = batch.filter(pc.is_valid(batch.column(IMAGE)))
                if kept.num_rows:
                    numbers = pa.array(range(ordinal, ordinal + kept.num_rows), pa.int64())
                    yield pa.RecordBatch.from_arrays([numbers, *(kept.column(c) for c in self.columns)], ["ordinal", *self.columns])
                ordinal += kept.num_rows


def _with_image(reader: pq.ParquetFile, group: int, place: int) -> int:
    """From the footer; where it has no count of nulls, from the column."""
    column = next(reader.metadata.row_group(group).column(i) for i in range(reader.metadata.num_columns) if reader.metadata.row_group(group).column(i).path_in_schema == IMAGE)
    if column.statistics is not None and column.statistics.has_null_count:
        return column.num_values - column.statistics.null_count if column.statistics.num_values == column.num_values else column.statistics.num_values
    return sum(len(b) - b.column(0).null_count for b in reader.iter_batches(OUT_ROWS, row_groups=[group], columns=[IMAGE]))


class RecordReader(Plan, DataSourceReader):
    def partitions(self) -> list[RowGroup]:
        return Plan.partitions(self, self.files(), 0)


class RecordStream(Plan, DataSourceStreamReader):
    """Offsets are the last file (its path), how many files and entries there were up to it, so that a restart goes on where it stopped."""

    def initialOffset(self) -> dict:
        return {"file": "", "files": 0, "entries": 0}

    def latestOffset(self) -> dict:
        files = self.files()
        return {"file": files[-1] if files else "", "files": len(files), "entries": sum(sum(self.groups(f)) for f in files)}

    def partitions(self, start: dict, end: dict) -> list[RowGroup]:
        files = self.files()
        if sum(f <= start["file"] for f in files) != start["files"] or sum(f <= end["file"] for f in files) != end["files"]:
            raise ValueError(f"files came or went before {end['file']!r}: numbers that were given would change")
        return Plan.partitions(self, [f for f in files if start["file"] < f <= end["file"]], start["entries"])


def records(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """``ordinal`` (from 0) and ``columns`` (DDL, with ``image``) of the records with an image below ``path``."""
    spark.dataSource.register(Records)
    return spark.read.format("records").option("columns", columns).load(path)


def record_stream(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """``records`` as a stream. Files come in order of their paths, as numbered ones do; one that comes before a file already read is an error."""
    spark.dataSource.register(Records)
    return spark.readStream.format("records").option("columns", columns).load(path)
