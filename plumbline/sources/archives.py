"""Archives read by many tasks: planned from zip directories, tars as streams, failures as rows."""

from __future__ import annotations

import lzma
import tarfile
import zipfile
import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from plumbline.sources.shared import saved, store
from plumbline.sources.sink import write_files

CONTENT = "archive string, member string, size long, offset long, content binary, error string"
TYPES = pa.schema([("archive", pa.string()), ("member", pa.string()), ("size", pa.int64()), ("offset", pa.int64()), ("content", pa.binary()), ("error", pa.string())])
#: Packed bytes and members that a task reads of a zip, and bytes of a member in one row.
PART_BYTES, PART_MEMBERS, RANGE_BYTES = 64 << 20, 1000, 4 << 20
#: Names of files in one batch.
NAMES = 10_000
PIECE = pa.schema([("archive", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("bytes", pa.int64()), ("error", pa.string())])
SUFFIXES = (".zip", ".tar", ".tar.gz", ".tgz", ".tar.xz", ".txz", ".gz", ".xz")
#: Where archives lie below a root; it is no folder of drawings.
ARCHIVES = "zips"
FAILURES = (tarfile.TarError, zipfile.BadZipFile, zlib.error, lzma.LZMAError, EOFError, OSError, NotImplementedError, RuntimeError, ValueError)


@dataclass
class Piece:
    path: str
    #: Positions in the zip's directory; none for a tar, which is read from end to end.
    members: tuple[int, int] | None
    bytes: int
    error: str | None = None


@dataclass
class Part(InputPartition):
    """What a task reads: a piece of a large archive, or several small ones."""

    pieces: list[Piece]


class Archives(DataSource):
    """``spark.read.format("archives")``: rows of ``CONTENT``, a member in ranges of bytes; an archive or member that cannot be read has one with an error.

    Options: ``path``, a folder; ``partMembers``, ``partBytes`` and ``rangeBytes``.
    """

    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return CONTENT

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader.of(self.options["path"], self.options)


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, part_members: int, part_bytes: int, range_bytes: int) -> None:
        self.path, self.part_members, self.part_bytes, self.range_bytes = path, part_members, part_bytes, range_bytes

    @classmethod
    def of(cls, path: str, options: Mapping[str, int | str]) -> ArchiveReader:
        return cls(path, *(int(options.get(name, default)) for name, default in (("partMembers", PART_MEMBERS), ("partBytes", PART_BYTES), ("rangeBytes", RANGE_BYTES))))

    def partitions(self) -> list[Part]:
        system, root = store(self.path)
        found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
        parts: list[Part] = []
        held = members = 0
        for file in sorted(found, key=lambda f: f.path):
            if file.type != fs.FileType.File or not file.path.endswith(SUFFIXES):
                continue
            for piece in self.pieces(system, file.path, file.size):
                count = piece.members[1] - piece.members[0] if piece.members else 1
                if not parts or held + piece.bytes > self.part_bytes or members + count > self.part_members:
                    parts.append(Part([]))
                    held = members = 0
                parts[-1].pieces.append(piece)
                held, members = held + piece.bytes, members + count
        return parts

    def pieces(self, system: fs.FileSystem, path: str, size: int) -> Iterator[Piece]:
        try:
            with system.open_input_file(path) as f:
                if f.read(4) not in (b"PK\x03\x04", b"PK\x05\x06"):
                    yield Piece(path, None, size)
                    return
                f.seek(0)
                sizes = [i.compress_size for i in zipfile.ZipFile(f).infolist()]
        except FAILURES as e:
            yield Piece(path, None, 0, str(e) or type(e).__name__)
            return
        start = packed = 0
        for i, packed_size in enumerate(sizes):
            if i > start and (packed + packed_size > self.part_bytes or i - start >= self.part_members):
                yield Piece(path, (start, i), packed)
                start, packed = i, 0
            packed += packed_size
        if sizes:
            yield Piece(path, (start, len(sizes)), packed)

    def read(self, part: Part | None) -> Iterator[pa.RecordBatch]:
        """Rows leave together up to the bytes of one range."""
        rows: list[dict] = []
        size = 0
        for piece in part.pieces if part else ():  # Spark's part is None where there are none
            for row in self._rows(piece):
                rows.append(row)
                size += len(row["content"] or b"")
                if size >= self.range_bytes or len(rows) >= self.part_members:
                    yield pa.RecordBatch.from_pylist(rows, schema=TYPES)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=TYPES)

    def _rows(self, piece: Piece) -> Iterator[dict]:
        if piece.error is not None:
            yield _failure(piece.path, None, piece.error)
        elif piece.members is None:
            yield from self._tar(piece.path)
        else:
            yield from self._zip(piece.path, *piece.members)

    def _zip(self, path: str, start: int, end: int) -> Iterator[dict]:
        with store(self.path)[0].open_input_file(path) as f, zipfile.ZipFile(f) as archive:
            for info in archive.infolist()[start:end]:
                if info.is_dir():
                    continue
                try:
                    with archive.open(info) as member:
                        yield from self._ranges(path, info.filename, info.file_size, member)
                except FAILURES as e:
                    yield _failure(path, info.filename, str(e) or type(e).__name__)

    def _tar(self, path: str) -> Iterator[dict]:
        name = None
        try:
            with store(self.path)[0].open_input_stream(path, compression=None) as f, tarfile.open(fileobj=f, mode="r|*") as archive:
                for info in archive:
                    name = info.name
                    if info.isfile():
                        yield from self._ranges(path, info.name, info.size, archive.extractfile(info))
        except FAILURES as e:
            yield _failure(path, name, str(e) or type(e).__name__)

    def _ranges(self, path: str, name: str, size: int, member) -> Iterator[dict]:
        offset = 0
        while (content := member.read(self.range_bytes)) or not offset:
            yield _row(path, name, size, offset, content, None)
            offset += len(content)
            if not content:
                break


def _row(path: str, member: str | None, size: int | None, offset: int, content: bytes | None, error: str | None) -> dict:
    return {"archive": path.rpartition("/")[2], "member": member, "size": size, "offset": offset, "content": content, "error": error}


def _failure(path: str, member: str | None, error: str) -> dict:
    return _row(path, member, None, 0, None, error)


def contents(spark: SparkSession, path: str, **options: int) -> DataFrame:
    """Rows of ``CONTENT`` of the archives right in a folder. A tar that breaks off has its members up to there, and a row with the error."""
    spark.dataSource.register(Archives)
    return spark.read.format("archives").options(**options).load(path)


def target_of(archive: str = "archive"):
    """The folder below the root that an archive is unpacked into."""
    return F.regexp_replace(archive, r"\.(zip|tar\.gz|tar\.xz|tgz|txz|tar|gz|xz)$", "")


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows that stand for much work, dealt by number."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *rows.columns)


def _names(spark: SparkSession, root: str, folder: str, kind: fs.FileType) -> DataFrame:
    """(name, size) of what is right in a folder below ``root``: one task's work, of names alone."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = store(root)
        for _ in (row for batch in batches for row in range(batch.num_rows)):
            here = [f for f in system.get_file_info(fs.FileSelector(f"{base.rstrip('/')}/{folder}", allow_not_found=True)) if f.type == kind]
            for at in range(0, len(here), NAMES):
                some = here[at : at + NAMES]
                yield pa.RecordBatch.from_pydict({"name": [f.base_name for f in some], "size": pa.array([f.size for f in some], pa.int64())})

    return spark.range(1, numPartitions=1).mapInArrow(found, "name string, size long")


def pieces_to_do(spark: SparkSession, root: str, **options: int) -> DataFrame:
    """(archive, start, end, bytes, error): pieces of the archives in ``{root}/zips`` whose folder has nothing in it yet. Zip directories are read by tasks; an archive that is done is not opened."""
    known = _names(spark, root, ARCHIVES, fs.FileType.File).select(F.col("name").alias("archive"), "size", target_of("name").alias("target"))

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = store(root)
        reader = ArchiveReader.of(root, options)
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                target = f"{base.rstrip('/')}/{row['target']}"
                done = row["target"] != ARCHIVES and system.get_file_info(target).type == fs.FileType.Directory and system.get_file_info(fs.FileSelector(target))
                for piece in reader.pieces(system, f"{base.rstrip('/')}/{ARCHIVES}/{row['archive']}", row["size"]) if row["archive"].endswith(SUFFIXES) and not done else ():
                    rows.append((row["archive"], *(piece.members or (None, None)), piece.bytes, piece.error))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(PIECE.types)], schema=PIECE)

    return _dealt(known).mapInArrow(plan, "archive string, start long, end long, bytes long, error string")


def read_pieces(pieces: DataFrame, root: str, content: bool = True, **options: int) -> DataFrame:
    """Rows of ``CONTENT`` of the pieces, a member's together and in order; without ``content`` that column is null."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = store(root)[1].rstrip("/")
        reader = ArchiveReader.of(root, options)
        for row in (row for batch in batches for row in batch.to_pylist()):
            members = None if row["start"] is None else (row["start"], row["end"])
            for out in reader.read(Part([Piece(f"{base}/{ARCHIVES}/{row['archive']}", members, row["bytes"], row["error"])])):
                yield out if content else out.set_column(out.schema.get_field_index("content"), "content", pa.nulls(out.num_rows, pa.binary()))

    return _dealt(pieces).mapInArrow(read, CONTENT)


def ingest(spark: SparkSession, root: str, **options: int) -> DataFrame:
    """Unpacks the archives in ``{root}/zips`` into folders of their names, and reports (archive, target, members, failures, error).

    An archive whose folder has anything in it is left alone and not reported.
    A failure ends neither the others nor the archive's other members. Names
    that lead out of the folder are failures.
    """
    # Planned before anything is written: once members are written, their folder is filled.
    pieces = saved(pieces_to_do(spark, root, **options))
    outside = F.col("member").rlike(r"(^|/)\.\.(/|$)|^/")

    def checked(content: bool) -> DataFrame:
        rows = read_pieces(pieces, root, content, **options).withColumn("target", target_of())
        return rows.withColumn("error", F.when(outside, "the name leads out of the folder").otherwise(F.col("error")))

    report = checked(False).groupBy("archive", "target").agg(
        F.count(F.when(F.col("error").isNull() & (F.col("offset") == 0), 1)).alias("members"), F.count("error").alias("failures"), F.min("error").alias("error")
    )
    kept = saved(report)
    # Ranges of a member come together and in order, so that contents need not be shuffled.
    write_files(checked(True).where("error is null").select(F.concat_ws("/", "target", "member").alias("path"), "content"), root)
    return kept


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """(folder, n_files): how many files lie in each folder right below ``root``, at any depth; the archives' folder is left out. A folder is listed by one task."""
    folders = _names(spark, root, "", fs.FileType.Directory).where((~F.substring("name", 1, 1).isin(".", "_")) & (F.col("name") != ARCHIVES)).select("name")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = store(root)
        for batch in batches:
            names = batch.column("name").to_pylist()
            counts = [sum(f.type == fs.FileType.File for f in system.get_file_info(fs.FileSelector(f"{base.rstrip('/')}/{n}", recursive=True))) for n in names]
            yield pa.RecordBatch.from_pydict({"folder": names, "n_files": pa.array(counts, pa.int64())})

    return _dealt(folders).mapInArrow(count, "folder string, n_files long")
