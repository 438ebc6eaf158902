"""Annotating folders of drawings, and the sample index over what was annotated.

A root has source folders with ``{stem}.png``, ``{stem}.svg`` and, once they
are annotated, ``{stem}_meta.json``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import svg
from plumbline.functions.dims import SPLITS, source_dirs
from plumbline.operators import annotate
from plumbline.operators.samples import ordinals, required
from plumbline.sources import files
from plumbline.sources.shared import exists, saved, store
from plumbline.sources.sink import write_files

SIDECAR = "_meta.json"
FILE = "path string, length long, content binary"
#: Bytes of an image that hold its size, and names of files in one batch.
HEADER, NAMES = 24, 10_000


def listed(spark: SparkSession, root: str, folders: tuple[str, ...], suffix: str) -> DataFrame:
    """path, length and content of the files with a suffix right in these folders; a folder that is not there has none."""
    there = [f"{root.rstrip('/')}/{d}" for d in folders if exists(spark, f"{root.rstrip('/')}/{d}")]
    if not there:
        return spark.createDataFrame([], FILE)
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("ignoreCorruptFiles", "true").load(there).select("path", "length", "content")


def scene_key(source_dir: Column | str = "source_dir", stem: Column | str = "stem") -> Column:
    return F.concat_ws("/", source_dir, stem)


def names(spark: SparkSession, root: str, folders: tuple[str, ...], *suffixes: str) -> DataFrame:
    """source_dir, stem (without the suffix) and suffix of the files right in these folders whose names end in one of the suffixes, by names alone.

    A folder is a task's work; one that is not there has none. Names that
    Spark's listings leave out are left out.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = store(root)
        for folder in (f for batch in batches for f in batch.column("source_dir").to_pylist()):
            here = [f.base_name for f in system.get_file_info(fs.FileSelector(f"{base.rstrip('/')}/{folder}", allow_not_found=True)) if f.type == fs.FileType.File and f.base_name[0] not in "._"]
            for at in range(0, len(here), NAMES):
                rows = [(folder, n[: -len(s)], s) for n in here[at : at + NAMES] for s in suffixes if n.endswith(s)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["source_dir", "stem", "suffix"])

    return spark.createDataFrame([(f,) for f in folders], "source_dir string").repartition(len(folders)).mapInArrow(found, "source_dir string, stem string, suffix string")


def sidecars(drawn: DataFrame, mode: str = "by_path", min_size: int = annotate.MIN_SIZE) -> DataFrame:
    """Metadata files (path, content) of drawings (source_dir, stem, width, height, svg), each scaled by its own viewBox and image size.

    A drawing that is no XML, or without a usable path, has none; one whose image has no size has none either.
    """
    known = drawn.where("width is not null and height is not null").withColumn("scene_id", scene_key())
    return _metadata(svg.boxed(known, keep=("scene_id", "width", "height")), mode, min_size)


def _metadata(drawings: DataFrame, mode: str, min_size: int) -> DataFrame:
    paths = svg.boxed_paths(drawings, "scene_id", "width", "height")
    found = annotate.documents(paths, "width", "height", "view_w", "view_h", mode, min_size)
    return found.select(F.concat("scene_id", F.lit(SIDECAR)).alias("path"), F.col("document").cast("binary").alias("content"))


def annotate_folders(spark: SparkSession, root: str, mode: str = "by_path", min_size: int = annotate.MIN_SIZE, default_size: int | None = None) -> None:
    """Writes the metadata beside the drawings of all source folders; what has metadata is left alone, so a repeated run does the rest.

    A drawing without an image is left out, or takes ``default_size``.
    """
    every = tuple(d for dirs in SPLITS.values() for d in dirs)
    # Names meet before contents: only drawings that are not done are read, and of their images the header.
    listed_names = saved(names(spark, root, every, ".png", ".svg", SIDECAR))
    pictures, drawings, done = (listed_names.where(F.col("suffix") == suffix).drop("suffix") for suffix in (".png", ".svg", SIDECAR))
    fresh = drawings.join(done, ["source_dir", "stem"], "left_anti").join(pictures.withColumn("drawn", F.lit(True)), ["source_dir", "stem"], "inner" if default_size is None else "left")

    def opened(batch: pa.RecordBatch, i: int) -> tuple[bytes | None, bytes | None]:
        system, base = store(root)
        path = f"{base.rstrip('/')}/{batch.column('scene_id')[i]}"
        header = _begun(system, f"{path}.png", HEADER) if batch.column("drawn")[i].as_py() else None
        return _begun(system, f"{path}.svg"), header

    # Names are few bytes and their drawings many, so the work is dealt by number.
    dealt = fresh.select(scene_key().alias("scene_id"), "drawn").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "scene_id")
    sizes = (size if default_size is None else F.when(F.col("header").isNull(), default_size).otherwise(size) for size in files.png_size(F.col("header")))
    read = svg.boxed(dealt, keep=("scene_id",), opened=opened).withColumns(dict(zip(("width", "height"), sizes)))
    write_files(_metadata(read.where("width is not null and height is not null"), mode, min_size), root)


def _begun(system: fs.FileSystem, path: str, size: int | None = None) -> bytes | None:
    """A file's first bytes, or all; none if it cannot be read."""
    try:
        with system.open_input_stream(path, compression=None) as f:
            return f.read(size)
    except OSError:
        return None


def sample_index(spark: SparkSession, root: str, split: str) -> DataFrame:
    """(idx, source_dir, stem, class_name, class_id) of each known class in each annotated image of a split.

    In order of the split's folders, the image's path and the class's name,
    numbered from 0. An unknown split and an empty index are errors; a folder
    that is not there is left out, as is an image without metadata.
    """
    folders = source_dirs(split)
    found = files.classes_beside(names(spark, root, folders, ".png"), listed(spark, root, folders, SIDECAR))
    rank = F.array_position(F.array(*map(F.lit, folders)), F.col("source_dir"))
    # Of a folder the file's name orders the path.
    placed = found.withColumns({"_folder": rank, "_file": F.concat("stem", F.lit(".png"))})
    indexed = ordinals(placed, "_folder", "_file", "class_name").select("idx", "source_dir", "stem", "class_name", "class_id")
    return required(indexed)
