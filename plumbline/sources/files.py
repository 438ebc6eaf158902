"""Files as rows: listings, formats, image headers, archives, and nested metadata as JSON."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.dims import class_dim

#: Archives of at most this many bytes are taken for failed downloads.
LEAST_ARCHIVE = 10_000

METADATA = (
    "image_size array<int>, svg_viewbox array<double>, num_instances int, "
    "instances array<struct<class:string, class_id:int, instance_id:bigint, bbox_px:array<int>>>"
)


def listing(spark: SparkSession, folder: str, suffix: str, recursive: bool = False) -> DataFrame:
    """path, length and content of the files with a suffix; unreadable ones are skipped, and content is read only where it is selected."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("ignoreCorruptFiles", "true")
    return reader.option("recursiveFileLookup", str(recursive).lower()).load(folder)


def located(files: DataFrame) -> DataFrame:
    """source_dir, stem and suffix of each path."""
    return files.select(
        "*",
        F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("source_dir"),
        F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("stem"),
        F.regexp_extract("path", r"(\.[^./]+)$", 1).alias("suffix"),
    )


def file_format(content: Column) -> Column:
    """zip, xz, gz or unknown, from the first bytes."""
    head = F.hex(F.substring(content, 1, 6))
    return (
        F.when(head.startswith("504B0304"), "zip")
        .when((head == "FD377A585A00") | (head.startswith("79377A585A")), "xz")
        .when(head.startswith("1F8B"), "gz")
        .otherwise("unknown")
    )


def png_size(content: Column) -> tuple[Column, Column]:
    """Width and height in a PNG header; null for anything else."""
    png = F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A"

    def number(at):
        return F.when(png & (F.length(content) >= 24), F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int"))

    return number(17), number(21)


def members(archives: DataFrame) -> DataFrame:
    """path, member, bytes of the files in zip and tar archives; an unknown format is tried as tar. An unreadable archive has no rows."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch.path, batch.content):
                rows = list(_members(bytes(content)))
                if rows:
                    yield pd.DataFrame({"path": path, "member": [r[0] for r in rows], "bytes": [r[1] for r in rows]})

    return archives.select("path", "content").mapInPandas(unpack, "path string, member string, bytes binary")


def _members(content: bytes) -> Iterator[tuple[str, bytes]]:
    try:
        if content[:4] == b"PK\x03\x04":
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                yield from ((i.filename, archive.read(i)) for i in archive.infolist() if not i.is_dir())
        else:
            with tarfile.open(fileobj=io.BytesIO(content)) as archive:
                yield from ((m.name, archive.extractfile(m).read()) for m in archive if m.isfile())
    except (tarfile.TarError, zipfile.BadZipFile, EOFError, OSError):
        return


def to_download(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """Archives of the manifest that are not there yet, or too small. Both have name; ``found`` has length."""
    return manifest.join(found.where(F.col("length") > LEAST_ARCHIVE), "name", "left_anti")


def metadata_json(boxes: DataFrame, width: int, height: int, view_w: float, view_h: float) -> DataFrame:
    """One JSON document for each scene that has boxes, its instances in order."""
    rows = F.sort_array(F.collect_list(F.struct("ord", "sid", "class_name", "class_id", "iid", "px0", "py0", "px1", "py1")))
    instances = F.transform(
        "rows",
        lambda r: F.struct(
            r["class_name"].alias("class"),
            r["class_id"].alias("class_id"),
            r["iid"].cast("long").alias("instance_id"),
            F.array(r["px0"], r["py0"], r["px1"], r["py1"]).alias("bbox_px"),
        ),
    )
    document = F.struct(
        F.array(F.lit(width), F.lit(height)).alias("image_size"),
        F.array(F.lit(0.0), F.lit(0.0), F.lit(view_w), F.lit(view_h)).alias("svg_viewbox"),
        F.size("rows").alias("num_instances"),
        instances.alias("instances"),
    )
    return boxes.groupBy("scene_id").agg(rows.alias("rows")).select("scene_id", F.to_json(document).alias("document"))


def paired(images: DataFrame, drawings: DataFrame, default_size: int | None = None) -> DataFrame:
    """Image and drawing files (path, content) of the same folder and stem: source_dir, stem, width, height (of the PNG header) and svg.

    A file alone is left out; with ``default_size`` a drawing without an image takes that width and height.
    """
    width, height = png_size(F.col("content"))
    sizes = located(images).where("suffix = '.png'").select("source_dir", "stem", width.alias("width"), height.alias("height"), F.lit(True).alias("drawn"))
    texts = located(drawings).where("suffix = '.svg'").select("source_dir", "stem", F.col("content").cast("string").alias("svg"))
    # Sizes are small: what is built is their table, and texts are not sorted.
    sizes = sizes.hint("shuffle_hash")
    if default_size is None:
        return texts.join(sizes, ["source_dir", "stem"]).drop("drawn")
    both = texts.join(sizes, ["source_dir", "stem"], "left")
    return both.withColumns({c: F.when(F.col("drawn"), F.col(c)).otherwise(default_size) for c in ("width", "height")}).drop("drawn")


def metadata_of(metadata: DataFrame) -> DataFrame:
    """source_dir, stem and document of the ``_meta.json`` files (path, content)."""
    texts = located(metadata).where("suffix = '.json' and endswith(stem, '_meta')")
    return texts.select("source_dir", F.expr("left(stem, length(stem) - 5)").alias("stem"), F.col("content").cast("string").alias("document"))


def classes_beside(images: DataFrame, metadata: DataFrame) -> DataFrame:
    """``classes_in`` the ``_meta.json`` files (path, content) that have an image (source_dir, stem) beside them. Names of classes meet images, documents do not travel."""
    found = classes_in(metadata_of(metadata))
    return found.join(images.select("source_dir", "stem"), ["source_dir", "stem"], "left_semi").select(*found.columns)


def classes_in(documents: DataFrame) -> DataFrame:
    """The known classes of each image's metadata, once each: source_dir, stem, class_name, class_id. Images without one have no row."""
    instances = documents.select("source_dir", "stem", F.explode(F.from_json("document", METADATA)["instances"]).alias("i"))
    named = instances.select("source_dir", "stem", F.col("i.class").alias("class_name")).distinct()
    # The classes are a fixed table.
    return named.join(F.broadcast(class_dim(documents.sparkSession).select("class_name", "class_id")), "class_name")


def files_per_folder(files: DataFrame) -> DataFrame:
    """How many files of each suffix every folder has."""
    return located(files).groupBy("source_dir", "suffix").agg(F.count("*").alias("n"))


def metadata_rows(documents: DataFrame) -> DataFrame:
    """The instances of ``metadata_json``, one row each, with their position."""
    parsed = documents.select("scene_id", F.from_json("document", METADATA).alias("m"))
    return parsed.select("scene_id", "m.num_instances", F.posexplode("m.instances").alias("pos", "i")).select("scene_id", "num_instances", "pos", "i.*")
