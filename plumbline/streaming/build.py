"""Incremental annotation of arriving drawings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.functions import svg
from plumbline.operators import annotate

DOCS = "scene_id long, svg string"


def annotated(docs: DataFrame, width: int, height: int, view_w: float | None = None, view_h: float | None = None, min_size: int = annotate.MIN_SIZE, sizes: DataFrame | None = None) -> DataFrame:
    """Labelled boxes of the drawings in ``docs`` (scene_id, svg), each scaled by its own viewBox where ``view_w`` or ``view_h`` is not given.

    ``sizes`` (scene_id, width, height) has each drawing's image size, in place
    of ``width`` and ``height``; a drawing without one has no boxes.
    """
    paths = svg.with_boxes(svg.elements(docs, view=True))
    if sizes is not None:
        known = sizes.where("width is not null and height is not null").dropDuplicates(["scene_id"])
        paths, width, height = paths.join(known.select("scene_id", F.col("width").alias("img_w"), F.col("height").alias("img_h")), "scene_id"), "img_w", "img_h"
    return annotate.annotated(paths, width, height, "view_w" if view_w is None else view_w, "view_h" if view_h is None else view_h, min_size=min_size)


def last_versions(batch: DataFrame, version: str | None = None) -> DataFrame:
    """One drawing of each scene: the one with the greatest ``version``, a column of whole numbers; ties, and all without one, by the text. Null texts count last."""
    rank = F.struct(F.col(version).cast("long").alias("v"), "svg") if version else F.struct("svg")
    return batch.groupBy("scene_id").agg(F.max_by("svg", rank).alias("svg"))


def run_incrementally(spark: SparkSession, source: str, target: str, checkpoint: str, width: int, height: int, min_size: int = annotate.MIN_SIZE, sizes: DataFrame | None = None, version: str | None = None) -> StreamingQuery:
    """Annotates what arrives in ``source`` (Parquet of ``DOCS``, and ``version`` where one is named) and appends to ``target``; what is done is never done again.

    A scene's drawing arrives in one piece, so each micro-batch is complete in
    itself; of several drawings of a scene in a batch the last version counts.
    The batch number names its folder, which makes a repeated batch
    overwrite itself. Ends when all that is there is done.
    """

    def write(batch: DataFrame, number: int) -> None:
        boxes = annotated(last_versions(batch, version), width, height, min_size=min_size, sizes=sizes).withColumn("min_size", F.lit(min_size))
        boxes.write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(DOCS + (f", {version} long" if version else "")).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def observed(df: DataFrame, name: str) -> DataFrame:
    """``df`` with its number of rows reported as a metric while it runs."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"))
