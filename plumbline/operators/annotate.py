"""From drawn paths to labelled pixel boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.dims import class_dim
from plumbline.functions.geometry import to_pixel

MIN_SIZE = 8


def scale(size: int | str, view: float | str) -> float | Column:
    """Pixels a view unit; null if the view is empty. A string names a column."""
    if isinstance(size, str) or isinstance(view, str):
        return F.try_divide(*(F.col(x) if isinstance(x, str) else F.lit(x) for x in (size, view)))
    return size / view


def with_pixels(boxes: DataFrame, width: int | str, height: int | str, view_w: float | str, view_h: float | str, min_size: int = MIN_SIZE) -> DataFrame:
    """Boxes in view units with whole pixels: truncated, each corner clamped on its own side; ``kept`` if they are large enough. Sizes may be names of columns."""
    sx, sy = scale(width, view_w), scale(height, view_h)
    width, height = (F.col(x) if isinstance(x, str) else F.lit(x) for x in (width, height))
    placed = (
        boxes.withColumn("px0", F.greatest(F.lit(0), to_pixel(F.col("x0"), sx)))
        .withColumn("py0", F.greatest(F.lit(0), to_pixel(F.col("y0"), sy)))
        .withColumn("px1", F.least(width, to_pixel(F.col("x1"), sx)))
        .withColumn("py1", F.least(height, to_pixel(F.col("y1"), sy)))
    )
    # A null scale has no pixels: greatest and least skip nulls.
    scaled = F.lit(sx).isNotNull() & F.lit(sy).isNotNull()
    return placed.withColumn("kept", F.coalesce(scaled & (F.col("px1") - F.col("px0") >= min_size) & (F.col("py1") - F.col("py0") >= min_size), F.lit(False)))


def pixel_boxes(boxes: DataFrame, width: int | str, height: int | str, view_w: float | str, view_h: float | str, min_size: int = MIN_SIZE) -> DataFrame:
    """``with_pixels`` without the small boxes."""
    return with_pixels(boxes, width, height, view_w, view_h, min_size).where("kept").drop("kept")


def instances(paths: DataFrame, stuff_by_class: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Union of the boxes of an instance's paths.

    Paths without an instance (-1) stay apart, or, with ``stuff_by_class``,
    merge by class. ``ord`` is the first path's. One shuffle by scene, class
    and instance, with partial minima and maxima before it. ``keep``: columns
    with one value a scene.
    """
    keys = ["scene_id", "sid", "iid"]
    alone = F.when(F.col("iid") == -1, F.col("ord")) if not stuff_by_class else F.lit(None).cast("int")
    return (
        paths.withColumn("own", alone)
        .groupBy(*keys, "own")
        .agg(F.min("ord").alias("ord"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), *(F.first(c).alias(c) for c in keep))
        .drop("own")
    )


def named(boxes: DataFrame) -> DataFrame:
    """Class names and ids; an unknown semantic id is ``class_NN`` with id -1."""
    dim = F.broadcast(class_dim(boxes.sparkSession))
    return (
        boxes.join(dim, "sid", "left")
        .withColumn("class_name", F.coalesce("class_name", F.format_string("class_%02d", "sid")))
        .withColumn("class_id", F.coalesce("class_id", F.lit(-1)))
    )


def annotated(paths: DataFrame, width: int | str, height: int | str, view_w: float | str, view_h: float | str, mode: str = "by_path", min_size: int = MIN_SIZE) -> DataFrame:
    """Labelled instance boxes. ``by_path``: every stuff path alone, unknown classes kept, at least ``min_size`` pixels.
    ``by_class``: stuff merged by class, unknown classes dropped, any area. Sizes may be names of columns, with one value a scene."""
    if mode not in ("by_path", "by_class"):
        raise ValueError(f"unknown mode {mode!r}")
    merged = mode == "by_class"
    sizes = tuple(c for c in (width, height, view_w, view_h) if isinstance(c, str))
    boxes = named(pixel_boxes(instances(paths, merged, sizes), width, height, view_w, view_h, 1 if merged else min_size).drop(*sizes))
    return boxes.where("class_id >= 0") if merged else boxes


def documents(paths: DataFrame, width: int | str, height: int | str, view_w: float | str, view_h: float | str, mode: str = "by_path", min_size: int = MIN_SIZE) -> DataFrame:
    """(scene_id, document): minified JSON metadata of each scene with a path, in the modes of ``annotated``.

    A scene whose boxes are all dropped has an empty list of instances; one
    without a path has no row. Instances come in order of their first path; in
    mode ``by_class`` what has no instance id comes first.
    """
    if mode not in ("by_path", "by_class"):
        raise ValueError(f"unknown mode {mode!r}")
    merged = mode == "by_class"
    sizes = tuple(c for c in (width, height, view_w, view_h) if isinstance(c, str))
    boxes = named(with_pixels(instances(paths, merged, sizes), width, height, view_w, view_h, 1 if merged else min_size))
    kept = F.col("kept") & (F.col("class_id") >= 0) if merged else F.col("kept")
    later = (F.col("iid") != -1) if merged else F.lit(False)
    row = F.struct(later.alias("later"), "ord", "class_name", "class_id", "iid", "px0", "py0", "px1", "py1")
    found = boxes.groupBy("scene_id").agg(F.sort_array(F.collect_list(F.when(kept, row))).alias("rows"), *(F.first(c).alias(c) for c in sizes))
    image_w, image_h, view_w, view_h = (F.col(x) if isinstance(x, str) else F.lit(x) for x in (width, height, view_w, view_h))
    instance = F.transform("rows", lambda r: F.struct(r["class_name"].alias("class"), r["class_id"].alias("class_id"), r["iid"].cast("long").alias("instance_id"), F.array(r["px0"], r["py0"], r["px1"], r["py1"]).alias("bbox_px")))
    document = F.struct(
        F.array(image_w, image_h).alias("image_size"), F.array(F.lit(0.0), F.lit(0.0), view_w.cast("double"), view_h.cast("double")).alias("svg_viewbox"),
        F.size("rows").alias("num_instances"), instance.alias("instances"),
    )
    return found.select("scene_id", F.to_json(document).alias("document"))
