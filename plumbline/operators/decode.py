"""From score cells to ranked boxes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.geometry import GRID, STRIDE, decoded_box
from plumbline.operators.targets import by_sample, whole_samples

KEYS = ["scene_id", "class_id", "y", "x"]
TOP, LEAST_SCORE = 50, 0.3


def local_maxima(cells: DataFrame, grid: int = GRID, together: bool = False) -> DataFrame:
    """Cells whose score is the greatest of their 3 x 3 surroundings; equal neighbours all stay. Cells without a score are left out.

    A task has a few samples' grids at a time. ``together``: a sample's cells
    already come one after the other, as those of ``target_cells`` do, and none is sent anywhere.
    """

    def peaks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, begins in whole_samples(batches):
            y, x = (rows.column(c).to_numpy() + 1 for c in ("y", "x"))
            score = rows.column("score").to_numpy()
            sample = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(rows))))
            # A border of nothing, so that ends of rows are no neighbours.
            map_ = np.full((len(begins), grid + 2, grid + 2), -np.inf)
            np.maximum.at(map_, (sample, y, x), score)
            best = np.maximum(np.maximum(map_[:, :-2], map_[:, 1:-1]), map_[:, 2:])
            best = np.maximum(np.maximum(best[:, :, :-2], best[:, :, 1:-1]), best[:, :, 2:])
            # Not a number counts as the greatest.
            yield from rows.filter(pa.array((score == best[sample, y - 1, x - 1]) | np.isnan(score))).to_batches()

    scored = cells.where("score is not null")
    return (scored if together else by_sample(scored)).mapInArrow(peaks, cells.schema)


def ranked(peaks: DataFrame, top: int = TOP, least_score: float = LEAST_SCORE, grid: int = GRID) -> DataFrame:
    """The ``top`` peaks of each image and class by score, ties by position, of those of ``least_score``: what is below it ranks behind them."""
    order = Window.partitionBy("scene_id", "class_id").orderBy(F.desc("score"), F.col("y") * grid + F.col("x"))
    return peaks.where(F.col("score") >= least_score).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def boxes(cells: DataFrame, stride: int = STRIDE) -> DataFrame:
    return cells.select(*cells.columns, *(c.alias(name) for name, c in decoded_box(F.col("x"), F.col("y"), F.col("dx"), F.col("dy"), F.col("w"), F.col("h"), stride).items()))


def in_scan_order(masked: DataFrame) -> DataFrame:
    """Centre cells of a sample numbered row by row from 0."""
    order = Window.partitionBy("scene_id", "class_id").orderBy("y", "x")
    return masked.where("mask > 0.5").withColumn("number", (F.row_number().over(order) - 1).cast("long"))


def best_classes(cells: DataFrame, top: int = 5) -> DataFrame:
    """The classes with the greatest score anywhere; ties by class id."""
    return cells.groupBy("class_id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "class_id").limit(top)
