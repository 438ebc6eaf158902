"""Target grids of samples, as sparse cells: centre heat, size, offset, mask."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from plumbline.functions.geometry import GRID, IMAGE_SIZE, gaussian_radius, to_input

SAMPLE = ("scene_id", "class_id")
KEYS = (*SAMPLE, "y", "x")
#: Samples that are looked at together.
SAMPLES = 64


def projected(boxes: DataFrame, width: int, height: int, image_size: int = IMAGE_SIZE, grid: int = GRID) -> DataFrame:
    """Pixel boxes of known classes on the output grid: corners in input pixels (ix0 ...), size, centre cell, offset and radius.

    Boxes without an area before or after, or with the centre outside, are dropped.
    """
    scale = grid / image_size
    inside = boxes.where("class_id >= 0").select(
        "scene_id",
        "class_id",
        "ord",
        to_input(F.col("px0"), float(width), image_size).alias("ix0"),
        to_input(F.col("py0"), float(height), image_size).alias("iy0"),
        to_input(F.col("px1"), float(width), image_size).alias("ix1"),
        to_input(F.col("py1"), float(height), image_size).alias("iy1"),
    )
    sized = inside.where("ix1 > ix0 and iy1 > iy0").select(
        "*",
        ((F.col("ix1") - F.col("ix0")) * scale).alias("w"),
        ((F.col("iy1") - F.col("iy0")) * scale).alias("h"),
        ((F.col("ix0") * scale + F.col("ix1") * scale) / 2).alias("cx"),
        ((F.col("iy0") * scale + F.col("iy1") * scale) / 2).alias("cy"),
    )
    centred = sized.where("w > 0 and h > 0").select(
        "*",
        F.floor("cx").cast("int").alias("x"),
        F.floor("cy").cast("int").alias("y"),
        gaussian_radius(F.col("w"), F.col("h")).alias("radius"),
    )
    return centred.where(F.col("x").between(0, grid - 1) & F.col("y").between(0, grid - 1)).select(
        "scene_id", "class_id", "ord", "ix0", "iy0", "ix1", "iy1", "w", "h", "x", "y", (F.col("cx") - F.col("x")).alias("dx"), (F.col("cy") - F.col("y")).alias("dy"), "radius"
    )


def by_sample(rows: DataFrame) -> DataFrame:
    """``rows`` dealt by image and class, a sample's rows one after the other; not into fewer tasks where they are small, since cells are many for each centre."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *SAMPLE).sortWithinPartitions(*SAMPLE)


def whole_samples(batches: Iterator[pa.RecordBatch], most: int = SAMPLES) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows of up to ``most`` samples, none cut apart, and where each sample begins; a sample's rows come one after the other."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, rows]).combine_chunks() if held else rows
        begins = np.flatnonzero(_changes(rows))
        # The last sample may go on in the next batch.
        for at in range(0, len(begins) - 1, most):
            some = begins[at : min(at + most, len(begins) - 1)]
            stop = begins[min(at + most, len(begins) - 1)]
            yield rows.slice(some[0], stop - some[0]), some - some[0]
        held = rows.slice(begins[-1])
    if held:
        yield held.combine_chunks(), np.zeros(1, np.int64)


def _changes(rows: pa.Table) -> np.ndarray:
    out = np.ones(len(rows), bool)
    out[1:] = False
    for name in SAMPLE:
        column = rows.column(name)
        a, b = column.slice(1), column.slice(0, len(column) - 1)
        unlike = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        out[1:] |= unlike.to_numpy()
    return out


def _covered(winners: DataFrame, grid: int, kept: tuple[str, ...]) -> DataFrame:
    """KEYS and heat of the cells that the centre cells ``winners`` (KEYS, radius, ``kept``) cover, with ``kept`` where a centre lies.

    Only centre cells travel, at most ``grid`` x ``grid`` of a sample; of a
    sample's cells none leaves the task that it is drawn in. They come one
    sample after the other.
    """

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, begins in whole_samples(batches):
            y, x, radius = (rows.column(c).to_numpy() for c in ("y", "x", "radius"))
            sample = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(rows))))
            edge = int(radius.max())
            wide = grid + 2 * edge
            heat = np.zeros((len(begins), wide, wide))
            for r in np.unique(radius).tolist():
                these = np.flatnonzero(radius == r)
                span, sigma = np.arange(-r, r + 1), max(r / 3.0, 0.5)
                squares = span[:, None] ** 2 + span**2
                value = np.where(squares == 0, 1.0, np.exp(-squares / (2 * sigma * sigma))).ravel()
                offset = (span[:, None] * wide + span).ravel()
                at = (sample[these] * wide + y[these] + edge) * wide + x[these] + edge
                np.maximum.at(heat.reshape(-1), (at[:, None] + offset).ravel(), np.tile(value, len(these)))
            inside = heat[:, edge : edge + grid, edge : edge + grid]
            s, cy, cx = np.nonzero(inside)
            first = pa.array(begins[s])
            out = [rows.column(c).combine_chunks().take(first) for c in SAMPLE] + [pa.array(cy.astype(np.int32)), pa.array(cx.astype(np.int32)), pa.array(inside[s, cy, cx])]
            if kept:
                place = np.full((len(begins), grid, grid), -1)
                place[sample, y, x] = np.arange(len(rows))
                own = place[s, cy, cx]
                centre = pa.array(own, mask=own < 0)
                out += [rows.column(c).combine_chunks().take(centre) for c in kept]
            yield pa.RecordBatch.from_arrays(out, [*KEYS, "heat", *kept])

    kinds = [*(winners.schema[c] for c in KEYS), StructField("heat", DoubleType()), *(winners.schema[c] for c in kept)]
    rows = winners.select(*SAMPLE, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("radius").cast("int").alias("radius"), *kept)
    return by_sample(rows).mapInArrow(draw, StructType(kinds))


def _winner(columns: tuple[str, ...]):
    """Of the centres in a cell the one of the largest area, the later one on a tie of 32-bit areas."""
    place = F.struct((F.col("w") * F.col("h")).cast("float").alias("area"), "ord")
    return F.max_by(F.struct(*columns), place)


def heat_cells(centres: DataFrame, grid: int = GRID) -> DataFrame:
    """Largest Gaussian of any instance in each covered cell: of the centres in a cell the widest one's is nowhere less than another's."""
    return _covered(centres.groupBy(*KEYS).agg(F.max("radius").alias("radius")), grid, ())


def centre_cells(centres: DataFrame) -> DataFrame:
    """Size, offset and mask of each centre cell, of the centre that wins it."""
    won = _winner(("w", "h", "dx", "dy", "radius", "ord"))
    return centres.groupBy(*KEYS).agg(won.alias("c"), F.count("*").alias("n_centres")).select(*KEYS, "c.*", "n_centres", F.lit(1.0).alias("mask"))


def target_cells(centres: DataFrame, grid: int = GRID) -> DataFrame:
    """``heat_cells`` with ``centre_cells``' w, h, dx, dy and mask (null, and 0, where no centre lies), in one pass."""
    kept = ("w", "h", "dx", "dy")
    winners = centres.groupBy(*KEYS).agg(F.max("radius").alias("radius"), _winner(kept).alias("c")).select(*KEYS, "radius", "c.*")
    return _covered(winners, grid, kept).withColumn("mask", F.col("w").isNotNull().cast("double"))


def kept_boxes(centres: DataFrame) -> DataFrame:
    """All valid boxes of a sample, also those that lost their cell, in order."""
    rows = F.sort_array(F.collect_list(F.struct("ord", "ix0", "iy0", "ix1", "iy1")))
    return centres.groupBy("scene_id", "class_id").agg(rows.alias("boxes"))
