"""Images as rows: reading, resizing and normalising, and heat maps drawn or laid over them.

Pixels are bytes, row by row from the top. Spark's reader gives the channels
blue first; what this module makes has red first.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType, IntegerType, StructField, StructType

from plumbline.functions.geometry import GRID, IMAGE_SIZE, STRIDE

#: Strengths of a heat map's red and green, and of the red laid over an image.
RED, GREEN, ALPHA = 255, 80, 170

PIXELS = pa.schema([("path", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("channels", pa.int32()), ("pixels", pa.binary()), ("palette", pa.binary())])


def images(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """path, width, height, channels and pixels of the images in a folder; files that are no image are left out."""
    reader = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", str(recursive).lower())
    return reader.load(folder).select(
        F.col("image.origin").alias("path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"),
        F.col("image.nChannels").alias("channels"), F.col("image.data").alias("pixels"),
    )


def rgb(pixels: bytes, width: int, height: int, channels: int) -> np.ndarray:
    """Height, width and red, green, blue of a reader's pixels; grey ones are repeated, transparency is dropped."""
    values = np.frombuffer(pixels, np.uint8).reshape(height, width, channels)
    return np.repeat(values, 3, axis=2) if channels == 1 else values[:, :, 2::-1]


def _taps(n: int, size: int) -> np.ndarray:
    """How much each of ``n`` places counts for each of ``size``: triangles about the same point, wider where places are many."""
    step = n / size
    centre = (np.arange(size)[:, None] + 0.5) * step
    return np.maximum(0, 1 - abs(np.arange(n) + 0.5 - centre) / max(step, 1.0))


def _along_rows(values: np.ndarray, size: int) -> np.ndarray:
    taps = _taps(values.shape[0], size)
    return np.tensordot(taps, values, 1) / taps.sum(1).reshape(-1, *[1] * (values.ndim - 1))


def resized(values: np.ndarray, size: int) -> np.ndarray:
    """A square of ``size``; bytes are rounded half up after each direction, width first."""
    across = np.floor(_along_rows(values.swapaxes(0, 1).astype(np.float64), size).swapaxes(0, 1) + 0.5)
    return np.floor(_along_rows(across, size) + 0.5).astype(np.uint8)


def _by_row(rows: DataFrame, name: str, kind, make: Callable) -> DataFrame:
    """``rows`` with a column in place of the pixels; one row leaves at a time, so that a task holds one image's values."""
    kept = [c for c in rows.columns if c not in ("width", "height", "channels", "pixels", "cells")]

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.iloc[i : i + 1]
                yield row[kept].assign(**{name: [make(row.iloc[0])]})

    return rows.mapInPandas(step, StructType([*(rows.schema[c] for c in kept), StructField(name, kind)]))


def normalised(rows: DataFrame, size: int = IMAGE_SIZE) -> DataFrame:
    """Images resized to a square and scaled to -1 to 1: ``values``, by channel (red first), row and column. Further columns stay.

    Rows without pixels are left out. Sums are exact where fixed-point filters
    round, so a byte may differ from theirs by one.
    """

    def make(row):
        square = resized(rgb(row.pixels, row.width, row.height, row.channels), size)
        return (square.transpose(2, 0, 1).ravel() / 127.5 - 1).astype(np.float32)

    return _by_row(rows.where("pixels is not null and width > 0 and height > 0"), "values", ArrayType(FloatType()), make)


def heat_squares(heat: DataFrame) -> DataFrame:
    """Each cell of a heat map (y, x, heat) as the square of pixels that it covers and its colour and transparency."""
    shade = {name: F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("heat"))) * most).cast("int") for name, most in (("red", RED), ("green", GREEN), ("alpha", ALPHA))}
    corner = {f"p{c}{i}": (F.col(c) + i) * STRIDE for c in ("x", "y") for i in (0, 1)}
    return heat.withColumns(shade | corner)


def overlaid(rows: DataFrame, heat: DataFrame, key: str, size: int = IMAGE_SIZE, cells: int = GRID) -> DataFrame:
    """Images with one heat map each laid over them in red: ``overlay``, pixels of a square, red first. Images without heat stay as they are.

    ``heat`` (key, y, x, heat) has at most ``cells`` x ``cells`` cells a key, which travel as one array.
    """
    maps = heat.groupBy(key).agg(F.collect_list(F.struct("y", "x", "heat")).alias("cells"))

    def make(row):
        base = resized(rgb(row.pixels, row.width, row.height, row.channels), size).astype(np.float64)
        grid = np.zeros((cells, cells))
        for c in row.cells if row.cells is not None else ():
            grid[c["y"], c["x"]] = c["heat"]
        smooth = _along_rows(_along_rows(grid.T, size).T, size)
        alpha = np.floor(np.clip(smooth * ALPHA, 0, ALPHA))[:, :, None] / 255
        return np.floor(base * (1 - alpha) + np.array([255, 0, 0]) * alpha + 0.5).astype(np.uint8).tobytes()

    return _by_row(rows.where("pixels is not null and width > 0 and height > 0").join(maps, key, "left"), "overlay", BinaryType(), make)


def png_pixels(content: bytes) -> tuple[int, int, int, bytes, bytes | None] | None:
    """Width, height, channels, pixels (row by row, red first) and palette (red, green, blue, alpha of each colour) of a PNG file of up to 8 bits; None if it is none.

    Interlaced files and those of 16 bits are not read.
    """
    try:
        if content[:8] != b"\x89PNG\r\n\x1a\n":
            return None
        at, data, colours, clear = 8, [], b"", b""
        while at + 8 <= len(content):
            size, kind = int.from_bytes(content[at : at + 4], "big"), content[at + 4 : at + 8]
            body = content[at + 8 : at + 8 + size]
            if kind == b"IHDR":
                width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", body)
            elif kind == b"PLTE":
                colours = body
            elif kind == b"tRNS":
                clear = body
            elif kind == b"IDAT":
                data.append(body)
            at += size + 12
        channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
        if interlaced or depth > 8:
            return None
        across = -(-width * channels * depth // 8)
        lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, across + 1)
        rows = _unfiltered(lines[:, 0], lines[:, 1:], max(1, channels * depth // 8))
        if depth < 8:
            bits = np.unpackbits(rows, axis=1)[:, : width * depth].reshape(height, width, depth)
            rows = (bits * (1 << np.arange(depth)[::-1])).sum(2).astype(np.uint8)
            rows = rows if colour == 3 else (rows * (255 // ((1 << depth) - 1))).astype(np.uint8)
        palette = None
        if colour == 3:
            rgba = np.full((len(colours) // 3, 4), 255, np.uint8)
            rgba[:, :3] = np.frombuffer(colours, np.uint8).reshape(-1, 3)
            rgba[: len(clear), 3] = np.frombuffer(clear, np.uint8)[: len(rgba)]
            palette = rgba.tobytes()
        return width, height, channels, rows.tobytes(), palette
    except (struct.error, zlib.error, ValueError, KeyError, UnboundLocalError):
        return None


def _unfiltered(kinds: np.ndarray, lines: np.ndarray, step: int) -> np.ndarray:
    """Rows of a PNG file as drawn: each is stored as differences from what lies left (``step`` bytes) and above."""
    out = np.zeros((len(lines), lines.shape[1]), np.uint8)
    above = np.zeros(lines.shape[1], np.uint8)
    for y, (kind, line) in enumerate(zip(kinds.tolist(), lines)):
        if kind == 0:
            row = line
        elif kind == 1:
            padded = np.concatenate([line, np.zeros(-len(line) % step, np.uint8)]).reshape(-1, step)
            row = np.cumsum(padded, axis=0, dtype=np.uint8).ravel()[: len(line)]
        elif kind == 2:
            row = line + above
        else:
            row = _from_neighbours(kind, line.tolist(), above.tolist(), step)
        out[y] = above = row
    return out


def _from_neighbours(kind: int, line: list[int], above: list[int], step: int) -> np.ndarray:
    left, corner, row = [0] * step, [0] * step, []
    for i, (x, up) in enumerate(zip(line, above)):
        a, c = left[i % step], corner[i % step]
        if kind == 3:
            guess = (a + up) // 2
        else:
            p = a + up - c
            guess = min((abs(p - a), 0, a), (abs(p - up), 1, up), (abs(p - c), 2, c))[2]
        value = (x + guess) & 255
        left[i % step], corner[i % step] = value, up
        row.append(value)
    return np.array(row, np.uint8)


def png_images(files: DataFrame) -> DataFrame:
    """path, width, height, channels, pixels and palette of PNG files (path, content); what is no PNG is left out."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                found = png_pixels(content or b"")
                if found:
                    yield pa.RecordBatch.from_pylist([dict(zip(PIXELS.names, (path, *found)))], schema=PIXELS)

    return files.select("path", "content").mapInArrow(step, "path string, width int, height int, channels int, pixels binary, palette binary")


def over_white(pixels: bytes, channels: int, palette: bytes | None) -> np.ndarray:
    """Red, green and blue of each pixel, laid over white by its alpha: of 2 and 4 channels the last one, of a palette its fourth.

    Grey ones are repeated; a colour that the palette does not have is white.
    """
    values = np.frombuffer(pixels, np.uint8).reshape(-1, channels)
    if palette is not None:
        table = np.zeros((256, 4), np.uint8)
        colours = np.frombuffer(palette, np.uint8).reshape(-1, 4)[:256]
        table[: len(colours)] = colours
        values = table[values[:, 0]]
    if values.shape[1] in (1, 3):
        return np.repeat(values, 3, axis=1) if values.shape[1] == 1 else values
    colour, alpha = values[:, :-1].astype(np.uint32), values[:, -1:].astype(np.uint32)
    laid = (255 * (255 - alpha) + colour * alpha + 127) // 255
    return np.repeat(laid, 3, axis=1).astype(np.uint8) if laid.shape[1] == 1 else laid.astype(np.uint8)


def composited(rows: DataFrame) -> DataFrame:
    """Images (width, height, channels, pixels and ``palette``, red first) as three channels over white; further columns stay. Rows without pixels are left out.

    The pixels of a batch's images of one kind are one array; an image with a
    palette goes by itself.
    """
    kept = [c for c in rows.columns if c not in ("channels", "pixels", "palette")]
    ready = rows if "palette" in rows.columns else rows.withColumn("palette", F.lit(None).cast("binary"))
    schema = StructType([*(rows.schema[c] for c in kept), StructField("channels", IntegerType()), StructField("pixels", BinaryType())])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pixels, channels, palettes = (batch.column(c).to_pylist() for c in ("pixels", "channels", "palette"))
            out: list[bytes | None] = [None] * len(pixels)
            for kind in set(zip(channels, [p is None for p in palettes])):
                those = [i for i in range(len(pixels)) if (channels[i], palettes[i] is None) == kind]
                for some in [those] if kind[1] else [[i] for i in those]:
                    laid = over_white(b"".join(pixels[i] for i in some), kind[0], palettes[some[0]])
                    ends = np.cumsum([len(pixels[i]) // kind[0] for i in some])
                    for i, part in zip(some, np.split(laid, ends[:-1])):
                        out[i] = part.tobytes()
            columns = {c: batch.column(c) for c in kept} | {"channels": pa.array([3] * len(out), pa.int32()), "pixels": pa.array(out, pa.binary())}
            yield pa.RecordBatch.from_pydict(columns)

    return ready.where("pixels is not null and channels between 1 and 4").select(*kept, "channels", "pixels", "palette").mapInArrow(step, schema)
