"""Scalar geometry as column expressions: pixels, grid cells, Gaussians, boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IMAGE_SIZE, STRIDE = 512, 8
GRID = IMAGE_SIZE // STRIDE


def output_grid(image_size: int, stride: int) -> int:
    if stride <= 0 or image_size % stride:
        raise ValueError(f"image size {image_size} is no multiple of stride {stride}")
    return image_size // stride


def to_pixel(x: Column, scale: float | Column) -> Column:
    """Truncated toward zero."""
    return (x * scale).cast("int")


def to_input(x: Column, size: float | Column, image_size: int = IMAGE_SIZE) -> Column:
    """Original pixels to input pixels, at most ``image_size - 1``."""
    return F.greatest(F.lit(0.0), F.least(F.lit(float(image_size - 1)), x * (F.lit(float(image_size)) / size)))


def gaussian_radius(w: Column, h: Column) -> Column:
    return F.greatest(F.lit(1), (F.least(w, h) / 2.5).cast("int"))


def decoded_box(x: Column, y: Column, dx: Column, dy: Column, w: Column, h: Column, stride: int = STRIDE) -> dict[str, Column]:
    """Corners in input pixels, not clipped."""
    cx, cy = (x + dx) * stride, (y + dy) * stride
    return {"x0": cx - w * stride / 2, "y0": cy - h * stride / 2, "x1": cx + w * stride / 2, "y1": cy + h * stride / 2}


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def relu(x: Column) -> Column:
    return F.greatest(F.lit(0.0), x)
