"""Constant dimensions: classes, splits, prompts, renames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Class names by semantic id, from 1.
CLASS_NAMES = (
    "wall", "door_single", "door_double", "door_sliding", "window", "door_revolving", "window_bay", "window_blind",
    "stair", "ramp", "elevator", "escalator", "column", "toilet", "sink", "bathtub", "shower", "washing_machine",
    "refrigerator", "oven", "bed", "sofa", "table", "chair", "room_label", "floor_plan_area", "parking", "plant",
    "counter", "cabinet", "tv", "escalator_stair", "dimension_line", "symbol_misc", "annotation_text",
)
# Prefixes of old crop names and what they become.
RENAMES = {
    "class_06": "door_revolving",
    "class_08": "window_blind",
    "class_10": "ramp",
    "class_25": "room_label",
    "class_26": "floor_plan_area",
    "class_32": "escalator_stair",
    "class_35": "annotation_text",
}
# Source folders of each split, in order.
SPLITS = {"train": ("train_set_1", "train_set_2"), "test": ("test_set",)}

CLASS_IDS = {name: i for i, name in enumerate(sorted(CLASS_NAMES))}


def class_dim(spark: SparkSession) -> DataFrame:
    """35 rows: sid, class_name, class_id (rank of the name, from 0). Small enough to broadcast by construction."""
    return spark.createDataFrame([(i, name, CLASS_IDS[name]) for i, name in enumerate(CLASS_NAMES, 1)], "sid int, class_name string, class_id int")


def prompt(name: Column) -> Column:
    return F.concat(F.lit("Find "), name, F.lit(" in this floor plan drawing"))


def source_dirs(split: str) -> tuple[str, ...]:
    """Source folders of a split; an unknown split is an error."""
    if split not in SPLITS:
        raise ValueError(f"unknown split {split!r}; there are {sorted(SPLITS)}")
    return SPLITS[split]
