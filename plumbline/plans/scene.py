"""The scene fixture: one drawn path for each row of ``lineitem``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

IMAGE_W, IMAGE_H, VIEW = 1024, 768, 100.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene_id, ord, sid, iid and the box x0, y0, x1, y1 in view units."""
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    keyed = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("scene_id"),
        (F.row_number().over(order) - 1).cast("int").alias("ord"),
        (F.col("l_partkey") % 37).cast("int").alias("sid"),
        F.when(F.col("l_linenumber") % 2 == 0, F.lit(-1)).otherwise((F.col("l_orderkey") % 3).cast("int")).alias("iid"),
        "l_orderkey",
        "l_partkey",
        "l_quantity",
    )
    stuff = F.col("iid") == -1
    x0 = F.when(stuff, (F.col("l_partkey") * 7) % 85).otherwise((F.col("sid") * 13 + F.col("iid") * 29) % 75) + (F.col("l_orderkey") % 40) / F.lit(10.0)
    y0 = F.when(stuff, (F.col("l_orderkey") * 11) % 85).otherwise((F.col("sid") * 17 + F.col("iid") * 23) % 75) + (F.col("l_partkey") % 40) / F.lit(10.0)
    return keyed.select("scene_id", "ord", "sid", "iid", x0.alias("x0"), y0.alias("y0"), (F.col("l_quantity") / 2).alias("w"), ((F.col("l_partkey") % 50) / F.lit(2.0)).alias("h")).select(
        "scene_id", "ord", "sid", "iid", "x0", "y0", (F.col("x0") + F.col("w")).alias("x1"), (F.col("y0") + F.col("h")).alias("y1")
    )


def source_dir(scene: str = "scene_id"):
    """A fifth of the scenes is the test set, two fifths each of the train sets."""
    part = F.col(scene) % 5
    return F.when(part == 0, "test_set").when(part <= 2, "train_set_1").otherwise("train_set_2")
