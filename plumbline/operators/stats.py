"""Statistics of classes, labels, sizes, runs and training metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Scene ids whose running sums one task takes.
SCENE_BLOCK = 4096


def rare_and_common(samples: DataFrame, k: int = 5) -> DataFrame:
    """The k classes with the fewest and the most samples; ties by first position. ``samples`` has idx."""
    counts = samples.groupBy("class_id", "class_name").agg(F.count("*").alias("n"), F.min("idx").alias("first"))
    # One row a class: at most 35 rows in these windows.
    low, high = Window.orderBy("n", "first"), Window.orderBy(F.desc("n"), F.desc("first"))
    every = Window.partitionBy(F.lit(0))
    ranked = counts.select("*", F.row_number().over(low).alias("low"), F.row_number().over(high).alias("high"), F.min("n").over(every).alias("least"), F.max("n").over(every).alias("most"))
    return ranked.where((F.col("low") <= k) | (F.col("high") <= k)).select("class_id", "class_name", "n", "low", "high", "least", "most")


def value_counts(df: DataFrame, column: str, order_by: str, top: int = 10) -> DataFrame:
    """The most frequent values and their counts, ties by first row; with a bar of up to 30 marks."""
    total = df.agg(F.count("*").alias("total"))
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"), F.min(order_by).alias("first")).orderBy(F.desc("n"), "first").limit(top)
    # One row.
    return counts.join(F.broadcast(total)).select("value", "n", F.repeat(F.lit("█"), (F.col("n") / F.col("total") * 30).cast("int")).alias("bar"))


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Bins of equal width between the least and the greatest value, with the mean cut to a whole number."""
    bounds = df.agg(F.min(column).cast("double").alias("low"), F.max(column).cast("double").alias("high"), F.expr(f"sum({column}) div count({column})").alias("mean"))
    # One row.
    placed = df.where(F.col(column).isNotNull()).join(F.broadcast(bounds))
    width = (F.col("high") - F.col("low")) / bins
    bin_of = F.when(F.col("high") == F.col("low"), 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col(column) - F.col("low")) / width)))
    return placed.groupBy(bin_of.cast("int").alias("bin"), "mean").agg(F.count("*").alias("n"))


def run_totals(boxes: DataFrame) -> DataFrame:
    """Samples and instances by split and source folder, with subtotals. ``boxes``: split, source_dir, scene_id, n (instances)."""
    return boxes.rollup("split", "source_dir").agg(F.count("*").alias("samples"), F.sum("n").cast("long").alias("instances"), F.sum((F.col("n") == 0).cast("long")).alias("empty"))


def progress(boxes: DataFrame) -> DataFrame:
    """Running instances of a source folder in order of the scenes: of a block of scene ids, on top of the blocks before it."""
    blocks = boxes.select("source_dir", "scene_id", "n", F.expr(f"scene_id div {SCENE_BLOCK}").alias("_block"))
    totals = blocks.groupBy("source_dir", "_block").agg(F.sum("n").alias("_n"), F.count("*").alias("_rows"))
    earlier = Window.partitionBy("source_dir").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("source_dir").alias("_dir"), F.col("_block").alias("_of"), F.sum("_n").over(earlier).alias("_n_before"), F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_before"))
    order = Window.partitionBy("source_dir", "_block").orderBy("scene_id").rowsBetween(Window.unboundedPreceding, 0)
    inside = blocks.select("source_dir", "scene_id", "_block", F.sum("n").over(order).alias("_n"), F.count("*").over(order).alias("_rows"))
    # Null keys are a folder and a block as well.
    found = inside.join(starts, F.col("source_dir").eqNullSafe(F.col("_dir")) & F.col("_block").eqNullSafe(F.col("_of")))
    running = F.coalesce(F.col("_n") + F.col("_n_before"), "_n", "_n_before")
    return found.select("source_dir", "scene_id", running.cast("long").alias("running"), (F.col("_rows") + F.col("_rows_before")).alias("done"))


def best_so_far(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Epochs whose loss is less than every earlier one's."""
    before = Window.partitionBy(*keys).orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    least = F.coalesce(F.min("loss").over(before), F.lit(float("inf")))
    return metrics.withColumn("least", least).where("loss < least").drop("least")


def running_mean(metrics: DataFrame, keys: list[str], every: int = 20) -> DataFrame:
    """Mean loss up to a step, at every ``every``-th step: of a block of steps, on top of the blocks before it. Null losses do not count; steps have no repeats."""
    blocks = metrics.withColumn("_block", F.expr(f"step div {SCENE_BLOCK}"))
    totals = blocks.groupBy(*keys, "_block").agg(F.sum("loss").alias("_sum"), F.count("loss").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    starts = totals.select(*keys, "_block", F.coalesce(F.sum("_sum").over(earlier), zero).alias("_before"), F.coalesce(F.sum("_n").over(earlier), zero).alias("_n_before"))
    upto = Window.partitionBy(*keys, "_block").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    inside = blocks.withColumns({"_inside": F.coalesce(F.sum("loss").over(upto), zero), "_n_inside": F.count("loss").over(upto)}).where(F.col("step") % every == 0)
    mean = F.try_divide(F.col("_before") + F.col("_inside"), F.col("_n_before") + F.col("_n_inside"))
    return inside.join(starts, [*keys, "_block"]).select(*metrics.columns, mean.alias("mean_loss"))


def periodic(metrics: DataFrame, every: int = 5) -> DataFrame:
    return metrics.where(F.col("epoch") % every == 0)
