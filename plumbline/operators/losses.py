"""Losses of predicted against target cells, epoch means, and the learning-rate schedule."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.geometry import GRID

KEYS = ["scene_id", "class_id", "y", "x"]
LEAST_P = 1e-4
FOCAL_WEIGHT, SIZE_WEIGHT, OFFSET_WEIGHT = 10.0, 1.0, 1.0
DIVISOR_EPSILON = 1e-4


def matched(preds: DataFrame, heat: DataFrame, centres: DataFrame) -> DataFrame:
    """Predicted cells with their targets; a cell without a target has target and mask 0.

    Predictions are sparse: a cell that is not listed counts as score 0, in ``focal``.
    """
    targets = heat.join(centres.select(*KEYS, F.col("w").alias("tw"), F.col("h").alias("th"), F.col("dx").alias("tdx"), F.col("dy").alias("tdy"), "mask"), KEYS, "full")
    zero = {c: 0.0 for c in ("heat", "tw", "th", "tdx", "tdy", "mask", "score", "w", "h", "dx", "dy")}
    return preds.join(targets, KEYS, "full").fillna(zero)


def _focal_terms() -> dict[str, Column]:
    p = F.greatest(F.lit(LEAST_P), F.least(F.lit(1 - LEAST_P), F.col("score")))
    positive = F.col("heat") == 1.0
    pos = F.when(positive, F.log(p) * (1 - p) * (1 - p)).otherwise(0.0)
    neg = F.when(~positive, F.log(1 - p) * p * p * F.pow(1 - F.col("heat"), F.lit(4.0))).otherwise(0.0)
    return {"pos": pos, "listed": neg, "n_listed": F.lit(1), "num_pos": positive.cast("long")}


def _l1_terms() -> dict[str, Column]:
    def both(a, ta, b, tb):
        return (smooth_l1(F.col(a), F.col(ta)) + smooth_l1(F.col(b), F.col(tb))) * F.col("mask")

    return {"size": both("w", "tw", "h", "th"), "offset": both("dx", "tdx", "dy", "tdy"), "channels": F.col("mask") * 2}


def _sums(cells: DataFrame, keys: list[str], terms: dict[str, Column]) -> DataFrame:
    """Sums of ``terms`` by sample, of which a row each travels, and then by group."""
    samples = list(dict.fromkeys([*keys, "scene_id", "class_id"]))
    by_sample = cells.groupBy(*samples).agg(*(F.sum(c).alias(f"sum_{name}") for name, c in terms.items()))
    return by_sample.groupBy(*keys).agg(*(F.sum(f"sum_{name}").alias(name) for name in terms), F.count("*").alias("n_samples"))


def _dense(sums: DataFrame, cells_of_sample: int) -> DataFrame:
    """An unlisted cell has score 0 and target 0, so it adds a constant."""
    total = F.col("n_samples") * cells_of_sample
    unlisted = math.log(1 - LEAST_P) * LEAST_P**2
    return sums.withColumn("neg", F.col("listed") + (total - F.col("n_listed")) * F.lit(unlisted)).withColumn("n_cells", total)


def focal_sums(cells: DataFrame, keys: list[str], cells_of_sample: int = GRID * GRID) -> DataFrame:
    """Sums of the focal terms over the dense grid of all samples of a group, from its listed cells only."""
    return _dense(_sums(cells, keys, _focal_terms()), cells_of_sample).select(*keys, "pos", "neg", "num_pos", "n_cells")


def _focal() -> Column:
    return F.when(F.col("num_pos") == 0, -F.col("neg") / F.col("n_cells")).otherwise(-(F.col("pos") + F.col("neg")) / F.col("num_pos"))


def focal(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Without positives the mean over all cells, else the sum for each positive."""
    return sums.select(*keys, _focal().alias("focal"), "num_pos")


def smooth_l1(pred: Column, target: Column) -> Column:
    d = F.abs(pred - target)
    return F.when(d < 1, 0.5 * d * d).otherwise(d - 0.5)


def masked_l1(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Smooth L1 of size and offset over centre cells; both channels count in the divisor."""
    return _sums(cells, keys, _l1_terms()).select(*keys, *(c.alias(name) for name, c in _l1().items()))


def _l1() -> dict[str, Column]:
    return {f"{part}_l1": F.col(part) / (F.col("channels") + DIVISOR_EPSILON) for part in ("size", "offset")}


def total_loss(cells: DataFrame, keys: list[str], cells_of_sample: int = GRID * GRID) -> DataFrame:
    """Weighted sum of the three losses, all from one pass over the cells."""
    sums = _dense(_sums(cells, keys, _focal_terms() | _l1_terms()), cells_of_sample).withColumns(_l1())
    return sums.withColumn("focal", _focal()).select(*keys, (FOCAL_WEIGHT * F.col("focal") + SIZE_WEIGHT * F.col("size_l1") + OFFSET_WEIGHT * F.col("offset_l1")).alias("loss"), "focal", "size_l1", "offset_l1", "num_pos")


def epoch_means(by_batch: DataFrame, keys: list[str]) -> DataFrame:
    """Unweighted means over batches; a smaller last batch counts like the others."""
    return by_batch.groupBy(*keys).agg(*(F.avg(c).alias(c) for c in ("loss", "focal", "size_l1", "offset_l1", "num_pos")), F.count("*").alias("n_batches"))


def lr_schedule(spark: SparkSession, n_samples: int, batch_size: int, epochs: int, warmup: int, lr: float) -> DataFrame:
    """Learning rate of every step: a linear rise from a tenth, then a cosine down to a hundredth."""
    total = max(1, epochs * -(-n_samples // batch_size))
    rise = min(warmup, max(1, total - 1))
    t = F.col("step")
    up = lr * (0.1 + 0.9 * t / rise) if rise else F.lit(lr)
    low = lr * 0.01
    down = low + (lr - low) * (1 + F.cos(F.lit(math.pi) * (t - rise) / max(1, total - rise))) / 2
    return spark.range(total).select(F.col("id").alias("step")).select("step", F.when(t < rise, up).otherwise(down).alias("lr"))
