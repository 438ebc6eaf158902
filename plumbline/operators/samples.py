"""The index of samples: one row for each image and class in it, counts, weights, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.dims import CLASS_IDS
from plumbline.sources.shared import saved

BATCH = 4
#: Positions of a class that one task ranks.
RANK_BLOCK = 65_536
#: Weights that are given count in these units.
WEIGHT_UNIT = 2.0**-30


def with_index(df: DataFrame, block: list[str], within: list[str], name: str = "idx", apart: tuple[str, ...] = ()) -> DataFrame:
    """Gapless position in the order of ``block`` and then ``within``, from 0; for each value of ``apart`` by itself.

    Blocks are counted first, so that no task sorts more than a block's rows;
    only the counts, one row a block, are ordered together.
    """
    keys = [*apart, *block]
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    order = Window.partitionBy(*apart).orderBy(*block) if apart else Window.orderBy(*block)
    before = F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*keys, before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*within)).cast("long") - 1
    return df.withColumn("_inside", inside).join(starts, keys).withColumn(name, F.col("_before") + F.col("_inside")).drop("_inside", "_before")


def ordinals(df: DataFrame, *order: str, name: str = "idx") -> DataFrame:
    """``df`` with its gapless position in ``order``, from 0.

    Ranges of the order are dealt to tasks, which sort them and number their
    rows; the result is written once, and a range starts where the counts of
    those before it end. Only those counts, one a range, meet in one task.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    # The number has the range in its upper bits and the place in the lower 33.
    placed = saved(ranged.withColumns({"_range": F.shiftright("_place", 33), "_place": F.col("_place").bitwiseAND((1 << 33) - 1)}))
    counts = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    # One row a range: as many as there are shuffle partitions.
    return placed.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_place")).drop("_range", "_place", "_start")


def expanded(boxes: DataFrame) -> DataFrame:
    """Distinct known classes of each image: scene_id, class_name, class_id."""
    return boxes.where("class_id >= 0").select("scene_id", "class_name", "class_id").distinct()


def class_counts(samples: DataFrame) -> DataFrame:
    return samples.groupBy("class_id", "class_name").agg(F.count("*").alias("n"))


def weights(samples: DataFrame, power: float = 0.5) -> DataFrame:
    """Each sample's weight, falling with its class's count, which covers all of ``samples``."""
    counts = samples.groupBy("class_id").agg(F.count("*").alias("n"))
    # One row a class: 35 at most.
    return samples.join(F.broadcast(counts), "class_id").withColumn("weight", F.pow(F.greatest(F.lit(1), F.col("n")), F.lit(-power)))


def hash_uniform(*columns: str | Column) -> Column:
    """A number in [0, 1) from whole-number columns, the same in every engine: a linear congruence."""
    mixed = F.lit(12_345).cast("long")
    for c in columns:
        mixed = (mixed * 48_271 + (F.col(c) if isinstance(c, str) else c)) % 2_147_483_647
    return ((mixed * 48_271) % 2_147_483_647) / F.lit(2_147_483_647.0)


def weighted_draws(samples: DataFrame, power: float = 0.5) -> DataFrame:
    """As many draws with replacement as samples: first a class by its total weight, then a member of it uniformly.

    Members are found by (class, rank), an equi-join. ``samples`` has idx.
    A class is ranked in blocks of positions.
    """
    blocks = samples.select("idx", "class_id", F.expr(f"idx div {RANK_BLOCK}").alias("_block"))
    ranked = with_index(blocks, ["_block"], ["idx"], "rank", apart=("class_id",)).drop("_block")
    per_class = samples.groupBy("class_id").agg(F.count("*").alias("n")).withColumn("w", F.col("n") * F.pow(F.col("n").cast("double"), F.lit(-power)))
    order = Window.orderBy("class_id")
    cdf = per_class.select(
        "class_id",
        "n",
        (F.sum("w").over(order) / F.sum("w").over(Window.partitionBy(F.lit(0)))).alias("upper"),
    )
    table = cdf.agg(F.sort_array(F.collect_list(F.struct("upper", "class_id", "n"))).alias("cdf")).withColumn("one", F.lit(1))  # one row of at most 35 entries
    draws = samples.select(F.col("idx").alias("draw"), F.lit(1).alias("one")).join(F.broadcast(table), "one")
    u, v = hash_uniform("draw", F.lit(1)), hash_uniform("draw", F.lit(2))
    chosen = draws.withColumn("u", u).withColumn("hit", F.coalesce(F.get(F.filter("cdf", lambda c: c["upper"] > F.col("u")), F.lit(0)), F.element_at("cdf", -1)))
    return (
        chosen.select("draw", F.col("hit.class_id").alias("class_id"), F.least(F.floor(v * F.col("hit.n")), F.col("hit.n") - 1).cast("long").alias("rank"))
        .join(ranked, ["class_id", "rank"])
        .select("draw", "class_id", F.col("idx").alias("pick"))
    )


def draws_by_weight(samples: DataFrame, draws: int | None = None, seed: int = 5) -> DataFrame:
    """(draw, pick): draws with replacement of ``samples`` (idx, weight) by weights that are given; as many as samples, or ``draws``.

    Weights become whole numbers of ``WEIGHT_UNIT``, so that their running sums
    are exact: sums by block of idx first, then within a block. The range of
    all sums is cut into as many bins as samples. A draw is a point, which lies
    in one bin, and meets the samples whose ranges reach into that bin: an
    equi-join on keys that draws fill evenly, however the weights are spread.
    A sample without a weight, or with 0 or less, is never drawn; if none has
    one there are no draws. idx has no repeats.
    """
    units = F.round(F.col("weight") / F.lit(WEIGHT_UNIT)).cast("long")
    rows = samples.select("idx", units.alias("_units"), F.expr(f"idx div {RANK_BLOCK}").alias("_block")).where("_units > 0")
    blocks = rows.groupBy("_block").agg(F.sum("_units").alias("_sum"), F.count("*").alias("_rows"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    # One row a block of 65,536 samples.
    starts = saved(blocks.select("_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"), "_sum", "_rows"))
    found = starts.agg(F.sum("_sum").alias("total"), F.sum("_rows").alias("n")).first()
    total, n = found.total or 1, found.n or 1
    draws = (samples.count() if draws is None else draws) if found.n else 0
    width = -(-total // n)
    inside = F.sum("_units").over(Window.partitionBy("_block").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    ranged = rows.withColumn("_upto", inside).join(starts.select("_block", "_start"), "_block").select("idx", (F.col("_start") + F.col("_upto") - F.col("_units")).alias("low"), (F.col("_start") + F.col("_upto")).alias("high"))
    ranged = ranged.withColumns({"first": F.expr(f"low div {width}"), "last": F.expr(f"(high - 1) div {width}")})
    # A heavy sample reaches into very many bins: its bins are dealt out in pieces.
    heavy = ranged.where(F.col("last") - F.col("first") >= RANK_BLOCK).withColumn("piece", F.explode(F.sequence("first", "last", F.lit(RANK_BLOCK)))).repartition("idx", "piece")
    heavy = heavy.withColumn("bin", F.explode(F.sequence("piece", F.least(F.col("piece") + (RANK_BLOCK - 1), "last"))))
    light = ranged.where(F.col("last") - F.col("first") < RANK_BLOCK).withColumn("bin", F.explode(F.sequence("first", "last")))
    reach = light.unionByName(heavy.select(light.columns)).select("idx", "low", "high", "bin")
    u = hash_uniform("draw", F.lit(seed))
    points = samples.sparkSession.range(draws).select(F.col("id").alias("draw")).withColumn("point", F.least(F.floor(u * float(total)), F.lit(total - 1)).cast("long"))
    hits = points.withColumn("bin", F.expr(f"point div {width}")).join(reach, "bin").where("point >= low and point < high")
    return hits.select("draw", F.col("idx").alias("pick"))


def batches(samples: DataFrame, size: int = BATCH) -> DataFrame:
    """Batch number by position; the last batch may be smaller."""
    return samples.withColumn("batch_id", F.expr(f"idx div {int(size)}"))


def collated(batched: DataFrame) -> DataFrame:
    """Each batch's ids and names in order of position."""
    rows = F.sort_array(F.collect_list(F.struct("idx", "class_id", "class_name", "scene_id")))
    return batched.groupBy("batch_id").agg(rows.alias("rows")).select(
        "batch_id",
        F.size("rows").alias("n"),
        F.array_join(F.transform("rows", lambda r: r["class_id"].cast("string")), ",").alias("class_ids"),
        F.array_join(F.transform("rows", lambda r: r["class_name"]), ",").alias("class_names"),
        F.array_join(F.transform("rows", lambda r: r["scene_id"].cast("string")), ",").alias("sample_ids"),
    )


def every_class(samples: DataFrame) -> DataFrame:
    """Each image with each of the 35 classes: the grid that inference runs over."""
    classes = F.array(*(F.struct(F.lit(i).alias("class_id"), F.lit(name).alias("class_name")) for name, i in CLASS_IDS.items()))
    return samples.select("scene_id").distinct().select("scene_id", F.explode(classes).alias("c")).select("scene_id", "c.class_id", "c.class_name")


def required(indexed: DataFrame) -> DataFrame:
    """``indexed``, or an error if it has no rows."""
    if indexed.isEmpty():
        raise ValueError("no samples: the index is empty")
    return indexed


def first_samples(indexed: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` samples by ``idx``; all of them if ``limit`` is 0 or less, or more than there are."""
    return indexed.where(F.col("idx") < limit) if limit > 0 else indexed
