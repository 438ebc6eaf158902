"""Metadata of the older layout: one JSON document with a list of samples, whose labels vary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructType
from pyspark.sql.window import Window

NO_LABELS = ("idx", "image_path")


def samples_of(documents: DataFrame) -> DataFrame:
    """One row for each of the ``samples`` of parsed documents."""
    return documents.select(F.explode("samples").alias("s")).select("s.*")


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """The samples of metadata files; a file is one JSON document, which one task reads."""
    return samples_of(spark.read.option("multiLine", "true").json(path))


def coerced(samples: DataFrame) -> DataFrame:
    """Nested values as JSON text; plain ones as they are."""
    nested = {f.name: F.to_json(f.name) for f in samples.schema if isinstance(f.dataType, (StructType, ArrayType, MapType))}
    return samples.withColumns(nested)


def label_counts(samples: DataFrame, top: int = 10) -> DataFrame:
    """The most frequent values of each label whose values are strings: label, value, n and a bar of up to 30 marks; ties by the least ``idx``.

    Nulls are not counted, but samples with them are in the total. Without such labels there are no rows.
    """
    labels = [f.name for f in samples.schema if f.name not in NO_LABELS and isinstance(f.dataType, StringType)]
    total = samples.agg(F.count("*").alias("total"))
    pairs = F.array(*(F.struct(F.lit(name).alias("label"), F.col(name).alias("value")) for name in labels)) if labels else F.array().cast("array<struct<label:string,value:string>>")
    values = samples.select("idx", F.explode(pairs).alias("p")).select("idx", "p.*").where("value is not null")
    counts = values.groupBy("label", "value").agg(F.count("*").alias("n"), F.min("idx").alias("first"))
    # Spark keeps the best of each task's rows before it sends them, so that a label of many values stays small.
    ranked = counts.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "first", "value"))).where(F.col("place") <= top)
    # One row.
    return ranked.join(F.broadcast(total)).select("label", "value", "n", F.repeat(F.lit("█"), (F.col("n") / F.col("total") * 30).cast("int")).alias("bar"))
