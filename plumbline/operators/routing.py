"""Samples sent through the kernel of their class, or through every class's."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Samples of a class that one task takes.
GROUP_ROWS = 50_000
#: Classes whose kernels are broadcast, at most.
MOST_CLASSES = 1000

Kernel = Callable[[np.ndarray, np.ndarray], Mapping[str, np.ndarray]]


def kernels_of(rows: DataFrame, key: str = "class_id", values: str = "values") -> dict[int, np.ndarray]:
    """Parameters by class from a table of one row a class; more than ``MOST_CLASSES`` are an error."""
    found = rows.select(key, values).limit(MOST_CLASSES + 1).collect()
    if len(found) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes")
    return {r[0]: np.array(r[1], float) for r in found}


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(whole), -1)


def by_class(samples: DataFrame, kernels: dict[int, np.ndarray], kernel: Kernel, outputs: str, sample: str = "sample_id", key: str = "class_id", values: str = "values", group_rows: int = GROUP_ROWS) -> DataFrame:
    """``samples`` with the outputs of the kernel of their own class.

    Samples are grouped by class, a class of more than ``group_rows`` dealt by
    hash of the sample, and a group goes through ``kernel(values, parameters)``
    at once; outputs come back by sample. ``outputs`` is their schema as DDL.
    A sample of no known class, or without values, has null outputs; all
    values have one length. Samples that repeat an id share their outputs.
    """
    shared = samples.sparkSession.sparkContext.broadcast(kernels)
    names = [c.split()[0] for c in outputs.split(", ")]
    usable = samples.where(F.col(key).isin(list(kernels)) & F.col(values).isNotNull()).select(sample, key, values)
    counts = usable.groupBy(key).agg(F.count("*").alias("_n")).select(key, F.ceil(F.col("_n") / group_rows).cast("int").alias("_deals"))
    # One row a class, of at most MOST_CLASSES.
    dealt = usable.join(F.broadcast(counts), key).withColumn("_deal", F.pmod(F.xxhash64(sample), F.col("_deals"))).drop("_deals")
    schema = f"{sample} {samples.schema[sample].dataType.simpleString()}, {outputs}"

    def run(group: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        found = kernel(_matrix(table.column(values)), shared.value[group[0].as_py()])
        return pa.table({sample: table.column(sample), **{name: pa.array(found[name]) for name in names}})

    routed = dealt.groupBy(key, "_deal").applyInArrow(run, schema).dropDuplicates([sample])
    return samples.join(routed, sample, "left")


def by_every_class(samples: DataFrame, kernels: dict[int, np.ndarray], kernel: Kernel, outputs: str, sample: str = "sample_id", key: str = "class_id", values: str = "values") -> DataFrame:
    """Each sample with each class's outputs, class by class within a batch: samples are read once and not sent. Samples without values are left out."""
    shared = samples.sparkSession.sparkContext.broadcast(kernels)
    names = [c.split()[0] for c in outputs.split(", ")]
    schema = f"{sample} {samples.schema[sample].dataType.simpleString()}, {key} int, {outputs}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(values))
                for class_id, parameters in shared.value.items():
                    found = kernel(x, parameters)
                    yield pa.RecordBatch.from_pydict({sample: batch.column(sample), key: pa.array(np.full(len(x), class_id), pa.int32()), **{name: pa.array(found[name]) for name in names}})

    return samples.where(F.col(values).isNotNull()).select(sample, values).mapInArrow(run, schema)
