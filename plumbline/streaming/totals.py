"""Totals by folder that follow a stream: kept in state from batch to batch, with a line at every 500 drawings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

#: A line for each so many drawings of a folder.
LINE_EVERY = 500
COUNTS = ("processed", "skipped", "instances")
TOTALS = "source_dir string, processed long, skipped long, instances long, line long"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Totals(StatefulProcessor):
    """Adds a batch's counts to its folder's; a row of totals each time, with the last multiple of ``every`` if one was passed."""

    def __init__(self, every: int) -> None:
        self.every = every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", StructType([StructField(c, LongType()) for c in COUNTS]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.sums.get() if self.sums.exists() else (0, 0, 0)
        now = list(before)
        for part in rows:
            now = [a + int(part[c].sum()) for a, c in zip(now, COUNTS)]
        self.sums.update(tuple(now))
        passed = now[0] // self.every * self.every
        yield pd.DataFrame({"source_dir": [key[0]], **{c: [n] for c, n in zip(COUNTS, now)}, "line": pd.array([passed if passed > before[0] else None], "Int64")})

    def close(self) -> None:
        pass


def _added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A task's counts by folder, so that a folder's task gets a row from each task and not from each drawing."""
    sums: dict[str, list[int]] = {}
    for batch in batches:
        done = batch.n.notna()
        for folder, own in batch.assign(done=done).groupby("source_dir"):
            total = sums.setdefault(folder, [0, 0, 0])
            for i, n in enumerate((own.done.sum(), (~own.done).sum(), own.n.sum())):
                total[i] += int(n)
    if sums:
        yield pd.DataFrame([(k, *v) for k, v in sums.items()], columns=["source_dir", *COUNTS])


def running_totals(drawings: DataFrame, every: int = LINE_EVERY) -> DataFrame:
    """Rows of ``TOTALS`` as a stream of ``drawings`` (source_dir, n: its instances, null if it was skipped) comes. Rows without a folder are left out."""
    added = drawings.where("source_dir is not null").select("source_dir", "n").mapInPandas(_added, "source_dir string, processed long, skipped long, instances long")
    return added.groupBy("source_dir").transformWithStateInPandas(Totals(every), TOTALS, "Update", "None")


def follow(spark: SparkSession, source: str, target: str, checkpoint: str, every: int = LINE_EVERY) -> StreamingQuery:
    """Writes the ``running_totals`` of the Parquet files that come to ``source`` (source_dir, n) to ``target``, a folder a batch; a repeated batch replaces its own.

    Ends when all that is there is counted; with the same checkpoint the next run goes on.
    """
    drawings = spark.readStream.schema("source_dir string, n long").option("recursiveFileLookup", "true").parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)  # what keeps state for user-defined operators
    try:
        return running_totals(drawings, every).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, before)


def latest(totals: DataFrame) -> DataFrame:
    """Each folder's last totals, of what ``follow`` has written (with ``batch``): totals only grow."""
    return totals.groupBy("source_dir").max(*COUNTS).toDF("source_dir", *COUNTS)


class ProgressLines(StreamingQueryListener):
    """Keeps one line for each batch that had rows: the query's name, the batch, its rows and seconds."""

    def __init__(self) -> None:
        self.lines: list[str] = []

    def onQueryStarted(self, event) -> None:
        self.lines.append(f"{event.name or event.id}: started")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.numInputRows:
            self.lines.append(f"{p.name or p.id}: batch {p.batchId}, {p.numInputRows} rows, {p.batchDuration / 1000:.1f} s")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.lines.append(f"{event.id}: ended" + (f" ({event.exception.splitlines()[0]})" if event.exception else ""))
