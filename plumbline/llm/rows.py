"""Helpers that the text operators share: key columns and Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null document id, beside a mark that it is null: it sorts after every other id.
NULL_ID = (1 << 63) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` alone (null text: empty), so that no other column can clash."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )


def keyed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``texts`` with ``okey`` (the id) and ``nul`` (the id is null, ``okey`` the greatest); the columns ``keep`` as ``_keep_*``.

    Rows that repeat an id and its text are one document, rows that repeat an
    id with another text are two.
    """
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("okey"),
        F.col(id_col).cast("long").isNull().alias("nul"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        *(F.col(c).alias(f"_keep_{c}") for c in keep),
    )


def map_batches(df: DataFrame, make: Callable[[], Callable | tuple[Callable, Callable]], schema: str) -> DataFrame:
    """``make()`` once a task, what it returns once an Arrow batch; it yields columns by name.

    Where ``make()`` returns two functions, the second one yields what the first still holds after the last batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = make()
        step, rest = made if isinstance(made, tuple) else (made, tuple)
        for batch in batches:
            if batch.num_rows:
                for columns in step(batch):
                    yield arrow_batch(columns)
        for columns in rest():
            yield arrow_batch(columns)
        del made, step, rest
        release_memory()

    return df.mapInArrow(run, schema)


#: Bytes of an Arrow batch that goes to Python: Spark's setting, its default, and what a program of many steps sets.
BATCH_SETTING, SPARKS_BATCH_BYTES, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "2m"


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches end at ``BATCH_BYTES``, unless it has a limit of its own.

    A batch lies in the executor and in Python at once, and in the executor its memory
    does not go back to the system. What is returned to be run later needs the setting too, so it stays.
    """
    if spark.conf.get(BATCH_SETTING) == SPARKS_BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def release_memory() -> None:
    """Gives free memory back to the system: workers live on, and what a task leaves would add to what the next ones take."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def arrow_batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})


def utf8(column: pa.Array) -> list[bytes]:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, which all executors share.

    Only a session of one machine may be without one, as in tests; it gets a folder of its own.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


#: Spark removes the shuffle files of a query as soon as it has run; a query that runs again makes them again.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder, lineage cut, the shuffle files that led to it removed.

    Spark may clean it up once ``df`` is gone (``spark.cleaner.referenceTracking.cleanCheckpoints``).
    """
    conf = df.sparkSession.conf
    shared_folder(df.sparkSession)
    before = conf.get(FREE_SHUFFLES)
    conf.set(FREE_SHUFFLES, "true")
    try:
        # Its plan is made under this setting.
        return df.select("*").checkpoint(eager=True)
    finally:
        conf.set(FREE_SHUFFLES, before)


def dropped(spark: SparkSession, folder: str) -> None:
    """Removes a folder that this engine has written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of one key that go to one task, and keys that may have more.
KEY_ROWS, MOST_HOT_KEYS = 50_000, 100_000


def even_join(rows: DataFrame, one: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``one`` (a row a key) on ``key``; keys of very many rows are dealt to several tasks.

    ``rows`` is read twice, so it should be written. The hot keys that are
    broadcast are at most ``MOST_HOT_KEYS``, since each has more rows than that share of all.
    """
    n = rows.count()
    least = max(KEY_ROWS, n // MOST_HOT_KEYS)
    if n <= least:
        return rows.join(one, key, how)
    hot = rows.groupBy(key).count().where(F.col("count") > least).select(key, F.ceil(F.col("count") / least).cast("int").alias("_deals"))
    hot = F.broadcast(hot)
    dealt = rows.join(hot, key, "left").withColumn("_deal", F.pmod(F.xxhash64(*rows.columns), F.coalesce("_deals", F.lit(1))).cast("int")).drop("_deals")
    copied = one.join(hot, key, "left").withColumn("_deal", F.explode(F.sequence(F.lit(0), F.coalesce("_deals", F.lit(1)) - 1))).drop("_deals")
    return dealt.join(copied, [key, "_deal"], how).drop("_deal")
