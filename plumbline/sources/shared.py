"""The folder that all executors share, tables written to it, and the stores that Python reaches."""

from __future__ import annotations

import hashlib
import tempfile

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Only a session of one machine may be without one, as in tests; it gets a folder of its own."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder, lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def folder_of(spark: SparkSession, *names: str) -> str:
    """A folder in the shared one for what is made from ``names``: the same whenever this application asks."""
    return f"{shared_folder(spark)}/{names[-1]}-{hashlib.md5(repr(names).encode()).hexdigest()[:16]}"


def exists(spark: SparkSession, path: str) -> bool:
    """If a file or folder is there, as Spark sees it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path)
