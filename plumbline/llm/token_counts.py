"""Exact histogram of encoded lengths, and what suffix sums over it answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.bpe import token_lengths
from plumbline.llm.rows import saved

#: Lengths summed together first, so that no window spans all lengths row by row.
BLOCK = 64


def length_histogram(docs: DataFrame, path: str | None = None, extra: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(length, n_docs): null and empty texts count with length ``extra``; repeated rows count each."""
    return token_lengths(docs, path, extra, id_col, text_col).groupBy("length").agg(F.count("*").alias("n_docs"))


def context_limits(histogram: DataFrame) -> DataFrame:
    """For each length that occurs, taken as context limit, from suffix sums.

    ``n_docs`` documents of that length; ``n_docs_over`` longer ones;
    ``n_tokens`` of the documents within the limit; ``n_tokens_over`` of the
    longer ones; ``n_tokens_truncated``: of all documents, each cut at the
    limit; ``quantile``: the share of documents within the limit. An empty
    histogram gives no rows.
    """
    cells = histogram.withColumn("block", F.expr(f"length div {BLOCK}")).withColumn("t", F.col("length") * F.col("n_docs"))
    blocks = cells.groupBy("block").agg(F.sum("n_docs").alias("bn"), F.sum("t").alias("bt"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("bn").over(later), F.lit(0)).alias("bn_over"),
        F.coalesce(F.sum("bt").over(later), F.lit(0)).alias("bt_over"),
        F.sum("bn").over(every).alias("all_docs"),
        F.sum("bt").over(every).alias("all_tokens"),
    )
    longer = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    n_over = F.col("bn_over") + F.coalesce(F.sum("n_docs").over(longer), F.lit(0))
    t_over = F.col("bt_over") + F.coalesce(F.sum("t").over(longer), F.lit(0))
    return (
        cells.join(blocks, "block")
        .withColumn("n_docs_over", n_over.cast("long"))
        .withColumn("n_tokens_over", t_over.cast("long"))
        .withColumn("n_tokens", (F.col("all_tokens") - F.col("n_tokens_over")).cast("long"))
        .select(
            "length",
            "n_docs",
            "n_docs_over",
            "n_tokens",
            "n_tokens_over",
            (F.col("n_tokens") + F.col("length") * F.col("n_docs_over")).alias("n_tokens_truncated"),
            (1 - F.col("n_docs_over") / F.col("all_docs")).alias("quantile"),
        )
    )


def token_counts(docs: DataFrame, path: str | None = None, extra: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``context_limits`` of the documents' encoded lengths.

    The histogram is written once, since its blocks and its cells both need it
    and texts should be encoded once.
    """
    return context_limits(saved(length_histogram(docs, path, extra, id_col, text_col)))


def quantile_length(limits: DataFrame, q: float) -> DataFrame:
    """The least length within which a share ``q`` of the documents lies; one row, null if there are none."""
    return limits.where(F.col("quantile") >= q).agg(F.min("length").alias("length"))


def truncated_total(histogram: DataFrame, limit: int) -> DataFrame:
    """Tokens of all documents, each cut at ``limit`` (any limit, also one that is no document's length)."""
    return histogram.agg(F.coalesce(F.sum(F.least("length", F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias("n_tokens_truncated"))
