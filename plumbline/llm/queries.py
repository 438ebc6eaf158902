"""The registered queries of the text operators, over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, classifier, jaccard, language, neighbours, packing, pii, quality_rules, repair, substrings, suffixes, token_counts, trie
from plumbline.llm.rows import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = classifier.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", classifier.is_held_out("doc_id").alias("held_out"), "score", (F.col("score") >= classifier.CUTOFF).cast("int").alias("predicted"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digest(pii.find_personal_data(table(spark, sf_dir, "documents")))


def op4_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op5_super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.kept_digest(substrings.kept_words(table(spark, sf_dir, "documents")))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), n=3, numerator=90, denominator=100)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = quality_rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return verdicts.select("doc_id", *counts, "base_failed", "kept")


def op9_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.kept_digest(suffixes.kept_bytes(table(spark, sf_dir, "documents")))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op11_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(table(spark, sf_dir, "documents")).select("doc_id", language.is_held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.shared_prefixes(table(spark, sf_dir, "conversations"))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repair.damaged(table(spark, sf_dir, "conversations"))
    return repair.repair_digests(rows, repair.audited(rows))


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_quality_classifier,
        op3_pii,
        op4_collision_counting,
        op5_super_kmers,
        op6_bpe,
        op7_ngram_jaccard,
        op8_quality_rules,
        op9_suffix_arrays,
        op10_token_counts,
        op11_language_spans,
        op12_prefix_trie,
        op13_structure_repair,
    )
}
ORACLE_SQL: dict[str, str] = {}
