"""The pipeline's stages by brute force, each on its own input."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import pii, quality_rules, rows, suffixes
from plumbline.llm import superkmers as sk
from tests.conftest import SF
from tests.llm.test_operators import NULL, WORDS, key, plain_components


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, after = docs.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        after[name] = (before, docs)
        if name != "best-fit packing":
            assert docs.columns == columns

    before, kept = after["quality rules"]
    verdicts = quality_rules.judged(before, spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in verdicts.where("kept").collect()}
    assert kept.count() > 0.5 * before.count()

    before, kept = after["n-gram Jaccard join"]
    groups = plain_components([(r.doc_id, r.text) for r in before.collect()], 5, 4, 5)
    assert {r.doc_id for r in kept.collect()} == {i for i, n, c in groups if i == c}

    before, kept = after["suffix-array dedup"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    first = {}
    for doc_id, text in rows:
        raw = text.encode()
        for i in range(len(raw) - 49):
            first[raw[i : i + 50]] = min(first.get(raw[i : i + 50], NULL), key(doc_id))
    out = {r.doc_id: r.text for r in kept.collect()}
    for doc_id, text in rows:
        raw = text.encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - 49):
            if first[raw[i : i + 50]] < doc_id:
                gone[i : i + 50] = True
        left = np.frombuffer(raw, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
        assert out.get(doc_id, "") == left or not WORDS.search(left)

    before, masked = after["PII"]
    assert {r.doc_id: r.text for r in masked.collect()} == {r.doc_id: pii.mask(r.text) for r in before.collect()}

    before, packed = after["best-fit packing"]
    sizes = packed.groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in sizes) <= 4096
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in before.collect()}
    assert corpus_pipeline.run(spark, SF).count() == packed.count()


def test_run_on_odd_and_on_empty_tables(spark, odd_docs, tmp_path):
    """Nulls, repeated rows, ties, long texts and clashing columns pass through; an empty table gives an empty result."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for name, docs in (("odd", odd_docs), ("empty", odd_docs.limit(0))):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
        packed = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        kept = {r.doc_id for r in quality_rules.filtered(docs, labels).collect()}
        assert {r.doc_id for r in packed} <= kept
        assert bool(packed) == bool(kept)


@pytest.mark.parametrize("stage", [f for name, f in corpus_pipeline.STAGES if name != "quality rules"])
def test_texts_go_to_python_in_small_batches(spark, stage):
    """Many long texts are no large batch, neither in what a stage runs itself nor in what it returns; a session's own limit stays."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(0, 12, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 100_000).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

    try:
        spark.conf.unset(setting)
        stage(spark, docs.limit(1).withColumn("text", F.lit("a few words")), SF)
        assert docs.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] < 4 << 20
        spark.conf.set(setting, "3m")
        stage(spark, docs.limit(0), SF)
        assert spark.conf.get(setting) == "3m"
    finally:
        spark.conf.unset(setting)


def test_small_batches_do_not_make_more_places(spark):
    """What a task gathers for a bucket goes on from batch to batch."""
    docs = spark.range(0, 400, 1, 1).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *(F.sha2(F.concat_ws(" ", "id", F.lit(i)), 256) for i in range(4))).alias("text"))
    found = sk.sampled(rows.keyed_texts(docs), suffixes.ByteStrings(), sk.Layout(3, 4))
    records = "spark.sql.execution.arrow.maxRecordsPerBatch"
    whole = found.count()
    try:
        spark.conf.set(records, 50)
        cut = sk.sampled(rows.keyed_texts(docs), suffixes.ByteStrings(), sk.Layout(3, 4))
        assert cut.count() == whole == 8
    finally:
        spark.conf.unset(records)
