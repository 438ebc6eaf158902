"""Languages of texts and spans: held-out accuracy, plain versions, odd rows."""

import itertools
import random
import zlib

import numpy as np

from plumbline.llm import language, queries

ENGLISH = "the weather in this town is often better than the people who live here say it is when they talk about the harbour and its boats".split()
GERMAN = "das wetter ist in dieser stadt oft besser als die leute sagen die hier wohnen wenn sie über den hafen und seine schiffe sprechen".split()
RUSSIAN = "погода в этом городе часто лучше чем говорят люди которые здесь живут когда они говорят о гавани и кораблях".split()


def prose(words, n, seed):
    return " ".join(random.Random(seed).choices(words, k=n)) + "."


def training(spark):
    rows = [(i, prose(words, 40, i), lang) for k, (words, lang) in enumerate(((ENGLISH, "en"), (GERMAN, "de"), (RUSSIAN, "ru"))) for i in range(k * 100, k * 100 + 60)]
    rows += [(None, prose(ENGLISH, 40, 1), "xx"), (900, None, "yy"), (901, prose(GERMAN, 20, 2), None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = queries.op11_language_spans(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(found) == docs.count() and found.score.between(0, 1).all()
    assert (found.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in found.doc_id]).all()
    held = found[found.held_out]
    assert len(held) > 250 and (held.lang == held.lang_pred).mean() > 0.98


def test_nothing_is_learnt_from_held_out_rows(spark):
    docs = training(spark)
    held = docs.where(language.is_held_out("doc_id")).withColumnRenamed("lang", "was").selectExpr("doc_id", "text", "'zz' as lang")
    rest = docs.where(~language.is_held_out("doc_id"))
    model = language.learn(rest.unionByName(held))
    assert model.names == ["de", "en", "ru"] and np.array_equal(model.grams, language.learn(rest).grams)
    sample = language.labelled_sample(docs, per_language=5, most=12)
    assert sample.count() == 12 and {r["count"] for r in sample.groupBy("lang").count().collect()} == {4}


def test_spans_of_mixed_texts(spark):
    parts = [prose(ENGLISH, 30, 7), prose(GERMAN, 25, 8), prose(RUSSIAN, 20, 9), prose(ENGLISH, 30, 10)]
    text = "\n".join(parts)
    mixed = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = language.identified(mixed, training(spark)).first()
    assert [s.lang for s in row.spans] == ["en", "de", "ru", "en"] and row.lang_pred == "en" and 0.3 < row.score < 0.9
    at = 0
    for span, part in zip(row.spans, parts):
        assert abs(span.start - at) <= 12 and abs(span.end - (at + len(part) - 1)) <= 12
        at += len(part) + 1


def test_labels_equal_the_best_of_all_sequences():
    draw = np.random.default_rng(5)
    model = language.Model(["a", "b", "c"], np.zeros((1, 3)), np.ones((1, 3), bool))
    for n in range(1, 7):
        scores = draw.normal(size=(n + 3, 3)).astype(np.float32) * 4
        of = np.array([0] * n + [1] * 3)
        found = model.labels(scores, of, switch=3.0)
        for doc in (0, 1):
            own = scores[of == doc].astype(float)
            price = lambda way: sum(own[i, s] for i, s in enumerate(way)) - 3.0 * sum(x != y for x, y in zip(way, way[1:]))  # noqa: E731, B023
            assert price(found[of == doc]) == max(map(price, itertools.product(range(3), repeat=len(own))))


def test_words_and_grams_equal_plain_ones():
    text = "Ab c1é́x. ΑβγDe  中文 x"
    words = language.words_of([text, "", "?!", text])
    found = [text[a:b] for a, b in zip(words.starts, words.ends) if b <= len(text)]
    assert found == ["Ab", "c", "é́x", "Αβγ", "De", "中文", "x"]
    assert set(words.of.tolist()) == {0, 3} and words.letters.tolist()[:3] == [2, 1, 2]
    # A word's trigrams are the same wherever it stands.
    alone = language.words_of(["De"])
    at = found.index("c")
    assert np.array_equal(words.grams(at, at + 1), language.words_of(["c"]).grams(0, 1)) and len(alone.grams(0, 1)) == 2
    whole = words.grams(0, len(words.starts))
    assert len(whole) == (words.ends - words.starts).sum()


def test_scripts_narrow_candidates(spark):
    model = language.learn(training(spark))
    scores = model.scores(language.words_of(["слово word 字"]))
    assert (scores[0] == language.RULED_OUT).tolist() == [True, True, False] and (scores[1] == language.RULED_OUT).tolist() == [False, False, True]
    assert (scores[2] == 0).all()


def test_odd_rows(spark, odd_docs):
    found = language.identified(odd_docs, training(spark))
    rows = found.collect()
    assert len(rows) == odd_docs.count() and {r.lang_pred for r in rows} <= {"en", "de", "ru", "und"}
    texts = spark.createDataFrame([(1, None), (1, None), (2, ""), (3, " \n\t"), (4, "123 !?"), (5, "字"), (6, "Да"), (7, "a" * 2_000_000), (8, "das ist " * 100_000), (None, "the"), (9, "x\u0000ỳ")], "doc_id long, text string")
    got = {(r.doc_id, r.lang_pred): r for r in language.identified(texts, training(spark)).collect()}
    assert {(i, "und") for i in (1, 2, 3, 4)} <= set(got) and (6, "ru") in got and (8, "de") in got and (None, "en") in got
    assert all((r.lang_pred == "und") == (not r.spans and r.score == 0) for r in got.values()) and len(got) == 10
    nothing = language.identified(texts, training(spark).where("lang is null"))
    assert {(r.lang_pred, r.score) for r in nothing.collect()} == {("und", 0.0)}
    assert language.identified(texts.limit(0), training(spark)).count() == 0
