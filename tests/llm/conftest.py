import pytest

PROSE = "the quick brown fox jumps over the lazy dog and runs along the river bank while seven old men watch it from their boat "


def passage(seed: int, words: int) -> str:
    """Words that repeat in no other passage."""
    return " ".join(f"w{seed}x{(i * 7919 + seed) % 10007}" for i in range(words))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty, blank and long texts, repeated rows and ids, ties, and columns whose names clash."""
    shared = passage(1, 60)
    rows = [
        (1, passage(2, 30) + " " + shared, "en", "a"),
        (2, shared + " " + passage(3, 20), None, "a"),
        (3, None, "en", None),
        (4, "", "xx", "b"),
        (5, " \t\n\r\x0b\x0c ", "en", "b"),
        (6, passage(4, 80), "de", "b"),
        (7, passage(4, 80), "de", "b"),
        (8, passage(4, 79) + " changed", "de", "b"),
        (8, passage(5, 30), "de", "b"),
        (9, PROSE * 300, "en", "c"),
        (9, PROSE * 300, "en", "c"),
        (None, passage(4, 80), "en", "c"),
        (None, shared, "en", "c"),
        (10, "one", "fr", "c"),
        (11, "ONE", "fr", "c"),
        (12, "one two", "fr", "c"),
        (13, "mail a.b@c.example now +1 (984) 555-5227 4539 1488 0343 6467 10.0.0.1 é🙂 <|endoftext|>", "fr", "c"),
        (14, "x" * 4000, "fr", "c"),
        (15, "Same line\nSame line\n\n\nother " + "a b c " * 30, "fr", "c"),
    ]
    rows = [(*r, len(r[1] or ""), i, "extra", 3.5) for i, r in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, okey long, ranges string, score double"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def plain_rows(odd_docs):
    return [(r.doc_id, r.text) for r in odd_docs.collect()]
