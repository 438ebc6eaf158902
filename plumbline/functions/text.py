"""Text expressions: hashed word ids, class names from file names, renames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.dims import RENAMES

MAX_WORDS, VOCABULARY = 32, 32_000


def word_ids(text: Column, max_words: int = MAX_WORDS, vocabulary: int = VOCABULARY) -> Column:
    """Ids of the first words, zero-padded: the md5 digest modulo ``vocabulary - 1``, plus 1.

    The 128-bit remainder is taken 16 bits at a time, so that no step overflows.
    """
    words = F.slice(F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != ""), 1, max_words)

    def number(word):
        digest = F.md5(word)
        chunks = F.transform(F.sequence(F.lit(1), F.lit(29), F.lit(4)), lambda i: F.conv(F.substring(digest, i, F.lit(4)), 16, 10).cast("long"))
        return F.aggregate(chunks, F.lit(0).cast("long"), lambda a, x: (a * 65536 + x) % (vocabulary - 1)) + 1

    ids = F.transform(words, number)
    return F.concat(ids, F.array_repeat(F.lit(0).cast("long"), F.lit(max_words) - F.size(ids)))


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1)


def class_of_file(path: Column) -> Column:
    """The file's stem without one trailing ``_digits``; null for originals."""
    name = stem(path)
    return F.when(name != "original", F.regexp_replace(name, "_[0-9]+$", ""))


def renamed(name: Column, rules: dict[str, str] = RENAMES) -> Column:
    """The first occurrence of a rule's prefix replaced, for names that start with it and an underscore."""
    return reduce(
        lambda out, rule: F.when(name.startswith(rule[0] + "_"), F.concat(F.lit(rule[1]), F.substring(name, len(rule[0]) + 1, 1 << 20))).otherwise(out),
        rules.items(),
        name,
    )


def rename_rule(name: Column, rules: dict[str, str] = RENAMES) -> Column:
    return reduce(lambda out, old: F.when(name.startswith(old + "_"), F.lit(old)).otherwise(out), rules, F.lit(None).cast("string"))
