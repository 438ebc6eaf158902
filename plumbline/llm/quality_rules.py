"""Quality rules whose cutoffs come with a bound on false rejection.

Every rule is a share of the text, computed by DataFrame expressions. For each
stratum and rule a fixed list of cutoffs, from lenient to strict, is tested on
labelled holdout documents: a cutoff holds if the exact binomial test says
that it rejects at most ``most_rejected`` of the good documents. Lists are
tested in order and end at the first failure, which needs no correction
within a list; across strata and rules the level is divided (Bonferroni). Of
the cutoffs that hold, the one that rejects most bad documents net of good
ones is used, and none if no cutoff gains. Everything is DataFrame
operations; no Python runs on executors.
"""

from __future__ import annotations

import math
import string
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.rows import saved


#: ASCII white space: what words are split at.
SPACE = " \t\n\x0b\f\r"
SPACES = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50

#: Strata are a fixed list, so that the table of cutoffs has a bounded size; any other language, or none, is "other".
STRATA = ("de", "en", "es", "fr", "other")
#: Rule: cutoffs from lenient to strict, fixed before any label is seen. A document is rejected above the cutoff.
GRID = {
    "symbol_share": (0.5, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03),
    "capital_share": (0.9, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15),
    "bang_share": (0.9, 0.7, 0.5, 0.3, 0.2, 0.1, 0.07, 0.05),
    "repeat_share": (0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15),
    "dup_line_share": (0.9, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2),
}
#: Each rule may reject this share of a stratum's good documents, so all rules together five times as much.
MOST_REJECTED = 0.02
#: Probability that any cutoff in use breaks its bound.
LEVEL = 0.05

#: Low bits of a packed window that hold its position; the rest are hash bits.
POSITION_BITS = 21
POSITION_MASK = (1 << POSITION_BITS) - 1


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Counts of every text, by expressions: doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, n_lines, n_capitals, n_bangs, and the columns ``keep``.

    Null texts count as empty. Repeated 3-word windows are found by sorting
    (hash, position) numbers; where two different windows of a text share their
    hash bits, or the text has over 2^21 words, the windows themselves are sorted.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    start = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), *(F.col(c).alias(f"_keep_{c}") for c in keep))
    trimmed, source = F.btrim("_text", F.lit(SPACE)), F.col("_text")
    words = F.when(F.length(trimmed) > 0, F.split(trimmed, SPACES)).otherwise(F.array().cast("array<string>"))
    lines = F.filter(F.split(source, "\n"), lambda line: F.length(F.btrim(line, F.lit(SPACE))) > 0)
    from_words = let(words, lambda w: F.struct(F.size(w).alias("n_words"), _repeated_words(w).alias("n_repeat_words")))
    from_lines = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    counted = start.select(
        F.col("_id").alias("doc_id"),
        from_words.alias("_w"),
        from_lines.alias("_l"),
        F.length(F.translate(source, SPACE, "")).alias("word_chars"),
        _without(source, SYMBOLS).alias("n_symbols"),
        _without(source, string.ascii_uppercase).alias("n_capitals"),
        _without(source, "!").alias("n_bangs"),
        *(F.col(f"_keep_{c}") for c in keep),
    )
    places = {"n_words": "_w.n_words", "n_repeat_words": "_w.n_repeat_words", "n_lines": "_l.n_lines", "n_dup_lines": "_l.n_dup_lines"}
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_bangs")
    return counted.select("doc_id", *(F.col(places.get(n, n)).cast("long").alias(n) for n in names), *(F.col(f"_keep_{c}") for c in keep))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` names it and wherever the optimizer moves it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def _same_hash(a: Column, b: Column) -> Column:
    return F.shiftright(a, POSITION_BITS) == F.shiftright(b, POSITION_BITS)


def _position(x: Column) -> Column:
    return x.bitwiseAND(F.lit(POSITION_MASK)).cast("int")


def _repeated_words(words: Column) -> Column:
    """How many words lie in 3-word windows that occur twice or more."""

    def pack(word, i):
        hashed = F.xxhash64(word, F.get(words, i + 1), F.get(words, i + 2))
        return F.shiftleft(hashed, POSITION_BITS).bitwiseOR(i.cast("long"))

    packed = F.sort_array(F.slice(F.transform(words, pack), F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))))

    def covered(at):
        """Of sorted window starts: each adds three words, or as many as there are up to the next."""
        return F.aggregate(F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - p, F.lit(3)))), F.lit(0), lambda a, b: a + b)

    def of_again(again):
        def differs(x, k):
            before = F.get(again, k - 1)
            here, there = _position(x), _position(before)
            return _same_hash(x, before) & reduce(lambda p, q: p | q, (F.get(words, here + i) != F.get(words, there + i) for i in range(3)))

        exact = (F.size(words) > POSITION_MASK) | (F.size(F.filter(again, differs)) > 0)
        return let(F.when(exact, _repeated_exactly(words)).otherwise(F.sort_array(F.transform(again, _position))), covered)

    def of_packed(p):
        return let(F.filter(p, lambda x, k: _same_hash(x, F.get(p, k - 1)) | _same_hash(x, F.get(p, k + 1))), of_again)

    return let(packed, of_packed)


def _repeated_exactly(words: Column) -> Column:
    """Sorted starts of 3-word windows that occur again, by sorting the windows themselves."""
    windows = F.sort_array(
        F.slice(
            F.transform(words, lambda w, i: F.struct(F.concat_ws(" ", w, F.get(words, i + 1), F.get(words, i + 2)).alias("t"), i.alias("i"))),
            F.lit(1),
            F.greatest(F.size(words) - 2, F.lit(0)),
        )
    )

    def again(s):
        return F.sort_array(F.transform(F.filter(s, lambda x, k: (x["t"] == F.get(s, k - 1)["t"]) | (x["t"] == F.get(s, k + 1)["t"])), lambda x: x["i"]))

    return let(windows, again)


def rule_values(counts: DataFrame) -> DataFrame:
    """``counts`` with the rules' shares and ``base_failed``."""
    words, chars, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "word_chars", "n_lines"))
    return counts.select(
        "*",
        (F.col("n_symbols") / chars).alias("symbol_share"),
        (F.col("n_capitals") / chars).alias("capital_share"),
        (F.col("n_bangs") / words).alias("bang_share"),
        (F.col("n_repeat_words") / words).alias("repeat_share"),
        (F.col("n_dup_lines") / lines).alias("dup_line_share"),
        ((F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
    )


def stratum(column: str) -> Column:
    return F.when(F.col(column).isin(*STRATA[:-1]), F.col(column)).otherwise(F.lit(STRATA[-1]))


def log_factorial(n: Column) -> Column:
    """ln n!, by Stirling's series from 20 on."""
    x = F.greatest(n.cast("double"), F.lit(1.0))
    series = x * F.log(x) - x + F.log(2 * math.pi * x) / 2 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    small = F.array(*(F.lit(math.lgamma(i + 1)) for i in range(20)))
    return F.when(n < 20, F.element_at(small, F.least(n, F.lit(19)).cast("int") + 1)).otherwise(series)


def binomial_log_cdf(n: Column, k: Column, p: float) -> Column:
    """ln P(Bin(n, p) <= k) for k < n p, summed downwards from the largest term so that nothing underflows.

    Terms fall as a normal density's do; those beyond ten deviations change no digit and are left out.
    """
    deviations = F.ceil(10 * F.sqrt(n * F.lit(p * (1 - p)))).cast("long") + 50
    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), F.greatest(F.least(k, deviations), F.lit(1)))).otherwise(F.array().cast("array<bigint>"))
    choose = log_factorial(n) - log_factorial(k) - log_factorial(n - k)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(a, i):
        term = a["term"] * (k - i + 1) / (n - k + i) * F.lit((1 - p) / p)
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    tail = F.aggregate(steps, start, add, lambda a: a["sum"])
    return n * F.log(F.lit(1 - p)) + k * F.log(F.lit(p / (1 - p))) + choose + F.log(tail)


def certified_cutoffs(values: DataFrame, labels: DataFrame, most_rejected: float = MOST_REJECTED, level: float = LEVEL) -> DataFrame:
    """One row a stratum with a cutoff for each rule, null where none is certified or gains.

    ``values``: doc_id, stratum, base_failed and the rules' shares. ``labels``:
    doc_id and quality; null labels are left out, of several labels of a document
    the lowest counts. A document is drawn once: of rows that repeat its id the one
    of the least values counts. Documents that fail the base rules are left out, since
    no cutoff decides on them.
    """
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    drawn = values.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.struct("stratum", "base_failed", *GRID)).alias("row")).select("doc_id", "row.*")
    holdout = drawn.join(marks, "doc_id")
    good, bad = ~F.col("base_failed") & (F.col("quality") == 1), ~F.col("base_failed") & (F.col("quality") == 0)
    cells = [(rule, i, cut) for rule, cuts in GRID.items() for i, cut in enumerate(cuts)]
    wide = holdout.groupBy("stratum").agg(
        F.count_if(good).alias("n"),
        *(F.count_if(cond & (F.col(rule) > cut)).alias(f"{kind}_{rule}_{i}") for rule, i, cut in cells for kind, cond in (("k", good), ("b", bad))),
    )
    entries = F.array(*(F.struct(F.lit(rule).alias("rule"), F.lit(i).alias("step"), F.lit(cut).alias("cut"), F.col(f"k_{rule}_{i}").alias("k"), F.col(f"b_{rule}_{i}").alias("b")) for rule, i, cut in cells))
    tests = wide.select("stratum", "n", F.explode(entries).alias("e")).select("stratum", "n", "e.*")
    share = level / (len(STRATA) * len(GRID))
    holds = F.when(F.col("k") < F.col("n") * most_rejected, binomial_log_cdf(F.col("n"), F.col("k"), most_rejected) <= F.log(F.lit(share))).otherwise(F.lit(False))
    in_turn = Window.partitionBy("stratum", "rule").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    gain = F.col("b") - F.col("k")
    chosen = (
        tests.withColumn("holds", F.min(holds).over(in_turn))
        .where(F.col("holds") & (gain > 0))
        .groupBy("stratum", "rule")
        .agg(F.max_by("cut", F.struct(gain, -F.col("step"))).alias("cut"))
    )
    return chosen.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == rule, F.col("cut"))).alias(f"cut_{rule}") for rule in GRID))


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: tuple[str, ...] = (), most_rejected: float = MOST_REJECTED, level: float = LEVEL) -> DataFrame:
    """Counts, rule shares, ``base_failed`` and ``kept`` of every row of ``docs``.

    Cutoffs and verdicts both need the counts, so these are written once, with
    the columns to ``keep`` beside them. Rows that repeat are judged each; without labels
    no rule but the base ones rejects. Null and empty texts have no words and fail; other
    columns are not read, whatever their names; an empty table gives no rows.
    """
    held = tuple(dict.fromkeys((lang_col, *keep)))
    values = rule_values(text_counts(docs, id_col, text_col, held)).withColumn("stratum", stratum(f"_keep_{lang_col}"))
    values = saved(values)
    # One row a stratum of STRATA at most.
    cutoffs = F.broadcast(certified_cutoffs(values, labels, most_rejected, level))
    over = reduce(lambda a, b: a | b, (F.coalesce(F.col(rule) > F.col(f"cut_{rule}"), F.lit(False)) for rule in GRID))
    return values.join(cutoffs, "stratum", "left").withColumn("kept", ~F.col("base_failed") & ~over)


def filtered(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns."""
    out = judged(docs, labels, keep=tuple(docs.columns), **options)
    return out.where("kept").select(*(F.col(f"_keep_{c}").alias(c) for c in docs.columns))
