"""Languages of texts, and of the spans of texts that mix them.

Words are runs of letters of one script. A word's script leaves the languages
that use it as candidates; each candidate scores the word by how usual its
letter trigrams are in that language. The best sequence of labels (Viterbi),
where every change of language costs a penalty, gives spans; the language
with the most letters in its spans is the text's.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.rows import map_batches

#: Labelled documents that the model is fitted on: of each language, and in all.
MOST_OF_LANGUAGE, MOST_LABELLED = 1500, 20_000
#: Languages that are learnt at most: those of the most documents.
MOST_LANGUAGES = 400
#: Classes of letter trigrams by hash, and what is added to each one's count.
GRAM_BITS, SMOOTHING = 16, 0.5
#: Price of a change of language, in natural logarithms.
SWITCH = 18.0
#: A language is a candidate for a script that at least this share of its letters has.
SCRIPT_SHARE = 0.01
#: Score of a language that is no candidate, for each word.
RULED_OUT = -1e6
#: Evidence, in natural logarithms, at which a winner is trusted by 73 %.
TEMPERATURE = 3.0
UNKNOWN = "und"

#: Characters of one part of a batch, and of one step over a text, for each language.
PART_CHARS, STEP_CHARS = 4_000_000, 1 << 20

# First and last code points of scripts; those of no range are one script more, 0.
SCRIPTS = (
    ("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF), ("greek", 0x1F00, 0x1FFF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F),
    ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF), ("arabic", 0x750, 0x77F), ("arabic", 0xFB50, 0xFDFF), ("arabic", 0xFE70, 0xFEFF), ("devanagari", 0x900, 0x97F),
    ("bengali", 0x980, 0x9FF), ("gurmukhi", 0xA00, 0xA7F), ("gujarati", 0xA80, 0xAFF), ("oriya", 0xB00, 0xB7F), ("tamil", 0xB80, 0xBFF), ("telugu", 0xC00, 0xC7F),
    ("kannada", 0xC80, 0xCFF), ("malayalam", 0xD00, 0xD7F), ("sinhala", 0xD80, 0xDFF), ("thai", 0xE00, 0xE7F), ("lao", 0xE80, 0xEFF), ("tibetan", 0xF00, 0xFFF),
    ("myanmar", 0x1000, 0x109F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("hangul", 0x3130, 0x318F), ("hangul", 0xAC00, 0xD7AF), ("ethiopic", 0x1200, 0x137F),
    ("khmer", 0x1780, 0x17FF), ("mongolian", 0x1800, 0x18AF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("han", 0xF900, 0xFAFF), ("han", 0x20000, 0x3FFFF),
)
SCRIPT_IDS = {name: i for i, name in enumerate(dict.fromkeys(s[0] for s in SCRIPTS), 1)}
N_SCRIPTS = len(SCRIPT_IDS) + 1
LETTER, MARK = 1, 2


@functools.cache
def characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every code point: letter or mark, script, and the lower-case one where that is one code point."""
    every = [chr(i) for i in range(0x110000)]
    kind = np.fromiter((LETTER if c.isalpha() else MARK if unicodedata.category(c)[0] == "M" else 0 for c in every), np.uint8, len(every))
    lower = np.fromiter((ord(x) if len(x := c.lower()) == 1 else ord(c) for c in every), np.uint32, len(every))
    script = np.zeros(len(every), np.uint8)
    for name, first, last in SCRIPTS:
        script[first : last + 1] = SCRIPT_IDS[name]
    return kind, script, lower


@dataclass
class Words:
    """The words of several texts in one row of code points, and the trigram class at each place that is in a word."""

    points: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    letters: np.ndarray
    script: np.ndarray
    of: np.ndarray

    def grams(self, a: int, b: int) -> np.ndarray:
        """Classes of the trigrams around the places of words ``a`` to ``b``, one after the other; beyond a word's ends is 0."""
        low, high = self.starts[a], self.ends[b - 1]
        inside = np.zeros(high - low + 2, np.int8)
        np.add.at(inside, self.starts[a:b] - low + 1, 1)
        np.add.at(inside, self.ends[a:b] - low + 1, -1)
        inside = np.cumsum(inside[:-1]) > 0
        c = np.where(inside, np.append(0, characters()[2][self.points[low:high]]), 0).astype(np.uint32)
        # Two words that touch (of two scripts) see each other's letter, which scripts tell apart anyway.
        c = np.append(c, np.uint32(0))
        mixed = (c[:-2] * np.uint32(0x9E3779B1)) ^ (c[1:-1] * np.uint32(0x85EBCA77)) ^ (c[2:] * np.uint32(0xC2B2AE3D))
        mixed = (mixed ^ mixed >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
        return (mixed >> np.uint32(32 - GRAM_BITS))[inside[1:]]


def words_of(texts: list[str]) -> Words:
    """Runs of letters and marks of one script, in order; a run of marks alone is no word."""
    kind, script, _ = characters()
    points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    inside = kind[points] > 0
    own = np.where(inside, script[points], 0)
    before = np.append(False, inside[:-1])
    changed = np.append(False, (own[1:] != own[:-1]) & (own[1:] > 0) & (own[:-1] > 0))
    starts = np.flatnonzero(inside & (~before | changed))
    stop = inside & np.append(~inside[1:] | changed[1:], True) if len(inside) else inside
    ends = np.flatnonzero(stop) + 1
    is_letter = kind[points] == LETTER
    sums = np.append(0, np.cumsum(is_letter, dtype=np.int64))
    letters = sums[ends] - sums[starts]
    starts, ends, letters = starts[letters > 0], ends[letters > 0], letters[letters > 0]
    begins = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    of = np.searchsorted(begins, starts, side="right")
    # A word's script is its first known one; words begin with a letter but where a mark comes first.
    return Words(points, starts, ends, letters, own[starts], of)


@dataclass
class Model:
    """Languages in order of name, logarithms of trigrams by class, and which scripts they use. Its size follows the sample's languages."""

    names: list[str]
    grams: np.ndarray
    uses: np.ndarray

    def scores(self, words: Words) -> np.ndarray:
        """Of each word, by language; a language that does not use the word's script is ruled out, unless none does."""
        out = np.zeros((len(words.starts), len(self.names)), np.float32)
        step = max(1, STEP_CHARS // max(1, len(self.names) // 4))
        a = 0
        while a < len(out):
            b = max(a + 1, int(np.searchsorted(words.ends, words.starts[a] + step)))
            lengths = words.ends[a:b] - words.starts[a:b]
            out[a:b] = np.add.reduceat(self.grams[words.grams(a, b)], np.cumsum(lengths) - lengths, axis=0)
            a = b
        uses = self.uses[words.script]
        known = uses.any(1)
        out[~known] = 0
        out[known[:, None] & ~uses] = RULED_OUT
        return out

    def labels(self, scores: np.ndarray, of: np.ndarray, switch: float = SWITCH) -> np.ndarray:
        """The best language of each word: all texts step by step together, the longest ones last."""
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(first, len(of)))
        order = np.argsort(-sizes, kind="stable")
        first, sizes = first[order], sizes[order]
        active = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), side="left")
        back = np.zeros(scores.shape, np.uint16)
        same = np.arange(scores.shape[1], dtype=np.uint16)
        best = scores[first].astype(np.float64)
        for t in range(1, len(active)):
            n = active[t]
            now = best[:n]
            top = now.argmax(1)
            moved = now[np.arange(n), top] - switch
            back[first[:n] + t] = np.where(now >= moved[:, None], same, top[:, None])
            best[:n] = np.maximum(now, moved[:, None]) + scores[first[:n] + t]
        out = np.zeros(len(of), np.int64)
        state = best.argmax(1) if len(best) else np.zeros(0, np.int64)
        for t in range(len(active) - 1, -1, -1):
            n = active[t]
            at = first[:n] + t
            out[at] = state[:n]
            state[:n] = back[at, state[:n]]
        return out


def is_held_out(column: str) -> Column:
    """Rows that nothing is learnt from. A null id is not held out, nor learnt from."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, per_language: int = MOST_OF_LANGUAGE, most: int = MOST_LABELLED) -> DataFrame:
    """(lang, text) of documents that are not held out: at most ``per_language`` of each language and ``most`` in all, by hash of the id; of at most ``MOST_LANGUAGES`` languages."""
    marked = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out("doc_id")).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang")).distinct()
    # At most MOST_LANGUAGES rows are broadcast.
    usual = marked.groupBy("lang").agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "lang").limit(MOST_LANGUAGES)
    # About twice the rows that a language may have are ranked, whatever its size.
    marked = marked.join(F.broadcast(usual), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("_n")) < 2 * per_language).drop("_n")
    order = (F.xxhash64("doc_id"), "doc_id")
    ranked = marked.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= per_language)
    chosen = ranked.orderBy("place", "lang", *order).limit(most).select("doc_id", "lang")
    # At most ``most`` rows are broadcast.
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text").where("text is not null").join(F.broadcast(chosen), ["doc_id", "lang"]).select("lang", "text")


def _parts(batch: pa.RecordBatch, other: str, most_chars: int = PART_CHARS) -> Iterator[tuple[list, list[str]]]:
    """Values of ``other`` and texts of a batch, in parts of bounded size."""
    for at in range(0, batch.num_rows, 2048):
        some = batch.slice(at, 2048)
        marks, values = some.column(other).to_pylist(), some.column("text").to_pylist()
        start = size = 0
        for i, value in enumerate(values):
            size += len(value or "")
            if size > most_chars:
                yield marks[start : i + 1], values[start : i + 1]
                start, size = i + 1, 0
        if start < len(marks):
            yield marks[start:], values[start:]


def learn(docs: DataFrame, per_language: int = MOST_OF_LANGUAGE, most: int = MOST_LABELLED) -> Model:
    """Fits the model; what reaches the driver is sums by language and class, bounded by the sample."""
    n_grams = 1 << GRAM_BITS

    def make():
        def step(batch):
            for langs, values in _parts(batch, "lang"):
                words = words_of(values)
                names, code = np.unique(np.array(langs, object), return_inverse=True)
                lang_of_word, size = code[words.of], n_grams + N_SCRIPTS
                grams = words.grams(0, len(words.starts)) if len(words.starts) else np.zeros(0, np.int64)
                seen, n = np.unique(np.repeat(lang_of_word, words.ends - words.starts) * size + grams, return_counts=True)
                script, which = np.unique(lang_of_word * size + n_grams + words.script, return_inverse=True)
                place, n = np.append(seen, script), np.append(n, np.bincount(which, words.letters, len(script)).astype(np.int64))
                yield {"lang": pa.array(names[place // size], pa.string()), "place": pa.array(place % size, pa.int32()), "n": pa.array(n, pa.int64())}

        return step

    rows = map_batches(labelled_sample(docs, per_language, most), make, "lang string, place int, n long").groupBy("lang", "place").agg(F.sum("n").alias("n")).toArrow()
    names, code = np.unique(np.array(rows.column("lang").to_pylist(), object), return_inverse=True)
    counts = np.zeros((len(names), n_grams + N_SCRIPTS))
    counts[code, rows.column("place").to_numpy()] = rows.column("n").to_numpy()
    grams, scripts = counts[:, :n_grams] + SMOOTHING, counts[:, n_grams:]
    uses = scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(1, keepdims=True))
    return Model(names.tolist(), np.ascontiguousarray(np.log(grams / grams.sum(1, keepdims=True)).T.astype(np.float32)), np.ascontiguousarray((uses & (scripts > 0)).T))


def judged(model: Model, texts: list[str]) -> tuple[list[str], np.ndarray, list[list[tuple[int, int, str]]]]:
    """Language, score and spans (start, end, language; code points) of each text."""
    words = words_of(texts)
    n, k = len(texts), len(model.names)
    if not k or not len(words.starts):
        return [UNKNOWN] * n, np.zeros(n), [[] for _ in texts]
    scores = model.scores(words)
    label = model.labels(scores, words.of)
    letters = np.bincount(words.of * k + label, words.letters, n * k).reshape(n, k)
    winner, total = letters.argmax(1), letters.sum(1)
    mine = label == winner[words.of]
    # How much better the winner explains its words than the next candidate for all of them.
    evidence = np.zeros((n, k))
    np.add.at(evidence, words.of[mine], np.maximum(scores[mine], -1e5).astype(np.float64))
    own = evidence[np.arange(n), winner]
    evidence[np.arange(n), winner] = -np.inf
    margin = own - evidence.max(1) if k > 1 else np.full(n, np.inf)
    sure = 1 / (1 + np.exp(-np.clip(margin / TEMPERATURE, -50, 50)))
    score = np.where(total > 0, letters.max(1) / np.maximum(total, 1) * sure, 0.0)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    lead = np.flatnonzero(np.append(True, (words.of[1:] != words.of[:-1]) | (label[1:] != label[:-1])))
    tail = np.append(lead[1:], len(label)) - 1
    spans: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for doc, start, end, lang in zip(words.of[lead].tolist(), words.starts[lead].tolist(), words.ends[tail].tolist(), label[lead].tolist()):
        spans[doc].append((start - int(begins[doc]), end - int(begins[doc]), model.names[lang]))
    return [model.names[w] if t else UNKNOWN for w, t in zip(winner.tolist(), total.tolist())], score, spans


def identified(docs: DataFrame, learnt_from: DataFrame | None = None, per_language: int = MOST_OF_LANGUAGE, most: int = MOST_LABELLED) -> DataFrame:
    """(doc_id, lang_pred, score, spans array<struct<start, end, lang>>) of every row of ``docs`` (doc_id, text).

    The model is learnt from ``learnt_from`` (doc_id, text, lang; by default
    ``docs``), at most ``per_language`` documents of each language and ``most``
    in all, held-out rows left out. Null texts and those without a letter are
    ``und`` with score 0 and no spans, as all are if nothing is learnt. Rows
    that repeat are judged each, alike; ties go to the first language by name.
    The score is the share of letters in the language's spans, times how sure
    their words are.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(docs if learnt_from is None else learnt_from, per_language, most))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def make():
        most_chars = 4 * PART_CHARS // max(4, len(model.value.names))

        def step(batch):
            for ids, values in _parts(batch, "doc_id", most_chars):
                langs, score, spans = judged(model.value, [v or "" for v in values])
                yield {"doc_id": pa.array(ids, pa.int64()), "lang_pred": pa.array(langs, pa.string()), "score": pa.array(score, pa.float64()), "spans": pa.array([[dict(zip(("start", "end", "lang"), s)) for s in own] for own in spans], span)}

        return step

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(plain, make, "doc_id long, lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>")
