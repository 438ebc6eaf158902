"""Removal of word windows that occur earlier, by super-k-mer partitioning.

Consecutive windows with the same minimiser travel as one packed string to the
bucket of that minimiser, where sorting counts windows exactly (``superkmers``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import superkmers as sk
from plumbline.llm.rows import keyed_texts, saved

#: Words of a window, and of the gram whose least hash is its minimiser.
WINDOW, GRAM = 20, 8
MOST_WORDS = 200_000


class WordHashes(dict):
    """64-bit hash of each word met."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class WordStrings(sk.Strings):
    """Words as tokens; a window also counts if it starts earlier in its document."""

    within, spacing = True, 42

    def __init__(self, length: int, gram: int, frequent: int = sk.FREQUENT):
        super().__init__(length, gram, frequent)
        self.hashes = WordHashes()

    def tokens(self, text: bytes) -> list[bytes]:
        return text.split()

    def flat(self, pieces: list[list[bytes]]) -> list[bytes]:
        return [w for piece in pieces for w in piece]

    def grams(self, flat: list[bytes]) -> np.ndarray:
        return sk.gram_hashes(self.hashes.of(flat), self.gram)

    def packed(self, flat: list[bytes], begin: int, end: int) -> bytes:
        return b" ".join(flat[begin:end])

    def windows(self, packed: bytes) -> list[bytes]:
        words = packed.split(b" ")
        return [b" ".join(words[i : i + self.length]) for i in range(len(words) - self.length + 1)]

    def numbers(self, strings: list[bytes]) -> np.ndarray:
        number: dict[bytes, int] = {}
        return np.array([number.setdefault(w, len(number)) for s in strings for w in s.split(b" ")], np.int64)

    def window_hashes(self, numbers: np.ndarray) -> np.ndarray:
        ids = numbers.astype(np.uint64)
        return sk.gram_hashes(sk.mix(ids, ids + np.uint64(1)), self.length)


def kept_words(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", strings: sk.Strings | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, text): each row's words that stay, joined by one space.

    A word goes if a window of ``window`` words covers it which starts earlier
    too: at a smaller id, or in the same document at an earlier word. Rows that repeat an
    id with another text are ordered by their texts; rows that repeat an id and its text are
    one document and get the same result each. A null id is later than every
    other. Null and empty texts have no words, texts under ``window`` words stay
    whole, and a text of any length is taken whole. Other columns of ``docs``
    are not read, whatever their names; an empty table gives no rows.
    """
    kind = strings or WordStrings(window, gram)
    plain = keyed_texts(docs, id_col, text_col)
    layout = sk.Layout.of(plain, kind, sk.text_bytes(plain))
    asked = saved(sk.shared_places(sk.sampled(plain, kind, layout), kind, layout)).union(sk.whole_copies(plain, layout))
    texts = sk.pressed(plain, layout, [])

    def apply(table: pa.Table, raws: list[bytes], ranges: list[np.ndarray]) -> dict:
        kept, n_words, n_removed = [], [], []
        for raw, pairs in zip(raws, ranges):
            words = raw.split()
            gone = sk.covered(len(words), pairs)
            n_words.append(len(words))
            n_removed.append(int(gone.sum()))
            kept.append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g] if n_removed[-1] else words))
        return {
            "doc_id": sk.doc_ids(table),
            "n_words": pa.array(n_words, pa.int64()),
            "n_removed": pa.array(n_removed, pa.int64()),
            "text": pa.array(kept, pa.binary()).cast(pa.string()),
        }

    return sk.with_ranges(texts, sk.covered_ranges(texts, asked, kind, layout), apply, "doc_id long, n_words long, n_removed long, text string")


def kept_digest(kept: DataFrame) -> DataFrame:
    """``kept_words`` with the text as a digest."""
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
