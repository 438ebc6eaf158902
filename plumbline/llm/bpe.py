"""BPE encoding and decoding by batched numpy merge rounds.

The words of a batch that were not met before lie behind each other in one
flat symbol array. A round looks up every neighbouring pair by binary search
in the sorted pair keys, takes each word's lowest rank, and merges that pair
wherever it stands in the word; words without a pair left drop out.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.rows import map_batches, texts

NO_RANK = np.int64(1) << 40
WORD_END = "</w>"
#: Words of more bytes are merged one by one, with a heap.
LONG_WORD = 256
#: Above these code points letter classes depend on the Unicode version.
UNUSUAL = regex.compile("[^\x00-ɏ̀-ͅ]")
#: A splitter that ``split_pattern`` knows.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def share_tokenizer(spark: SparkSession, path: str | None = None) -> Broadcast:
    """The vocabulary file's bytes, read by the driver. Its size is the file's: a few MB."""
    with open(path or default_tokenizer(), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


def split_pattern(pattern: str, most: int) -> regex.Pattern | re.Pattern:
    """``pattern`` for texts without code points above ``most`` (at most U+FFFF).

    ``SPLIT`` becomes a pattern of ``re``, which is several times as fast: its
    classes are listed as ``regex`` has them, and branches that start with
    different characters change places.
    """
    if pattern != SPLIT:
        return regex.compile(pattern)
    every = "".join(map(chr, range(most + 1)))
    letters, numbers, spaces = ("".join(f"\\U{ord(r[0]):08x}-\\U{ord(r[-1]):08x}" for r in regex.findall(f"{c}+", every)) for c in (r"\p{L}", r"\p{N}", r"\s"))
    return re.compile(f"[{letters}]+|[{numbers}]|'(?:s|t|re|ve|m|ll|d)|[^{spaces}{letters}{numbers}]+")


class WordBpe:
    """Encoder and decoder of one vocabulary file with word ends."""

    def __init__(self, spec: bytes, most_words: int = 250_000):
        self.spec, self.most_words = spec, most_words
        parsed = json.loads(spec)
        vocab: dict[str, int] = parsed["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in parsed["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pattern = parsed["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        #: For ASCII texts, and for others; what UNUSUAL leaves is composed and lower-cased within U+FFFF.
        self.ascii_words_of, self.words_of = split_pattern(pattern, 0x7F), split_pattern(pattern, 0xFFFF)
        self.library = None
        self.token = dict(zip(vocab.values(), vocab)) | {i: s for s, i in self.special.items()}
        chars = byte_characters()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.final = np.array([vocab[c + WORD_END] for c in chars], np.int64)
        left, right = (np.array([vocab[m[i]] for m in merges], np.int64) for i in (0, 1))
        product = np.array([vocab[a + b] for a, b in merges], np.int64)
        key = left << 32 | right
        order = np.argsort(key)
        self.keys, self.ranks, self.products = key[order], order.astype(np.int64), product[order]
        made = np.full(max(vocab.values()) + 1, -1, np.int64)
        np.maximum.at(made, product, np.arange(len(product)))
        #: A merge that only joins older symbols never undercuts the round's rank.
        self.all_at_once = bool(np.all(np.maximum(made[left], made[right]) < np.arange(len(product)))) and len(set(product.tolist())) == len(product)
        #: Rank and product of each pair, for long words; made when one comes.
        self.merged: dict[int, tuple[int, int]] | None = None
        #: Ids of the words met, and of those met before ``known`` was last full: what is met again moves over, the rest goes.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        #: Of a word's ids: their decimal form and their decoded form.
        self.shown: dict[bytes, tuple[str, str]] = {}

    # -- text to words ------------------------------------------------------

    def words(self, text: str) -> list[str]:
        """The pre-tokenised words of a text; special strings are words of their own."""
        if self.split_special is None or not any(s in text for s in self.special):
            return self._plain_words(text)
        out: list[str] = []
        for part in self.split_special.split(text):
            if part in self.special:
                out.append(part)
            elif part:
                out += self._plain_words(part)
        return out

    def _plain_words(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii_words_of.findall(text.lower())
        if UNUSUAL.search(text):
            return self._library_words(text)
        text = unicodedata.normalize("NFC", text)
        return self.words_of.findall(text.lower())

    def _library_words(self, text: str) -> list[str]:
        """The library's own normaliser and splitter, for scripts whose classes differ by Unicode version."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_buffer(self.spec)
            self.back = {c: b for b, c in enumerate(byte_characters())}
        clean = self.library.normalizer.normalize_str(text)
        return [bytes(self.back[c] for c in w).decode("utf-8", "surrogateescape") for w, _ in self.library.pre_tokenizer.pre_tokenize_str(clean)]

    # -- words to ids -------------------------------------------------------

    def learn(self, words: Iterable[str]) -> None:
        """Encodes the words that are not known yet; afterwards ``known`` has them all."""
        if len(self.known) > self.most_words:
            self.known, self.older = {}, self.known
        known, older, new = self.known, self.older, []
        for w in (words if isinstance(words, set) else set(words)).difference(known):
            if (ids := older.get(w)) is None:
                new.append(w)
            else:
                known[w] = ids
        plain = [w for w in new if w not in self.special]
        for w in new:
            if w in self.special:
                self.known[w] = self.special[w].to_bytes(4, "little")
        raws = [w.encode("utf-8", "surrogateescape") for w in plain]
        short = [(w, raw) for w, raw in zip(plain, raws) if len(raw) <= LONG_WORD]
        for w, raw in zip(plain, raws):
            if len(raw) > LONG_WORD:
                self.known[w] = self.merge_long(raw).astype("<u4").tobytes()
        if short:
            ids, ends = self.merge([raw for _, raw in short])
            whole, at = ids.astype("<u4").tobytes(), 0
            for (w, _), end in zip(short, (4 * ends).tolist()):
                self.known[w] = whole[at:end]
                at = end

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and where each word ends in it."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[flat]
        ends = np.cumsum(lengths)
        filled = lengths > 0
        symbols[ends[filled] - 1] = self.final[flat[ends[filled] - 1]]
        word = np.repeat(np.arange(len(words)), lengths)
        done_symbols, done_words = [], []
        # Of the pair that a symbol begins: its rank, and its place in ``keys``. After a round only pairs with a new symbol are looked up.
        rank, at = np.full(len(symbols), NO_RANK), np.zeros(len(symbols), np.int64)
        look = np.arange(len(symbols) - 1)
        while len(symbols):
            pair = symbols[look] << 32 | symbols[look + 1]
            found = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            rank[look] = np.where((self.keys[found] == pair) & (word[look + 1] == word[look]), self.ranks[found], NO_RANK)
            at[look] = found
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            sizes = np.diff(np.append(starts, len(word)))
            best = np.minimum.reduceat(rank, starts)
            over = np.repeat(best == NO_RANK, sizes)
            if over.any():
                done_symbols.append(symbols[over])
                done_words.append(word[over])
                if over.all():
                    break
            take = np.flatnonzero((rank == np.repeat(best, sizes)) & ~over)
            take = self._apart(take, word)
            symbols[take] = self.products[at[take]]
            keep = ~over
            keep[take + 1] = False
            new = np.zeros(len(symbols), bool)
            new[take] = True
            new[np.maximum(take - 1, 0)] = True
            symbols, word, rank, at = symbols[keep], word[keep], rank[keep], at[keep]
            look = np.flatnonzero(new[keep])
            if len(look) and look[-1] == len(symbols) - 1:
                rank[-1], look = NO_RANK, look[:-1]
        if not done_symbols:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        return symbols[order], np.cumsum(np.bincount(word, minlength=len(words)))

    def merge_long(self, word: bytes) -> np.ndarray:
        """Ids of one long word: the same merges, but after each one only the pairs beside it are looked up anew, and a heap has the lowest rank."""
        flat = np.frombuffer(word, np.uint8)
        symbols = self.inner[flat].tolist()
        symbols[-1] = int(self.final[flat[-1]])
        n = len(symbols)
        if self.merged is None:
            self.merged = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.products.tolist())))
        merged = self.merged
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(found[0], i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (found := merged.get(a << 32 | b))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j] = merged[a << 32 | b][1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for left, right in ((before[i], i), (i, k)):
                if left >= 0 and right < n and (found := merged.get(symbols[left] << 32 | symbols[right])):
                    heapq.heappush(heap, (found[0], left, symbols[left], symbols[right]))
        return np.array([s for s in symbols if s >= 0], np.int64)

    def _apart(self, take: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Of overlapping pairs in a row every other one, from the left; or each word's first pair."""
        if not self.all_at_once:
            return take[np.append(True, word[take[1:]] != word[take[:-1]])]
        fresh = np.append(True, (take[1:] != take[:-1] + 1) | (word[take[1:]] != word[take[:-1]]))
        run_start = np.maximum.accumulate(np.where(fresh, np.arange(len(take)), 0))
        return take[(np.arange(len(take)) - run_start) % 2 == 0]

    # -- whole texts --------------------------------------------------------

    def encode(self, batch: list[str]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit numbers."""
        words = list(map(self.words, batch))
        self.learn(set().union(*words))
        ids_of = self.known.__getitem__
        return [b"".join(map(ids_of, ws)) for ws in words]

    def decode(self, ids: Iterable[int]) -> str:
        """As the library without a decoder: the tokens, special ones too, joined by spaces."""
        return " ".join([self.token[i] for i in ids])


@lru_cache(maxsize=2)
def encoder(spec: bytes) -> WordBpe:
    """One encoder for all tasks of a worker, so that later tasks know the words of earlier ones."""
    return WordBpe(spec)


def batches_of_text(batch: pa.RecordBatch, most_chars: int = 1_000_000, most_rows: int = 256) -> Iterator[tuple[list, list[str]]]:
    """doc_id and text of an Arrow batch in parts of bounded size."""
    for at in range(0, batch.num_rows, most_rows):
        some = batch.slice(at, most_rows)
        ids, values = some.column("doc_id").to_pylist(), some.column("text").to_pylist()
        start = size = 0
        for i, value in enumerate(values):
            size += len(value)
            if size > most_chars:
                yield ids[start : i + 1], values[start : i + 1]
                start, size = i + 1, 0
        if start < len(ids):
            yield ids[start:], values[start:]


def encode_texts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of every text.

    Null and empty texts give no ids and an empty string; rows that repeat are
    encoded each; other columns are left out.
    """
    spec = share_tokenizer(docs.sparkSession, path)

    def make():
        bpe = encoder(spec.value)

        def step(batch):
            for ids, values in batches_of_text(batch):
                tokens = [np.frombuffer(raw, "<u4").astype(np.int32) for raw in bpe.encode(values)]
                yield {
                    "doc_id": pa.array(ids, pa.int64()),
                    "ids": pa.array(tokens, pa.list_(pa.int32())),
                    "decoded": pa.array([bpe.decode(t.tolist()) for t in tokens], pa.string()),
                }

        return step

    return map_batches(texts(docs, id_col, text_col), make, "doc_id long, ids array<int>, decoded string")


def token_lengths(docs: DataFrame, path: str | None = None, extra: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, length) with each text's number of ids plus ``extra``."""
    spec = share_tokenizer(docs.sparkSession, path)

    def make():
        bpe = encoder(spec.value)

        def step(batch):
            for ids, values in batches_of_text(batch):
                yield {
                    "doc_id": pa.array(ids, pa.int64()),
                    "length": pa.array([len(raw) // 4 + extra for raw in bpe.encode(values)], pa.int64()),
                }

        return step

    return map_batches(texts(docs, id_col, text_col), make, "doc_id long, length long")


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoding and decoding, as digests only.

    The ids of a text stay in the task; a text is encoded once and decoded from
    its ids word by word, so that a repeated word costs two lookups.
    """
    spec = share_tokenizer(docs.sparkSession, path)

    def make():
        from hashlib import sha256

        bpe = encoder(spec.value)
        shown = bpe.shown

        def show(raw: bytes) -> tuple[str, str]:
            ids = np.frombuffer(raw, "<u4").tolist()
            return " ".join(map(str, ids)), bpe.decode(ids)

        def step(batch):
            for doc_ids, values in batches_of_text(batch):
                words = list(map(bpe.words, values))
                bpe.learn(set().union(*words))
                known = bpe.known
                if len(shown) > 250_000:
                    shown.clear()
                counts, ids_digest, text_digest = [], [], []
                for ws in words:
                    raws = [known[w] for w in ws]
                    for raw in set(raws):
                        if raw not in shown:
                            shown[raw] = show(raw)
                    pairs = [shown[raw] for raw in raws]
                    counts.append(sum(map(len, raws)) // 4)
                    ids_digest.append(sha256(" ".join([p[0] for p in pairs]).encode()).hexdigest())
                    text_digest.append(sha256(" ".join([p[1] for p in pairs]).encode()).hexdigest())
                yield {
                    "doc_id": pa.array(doc_ids, pa.int64()),
                    "n_tokens": pa.array(counts, pa.int64()),
                    "ids_sha256": pa.array(ids_digest, pa.string()),
                    "decoded_sha256": pa.array(text_digest, pa.string()),
                }

        return step

    return map_batches(texts(docs, id_col, text_col), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
