"""Windows of k tokens that occur again, found through super-k-mers.

Tokens are words or bytes. A window's minimiser is its gram of g tokens with
the least hash, the leftmost on ties; consecutive windows with the same
minimiser make a super-k-mer. Equal windows have equal minimisers, so a gram
that is the minimiser of super-k-mers of one document only cannot lead to an
equal window in another. The search has four steps:

1. ``sampled``: of each document the place of every distinct minimiser travels
   to the bucket of the minimiser's hash: some six bytes, no text.
2. ``shared_places``, or an index of such places (``suffixes``): where a
   bucket has a minimiser in several documents, their places go to the part of
   the corpus that holds the documents' texts.
3. ``sent_strings``: the super-k-mers at these places travel as packed strings to the
   bucket of their minimiser; those of minimisers that very many documents
   have travel window by window, led by the window's own hash, so that no
   minimiser gathers a large part of the corpus in one bucket. Of equal strings
   in a part the earliest travels alone.
4. ``covered_ranges``: in a bucket equal windows meet, are compared token by token, and the
   ranges that they cover return to the texts.

Hashes only bring windows together: every range that is returned rests on equal
tokens. Rows that are whole copies of an earlier document's text are settled
before, by the SHA-256 of the text, and send no strings.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.rows import NULL_ID, map_batches, saved, utf8

U = np.uint64
MIX_A, MIX_B = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)
#: Low bits of a gram's sort value that hold its position in a batch.
POSITION_BITS = U(26)
#: Bytes of compressed text that a part of the corpus holds about, and minimisers that a bucket holds.
PART_BYTES, BUCKET_SAMPLES = 4_000_000, 1 << 18
#: Documents that have a minimiser from which on its super-k-mers travel window by window.
FREQUENT = 2000
#: Minimisers, and super-k-mers, that a task gathers before it sends.
SEND_ROWS, SEND_STRINGS = 800_000, 400_000
#: Documents whose tokens are looked at together, where they come from a table.
SLICE_ROWS = 512
#: Bit of a document's flags that says that its id is null; the others tell texts with the same id apart.
NULL_FLAG = 1 << 31


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of pairs; not symmetric."""
    x = a * MIX_A + (b ^ (b >> U(29))) * MIX_B
    x ^= x >> U(32)
    x *= MIX_B
    x ^= x >> U(29)
    return x


def gram_hashes(tokens: np.ndarray, g: int) -> np.ndarray:
    """Hash of every run of g tokens, by doubling: runs of 1, 2, 4, ... and the rest by overlap."""
    size, h = 1, tokens
    while size * 2 <= g:
        h = mix(h[:-size], h[size:])
        size *= 2
    return mix(h[: len(h) - (g - size)], h[g - size :]) if size < g else h


def spread(h: np.ndarray) -> np.ndarray:
    """Minimisers' hashes, which are small ones, spread over all 64 bits, one to one."""
    h = (h ^ (h >> U(32))) * MIX_B
    h = (h ^ (h >> U(29))) * MIX_A
    return h ^ (h >> U(32))


def order_by(keys: np.ndarray) -> np.ndarray:
    """The stable order of whole numbers below 2^32: each sorted together with its place, which is several times as fast as an indirect sort."""
    both = np.sort(keys.astype(U) << U(32) | np.arange(len(keys), dtype=U))
    return (both & U(0xFFFFFFFF)).astype(np.int64)


def order_by_hash(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the high bits of ``hashes``, then place, and marks where these bits change; the low bits, as many as a place has, do not count."""
    low = U((1 << len(hashes).bit_length()) - 1)
    both = np.sort(hashes & ~low | np.arange(len(hashes), dtype=U))
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (both[1:] ^ both[:-1]) > low
    return (both & low).astype(np.int64), fresh


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size, v = 1, values
    while size * 2 <= width:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    return np.minimum(v[: len(v) - (width - size)], v[width - size :]) if size < width else v


@dataclass
class SuperKmers:
    """Of a batch of documents: first token, number of windows, document and minimiser hash of each super-k-mer."""

    first: np.ndarray
    windows: np.ndarray
    doc: np.ndarray
    gram: np.ndarray


def super_kmers(grams: np.ndarray, lengths: np.ndarray, k: int, g: int) -> SuperKmers:
    """``grams``: hashes of all runs of g tokens of the documents behind each other; ``lengths``: tokens of each document."""
    starts = np.cumsum(lengths) - lengths
    n = int(lengths.sum()) - k + 1
    if n <= 0:
        empty = np.zeros(0, np.int64)
        return SuperKmers(empty, empty, empty, np.zeros(0, U))
    low = (U(1) << POSITION_BITS) - U(1)
    least = sliding_min((grams & ~low) | np.arange(len(grams), dtype=U), k - g + 1) & low
    # Of each document the windows that lie in it.
    inside = np.zeros(n + 1, np.int8)
    has = lengths >= k
    np.add.at(inside, starts[has], 1)
    np.add.at(inside, np.minimum(starts[has] + lengths[has] - k + 1, n), -1)
    inside = np.cumsum(inside[:-1]) > 0
    fresh = np.empty(n, bool)
    fresh[0] = True
    fresh[1:] = least[1:] != least[:-1]
    fresh[starts[has]] = True
    first = np.flatnonzero(fresh & inside)
    # A super-k-mer ends where the next starts or its document's windows end.
    doc = np.searchsorted(starts, first, "right") - 1
    until = np.minimum(np.append(first[1:], n), starts[doc] + lengths[doc] - k + 1)
    return SuperKmers(first, until - first, doc, spread(grams[least[first].astype(np.int64)]))


#: Tokens of a part of a batch, and of a part of a long document: so few that its arrays stay near a core.
PART_TOKENS = 1 << 17


@dataclass
class Part:
    """Some documents' tokens, at most about ``PART_TOKENS``; long documents are cut into parts that overlap by k - 1 tokens."""

    doc: list[int]
    offset: list[int]
    tokens: list

    def lengths(self) -> np.ndarray:
        return np.fromiter(map(len, self.tokens), np.int64, len(self.tokens))


def parts_of(documents: Iterable, k: int) -> Iterator[Part]:
    """``documents``: sequences of tokens, taken one by one. Those with no window are left out."""
    part, size = Part([], [], []), 0
    for doc, tokens in enumerate(documents):
        for offset in range(0, len(tokens) - k + 1, PART_TOKENS):
            piece = tokens[offset : offset + PART_TOKENS + k - 1] if len(tokens) > PART_TOKENS else tokens
            part.doc.append(doc)
            part.offset.append(offset)
            part.tokens.append(piece)
            size += len(piece)
            if size >= PART_TOKENS:
                yield part
                part, size = Part([], [], []), 0
            if piece is tokens:
                break
    if part.doc:
        yield part


class Strings:
    """What tokens are: of texts, windows of ``length`` tokens with minimisers of ``gram``."""

    #: Whether a window also counts as repeated if it starts earlier in the same document.
    within = False
    #: Bytes of text for each minimiser, about.
    spacing = 16

    def __init__(self, length: int, gram: int, frequent: int = FREQUENT):
        self.length, self.gram, self.frequent = length, gram, frequent

    def tokens(self, text: bytes):
        """The tokens of a text, a sequence."""
        raise NotImplementedError

    def flat(self, pieces: list):
        """Sequences behind each other."""
        raise NotImplementedError

    def grams(self, flat) -> np.ndarray:
        """Hash of every run of ``gram`` tokens."""
        raise NotImplementedError

    def packed(self, flat, begin: int, end: int) -> bytes:
        """The tokens from ``begin`` to ``end`` as one string."""
        raise NotImplementedError

    def cut(self, flat, begins: list[int], ends: list[int]) -> list[bytes]:
        """``packed`` of each of several places."""
        return [self.packed(flat, a, b) for a, b in zip(begins, ends)]

    def windows(self, packed: bytes) -> list[bytes]:
        """The windows of a packed string."""
        raise NotImplementedError

    def numbers(self, strings: list[bytes]) -> np.ndarray:
        """The tokens of packed strings behind each other, as numbers."""
        raise NotImplementedError

    def window_hashes(self, numbers: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def equal(self, numbers: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the windows that start at ``a`` and at ``b`` are the same."""
        return np.logical_and.reduce([numbers[a + i] == numbers[b + i] for i in range(self.length)]) if len(a) else np.zeros(0, bool)


@dataclass
class Found:
    """Super-k-mers of some documents: tokens, and of each the document's row, first token there and here, number in its document, windows, minimiser."""

    flat: object
    row: np.ndarray
    start: np.ndarray
    first: np.ndarray
    place: np.ndarray
    windows: np.ndarray
    gram: np.ndarray

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """Order by minimiser and document, and the heads of these groups in it."""
        order, fresh = order_by_hash(self.gram)
        gram = self.gram[order]
        if np.any((gram[1:] != gram[:-1]) & ~fresh[1:]):
            # Different minimisers share their high bits.
            order = np.argsort(self.gram, kind="stable")
            gram = self.gram[order]
        row = self.row[order]
        return order, np.flatnonzero(np.append(True, (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])) if len(order) else np.zeros(0, bool))


def found_in(kind: Strings, texts: list[bytes]) -> Iterator[Found]:
    seen = np.zeros(len(texts), np.int64)
    for part in parts_of(map(kind.tokens, texts), kind.length):
        flat, lengths = kind.flat(part.tokens), part.lengths()
        own = super_kmers(kind.grams(flat), lengths, kind.length, kind.gram)
        row = np.array(part.doc, np.int64)[own.doc]
        start = np.array(part.offset, np.int64)[own.doc] + own.first - (np.cumsum(lengths) - lengths)[own.doc]
        counts = np.bincount(row, minlength=len(texts))
        place = np.arange(len(row)) - (np.cumsum(counts) - counts)[row] + seen[row]
        seen += counts
        yield Found(flat, row, start, own.first, place, own.windows, own.gram)


# -- blobs: columns of numbers, byte by byte, and what follows -----------------


def pack(columns: Iterable[tuple[np.ndarray, str]], tail: bytes = b"") -> bytes:
    """``columns`` with their types; compressed."""
    out = []
    for values, kind in columns:
        column = np.ascontiguousarray(values).astype(kind)
        # A transposed array by itself goes out byte for byte, a copy of it at once.
        out += [len(column).to_bytes(4, "little"), np.ascontiguousarray(column.view(np.uint8).reshape(-1, column.itemsize).T).tobytes()]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(out) + tail)


def unpack(blob: bytes, kinds: Iterable[str]) -> tuple[list[np.ndarray], bytes]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    for kind in kinds:
        n, width = int.from_bytes(raw[at : at + 4], "little"), np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, n * width, at + 4).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += 4 + n * width
    return out, raw[at:]


def steps(values: np.ndarray) -> np.ndarray:
    """Differences of sorted values, undone by ``np.cumsum``."""
    return np.diff(values, prepend=values.dtype.type(0))


def slices_of(keys: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal sorted keys."""
    if len(keys):
        head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        for a, b in zip(head.tolist(), [*head[1:].tolist(), len(keys)]):
            yield int(keys[a]), slice(a, b)


@dataclass(frozen=True)
class Layout:
    """Buckets (2 to the power ``bits``) of minimisers, and parts of the corpus by document id."""

    bits: int
    parts: int

    @staticmethod
    def of(docs: DataFrame, kind: Strings, n_bytes: int) -> Layout:
        """For so many bytes of text: buckets and parts of a size that does not grow, one for each shuffle partition at least."""
        least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return Layout(max(n_bytes // kind.spacing // BUCKET_SAMPLES, least).bit_length(), max(2 * n_bytes // (5 * PART_BYTES), least))

    def part(self, okeys: np.ndarray) -> np.ndarray:
        h = okeys.view(U)
        return (mix(h, mix(h, h)) % U(self.parts)).astype(np.int64)

    def bucket(self, gram: np.ndarray) -> np.ndarray:
        return (gram >> U(64 - self.bits)).astype(np.int64)


# -- 1: places of minimisers --------------------------------------------------

PLACES = "bucket int, blob binary"
PLACE_KINDS = ("<u4", "<i8", "<u4")


def sampled(docs: DataFrame, kind: Strings, layout: Layout) -> DataFrame:
    """``PLACES``: of each document of ``keyed_texts`` every distinct minimiser once: 32 bits below the bucket's, id, number."""

    def make():
        held, n = [], 0

        def step(batch):
            nonlocal held, n
            for at in range(0, batch.num_rows, SLICE_ROWS):
                some = batch.slice(at, SLICE_ROWS)
                okeys = some.column("okey").to_numpy()
                for found in found_in(kind, utf8(some.column("text"))):
                    order, head = found.groups()
                    one = np.sort(order[head])
                    held.append((found.gram[one], okeys[found.row[one]], found.place[one]))
                    n += len(one)
                    if n >= SEND_ROWS:
                        yield sent(held)
                        held, n = [], 0

        def rest():
            if n:
                yield sent(held)

        def sent(held):
            gram, okey, place = (np.concatenate(c) for c in zip(*held))
            if np.any(okey[1:] < okey[:-1]):
                by_id = np.argsort(okey, kind="stable")
                gram, okey, place = gram[by_id], okey[by_id], place[by_id]
            bucket = layout.bucket(gram)
            order = order_by(bucket)
            bucket, okey, place = bucket[order], okey[order], place[order]
            below = ((gram[order] << U(layout.bits)) >> U(32)).astype("<u4")
            cut = list(slices_of(bucket))
            blobs = [pack(zip((below[s], steps(okey[s]), place[s]), PLACE_KINDS)) for _, s in cut]
            return {"bucket": pa.array([b for b, _ in cut], pa.int32()), "blob": pa.array(blobs, pa.binary())}

        return step, rest

    return map_batches(docs.select("okey", "text"), make, PLACES)


def placed(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, id and number of all places in ``blobs``."""
    columns = [unpack(b, PLACE_KINDS)[0] for b in blobs]
    return tuple(np.concatenate([c[i] if i != 1 else np.cumsum(c[i]) for c in columns]) for i in range(3))


# -- 2: places whose minimiser is in several documents --------------------------

ASKED = "part int, copies boolean, blob binary"
ASKED_KINDS = ("<i8", "<u4", "u1")


@dataclass
class Runs:
    """Runs of equal sorted minimisers: heads, sizes, and whether their documents are several."""

    head: np.ndarray
    size: np.ndarray
    several: np.ndarray

    @staticmethod
    def of(rest: np.ndarray, okey: np.ndarray, within: bool) -> Runs:
        head = np.flatnonzero(np.append(True, rest[1:] != rest[:-1])) if len(rest) else np.zeros(0, np.int64)
        size = np.diff(np.append(head, len(rest)))
        most = np.maximum.reduceat(okey, head) if len(head) else okey
        # Rows without an id share the greatest one with a legal id, and may be several.
        several = (np.minimum.reduceat(okey, head) < most if len(head) else okey > 0) | ((size > 1) & (within | (most == NULL_ID)))
        return Runs(head, size, several)


def asked_rows(okey: np.ndarray, place: np.ndarray, often: np.ndarray, layout: Layout) -> tuple[list[int], list[bytes]]:
    part = layout.part(okey)
    order = np.lexsort((place, okey, part))
    part, okey, place, often = part[order], okey[order], place[order], often[order]
    cut = list(slices_of(part))
    return [p for p, _ in cut], [pack(zip((steps(okey[s]), place[s], often[s]), ASKED_KINDS)) for _, s in cut]


def shared_places(places: DataFrame, kind: Strings, layout: Layout) -> DataFrame:
    """``ASKED``: by part of the corpus, the places whose minimiser is in several documents, and whether in very many."""

    def of_bucket(group: pa.Table) -> pa.Table:
        rest, okey, place = placed(group.column("blob").to_pylist())
        order = order_by(rest)
        rest, okey, place = rest[order], okey[order], place[order]
        runs = Runs.of(rest, okey, kind.within)
        chosen = np.repeat(runs.several, runs.size)
        often = np.repeat(runs.size >= kind.frequent, runs.size)
        parts, blobs = asked_rows(okey[chosen], place[chosen], often[chosen], layout)
        return pa.table({"part": pa.array(parts, pa.int32()), "copies": pa.array([False] * len(parts), pa.bool_()), "blob": pa.array(blobs, pa.binary())})

    return places.groupBy("bucket").applyInArrow(of_bucket, ASKED)


def copy_mark(okey: int, nul: bool, digest: bytes) -> bytes:
    return okey.to_bytes(8, "little", signed=True) + bytes([bool(nul)]) + digest


def whole_copies(docs: DataFrame, layout: Layout) -> DataFrame:
    """``ASKED``: the SHA-256 of the text of rows of ``keyed_texts`` whose text a smaller id has too; found by a join of digests."""
    digests = saved(docs.select("nul", "okey", F.unhex(F.sha2("text", 256)).alias("digest")))
    place = F.struct("nul", "okey")
    several = digests.groupBy("digest").agg(F.min(place).alias("least"), F.max(place).alias("most")).where("least < most")
    copies = digests.join(several, "digest").where(place > F.col("least")).select("okey", "nul", "digest").distinct()

    def make():
        def step(batch):
            okey = batch.column("okey").to_numpy()
            marks = [copy_mark(*row) for row in zip(okey.tolist(), batch.column("nul").to_pylist(), batch.column("digest").to_pylist())]
            yield {"part": pa.array(layout.part(okey), pa.int32()), "copies": pa.array([True] * len(okey), pa.bool_()), "blob": pa.array(marks, pa.binary())}

        return step

    return map_batches(copies, make, ASKED)


# -- 3: strings ---------------------------------------------------------------

SENT = "bucket int, blob binary"
STRING_KINDS = ("<u4", "<u4", "<u4", "<i8", "<u4", "<u4")
RANGE_KINDS = ("<i8", "<u4", "<u4", "<u4")


def pressed(docs: DataFrame, layout: Layout, keep: list[str]) -> DataFrame:
    """``keyed_texts`` by part of the corpus, the text compressed, with the columns ``keep``."""

    def make():
        press = zstandard.ZstdCompressor(level=3)

        def step(batch):
            body = pa.array([press.compress(t) for t in utf8(batch.column("text"))], pa.binary())
            yield {"part": pa.array(layout.part(batch.column("okey").to_numpy()), pa.int32()), "okey": batch.column("okey"), "nul": batch.column("nul"), "body": body, **{c: batch.column(c) for c in keep}}

        return step

    kept = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return map_batches(docs.select("okey", "nul", "text", *keep), make, f"part int, okey long, nul boolean, body binary{kept}")


class Texts:
    """The documents of a part of the corpus: texts, ids, flags (null id, and which of several texts of an id), and rank by id."""

    def __init__(self, table: pa.Table):
        unpress = zstandard.ZstdDecompressor()
        self.texts = [unpress.decompress(b) for b in table.column("body").to_pylist()]
        self.okey = table.column("okey").to_numpy().astype(np.int64)
        nul = table.column("nul").to_numpy().astype(np.int64)
        by_id: dict[tuple[int, int], set[bytes]] = {}
        ids = list(zip(self.okey.tolist(), nul.tolist()))
        for i, text in zip(ids, self.texts):
            by_id.setdefault(i, set()).add(text)
        number = {(i, text): n for i, texts in by_id.items() if len(texts) > 1 for n, text in enumerate(sorted(texts))}
        self.flag = nul * NULL_FLAG + np.array([number.get(x, 0) for x in zip(ids, self.texts)] if number else 0, np.int64)
        self.rank = ranks(self.okey, self.flag)


def ranks(okey: np.ndarray, flag: np.ndarray) -> np.ndarray:
    """Numbers that order ids, null last; equal for equal ids."""
    nul = flag >= NULL_FLAG
    order = np.lexsort((okey, nul))
    fresh = np.append(False, (okey[order][1:] != okey[order][:-1]) | (nul[order][1:] != nul[order][:-1])) if len(order) else np.zeros(0, bool)
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(fresh)
    return out


def is_later(kind: Strings, number: np.ndarray, rank: np.ndarray, flag: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Of places of strings with these numbers (small ones), those that an earlier place of the same string covers wholly."""
    if not kind.within:
        least = np.full(int(number.max()) + 1 if len(number) else 0, np.iinfo(np.int64).max)
        np.minimum.at(least, number, rank)
        return rank > least[number]
    order = np.lexsort((start, flag, rank, number))
    head = np.append(True, number[order][1:] != number[order][:-1]) if len(order) else np.zeros(0, bool)
    first = order[np.flatnonzero(head)][np.cumsum(head) - 1] if len(order) else order
    out = np.zeros(len(order), bool)
    # Rows that repeat a document have the same place twice.
    out[order] = (rank[order] > rank[first]) | (flag[order] != flag[first]) | (start[order] != start[first])
    return out


def numbering() -> dict[bytes, int]:
    """Numbers strings as they are looked up, from 0."""
    out: defaultdict[bytes, int] = defaultdict()
    out.default_factory = out.__len__
    return out


def met(own: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Which of ``own`` are among ``codes``; both ascend, so only the codes in reach are looked at."""
    out = np.zeros(len(own), bool)
    if len(own):
        codes = codes[np.searchsorted(codes, own[0]) : np.searchsorted(codes, own[-1], "right")]
        at = np.searchsorted(own, codes)
        out[at[own[at] == codes]] = True
    return out


class Sender:
    """Gathers a part's strings with their places, and sends them by bucket."""

    def __init__(self, kind: Strings, layout: Layout, docs: Texts):
        self.kind, self.layout, self.docs = kind, layout, docs
        self.known: list[tuple[np.ndarray, ...]] = []
        self.buckets: list[int] = []
        self.blobs: list[bytes] = []
        self.clear()

    def clear(self) -> None:
        self.number = numbering()
        self.rows: list[tuple[np.ndarray, ...]] = []

    def add(self, found: Found, chosen: np.ndarray, often: np.ndarray) -> None:
        number, first = self.number, found.first[chosen]
        ends = (first + found.windows[chosen] + self.kind.length - 1).tolist()
        ids = list(map(number.__getitem__, self.kind.cut(found.flat, first.tolist(), ends)))
        self.rows.append((np.array(ids, np.int64), found.row[chosen], found.start[chosen], found.windows[chosen], found.gram[chosen], often[chosen]))
        if len(number) >= SEND_STRINGS:
            self.send()

    def cover(self, row: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        self.known.append((self.docs.okey[row], self.docs.flag[row], begin, end))

    def unknown(self, number: np.ndarray, row: np.ndarray, start: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """Which places are not covered by an earlier one of the same string here; the others are known."""
        later = is_later(self.kind, number, self.docs.rank[row], self.docs.flag[row], start)
        self.cover(row[later], start[later], (start + windows)[later] + self.kind.length - 1)
        return ~later

    def send(self) -> None:
        if self.rows:
            number, row, start, windows, gram, often = (np.concatenate(c) for c in zip(*self.rows))
            strings = list(self.number)
            self.clear()
            left = self.unknown(number, row, start, windows)
            whole, cut = np.flatnonzero(left & ~often), np.flatnonzero(left & often)
            self.blob(strings, number[whole], row[whole], start[whole], windows[whole], gram[whole])
            if len(cut):
                self.send_windows(strings, number[cut], row[cut], start[cut])

    def send_windows(self, strings: list[bytes], number: np.ndarray, row: np.ndarray, start: np.ndarray) -> None:
        own = numbering()
        windows = {n: list(map(own.__getitem__, self.kind.windows(strings[n]))) for n in np.unique(number).tolist()}
        counts = np.array([len(windows[n]) for n in number.tolist()])
        each = np.repeat(np.arange(len(number)), counts)
        within = np.arange(len(each)) - np.repeat(np.cumsum(counts) - counts, counts)
        ids, one = np.concatenate([windows[n] for n in number.tolist()]), np.ones(len(each), np.int64)
        row, start = row[each], start[each] + within
        left = self.unknown(ids, row, start, one)
        gram = np.fromiter(map(xxhash.xxh3_64_intdigest, own), U, len(own))
        self.blob(list(own), ids[left], row[left], start[left], one[left], gram[ids[left]])

    def blob(self, strings: list[bytes], number: np.ndarray, row: np.ndarray, start: np.ndarray, windows: np.ndarray, gram: np.ndarray) -> None:
        """Strings in the order of their minimisers, each once a bucket, and their places."""
        # Equal strings have one minimiser, and rows come in order.
        of_string = np.zeros(len(strings), U)
        of_string[number] = gram
        by_gram = np.empty(len(strings), np.int64)
        by_gram[np.argsort(of_string, kind="stable")] = np.arange(len(strings))
        order = order_by(by_gram[number])
        bucket = self.layout.bucket(gram[order])
        number, row, start, windows = number[order], row[order], start[order], windows[order]
        for b, s in slices_of(bucket):
            head = np.append(True, number[s][1:] != number[s][:-1])
            texts = [strings[n] for n in number[s][head].tolist()]
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            at, doc = np.cumsum(head) - 1, row[s]
            columns = (sizes, windows[s][head], steps(at), self.docs.okey[doc], self.docs.flag[doc], start[s])
            self.buckets.append(b)
            self.blobs.append(pack(zip(columns, STRING_KINDS), b"".join(texts)))

    def result(self, part: int) -> pa.Table:
        self.send()
        if self.known:
            # A bucket below zero holds what needs no other part's strings.
            self.buckets.append(-1 - part)
            self.blobs.append(pack_ranges(*merged(*(np.concatenate(c) for c in zip(*self.known)))))
        return pa.table({"bucket": pa.array(self.buckets, pa.int32()), "blob": pa.array(self.blobs, pa.binary())})


def sent_strings(kind: Strings, layout: Layout, table: pa.Table, asked: pa.Table) -> pa.Table:
    """``SENT``: the strings of a part of the corpus at the places asked for."""
    docs = Texts(table)
    sender = Sender(kind, layout, docs)
    wanted, copies = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8))], set()
    for is_copies, blob in zip(asked.column("copies").to_pylist(), asked.column("blob").to_pylist()):
        if is_copies:
            copies.add(blob)
        else:
            okey, place, often = unpack(blob, ASKED_KINDS)[0]
            wanted.append((np.cumsum(okey), place.astype(np.int64), often))
    texts = list(docs.texts)
    if copies:
        for i, (okey, flag, text) in enumerate(zip(docs.okey.tolist(), docs.flag.tolist(), docs.texts)):
            if copy_mark(okey, flag >= NULL_FLAG, sha256(text).digest()) in copies:
                texts[i] = b""
                if (n := len(kind.tokens(text))) >= kind.length:
                    sender.cover(np.array([i]), np.array([0]), np.array([n]))
    okey, place, often = (np.concatenate(c) for c in zip(*wanted))
    # Rows of the ids; an id with several texts has several.
    by_id = np.argsort(docs.okey, kind="stable")
    low, high = np.searchsorted(docs.okey[by_id], okey, "left"), np.searchsorted(docs.okey[by_id], okey, "right")
    each = np.repeat(np.arange(len(okey)), high - low)
    row = by_id[np.arange(len(each)) + np.repeat(low - (np.cumsum(high - low) - (high - low)), high - low)] if len(each) else each
    codes = (row << 32) | place[each]
    codes, often_codes = np.sort(codes), np.sort(codes[often[each] > 0])
    for found in found_in(kind, texts):
        own = (found.row << 32) | found.place
        order, head = found.groups()
        if not len(order):
            continue
        size = np.diff(np.append(head, len(order)))

        def of_groups(marks):
            out = np.empty(len(order), bool)
            out[order] = np.repeat(np.logical_or.reduceat(marks[order], head), size)
            return out

        chosen, frequent = of_groups(met(own, codes)), of_groups(met(own, often_codes))
        if kind.within:
            again = np.empty(len(order), bool)
            again[order] = np.repeat(size > 1, size)
            chosen |= again
        if chosen.any():
            sender.add(found, chosen, frequent)
    return sender.result(int(table.column("part")[0].as_py()) if table.num_rows else 0)


# -- 4: windows that occur earlier ----------------------------------------------

RANGES = "part int, blob binary"


def merged(okey: np.ndarray, flag: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges by document and begin; those that meet the one before, or overlap it, are one."""
    order = np.lexsort((begin, flag, okey))
    okey, flag, begin, end = okey[order], flag[order], begin[order], end[order]
    if not len(okey):
        return okey, flag, begin, end
    doc = np.cumsum(np.append(False, (okey[1:] != okey[:-1]) | (flag[1:] != flag[:-1])))
    # The furthest end so far of the same document: documents are set apart by more than any end.
    apart = int(end.max()) + 1
    reach = np.maximum.accumulate(end + doc * apart) - doc * apart
    head = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (begin[1:] > reach[:-1])))
    return okey[head], flag[head], begin[head], np.maximum.reduceat(end, head)


def pack_ranges(okey: np.ndarray, flag: np.ndarray, begin: np.ndarray, end: np.ndarray) -> bytes:
    return pack(zip((steps(okey), flag, begin, end), RANGE_KINDS))


def exact_runs(hashes: np.ndarray, at: np.ndarray, length: int, numbers: np.ndarray, equal: Callable) -> tuple[np.ndarray, np.ndarray]:
    """An order of windows, equal ones in order of place behind each other, and marks of the first of each run of them: windows with one hash are compared token by token."""
    order, fresh = order_by_hash(hashes)
    pairs = np.flatnonzero(~fresh)
    unlike = pairs[~equal(numbers, at[order[pairs - 1]], at[order[pairs]])]
    if len(unlike):
        # Different windows share a hash: of these runs the windows themselves are sorted.
        run = np.cumsum(fresh) - 1
        marked = np.zeros(run[-1] + 1, bool)
        marked[run[unlike]] = True
        some = np.flatnonzero(marked[run])
        run[some] = len(run) + np.unique(numbers[at[order[some]][:, None] + np.arange(length)], axis=0, return_inverse=True)[1].ravel()
        again = np.argsort(run, kind="stable")
        order, run = order[again], run[again]
        fresh[1:] = run[1:] != run[:-1]
    return order, fresh


def exact_groups(hashes: np.ndarray, at: np.ndarray, length: int, numbers: np.ndarray, equal: Callable) -> np.ndarray:
    """A number for each window, the same for equal windows only."""
    order, fresh = exact_runs(hashes, at, length, numbers, equal)
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(fresh) - 1
    return group


def covered_here(kind: Strings, layout: Layout, group: pa.Table) -> pa.Table:
    """``RANGES``: of a bucket's strings the ranges of tokens in windows that start earlier too."""
    buckets, blobs = group.column("bucket").to_pylist(), group.column("blob").to_pylist()
    if buckets[0] < 0:
        return pa.table({"part": pa.array([-1 - b for b in buckets], pa.int32()), "blob": pa.array(blobs, pa.binary())})
    of_blob, sizes, tails, rows, before = [], [], [], [], 0
    for blob in blobs:
        (size, windows, at, *place), tail = unpack(blob, STRING_KINDS)
        of_blob.append(windows)
        sizes.append(size)
        tails.append(tail)
        rows.append((before + np.cumsum(at.astype(np.int64)), *(c.astype(np.int64) for c in place)))
        before += len(size)
    ends = np.cumsum(np.concatenate([[0], *sizes]), dtype=np.int64)
    coded = pa.Array.from_buffers(pa.large_binary(), before, [None, pa.py_buffer(ends), pa.py_buffer(b"".join(tails))]).dictionary_encode()
    numbers_of, strings = coded.indices.to_numpy(), coded.dictionary
    rows = [(numbers_of[at].astype(np.int64), *place) for at, *place in rows]
    number, okey, flag, start = (np.concatenate(c) for c in zip(*rows))
    windows = np.zeros(len(strings), np.int64)
    windows[numbers_of] = np.concatenate(of_blob)
    rank = ranks(okey, flag)
    later = is_later(kind, number, rank, flag, start)
    ranges = [(okey[later], flag[later], start[later], (start + windows[number])[later] + kind.length - 1)]
    # Of the earliest places' strings, each once, the windows that still earlier ones have.
    rest = np.flatnonzero(~later)
    rest = rest[np.lexsort((start[rest], flag[rest], rank[rest])) if flag[rest].any() else np.argsort(rank[rest] << 32 | start[rest], kind="stable")]
    first_at = np.empty(len(strings), np.int64)
    first_at[number[rest][::-1]] = np.arange(len(rest))[::-1]
    one = rest[first_at[number[rest]] == np.arange(len(rest))]
    own = number[one]
    counts = windows[own]
    row = np.repeat(np.arange(len(own)), counts)
    numbers = kind.numbers(strings.take(pa.array(own)).to_pylist())
    # A string has as many windows as tokens but for the last ones.
    at = np.arange(len(row)) + (kind.length - 1) * row
    order, head = exact_runs(kind.window_hashes(numbers)[at], at, kind.length, numbers, kind.equal)
    # Windows are in order of place, so the first of a group is the earliest.
    more = np.flatnonzero(~head)
    again, first = order[more], order[np.flatnonzero(head)[np.cumsum(head)[more] - 1]]
    if not kind.within:
        rank_one = rank[one]
        again = again[rank_one[row[again]] > rank_one[row[first]]]
    marks = np.zeros(len(order), bool)
    marks[again] = True
    fresh = np.append(True, row[1:] != row[:-1])
    begin = np.flatnonzero(marks & (fresh | ~np.append(False, marks[:-1])))
    end = np.flatnonzero(marks & np.append(fresh[1:] | ~marks[1:], True)) + 1
    # Runs of such windows, for each place of their string that is left.
    before = (np.cumsum(counts) - counts)[row[begin]]
    of, begin, end = own[row[begin]], begin - before, end - 1 - before + kind.length
    order = np.argsort(of, kind="stable")
    of, begin, end = of[order], begin[order], end[order]
    low, high = np.searchsorted(of, number[rest], "left"), np.searchsorted(of, number[rest], "right")
    each = np.repeat(rest, high - low)
    run = np.arange(len(each)) + np.repeat(low - (np.cumsum(high - low) - (high - low)), high - low)
    ranges.append((okey[each], flag[each], start[each] + begin[run], start[each] + end[run]))
    okey, flag, begin, end = merged(*(np.concatenate(c) for c in zip(*ranges)))
    part = layout.part(okey)
    order = np.argsort(part, kind="stable")
    okey, flag, begin, end = okey[order], flag[order], begin[order], end[order]
    cut = list(slices_of(part[order]))
    return pa.table({"part": pa.array([p for p, _ in cut], pa.int32()), "blob": pa.array([pack_ranges(okey[s], flag[s], begin[s], end[s]) for _, s in cut], pa.binary())})


def covered_ranges(texts: DataFrame, asked: DataFrame, kind: Strings, layout: Layout) -> DataFrame:
    """``RANGES``: of ``pressed`` texts the ranges of tokens that lie in windows which start earlier too."""
    sent = texts.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(lambda a, b: sent_strings(kind, layout, a, b), SENT)
    return sent.groupBy("bucket").applyInArrow(lambda group: covered_here(kind, layout, group), RANGES)


def with_ranges(texts: DataFrame, ranges: DataFrame, apply: Callable[[pa.Table, list[bytes], list[np.ndarray]], dict], schema: str) -> DataFrame:
    """``apply`` on the rows of each part of ``pressed`` texts: the rows, their texts, and of each its ranges (pairs of numbers in rows)."""

    def of_part(table: pa.Table, found: pa.Table) -> pa.Table:
        docs = Texts(table)
        columns = [unpack(b, RANGE_KINDS)[0] for b in found.column("blob").to_pylist()]
        okey, flag, begin, end = (np.concatenate([np.zeros(0, np.int64), *(np.cumsum(c[i]) if not i else c[i].astype(np.int64) for c in columns)]) for i in range(4))
        order = np.lexsort((flag, okey))
        pairs = np.column_stack([begin[order], end[order]])
        fresh = np.append(True, (okey[order][1:] != okey[order][:-1]) | (flag[order][1:] != flag[order][:-1])) if len(order) else np.zeros(0, bool)
        head = np.flatnonzero(fresh)
        own = {d: pairs[a:b] for d, a, b in zip(zip(okey[order][head].tolist(), flag[order][head].tolist()), head.tolist(), [*head[1:].tolist(), len(order)])}
        none = np.zeros((0, 2), np.int64)
        out = apply(table, docs.texts, [own.get(d, none) for d in zip(docs.okey.tolist(), docs.flag.tolist())])
        out = pa.table({k: v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v) for k, v in out.items()})
        return pa.Table.from_batches(out.to_batches(SLICE_ROWS), out.schema)

    return texts.groupBy("part").cogroup(ranges.groupBy("part")).applyInArrow(of_part, schema)


def doc_ids(table: pa.Table) -> pa.Array:
    return pa.array(table.column("okey").to_numpy(), pa.int64(), mask=table.column("nul").to_numpy())


def text_bytes(docs: DataFrame) -> int:
    return int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def runs(marks: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of the runs of true marks."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], marks.astype(np.int8), [0]))))
    return zip(edges[::2].tolist(), edges[1::2].tolist())


def covered(n: int, pairs: np.ndarray) -> np.ndarray:
    """Marks of the n tokens that lie in a range."""
    marks = np.zeros(n + 1, np.int32)
    np.add.at(marks, pairs[:, 0], 1)
    np.add.at(marks, pairs[:, 1], -1)
    return np.cumsum(marks[:-1]) > 0
