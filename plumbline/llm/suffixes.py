"""Removal of byte strings that earlier documents have too, by a logarithmic family of suffix arrays.

A ``SuffixIndex`` holds levels. A level is a Parquet table, by bucket, of the
suffixes that start at minimisers (``superkmers``): each with its document and
its place there, sorted by its leading ``GRAM`` bytes (by their hash, of which
the bucket holds the high bits). Any two documents with a string of
``LENGTH`` bytes in common have suffixes there that start with the same
minimiser within it, so no other suffixes are needed.

New documents come in batches. A batch's suffixes are sorted into an array of
their own, which is merge-scanned against all levels: the places in
documents where a suffix of the batch and one of another document start alike
are noted. Then the batch becomes a level; levels that are not twice as large as the
next merge, so that there are logarithmically many and each suffix moves
logarithmically often. What the scans have noted is settled by bytes: the
strings around these places meet by minimiser, and equal ones are compared
byte by byte before a range is taken for covered.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import superkmers as sk
from plumbline.llm.rows import NULL_ID, dropped, keyed_texts, saved, shared_folder

#: Bytes of a match, and of the gram whose least hash is a window's minimiser.
LENGTH, GRAM = 50, 20
#: Grams that are hashed together, so that their arrays stay near a core.
BLOCK = 1 << 15
#: Batches, by id, that a table of documents is taken in.
BATCHES = 3


def byte_grams(flat: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of every run of ``gram`` bytes (8 or more): its eights, mixed."""
    n = len(flat) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if n > BLOCK:
        return np.concatenate([byte_grams(flat[at : at + BLOCK + gram - 1], gram) for at in range(0, n, BLOCK)])
    words = eights(flat)
    h = words[:n] * sk.MIX_A
    for at in offsets(gram)[1:]:
        h ^= h >> np.uint64(32)
        h += words[at : at + n]
        h *= sk.MIX_B
    h ^= h >> np.uint64(29)
    return h * sk.MIX_A


def eights(flat: np.ndarray) -> np.ndarray:
    """The eight bytes from every byte on, as one number."""
    return np.ndarray((len(flat) - 7,), "<u8", flat, strides=(1,)).copy()


def offsets(length: int) -> list[int]:
    """Where eights start that cover ``length`` bytes."""
    return sorted({*range(0, length - 7, 8), length - 8})


class ByteStrings(sk.Strings):
    """Bytes of UTF-8 as tokens; matches lie in different documents."""

    within, spacing = False, 16

    def __init__(self, length: int = LENGTH, gram: int = GRAM, frequent: int = sk.FREQUENT):
        if not 8 <= gram <= length:
            raise ValueError(f"no grams of {gram} bytes for strings of {length}")
        super().__init__(length, gram, frequent)

    def tokens(self, text: bytes) -> bytes:
        return text

    def flat(self, pieces: list[bytes]) -> bytes:
        return b"".join(pieces)

    def grams(self, flat: bytes) -> np.ndarray:
        return byte_grams(np.frombuffer(flat, np.uint8), self.gram)

    def packed(self, flat: bytes, begin: int, end: int) -> bytes:
        return flat[begin:end]

    def cut(self, flat: bytes, begins: list[int], ends: list[int]) -> list[bytes]:
        return [flat[a:b] for a, b in zip(begins, ends)]

    def windows(self, packed: bytes) -> list[bytes]:
        return [packed[i : i + self.length] for i in range(len(packed) - self.length + 1)]

    def numbers(self, strings: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(strings), np.uint8)

    def window_hashes(self, numbers: np.ndarray) -> np.ndarray:
        return byte_grams(numbers, self.length)

    def equal(self, numbers: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(a):
            return np.zeros(0, bool)
        words = eights(numbers)
        return np.logical_and.reduce([words[a + i] == words[b + i] for i in offsets(self.length)])


LEVEL_KINDS = ("<u4", "<i8", "<u4")


class SuffixIndex:
    """Levels of sorted suffixes in ``folder``, and the places that scans have noted."""

    SCANNED = "kind string, key int, blob binary"

    def __init__(self, spark: SparkSession, folder: str, kind: sk.Strings, layout: sk.Layout):
        self.spark, self.folder, self.kind, self.layout = spark, folder.rstrip("/"), kind, layout
        #: Size and table of each level, the largest first.
        self.levels: list[tuple[int, str]] = []
        self.scans: list[str] = []

    def rows(self, path: str, kind: str) -> DataFrame:
        return self.spark.read.schema(self.SCANNED).parquet(path).where(F.col("kind") == kind)

    def add(self, docs: DataFrame, size: int, last: bool = False) -> None:
        """Scans the batch ``docs`` (``keyed_texts``, of any ids) of ``size`` bytes, and makes it a level, unless it is the ``last``."""
        merge, total = len(self.levels), size
        while merge and self.levels[merge - 1][0] < 2 * total:
            merge -= 1
            total += self.levels[merge][0]
        kind, layout = self.kind, self.layout
        arrays = sk.sampled(docs, kind, layout).select("bucket", F.lit(-1).alias("level"), "blob")
        for i, (_, path) in enumerate(self.levels):
            arrays = arrays.union(self.rows(path, "level").select(F.col("key").alias("bucket"), F.lit(i).alias("level"), "blob"))
        path = f"{self.folder}/{uuid.uuid4().hex}"
        scanned = arrays.groupBy("bucket").applyInArrow(lambda group: scan(group, kind, layout, merge, last), self.SCANNED)
        scanned.write.partitionBy("kind").parquet(path)
        self.scans.append(path)
        if not last:
            for _, old in self.levels[merge:]:
                dropped(self.spark, f"{old}/kind=level")
            self.levels[merge:] = [(total, path)]

    def noted(self) -> DataFrame:
        """``superkmers.ASKED``: the places of all documents so far whose suffix starts like another document's."""
        found = [self.rows(path, "noted").select(F.col("key").alias("part"), F.lit(False).alias("copies"), "blob") for path in self.scans]
        out = found[0]
        for more in found[1:]:
            out = out.union(more)
        return out

    def drop(self) -> None:
        dropped(self.spark, self.folder)


def scan(group: pa.Table, kind: sk.Strings, layout: sk.Layout, merge: int, last: bool) -> pa.Table:
    """A bucket of a batch, sorted and merged past the levels' arrays: places to note, and the array of the levels from ``merge`` on with the batch."""
    levels: dict[int, list[bytes]] = {}
    for level, blob in zip(group.column("level").to_pylist(), group.column("blob").to_pylist()):
        levels.setdefault(level, []).append(blob)
    bucket = int(group.column("bucket")[0].as_py())
    arrays, of_level = [], []
    for level in sorted(levels, key=lambda x: (x < 0, x)):
        if level < 0:
            rest, okey, place = sk.placed(levels[level])
            order = sk.order_by(rest)
            rest, okey, place = rest[order], okey[order], place[order]
        else:
            (delta, okey, place), _ = sk.unpack(levels[level][0], LEVEL_KINDS)
            rest = np.cumsum(delta, dtype=np.uint32)
        arrays.append((rest, okey, place))
        of_level.append(np.full(len(rest), level))
    rest, okey, place = (np.concatenate(c) for c in zip(*arrays))
    # Sorted arrays behind each other: a stable sort merges their runs.
    order = np.argsort(rest, kind="stable")
    rest, okey, place, level = rest[order], okey[order], place[order], np.concatenate(of_level)[order]
    fresh = level < 0
    runs = sk.Runs.of(rest, okey, kind.within)
    # What the runs were before this batch: the same without its suffixes.
    old = np.flatnonzero(~fresh)
    before = sk.Runs.of(rest[old], okey[old], kind.within)
    run = np.repeat(np.arange(len(runs.head)), runs.size)
    was, old_size = np.zeros(len(runs.head), bool), np.zeros(len(runs.head), np.int64)
    if len(old):
        at = run[old[before.head]]
        was[at], old_size[at] = before.several, before.size
    often = runs.size >= kind.frequent
    # Old places were noted when their run first had several documents, and again when these became very many.
    again = ~was | (often & (old_size < kind.frequent))
    chosen = runs.several[run] & (fresh | again[run])
    # A run without new suffixes tells nothing new.
    has_new = np.zeros(len(runs.head), bool)
    has_new[run[fresh]] = True
    chosen &= has_new[run]
    parts, blobs = sk.asked_rows(okey[chosen], place[chosen], often[run[chosen]], layout)
    kinds, keys = ["noted"] * len(parts), parts
    if not last:
        kept = fresh | (level >= merge)
        if kept.any():
            kinds, keys = [*kinds, "level"], [*keys, bucket]
            blobs.append(sk.pack(zip((sk.steps(rest[kept]), okey[kept], place[kept]), LEVEL_KINDS)))
    return pa.table({"kind": pa.array(kinds, pa.string()), "key": pa.array(keys, pa.int32()), "blob": pa.array(blobs, pa.binary())})


def noted_places(plain: DataFrame, kind: sk.Strings, layout: sk.Layout, n_bytes: int, batches: int) -> DataFrame:
    """What an index notes of ``keyed_texts`` that come to it in ``batches`` by id."""
    spark = plain.sparkSession
    edges = plain.agg(F.percentile_approx("okey", [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else []
    edges = sorted(set(edges or []) - {NULL_ID})
    index = SuffixIndex(spark, f"{shared_folder(spark)}/suffixes-{uuid.uuid4().hex}", kind, layout)
    for low, high in zip([None, *edges], [*edges, None]):
        batch = plain
        if low is not None:
            batch = batch.where(F.col("okey") > low)
        if high is not None:
            batch = batch.where(F.col("okey") <= high)
        index.add(batch, max(n_bytes // (len(edges) + 1), 1), last=high is None)
    noted = saved(index.noted())
    index.drop()
    return noted


def kept_bytes(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text",
    keep: tuple[str, ...] = (), as_text: bool = False, batches: int = BATCHES, strings: sk.Strings | None = None,
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary), and the columns ``keep`` of ``docs`` as ``_keep_*``.

    ``as_text``: ``kept`` is a string, without characters of which only some bytes stay.

    Null and empty texts have no bytes; matches never cross documents, and a
    text of any length is taken whole. Rows that repeat an id, with the same
    text or another, do not remove each other's bytes: only a smaller id does. A
    null id is greater than every other. An empty table gives no rows.
    """
    kind = strings or ByteStrings(length, gram)
    plain = keyed_texts(docs, id_col, text_col)
    n_bytes = sk.text_bytes(plain)
    layout = sk.Layout.of(plain, kind, n_bytes)
    asked = noted_places(plain, kind, layout, n_bytes, batches).union(sk.whole_copies(plain, layout))
    names = [f"_keep_{c}" for c in keep]
    texts = sk.pressed(keyed_texts(docs, id_col, text_col, keep), layout, names)
    schema = ", ".join([f"doc_id long, n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}", *(f"`_keep_{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)])

    def apply(table: pa.Table, raws: list[bytes], ranges: list[np.ndarray]) -> dict:
        kept, n_spans = [], []
        for raw, pairs in zip(raws, ranges):
            if len(pairs):
                gone = sk.covered(len(raw), pairs)
                n_spans.append(sum(1 for _ in sk.runs(gone)))
                raw = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            else:
                n_spans.append(0)
            kept.append(raw)
        n_bytes = np.fromiter(map(len, raws), np.int64, len(raws))
        return {
            "doc_id": sk.doc_ids(table),
            "n_bytes": pa.array(n_bytes),
            "n_removed": pa.array(n_bytes - np.fromiter(map(len, kept), np.int64, len(kept))),
            "n_spans": pa.array(n_spans, pa.int64()),
            "kept": pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary()),
            **{c: table.column(c) for c in names},
        }

    return sk.with_ranges(texts, sk.covered_ranges(texts, asked, kind, layout), apply, schema)


def kept_digest(kept: DataFrame) -> DataFrame:
    """``kept_bytes`` with the bytes as a digest."""
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def cleaned(docs: DataFrame, length: int = LENGTH, text_col: str = "text") -> DataFrame:
    """``docs`` with what earlier documents have removed from the texts, all columns kept.

    A character of which only some bytes are removed goes whole. Null texts
    stay null; documents of which nothing is left go, those without a text
    before stay. ``n_chars``, where there is one, follows the text.
    """
    others = tuple(c for c in docs.columns if c != text_col)
    mark = "is_null" + "_" * max(map(len, docs.columns))
    out = kept_bytes(docs.withColumn(mark, F.col(text_col).isNull()), length, text_col=text_col, keep=(*others, mark), as_text=True)
    out = out.where((F.col("n_removed") == 0) | (F.length(F.trim("kept")) > 0))
    new = {text_col: F.when(~F.col(f"_keep_{mark}"), F.col("kept"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col("_keep_n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*(new[c].alias(c) if c in new else F.col(f"_keep_{c}").alias(c) for c in docs.columns))
