"""Best-fit packing planned on the histogram of piece lengths.

The planner sees counts by length (at most ``capacity`` of them), never
documents. It fills, longest first, the sequences with the least room that
still fits, and writes slots: ranges of ranks within a length and the
sequences and places they get. Pieces then take their slots by a join on
(length, rank), with ranks counted in salted parts of each length.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.bpe import batches_of_text, encoder, share_tokenizer
from plumbline.llm.rows import map_batches, saved, texts

CAPACITY = 4096
END_ID = 1
#: Pieces that one salt of a length holds about, when ranks are counted.
RANK_GROUP = 1_000_000
LEAST_SALTS = 64
#: Ranks that share a join key with the slots.
RANK_STEP = 64
#: Ranks of one slot row, so that no row spreads over too many join keys.
SLOT_RANKS = 1 << 22

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
SLOTS = "length long, rank_from long, rank_to long, per_sequence long, sequence_from long, offset_from long"


def plan_slots(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows of ``SLOTS``.

    All sequences with equal room are alike, so they are kept as ranges of
    sequence numbers by room. The r-th piece of a row goes to sequence
    ``sequence_from + r // per_sequence``, at ``offset_from + r % per_sequence * length``.
    """
    rooms: list[int] = []
    ranges: dict[int, list[tuple[int, int]]] = defaultdict(list)
    slots, next_sequence = [], 0

    def put(room: int, first: int, count: int) -> None:
        if room and count:
            if not ranges[room]:
                bisect.insort(rooms, room)
            last = ranges[room][-1] if ranges[room] else None
            if last and last[0] + last[1] == first:
                ranges[room][-1] = (last[0], last[1] + count)
            else:
                ranges[room].append((first, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, count = ranges[room].pop()
                if not ranges[room]:
                    rooms.pop(at)
            else:
                room = capacity
                first, count = next_sequence, -(-left // (capacity // length))
                next_sequence += count
            per = room // length
            full = min(count, left // per)
            used = full * per
            if full:
                slots.append((length, rank, rank + used, per, first, capacity - room))
                put(room - per * length, first, full)
            rest = count - full
            if rest and used < left:
                some = min(left - used, per)
                slots.append((length, rank + used, rank + used + some, per, first + full, capacity - room))
                put(room - some * length, first + full, 1)
                used += some
                full += 1
                rest -= 1
            put(room, first + full, rest)
            rank += used
            left -= used
    return slots


def pieces_of(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``PIECES``: each document's ids and ``end_id``, cut only beyond ``capacity``. Empty and null texts: the end id alone."""
    spec = share_tokenizer(docs.sparkSession, path)

    def make():
        bpe, end, width = encoder(spec.value), end_id.to_bytes(4, "little"), 4 * capacity

        def step(batch):
            for ids, values in batches_of_text(batch):
                rows = []
                for doc_id, raw in zip(ids, bpe.encode(values)):
                    raw += end
                    rows += [
                        (doc_id, i, at // 4, len(part := raw[at : at + width]) // 4, zlib.crc32(part))
                        for i, at in enumerate(range(0, len(raw), width))
                    ]
                doc_id, piece, start, length, crc = zip(*rows)
                yield {
                    "doc_id": pa.array(doc_id, pa.int64()),
                    "piece": pa.array(piece, pa.int32()),
                    "start": pa.array(start, pa.int64()),
                    "length": pa.array(length, pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64()),
                }

        return step

    return map_batches(texts(docs, id_col, text_col), make, PIECES)


def ranked(pieces: DataFrame, salts: int) -> DataFrame:
    """``pieces`` with ``rank`` within the length, from 0 and gapless, counted in ``salts`` parts of each length."""
    keys = ["doc_id", "piece", "start", "ids_crc32"]
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64(*keys), F.lit(salts)))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("length", "salt").orderBy(*keys)).cast("long") - 1
    return (
        salted.withColumn("inside", inside)
        .join(counts.select("length", "salt", before.alias("before")), ["length", "salt"])
        .withColumn("rank", F.col("before") + F.col("inside"))
        .drop("salt", "inside", "before")
    )


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all documents into few sequences of at most ``capacity`` tokens.

    One row a piece: ``PIECES`` plus ``sequence_id`` and ``offset``. Rows that
    repeat are packed each; null ids are packed and stay null; an empty table
    gives no rows. The encoded pieces (numbers only) are written once, since
    the histogram and the slots both need them.
    """
    pieces = saved(pieces_of(docs, capacity, path, end_id, id_col, text_col))
    # At most `capacity` rows reach the driver: one a length.
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    spark, total = docs.sparkSession, sum(histogram.values())
    rows = []
    for length, first, last, per, sequence, offset in plan_slots(histogram, capacity):
        step = max(1, SLOT_RANKS // per) * per
        rows += [(length, a, min(a + step, last), per, sequence + (a - first) // per, offset) for a in range(first, last, step)]
    planned = spark.createDataFrame(pd.DataFrame(rows, columns=[c.split()[0] for c in SLOTS.split(", ")]), SLOTS) if rows else spark.createDataFrame([], SLOTS)
    slots = planned.withColumn("part", F.explode(F.sequence(F.expr(f"rank_from div {RANK_STEP}"), F.expr(f"(rank_to - 1) div {RANK_STEP}"))))
    placed = ranked(pieces, max(LEAST_SALTS, total // RANK_GROUP)).withColumn("part", F.expr(f"rank div {RANK_STEP}")).alias("p").join(
        slots.alias("s"),
        (F.col("p.length") == F.col("s.length")) & (F.col("p.part") == F.col("s.part")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")),
    )
    place = F.col("rank") - F.col("rank_from")
    return placed.select(
        "doc_id",
        "piece",
        "start",
        F.col("p.length").alias("length"),
        "ids_crc32",
        (F.col("sequence_from") + F.floor(place / F.col("per_sequence"))).cast("long").alias("sequence_id"),
        (F.col("offset_from") + F.pmod(place, F.col("per_sequence")) * F.col("p.length")).cast("long").alias("offset"),
    )
