"""Repair of conversations whose turns are missing, repeated, empty, cut short or of the wrong role.

A conversation's role initials should read (s?(ua)+)?. Turns are kept, given
another role or deleted, and empty turns inserted, at the least cost. The
plan is a dynamic program over the turns that stay: from the last turn to the
first, running minima per role hold the cheapest way on, less the deletions
before it (a prefix sum), and the roles of neighbours that stay say how many
turns go between them. Of plans that cost the same, the one whose audit (the
edits' initials in order) comes first in ASCII is taken.

Plans are made from a few bytes a turn; the texts then stream past them in
order, so that no task holds a conversation's texts.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.rows import arrow_batch

#: Costs of the edits, and of leaving a truncated turn in.
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
#: Turns to insert between two that stay (or the start "" and the end "$"); other pairs cannot follow each other.
BETWEEN = {
    ("", "s"): 0, ("", "u"): 0, ("", "a"): 1, ("", "$"): 0,
    ("s", "u"): 0, ("s", "a"): 1, ("s", "$"): 2,
    ("u", "a"): 0, ("u", "u"): 1, ("u", "$"): 1,
    ("a", "u"): 0, ("a", "a"): 1, ("a", "$"): 0,
}
LEGAL = ("su", "ua", "au")
ROLES = "sua$"
NAMES = {"u": "user", "a": "assistant"}

SPACES = " \t\n\x0b\x0c\r"
FAULTS = ("gaps", "blank", "duplicate", "truncated", "illegal")
REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
#: Rows and bytes of text that leave a task together.
OUT_ROWS, OUT_BYTES = 10_000, 4_000_000


def cheapest(turns: list[tuple[str, bool, bool]]) -> tuple[int, str]:
    """Cost and audit of the best plan for turns of (role initial, must go, truncated)."""
    n = len(turns)
    best: dict[str, tuple[int, int]] = {}  # by role: prefix sum of deletions + price + what follows, and the turn
    ways = {role: array("q", bytes(8 * n)) for role in "sua"}  # by role that stays at a turn: the next one that stays, and its role

    def way_on(role: str, place: int) -> tuple[int, int]:
        """The cheapest way on from a turn that stays before ``place``; ties by the later next turn, then more inserts, then a kept one."""
        inserts = BETWEEN[role, "$"]
        found = (DELETE * (n - place) + INSERT * inserts, -n, -inserts, False, "$")
        for then, (price, at) in best.items():
            if (role, then) in BETWEEN:
                inserts = BETWEEN[role, then]
                found = min(found, (price - DELETE * place + INSERT * inserts, -at, -inserts, turns[at][0] != then, then))
        return found[0], -found[1] * 4 + ROLES.index(found[4])

    for i in range(n - 1, -1, -1):
        initial, must_go, truncated = turns[i]
        if must_go:
            continue
        prices = {role: TRUNCATED * truncated + REROLE * (initial != role) for role in "sua" if role == initial or role in NAMES}
        follows = {role: way_on(role, i + 1) for role in prices}
        for role, price in prices.items():
            ways[role][i] = follows[role][1]
            price += DELETE * i + follows[role][0]
            # From the last turn to the first: an equal price keeps the later turn.
            if role not in best or price < best[role][0]:
                best[role] = (price, i)
    cost, way = way_on("", 0)
    audit, role, at = [], "", -1
    while True:
        then, place = ROLES[way % 4], way // 4
        audit.append("D" * (place - at - 1) + "I" * BETWEEN[role, then])
        if then == "$":
            return cost, "".join(audit)
        audit.append("K" if turns[place][0] == then else "R")
        role, at, way = then, place, ways[then][place]


def text_end(text: Column) -> Column:
    """The last character that is no space; empty for a blank text."""
    return F.right(F.rtrim(text, F.lit(SPACES)), F.lit(1))


def turn_key(role: Column, text: Column) -> Column:
    """Equal for equal role and text."""
    return F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))


def _plain(rows: DataFrame) -> DataFrame:
    """The operator's columns alone; a null role or text is one space, a row marked ``lost`` only names its conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    lost = F.col("lost") if "lost" in rows.columns else F.lit(False)
    plain = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), lost.alias("lost"))
    return plain.withColumn("key", turn_key(F.col("role"), F.col("text")))


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def _batches(rows: Iterable[tuple], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """``rows`` in batches; the length of each row's last column counts."""
    kept, size = [], 0

    def batch():
        return arrow_batch({name: pa.array(column, kind) for name, kind, column in zip(names, types, zip(*kept))})

    for row in rows:
        kept.append(row)
        size += len(row[-1] or "")
        if len(kept) >= OUT_ROWS or size >= OUT_BYTES:
            yield batch()
            kept, size = [], 0
    if kept:
        yield batch()


def _report(conv_id: int | None, rows: Iterator[tuple]) -> tuple:
    """One conversation's row of ``REPORT``, from its turns in order."""
    turns, seen, counts = [], set(), dict.fromkeys(FAULTS, 0)
    numbers, low, last, before = 0, None, None, None
    for _, turn, key, initial, end, lost in rows:
        if lost:
            continue
        if turn is not None and turn != last:
            numbers, last = numbers + 1, turn
            low = turn if low is None else low
        fault = "blank" if not end else "duplicate" if key in seen else "truncated" if end not in ".!?" else None
        if fault:
            counts[fault] += 1
        seen.add(key)
        counts["illegal"] += before is not None and before + initial not in LEGAL
        before = initial
        turns.append((initial, fault in ("blank", "duplicate"), fault == "truncated"))
    counts["gaps"] = last - low + 1 - numbers if numbers else 0
    return (conv_id, *(counts[f] for f in FAULTS), *cheapest(turns))


def audited(rows: DataFrame) -> DataFrame:
    """``REPORT`` of every conversation in ``rows`` (conv_id, turn, role, text).

    Turns go by number, nulls first, rows of one number by the digest of role
    and text. A null role or text is one space, so the turn is blank or its
    role illegal; a null conv_id is a conversation like others; an empty role
    has no initial and is never kept. Rows that repeat are duplicates. A
    conversation whose rows are all marked ``lost`` has zeros. An empty table
    has no report. A conversation goes through one task, which keeps a few
    bytes and a key a turn.
    """
    codes = _plain(rows).select("conv_id", "turn", "key", F.left("role", F.lit(1)).alias("initial"), text_end(F.col("text")).alias("end"), "lost")

    def run(batches):
        found = (_report(conv_id, own) for conv_id, own in groupby(_rows(batches), key=lambda r: r[0]))
        yield from _batches(found, [c.split()[0] for c in REPORT.split(", ")], [*[pa.int64()] * 7, pa.string()])

    return codes.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "key").mapInArrow(run, REPORT)


def _stream(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """Each conversation's report and then its turns in order, in one partition; no turn for a lost row."""
    turns = _plain(rows).where("not lost").select("conv_id", F.lit(True).alias("is_turn"), "turn", "key", "role", "text", F.lit(None).cast("struct<gaps:long,blank:long,duplicate:long,truncated:long,illegal:long,cost:long,audit:string>").alias("report"))
    heads = reports.select("conv_id", F.lit(False).alias("is_turn"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("key"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.struct(*FAULTS, "cost", "audit").alias("report"))
    return heads.unionByName(turns).repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "is_turn", F.asc_nulls_first("turn"), "key")


def _replayed(audit: str, turns: Iterator[tuple]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the turns that an audit leaves."""
    last = ""
    for edit in audit:
        _, _, _, _, role, text, _ = (None,) * 7 if edit == "I" else next(turns)
        if edit == "D":
            continue
        if edit in "RI":
            role, text = NAMES["a" if last == "u" else "u"], text or ""
        last = role[:1]
        yield edit, role, text


def repaired(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text) of the repaired conversations, ``place`` from 0; edit K, R or I. Rows and reports as in ``audited``."""

    def run(batches):
        def made():
            for conv_id, own in groupby(_rows(batches), key=lambda r: r[0]):
                for place, (edit, role, text) in enumerate(_replayed(next(own)[6]["audit"], own)):
                    yield conv_id, place, edit, role, text

        yield from _batches(made(), ["conv_id", "place", "edit", "role", "text"], [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()])

    return _stream(rows, reports).mapInArrow(run, "conv_id long, place long, edit string, role string, text string")


def repair_digests(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """``reports`` with ``repaired_sha256``: of the repaired turns as role:text, joined by newlines."""

    def run(batches):
        def made():
            for conv_id, own in groupby(_rows(batches), key=lambda r: r[0]):
                report, digest, between = next(own)[6], hashlib.sha256(), ""
                for _, role, text in _replayed(report["audit"], own):
                    digest.update(f"{between}{role}:{text}".encode())
                    between = "\n"
                yield conv_id, *(report[f] for f in FAULTS), report["cost"], report["audit"], digest.hexdigest()

        yield from _batches(made(), [*(c.split()[0] for c in REPORT.split(", ")), "repaired_sha256"], [*[pa.int64()] * 7, pa.string(), pa.string()])

    return _stream(rows, reports).mapInArrow(run, f"{REPORT}, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` with faults put in by a checksum of ``conv_id:turn`` (nulls: one space): a fifth of all turns has one.

    Columns conv_id, turn, role, text, and ``lost`` on rows that are dropped.
    """
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("long").cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    kind = F.crc32(name) % 20
    hurt = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (kind == 0).alias("lost"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return hurt.drop("copy")
