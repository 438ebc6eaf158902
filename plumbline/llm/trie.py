"""Conversations as succinct tries of their turns, and what every shared prefix saves.

A turn is a label (a digest of its role and text) and a number of characters.
Conversations with equal turns are one sequence with a count. Prefixes of very
many sequences are the heavy upper levels: they are found level by level, and
what lies below them falls into subtrees of bounded size, which are dealt into
shards. A task builds a shard's trie breadth first in numpy: a LOUDS bitvector
(for each node a one for every child, then a zero) and arrays of labels. Rows
of nodes are read off such tries: parents from the bits, and rollups by adding
each level to the one above, from the deepest up. Heavy levels merge last, by
sums over each heavy node's ancestors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.rows import arrow_batch, saved

LABEL = 16
#: Conversations that share an opening: ids of one such number of hundreds, with at most this many turns of the first.
FAMILY, MOST_SHARED = 100, 6
#: A prefix of more distinct sequences than this is heavy.
MOST_BELOW = 4096
#: Levels that are looked at in one pass for heavy prefixes.
LEVELS = 4
#: Turns that a shard holds about.
SHARD_TURNS = 100_000
#: Ids whose members are listed together, and rows that are broadcast at most.
ID_BLOCK, MOST_BROADCAST = 4096, 100_000

TRIE = "shard int, nodes int, louds binary, labels binary, depths binary, chars binary, ends binary, firsts binary, tops array<struct<parent:binary,label:binary>>, sequences array<string>"
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, heavy_parent binary, sequence string"


def turn_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, label and chars (code points of the text) of each row; a null role or text is empty, rows without a conv_id take no part."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    label = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * LABEL)
    known = conversations.where("conv_id is not null")
    return known.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), label.alias("label"), F.length(text).alias("chars"))


def shared_turns(conv_id: Column) -> Column:
    """How many opening turns a conversation takes from its family's first."""
    return (F.crc32(conv_id.cast("string")) % MOST_SHARED).cast("int")


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id, labels (their bytes one after the other) and chars of every conversation, in order of turns, nulls first; rows of one turn by label.

    A conversation is one row: some twenty bytes a turn, without its texts.
    """
    ordered = F.sort_array(F.collect_list(F.struct("turn", "label", "chars")))
    rows = turns.groupBy("conv_id").agg(ordered.alias("t"))
    return rows.select("conv_id", F.unhex(F.array_join(F.transform("t", lambda t: t["label"]), "")).alias("labels"), F.transform("t", lambda t: t["chars"]).alias("chars"))


def rebuilt(own: DataFrame) -> DataFrame:
    """Sequences whose first ``shared_turns`` are those of the first conversation of their family (fewer if it is shorter, none if there is none)."""
    h = shared_turns(F.col("conv_id"))
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    heads = own.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("_family"), F.substring("labels", 1, LABEL * MOST_SHARED).alias("_labels"), F.slice("chars", 1, MOST_SHARED).alias("_chars"))
    both = own.withColumn("_family", family).withColumn("_h", h).join(heads, "_family", "left")
    # substring and slice of nothing are empty, past the end as well.
    labels = F.concat(F.coalesce(F.substring("_labels", F.lit(1), F.col("_h") * LABEL), F.lit(b"")), F.substring("labels", F.col("_h") * LABEL + 1, F.length("labels")))
    chars = F.concat(F.coalesce(F.slice("_chars", F.lit(1), F.col("_h")), F.array().cast("array<int>")), F.slice("chars", F.col("_h") + 1, F.greatest(F.size("chars"), F.lit(1))))
    return both.select("conv_id", labels.alias("labels"), chars.alias("chars"))


def _distinct(paths: DataFrame, id_block: int) -> tuple[DataFrame, DataFrame]:
    """Listed members of equal sequences by block of ids, and the distinct sequences: sequence, n, first, labels, chars, and the members' digest where one block has them all."""
    keyed = paths.withColumn("sequence", F.sha2("labels", 256)).withColumn("block", F.expr(f"conv_id div {id_block}"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    parts = saved(keyed.groupBy("sequence", "block").agg(F.count("*").alias("n"), F.min("conv_id").alias("first"), listed.alias("members"), F.first("labels").alias("labels"), F.first("chars").alias("chars")))
    one = F.when(F.count("*") == 1, F.sha2(F.first("members").cast("binary"), 256))
    distinct = parts.groupBy("sequence").agg(F.sum("n").alias("n"), F.min("first").alias("first"), one.alias("ends_sha256"), F.first("labels").alias("labels"), F.first("chars").alias("chars"))
    return parts, saved(distinct)


def _prefixes(active: DataFrame, levels: int) -> DataFrame:
    """``active`` with keys of the next prefixes, each a digest of the last one and a label, as an array."""
    length, key, keys = F.length("labels") / LABEL, F.element_at("path", -1), []
    for i in range(1, levels + 1):
        label = F.substring("labels", (F.size("path") - 2 + i) * LABEL + 1, F.lit(LABEL))
        key = F.when(F.size("path") - 1 + i <= length, F.unhex(F.substring(F.sha2(F.concat(key, label), 256), 1, 2 * LABEL)))
        keys.append(key)
    return active.withColumn("next", F.filter(F.array(*keys), lambda k: k.isNotNull()))


def _small(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast if it has few rows; it should be written."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def _split(distinct: DataFrame, most_below: int, levels: int) -> tuple[DataFrame, DataFrame]:
    """The sequences with ``path``, the keys of their heavy prefixes from the root on, and the heavy prefixes: key, path, chars of their last turn."""
    spark = distinct.sparkSession
    root = spark.range(1).select(F.lit(b"").alias("key"), F.array(F.lit(b"")).alias("path"), F.lit(0).alias("chars"))
    active, settled, heavy = distinct.withColumn("path", F.array(F.lit(b""))), [], [root]
    while True:
        ahead = _prefixes(active, levels)
        rows = ahead.select("sequence", F.posexplode("next").alias("ahead", "key"))
        counts = rows.groupBy("key").agg(F.count("*").alias("below"), F.min("sequence").alias("sequence"), F.min("ahead").alias("ahead"))
        found = saved(counts.where(F.col("below") > most_below).select("key", "sequence", "ahead"))
        if found.isEmpty():
            return _union([*settled, active]), _union(heavy)
        few = _small(found)
        paths = few.join(ahead, "sequence").select("key", F.concat("path", F.slice("next", F.lit(1), F.col("ahead") + 1)).alias("path"), "chars")
        heavy.append(saved(paths.select("key", "path", F.element_at("chars", F.size("path") - 1).alias("chars"))))
        deepest = rows.join(few.select("key"), "key").groupBy("sequence").agg((F.max("ahead") + 1).cast("int").alias("deeper"))
        grown = ahead.join(deepest, "sequence", "left").withColumn("deeper", F.coalesce("deeper", F.lit(0)))
        grown = saved(grown.withColumn("path", F.concat("path", F.slice("next", F.lit(1), F.col("deeper")))).drop("next"))
        settled.append(grown.where(F.col("deeper") < levels).drop("deeper"))
        active = grown.where(F.col("deeper") == levels).drop("deeper")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def build(table: pa.Table) -> dict:
    """The trie of a shard's sequences below their heavy prefixes, as one row's columns of ``TRIE``; node 0 is above them all."""
    column = {name: table.column(name).to_pylist() for name in ("sequence", "rest", "n", "first", "at", "parent")}
    sizes = np.array([len(r) // LABEL for r in column["rest"]])
    labels, label = np.unique(np.frombuffer(b"".join(column["rest"]), ">u8").reshape(-1, 2), axis=0, return_inverse=True)
    label = label.ravel()
    chars = np.concatenate([np.asarray(c, np.int32) for c in table.column("chars").to_pylist()])
    starts = np.cumsum(sizes) - sizes
    places = {p: i for i, p in enumerate(dict.fromkeys(column["parent"]))}
    node = np.array([places[p] for p in column["parent"]], np.int64)
    at, n, first = (np.array(column[c], np.int64) for c in ("at", "n", "first"))
    which, below, level = np.arange(len(sizes)), 0, 0
    children, node_label, node_chars, depths, ends, firsts, sequences_at = [], [], [], [np.zeros(1, np.int32)], [np.zeros(1, np.int64)], [np.full(1, np.iinfo(np.int64).max)], [None]
    while len(which):
        # Above the first level all is one node; subtrees of different heavy prefixes stay apart by the code.
        code = node[which] * len(labels) + label[starts[which] + level]
        _, lead, new = np.unique(code, return_index=True, return_inverse=True)
        above = np.zeros(len(lead), np.int64) if level == 0 else node[which[lead]]
        children.append(np.bincount(above - below, minlength=1 if level == 0 else size))
        below, size = (1, len(lead)) if level == 0 else (below + size, len(lead))
        node[which] = below + new
        of = which[lead]
        node_label.append(label[starts[of] + level])
        node_chars.append(chars[starts[of] + level])
        depths.append((at[of] + level + 1).astype(np.int32))
        end = sizes[which] == level + 1
        # Sequences are distinct: at most one ends at a node.
        here, done = new[end], which[end]
        n_here, first_here, seq_here = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max), [None] * size
        n_here[here], first_here[here] = n[done], first[done]
        for i, s in zip(here.tolist(), done.tolist()):
            seq_here[i] = column["sequence"][s]
        ends.append(n_here)
        firsts.append(first_here)
        sequences_at += seq_here
        if level == 0:
            tops = [{"parent": column["parent"][i], "label": labels[label[starts[i]]].astype(">u8").tobytes()} for i in of.tolist()]
        which, level = which[~end], level + 1
    children.append(np.zeros(size, np.int64))
    degree = np.concatenate(children)
    bits = np.ones(degree.sum() + len(degree), np.uint8)
    bits[np.cumsum(degree) + np.arange(len(degree))] = 0
    return {
        "shard": table.column("shard")[0].as_py(), "nodes": len(degree), "louds": np.packbits(bits).tobytes(), "labels": labels[np.concatenate(node_label)].astype(">u8").tobytes(),
        "depths": np.concatenate(depths).astype("<i4").tobytes(), "chars": np.concatenate([[0], *node_chars]).astype("<i4").tobytes(), "ends": np.concatenate(ends).astype("<i8").tobytes(),
        "firsts": np.concatenate(firsts).astype("<i8").tobytes(), "tops": tops, "sequences": sequences_at,
    }


def shape(louds: bytes, nodes: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Parent and number of children of each node of a LOUDS bitvector, and where each level starts and the last ends. Node 0 is its own parent."""
    bits = np.unpackbits(np.frombuffer(louds, np.uint8), count=2 * nodes - 1)
    zeros = np.flatnonzero(bits == 0)
    degree = np.diff(zeros, prepend=-1) - 1
    # The i-th one is node i, in the block of its parent: as many zeros come before it.
    parent = np.concatenate([[0], np.repeat(np.arange(nodes), degree)])
    until, levels = np.cumsum(degree), [0, 1]
    while levels[-1] < nodes:
        levels.append(int(until[levels[-1] - 1]) + 1)
    return parent, degree, levels


def rolled_up(row: dict) -> dict:
    """Columns of ``NODES`` for the nodes of one trie, its node 0 left out; node 0's children have ``heavy_parent`` in place of a parent."""
    parent, degree, levels = shape(row["louds"], row["nodes"])
    chars, depth = (np.frombuffer(row[c], "<i4").astype(np.int64) for c in ("chars", "depths"))
    n, first = (np.frombuffer(row[c], "<i8").copy() for c in ("ends", "firsts"))
    leaves, saved_tokens = (degree == 0).astype(np.int64), np.zeros(row["nodes"], np.int64)
    for a, b in zip(levels[-2:0:-1], levels[:0:-1]):
        # All below these nodes is added already.
        saved_tokens[a:b] += (n[a:b] - 1) * chars[a:b]
        for sums in (n, leaves, saved_tokens):
            np.add.at(sums, parent[a:b], sums[a:b])
        np.minimum.at(first, parent[a:b], first[a:b])
    top = levels[2] - 1 if len(levels) > 2 else 0
    return {
        "conv_id": first[1:], "depth": depth[1:], "parent_conv_id": pa.array([None] * top + first[parent[1 + top :]].tolist(), pa.int64()), "n_convs": n[1:], "n_children": degree[1:].astype(np.int64),
        "n_leaves": leaves[1:], "saved_tokens": saved_tokens[1:], "heavy_parent": pa.array([t["parent"] for t in row["tops"]] + [None] * (row["nodes"] - 1 - top), pa.binary()), "sequence": pa.array(row["sequences"][1:], pa.string()),
    }


def tries(split: DataFrame, shards: int) -> DataFrame:
    """``TRIE`` rows of the parts of sequences below their heavy prefixes, whole subtrees together, dealt into ``shards``."""
    depth = F.size("path") - 1
    below = split.where(F.length("labels") > depth * LABEL).select(
        "sequence", "n", "first", depth.cast("long").alias("at"), F.element_at("path", -1).alias("parent"),
        F.substring("labels", depth * LABEL + 1, F.length("labels")).alias("rest"), F.slice("chars", depth + 1, F.greatest(F.size("chars"), F.lit(1))).alias("chars"),
    )
    dealt = below.withColumn("shard", F.pmod(F.xxhash64("parent", F.substring("rest", 1, LABEL)), F.lit(shards)).cast("int"))

    def make(table: pa.Table) -> pa.Table:
        row = build(table)
        return pa.Table.from_pylist([row], schema=_arrow_schema())

    return dealt.groupBy("shard").applyInArrow(make, TRIE)


def _arrow_schema() -> pa.Schema:
    kinds = {"int": pa.int32(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}
    top = pa.list_(pa.struct([("parent", pa.binary()), ("label", pa.binary())]))
    return pa.schema([(name, kinds.get(kind, top)) for name, kind in (c.split(" ") for c in TRIE.split(", "))])


def _light_nodes(built: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield arrow_batch(rolled_up(row))

    return built.mapInArrow(run, NODES)


def _heavy_nodes(heavy: DataFrame, split: DataFrame, light: DataFrame) -> DataFrame:
    """Nodes of the heavy levels, from the subtrees that hang on them and the sequences that end at them, with ``key``."""
    tops = light.where("heavy_parent is not null").groupBy(F.col("heavy_parent").alias("key")).agg(F.sum("n_convs").alias("n"), F.min("conv_id").alias("first"), F.count("*").alias("tops"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    ended = split.where(F.length("labels") == (F.size("path") - 1) * LABEL).select(F.element_at("path", -1).alias("key"), F.col("n").alias("own_n"), F.col("first").alias("own_first"), "sequence")
    joined = saved(heavy.join(tops, "key", "left").join(ended, "key", "left"))
    zero = F.lit(0).cast("long")
    added = joined.select(F.explode("path").alias("key"), (F.coalesce("n", zero) + F.coalesce("own_n", zero)).alias("n"), F.least("first", "own_first").alias("first"), F.coalesce("leaves", zero).alias("leaves"), F.coalesce("saved", zero).alias("saved"))
    sums = saved(added.groupBy("key").agg(F.sum("n").alias("n_convs"), F.min("first").alias("conv_id"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved_below")))
    own = joined.select("key", "path", "chars", "sequence", F.coalesce("tops", zero).alias("tops"), F.get("path", F.size("path") - 2).alias("above")).join(sums, "key")
    spared = own.select(F.explode("path").alias("key"), ((F.col("n_convs") - 1) * F.col("chars")).alias("spared")).groupBy("key").agg(F.sum("spared").alias("spared"))
    inner = own.where("above is not null").groupBy(F.col("above").alias("key")).agg(F.count("*").alias("inner"))
    above = sums.select(F.col("key").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    children = F.col("tops") + F.coalesce("inner", zero)
    return own.join(spared, "key").join(inner, "key", "left").join(above, "above", "left").select(
        "key", "conv_id", (F.size("path") - 1).cast("long").alias("depth"), "parent_conv_id", "n_convs", children.alias("n_children"),
        F.when(children == 0, F.lit(1).cast("long")).otherwise(F.col("leaves")).alias("n_leaves"), (F.col("saved_below") + F.col("spared")).alias("saved_tokens"), "sequence",
    )


def _long_lists(parts: DataFrame, distinct: DataFrame) -> DataFrame:
    """Digests of members that several blocks of ids list: blocks stream past in order, so that no list is held whole."""
    spread = _small(saved(distinct.where("ends_sha256 is null").select("sequence")))
    rows = parts.select("sequence", "block", "members").join(spread, "sequence").repartition("sequence").sortWithinPartitions("sequence", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        for sequence, own in groupby(flat, key=lambda r: r[0]):
            digest = hashlib.sha256(next(own)[2].encode())
            for _, _, members in own:
                digest.update(b"," + members.encode())
            yield arrow_batch({"sequence": [sequence], "long_sha256": [digest.hexdigest()]})

    return rows.mapInArrow(run, "sequence string, long_sha256 string")


def prefix_nodes(paths: DataFrame, most_below: int = MOST_BELOW, levels: int = LEVELS, shard_turns: int = SHARD_TURNS, id_block: int = ID_BLOCK) -> DataFrame:
    """Every distinct prefix of ``paths`` (conv_id, labels, chars; one row a conversation) as a node.

    conv_id (smallest member), depth, parent_conv_id (null at the root),
    n_convs, n_children, n_leaves, saved_tokens (characters that members after
    the first repeat, over the subtree), ends_sha256 (of the ascending ids,
    comma-joined, of the members that end here). A conversation without turns
    is a member of the root. No conversations, no nodes.
    """
    parts, distinct = _distinct(paths, id_block)
    split, heavy = _split(distinct, most_below, levels)
    turns = distinct.agg(F.sum(F.length("labels")).alias("n")).first().n
    if turns is None:
        heavy = heavy.limit(0)
    shards = max(1, -(-(turns or 0) // (LABEL * shard_turns)))
    light = saved(_light_nodes(tries(split, shards)))
    upper = saved(_heavy_nodes(heavy, split, light))
    parents = _small(upper.select(F.col("key").alias("heavy_parent"), F.col("conv_id").alias("_parent")))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "sequence"]
    tops = light.where("heavy_parent is not null").join(parents, "heavy_parent").withColumn("parent_conv_id", F.col("_parent"))
    nodes = light.where("heavy_parent is null").select(columns).unionByName(tops.select(columns)).unionByName(upper.select(columns))
    digests = distinct.select("sequence", "ends_sha256").join(_long_lists(parts, distinct), "sequence", "left").select("sequence", F.coalesce("ends_sha256", "long_sha256").alias("ends_sha256"))
    # Nodes where nothing ends have no key, and would all meet in one task.
    ending = nodes.where("sequence is not null").join(digests, "sequence").select(*columns[:-1], "ends_sha256")
    return ending.unionByName(nodes.where("sequence is null").select(*columns[:-1], F.sha2(F.lit(b""), 256).alias("ends_sha256")))


def shared_prefixes(conversations: DataFrame, **options) -> DataFrame:
    """``prefix_nodes`` of ``conversations`` (conv_id, turn, role, text) rebuilt with their families' openings.

    Turns go by number, nulls first, rows of one number by digest; a null role
    or text is empty, so repeated rows are turns of their own; rows without a
    conv_id take no part; an empty table has no nodes.
    """
    return prefix_nodes(rebuilt(sequences(turn_rows(conversations))), **options)
