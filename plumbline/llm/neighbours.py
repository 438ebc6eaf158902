"""Approximate nearest neighbours by collision counting.

Each of ``PROJECTIONS`` random directions gives every vector one number;
the numbers of a block of vectors are sorted. A query looks at a window
centred on its own number in each sorted array. A vector that lies in enough
windows has collided often enough to be verified by its exact inner product.
As long as too few have, all windows of the query grow by the same factor
(virtual rehashing: nothing is hashed anew).

Inner products become distances by one more component that gives every
vector the same length; a query has 0 there.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TOP = 20
PROJECTIONS = 128
#: Share of the windows that a vector must lie in to be verified.
COLLISIONS = 0.75
#: Half width of the first windows, for unit queries and vectors of length 1; and their growth.
FIRST_WIDTH, GROWTH = 1.2, 1.1
#: Collided vectors that end a query's search in a block, for each neighbour asked for; a share of the block in any case.
#: The last widening may bring more: those that collide most often are verified, ties included.
ENOUGH, ENOUGH_SHARE = 20, 0.12
#: Vectors of a block, and what a task holds of either side about.
BLOCK, GROUP_VECTORS, GROUP_QUERIES = 8192, 65_536, 8192
SEED = 7

FOUND = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>, dim, peak: the greatest component without sign): vectors that are not null, empty or zero and hold finite numbers only. Null ids are left out."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    return (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
        .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
        .where(F.coalesce(ok, F.lit(False)))
        .withColumn("dim", F.size("v"))
        .withColumn("peak", F.array_max(F.transform("v", F.abs)))
    )


class Block:
    """Sorted projections of a block of distinct vectors."""

    def __init__(self, unit: np.ndarray, vectors: np.ndarray, owners: list[np.ndarray], directions: np.ndarray):
        self.vectors, self.owners = vectors, owners
        numbers = unit @ directions
        order = np.argsort(numbers, axis=0, kind="stable")
        self.numbers = np.take_along_axis(numbers, order, 0).T.copy()
        # Of each vector its place in every sorted array.
        self.place = np.empty(order.T.shape, np.uint16)
        np.put_along_axis(self.place, order.T, np.arange(len(vectors), dtype=np.uint16)[None], 1)

    def candidates(self, at: np.ndarray, least: int, enough: int) -> list[np.ndarray]:
        """For each query (a row of ``at``) the vectors that collide with it most often, in ``least`` windows or more, after as many rehashings as ``enough`` of them take."""
        width, n = FIRST_WIDTH, len(self.vectors)
        found, pending = [np.zeros(0, np.int64)] * len(at), np.arange(len(at))
        while len(pending):
            low, high = (np.stack([row.searchsorted(x + side * width, how) for row, x in zip(self.numbers, at[pending].T)], 1).astype(np.uint16) for side, how in ((-1, "left"), (1, "right")))
            left = []
            for i, a, b in zip(pending.tolist(), low, high):
                # Places before the window wrap around to large ones.
                seen = ((self.place - a[:, None]) < (b - a)[:, None]).sum(0, dtype=np.uint8)
                hits = np.flatnonzero(seen >= least)
                # Windows that hold all numbers cannot grow.
                if len(hits) >= min(enough, n) or ((a == 0) & (b == n)).all():
                    if len(hits) > enough:
                        often = seen[hits]
                        hits = hits[often >= np.partition(often, len(hits) - enough)[len(hits) - enough]]
                    found[i] = hits
                else:
                    left.append(i)
            pending = np.array(left, np.int64)
            width *= GROWTH
        return found


def search_group(data: pd.DataFrame, queries: pd.DataFrame, top: int, peak: float) -> pd.DataFrame:
    """The ``top`` nearest of ``data`` for each query, of those found; ties to the smaller id, the query's own row left out.

    Projections are of vectors divided by ``peak`` (the greatest component of
    all), and of queries divided by their own, so that no square overflows.
    """
    if data.empty or queries.empty:
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
    data = data.sort_values("vec_id", kind="stable")
    x, ids = np.stack(data.v.to_numpy()).astype(np.float64), data.vec_id.to_numpy()
    q, query_ids = np.stack(queries.v.to_numpy()).astype(np.float64), queries.query_id.to_numpy()
    # Copies stand for each other: one vector is searched, its smallest ids answer.
    _, first, which = np.unique(x.view(np.dtype((np.void, x.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
    owners = np.split(ids[np.argsort(which, kind="stable")], np.cumsum(np.bincount(which))[:-1])
    owners = [o[: top + 1] for o in owners]
    x = x[first]
    scaled = x / peak
    squares = (scaled**2).sum(1)
    longest = np.sqrt(squares.max())
    lift = np.sqrt(np.maximum(longest**2 - squares, 0))
    directions = np.random.default_rng(SEED).standard_normal((x.shape[1] + 1, PROJECTIONS))
    unit = np.column_stack([scaled, lift]) / longest
    q_scaled = q / np.abs(q).max(1, keepdims=True)
    numbers = (q_scaled / np.sqrt((q_scaled**2).sum(1, keepdims=True))) @ directions[:-1]
    best: list[list[tuple[float, int]]] = [[] for _ in query_ids]
    least = int(np.ceil(COLLISIONS * PROJECTIONS))
    for at in range(0, len(x), BLOCK):
        block = Block(unit[at : at + BLOCK], x[at : at + BLOCK], owners[at : at + BLOCK], directions)
        enough = max(ENOUGH * (top + 1), int(ENOUGH_SHARE * len(block.vectors)))
        for i, (vector, query_id, found) in enumerate(zip(q, query_ids, block.candidates(numbers, least, enough))):
            # Summed row by row, so that equal vectors score equally wherever they stand.
            with np.errstate(over="ignore", invalid="ignore"):
                score = (block.vectors[found] * vector).sum(1)
            # Products beyond the range of numbers of either sign cancel to no number: the farthest.
            score = np.where(np.isnan(score), -np.inf, score)
            if len(found) > top + 1:
                bound = np.partition(score, len(score) - top - 1)[len(score) - top - 1]
                found, score = found[score >= bound], score[score >= bound]
            rows = [(-s, int(o)) for s, f in zip(score.tolist(), found.tolist()) for o in block.owners[f] if o != query_id]
            best[i] = sorted(best[i] + rows)[:top]
    return pd.DataFrame([(int(k), o, -s) for k, rows in zip(query_ids, best) for s, o in rows], columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


def nearest(vectors: DataFrame, queries: DataFrame, top: int = TOP, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``top`` nearest found by inner product, the nearest first.

    Both tables meet group by group: vectors are dealt into groups by id, each
    with its own sorted arrays, and queries in blocks visit every group.
    Vectors of another dimension than a query's are not compared with it.
    Rows that repeat a vec_id with the same vector count once; a query that
    repeats is answered once. Components may be of any finite size; products
    beyond the range of numbers score infinity. Null and zero vectors, and those
    with null or non-finite components, take no part; other columns are not read. An empty table gives no rows.
    """
    data, asked = (usable(df, id_col, vector_col).dropDuplicates(["vec_id", "v"]) for df in (vectors, queries))
    size = data.agg(F.count("*").alias("n"), F.max("peak").alias("peak")).first()
    n_queries = asked.count()
    groups, blocks = -(-size.n // GROUP_VECTORS) or 1, -(-n_queries // GROUP_QUERIES) or 1
    # Small tables are dealt finer, to use the tasks there are; ever more groups would only repeat the queries.
    groups, blocks = max(groups, min(4, size.n // 2000 or 1)), max(blocks, min(6, n_queries // 100 or 1))
    peak = float(size.peak or 1.0)

    def every(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = data.select("vec_id", "v", "dim", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("g"), every(blocks).alias("b"))
    right = asked.select(F.col("vec_id").alias("query_id"), "v", "dim", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int").alias("b"), every(groups).alias("g"))
    found = (
        left.groupBy("g", "b", "dim")
        .cogroup(right.groupBy("g", "b", "dim"))
        .applyInPandas(lambda a, b: search_group(a, b, top, peak), FOUND)
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top)
        .select("query_id", "rank", "vec_id", "score")
    )
