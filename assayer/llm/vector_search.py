"""Exact nearest neighbours by a block matrix join.

Vectors are dealt to blocks of at most TILE; every block of queries meets every block of candidates in one tile. A tile multiplies int8 codes; each vector x is scale * code + e with |e| <= scale / 2 in every component, which bounds the error of a product by

    |q.x - sq sx (cq.cx)| <= sq/2 * sum|x| + sx/2 * sum|q| + dim * sq * sx / 4

Pairs whose upper bound falls below the k-th largest lower bound of their query in the tile cannot be among its k nearest; the rest are recomputed in double precision, component by component in order, and a heap keeps k. The tiles' lists of a query are merged by a heap.

Vectors that are null, zero, of another length than most, or that hold null or non-finite components take no part, neither as queries nor as candidates; nor do rows without an id. Ties go to the smaller vec_id. Rows that repeat an id and vector count once. An empty table gives no row. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vectors in a block.
TILE = 4096
#: Queries whose products are held at once: TILE * ROWS floats.
ROWS = 256


def codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and sums of magnitudes of the rows."""
    scale = np.abs(x).max(axis=1) / 127
    return np.rint(x / scale[:, None]).astype(np.int8), scale, np.abs(x).sum(axis=1)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, summed in the order of the components."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


def nearest(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query, id, score) of the k nearest of each query among one block's vectors, its own row left out."""
    dim, out = queries.shape[1], []
    cx, sx, mx = codes(vectors)
    cq, sq, mq = codes(queries)
    exact = np.float32 if dim * 127 * 127 < 1 << 24 else np.float64  # sums of int8 products are whole numbers that this type holds exactly
    tx = cx.astype(exact).T
    for at in range(0, len(queries), ROWS):
        q = slice(at, at + ROWS)
        product = (cq[q].astype(exact) @ tx) * (sq[q, None] * sx)
        bound = (sq[q, None] * mx + sx * mq[q, None]) / 2 + dim * sq[q, None] * sx / 4
        bound += 1e-9 * (np.abs(product) + bound)  # what floating point adds
        low, high = product - bound, product + bound
        own = query_ids[q, None] == ids
        low[own] = high[own] = -np.inf
        kth = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(low), -np.inf)
        r, c = np.nonzero((high >= kth[:, None]) & ~own)
        score = np.concatenate([inner(queries[q][r[i : i + 65536]], vectors[c[i : i + 65536]]) for i in range(0, len(r), 65536)] or [np.zeros(0)])
        for row, lo, hi in zip(range(len(low)), np.searchsorted(r, np.arange(len(low))), np.searchsorted(r, np.arange(len(low)), "right"), strict=True):
            best = heapq.nsmallest(k, zip((-score[lo:hi]).tolist(), ids[c[lo:hi]].tolist(), strict=True))
            out += [(int(query_ids[q][row]), i, -s) for s, i in best]
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """id, v of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    rows = rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).select("n")
    return rows.join(F.broadcast(size), F.size("v") == F.col("n")).select("id", "v")


def search(vectors: DataFrame, is_query: Callable[[Column], Column], k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row of vectors(vec_id, embedding) whose id is_query picks, by inner product.

    The work is queries times candidates, in tiles: blocks of queries are copied to each block of candidates and the other way round, each tile of at most TILE by TILE vectors in a task of its own group, so neither side is broadcast and a task's memory is bounded.
    """
    rows = usable(vectors)
    asked = rows.where(is_query(F.col("id")))
    n, m = rows.count(), asked.count()
    x_blocks, q_blocks = max(1, -(-n // (TILE * 3 // 4))), max(1, -(-m // (TILE * 3 // 4)))
    tile_x = rows.select((F.pmod(F.xxhash64("id"), F.lit(x_blocks))).alias("b"), "id", "v").withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    tile_q = asked.select((F.pmod(F.xxhash64("id"), F.lit(q_blocks))).alias("a"), "id", "v").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(x_blocks - 1))))

    def tile(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        found: list = []
        if len(q) and len(x):
            q, x = (t[~pd.Series([(i, v.tobytes()) for i, v in zip(t["id"], t["v"], strict=True)], index=t.index).duplicated()] for t in (q, x))
            found = nearest(q["id"].to_numpy(), np.stack(q["v"].to_numpy()), x["id"].to_numpy(), np.stack(x["v"].to_numpy()), k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    cast = [F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col("id").alias("id"), F.col("v").alias("v")]
    found = tile_q.select(*cast).groupBy("a", "b").cogroup(tile_x.select(*cast).groupBy("a", "b")).applyInPandas(tile, "query_id long, vec_id long, score double")

    def merge(x: pd.DataFrame) -> pd.DataFrame:
        out = []
        for query, own in x.groupby("query_id"):
            best = heapq.nsmallest(k, set(zip((-own["score"]).tolist(), own["vec_id"].tolist(), strict=True)))
            out += [(query, i + 1, v, -s) for i, (s, v) in enumerate(best)]
        return pd.DataFrame(out, columns=["query_id", "rank", "vec_id", "score"])

    return found.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(max(12, -(-m // 256))))).groupBy("part").applyInPandas(merge, "query_id long, rank int, vec_id long, score double")
