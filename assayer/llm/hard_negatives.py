"""Hard-negative mining by segment summaries.

Each vector of whole numbers is cut into 1, 4 and 16 segments, and each segment's mean and deviation (the length of what is left of it without the mean) are stored beside it. For two vectors' segments a and b of length l,

    a.b = l mean(a) mean(b) + (a - mean(a)).(b - mean(b)), and the last term is within plus or minus deviation(a) deviation(b),

so sums over segments bound a score from both sides. All pairs of a tile get the bounds of the coarsest level; only pairs that a bound can't settle get those of the next, and what the finest leaves is computed exactly. A pair is settled for an anchor's positives if its upper bound is below the k-th largest lower bound, and for the negatives of a positive if it can't lie in the asked range of scores, or is below the k-th largest lower bound of pairs that surely do.

Anchors are a stated set of queries; their blocks meet all blocks of rows, each pair of blocks in a group of its own, so labels deal nothing and a hot label is no hot group. Blocks are of about BLOCK_BYTES of vectors. There is one round for positives, whose scores then set the ranges of the second round; the tiles' first k rows of an anchor, or of an anchor and positive, are merged by a ranked window.

Rows with a null id or label, or whose vector is null, empty, of another length than most (ties: the shorter), or holds null or non-finite components, take no part; nor do vectors so long that a score might not fit into a long. Of rows that share an id the one with the smallest label and vector counts. Anchors without positives, and positives without negatives in range, give no row; neither does an empty table. Ties go to the smaller id. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.common import release, staged

LEVELS = (1, 4, 16)
BLOCK_BYTES = 4 << 20
#: Anchors whose bounds are held at once.
ROWS = 64
#: What rounding can add to a bound, as a share of the vectors' lengths multiplied.
SLACK = 1e-9


def summaries(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level, means times the root of the segment's length, and deviations, of the rows' segments."""
    out = []
    for parts in LEVELS:
        start = np.unique(np.arange(parts) * x.shape[1] // parts)
        size = np.diff(np.append(start, x.shape[1]))
        mean = np.add.reduceat(x, start, axis=1) / size
        away = x - np.repeat(mean, size, axis=1)
        out.append((mean * np.sqrt(size), np.sqrt(np.add.reduceat(away * away, start, axis=1))))
    return out


class Rows:
    """Vectors of a block with their stored summaries."""

    def __init__(self, frame: pd.DataFrame, dim: int):
        self.id, self.label = frame["id"].to_numpy(np.int64), frame["label"].to_numpy()
        self.x = np.frombuffer(b"".join(frame["x"]), np.int64).reshape(-1, dim)
        stored = np.frombuffer(b"".join(frame["summary"])).reshape(len(frame), -1)
        self.size, self.levels, at = stored[:, 0], [], 1
        for parts in LEVELS:
            n = min(parts, dim)
            self.levels.append((stored[:, at : at + n], stored[:, at + n : at + 2 * n]))
            at += 2 * n


def coarse(a: Rows, who: np.ndarray, b: Rows, those: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all pairs of some rows, from the coarsest level."""
    (ma, da), (mb, db) = a.levels[0], b.levels[0]
    middle, spread = ma[who] @ mb[those].T, da[who] @ db[those].T + SLACK * np.outer(a.size[who], b.size[those])
    return middle - spread, middle + spread


def finer(a: Rows, who: int, b: Rows, those: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of one row of a with some rows of b."""
    (ma, da), (mb, db) = a.levels[level], b.levels[level]
    middle, spread = mb[those] @ ma[who], db[those] @ da[who] + SLACK * a.size[who] * b.size[those]
    return middle - spread, middle + spread


def cut(low: np.ndarray, k: int) -> float:
    """The k-th largest of the lower bounds, which the k first reach at least."""
    return -np.inf if len(low) < k else float(np.partition(low, -k)[-k])


def first(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first by falling score, then id."""
    return np.lexsort((ids, -score))[:k]


def positives_of(a: Rows, b: Rows, k: int) -> list[tuple[int, int, int]]:
    """(anchor, row, score) of the k first rows of b with an anchor's label."""
    out = []
    for label in np.intersect1d(a.label, b.label):
        who, those = np.flatnonzero(a.label == label), np.flatnonzero(b.label == label)
        for at in range(0, len(who), ROWS):
            part = who[at : at + ROWS]
            low, high = coarse(a, part, b, those)
            for row, anchor in enumerate(part):
                other = b.id[those] != a.id[anchor]
                places, lo, hi = those[other], low[row][other], high[row][other]
                for level in range(1, len(LEVELS) + 1):
                    open_ = hi >= cut(lo, k)
                    places = places[open_]
                    if level < len(LEVELS):
                        lo, hi = finer(a, anchor, b, places, level)
                score = b.x[places] @ a.x[anchor]
                out += [(a.id[anchor], b.id[places[i]], score[i]) for i in first(score, b.id[places], k)]
    return out


def negatives_of(a: Rows, ranges: dict[int, list[tuple[int, int, int]]], b: Rows, k: int) -> list[tuple[int, int, int, int]]:
    """(anchor, positive, row, score): for each of an anchor's (positive, least, most), the k first rows of b with another label whose score is in that range."""
    out = []
    who = np.array([i for i, x in enumerate(a.id.tolist()) if x in ranges], np.int64)
    for at in range(0, len(who), ROWS):
        part = who[at : at + ROWS]
        low, high = coarse(a, part, b, np.arange(len(b.id)))
        for row, anchor in enumerate(part):
            wanted = ranges[int(a.id[anchor])]
            places = np.flatnonzero((b.label != a.label[anchor]) & (b.id != a.id[anchor]))
            lo, hi = low[row][places], high[row][places]
            for level in range(1, len(LEVELS) + 1):
                open_ = np.zeros(len(places), bool)
                for _, least, most in wanted:
                    sure = lo[(lo >= least) & (hi <= most)]
                    open_ |= (hi >= max(least, cut(sure, k))) & (lo <= most)
                places = places[open_]
                if level < len(LEVELS):
                    lo, hi = finer(a, anchor, b, places, level)
            score = b.x[places] @ a.x[anchor]
            for positive, least, most in wanted:
                inside = np.flatnonzero((score >= least) & (score <= most))
                out += [(a.id[anchor], positive, b.id[places[inside[i]]], score[inside[i]]) for i in first(score[inside], b.id[places[inside]], k)]
    return out


def rows_of(vectors: DataFrame, label: Column, scale: int) -> DataFrame:
    """id, label, x, summary of the rows that take part, staged. x holds floor(scale * component) as longs, summary the length and each level's means and deviations as doubles."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), label.cast("string").alias("label"), v.alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    rows = rows.where(~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).select("n")
    rows = rows.join(F.broadcast(size), F.size("v") == F.col("n")).groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")

    def stored(frames):
        for f in frames:
            x = np.floor(np.stack(f["v"].to_numpy()) * scale) if len(f) else np.zeros((0, 1))
            length = np.sqrt((x * x).sum(axis=1))
            fits = length < 1 << 31
            x, length, f = x[fits], length[fits], f[fits]
            held = np.hstack([length[:, None], *(part for pair in summaries(x) for part in pair)]) if len(f) else np.zeros((0, 1))
            yield pd.DataFrame({"id": f["id"], "label": f["label"], "x": [r.tobytes() for r in x.astype(np.int64)], "summary": [r.tobytes() for r in held]})
        release()

    return staged(rows.mapInPandas(stored, "id long, label string, x binary, summary binary"), "summaries")


def tiles(asked: DataFrame, rows: DataFrame, dim: int, task: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Every block of asked rows with every block of rows, a task for each pair."""
    n, m = rows.count(), asked.count()
    held = max(64, BLOCK_BYTES // (8 * dim))
    x_blocks, q_blocks = max(1, -(-n // held)), max(1, -(-m // held))
    b = rows.select(F.pmod(F.xxhash64("id"), F.lit(x_blocks)).cast("long").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long"))).alias("a"), *(F.col(c).alias(c) for c in rows.columns))
    a = asked.select(F.pmod(F.xxhash64("id"), F.lit(q_blocks)).cast("long").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(x_blocks - 1).cast("long"))).alias("b"), *(F.col(c).alias(c) for c in asked.columns))

    def one(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        found = task(q, x) if len(q) and len(x) else []
        return pd.DataFrame(found, columns=[c.split()[0] for c in schema.split(", ")])

    return a.groupBy("a", "b").cogroup(b.groupBy("a", "b")).applyInPandas(one, schema)


def mine(vectors: DataFrame, is_anchor: Callable[[Column], Column], label: Column, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of vectors(vec_id, embedding): for each anchor and each of its first rows of the same label, the first rows of other labels whose score is least to most percent of the positive's."""
    rows = rows_of(vectors, label, scale)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    one = rows.select(F.octet_length("x").alias("n")).first()
    if one is None:
        return rows.sparkSession.createDataFrame([], schema)
    dim, anchors = one["n"] // 8, rows.where(is_anchor(F.col("id")))
    found = tiles(anchors, rows, dim, lambda q, x: positives_of(Rows(q, dim), Rows(x, dim), positives), "anchor_id long, positive_id long, positive_score long")
    rank = lambda key, score, tie: F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(score), tie))
    found = found.withColumn("rank", rank(["anchor_id"], "positive_score", "positive_id")).where(F.col("rank") <= positives)
    chosen = staged(found.select("anchor_id", "positive_id", "positive_score"), "positives")
    lists = chosen.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("pairs"))
    lists = lists.select(F.col("anchor_id").alias("id"), F.col("pairs.positive_id").alias("who"), F.col("pairs.positive_score").alias("scores"))
    asked = anchors.join(lists, "id")

    def task(q: pd.DataFrame, x: pd.DataFrame) -> list:
        ranges = {int(i): [(int(w), -(-least * int(s) // 100), most * int(s) // 100) for w, s in zip(who, scores, strict=True)] for i, who, scores in zip(q["id"], q["who"], q["scores"], strict=True)}
        return negatives_of(Rows(q, dim), ranges, Rows(x, dim), negatives)

    met = tiles(asked, rows, dim, task, "anchor_id long, positive_id long, negative_id long, negative_score long")
    met = met.withColumn("rank", rank(["anchor_id", "positive_id"], "negative_score", "negative_id")).where(F.col("rank") <= negatives)
    return met.join(chosen, ["anchor_id", "positive_id"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
