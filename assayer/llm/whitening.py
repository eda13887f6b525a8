"""PCA whitening of embeddings by Chebyshev-filtered subspace iteration.

Vectors become whole numbers x, whose count n and sums S are exact. The covariance V of the fit list is never formed: a pass over the staged vectors gives V Q for a block Q of few columns, as the sum of centred blocks X'(X Q) / n. Each outer step applies a Chebyshev polynomial of V to the block, by its three-term recurrence with one pass a degree, which damps every eigenvalue between 0 and the block's smallest Ritz value; then come QR, one more pass, and Rayleigh-Ritz. It ends when the residuals |V q - e q| of all wanted components are certified to be within TOLERANCE of the largest eigenvalue and rounding lets them fall no further. The block has GUARD columns more than wanted, and doubles where the Ritz values foretell more than PASSES passes, as in a flat spectrum; with as many columns as dimensions a Rayleigh-Ritz is exact, so it always ends.

A pass sends Q to the tasks (dimensions times block, whatever the number of vectors), sums by task, then by slot, and brings at most SLOTS sums of that size to the driver.

Rows whose vector is null, empty, of another length than most (ties: the shorter), or holds null or non-finite components take no part and get no row. Repeated rows count each time; a null vec_id stays null. Where an eigenvalue is zero beside the largest (below ZERO of it), whitened is null, and it is left out of identity_error; without any variance, so are explained and identity_error. Deviations beyond a long are null. An empty table gives no row. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import release, staged

GUARD, SLOTS = 16, 16
#: Residuals that certify, and those beyond which rounding lets nothing improve, as shares of the largest eigenvalue.
TOLERANCE, FINE = 1e-11, 1e-14
#: Degree of a polynomial, and passes to come beyond which the block doubles.
DEGREE, PASSES = 12, 72
ZERO = 1e-12


def numbers(vectors: DataFrame, scale: int, shift: int) -> DataFrame:
    """vec_id, x: the vectors that take part as floor(scale * c) + shift."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0))
    rows = rows.where(~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).select("n")
    rows = rows.join(F.broadcast(size), F.size("v") == F.col("n"))
    return staged(rows.select("vec_id", F.transform("v", lambda c: F.floor(c * scale).cast("long") + shift).alias("x")), "vectors")


class Fit:
    """The fit list: rows(x), their number n, exact sums S, and passes over them."""

    def __init__(self, rows: DataFrame):
        self.rows = rows
        sums = rows.select(F.posexplode("x").alias("d", "x")).groupBy("d").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum((F.col("x") * F.col("x")).cast("decimal(38,0)")).alias("q")).orderBy("d").collect()
        self.n = sums[0]["n"] if sums else 0
        self.sums = [int(r["s"]) for r in sums]
        self.trace = sum(self.n * int(r["q"]) - int(r["s"]) ** 2 for r in sums) / self.n**2 if sums else 0.0
        self.passes = 0

    def gram(self, right: np.ndarray, left: np.ndarray | None = None) -> np.ndarray:
        """X'(X right) / n of the centred rows X, or (X left)'(X right) / n."""
        n, sums, d = self.n, np.array(self.sums), len(self.sums)

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((d if left is None else left.shape[1], right.shape[1]))
            for x in batches:
                c = centred(x.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d), n, sums)
                total += (c if left is None else c @ left).T @ (c @ right)
            yield pa.RecordBatch.from_pydict({"sums": [total.tobytes()]})
            release()

        def added(x: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"sums": [np.sum([np.frombuffer(b) for b in sorted(x["sums"])], axis=0).tobytes()]})

        parts = self.rows.select("x").mapInArrow(partial, "sums binary").withColumn("slot", F.spark_partition_id() % SLOTS)
        got = parts.groupBy("slot").applyInPandas(added, "sums binary").collect()
        self.passes += 1
        return np.sum([np.frombuffer(b) for b in sorted(bytes(r["sums"]) for r in got)], axis=0).reshape(-1, right.shape[1]) / n


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S / n in double precision; the subtraction is of whole numbers where they fit."""
    if len(x) and max(abs(int(x.max())), abs(int(x.min()))) * n < 1 << 62:
        return (n * x - sums) / n
    return x - sums / n


def filtered(product: Callable[[np.ndarray], np.ndarray], q: np.ndarray, vq: np.ndarray, values: np.ndarray, done: int, low: float) -> np.ndarray:
    """A Chebyshev polynomial of V applied to the Ritz vectors q, whose product vq is known: at most 1 in [0, low], growing fast above. The first `done` columns have converged; they stay, and are taken out of V. The degree is kept where growth at the largest value left would swamp the smaller columns."""
    half, held, kept = low / 2, q[:, :done], values[:done]
    without = lambda x, y: x - held @ (kept[:, None] * (held.T @ y))
    grow = np.arccosh(max(values[done] / half - 1, 1.0))
    degree = int(np.clip(16 / max(grow, 1e-3), 1, DEGREE))
    last, now = q[:, done:], (without(vq[:, done:], q[:, done:]) - half * q[:, done:]) / half
    for _ in range(degree - 1):
        last, now = now, 2 * (without(product(now), now) - half * now) / half - last
    return np.hstack([held, now / np.linalg.norm(now, axis=0)])


def components(product: Callable[[np.ndarray], np.ndarray], dim: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and their unit eigenvectors by columns, of a positive semidefinite matrix that is known by its products."""
    block, rng = min(dim, k + GUARD), np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.standard_normal((dim, block)))
    best, stale = np.inf, 0
    while True:
        vq = product(q)
        values, turn = np.linalg.eigh((q.T @ vq + vq.T @ q) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        top = max(values[0], 0.0)
        residuals = np.linalg.norm(vq[:, :k] - q[:, :k] * values[:k], axis=0)
        residual, stale = residuals.max(), stale + 1 if residuals.max() > 0.8 * best else 0
        best = min(best, residual)
        low = max(values[-1], ZERO * top)
        a_pass = np.arccosh(max(2 * values[k - 1] / low - 1, 1.0)) if top else 0.0
        if block == dim or residual <= FINE * top or best <= TOLERANCE * top and stale > (DEGREE * a_pass < 3):
            return values[:k], q[:, :k]
        if np.log(residual / (FINE * top)) > PASSES * a_pass:
            block = min(dim, 2 * block)
            q = np.hstack([vq, top * rng.standard_normal((dim, block - q.shape[1]))])
        else:
            q = filtered(product, q, vq, values, int(np.append(residuals > 10 * FINE * top, True).argmax()), low)
        q, _ = np.linalg.qr(q)


def whiten(vectors: DataFrame, k: int = 8, scale: int = 1024, shift: int = 100000) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of vectors(vec_id, embedding), for the first k components (all, if fewer dimensions)."""
    rows = numbers(vectors, scale, shift)
    fit = Fit(rows)
    n, sums, trace = fit.n, np.array(fit.sums, dtype=np.int64), fit.trace
    schema = f"vec_id {dict(vectors.dtypes)['vec_id']}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not n:
        return rows.sparkSession.createDataFrame([], schema)
    values, axes = components(fit.gram, len(sums), min(k, len(sums)))
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1, 1)
    there = values > ZERO * max(values[0], 0.0)
    scaled = axes * np.where(there, 1 / np.sqrt(np.where(there, values, 1)), 0)
    error = None
    if there.any():
        used = scaled[:, there]
        error = float(np.abs(fit.gram(used, used) - np.eye(used.shape[1])).max())
    share = [float(v / trace) if trace > 0 else None for v in values]
    d, m = len(sums), len(values)

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            v = x.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            white = (centred(v, n, sums) @ scaled).ravel()
            away = max(abs(int(v.max())), abs(int(v.min()))) * n + max(map(abs, sums.tolist()))
            dev = n * v - sums if away < 1 << 62 else n * v.astype(object) - sums.astype(object)
            if away < 1 << 62 and int(np.abs(dev).max()) ** 2 * d >= 1 << 63:
                dev = dev.astype(object)
            exact = [int(e) if e < 1 << 63 else None for e in (dev * dev).sum(axis=1).tolist()]
            at = np.repeat(np.arange(len(v)), m)
            many = lambda a, kind: pa.array(a * len(v), kind)
            yield pa.RecordBatch.from_arrays(
                [x.column(0).take(pa.array(at)), many(list(range(1, m + 1)), pa.int32()), pa.array(np.full(len(at), n)), pa.array(exact, pa.int64()).take(pa.array(at)), pa.array(white, mask=np.tile(~there, len(v))), many(share, pa.float64()), many([error] * m, pa.float64())],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )
        release()

    return rows.select("vec_id", "x").mapInArrow(out, schema)
