"""Fitting thresholds and measuring them: grids, constants, folds, rank correlation, calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.sources.shared import staged


def band_grid(spark: SparkSession, step: int = 25) -> DataFrame:
    """Pairs half < whole in thousandths, half up to 900, whole up to 975."""
    rows = [(h, f) for h in range(0, 901, step) for f in range(h + step, 976, step)]
    return spark.createDataFrame(rows, "half int, whole int")


def balanced_error(errors: DataFrame, keys: list[str], third: str, error: str) -> DataFrame:
    """The mean over thirds of the mean error; empty thirds drop out."""
    return errors.groupBy(*keys, third).agg(F.avg(error).alias("__m")).groupBy(*keys).agg(F.avg("__m").alias("balanced"))


def first_best(df: DataFrame, keys: list[str], error: str, *order: str) -> DataFrame:
    """The row with the smallest error to 12 places, the first in order on ties."""
    w = Window.partitionBy(*keys).orderBy(F.round(error, 12), *order) if keys else None
    if w is None:
        return df.orderBy(F.round(error, 12), *order).limit(1)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def ranked(df: DataFrame, value: str, name: str) -> DataFrame:
    """Mean ranks over all rows, from the counts of distinct values. Values are dealt in ranges; a window sees the values of a range, and one the ranges."""
    counts = df.groupBy(value).agg(F.count("*").alias("__n")).repartitionByRange(value).withColumn("__p", F.spark_partition_id())
    counts = staged(counts, "ranks")
    upto = lambda w: F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = counts.groupBy("__p").agg(F.sum("__n").alias("__n")).withColumn("__one", F.lit(0))
    ranges = ranges.select("__p", upto(Window.partitionBy("__one").orderBy("__p")).alias("__r"))  # a row a range
    inside = counts.withColumn("__b", upto(Window.partitionBy("__p").orderBy(value))).join(ranges, "__p")
    return df.join(inside.select(value, (F.col("__r") + F.col("__b") + (F.col("__n") + 1) / 2).alias(name)), value)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    rows = ranked(ranked(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()), a, "__ra"), b, "__rb")
    return rows.agg(F.coalesce(F.covar_pop("__ra", "__rb") / F.nullif(F.stddev_pop("__ra") * F.stddev_pop("__rb"), F.lit(0.0)), F.lit(0.0)).alias("spearman"))


def rising(mean: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """First places of the blocks of a least-squares rising step fit: while a block's mean is above the next one's, runs of falling means are pooled, all at once."""
    first = np.arange(len(mean))
    total, count = mean * weight, weight.astype(float)
    while len(first) > 1:
        value = total / count
        starts = np.flatnonzero(np.append(True, value[:-1] <= value[1:]))
        if len(starts) == len(first):
            break
        first, total, count = first[starts], np.add.reduceat(total, starts), np.add.reduceat(count, starts)
    return first


def cells_of(df: DataFrame, key: list[str], x: str, y: str) -> DataFrame:
    """key, __x, __s, __n: samples summed by x to six places, so a key has a million cells at most for x in [0, 1]. Cells of parts of the rows can be added and taken away."""
    return df.groupBy(*key, F.round(F.col(x).cast("double"), 6).alias("__x")).agg(F.sum(F.col(y).cast("double")).alias("__s"), F.count("*").cast("double").alias("__n"))


def without_fold(cells: DataFrame, key: list[str], fold: str) -> DataFrame:
    """The cells of all folds but one, for each fold: all cells less the fold's own."""
    every = cells.groupBy(*key, "__x").agg(F.sum("__s").alias("__as"), F.sum("__n").alias("__an"))
    folds = cells.select(*key, fold).distinct()
    rest = folds.join(every, key).join(cells, [*key, fold, "__x"], "left")
    return rest.select(*key, fold, "__x", (F.col("__as") - F.coalesce("__s", F.lit(0.0))).alias("__s"), (F.col("__an") - F.coalesce("__n", F.lit(0.0))).alias("__n")).where("__n > 0.5")


def isotonic(df: DataFrame, key: list[str], x: str, y: str) -> DataFrame:
    """Breakpoints xs, ys of a rising step curve for each key: the lowest and highest x of each block with its mean, to six places and within [0, 1]."""
    return isotonic_cells(cells_of(df, key, x, y), key)


def isotonic_cells(cells: DataFrame, key: list[str]) -> DataFrame:
    """The curves of isotonic() from cells."""
    kinds = ", ".join(f"{k} {dict(cells.dtypes)[k]}" for k in key)

    def pool(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__x")
        at, total, count = (rows[c].to_numpy(float) for c in ("__x", "__s", "__n"))
        first = rising(total / count, count)
        last = np.append(first[1:], len(at)) - 1
        mean = np.clip(np.round(np.add.reduceat(total, first) / np.add.reduceat(count, first), 6), 0.0, 1.0)
        ends = np.stack([first, last], 1).ravel()
        once = np.append(True, ends[1:] != ends[:-1])
        return pd.DataFrame([[*(rows[k].iloc[0] for k in key), at[ends[once]].tolist(), np.repeat(mean, 2)[once].tolist()]], columns=[*key, "xs", "ys"])

    return cells.groupBy(*key).applyInPandas(pool, f"{kinds}, xs array<double>, ys array<double>")


def calibrations(df: DataFrame, engine: str, kind: str, x: str, error: str, previous: DataFrame, least: int = 30) -> DataFrame:
    """engine, kind, version, samples, error_rate, weight, xs, ys of the groups of df(engine, kind, x, error) that have `least` samples; a version is the one after that of previous(engine, kind, version), and weights are relative to the best engine of the kind."""
    group = [engine, kind]
    enough = df.groupBy(*group).agg(F.count("*").alias("samples"), F.avg(error).alias("rate")).where(F.col("samples") >= least)
    odds = F.least(F.greatest(F.col("rate"), F.lit(1e-6)), F.lit(1 - 1e-6))
    raw = enough.withColumn("raw", F.greatest(F.lit(0.0), F.log((1 - odds) / odds) / 2))
    best = F.max("raw").over(Window.partitionBy(kind))
    weighted = raw.withColumn("weight", F.when(best > 0, F.round(F.col("raw") / best, 6)).otherwise(0.0))
    curves = isotonic(df.join(enough.select(*group), group, "left_semi").withColumn("__y", 1 - F.col(error)), group, x, "__y")
    out = weighted.join(curves, group).join(previous.select(*group, F.col("version").alias("__v")), group, "left")
    return out.select(*group, (F.coalesce("__v", F.lit(0)) + 1).alias("version"), "samples", F.round("rate", 6).alias("error_rate"), "weight", "xs", "ys")


def interpolated(value, xs, ys):
    """A piecewise linear curve through breakpoints, flat beyond its ends."""
    at = F.size(F.filter(xs, lambda p: p <= value))
    lo, hi = F.greatest(at, F.lit(1)), F.least(at + 1, F.size(xs))
    x0, x1, y0, y1 = F.element_at(xs, lo), F.element_at(xs, hi), F.element_at(ys, lo), F.element_at(ys, hi)
    return F.when(value <= F.element_at(xs, 1), F.element_at(ys, 1)).when((at >= F.size(xs)) | (x1 == x0), y0).otherwise(y0 + (value - x0) * (y1 - y0) / (x1 - x0))


def draws_of(units: int, draws: int, seed: int) -> Iterator[np.ndarray]:
    """How often each of so many units is drawn, a draw of as many at a time: the draws of random.Random(seed).randrange, whose words are the same generator's as numpy's, kept where they are below the number of units."""
    source, shift = np.random.RandomState([seed]), 32 - units.bit_length()  # noqa: NPY002
    held = np.zeros(0, np.int64)
    for _ in range(draws):
        while len(held) < units:
            words = source.randint(0, 1 << 32, max(64, units), dtype=np.uint32) >> np.uint32(shift)
            held = np.concatenate([held, words[words < units].astype(np.int64)])
        yield np.bincount(held[:units], minlength=units)
        held = held[units:]


def interval(values: np.ndarray) -> tuple[float | None, float | None]:
    """The 2.5 and 97.5 % places of sorted values."""
    values = np.sort(values[np.isfinite(values)])
    return tuple(float(values[int(share * (len(values) - 1))]) for share in (0.025, 0.975)) if len(values) else (None, None)


def bootstrap_ratio(df: DataFrame, key: list[str], unit: str, part: str, whole: str, draws: int = 1000, seed: int = 20261004, least: int = 5) -> DataFrame:
    """A 95 % interval of sum(part) / sum(whole) over resampled units (pages) of a key, in order of their names; null below `least` units. Units are aggregated before they come here: a key has one row a page. A task holds a key's units and one draw's counts."""
    kinds = ", ".join(f"{k} {dict(df.dtypes)[k]}" for k in key)

    def resample(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(unit)
        low = high = None
        if len(rows) >= least:
            over, under = rows[part].to_numpy(float), rows[whole].to_numpy(float)
            sums = np.array([(counts @ over, counts @ under) for counts in draws_of(len(rows), draws, seed)])
            low, high = interval(sums[sums[:, 1] != 0, 0] / sums[sums[:, 1] != 0, 1])
        return pd.DataFrame([[*(rows[k].iloc[0] for k in key), len(rows), low, high]], columns=[*key, "pages", "low", "high"])

    return df.select(*key, unit, F.col(part).cast("double").alias(part), F.col(whole).cast("double").alias(whole)).groupBy(*key).applyInPandas(resample, f"{kinds}, pages long, low double, high double")


def band_cube(rows: DataFrame, keys: list[str], step: int) -> DataFrame:
    """keys, third, bin, n, e0, e1, e2 of rows(keys, third, sim in thousandths, e0, e1, e2): errors if the similarity earned nothing, half or all, summed by bins of `step`. The cube doesn't grow with the rows, and the errors of any pair of bands follow from it, so no row meets a threshold."""
    return rows.groupBy(*keys, "third", F.floor(F.col("sim") / step).cast("int").alias("bin")).agg(F.count("*").alias("n"), *(F.sum(e).alias(e) for e in ("e0", "e1", "e2")))


def band_errors(cube: DataFrame, keys: list[str], grid: DataFrame, step: int) -> DataFrame:
    """keys, half, whole, third, error, n: the summed errors of each pair of bands, by running sums over the bins."""
    up = Window.partitionBy(*keys, "third").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    upto = cube.select(*keys, "third", "bin", *(F.sum(c).over(up).alias(c) for c in ("n", "e0", "e1", "e2")))
    of_key = upto.groupBy(*keys, "third").agg(F.max_by(F.struct("n", "e0", "e1", "e2"), "bin").alias("every"), F.array_sort(F.collect_list(F.struct("bin", "e0", "e1", "e2"))).alias("sums"))
    at = lambda edge, e: F.coalesce(F.try_element_at(F.filter("sums", lambda x: x["bin"] < F.col(edge) / step), F.lit(-1))[e], F.lit(0.0))
    pairs = of_key.crossJoin(F.broadcast(grid))  # a row a key and third, a fixed grid
    error = at("half", "e0") + at("whole", "e1") - at("half", "e1") + F.col("every.e2") - at("whole", "e2")
    return pairs.select(*keys, "half", "whole", "third", error.alias("error"), F.col("every.n").alias("n"))


def cross_validated(cube: DataFrame, keys: list[str], fold: str, grid: DataFrame, step: int) -> DataFrame:
    """keys, balanced, mae: bands are chosen by the balanced error of all folds but one, and measured on that one. What is without a fold is the whole cube less the fold's own part."""
    cube = staged(cube, "cube")
    sums = ("n", "e0", "e1", "e2")
    whole = cube.groupBy(*keys, "third", "bin").agg(*(F.sum(c).alias(f"all_{c}") for c in sums))
    folds = cube.select(*keys, fold).distinct()
    rest = folds.join(whole, keys).join(cube, [*keys, fold, "third", "bin"], "left").select(*keys, fold, "third", "bin", *((F.col(f"all_{c}") - F.coalesce(c, F.lit(0))).alias(c) for c in sums)).where("n > 0")
    errors = band_errors(rest, [*keys, fold], grid, step)
    balanced = errors.groupBy(*keys, fold, "half", "whole").agg(F.avg(F.col("error") / F.col("n")).alias("balanced"))
    chosen = first_best(balanced, [*keys, fold], "balanced", "half", "whole").select(*keys, fold, "half", "whole")
    held = band_errors(cube, [*keys, fold], grid, step).join(chosen, [*keys, fold, "half", "whole"])
    thirds = held.groupBy(*keys, "third").agg(F.sum("error").alias("error"), F.sum("n").alias("n"))
    return thirds.groupBy(*keys).agg(F.avg(F.col("error") / F.col("n")).alias("balanced"), (F.sum("error") / F.sum("n")).alias("mae"))


def margin_search(rows: DataFrame, default: int, most: float = 0.4, steps: int = 10, step: int = 10) -> DataFrame:
    """margin, recall, rate: the margin, of `steps` of `step` thousandths and 0, that flags the most of rows(always, distance, disagree) that disagree, while at most a share of `most` is flagged; ties to the fewest flags, then to the default. A row is flagged always, or from the first margin beyond its distance to a band: rows are counted by that margin, and running sums give every margin."""
    level = F.when(F.col("always"), 0).otherwise(F.least(F.floor(F.col("distance") / step) + 1, F.lit(steps + 1))).cast("int")
    cells = rows.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.count_if("disagree").alias("d"))
    margins = rows.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("k"))
    met = margins.crossJoin(F.broadcast(cells)).groupBy("k").agg(F.sum(F.when(F.col("level") <= F.col("k"), F.col("n")).otherwise(0)).alias("flagged"), F.sum(F.when(F.col("level") <= F.col("k"), F.col("d")).otherwise(0)).alias("caught"), F.sum("n").alias("n"), F.sum("d").alias("d"))  # a dozen rows each
    all_ = met.select((F.col("k") * step).alias("margin"), F.coalesce(F.col("caught") / F.nullif("d", F.lit(0)), F.lit(1.0)).alias("recall"), (F.col("flagged") / F.col("n")).alias("rate"))
    own = F.col("margin") == default
    return all_.where((F.col("rate") <= most) | own).orderBy(F.col("rate") > most, F.desc("recall"), "rate", ~own, "margin").limit(1)


def paired(units: DataFrame, engine: str, unit: str, part: str, whole: str) -> DataFrame:
    """engine, against, unit, part, whole: for each two engines the differences of a unit, over the first one's whole; with the same draws for both, their interval is that of the difference. Units that the second lacks count as 0 there."""
    names = units.select(F.col(engine).alias("against")).distinct()  # a row an engine
    a = units.crossJoin(F.broadcast(names)).where(F.col(engine) != F.col("against"))
    b = units.select(F.col(engine).alias("against"), unit, F.col(part).alias("__other"))
    return a.join(b, ["against", unit], "left").select(engine, "against", unit, (F.col(part) - F.coalesce("__other", F.lit(0))).alias(part), whole)


def precision_curve(found: DataFrame, score: str, hit: str) -> DataFrame:
    """score, hits, n, precision, best: by falling score, how many are found and right at each score, the precision from the highest score down to it, and the highest precision from it on. Scores are dealt in ranges: a window sees the scores of a range, and one the ranges; what a range takes over from others is a row."""
    cells = found.groupBy(F.col(score).alias("score")).agg(F.count(hit).alias("hits"), F.count("*").alias("n")).repartitionByRange(F.desc("score")).withColumn("__p", F.spark_partition_id())
    cells = staged(cells, "scores")
    one = Window.partitionBy("__one").orderBy("__p")
    before, after = one.rowsBetween(Window.unboundedPreceding, -1), one.rowsBetween(1, Window.unboundedFollowing)
    ranges = cells.groupBy("__p").agg(F.sum("hits").alias("h"), F.sum("n").alias("m")).withColumn("__one", F.lit(0))
    carried = ranges.select("__p", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__{c}") for c in ("h", "m")))
    down = Window.partitionBy("__p").orderBy(F.desc("score"))
    upto = cells.join(carried, "__p").withColumn("precision", (F.sum("hits").over(down) + F.col("__h")) / (F.sum("n").over(down) + F.col("__m")))
    upto = staged(upto.select("__p", "score", "hits", "n", "precision"), "precisions")
    tops = upto.groupBy("__p").agg(F.max("precision").alias("top")).withColumn("__one", F.lit(0)).select("__p", F.max("top").over(after).alias("__later"))
    own = F.max("precision").over(down.rowsBetween(0, Window.unboundedFollowing))
    return upto.withColumn("__own", own).join(tops, "__p").select("score", "hits", "n", "precision", F.greatest("__own", F.coalesce("__later", F.lit(0.0))).alias("best"))
