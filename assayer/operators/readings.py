"""Choosing among several readings of a line, and measuring the choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions import text


def agreement(readings: DataFrame, line: str, reading: str, body: str) -> DataFrame:
    """line, reading, agreement: 1 less the mean normalised distance to the line's other readings; 0 alone."""
    a = readings.select(line, reading, F.col(body).alias("__a"))
    b = readings.select(line, F.col(reading).alias("__r"), F.col(body).alias("__b"))
    pairs = a.join(b, line).where(F.col(reading) != F.col("__r"))
    near = pairs.groupBy(line, reading).agg((1 - F.avg(text.norm_distance(F.col("__a"), F.col("__b")))).alias("agreement"))
    return a.select(line, reading).join(near, [line, reading], "left").select(line, reading, F.coalesce("agreement", F.lit(0.0)).alias("agreement"))


def select_reading(scored: DataFrame, line: str, position: str, alpha: float, beta: float, threshold: float, extra: tuple[str, ...] = ()) -> DataFrame:
    """The winner of each line of scored(line, position, confidence, weight, agreement, lexicon): the highest weight * confidence + alpha * agreement + beta * lexicon, then confidence, then position; its score as a share of the best possible, and whether it is flagged."""
    s = F.round(F.col("weight") * F.col("confidence") + alpha * F.col("agreement") + beta * F.coalesce("lexicon", F.lit(0.0)), 9)
    w = Window.partitionBy(*extra, line).orderBy(F.desc("s"), F.desc("confidence"), position)
    best = scored.withColumn("s", s).withColumn("__r", F.row_number().over(w)).where("__r = 1")
    ceiling = F.col("weight") + alpha + F.when(F.col("lexicon").isNotNull(), beta).otherwise(0.0)
    return best.withColumn("line_score", F.least(F.lit(1.0), F.col("s") / ceiling)).withColumn("flagged", F.col("line_score") < threshold).drop("__r")


def edits(df: DataFrame, written: str, truth: str) -> DataFrame:
    """df with chars, edits, words, word_edits of a reading against the truth, both in flat form."""
    a, b = text.flat(F.col(written)), text.flat(F.col(truth))
    split = lambda x: F.filter(F.split(x, " "), lambda w: w != "")
    return df.withColumns({"chars": F.length(b), "edits": F.levenshtein(a, b), "words": F.size(split(b)), "word_edits": text.list_edits(split(a), split(b))})


def tally(df: DataFrame, written: str, truth: str, groups: list[str]) -> DataFrame:
    """Edits and lengths summed over all, and by each of the groups on its own: a rate is a sum over a sum."""
    rows = edits(df, written, truth)
    sets = [[], *[[g] for g in groups]]
    measures = [F.count("*").alias("lines"), *[F.sum(c).alias(c) for c in ("edits", "chars", "word_edits", "words")]]
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(g) for g in groups]).agg(*measures)


def content_class(df: DataFrame, line: str, body: str, confidence: str, printing: Column, numeric: float = 0.6, alike: float = 0.8, sure: float = 0.8) -> DataFrame:
    """line, class: numeric where digits and signs make most of its readings' characters and one is a digit; print where two printing engines or more agree and are sure; else cursive."""
    packed = F.regexp_replace(body, r"\s+", "")
    share = df.groupBy(line).agg(F.sum(F.length(packed)).alias("all"), F.sum(F.length(F.regexp_replace(packed, r"[^0-9.,+\-/%()=]", ""))).alias("numeric"), F.max(packed.rlike("[0-9]")).alias("digit"))
    printed = df.where(printing & (F.trim(body) != "")).select(line, F.col(body).alias("__a"), F.col(confidence).alias("__c"), F.monotonically_increasing_id().alias("__i"))
    held = printed.groupBy(line).agg(F.collect_list(F.struct("__i", "__a", "__c")).alias("__r"))  # a line's readings, one an engine
    near = lambda p, q: F.when(p["__i"] < q["__i"], text.norm_distance(p["__a"], q["__a"]))
    apart = F.array_compact(F.flatten(F.transform("__r", lambda p: F.transform("__r", lambda q: near(p, q)))))
    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x) / F.size(xs)
    held = held.where(F.size("__r") >= 2).select(line, (1 - mean(apart)).alias("agree"), mean(F.transform("__r", lambda p: p["__c"].cast("double"))).alias("sure"))
    rows = share.join(held, line, "left")
    kind = F.when((F.col("all") > 0) & (F.col("numeric") / F.nullif("all", F.lit(0)) >= numeric) & F.col("digit"), "numeric").when((F.col("agree") >= alike) & (F.col("sure") >= sure), "print").otherwise("cursive")
    return rows.select(line, kind.alias("class"))


def orientation(df: DataFrame, page: str, side: str, body: str, confidence: str, margin: float = 0.1, least: int = 40) -> DataFrame:
    """page, upright, turned, decided, turn: confidences weighted by characters of the readings of a page as it is and turned; it is turned if enough was read and turned reads better by the margin."""
    n = F.length(F.trim(body))
    q = lambda k, what: F.sum(F.when(F.col(side) == k, what))
    quality = lambda k: F.round(F.coalesce(q(k, F.col(confidence) * n) / F.nullif(q(k, n), F.lit(0)), F.lit(0.0)), 4)
    rows = df.groupBy(page).agg(quality("upright").alias("upright"), quality("turned").alias("turned"), (F.greatest(F.coalesce(q("upright", n), F.lit(0)), F.coalesce(q("turned", n), F.lit(0))) >= least).alias("decided"))
    return rows.withColumn("turn", F.col("decided") & (F.round(F.col("turned") - F.col("upright"), 4) >= margin))


def merge_pieces(df: DataFrame, line: str, x: str, body: str, confidence: str) -> DataFrame:
    """An engine's pieces of a line from left to right, with a confidence weighted by their lengths."""
    w = F.greatest(F.length(F.trim(body)), F.lit(1))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(x, body))), lambda p: p[body])
    return df.groupBy(line).agg(F.array_join(parts, " ").alias("text"), (F.sum(F.col(confidence) * w) / F.sum(w)).alias("confidence"))


def competing(in_set: Column, line: Column) -> Column:
    """Readings that compete: those of the class's set, or all where a line has none of them."""
    return in_set | ~F.max(in_set).over(Window.partitionBy(line))
