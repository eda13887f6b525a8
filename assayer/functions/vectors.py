"""Vectors: cosine similarity, centroids, hashed trigrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """In [0, 1]; 0 for a zero vector."""
    return F.when((norm(a) == 0) | (norm(b) == 0), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(a, b) / (norm(a) * norm(b)))))


def centroids(df: DataFrame, key: str, vector: str) -> DataFrame:
    """The mean vector of a key, component by component, so that partial sums meet before the shuffle."""
    at = df.select(key, F.posexplode(vector).alias("at", "x")).groupBy(key, "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return at.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("centroid"))


#: Words that say nothing about a question.
QUESTION_WORDS = "the a an and or of to in on for is are was were be by with as at from that this it its which what who whom how why when where explain write discuss describe briefly short note notes any five four two three state give list".split()


def trigram_slots(df: DataFrame, key: str, text: str, slots: int = 1024) -> DataFrame:
    """key, slot, weight: of words with three letters or more that say something, counts of hashed trigrams of the padded word (1 each) and of the word (2 each)."""
    word = df.select(key, F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit("([a-z0-9]+)"), F.lit(1))).alias("w"))
    word = word.where((F.length("w") >= 3) & ~F.col("w").isin(QUESTION_WORDS))
    padded = F.concat(F.lit(" "), F.col("w"), F.lit(" "))
    grams = F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: F.struct(F.substr(padded, i, F.lit(3)).alias("gram"), F.lit(1).alias("n")))
    whole = F.array(F.struct(F.concat(F.lit("w:"), F.col("w")).alias("gram"), F.lit(2).alias("n")))
    parts = word.select(key, F.explode(F.concat(grams, whole)).alias("g"))
    return parts.groupBy(key, F.pmod(F.crc32("g.gram"), F.lit(slots)).cast("int").alias("slot")).agg(F.sum("g.n").alias("weight"))


def top_mean(values: Column, k: int = 3) -> Column:
    """The mean of the k largest of an array."""
    top = F.slice(F.sort_array(values, asc=False), 1, k)
    return F.aggregate(top, F.lit(0.0), lambda s, x: s + x) / F.size(top)
