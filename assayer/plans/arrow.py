"""Queries that need Arrow-batched functions: they have tests of their own instead of SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions import labels, udfs
from assayer.functions.text import tokens
from assayer.registry import Tables, query


@query()
def str_normalise_label(t: Tables) -> DataFrame:
    return t.pages.select("page_id", udfs.normalise_label("url").alias("label"))


@query()
def str_split_sentences(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.posexplode(udfs.sentences("text")).alias("at", "sentence")).select("conv_id", "turn", "at", F.sha2("sentence", 256).alias("h"))


@query()
def str_extract_numbers(t: Tables) -> DataFrame:
    """Numbers with units, of addresses as lines of words and of texts."""
    lines = t.pages.select("page_id", F.regexp_replace("url", "[/=#?&]+", " ").alias("text"))
    return lines.select("page_id", F.explode(udfs.extract_numbers("text")).alias("n")).select("page_id", F.col("n.value").cast("double").alias("value"), F.col("n.unit").alias("unit"))


def labelled_lines(t: Tables) -> DataFrame:
    """Lines of the conversations' texts, the first of a turn with an answer's label in one of the ways in which labels are written."""
    line = t.conversations.select("conv_id", "turn", "role", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    n = (F.col("turn") + 1).cast("string")
    forms = [F.concat(F.lit("Q no. "), n, F.lit(". ")), F.concat(n, F.lit(") b) ")), F.concat(F.lit("Ans "), n, F.lit(": ")), F.concat(n, F.lit(". ")), F.lit("Section - B "), F.lit("(ii) "), F.lit("")]
    form = F.element_at(F.array(*forms), F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(forms))).cast("int") + 1)
    return line.withColumn("line", F.when(F.col("at") == 0, F.concat(form, "line")).otherwise(F.col("line")))


@query()
def str_parse_label(t: Tables) -> DataFrame:
    rows = labelled_lines(t).select("conv_id", "turn", "at", labels.parse_label("line").alias("l"))
    return rows.where("l.kind IS NOT NULL").select("conv_id", "turn", "at", "l.kind", "l.number", "l.part", "l.section", "l.strong")


def near_words(words: DataFrame) -> DataFrame:
    """w, x: words of a vocabulary (w) that may be within two edits of each other, a swap of neighbours being one. Each stands under itself and all it becomes by leaving out up to two characters; two words within two edits have one of these in common."""
    w = F.col("w")
    n = F.length(w)
    without = lambda text, i: F.concat(F.substr(text, F.lit(1), i - 1), F.substr(text, i + 1))
    places = lambda text: F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(F.array().cast("array<int>"))
    once = F.transform(places(w), lambda i: without(w, i))
    twice = F.flatten(F.transform(once, lambda v: F.transform(places(v), lambda i: without(v, i))))
    keys = words.select("w", F.explode(F.array_distinct(F.concat(F.array(w), once, twice))).alias("key"))
    met = keys.join(keys.withColumnRenamed("w", "x"), "key").where("w < x")
    return met.select("w", "x").distinct().where(F.abs(F.length("w") - F.length("x")) <= 2)


def _vocabulary(t: Tables) -> DataFrame:
    return t.benchmark.select(F.explode(tokens(F.col("text"))).alias("w")).distinct()


@query()
def str_osa(t: Tables) -> DataFrame:
    """Pairs of words within two edits, with their distance."""
    return near_words(_vocabulary(t)).select("w", "x", udfs.osa("w", "x").alias("distance")).where("distance <= 2")


@query()
def str_word_match(t: Tables) -> DataFrame:
    """Key words with the words that may stand for them: two edits are the most that any word allows."""
    near = near_words(_vocabulary(t))
    both = near.select(F.col("w").alias("key"), F.col("x").alias("written")).union(near.select("x", "w"))
    return both.where(udfs.words_match("key", "written"))


@query()
def mth_label_distance(t: Tables) -> DataFrame:
    return near_words(_vocabulary(t)).select("w", "x", F.round(udfs.osa("w", "x") / F.greatest(F.length("w"), F.length("x")), 6).alias("share"))


@query()
def str_find_phrase(t: Tables) -> DataFrame:
    """Where a turn says what the turn before it began with: its first three words."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = t.conversations.select("conv_id", "turn", "text", before.alias("before")).where("before IS NOT NULL")
    phrase = F.array_join(F.slice(tokens(F.col("before")), 1, 3), " ")
    return rows.select("conv_id", "turn", F.size(udfs.find_phrase(phrase, "text")).alias("hits"))
