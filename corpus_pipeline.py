"""A corpus pipeline of five stages, each over all that its predecessor kept.

run(spark, sf_dir) applies the stages to the documents table; every stage's result is written as Parquet in the shared folder and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import hyper_minhash, language_id, packing, suffix_dedup, toxicity
from assayer.llm.common import small_batches, staged

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language by their code length; those without text or letters go, and those far from every language learned. A null lang is filled. Where no language could be learned, or the document's own couldn't, those with a letter stay."""
    small_batches(spark)
    half, trees, limit = language_id.halves(docs, F.lit(True))
    found = language_id.identify(docs, trees[0], *COLUMNS, limit=limit, other=(half, trees[1]))
    unlearned = F.coalesce(~F.col("lang").isin(*limit), F.lit(False)) & (F.col("lang_pred") != "und")
    lang = F.coalesce("lang", F.expr("nullif(lang_pred, 'und')")).alias("lang")
    return found.where(F.col("known") | unlearned).select(*[lang if c == "lang" else c for c in COLUMNS])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5, learned from the labels of the documents that are left."""
    small_batches(spark)
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
    return toxicity.score(docs, model, *COLUMNS).where("score < 0.5").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id."""
    small_batches(spark)
    kept = hyper_minhash.near_duplicates(docs, 75).where("kept").select(F.col("doc_id").alias("kept_id"))
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur twice; what is left of a document stays under its id, with the other columns as they were but for n_chars."""
    small_batches(spark)
    cut = suffix_dedup.remove_repeats(docs, text=True, carry=("lang", "source"))
    carried = F.from_json("carried", "lang string, source string")
    return cut.select("doc_id", "text", carried["lang"].alias("lang"), carried["source"].alias("source"), F.char_length("text").cast("long").alias("n_chars"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens, mixed by source."""
    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 1024, 0)


STAGES = [
    ("language_id", identify_language),
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("packing", pack_sequences),
]

#: SQL can't express the stages; tests/llm holds each against a brute-force version or a held-out part.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
