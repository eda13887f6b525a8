"""Token counts by a digest cache.

A cache is a Parquet table (tokenizer, digest, n_tokens), with a folder for each tokenizer. A run joins the distinct digests of its texts to it, encodes one text for each digest that is missing, appends those counts and joins them back. Texts are shuffled only if many digests are missing. compacted() writes a cache that many runs have appended to as few files.

Normalised content is the text with null read as empty, as UTF-8 bytes: anything more would change counts. The tokenizer's digest covers its file and its library's version, so another version never meets old counts.

Nulls: a null text counts as empty (0 tokens). A null doc_id stays null. Repeated rows each give a row. An empty table gives no row. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import new_path, staged

CACHE = "digest binary, n_tokens long, tokenizer string"
#: Up to so many missing digests, of 32 bytes, go to where the texts are.
FEW = 30_000
#: A digest with more than one in HOT of all rows is joined by broadcast; there are fewer than HOT of them.
HOT = 1000


def tokenizer_digest(path: str) -> str:
    """Of the tokenizer's file and of the version of the library that reads it."""
    import sentencepiece
    import tokenizers

    library = sentencepiece if path.endswith(".model") else tokenizers
    return hashlib.sha256(Path(path).read_bytes() + f"{library.__name__} {library.__version__}".encode()).hexdigest()


def counter(path: str):
    """A function from a text to its number of tokens."""
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(pieces.encode(text, num_threads=1))
    from assayer.llm.pretokens import byte_bpe

    encoder = byte_bpe(path)
    return lambda text: len(encoder.ids(text))


def known_counts(docs: DataFrame, cache: str, version: str) -> DataFrame:
    """digest, n_tokens of a tokenizer; two runs may have appended the same digest."""
    known = docs.sparkSession.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == version)
    return known.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def compacted(docs: DataFrame, cache: str, to: str, files: int = 8) -> None:
    """Writes the cache anew, each digest once and in sorted files, to another folder, which later runs are given instead."""
    rows = docs.sparkSession.read.schema(CACHE).parquet(cache).groupBy("tokenizer", "digest").agg(F.max("n_tokens").alias("n_tokens"))
    rows.select("digest", "n_tokens", "tokenizer").repartitionByRange(files, "tokenizer", "digest").sortWithinPartitions("digest").write.partitionBy("tokenizer").parquet(to)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, cache: str | None = None, few: int = FEW) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of docs(doc_id, text).

    cache: a folder all executors reach; without one a new cache starts in the shared folder. Copies of a text meet before the shuffle (a partial aggregate keeps one a digest and task), and the counts of frequent digests go to their rows, so a frequent text makes no hot task. few: so many missing digests are broadcast.
    """
    spark, version = docs.sparkSession, tokenizer_digest(tokenizer)
    cache = cache or new_path(spark, "token-cache")
    spark.createDataFrame([], CACHE).write.mode("append").partitionBy("tokenizer").parquet(cache)
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    rows = staged(texts.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    seen = staged(rows.groupBy("digest").agg(F.count("*").alias("n")), "distinct-digests")
    known = known_counts(docs, cache, version)
    missing = staged(seen.select("digest").join(known, "digest", "left_anti"), "missing-digests")
    if missing.count() <= few:
        to_encode = texts.select("digest", "text").join(F.broadcast(missing), "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text"))
    else:
        to_encode = texts.groupBy("digest").agg(F.first("text").alias("text")).join(missing, "digest", "left_semi")

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(tokenizer)
        for x in frames:
            yield pd.DataFrame({"digest": x["digest"], "n_tokens": [count(t) for t in x["text"]], "tokenizer": version})

    to_encode.mapInPandas(encode, CACHE).write.mode("append").partitionBy("tokenizer").parquet(cache)
    counts = known_counts(docs, cache, version)
    total = seen.agg(F.sum("n").alias("n")).first()["n"] or 0
    often = seen.where(F.col("n") * HOT > total).select("digest")
    often_counts = F.broadcast(counts.join(often, "digest", "left_semi"))  # fewer than HOT rows
    columns = ("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    rest = rows.join(often_counts, "digest", "left_anti").join(counts, "digest")
    return rows.join(often_counts, "digest").select(*columns).unionByName(rest.select(*columns))
