"""Canonical exact digests of documents, in DataFrame functions only.

The canonical text is the text in Unicode normal form C, case-folded (upper, then lower, which also folds sharp s), with every run of white space as one space and none at the ends. Its fingerprint is two 64-bit xxhashes. Documents are grouped by it, and inside a group the canonical texts are compared byte by byte: where they differ, the SHA-256 of each text follows its hash, so that equal fingerprints mean equal canonical texts.

Spark has no normalize function, but the Unicode library that it ships for its collations has; SQL's java_method calls it for texts with a character above U+02FF, below which nothing composes or moves.

Nulls: a null text counts as empty. A row without doc_id has no next document: its edited text loses its tail, near_next is 0. Repeated ids: the next document of an id is the next smaller id; if that has several rows, the smallest text of them. Every row gives a row; an empty table gives none. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.common import staged

#: White space as Unicode has it.
SPACES = r"[\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
#: A static method from a text to its normal form C.
COMPOSE = ("com.ibm.icu.text.Normalizer", "compose")


def nfc(text: Column) -> Column:
    """Unicode normal form C."""
    return F.when(text.rlike(r"[^\x{0}-\x{2ff}]"), F.java_method(*map(F.lit, COMPOSE), text, F.lit(False))).otherwise(text)


def canonical(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.upper(nfc(text))), SPACES, " "))


def wide_hash(text: Column) -> Column:
    """128 bits of xxhash in hexadecimal."""
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(text)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(1), text)), 16, "0")))


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def uneven(docs: DataFrame, digest: Callable[[Column], Column] = wide_hash) -> DataFrame | None:
    """The hashes whose canonical texts differ in any byte; as a rule there are none, which is None. A task's copies of a text meet before the shuffle."""
    rows = texts_of(docs).select(canonical(F.col("text")).alias("body")).select(digest(F.col("body")).alias("hash"), "body")
    found = staged(rows.groupBy("hash").agg(F.count_distinct("body").alias("n")).where("n > 1").select("hash"), "uneven")
    return None if found.isEmpty() else found


def told_apart(rows: DataFrame, apart: DataFrame | None, hash_name: str, body: Column, out: str) -> DataFrame:
    """rows with the column `out`: the hash, in an uneven bucket followed by the SHA-256 of the body."""
    if apart is None:
        return rows.withColumn(out, F.col(hash_name))
    marked = rows.join(apart.select(F.col("hash").alias("__h"), F.lit(True).alias("__apart")), F.col(hash_name) == F.col("__h"), "left")
    return marked.withColumn(out, F.when(F.col("__apart"), F.concat_ws("-", hash_name, F.sha2(body, 256))).otherwise(F.col(hash_name))).drop("__h", "__apart")


def fingerprinted(rows: DataFrame, apart: DataFrame | None, digest: Callable[[Column], Column] = wide_hash) -> DataFrame:
    """rows with the hash and the fingerprint of their text."""
    rows = rows.withColumn("body", canonical(F.col("text"))).withColumn("hash", digest(F.col("body")))
    return told_apart(rows, apart, "hash", F.col("body"), "fingerprint").drop("body")


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, group_id (the smallest doc_id of the documents with this fingerprint)."""
    rows = fingerprinted(texts_of(docs), uneven(docs)).select("doc_id", "fingerprint")
    return rows.join(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("group_id")), "fingerprint").select("doc_id", "fingerprint", "group_id")


def next_smaller(values: DataFrame, levels: int = 4) -> DataFrame:
    """v, following: the next smaller of distinct longs v, null for the smallest. A window sees at most the 65,536 values that share all but the lowest 16 bits; between such ranges the same holds for the higher bits."""
    if not levels:  # what is left of 64 bits
        return values.select("v", F.lead("v").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("v"))).alias("following"))
    ranged = values.select("v", F.shiftright("v", 16).alias("g"))
    own = ranged.withColumn("inside", F.lead("v").over(Window.partitionBy("g").orderBy(F.desc("v"))))
    tops = ranged.groupBy("g").agg(F.max("v").alias("top"))
    below = next_smaller(tops.select(F.col("g").alias("v")), levels - 1).select(F.col("v").alias("g"), F.col("following").alias("g2"))
    across = below.join(tops.select(F.col("g").alias("g2"), F.col("top").alias("outside")), "g2").select("g", "outside")
    return own.join(across, "g", "left").select("v", F.coalesce("inside", "outside").alias("following"))


def edited_fingerprints(docs: DataFrame, digest: Callable[[Column], Column] = wide_hash) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of docs(doc_id, text).

    The edited text has its last third replaced by the head of the next document, by descending doc_id (after the last: the first). Fingerprints are exact, so a likeness is 1 or 0. Texts are shuffled once by id; of the next document only the part that is needed moves.
    """
    rows, apart = texts_of(docs), uneven(docs, digest)
    placed = rows.where("doc_id is not null")
    need = F.floor(F.char_length("text") / 3).cast("int").alias("need")
    ids = staged(placed.select(F.col("doc_id").cast("long").alias("v"), need).groupBy("v").agg(F.max("need").alias("need")), "ids")
    first = ids.agg(F.max("v").alias("first"))
    links = next_smaller(ids.select("v")).crossJoin(F.broadcast(first)).select("v", F.coalesce("following", "first").alias("following")).join(ids, "v")  # one row on the right
    # both joins deal the same rows by doc_id, so that texts are shuffled once
    heads = fingerprinted(placed.join(links, F.col("doc_id") == F.col("following")), apart, digest)
    heads = heads.select("v", F.struct(F.expr("substring(text, 1, need)").alias("head"), F.col("fingerprint").alias("next_fingerprint")).alias("h")).groupBy("v").agg(F.min("h").alias("h"))
    joined = placed.join(heads.select("v", "h.head", "h.next_fingerprint"), F.col("doc_id") == F.col("v")).drop("v")
    nowhere = rows.where("doc_id is null").withColumn("head", F.lit("")).withColumn("next_fingerprint", F.lit(None).cast("string"))
    joined = fingerprinted(joined.unionByName(nowhere), apart, digest).withColumn("n_chars", F.char_length("text").cast("long"))
    third = "cast(floor(n_chars / 3) as int)"
    edited = joined.withColumn("edited", F.concat(F.expr(f"substring(text, 1, cast(n_chars as int) - {third})"), F.coalesce(F.expr(f"substring(head, 1, {third})"), F.lit(""))))
    edited = edited.withColumn("edited_body", canonical(F.col("edited"))).withColumn("edited_hash", digest(F.col("edited_body")))
    meets = F.col("hash") == F.col("edited_hash")
    edited = edited.withColumn("same", F.when(meets, canonical(F.col("text")) == F.col("edited_body")).otherwise(False))
    edited = told_apart(edited, apart, "edited_hash", F.col("edited_body"), "edited_fingerprint")
    fresh = F.when(meets & ~F.col("same") & (F.col("edited_fingerprint") == F.col("edited_hash")), F.concat_ws("-", "edited_hash", F.sha2("edited_body", 256))).otherwise(F.col("edited_fingerprint"))
    near_next = F.coalesce((F.col("fingerprint") == F.col("next_fingerprint")).cast("double"), F.lit(0.0))
    return edited.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", fresh.alias("edited_fingerprint"), F.col("same").cast("double").alias("near_edited"), near_next.alias("near_next"))
