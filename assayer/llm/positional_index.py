"""Benchmark decontamination by a positional inverted index, in DataFrame functions alone.

The index holds a posting (term, row, position) for every occurrence, in any document, of a term that a test item has, as Parquet sorted by term within each part of the documents; parts are segments, so the documents are not shuffled. A posting of the term HEAD stands for a document itself. Terms are numbers of a dictionary that is joined by the words themselves, so no hash decides about equality.

Phrases: an item is cut into windows of `width` consecutive words, and the terms of a window are ordered by how often the documents have them. The rarest term's postings, less its offset, give starts; they are intersected with the offset-adjusted postings of the next rarest term, and what is left with those of all others, read from the documents that are left only. Work and shuffles follow the postings of rare terms, not the number of words.

Proximity: an occurrence of an item's rarest term counts if each other term of the item has a posting at most `within` words away.

Dictionary, windows' terms and the documents left after two terms are broadcast where their measured size is within BROADCAST_BYTES; beyond it the same joins are shuffled.

Null texts have no words, nor have texts of separators only; such documents get a row, such items no window. An item with fewer words than `width` is one window. Rows that repeat a doc_id, or whole rows, are documents of their own; items that share an item_id are one item; a null item_id is written as the empty text. Without documents the result is empty; without items no document is hit. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.common import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The number of the term that stands for a document itself; its word is empty, which no word of a text is.
HEAD = -1
#: A table is broadcast only if its measured size is within this.
BROADCAST_BYTES = 16 << 20


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def limited(small: DataFrame, text: Column | None = None) -> DataFrame:
    """Marked for broadcast if its rows, at 64 bytes each and the bytes of `text`, are few enough; else as it is, and Spark shuffles both sides."""
    size = F.lit(64) if text is None else F.lit(64) + F.octet_length(text)
    held = small.agg(F.sum(size.cast("long")).alias("n")).first()["n"] or 0
    return F.broadcast(small) if held <= BROADCAST_BYTES else small


def numbered(terms: DataFrame) -> DataFrame:
    """term, id: the distinct words of a column `term` with numbers, and the empty word as HEAD."""
    spark = terms.sparkSession
    known = terms.where("term <> ''").select("term").distinct().select("term", F.monotonically_increasing_id().alias("id"))
    return staged(known.unionByName(spark.createDataFrame([("", HEAD)], "term string, id long")), "terms")


@dataclass(frozen=True)
class Index:
    """terms: term, id. postings: term, row, pos of every occurrence; rows of the term HEAD have a document's n_words and doc_id."""

    terms: DataFrame
    postings: DataFrame

    def documents(self) -> DataFrame:
        return self.postings.where(F.col("term") == HEAD).select("row", "doc_id", "n_words")

    def occurrences(self) -> DataFrame:
        return self.postings.where(F.col("term") != HEAD).select("term", "row", "pos")

    def frequencies(self) -> DataFrame:
        return self.occurrences().groupBy("term").agg(F.count("*").alias("n"))


def build(docs: DataFrame, terms: DataFrame) -> Index:
    """The index of docs(doc_id, text) for the words in terms(term)."""
    known = numbered(terms)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words(F.col("text")).alias("words"))
    tokens = rows.select("row", "doc_id", F.size("words").alias("n"), F.posexplode(F.concat(F.array(F.lit("")), "words")).alias("at", "word"))
    found = tokens.join(limited(known, F.col("term")), F.col("word") == F.col("term"))
    head = F.col("at") == 0
    postings = found.select(F.col("id").alias("term"), "row", (F.col("at") - 1).alias("pos"), F.when(head, F.col("n").cast("long")).alias("n_words"), F.when(head, F.col("doc_id")).alias("doc_id"))
    return Index(known, staged(postings.sortWithinPartitions("term", "row", "pos"), "postings"))


def item_words(items: DataFrame) -> DataFrame:
    """item, words of items(item_id, text) that have words."""
    return items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("words")).where(F.size("words") > 0)


def item_terms(items: DataFrame) -> DataFrame:
    """term: every word of items(item_id, text)."""
    return item_words(items).select(F.explode("words").alias("term"))


def ranked(offsets: DataFrame, index: Index) -> DataFrame:
    """id, width, off, term, role of offsets(id, width, off, word): role 1 is the term that documents have least. Ids with a term that no document has are left out."""
    numbers = offsets.join(limited(index.terms, F.col("term")), F.col("word") == F.col("term")).select(offsets["id"], "width", "off", index.terms["id"].alias("term"))
    counted = numbers.join(limited(index.frequencies()), "term", "left").select("id", "width", "off", "term", F.coalesce("n", F.lit(0)).alias("n"))
    own = Window.partitionBy("id")
    placed = counted.select("*", F.row_number().over(own.orderBy("n", "term", "off")).alias("role"), F.min("n").over(own).alias("least"))
    return staged(placed.where("least > 0").select("id", "width", "off", "term", "role"), "roles")


def only(postings: DataFrame, roles: DataFrame) -> DataFrame:
    """Postings of the terms of some roles."""
    return postings.join(limited(roles.select("term").distinct()), "term", "left_semi")


def phrases(index: Index, windows: DataFrame) -> DataFrame:
    """id, width, row, start: every occurrence of windows(id, terms), terms being words."""
    offsets = windows.select("id", F.size("terms").alias("width"), F.posexplode("terms").alias("off", "word"))
    roles = ranked(offsets, index)
    postings = index.occurrences()
    role = lambda k: roles.where(F.col("role") == k)
    first = postings.join(limited(role(1)), "term").select("id", "width", "row", (F.col("pos") - F.col("off")).alias("start")).where("start >= 0")
    second = role(2)
    asked = first.where("width > 1").join(limited(second.select("id", "off", "term")), "id").select("id", "width", "row", "start", "term", (F.col("start") + F.col("off")).alias("pos"))
    pairs = asked.join(only(postings, second), ["term", "row", "pos"]).select("id", "width", "row", "start")
    left = staged(first.where("width = 1").unionByName(pairs), "candidates")
    rest = left.where("width > 2").join(limited(roles.where("role > 2").select("id", "off", "term")), "id").select("id", "width", "row", "start", "term", (F.col("start") + F.col("off")).alias("pos"))
    there = postings.join(limited(left.where("width > 2").select("row").distinct()), "row", "left_semi")
    met = rest.join(there, ["term", "row", "pos"]).groupBy("id", "width", "row", "start").agg(F.count("*").alias("n"))
    return left.where("width <= 2").unionByName(met.where("n = width - 2").drop("n"))


def near(index: Index, items: DataFrame, within: int) -> DataFrame:
    """item, row, pos: occurrences of each item's rarest term that have every other term of the item at most `within` words away."""
    distinct = item_words(items).select("item", F.array_distinct("words").alias("terms"))
    at = distinct.select("item", F.monotonically_increasing_id().alias("id"), "terms")
    at = staged(at, "items")
    roles = ranked(at.select("id", F.size("terms").alias("width"), F.posexplode("terms").alias("off", "word")), index)
    postings, span = index.occurrences(), 2 * within + 1
    first = postings.join(limited(roles.where("role = 1")), "term").select("id", "width", "row", "pos")
    asked = first.where("width > 1").join(limited(roles.where("role > 1").select("id", "term")), "id")
    asked = asked.select("*", F.explode(F.array_distinct(F.array(F.floor((F.col("pos") - within) / span), F.floor((F.col("pos") + within) / span)))).alias("cell"))
    others = only(postings, roles.where("role > 1")).select("term", "row", F.col("pos").alias("other"), F.floor(F.col("pos") / span).alias("cell"))
    met = asked.join(others, ["term", "row", "cell"]).where(F.abs(F.col("other") - F.col("pos")) <= within)
    met = met.groupBy("id", "width", "row", "pos").agg(F.countDistinct("term").alias("n")).where("n = width - 1")
    found = first.where("width = 1").select("id", "row", "pos").unionByName(met.select("id", "row", "pos"))
    return found.join(limited(at.select("id", "item"), F.col("item")), "id").select("item", "row", "pos")


def windows_of(items: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """windows(id, terms), all different, and members(id, item)."""
    spans = item_words(items).select("item", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - F.lit(width - 1), F.lit(1))), lambda i: F.slice("words", i, F.lit(width)))).alias("terms"))
    windows = staged(spans.select("terms").distinct().select(F.monotonically_increasing_id().alias("id"), "terms"), "windows")
    return windows, spans.join(windows, "terms").select("id", "item").distinct()


def contamination(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: words of each of docs(doc_id, text) inside an occurrence of a window of items(item_id, text), and the items whose windows occur, digested as their ids sorted as texts and joined by commas."""
    index = build(docs, item_terms(items))
    windows, members = windows_of(items, width)
    matches = staged(phrases(index, windows), "matches")
    before = Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    spots = matches.groupBy("row", "start").agg(F.max(F.col("start") + F.col("width")).alias("end"))
    fresh = spots.select("row", F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0)))).alias("fresh"))
    hits = fresh.groupBy("row").agg(F.sum("fresh").alias("n_hit"))
    named = matches.select("row", "id").distinct().join(members, "id").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    rows = index.documents().join(hits, "row", "left").join(named, "row", "left")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    hit = F.coalesce(F.col("n_hit").cast("long"), F.lit(0).cast("long"))
    return rows.select("doc_id", "n_words", hit.alias("n_hit"), F.size(items_of).cast("long").alias("n_items"), F.sha2(F.array_join(items_of, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))
