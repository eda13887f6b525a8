"""Sources: folders of files, archives, rosters, manifests, annotations, word lists."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions.text import natural_key

#: The first bytes of the media that are taken.
MEDIA = {"pdf": b"%PDF-", "jpeg": b"\xff\xd8\xff", "png": b"\x89PNG\r\n\x1a\n"}
#: Limits of an uploaded archive and of a roster.
ARCHIVE_FILES, ROSTER_ROWS = 200, 5000


def media_kind(content: Column) -> Column:
    """pdf, jpeg or png by first bytes, else null."""
    kind = F.lit(None).cast("string")
    for name, head in MEDIA.items():
        kind = F.when(F.substring(content, 1, len(head)) == F.lit(head), name).otherwise(kind)
    return kind


def files(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("pdf", "jpg", "jpeg", "png"), by: Column | None = None) -> DataFrame:
    """Files of a folder by extension, hidden ones left out: path, length, content and place, which sorts by the natural order of their names or of what `by` makes of their paths."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    kept = found.where(~name.startswith(".") & F.lower(F.element_at(F.split(name, r"\."), -1)).isin(*extensions))
    return kept.select("path", "length", "content", natural_key(name if by is None else by).alias("place"))


def folder(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("pdf", "jpg", "jpeg", "png"), by: Column | None = None) -> DataFrame:
    """The files of a folder in their order."""
    return files(spark, path, extensions, by).orderBy("place")


def members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The members of archives, a frame an archive: a worker holds the files of one at a time."""
    for x in frames:
        for path, content in zip(x["path"], x["content"], strict=True):
            rows: list[tuple] = []
            try:
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    files = [m for m in tar if m.isfile()]
                    if len(files) > ARCHIVE_FILES:
                        rows.append((path, None, None, "too many files"))
                    else:
                        rows += [(path, m.name, tar.extractfile(m).read(), None) for m in files]
            except tarfile.TarError:
                rows.append((path, None, None, "not an archive"))
            if rows:
                yield pd.DataFrame(rows, columns=["path", "member", "content", "error"])


def archive_members(files: DataFrame) -> DataFrame:
    """Members of tar archives in rows(path, content): path, member, content; more than ARCHIVE_FILES members are an error row."""
    return files.select("path", "content").mapInPandas(members, "path string, member string, content binary, error string")


def roster(lines: DataFrame) -> DataFrame:
    """Rows(line, usn, name) of a roster with the error of each, if any: missing, too long a file, or a number seen before (naming its first line)."""
    usn = F.upper(F.regexp_replace("usn", r"\s+", ""))
    rows = lines.select("line", usn.alias("usn"), F.trim("name").alias("name"))
    first = rows.groupBy("usn").agg(F.min("line").alias("first_line"))
    error = F.when(F.col("usn").isNull() | (F.col("usn") == ""), "roll number missing").when(F.col("name").isNull() | (F.col("name") == ""), "name missing").when(F.col("line") > ROSTER_ROWS + 1, "too many rows")
    error = error.when(F.col("first_line") < F.col("line"), F.concat(F.lit("same roll number as line "), F.col("first_line").cast("string")))
    return rows.join(first, "usn", "left").select("line", "usn", "name", error.alias("error"))


def verified_truth(manifest: DataFrame) -> DataFrame:
    """Lines of a ground-truth manifest that a person has verified; a line without status counts as verified."""
    return manifest.where(F.coalesce("status", F.lit("verified")) == "verified")


def answer_set(answers: DataFrame, marks: DataFrame, questions: DataFrame) -> DataFrame:
    """Answers with their mark (an override wins) and their question's maximum; unmarked ones are left out."""
    rows = answers.join(marks.select("id", F.col("mark").alias("__override")), "id", "left").withColumn("mark", F.coalesce("__override", "teacher_mark")).drop("__override")
    return rows.where("mark IS NOT NULL").join(questions, rows["question"] == questions["code"])


def split_weight(total: Column, n: Column, i: Column) -> Column:
    """The i-th (from 0) of n parts of a total in cents that add up exactly: the remainder lies on the last."""
    part = F.floor(total / n)
    return F.when(i == n - 1, total - part * (n - 1)).otherwise(part)


def annotation_xml(spark: SparkSession, path: str) -> DataFrame:
    """file, label and box of each object in annotation files."""
    rows = spark.read.format("xml").option("rowTag", "annotation").load(path)
    return rows.select("filename", F.explode("object").alias("o")).select("filename", F.col("o.name").alias("label"), "o.bndbox.*")


def cloud_lines(raw: DataFrame) -> DataFrame:
    """Lines of a text detection service's JSON in rows(id, body): text, confidence and box of LINE blocks."""
    schema = "Blocks array<struct<BlockType:string,Text:string,Confidence:double,Geometry:struct<BoundingBox:struct<Left:double,Top:double,Width:double,Height:double>>>>"
    b = raw.select("id", F.explode(F.from_json("body", schema)["Blocks"]).alias("b")).where("b.BlockType = 'LINE'")
    box = "b.Geometry.BoundingBox"
    return b.select("id", F.col("b.Text").alias("text"), (F.col("b.Confidence") / 100).alias("confidence"), F.struct(F.col(f"{box}.Left").alias("x0"), F.col(f"{box}.Top").alias("y0"), (F.col(f"{box}.Left") + F.col(f"{box}.Width")).alias("x1"), (F.col(f"{box}.Top") + F.col(f"{box}.Height")).alias("y1")).alias("box"))


def known_words(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Words of rows(w) that a lexicon(w) has, with or without a possessive ending."""
    plain = words.withColumn("__bare", F.regexp_replace(F.lower("w"), r"['’]s$", ""))
    return plain.join(lexicon.select(F.lower("w").alias("__bare")).distinct(), "__bare", "left_semi").drop("__bare")


def marker_events(paths: DataFrame) -> DataFrame:
    """College and booklet of rows(path) that are completion markers college/<id>/booklets/<id>/_complete."""
    shape = r"college/([^/]+)/booklets/([^/]+)/_complete$"
    return paths.where(F.col("path").rlike(shape)).select(F.regexp_extract("path", shape, 1).alias("college_id"), F.regexp_extract("path", shape, 2).alias("booklet_id"))


#: How a corpus writes brackets.
BRACKETS = {"-LRB-": "(", "-RRB-": ")", "-LSB-": "[", "-RSB-": "]", "-LCB-": "{", "-RCB-": "}"}


def clean_markup(text: Column) -> Column:
    """Without tags, with plain brackets and single spaces, none inside brackets."""
    for token, char in BRACKETS.items():
        text = F.replace(text, F.lit(token), F.lit(char))
    text = F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^>]*>", " "), r"\s+", " "))
    return F.regexp_replace(F.regexp_replace(text, r"([(\[{])\s+", "$1"), r"\s+([)\]}])", "$1")


def zipped_answers(answers: DataFrame, grades: DataFrame) -> DataFrame:
    """id, question, text, mark of parallel files' lines(code, pos, line), which belong together by position; the first word of an answer's line is its number. Files of unequal lengths give one row with an error."""
    a = answers.select("code", "pos", clean_markup(F.regexp_replace("line", r"^\S*\s?", "")).alias("text"))
    both = a.join(grades.select("code", "pos", F.col("line").cast("double").alias("mark"), F.lit(True).alias("__there")), ["code", "pos"], "full").withColumn("__pair", F.col("text").isNotNull() & F.col("__there"))
    uneven = both.groupBy("code").agg(F.min(F.coalesce("__pair", F.lit(False))).alias("ok"))
    rows = both.join(uneven, "code").where("ok").select(F.concat_ws(":", "code", F.col("pos").cast("string")).alias("id"), F.col("code").alias("question"), "text", "mark", F.lit(None).cast("string").alias("error"))
    return rows.unionByName(uneven.where("NOT ok").select(F.lit(None).cast("string").alias("id"), F.col("code").alias("question"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("double").alias("mark"), F.lit("answers and grades are not as many").alias("error")))


SAMPLE = "image string, width int, height int, objects array<struct<class:string,box:array<double>>>, arrows array<struct<box:array<double>,has_head:boolean>>, edges array<array<int>>"


def diagram_samples(lines: DataFrame) -> DataFrame:
    """Samples of a diagram manifest, one JSON a line in rows(body); a line that is none, or without an image, is an error row."""
    x = lines.select("body", F.from_json("body", SAMPLE).alias("s"))
    return x.select("s.*", F.when(F.col("s.image").isNull(), F.concat(F.lit("not a sample: "), F.substring("body", 1, 40))).alias("error"))


def annotations(files: DataFrame) -> DataFrame:
    """file, label and box of each object in rows(body) of annotation XML."""
    kind = "filename string, object array<struct<name:string,bndbox:struct<xmin:int,ymin:int,xmax:int,ymax:int>>>"
    o = files.select(F.from_xml("body", kind).alias("a")).select("a.filename", F.explode("a.object").alias("o"))
    return o.select("filename", F.col("o.name").alias("label"), "o.bndbox.*")
