"""Scoring of answers: conversations are answers, their turns segments, the lines of the texts regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions import text, udfs, vectors
from assayer.operators import steps
from assayer.plans import measures
from assayer.registry import Tables, query
from assayer.sources import readers
from assayer.sources.shared import shared_path

#: The least words of an answer, the share of badly read lines, and the relevance below which an answer is off target, or is with unfamiliar names in it.
BLANK_WORDS, LOW_OCR, RELEVANCE, SOFT = 3, 0.25, 0.25, 0.40

#: A turn is a segment; every fifth is a diagram. Of its lines those whose length divides by 11 are struck out, those whose length divides by 7 have a teacher's text, and those whose length divides by 4 were read badly.
SQL_REGIONS = f"""z AS (SELECT conv_id, turn, pos, CASE WHEN pos = 1 THEN (turn + 1) || ') ' || l ELSE l END AS l, length(l) AS n FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM conversations WHERE turn % 5 <> 4) WHERE trim(l) <> ''),
    k AS (SELECT conv_id, turn, pos, n, CASE WHEN row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) = 1 THEN regexp_replace(regexp_replace(CASE WHEN n % 7 = 0 THEN lower(l) ELSE l END, '{text.ANSWER_LABEL}', ''), '{text.ANSWER_WORD}', '') ELSE CASE WHEN n % 7 = 0 THEN lower(l) ELSE l END END AS l FROM z WHERE n % 11 <> 0),
    s AS (SELECT conv_id, turn, string_agg(l, chr(10) ORDER BY pos) AS body, count(*) AS lines, count(*) FILTER (n % 4 = 0 AND n % 7 <> 0) AS low FROM k WHERE trim(l) <> '' GROUP BY 1, 2),
    g AS (SELECT conv_id, count(*) FILTER (n % 11 = 0) AS struck FROM z GROUP BY 1)"""


def regions(t: Tables) -> DataFrame:
    """conv_id, turn, pos, text, teacher, struck, flagged: the lines with text of the turns that are no diagrams."""
    line = t.conversations.where("turn % 5 <> 4").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("pos", "l")).where("trim(l) <> ''")
    n = F.length("l")
    body = F.when(F.col("pos") == 0, F.concat((F.col("turn") + 1).cast("string"), F.lit(") "), "l")).otherwise(F.col("l"))
    return line.select("conv_id", "turn", "pos", body.alias("text"), F.when(n % 7 == 0, F.lower(body)).alias("teacher"), (n % 11 == 0).alias("struck"), (n % 4 == 0).alias("flagged"))


def assembled(rows: DataFrame, answer: str, segment: str) -> DataFrame:
    """answer, segment, body, lines, low: the lines of each segment in order, a teacher's text before the one read, struck-out ones left out, the label taken off the first; how many lines there are and how many were read badly."""
    w = Window.partitionBy(answer, segment).orderBy("pos")
    kept = rows.where("NOT struck").withColumn("l", F.coalesce("teacher", "text")).withColumn("first", F.row_number().over(w) == 1)
    kept = kept.withColumn("l", F.when(F.col("first"), text.strip_label(F.col("l"))).otherwise(F.col("l"))).where("trim(l) <> ''")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", "l"))), lambda x: x["l"])
    return kept.groupBy(answer, segment).agg(F.array_join(lines, "\n").alias("body"), F.count("*").alias("lines"), F.count_if(F.col("flagged") & F.col("teacher").isNull()).alias("low"))


def answers(t: Tables) -> DataFrame:
    """conv_id, body, lines, low, struck: whole answers, segments apart by an empty line."""
    segments = assembled(regions(t), "conv_id", "turn")
    whole = F.transform(F.array_sort(F.collect_list(F.struct("turn", "body"))), lambda x: x["body"])
    out = segments.groupBy("conv_id").agg(F.array_join(whole, "\n\n").alias("body"), F.sum("lines").alias("lines"), F.sum("low").alias("low"))
    return out.join(regions(t).groupBy("conv_id").agg(F.count_if("struck").alias("struck")), "conv_id")


@query(f"WITH {SQL_REGIONS} SELECT conv_id, sha256(string_agg(body, chr(10) || chr(10) ORDER BY turn)) AS body, CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(low) AS BIGINT) AS low, any_value(struck) AS struck FROM s JOIN g USING (conv_id) GROUP BY 1")
def sc_assemble(t: Tables) -> DataFrame:
    return answers(t).withColumn("body", F.sha2("body", 256))


SQL_COPIES = "c AS (SELECT conv_id, turn, role, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS duplicates, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations), p AS (SELECT conv_id, turn, CASE WHEN duplicates < 2 THEN 1 ELSE greatest(before, 1) END AS copy FROM c)"


def copies(t: Tables) -> DataFrame:
    """conv_id, turn, copy: an answer that was begun twice or more (a question's turn marks a copy) in its copies; what goes on joins the copy before it."""
    mark = (F.col("role") == "user").cast("int")
    w = Window.partitionBy("conv_id")
    rows = t.conversations.select("conv_id", "turn", F.sum(mark).over(w).alias("all"), F.sum(mark).over(w.orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)).alias("before"))
    return rows.select("conv_id", "turn", F.when(F.col("all") < 2, 1).otherwise(F.greatest("before", F.lit(1))).cast("long").alias("copy"))


@query(f"WITH {SQL_COPIES} SELECT conv_id, CAST(copy AS BIGINT) AS copy, count(*) AS parts, min(turn) AS first_turn FROM p GROUP BY 1, 2")
def sc_candidates(t: Tables) -> DataFrame:
    return copies(t).groupBy("conv_id", "copy").agg(F.count("*").alias("parts"), F.min("turn").alias("first_turn"))


@query()
def sc_list(t: Tables) -> DataFrame:
    """Of the items that a turn's predecessor names (its first six words of five letters or more, each also without its last letter), those that the turn names; credit is their share of three, at most 1."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = t.conversations.select("conv_id", "turn", "text", before.alias("before")).where("before IS NOT NULL")
    items = F.slice(F.array_distinct(F.filter(text.tokens(F.col("before")), lambda w: F.length(w) >= 5)), 1, 6)
    wordings = F.transform(items, lambda w: F.array(w, F.substr(w, F.lit(1), F.length(w) - 1)))
    # dealt again by a fixed number: adaptive execution would put these short rows, each long at work, into a few tasks
    rows = rows.repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "conv_id", "turn").select("conv_id", "turn", udfs.count_items(wordings, "text").alias("found"))
    return rows.withColumn("credit", F.round(F.least("found", F.lit(3)) / 3, 4))


NUMBER_UNIT = r"(?:^| )([0-9]+)(?: ([a-zA-Z]{1,6})\b)?"


@query(rf"""
    WITH n AS (SELECT page_id, unnest(regexp_extract_all(l, '{NUMBER_UNIT}', 1)) AS v, unnest(regexp_extract_all(l, '{NUMBER_UNIT}', 2)) AS u, unnest(range(1, len(regexp_extract_all(l, '{NUMBER_UNIT}', 1)) + 1)) AS i FROM (SELECT page_id, {measures.SQL_LINE} AS l FROM pages)),
    d AS (SELECT page_id, CAST(v AS DOUBLE) AS v, i, abs(CAST(v AS DOUBLE) - 500) AS off, coalesce(u, '') <> '' AND levenshtein(lower(u), 'page') <= 1 AS unit FROM n),
    b AS (SELECT page_id, bool_or(off <= 200) AS ok, min_by(v, off * 1000 + i) AS nearest, bool_or(off <= 200 AND unit) AS named, min_by(v, i) FILTER (off <= 200 AND unit) AS a, min_by(v, i) FILTER (off <= 200) AS f FROM d GROUP BY 1)
    SELECT p.page_id, CASE WHEN ok THEN 1.0 ELSE 0.0 END AS credit, CASE WHEN named THEN a WHEN ok THEN f ELSE nearest END AS found, coalesce(ok AND NOT named, false) AS check FROM pages p LEFT JOIN b USING (page_id)""")
def sc_numeric(t: Tables) -> DataFrame:
    """Whether a line names a number within 200 of 500: credit 1 if any is, else the nearest is shown. A missing unit (page) costs nothing but is to be checked."""
    line = t.pages.select("page_id", measures.line_of().alias("l"))
    n = line.select("page_id", F.posexplode(udfs.extract_numbers("l")).alias("i", "n")).select("page_id", "i", F.col("n.value").cast("double").alias("v"), F.col("n.unit").alias("u"))
    off = F.abs(F.col("v") - 500)
    within, unit = off <= 200, udfs.words_match(F.lit("page"), "u") & (F.col("u") != "")
    n = n.withColumns({"off": off, "within": within, "unit": unit})
    best = n.groupBy("page_id").agg(F.max("within").alias("ok"), F.min_by("v", F.struct("off", "i")).alias("nearest"), F.max(F.col("within") & F.col("unit")).alias("named"), F.min_by("v", F.when(F.col("within") & F.col("unit"), F.col("i"))).alias("a"), F.min_by("v", F.when(F.col("within"), F.col("i"))).alias("f"))
    rows = line.select("page_id").join(best, "page_id", "left")
    return rows.select("page_id", F.when(F.col("ok"), 1.0).otherwise(0.0).alias("credit"), F.when(F.col("named"), F.col("a")).when(F.col("ok"), F.col("f")).otherwise(F.col("nearest")).alias("found"), F.coalesce(F.col("ok") & ~F.col("named"), F.lit(False)).alias("check"))


def relevance(sentences: DataFrame, key: DataFrame, answer: str, best: int = 3) -> DataFrame:
    """answer, relevance: the mean of the answer's `best` sentences nearest to any sentence of its key. sentences(answer, s, text), key(answer, s, text); trigram vectors meet by their slots, so only pairs of one answer with something in common are made."""

    def slots(df: DataFrame, s: str) -> DataFrame:
        named = df.withColumn("id", F.struct(answer, "s"))
        v = vectors.trigram_slots(named, "id", "text")
        return v.select(F.col(f"id.{answer}").alias(answer), F.col("id.s").alias(s), "slot", F.col("weight").cast("double").alias(f"w_{s}"))

    a, b = slots(sentences, "a"), slots(key, "b")
    size = lambda df, s: df.groupBy(answer, s).agg(F.sqrt(F.sum(F.col(f"w_{s}") ** 2)).alias(f"n_{s}"))
    dots = a.join(b, [answer, "slot"]).groupBy(answer, "a", "b").agg(F.sum(F.col("w_a") * F.col("w_b")).alias("dot"))
    near = dots.join(size(a, "a"), [answer, "a"]).join(size(b, "b"), [answer, "b"]).groupBy(answer, "a").agg(F.max(F.col("dot") / (F.col("n_a") * F.col("n_b"))).alias("c"))
    every = sentences.select(answer, F.col("s").alias("a")).join(near, [answer, "a"], "left").withColumn("c", F.coalesce("c", F.lit(0.0)))
    place = F.row_number().over(Window.partitionBy(answer).orderBy(F.desc("c"), "a"))
    return every.withColumn("place", place).where(F.col("place") <= best).groupBy(answer).agg(F.avg("c").alias("relevance"))


def guarded(t: Tables) -> DataFrame:
    """conv_id, relevance, contradicting, unfamiliar, reasons: an answer (the assistant's turns) against its question (the user's turns). Off target is what is not relevant, names a term that contradicts the key, or names much that the papers (the benchmark's texts) don't know and is of middling relevance."""
    said = lambda role: t.conversations.where(F.col("role") == role).select("conv_id", "turn", F.posexplode(udfs.sentences("text")).alias("at", "text"))
    numbered = lambda df: df.select("conv_id", (F.col("turn") * 100000 + F.col("at")).alias("s"), "text")
    answer = said("assistant")
    near = relevance(numbered(answer), numbered(said("user")), "conv_id")
    known = t.benchmark.select(F.explode(text.tokens(F.col("text"))).alias("w")).distinct()
    names = answer.select("conv_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?<=[^.:;\s]\s{1,9})\b([A-Z][a-z]{2,})\b"), F.lit(1))).alias("name")).select("conv_id", F.lower("name").alias("w")).distinct()
    strange = names.join(known, "w", "left_anti").groupBy("conv_id").agg(F.count("*").alias("unfamiliar"))
    terms = ["idiot", "worthless"]
    hits = [F.size(udfs.find_phrase(F.lit(x), "text")) > 0 for x in terms]
    against = answer.select("conv_id", *[h.alias(x) for x, h in zip(terms, hits, strict=True)]).groupBy("conv_id").agg(*[F.max(x).alias(x) for x in terms])
    against = against.select("conv_id", F.array_compact(F.array(*[F.when(F.col(x), x) for x in terms])).alias("contradicting"))
    rows = against.join(near, "conv_id", "left").join(strange, "conv_id", "left").withColumn("unfamiliar", F.coalesce("unfamiliar", F.lit(0)))
    r, opposed = F.col("relevance"), F.size("contradicting") > 0
    reasons = F.array_compact(F.array(F.when(r < RELEVANCE, "low relevance"), F.when(opposed, "contradicts the key"), F.when((F.col("unfamiliar") > 0) & (r < SOFT) & ~opposed, "unfamiliar names")))
    return rows.select("conv_id", F.round("relevance", 4).alias("relevance"), "contradicting", "unfamiliar", reasons.alias("reasons"))


@query()
def sc_guard(t: Tables) -> DataFrame:
    return guarded(t).select("conv_id", "relevance", F.array_join("contradicting", ",").alias("contradicting"), "unfamiliar", F.array_join("reasons", ", ").alias("reasons"), (F.size("reasons") > 0).alias("off_target"))


def flags(words: Column, lines: Column, low: Column, off_target: Column, copies_: Column, disagreeing: Column) -> Column:
    """An answer's flags in order; a blank one is not off target besides."""
    blank = words < BLANK_WORDS
    return F.array_compact(F.array(F.when(blank, "blank"), F.when((lines > 0) & (low / F.nullif(lines, F.lit(0)) >= LOW_OCR), "low ocr"), F.when(off_target & ~blank, "off target"), F.when(copies_ > 1, "duplicate"), F.when(disagreeing, "scorers disagree")))


@query()
def sc_flags(t: Tables) -> DataFrame:
    """Flags of answers: blank, badly read, off target by the guard, begun more than once, or with scorers that disagree on the document of the same number."""
    from assayer.plans.flow import sc_disagree

    n = copies(t).groupBy("conv_id").agg(F.max("copy").alias("n"))
    off = guarded(t).select("conv_id", (F.size("reasons") > 0).alias("off"))
    apart = sc_disagree(t).where("opinion = 'disagree'").select(F.col("doc_id").alias("conv_id"), F.lit(True).alias("apart"))
    rows = answers(t).join(n, "conv_id").join(off, "conv_id", "left").join(apart, "conv_id", "left").withColumn("words", F.size(text.tokens(F.col("body"))))
    c = F.col
    return rows.select("conv_id", F.array_join(flags(c("words"), c("lines"), c("low"), F.coalesce(c("off"), F.lit(False)), c("n"), F.coalesce(c("apart"), F.lit(False))), ",").alias("flags"))


@query("""
    WITH c AS (SELECT l_orderkey, (l_linenumber + 1) // 2 AS copy, CAST(round(sum(CAST(l_discount AS DECIMAL(10, 4)) * CAST(l_quantity AS DECIMAL(10, 4))) / 0.5, 0) * 0.5 AS DOUBLE) AS mark FROM lineitem GROUP BY 1, 2)
    SELECT l_orderkey, copy, mark FROM c QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY mark DESC, copy) = 1""")
def sc_mark(t: Tables) -> DataFrame:
    """The mark of each copy of an answer, the sum of weight times credit rounded to half marks; the best copy counts, the earlier of equals."""
    total = F.sum(F.col("l_discount").cast("decimal(10,4)") * F.col("l_quantity").cast("decimal(10,4)"))
    each = t.lineitem.groupBy("l_orderkey", F.expr("(l_linenumber + 1) div 2").cast("int").alias("copy")).agg(total.alias("s"))
    each = each.select("l_orderkey", "copy", (F.round(F.col("s") / F.lit("0.5").cast("decimal(10,4)"), 0) * 0.5).cast("double").alias("mark"))
    best = each.groupBy("l_orderkey").agg(F.max(F.struct("mark", (-F.col("copy")).alias("less"))).alias("b"))
    return best.select("l_orderkey", (-F.col("b.less")).alias("copy"), "b.mark")


@query("SELECT l_orderkey, string_agg(DISTINCT v, ',' ORDER BY v) AS versions FROM (SELECT l_orderkey, unnest(['content ' || l_partkey || ' v' || (l_linenumber % 3 + 1), 'scorer ' || l_returnflag || ' v' || CASE l_linestatus WHEN 'F' THEN 2 ELSE 1 END]) AS v FROM lineitem) GROUP BY 1")
def sc_lineage(t: Tables) -> DataFrame:
    """The versions of the content and of the scorers that an answer's score was made with."""
    content = F.concat(F.lit("content "), F.col("l_partkey").cast("string"), F.lit(" v"), (F.col("l_linenumber") % 3 + 1).cast("string"))
    scorer = F.concat(F.lit("scorer "), "l_returnflag", F.lit(" v"), F.when(F.col("l_linestatus") == "F", "2").otherwise("1"))
    rows = t.lineitem.select("l_orderkey", F.explode(F.array(content, scorer)).alias("v"))
    return rows.groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_set("v")), ",").alias("versions"))


@query("""
    WITH b AS (SELECT l_orderkey, (l_linenumber + 1) // 2 AS slot, l_linenumber AS alternative, CASE WHEN l_linestatus = 'F' THEN l_quantity WHEN l_discount > 0 THEN round(l_quantity * l_discount * 10, 2) END AS mark FROM lineitem), a AS (SELECT l_orderkey, slot, alternative, sum(CAST(mark AS DECIMAL(18, 2))) AS mark FROM b WHERE mark IS NOT NULL GROUP BY ALL),
    d AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, slot ORDER BY mark DESC, alternative) = 1 AS chosen FROM a), e AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, chosen ORDER BY mark DESC, slot, alternative) AS place FROM d)
    SELECT l_orderkey, string_agg(slot || '.' || alternative || '=' || CASE WHEN NOT chosen THEN 'other alternative scored higher' WHEN place > 2 THEN 'not among the best' ELSE 'counted' END, ';' ORDER BY slot, alternative) AS slots, CAST(sum(mark) FILTER (chosen AND place <= 2) AS DOUBLE) AS total FROM e GROUP BY 1""")
def rep_evaluation(t: Tables) -> DataFrame:
    """A booklet's result: each slot's alternatives with what became of them, and the total."""
    from assayer.operators import choice
    from assayer.plans.windows import leaf_marks

    marks = leaf_marks(t).where("mark IS NOT NULL").groupBy("l_orderkey", "slot", "alternative").agg(F.sum(F.col("mark").cast("decimal(18,2)")).alias("mark")).withColumn("one", F.lit(1))
    ruled = choice.choice_rules(marks, "l_orderkey", "one", "slot", "alternative", "mark", 2)
    each = F.transform(F.array_sort(F.collect_list(F.struct("slot", "alternative", "outcome"))), lambda x: F.concat(x["slot"].cast("string"), F.lit("."), x["alternative"].cast("string"), F.lit("="), x["outcome"]))
    return ruled.groupBy("l_orderkey").agg(F.array_join(each, ";").alias("slots"), F.sum(F.when(F.col("counted"), F.col("mark"))).cast("double").alias("total"))


@query(f"""
    WITH {SQL_REGIONS}, a AS (SELECT conv_id, string_agg(body, chr(10) || chr(10) ORDER BY turn) AS text, sum(lines) AS lines FROM s GROUP BY 1), d AS (SELECT conv_id, count(*) AS diagrams FROM conversations WHERE turn % 5 = 4 GROUP BY 1)
    SELECT conv_id, CAST(lines AS BIGINT) AS lines, len({measures.SQL_TOKENS}) AS words, coalesce(diagrams, 0) AS diagrams, round(least(len({measures.SQL_TOKENS}) / 50.0, 5.0) * 2, 0) / 2 AS mark FROM a LEFT JOIN d USING (conv_id)""")
def st_pipeline(t: Tables) -> DataFrame:
    """Booklets from their pages to marks, by steps with a ledger of ids: read (lines), prepare (regions without what was struck out), segment (assembled answers), diagrams, score (half a mark for every 25 words, up to 5). The booklets come in two loads; the second run takes only those that the first has not done."""
    return pipeline(t, shared_path(t.spark, "pipeline"), [t.conversations.where("conv_id % 2 = 0"), t.conversations])


def pipeline(t: Tables, folder: str, loads: list[DataFrame]) -> DataFrame:
    """Runs the steps over what has come, load by load."""
    spark, key = t.spark, "conv_id"
    own = lambda df: lambda ids: df().join(ids, key, "left_semi")
    before = lambda name: steps.rows_of(spark, folder, name)

    def segment() -> DataFrame:
        parts = assembled(before("prepare"), key, "turn")
        whole = F.transform(F.array_sort(F.collect_list(F.struct("turn", "body"))), lambda x: x["body"])
        return parts.groupBy(key).agg(F.array_join(whole, "\n\n").alias("body"), F.sum("lines").alias("lines"))

    def diagrams() -> DataFrame:
        drawn = t.conversations.where("turn % 5 = 4").groupBy(key).agg(F.count("*").alias("diagrams"))
        return before("segment").join(drawn, key, "left").withColumn("diagrams", F.coalesce("diagrams", F.lit(0)))

    def score() -> DataFrame:
        words = F.size(text.tokens(F.col("body"))).cast("long")
        rows = before("diagrams").select(key, "lines", words.alias("words"), "diagrams")
        return rows.withColumn("mark", F.round(F.least(F.col("words") / 50.0, F.lit(5.0)) * 2, 0) / 2)

    made = [("read", own(lambda: regions(t))), ("prepare", own(lambda: before("read").where("NOT struck"))), ("segment", own(segment)), ("diagrams", own(diagrams)), ("score", own(score))]
    out: DataFrame | None = None
    for load in loads:
        out = steps.advance(spark, folder, key, load, made)
    return out


@query(r"""
    WITH a AS (SELECT conv_id, turn, (turn + 1) || ' <b>' || text || '</b> -LRB- see  ' || role || ' -RRB-' AS line FROM conversations)
    SELECT conv_id || ':' || turn AS id, CAST(conv_id AS VARCHAR) AS question, sha256(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(replace(replace(regexp_replace(line, '^\S*\s?', ''), '-LRB-', '('), '-RRB-', ')'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')), '([(\[{])\s+', '\1', 'g'), '\s+([)\]}])', '\1', 'g')) AS text, CAST(turn % 6 AS DOUBLE) AS mark FROM a""")
def src_mohler(t: Tables) -> DataFrame:
    """Short answers from parallel files of answers and grades, which belong together by position."""
    line = F.concat((F.col("turn") + 1).cast("string"), F.lit(" <b>"), "text", F.lit("</b> -LRB- see  "), "role", F.lit(" -RRB-"))
    answers_ = t.conversations.select(F.col("conv_id").cast("string").alias("code"), F.col("turn").alias("pos"), line.alias("line"))
    grades = t.conversations.select(F.col("conv_id").cast("string").alias("code"), F.col("turn").alias("pos"), (F.col("turn") % 6).cast("string").alias("line"))
    return readers.zipped_answers(answers_, grades).select("id", "question", F.sha2("text", 256).alias("text"), "mark")


@query("SELECT 'page' || l_orderkey AS image, count(*) AS objects, count(*) FILTER (l_returnflag = 'R') AS arrows, count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'F') AS heads, CAST(sum(l_linenumber) AS BIGINT) AS edge_sum FROM lineitem GROUP BY 1")
def src_diagram_manifest(t: Tables) -> DataFrame:
    """Samples from a manifest of one JSON a line: objects, arrows and edges."""
    box = F.array(F.col("l_linenumber") * 10.0, F.col("l_quantity"), F.col("l_linenumber") * 10.0 + 5, F.col("l_quantity") + 12)
    objects = F.collect_list(F.struct(F.col("l_returnflag").alias("class"), box.alias("box")))
    arrows = F.collect_list(F.when(F.col("l_returnflag") == "R", F.struct(box.alias("box"), (F.col("l_linestatus") == "F").alias("has_head"))))
    edges = F.collect_list(F.array(F.lit(0), F.col("l_linenumber")))
    body = t.lineitem.groupBy("l_orderkey").agg(objects.alias("objects"), arrows.alias("arrows"), edges.alias("edges"))
    lines = body.select(F.to_json(F.struct(F.concat(F.lit("page"), F.col("l_orderkey").cast("string")).alias("image"), F.lit(100).alias("width"), F.lit(100).alias("height"), "objects", "arrows", "edges")).alias("body"))
    s = readers.diagram_samples(lines)
    return s.select("image", F.size("objects").cast("long").alias("objects"), F.size("arrows").cast("long").alias("arrows"), F.size(F.filter("arrows", lambda a: a["has_head"])).cast("long").alias("heads"), F.aggregate("edges", F.lit(0).cast("long"), lambda n, e: n + e[1]).alias("edge_sum"))


@query("SELECT l_orderkey || '.png' AS filename, l_returnflag AS label, l_linenumber * 10 AS xmin, CAST(l_quantity AS INTEGER) AS ymin, l_linenumber * 10 + 5 AS xmax, CAST(l_quantity AS INTEGER) + 12 AS ymax FROM lineitem")
def src_voc_xml(t: Tables) -> DataFrame:
    """Objects from annotation files, one XML a page."""
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c.cast("string"), F.lit(f"</{name}>"))
    x, y = F.col("l_linenumber") * 10, F.col("l_quantity").cast("int")
    box = tag("bndbox", F.concat(tag("xmin", x), tag("ymin", y), tag("xmax", x + 5), tag("ymax", y + 12)))
    o = t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.collect_list(tag("object", F.concat(tag("name", F.col("l_returnflag")), box))), "").alias("o"))
    return readers.annotations(o.select(tag("annotation", F.concat(tag("filename", F.concat(F.col("l_orderkey").cast("string"), F.lit(".png"))), F.col("o"))).alias("body")))

