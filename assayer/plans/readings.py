"""Reading selection and its measures: a line is a source and language, its readings are the texts of three of its documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions import text
from assayer.operators import fitting, readings
from assayer.plans import measures
from assayer.registry import Tables, query
from assayer.sources.shared import staged

SQL_READ = f"""r AS (SELECT page_id // 3 AS line, 'e' || page_id % 3 AS engine, regexp_extract(url, '/(de|en|es|fr)/', 1) AS lang, regexp_extract(url, '^[a-z]+') AS capture, regexp_extract(url, '//([^/]*)/', 1) AS host, page_id, {measures.SQL_LINE} AS body, (page_id % 7 + 3) / 10.0 AS confidence, page_id % 3 + 1 AS pos FROM pages)"""
SQL_AGREE = """a AS (SELECT x.line, x.page_id, coalesce(1 - avg(CASE WHEN greatest(length(x.body), length(y.body)) = 0 THEN 0 ELSE levenshtein(x.body, y.body) / greatest(length(x.body), length(y.body)) END), 0) AS agreement FROM r x LEFT JOIN r y ON y.line = x.line AND y.page_id <> x.page_id GROUP BY 1, 2)"""
SQL_SCORE = "s AS (SELECT r.line, r.page_id, r.engine, pos, confidence, agreement, round(1.0 * confidence + 0.5 * agreement, 9) AS s FROM r JOIN a ON a.line = r.line AND a.page_id = r.page_id)"


def _readings(t: Tables) -> DataFrame:
    """Three readings of a line: the addresses of three pages, by an engine each."""
    n = F.col("page_id")
    return t.pages.select(
        F.expr("page_id div 3").alias("line"), F.concat(F.lit("e"), (n % 3).cast("string")).alias("engine"), F.regexp_extract("url", "/(de|en|es|fr)/", 1).alias("lang"), F.regexp_extract("url", "^[a-z]+", 0).alias("capture"),
        F.regexp_extract("url", "//([^/]*)/", 1).alias("host"), n.alias("page_id"), measures.line_of().alias("body"), ((n % 7 + 3) / F.lit(10.0)).alias("confidence"), (n % 3 + 1).alias("pos"),
    )


def _scored(t: Tables) -> DataFrame:
    rows = _readings(t)
    return rows.join(readings.agreement(rows, "line", "page_id", "body"), ["line", "page_id"]).withColumn("weight", F.lit(1.0)).withColumn("lexicon", F.lit(None).cast("double"))


@query(f"WITH {SQL_READ}, {SQL_AGREE} SELECT line, page_id, round(agreement, 6) AS agreement FROM a")
def ocr_agreement(t: Tables) -> DataFrame:
    return readings.agreement(_readings(t), "line", "page_id", "body").select("line", "page_id", F.round("agreement", 6).alias("agreement"))


@query(f"WITH {SQL_READ}, {SQL_AGREE}, {SQL_SCORE} SELECT line, page_id, round(least(1.0, s / 1.5), 6) AS line_score, s / 1.5 < 0.6 AS flagged FROM s QUALIFY row_number() OVER (PARTITION BY line ORDER BY s DESC, confidence DESC, pos) = 1")
def ocr_select(t: Tables) -> DataFrame:
    return readings.select_reading(_scored(t), "line", "pos", 0.5, 0.25, 0.6).select("line", "page_id", F.round("line_score", 6).alias("line_score"), "flagged")


@query(f"WITH {SQL_READ}, {SQL_AGREE}, {SQL_SCORE}, g AS (SELECT unnest([0.0, 0.25, 0.5, 1.0, 2.0]) AS alpha), p AS (SELECT alpha, line, page_id, agreement FROM s, g QUALIFY row_number() OVER (PARTITION BY alpha, line ORDER BY round(confidence + alpha * agreement, 9) DESC, confidence DESC, pos) = 1) SELECT alpha, round(avg(agreement), 6) AS mean_agreement, count(*) AS lines FROM p GROUP BY 1")
def ocr_grid(t: Tables) -> DataFrame:
    """The selection for every weight of a grid in one pass: the weight is part of the window's key."""
    grid = F.explode(F.array(*[F.lit(a) for a in (0.0, 0.25, 0.5, 1.0, 2.0)]))
    rows = _scored(t).withColumn("alpha", grid)
    w = Window.partitionBy("alpha", "line").orderBy(F.desc(F.round(F.col("confidence") + F.col("alpha") * F.col("agreement"), 9)), F.desc("confidence"), "pos")
    best = rows.withColumn("r", F.row_number().over(w)).where("r = 1")
    return best.groupBy("alpha").agg(F.round(F.avg("agreement"), 6).alias("mean_agreement"), F.count("*").alias("lines"))


@query(f"WITH {SQL_READ}, {SQL_AGREE}, {SQL_SCORE}, p AS (SELECT x.engine AS without, line, page_id FROM s, (SELECT DISTINCT engine FROM r) x WHERE s.engine <> x.engine QUALIFY row_number() OVER (PARTITION BY x.engine, line ORDER BY s DESC, confidence DESC, pos) = 1) SELECT without, count(*) AS lines, CAST(sum(page_id) AS BIGINT) AS check FROM p GROUP BY 1")
def ocr_ablation(t: Tables) -> DataFrame:
    rows = _scored(t)
    engines = rows.select(F.col("engine").alias("without")).distinct()
    left = rows.crossJoin(F.broadcast(engines)).where("engine <> without")  # a row an engine
    best = readings.select_reading(left, "line", "pos", 0.5, 0.25, 0.6, ("without",))
    return best.groupBy("without").agg(F.count("*").alias("lines"), F.sum("page_id").alias("check"))


SQL_TRUTH = f"""t AS (SELECT *, levenshtein(lower(written), lower(truth)) AS edits, length(truth) AS chars, {measures._sql_words('a', 'b')} AS word_edits, len(b) AS words FROM (SELECT *, list_distinct(list_concat(a, b)) AS k FROM
    (SELECT x.line, x.engine, x.capture, x.lang, x.host, x.pos, x.body AS written, y.body AS truth, string_split(lower(x.body), ' ') AS a, string_split(lower(y.body), ' ') AS b FROM r x JOIN r y ON y.line = x.line AND y.pos = 1 WHERE x.pos > 1)))"""


def _truth(t: Tables) -> DataFrame:
    """Readings with the truth of their line, which is its first."""
    rows = _readings(t)
    first = rows.where("pos = 1").select("line", F.col("body").alias("truth"))
    return rows.where("pos > 1").withColumnRenamed("body", "written").join(first, "line")


@query(f"WITH {SQL_READ}, {SQL_TRUTH} SELECT engine, CAST(sum(edits) AS BIGINT) AS edits, CAST(sum(chars) AS BIGINT) AS chars, CAST(sum(word_edits) AS BIGINT) AS word_edits, CAST(sum(words) AS BIGINT) AS words, round(sum(edits) / sum(chars), 6) AS cer, round(sum(word_edits) / sum(words), 6) AS wer FROM t GROUP BY 1")
def ocr_tally(t: Tables) -> DataFrame:
    rows = readings.edits(_truth(t), "written", "truth").groupBy("engine").agg(*[F.sum(c).alias(c) for c in ("edits", "chars", "word_edits", "words")])
    return rows.withColumns({"cer": F.round(F.col("edits") / F.col("chars"), 6), "wer": F.round(F.col("word_edits") / F.col("words"), 6)})


@query(f"WITH {SQL_READ}, {SQL_TRUTH} SELECT coalesce(engine, '-') AS engine, coalesce(capture, '-') AS capture, count(*) AS lines, CAST(sum(edits) AS BIGINT) AS edits, CAST(sum(chars) AS BIGINT) AS chars, CAST(sum(word_edits) AS BIGINT) AS word_edits, CAST(sum(words) AS BIGINT) AS words FROM t GROUP BY GROUPING SETS ((), (engine), (capture))")
def ocr_groups(t: Tables) -> DataFrame:
    every = readings.tally(_truth(t), "written", "truth", ["engine", "capture"])
    return every.withColumns({c: F.coalesce(c, F.lit("-")) for c in ("engine", "capture")})


@query(f"WITH {SQL_READ}, {SQL_TRUTH} SELECT line, engine AS best, CAST(edits AS INTEGER) AS edits, CAST(word_edits AS INTEGER) AS word_edits FROM t QUALIFY row_number() OVER (PARTITION BY line ORDER BY edits, word_edits, pos) = 1")
def ocr_oracle(t: Tables) -> DataFrame:
    """The reading of a line with the fewest edits, then the fewest word edits, then the first."""
    rows = readings.edits(_truth(t), "written", "truth")
    return rows.groupBy("line").agg(F.min(F.struct("edits", "word_edits", "pos", "engine")).alias("b")).select("line", F.col("b.engine").alias("best"), "b.edits", "b.word_edits")


@query(f"""
    WITH {SQL_READ}, c AS (SELECT line, sum(length(replace(body, ' ', ''))) AS a, sum(length(regexp_replace(body, '[^0-9]', '', 'g'))) AS n, bool_or(regexp_matches(body, '[0-9]')) AS d FROM r GROUP BY 1),
    p AS (SELECT x.line, 1 - levenshtein(x.body, y.body) / greatest(length(x.body), length(y.body)) AS agree, (x.confidence + y.confidence) / 2 AS sure FROM r x JOIN r y ON y.line = x.line WHERE x.engine = 'e0' AND y.engine = 'e2')
    SELECT line, CASE WHEN n / a >= 0.6 AND d THEN 'numeric' WHEN agree >= 0.5 AND sure >= 0.5 THEN 'print' ELSE 'cursive' END AS class FROM c LEFT JOIN p USING (line)""")
def str_content_class(t: Tables) -> DataFrame:
    """The class of a line by its readings; addresses agree less than print does, so the limits are lower."""
    return readings.content_class(_readings(t), "line", "body", "confidence", F.col("engine").isin("e0", "e2"), 0.6, 0.5, 0.5)


@query("SELECT lang, source, count(d.doc_id) AS readings FROM (SELECT DISTINCT lang FROM documents) CROSS JOIN (SELECT DISTINCT source FROM documents) LEFT JOIN documents d USING (lang, source) GROUP BY 1, 2")
def ocr_missing(t: Tables) -> DataFrame:
    """Every engine and line, those without a reading with none."""
    d = t.documents
    have = d.groupBy("lang", "source").agg(F.count("*").alias("n"))
    every = d.select("lang").distinct().crossJoin(F.broadcast(d.select("source").distinct()))
    return every.join(have, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("readings"))


@query("SELECT cut, count(*) FILTER (n_chars < cut) AS flagged, count(*) FILTER (n_chars < cut AND quality = 0) AS flagged_bad, count(*) FILTER (n_chars >= cut AND quality = 0) AS rest_bad FROM documents JOIN labels USING (doc_id), (SELECT unnest([100, 300, 600, 1000, 2000, 4000, 8000]) AS cut) GROUP BY 1")
def ocr_flag_curve(t: Tables) -> DataFrame:
    cuts = F.explode(F.array(*[F.lit(c) for c in (100, 300, 600, 1000, 2000, 4000, 8000)]))
    rows = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id").withColumn("cut", cuts)
    low, bad = F.col("n_chars") < F.col("cut"), F.col("quality") == 0
    return rows.groupBy("cut").agg(F.count_if(low).alias("flagged"), F.count_if(low & bad).alias("flagged_bad"), F.count_if(~low & bad).alias("rest_bad"))


@query(f"WITH {SQL_READ} SELECT count(*) AS readings, round(avg(confidence), 6) AS confidence, count(*) FILTER (length(body) < 40) AS short, count(DISTINCT line) AS lines FROM r")
def ocr_describe(t: Tables) -> DataFrame:
    return _readings(t).agg(F.count("*").alias("readings"), F.round(F.avg("confidence"), 6).alias("confidence"), F.count_if(F.length("body") < 40).alias("short"), F.count_distinct("line").alias("lines"))


@query(f"WITH {SQL_READ}, {SQL_TRUTH} SELECT engine, round(avg(CASE WHEN lang = regexp_extract(truth, ' (de|en|es|fr) ', 1) THEN 1.0 ELSE 0.0 END), 6) AS unchanged FROM t GROUP BY 1")
def ocr_prefill_share(t: Tables) -> DataFrame:
    """How often a prefilled field (the language of a line) stays as it was."""
    return _truth(t).groupBy("engine").agg(F.round(F.avg((F.col("lang") == F.regexp_extract("truth", " (de|en|es|fr) ", 1)).cast("double")), 6).alias("unchanged"))


@query(f"WITH {SQL_READ}, {SQL_TRUTH}, c AS (SELECT capture, engine, round(sum(edits) / sum(chars), 6) AS cer FROM t GROUP BY 1, 2) SELECT capture, engine AS best, cer FROM c QUALIFY row_number() OVER (PARTITION BY capture ORDER BY cer, engine) = 1")
def ocr_compare_best(t: Tables) -> DataFrame:
    c = readings.edits(_truth(t), "written", "truth").groupBy("capture", "engine").agg(F.round(F.sum("edits") / F.sum("chars"), 6).alias("cer"))
    return c.groupBy("capture").agg(F.min_by("engine", F.struct("cer", "engine")).alias("best"), F.min("cer").alias("cer"))


@query("SELECT conv_id, sha256(string_agg(text, ' ' ORDER BY turn)) AS text, round(sum((turn % 5) * greatest(1, length(trim(text)))) / sum(greatest(1, length(trim(text)))), 6) AS confidence FROM conversations GROUP BY 1")
def ocr_merge(t: Tables) -> DataFrame:
    """A conversation's turns as the pieces of a line."""
    pieces = t.conversations.select("conv_id", "turn", "text", (F.col("turn") % 5).alias("c"))
    out = readings.merge_pieces(pieces, "conv_id", "turn", "text", "c")
    return out.select("conv_id", F.sha2("text", 256).alias("text"), F.round("confidence", 6).alias("confidence"))


@query(f"WITH {SQL_READ}, m AS (SELECT *, max(CASE WHEN lang IN ('de', 'fr') THEN 1 ELSE 0 END) OVER (PARTITION BY line) AS member FROM r) SELECT line, page_id FROM m WHERE member = 0 OR lang IN ('de', 'fr')")
def ocr_competing(t: Tables) -> DataFrame:
    rows = _readings(t).withColumn("ok", readings.competing(F.col("lang").isin("de", "fr"), F.col("line")))
    return rows.where("ok").select("line", "page_id")


SQL_QUALITY = "coalesce(round(sum(CASE WHEN turn % 2 = {0} THEN c * n END) / nullif(sum(CASE WHEN turn % 2 = {0} THEN n END), 0), 4), 0)"


@query(f"""
    WITH p AS (SELECT conv_id, turn, length(trim(text)) AS n, (turn * 7 + length(text)) % 10 / 10.0 AS c FROM conversations),
    q AS (SELECT conv_id, {SQL_QUALITY.format(0)} AS upright, {SQL_QUALITY.format(1)} AS turned, greatest(coalesce(sum(n) FILTER (turn % 2 = 0), 0), coalesce(sum(n) FILTER (turn % 2 = 1), 0)) >= 40 AS decided FROM p GROUP BY 1)
    SELECT *, decided AND round(turned - upright, 4) >= 0.1 AS turn FROM q""")
def ocr_orientation(t: Tables) -> DataFrame:
    """Pages (conversations) that read better upside down; odd turns are what was read turned."""
    rows = t.conversations.select("conv_id", "text", F.when(F.col("turn") % 2 == 0, "upright").otherwise("turned").alias("side"), ((F.col("turn") * 7 + F.length("text")) % 10 / 10.0).alias("c"))
    return readings.orientation(rows, "conv_id", "side", "text", "c")


def _accuracy(t: Tables) -> DataFrame:
    rows = readings.edits(_truth(t), "written", "truth")
    return rows.withColumn("error", F.when(F.col("chars") == 0, 0.0).otherwise(F.least(F.lit(1.0), F.col("edits") / F.col("chars"))))


SQL_CELLS = "x AS (SELECT engine, round(confidence, 6) AS c, sum(1 - least(1.0, edits / chars)) AS s, count(*) AS n FROM t JOIN r USING (line, engine) GROUP BY 1, 2), p AS (SELECT *, row_number() OVER w AS i, sum(s) OVER w AS su, sum(n) OVER w AS nu FROM x WINDOW w AS (PARTITION BY engine ORDER BY c))"


@query(f"""
    WITH {SQL_READ}, {SQL_TRUTH.replace("x.pos,", "x.pos, ")}, {SQL_CELLS},
    m AS (SELECT a.engine, a.c, j.i AS first, min((k.su - j.su + j.s) / (k.nu - j.nu + j.n)) AS least FROM p a JOIN p j ON j.engine = a.engine AND j.i <= a.i JOIN p k ON k.engine = a.engine AND k.i >= a.i GROUP BY 1, 2, 3)
    SELECT engine, c AS confidence, round(max(least), 5) AS accuracy FROM m GROUP BY 1, 2""")
def ocr_isotonic(t: Tables) -> DataFrame:
    """Each engine's calibration curve at the confidences it gave."""
    rows = _accuracy(t).select("engine", F.round("confidence", 6).alias("confidence"), (1 - F.col("error")).alias("accuracy"))
    curve = fitting.isotonic(rows, ["engine"], "confidence", "accuracy")
    at = rows.select("engine", "confidence").distinct().join(curve, "engine")
    return at.select("engine", "confidence", F.round(fitting.interpolated(F.col("confidence"), F.col("xs"), F.col("ys")), 5).alias("accuracy"))


@query(f"""
    WITH {SQL_READ}, {SQL_TRUTH}, g AS (SELECT engine, lang, count(*) AS samples, avg(least(1.0, edits / chars)) AS rate FROM t GROUP BY 1, 2 HAVING count(*) >= 30), w AS (SELECT *, greatest(0, ln((1 - rate) / rate) / 2) AS raw FROM g)
    SELECT engine, lang, CAST(CASE WHEN engine = 'e1' THEN 4 ELSE 1 END AS INTEGER) AS version, samples, round(rate, 6) AS error_rate, CASE WHEN max(raw) OVER (PARTITION BY lang) > 0 THEN round(raw / max(raw) OVER (PARTITION BY lang), 6) ELSE 0 END AS weight FROM w""")
def ocr_fit(t: Tables) -> DataFrame:
    """New calibrations of the engines and classes with 30 samples at least: version, error rate, relative weight (and the curve, which ocr_isotonic shows)."""
    rows = _accuracy(t).select("engine", "lang", "confidence", "error")
    previous = rows.where("engine = 'e1'").select("engine", "lang").distinct().withColumn("version", F.lit(3))
    return fitting.calibrations(rows, "engine", "lang", "confidence", "error", previous).drop("xs", "ys")


@query()
def mth_interpolate(t: Tables) -> DataFrame:
    """Confidences put on the calibrated scale of their engine; a row an engine joins them."""
    rows = _accuracy(t)
    curve = fitting.isotonic(rows.withColumn("accuracy", 1 - F.col("error")), ["engine"], "confidence", "accuracy")
    return rows.join(F.broadcast(curve), "engine").select("page_id", F.round(fitting.interpolated(F.col("confidence"), F.col("xs"), F.col("ys")), 6).alias("calibrated"))


@query()
def ocr_bootstrap(t: Tables) -> DataFrame:
    """Intervals of the engines' character errors over pages, and of the differences of every two."""
    pages = staged(readings.edits(_truth(t), "written", "truth").groupBy("engine", "host").agg(F.sum("edits").alias("edits"), F.sum("chars").alias("chars")), "pages")
    own = fitting.bootstrap_ratio(pages, ["engine"], "host", "edits", "chars").withColumn("against", F.lit(None).cast("string"))
    pairs = fitting.bootstrap_ratio(fitting.paired(pages, "engine", "host", "edits", "chars"), ["engine", "against"], "host", "edits", "chars")
    return own.unionByName(pairs).select("engine", "against", "pages", "low", "high")


@query(f"""
    WITH {SQL_READ}, {SQL_TRUTH}, f AS (SELECT host, CAST((row_number() OVER (ORDER BY host) - 1) % 5 AS INTEGER) AS fold FROM (SELECT DISTINCT host FROM t)),
    y AS (SELECT t.engine, fold, round(r.confidence, 6) AS c, sum(1 - least(1.0, edits / chars)) AS s, count(*) AS n FROM t JOIN r ON r.line = t.line AND r.engine = t.engine JOIN f ON f.host = t.host GROUP BY 1, 2, 3),
    x AS (SELECT engine, o.fold, c, sum(s) AS s, sum(n) AS n FROM y, (SELECT DISTINCT fold FROM f) o WHERE o.fold <> y.fold GROUP BY 1, 2, 3),
    p AS (SELECT *, row_number() OVER w AS i, sum(s) OVER w AS su, sum(n) OVER w AS nu FROM x WINDOW w AS (PARTITION BY engine, fold ORDER BY c)),
    m AS (SELECT a.engine, a.fold, a.c, j.i AS first, min((k.su - j.su + j.s) / (k.nu - j.nu + j.n)) AS least FROM p a JOIN p j ON j.engine = a.engine AND j.fold = a.fold AND j.i <= a.i JOIN p k ON k.engine = a.engine AND k.fold = a.fold AND k.i >= a.i GROUP BY 1, 2, 3, 4),
    v AS (SELECT engine, fold, c, max(least) AS accuracy FROM m GROUP BY 1, 2, 3)
    SELECT r.page_id, f.fold, round(round(accuracy, 6), 5) AS calibrated FROM t JOIN r ON r.line = t.line AND r.engine = t.engine JOIN f ON f.host = t.host JOIN v ON v.engine = t.engine AND v.fold = f.fold AND v.c = round(r.confidence, 6)""")
def ocr_kfold(t: Tables) -> DataFrame:
    """Confidences calibrated by curves fitted on the other folds' pages."""
    rows = _accuracy(t).select("engine", "host", "page_id", F.round("confidence", 6).alias("confidence"), (1 - F.col("error")).alias("accuracy"))
    rank = fitting.ranked(rows.select("host").distinct(), "host", "place")
    rows = staged(rows.join(rank.select("host", ((F.col("place") - 1).cast("int") % 5).alias("fold")), "host"), "readings")
    cells = staged(fitting.cells_of(rows, ["engine", "fold"], "confidence", "accuracy"), "cells")
    curves = fitting.isotonic_cells(fitting.without_fold(cells, ["engine"], "fold"), ["engine", "fold"])
    met = rows.join(curves, ["engine", "fold"])
    return met.select("page_id", "fold", F.round(fitting.interpolated(F.col("confidence"), F.col("xs"), F.col("ys")), 5).alias("calibrated"))
