"""Segmentation queries: conversations are booklets, their turns pages, the lines of the texts lines. The questions' turns (user) are the paper."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.operators import segments
from assayer.plans.arrow import labelled_lines
from assayer.registry import Tables, query
from assayer.sources.shared import by_key, staged

WIDTH, HEIGHT = 1000, 1400
#: Where the n-th line (from 0) of a page lies. On odd pages two lines share a row; empty lines are slivers of the next page.
X0 = "CASE WHEN text = '' THEN 0 WHEN pos = 0 THEN 60 WHEN pos % 2 = 1 AND turn % 2 = 1 THEN 560 ELSE 120 + length(text) % 3 END"
Y0 = "40 * (pos - (pos % 2) * (turn % 2)) + CASE WHEN pos > 5 THEN 90 ELSE 0 END"
SQL_LINES = f"q AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS text, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM conversations), g AS (SELECT *, {X0} AS x0, {Y0} AS y0 FROM q), b AS (SELECT *, x0 + CASE WHEN text = '' THEN 40 ELSE 20 + least(8 * length(text), 410) END AS x1, y0 + 28 AS y1 FROM g)"


#: Every third page has a figure; some are tables, some are the whole page.
FIGURE = {"x0": "CASE WHEN n % 7 = 0 THEN 0 ELSE 50 + n % 300 END", "y0": "CASE WHEN n % 7 = 0 THEN 0 ELSE n * 7 % 300 END", "x1": "CASE WHEN n % 7 = 0 THEN 1000 ELSE 450 + n % 300 END", "y1": "CASE WHEN n % 7 = 0 THEN 1400 ELSE n * 7 % 300 + 60 + n % 80 END"}
SQL_FIGURES = "fg AS (SELECT conv_id, turn, kind, x0, y0, x1, y1 FROM (SELECT conv_id, turn, CASE WHEN n % 5 = 0 THEN 'table' ELSE 'diagram' END AS kind, " + ", ".join(f"{v} AS {k}" for k, v in FIGURE.items()) + " FROM (SELECT conv_id, turn, length(text) AS n FROM conversations) WHERE n % 3 = 0))"


def figures(t: Tables) -> DataFrame:
    """booklet, page, figure, kind and box."""
    n = t.conversations.select(F.col("conv_id").alias("booklet"), F.col("turn").alias("page"), F.length("text").alias("n")).where("n % 3 = 0")
    return n.select("booklet", "page", F.concat_ws(".", "booklet", "page").alias("figure"), F.when(F.expr("n % 5 = 0"), "table").otherwise("diagram").alias("kind"), *(F.expr(v).alias(k) for k, v in FIGURE.items()))


def with_middle(df: DataFrame) -> DataFrame:
    return df.withColumn("middle", (F.col("y0") + F.col("y1")) / 2)


def booklet_lines(t: Tables, labelled: bool) -> DataFrame:
    """booklet, page, at, text and box of every line; labelled ones begin as answers' labels are written."""
    q = t.conversations.select("conv_id", "turn", "role", F.posexplode(F.split("text", "\n")).alias("at", "text"))
    if labelled:
        q = labelled_lines(t).withColumnRenamed("line", "text")
    q = q.withColumn("pos", F.col("at"))
    g = q.withColumn("x0", F.expr(X0)).withColumn("y0", F.expr(Y0))
    wide = F.when(F.col("text") == "", 40).otherwise(20 + F.least(8 * F.length("text"), F.lit(410)))
    return g.select(F.col("conv_id").alias("booklet"), F.col("turn").alias("page"), "role", "at", "text", "x0", "y0", (F.col("x0") + wide).alias("x1"), (F.col("y0") + 28).alias("y1"))


@query(f"""
    WITH {SQL_LINES}, {SQL_FIGURES}, k AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id, turn ORDER BY y0) - 1 AS row FROM b WHERE NOT (text = '')),
    w AS (SELECT conv_id, turn, list_sort(list(x0) FILTER (x1 - x0 >= 350)) AS wide, list_sort(list(x0)) AS every FROM k GROUP BY 1, 2), l AS (SELECT conv_id, turn, CASE WHEN len(wide) > 0 THEN wide[CAST(floor(0.3 * (len(wide) - 1) + 0.5) AS BIGINT) + 1] ELSE every[CAST(floor(0.3 * (len(every) - 1) + 0.5) AS BIGINT) + 1] END AS text_left FROM w),
    t AS (SELECT DISTINCT conv_id, turn, y0 FROM k), p AS (SELECT conv_id, turn, list_sort(list(gap)) AS gaps FROM (SELECT conv_id, turn, y0 - lag(y0) OVER (PARTITION BY conv_id, turn ORDER BY y0) AS gap FROM t) WHERE gap > 0 GROUP BY 1, 2)
    SELECT k.conv_id AS booklet, k.turn AS page, CAST(pos AS INTEGER) AS "at", CAST(row AS INTEGER) AS row, row_number() OVER (PARTITION BY k.conv_id, k.turn, row ORDER BY x0, pos) = 1 AS first_in_row, CAST(text_left AS INTEGER) AS text_left, CAST(CASE WHEN len(gaps) >= 2 THEN gaps[len(gaps) // 2 + 1] ELSE 0 END AS DOUBLE) AS pitch,
        EXISTS (SELECT 1 FROM fg WHERE fg.conv_id = k.conv_id AND fg.turn = k.turn AND kind = 'diagram' AND (fg.x1 - fg.x0) * (fg.y1 - fg.y0) < 0.6 * {WIDTH} * {HEIGHT} AND (k.x0 + k.x1) / 2 BETWEEN fg.x0 AND fg.x1 AND (k.y0 + k.y1) / 2 BETWEEN fg.y0 AND fg.y1) AS in_figure
    FROM k JOIN l ON l.conv_id = k.conv_id AND l.turn = k.turn LEFT JOIN p ON p.conv_id = k.conv_id AND p.turn = k.turn""")
def seg_page_lines(t: Tables) -> DataFrame:
    lines = segments.page_lines(booklet_lines(t, False), "booklet", "page", WIDTH)
    return segments.in_figures(lines, figures(t), "booklet", "page", WIDTH * HEIGHT).select("booklet", "page", "at", "row", "first_in_row", F.col("text_left").cast("int").alias("text_left"), "pitch", "in_figure")


@query(f"""
    WITH {SQL_LINES}, {SQL_FIGURES}, k AS (SELECT conv_id, turn, (y0 + y1) / 2 AS middle, row_number() OVER (PARTITION BY conv_id, turn ORDER BY y0, x0, pos) AS seq, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, y0, x0, pos) - 1) // 3 AS segment FROM b WHERE NOT (text = '')),
    f AS (SELECT conv_id, turn, (y0 + y1) / 2 AS middle FROM fg),
    on_page AS (SELECT f.conv_id, f.turn, arg_max(segment, seq) AS segment FROM f JOIN k ON k.conv_id = f.conv_id AND k.turn = f.turn AND k.middle <= f.middle GROUP BY 1, 2),
    earlier AS (SELECT f.conv_id, f.turn, arg_max(segment, (k.turn, seq)) AS segment FROM f JOIN k ON k.conv_id = f.conv_id AND k.turn < f.turn GROUP BY 1, 2),
    one AS (SELECT conv_id, min(segment) AS segment FROM k GROUP BY 1)
    SELECT f.conv_id AS booklet, f.turn AS page, coalesce(p.segment, e.segment, one.segment) AS segment FROM f LEFT JOIN on_page p ON p.conv_id = f.conv_id AND p.turn = f.turn LEFT JOIN earlier e ON e.conv_id = f.conv_id AND e.turn = f.turn LEFT JOIN one ON one.conv_id = f.conv_id""")
def seg_figures(t: Tables) -> DataFrame:
    """Figures put into segments of three lines each."""
    rows = with_middle(booklet_lines(t, False).where("text <> ''"))
    of_page, of_booklet = Window.partitionBy("booklet", "page").orderBy("y0", "x0", "at"), Window.partitionBy("booklet").orderBy("page", "y0", "x0", "at")
    rows = rows.select("booklet", "page", "middle", F.row_number().over(of_page).alias("seq"), F.floor((F.row_number().over(of_booklet) - 1) / 3).alias("segment"))
    return segments.place_figures(rows, with_middle(figures(t)), "booklet", "page").select("booklet", "page", "segment")


def _evidence(t: Tables) -> DataFrame:
    lines = booklet_lines(t, True).where("role = 'assistant'")
    laid = segments.in_figures(segments.page_lines(lines, "booklet", "page", WIDTH), figures(t), "booklet", "page", WIDTH * HEIGHT)
    return segments.evidence(laid, "booklet", "page", WIDTH)


@query()
def seg_evidence(t: Tables) -> DataFrame:
    return _evidence(t).select("booklet", "page", "at", "l.kind", "l.number", "l.part", "evidence")


def _block_lines(t: Tables) -> DataFrame:
    """Lines with their blocks, lists joined. Staged: what follows reads them several times."""
    lines = staged(segments.blocks(_evidence(t), "booklet", "page"), "block-lines")
    return staged(segments.merged(lines, "booklet", "page"), "merged-lines")


def _blocks(t: Tables, lines: DataFrame | None = None) -> DataFrame:
    return staged(segments.gathered(lines if lines is not None else _block_lines(t), "booklet", "page"), "blocks")


@query()
def seg_blocks(t: Tables) -> DataFrame:
    return _blocks(t).select("booklet", "block", "lines", "section", "evidence", F.sha2("text", 256).alias("h"))


#: A paper's question of two lines or more has parts a and b, one a line; the first half of the questions is section A.
SQL_LEAVES = """u AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS slot, count(*) OVER (PARTITION BY conv_id) AS n, string_split(text, chr(10)) AS ls FROM conversations WHERE role = 'user'),
    p AS (SELECT conv_id, slot, n, CASE WHEN len(ls) > 1 THEN unnest(['a', 'b']) END AS part, ls, text FROM u WHERE len(ls) > 1 UNION ALL SELECT conv_id, slot, n, NULL, ls, text FROM u WHERE len(ls) = 1)"""


def leaves(t: Tables) -> DataFrame:
    """booklet, slot, part, section, label, text: what can be answered, in paper order."""
    u = t.conversations.where("role = 'user'")
    w = Window.partitionBy("conv_id")
    u = u.select(F.col("conv_id").alias("booklet"), F.row_number().over(w.orderBy("turn")).alias("slot"), F.count("*").over(w).alias("n"), F.split("text", "\n").alias("ls"))
    parts = F.when(F.size("ls") > 1, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit(None).cast("string")))
    rows = u.select("booklet", "slot", "n", "ls", F.explode(parts).alias("part"))
    text = F.when(F.col("part") == "a", F.element_at("ls", 1)).when(F.col("part") == "b", F.array_join(F.slice("ls", F.lit(2), F.size("ls")), " ")).otherwise(F.element_at("ls", 1))
    section = F.when(F.col("slot") * 2 <= F.col("n"), "A").otherwise("B")
    return rows.select("booklet", "slot", "part", section.alias("section"), F.concat_ws(".", F.col("slot").cast("string"), "part").alias("label"), text.alias("text"))


@query(f"""WITH {SQL_LEAVES} SELECT conv_id AS booklet, CAST(slot AS INTEGER) AS slot, part, CASE WHEN slot * 2 <= n THEN 'A' ELSE 'B' END AS section, slot || coalesce('.' || part, '') AS label, sha256(CASE WHEN part = 'b' THEN array_to_string(ls[2:], ' ') ELSE ls[1] END) AS wording FROM p""")
def seg_leaves(t: Tables) -> DataFrame:
    return leaves(t).withColumn("wording", F.sha2("text", 256)).drop("text")


@query()
def seg_similarity(t: Tables) -> DataFrame:
    return segments.similarities(_blocks(t).select("booklet", "block", "text"), leaves(t), "booklet", "block")


def decoded(t: Tables, lines: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks with the state that was found for each; the leaves as rows, and by place."""
    b, paper = _blocks(t, lines), staged(leaves(t), "leaves")
    order = F.array_sort(F.collect_list(F.struct("slot", F.coalesce("part", F.lit("")).alias("p"), "part", "section", "label")))
    papers = paper.groupBy("booklet").agg(order.alias("leaves"))
    near = segments.similarities(b.select("booklet", "block", "text"), paper, "booklet", "block").join(by_key(paper.select("booklet", "label", "slot", F.coalesce("part", F.lit("")).alias("p"))), ["booklet", "label"])
    sims = near.groupBy("booklet", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "p", "similarity"))), lambda x: x["similarity"]).alias("sims"))
    rows = b.join(by_key(papers), "booklet").join(by_key(sims), ["booklet", "block"], "left")
    found = segments.decode(rows.select("booklet", F.col("block").cast("long").alias("block"), "l", "evidence", "section", "sims", "leaves"))
    return staged(b.join(by_key(found), ["booklet", "block"]), "decoded"), paper, papers


@query()
def seg_decode(t: Tables) -> DataFrame:
    """Blocks assigned to the questions of their paper by beam search."""
    return decoded(t)[0].select("booklet", "block", "state")


@query()
def seg_finish(t: Tables) -> DataFrame:
    """Segments, with the figures that go to them: neighbouring blocks of one state (a new label in the tray begins anew), with their question, how it was found, and flags. What no label names needs a similarity of 0.25, else it goes to the tray with the question proposed; a question answered in several segments is a duplicate, and a label that names another disagrees."""
    lines = _block_lines(t)
    rows, paper, papers = decoded(t, lines)
    w = Window.partitionBy("booklet").orderBy("block")
    again = F.col("state") != F.lag("state").over(w)
    anew = F.col("l.kind").isNotNull() & (F.lag("state").over(w) == -1)
    rows = rows.withColumn("__turn", F.coalesce(again | anew, F.lit(True)).cast("int")).withColumn("segment", F.sum("__turn").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), " ")
    rows = staged(rows, "segment-blocks")
    order = Window.partitionBy("booklet", "page").orderBy("row", "x0", "at")
    owned = with_middle(lines.join(by_key(rows.select("booklet", "block", "segment")), ["booklet", "block"])).select("booklet", "page", F.row_number().over(order).alias("seq"), "middle", "segment")
    answers = figures(t).join(by_key(t.conversations.where("role = 'assistant'").select(F.col("conv_id").alias("booklet"), F.col("turn").alias("page"))), ["booklet", "page"], "left_semi")
    drawn = segments.place_figures(staged(owned, "owned"), with_middle(answers), "booklet", "page").where("segment IS NOT NULL").groupBy("booklet", "segment").agg(F.count("*").alias("figures"))
    pieces = rows.groupBy("booklet", "segment").agg(F.min("state").alias("state"), F.min_by("l", "block").alias("l"), F.count("*").alias("blocks"), F.substring(text, 1, segments.BLOCK_CHARS).alias("text"))
    pieces = staged(pieces, "pieces")
    near = staged(segments.similarities(pieces.select("booklet", "segment", "text"), paper, "booklet", "segment"), "near")
    best = near.groupBy("booklet", "segment").agg(F.min_by("label", F.struct(-F.col("similarity"), "label")).alias("nearest"), F.max("similarity").alias("highest"))
    pieces = pieces.join(by_key(papers), "booklet").withColumn("question", F.when(F.col("state") >= 0, F.col("leaves")[F.col("state")]))
    own = near.withColumnRenamed("similarity", "score")
    pieces = pieces.withColumn("label", F.col("question.label")).join(by_key(best), ["booklet", "segment"], "left")
    pieces = pieces.join(by_key(own), ["booklet", "segment", "label"], "left")
    of_slot = F.filter("leaves", lambda q: q["slot"] == F.col("l.number"))
    named = F.when(F.col("l.kind") == "question", F.coalesce(F.try_element_at(F.filter(of_slot, lambda q: q["part"] == F.col("l.part")), F.lit(1))["label"], F.try_element_at(of_slot, F.lit(1))["label"]))
    pieces = pieces.withColumn("named", named)
    by_label = F.coalesce((F.col("named") == F.col("label")) | (F.col("l.kind") == "part"), F.lit(False))
    pieces = pieces.withColumn("by_label", by_label)
    weak = (F.col("state") >= 0) & ~F.col("by_label") & (F.coalesce("score", F.lit(0.0)) < segments.LEAST_SIMILAR)
    kept = (F.col("state") >= 0) & ~weak
    copies = F.count(F.when(F.col("state") >= 0, F.col("label"))).over(Window.partitionBy("booklet", "label"))
    unread = F.coalesce((F.col("l.kind") == "answer") | (F.col("named").isNull() & F.col("l.strong")), F.lit(False))
    flags = F.array_compact(F.array(F.when(F.col("state") == -2, "before the first answer"), F.when((F.col("state") != -2) & unread, "number unread"), F.when(kept & (F.col("named") != F.col("label")) & (F.col("l.kind") != "part"), "label disagrees"), F.when(kept & (copies > 1), "duplicate")))
    found_by = F.when((F.col("state") == -2) | (kept & F.col("by_label")), "rule").otherwise("similarity")
    score = F.when(kept & F.col("by_label"), None).when(F.col("state") >= 0, F.col("score")).otherwise(F.col("highest"))
    pieces = pieces.join(by_key(drawn), ["booklet", "segment"], "left")
    return pieces.select("booklet", "segment", F.when(kept, F.col("label")).alias("question"), found_by.alias("found_by"), F.round(score, 4).alias("score"), F.when(~kept, F.when(F.col("state") >= 0, F.col("label")).otherwise(F.col("nearest"))).alias("proposed"), F.array_join(flags, ",").alias("flags"), "blocks", F.coalesce("figures", F.lit(0)).alias("figures"))


#: Each booklet's edit: merge its first two segments, split the first behind its first line, take the first away from its question, or move the boundary of the first two behind the second line.
SQL_EDITS = "e AS (SELECT conv_id, turn AS segment, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) AS pos FROM (SELECT conv_id, turn, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM conversations))"


@query(f"""
    WITH {SQL_EDITS}, c AS (SELECT conv_id, pos, CASE conv_id % 4 WHEN 0 THEN CASE WHEN segment = 1 THEN 0 ELSE segment END WHEN 1 THEN CASE WHEN segment = 0 AND pos > 1 THEN 1000 ELSE segment END WHEN 2 THEN segment ELSE CASE WHEN segment <= 1 THEN CASE WHEN pos <= 2 THEN 0 ELSE 1 END ELSE segment END END AS segment FROM e)
    SELECT conv_id AS booklet, CAST(segment AS INTEGER) AS segment, count(*) AS lines, min(pos) AS first_line, CASE WHEN conv_id % 4 = 2 AND segment = 0 THEN -1 ELSE CAST(segment AS INTEGER) + 1 END AS question FROM c GROUP BY conv_id, segment""")
def seg_edits(t: Tables) -> DataFrame:
    """A teacher's edits of segments (turns) on their lines."""
    lines = t.conversations.select(F.col("conv_id").alias("booklet"), F.col("turn").alias("segment"), F.posexplode(F.split("text", "\n")).alias("i", "text"))
    lines = lines.select("booklet", "segment", F.row_number().over(Window.partitionBy("booklet").orderBy("segment", "i")).alias("at"))
    zero, one = F.lit(0), F.lit(1)
    kind = F.col("booklet") % 4
    edited = segments.merge(lines.where(kind == 0), zero, one).unionByName(segments.split(lines.where(kind == 1), zero, one, F.lit(1000))).unionByName(lines.where(kind == 2)).unionByName(segments.move_boundary(lines.where(kind == 3), zero, one, F.lit(2)))
    out = edited.groupBy("booklet", "segment").agg(F.count("*").alias("lines"), F.min("at").cast("long").alias("first_line"))
    return out.withColumn("question", F.when((kind == 2) & (F.col("segment") == 0), -1).otherwise(F.col("segment") + 1))


SQL_PAGES = "g AS (SELECT conv_id, turn, turn // 2 AS want, (turn + CASE WHEN length(text) % 4 = 0 THEN 1 ELSE 0 END) // 2 AS got FROM conversations), h AS (SELECT *, CASE WHEN want IS DISTINCT FROM lag(want) OVER w THEN want END AS want_start, CASE WHEN got IS DISTINCT FROM lag(got) OVER w THEN got END AS got_start, CASE WHEN want = lag(want) OVER w THEN want END AS want_on, CASE WHEN got = lag(got) OVER w THEN got END AS got_on FROM g WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"


@query(f"""
    WITH {SQL_PAGES}, o AS (SELECT conv_id, coalesce(string_agg(chr(CAST(65 + want_start AS INTEGER)), '' ORDER BY turn), '') AS a, coalesce(string_agg(chr(CAST(65 + got_start AS INTEGER)), '' ORDER BY turn), '') AS b, count(want_start) AS true_starts, count(got_start) AS predicted_starts, count(*) FILTER (want_start = got_start) AS correct_starts, count(want_on) AS continuations, count(*) FILTER (want_on IS NOT NULL AND want_on = got_on) AS correct_continuations, round(avg(CASE WHEN want = got THEN 1.0 ELSE 0.0 END), 6) AS page_jaccard FROM h GROUP BY 1)
    SELECT conv_id AS booklet, CAST(levenshtein(a, b) AS INTEGER) AS order_edits, true_starts, predicted_starts, correct_starts, continuations, correct_continuations, page_jaccard FROM o""")
def seg_score(t: Tables) -> DataFrame:
    """Of each booklet's pages, what begins on them and goes on from the page before, against the truth: edits of the written order, starts, continuations, and the mean overlap of the questions on a page."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    shift = F.when(F.length("text") % 4 == 0, 1).otherwise(0)
    g = t.conversations.select("conv_id", "turn", F.floor(F.col("turn") / 2).alias("want"), F.floor((F.col("turn") + shift) / 2).alias("got"))
    for k in ("want", "got"):
        same = F.coalesce(F.col(k) == F.lag(k).over(w), F.lit(False))
        g = g.withColumn(f"{k}_start", F.when(~same, F.col(k))).withColumn(f"{k}_on", F.when(same, F.col(k)))
    from assayer.functions import text

    starts = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col(f"{k}_start").isNotNull(), F.struct("turn", F.col(f"{k}_start").cast("string").alias("s"))))), lambda x: x["s"])
    out = g.groupBy(F.col("conv_id").alias("booklet")).agg(
        starts("want").alias("a"), starts("got").alias("b"), F.count("want_start").alias("true_starts"), F.count("got_start").alias("predicted_starts"), F.count_if(F.col("want_start") == F.col("got_start")).alias("correct_starts"),
        F.count("want_on").alias("continuations"), F.count_if(F.col("want_on") == F.col("got_on")).alias("correct_continuations"), F.round(F.avg((F.col("want") == F.col("got")).cast("double")), 6).alias("page_jaccard"),
    )
    return out.withColumn("order_edits", text.list_edits(F.col("a"), F.col("b"))).drop("a", "b")


NUMBER = r"^[\s\-–(\[]*(?:page|pg|p)?\s*[.:#\-]?\s*(\d{1,2})\s*(?:/\s*\d{1,2})?[\s\-–)\].]*$"


@query(f"""
    WITH {SQL_LINES}, n AS (SELECT conv_id, turn, pos, x0, x1, y0, y1, length(text) % 50 AS v, max(y1) OVER (PARTITION BY conv_id, turn) AS height FROM b WHERE text <> ''),
    c AS (SELECT conv_id, turn, pos, v FROM n WHERE length(CAST(v AS VARCHAR)) <= 2 AND pos % 3 = 1 AND (x0 + x1) / 2.0 >= 350 AND ((y0 + y1) / 2.0 <= 0.25 * height OR (y0 + y1) / 2.0 >= 0.75 * height) AND v > 0)
    SELECT conv_id AS booklet, turn AS page, CAST(min(v) AS INTEGER) AS number FROM c GROUP BY 1, 2 HAVING count(DISTINCT v) = 1""")
def str_page_number(t: Tables) -> DataFrame:
    """The number written on a page: a line of a number alone, right of the middle's left, in the top or bottom band; not if there are several. Every third line stands for a number, its length."""
    lines = booklet_lines(t, False).where("text <> ''").withColumn("height", F.max("y1").over(Window.partitionBy("booklet", "page")))
    lines = lines.withColumn("text", F.when(F.col("at") % 3 == 1, F.concat(F.lit("- "), (F.length("text") % 50).cast("string"), F.lit(" -"))).otherwise(F.col("text")))
    n = F.nullif(F.regexp_extract("text", NUMBER, 1), F.lit("")).cast("int")
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    found = lines.withColumn("n", n).where((F.col("at") % 3 == 1) & (F.col("n") > 0) & (x >= 0.35 * WIDTH) & ((y <= 0.25 * F.col("height")) | (y >= 0.75 * F.col("height"))))
    return found.groupBy("booklet", "page").agg(F.min("n").alias("number"), F.count_distinct("n").alias("k")).where("k = 1").drop("k")
