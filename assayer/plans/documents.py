"""Queries on nested documents, page geometry, segments and diagrams."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions import numbers, vectors
from assayer.operators import assignment, blueprints, islands, paging
from assayer.plans import flow, measures, windows
from assayer.registry import Tables, query
from assayer.sources import readers
from assayer.sources.shared import shared_path, staged


@query("SELECT c_custkey, coalesce(a.n, 0) AS owned, coalesce(b.n, 0) AS events, coalesce(round(a.t, 2), 0) AS value FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS t FROM orders GROUP BY 1) a ON a.o_custkey = c_custkey LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) b ON b.user_id = c_custkey")
def join_left_aggregates(t: Tables) -> DataFrame:
    a = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("a"), F.sum("o_totalprice").alias("v"))
    b = t.events.groupBy(F.col("user_id").alias("c_custkey")).agg(F.count("*").alias("b"))
    zero = lambda c, n: F.coalesce(c, F.lit(0)).alias(n)
    return t.customer.join(a, "c_custkey", "left").join(b, "c_custkey", "left").select("c_custkey", zero("a", "owned"), zero("b", "events"), F.coalesce(F.round("v", 2), F.lit(0.0)).alias("value"))


PAPER = "sections array<struct<label:string,items:array<struct<slot:int,marks:double,part:bigint>>>>"


def _papers(t: Tables) -> DataFrame:
    """Orders as papers: a section for each return flag, an item for each line, as JSON."""
    item = F.struct(F.col("l_linenumber").alias("slot"), F.col("l_quantity").alias("marks"), F.col("l_partkey").alias("part"))
    sections = t.lineitem.groupBy("l_orderkey", "l_returnflag").agg(F.array_sort(F.collect_list(item)).alias("items"))
    papers = sections.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_returnflag").alias("label"), "items"))).alias("sections"))
    return papers.select(F.col("l_orderkey").alias("paper"), F.to_json(F.struct("sections")).alias("body"))


def _leaves(t: Tables) -> DataFrame:
    s = _papers(t).select("paper", F.explode(F.from_json("body", PAPER)["sections"]).alias("s"))
    return s.select("paper", F.col("s.label").alias("label"), F.explode("s.items").alias("i")).select("paper", "label", "i.slot", "i.marks", "i.part")


@query("SELECT l_orderkey AS paper, l_linenumber AS slot, p_partkey AS part, p_name FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_type = 'PROMO'")
def join_lateral_json(t: Tables) -> DataFrame:
    """Questions named anywhere in a document, joined to their texts."""
    return _leaves(t).join(t.part.where("p_type = 'PROMO'"), F.col("part") == F.col("p_partkey")).select("paper", "slot", "part", "p_name")


@query("SELECT o_custkey, count(DISTINCT o_orderkey) AS papers, round(sum(l_quantity), 2) AS total, count(*) AS questions FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def agg_paper_totals(t: Tables) -> DataFrame:
    per = t.lineitem.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n"))
    return t.orders.join(per, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey").agg(F.count("*").alias("papers"), F.round(F.sum("q"), 2).alias("total"), F.sum("n").alias("questions"))


@query("SELECT l_returnflag, CAST(round(CAST(sum(date_diff('day', o_orderdate, l_shipdate)) AS DECIMAL(20, 4)) / count(*), 1) AS DOUBLE) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate GROUP BY 1")
def agg_average_days(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).where("l_shipdate >= o_orderdate")
    out = rows.groupBy("l_returnflag").agg((F.sum(F.datediff("l_shipdate", "o_orderdate")) * 86400).alias("s"), F.count("*").alias("n"))
    return out.select("l_returnflag", numbers.average_days(F.col("s"), F.col("n")).cast("double").alias("days"))


@query("SELECT a.p_type AS a, b.p_type AS b, CASE WHEN a.p_type = b.p_type THEN 0.0 WHEN a.p_type = 'SMALL' OR b.p_type = 'SMALL' THEN 0.5 ELSE 1.0 END AS cost FROM (SELECT DISTINCT p_type FROM part) a, (SELECT DISTINCT p_type FROM part) b")
def mth_shape_cost(t: Tables) -> DataFrame:
    """Costs of every pair of shapes; one that is unknown costs half."""
    a = t.part.select(F.col("p_type").alias("a")).distinct()
    pairs = a.crossJoin(F.broadcast(a.select(F.col("a").alias("b"))))  # kinds of shapes, not rows
    unknown = (F.col("a") == "SMALL") | (F.col("b") == "SMALL")
    return pairs.select("a", "b", F.when(F.col("a") == F.col("b"), 0.0).when(unknown, 0.5).otherwise(1.0).alias("cost"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, round(greatest(0, least(1, (3.0 * l_linenumber + 4.0 * l_quantity) / 25)), 6) AS along, round(abs(4.0 * l_linenumber - 3.0 * l_quantity) / 5, 6) AS off FROM lineitem")
def mth_geometry_text(t: Tables) -> DataFrame:
    """A text's point against the arrow from (0, 0) to (3, 4): how far along it, and how far off its line."""
    x, y = F.col("l_linenumber"), F.col("l_quantity")
    along = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (3.0 * x + 4.0 * y) / 25))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.round(along, 6).alias("along"), F.round(F.abs(4.0 * x - 3.0 * y) / 5, 6).alias("off"))


@query("SELECT l_orderkey AS graph, count(*) AS edges, CAST(sum(l_linenumber) AS BIGINT) AS check FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem) GROUP BY 1")
def jsn_graph(t: Tables) -> DataFrame:
    """Graphs written as JSON and read again."""
    edges = t.lineitem.select("l_orderkey", F.struct(F.col("l_linenumber").alias("source"), F.col("l_partkey").alias("target")).alias("e")).distinct()
    body = edges.groupBy(F.col("l_orderkey").alias("graph")).agg(F.to_json(F.struct(F.collect_list("e").alias("edges"))).alias("body"))
    back = body.select("graph", F.explode(F.from_json("body", "edges array<struct<source:int,target:bigint>>")["edges"]).alias("e"))
    return back.groupBy("graph").agg(F.count("*").alias("edges"), F.sum("e.source").alias("check"))


@query("""
    WITH b AS (SELECT l_orderkey, CAST(l_quantity AS INTEGER) AS y, l_linenumber AS x, l_partkey, l_suppkey, l_extendedprice FROM lineitem),
    r AS (SELECT *, sum(CASE WHEN y - py > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY y, l_partkey, l_suppkey, l_extendedprice) AS r FROM (SELECT *, lag(y) OVER (PARTITION BY l_orderkey ORDER BY y, l_partkey, l_suppkey, l_extendedprice) AS py FROM b)),
    c AS (SELECT *, sum(CASE WHEN x - px > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY x, l_partkey, l_suppkey, l_extendedprice) AS c FROM (SELECT *, lag(x) OVER (PARTITION BY l_orderkey ORDER BY x, l_partkey, l_suppkey, l_extendedprice) AS px FROM r))
    SELECT l_orderkey, CAST(r + 1 AS BIGINT) AS row_no, CAST(c + 1 AS BIGINT) AS col_no, count(*) AS pieces, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM c GROUP BY ALL""")
def ocr_cells(t: Tables) -> DataFrame:
    """Table cells from pieces of text by clusters of rows and of columns."""
    tie = ["l_partkey", "l_suppkey", "l_extendedprice"]
    b = t.lineitem.select("l_orderkey", F.col("l_quantity").cast("int").alias("y"), F.col("l_linenumber").alias("x"), *tie)
    rows = islands.clusters(islands.clusters(b, ["l_orderkey"], "y", 5, tie, "row_no"), ["l_orderkey"], "x", 1, tie, "col_no")
    return rows.groupBy("l_orderkey", "row_no", "col_no").agg(F.count("*").alias("pieces"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))


@query("SELECT n_name, term, d, CASE WHEN d = 0 THEN 'exact' WHEN d <= 0.25 THEN 'close' ELSE 'none' END AS state FROM (SELECT n_name, r_name AS term, round(levenshtein(n_name, r_name) / greatest(length(n_name), length(r_name)), 6) AS d, row_number() OVER (PARTITION BY n_name ORDER BY levenshtein(n_name, r_name) / greatest(length(n_name), length(r_name)), r_name) AS r FROM nation, region) WHERE r = 1")
def gr_snap(t: Tables) -> DataFrame:
    """Each label's nearest term of a glossary, which is a small list."""
    from assayer.functions.text import norm_distance

    pairs = t.nation.select("n_name").crossJoin(F.broadcast(t.region.select(F.col("r_name").alias("term")))).withColumn("d", F.round(norm_distance(F.col("n_name"), F.col("term")), 6))
    best = pairs.groupBy("n_name").agg(F.min_by(F.struct("term", "d"), F.struct("d", "term")).alias("b")).select("n_name", "b.term", "b.d")
    return best.withColumn("state", F.when(F.col("d") == 0, "exact").when(F.col("d") <= 0.25, "close").otherwise("none"))


def _near(t: Tables) -> DataFrame:
    """Texts (returned lines) with the shapes of their page and the distance to each."""
    text = windows._boxes(t, "a").join(t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("page"), *[F.col(c).alias(f"a_{c}") for c in windows.TIES]).distinct(), ["page", *[f"a_{c}" for c in windows.TIES]], "left_semi")
    shape = windows._boxes(t, "b").join(t.lineitem.where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("page"), *[F.col(c).alias(f"b_{c}") for c in windows.TIES]).distinct(), ["page", *[f"b_{c}" for c in windows.TIES]], "left_semi")
    return text.join(shape, "page").withColumn("d", F.round(numbers.box_distance("a", "b"), 6))


@query(f"""
    WITH b AS (SELECT x.*, l.l_returnflag FROM ({windows.SQL_BOX}) x JOIN (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag FROM lineitem) l USING (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)),
    p AS (SELECT a.l_orderkey AS page, a.l_linenumber AS line, a.l_partkey AS part, a.l_suppkey AS s, a.l_extendedprice AS price, b.l_linenumber AS shape_line, b.l_partkey AS shape_part, b.l_suppkey AS bs, b.l_extendedprice AS bp, round(sqrt(power(greatest(a.x0 - b.x1, b.x0 - a.x1, 0), 2) + power(greatest(a.y0 - b.y1, b.y0 - a.y1, 0), 2)), 6) AS d FROM b a JOIN b ON b.l_orderkey = a.l_orderkey WHERE a.l_returnflag = 'R' AND b.l_returnflag = 'A')
    SELECT page, line, part, price, shape_line, shape_part, d FROM p WHERE d <= 12 QUALIFY row_number() OVER (PARTITION BY page, line, part, s, price ORDER BY d, shape_line, shape_part, bs, bp) = 1""")
def gr_nearest_shape(t: Tables) -> DataFrame:
    """Each text put on the nearest shape of its page within 12 pixels."""
    near = _near(t).where("d <= 12")
    w = Window.partitionBy("page", *[f"a_{c}" for c in windows.TIES]).orderBy("d", *[f"b_{c}" for c in windows.TIES])
    best = near.withColumn("r", F.row_number().over(w)).where("r = 1")
    return best.select("page", F.col("a_l_linenumber").alias("line"), F.col("a_l_partkey").alias("part"), F.col("a_l_extendedprice").alias("price"), F.col("b_l_linenumber").alias("shape_line"), F.col("b_l_partkey").alias("shape_part"), "d")


@query("SELECT l_orderkey AS id, 'part ' || l_partkey AS text, round(l_discount * 100 / 100, 4) AS confidence FROM lineitem WHERE l_returnflag = 'A'")
def src_ocr_cloud_parse(t: Tables) -> DataFrame:
    """A service's answer, one JSON a page, read into lines."""
    box = F.struct(F.struct(F.lit(0.1).alias("Left"), F.lit(0.2).alias("Top"), F.lit(0.3).alias("Width"), F.lit(0.1).alias("Height")).alias("BoundingBox"))
    block = F.struct(F.when(F.col("l_returnflag") == "A", "LINE").otherwise("WORD").alias("BlockType"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("Text"), (F.col("l_discount") * 100).alias("Confidence"), box.alias("Geometry"))
    raw = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.to_json(F.struct(F.collect_list(block).alias("Blocks"))).alias("body"))
    return readers.cloud_lines(raw).select("id", "text", F.round("confidence", 4).alias("confidence"))


@query("SELECT CAST(o_custkey AS VARCHAR) AS college_id, CAST(o_orderkey AS VARCHAR) AS booklet_id FROM orders WHERE o_orderstatus = 'F'")
def src_object_event(t: Tables) -> DataFrame:
    """Completion markers among the objects of a store."""
    last = F.when(F.col("o_orderstatus") == "F", "_complete").otherwise("page1.png")
    paths = t.orders.select(F.concat_ws("/", F.lit("bucket/college"), F.col("o_custkey").cast("string"), F.lit("booklets"), F.col("o_orderkey").cast("string"), last).alias("path"))
    return readers.marker_events(paths)


@query("SELECT page_id, strlen(html) AS bytes, sha256(html) AS h FROM pages")
def src_stream_tar(t: Tables) -> DataFrame:
    """Pages packed into archives and taken out again."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            for at in range(0, len(x), 50):
                buffer = io.BytesIO()
                with tarfile.open(fileobj=buffer, mode="w") as tar:
                    for page, html in zip(x["page_id"][at : at + 50], x["html"][at : at + 50], strict=True):
                        info = tarfile.TarInfo(f"{page}.html")
                        info.size = len(html)
                        tar.addfile(info, io.BytesIO(html))
                yield pd.DataFrame([(f"archive {at}", buffer.getvalue())], columns=["path", "content"])

    archives = t.pages.select("page_id", F.col("html").cast("binary").alias("html")).mapInPandas(pack, "path string, content binary")
    return readers.archive_members(archives).select(F.regexp_extract("member", r"^(\d+)", 1).cast("long").alias("page_id"), F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("h"))


#: Folders of folders are listed by a task each; more than Spark lists in the driver, however many pages there are.
SHELVES = 64


@query("SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS bytes, sha256(html) AS h, CAST(row_number() OVER (ORDER BY page_id) AS BIGINT) AS place FROM pages")
def src_folder(t: Tables) -> DataFrame:
    """Pages written as files into the shared folder, each in a folder named after it on one of SHELVES shelves, and read by extension in natural order; the writer ends a file with a line feed."""
    path = shared_path(t.spark, "folder")
    pages = t.pages.select(F.concat(F.lit("scan-"), F.col("page_id").cast("string")).alias("page"), F.col("html").alias("value"))
    shelf = F.crc32("page") % SHELVES
    # a shelf has one writer, and the driver moves shelves, not the folder of every page
    pages.withColumn("shelf", shelf).repartition(SHELVES, "shelf").write.partitionBy("shelf", "page").text(path)
    name = F.regexp_extract("path", r"page=(scan-\d+)", 1)
    files = readers.files(t.spark, path, ("txt",), name)
    body = F.expr("substring(content, 1, length - 1)")
    rows = files.select(F.regexp_extract(name, r"(\d+)", 1).cast("long").alias("page_id"), F.octet_length(body).cast("long").alias("bytes"), F.sha2(body, 256).alias("h"), F.col("place").alias("__at"))
    rows = staged(rows, "digests")  # every file is opened once, and only its digest is sorted
    return paging.numbered(rows, "place", [F.col("__at")]).drop("__at")


@query("SELECT conv_id, turn, turn || '.' || role AS label FROM conversations ORDER BY conv_id, turn, role")
def srt_paper_order(t: Tables) -> DataFrame:
    """Labels like 12.a by their number, then their text."""
    label = F.concat_ws(".", F.col("turn").cast("string"), "role")
    parts = F.transform(F.split("label", r"\."), lambda p: F.struct(p.try_cast("int").alias("n"), p.alias("s")))
    return t.conversations.select("conv_id", "turn", label.alias("label")).orderBy("conv_id", parts)


SQL_FIND = "SELECT * FROM (SELECT '{group}' AS hit_group, CAST({key} AS VARCHAR) AS key, {text} AS hit FROM {table} WHERE contains(lower({text}), '{words}') ORDER BY lower({text}), key LIMIT 5)"


def _finds(words: str) -> list[tuple[str, str, str, str]]:
    """Group, table, key and text of the five groups of the global search; a search of fewer than 2 or more than 80 characters finds nothing."""
    every = [("part", "part", "p_partkey", "p_name"), ("brand", "part", "p_partkey", "p_brand"), ("customer", "customer", "c_custkey", "c_name"), ("supplier", "supplier", "s_suppkey", "s_name"), ("nation", "nation", "n_nationkey", "n_name")]
    return every if 2 <= len(words.strip()) <= 80 else []


@query(" UNION ALL ".join(SQL_FIND.format(group=g, key=k, text=x, table=table, words="er") for g, table, k, x in _finds("er")))
def rep_global_search(t: Tables) -> DataFrame:
    return paging.search_groups([(g, getattr(t, table).where(paging.contains_ci(x, "er")), F.col(k), F.col(x)) for g, table, k, x in _finds("er")])


@query("""
    WITH f AS (SELECT *, CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS reset FROM events), g AS (SELECT *, sum(reset) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS spell FROM f),
    n AS (SELECT user_id, event_id, ts, event_type, count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id, spell ORDER BY ts, event_id) AS n FROM g), l AS (SELECT user_id, arg_max(CASE WHEN event_type = 'error' THEN n % 2 ELSE 0 END, (ts, event_id)) AS failed, max(CASE WHEN event_type = 'error' AND n % 2 = 0 THEN ts END) AS locked FROM n GROUP BY 1)
    SELECT c_custkey AS user_id, CAST(coalesce(failed, 0) AS BIGINT) AS failed, strftime(locked, '%Y-%m-%d %H:%M:%S') AS locked_since FROM customer LEFT JOIN l ON l.user_id = c_custkey""")
def snk_counter_upsert(t: Tables) -> DataFrame:
    """Users' counters after the events: failures since the last success or lockout, and when a second failure in a row locked the user out last. Counters are upserted: users without events keep theirs at 0."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    bad = F.col("event_type") == "error"
    rows = t.events.withColumn("spell", F.sum((~bad).cast("int")).over(w))
    n = F.sum(bad.cast("int")).over(Window.partitionBy("user_id", "spell").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("n", n)
    last = rows.groupBy("user_id").agg(F.max_by(F.when(bad, F.col("n") % 2).otherwise(0), F.struct("ts", "event_id")).alias("failed"), F.max(F.when(bad & (F.col("n") % 2 == 0), F.col("ts"))).alias("locked"))
    every = t.customer.select(F.col("c_custkey").alias("user_id")).join(last, "user_id", "left")
    return every.select("user_id", F.coalesce("failed", F.lit(0)).cast("long").alias("failed"), F.date_format("locked", "yyyy-MM-dd HH:mm:ss").alias("locked_since"))


@query("""
    WITH f AS (SELECT doc_id, sha256(text) AS h, n_chars FROM documents), c AS (SELECT h, max(n_chars) AS lines FROM f WHERE doc_id % 3 = 0 GROUP BY 1)
    SELECT doc_id, c.h IS NOT NULL AS cached, coalesce(c.lines, f.n_chars) AS lines FROM f LEFT JOIN c USING (h)""")
def src_ocr_cache(t: Tables) -> DataFrame:
    """Readings of files by a JSON cache: what a file of the same content (every third file was read before) gave is used again; the others are read and would be added."""
    files = t.documents.select("doc_id", F.sha2("text", 256).alias("h"), "n_chars")
    cache = files.where("doc_id % 3 = 0").groupBy("h").agg(F.to_json(F.struct(F.max("n_chars").alias("lines"))).alias("body"))
    rows = files.join(cache, "h", "left")
    read = F.from_json("body", "lines long")["lines"]
    return rows.select("doc_id", F.col("body").isNotNull().alias("cached"), F.coalesce(read, F.col("n_chars")).alias("lines"))


@query("""
    SELECT l_orderkey AS paper, 'sections[' || s || '].items[' || i || '].' || what AS path, problem FROM (
        SELECT l_orderkey, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag) - 1 AS s, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, m, l_partkey, l_suppkey, l_extendedprice) - 1 AS i, l_linenumber, m, l_partkey FROM (SELECT *, CASE WHEN l_quantity = 50 THEN -1.0 WHEN l_quantity = 49 THEN NULL ELSE l_quantity END AS m FROM lineitem)),
        (SELECT unnest(['marks', 'marks', 'slot']) AS what, unnest(['required', 'must be above 0', 'must be at most 6']) AS problem)
    WHERE CASE problem WHEN 'required' THEN m IS NULL WHEN 'must be above 0' THEN m <= 0 ELSE l_linenumber > 6 END""")
def jsn_item_faults(t: Tables) -> DataFrame:
    """Faults of papers written as JSON, each with its path: items without marks, with marks of 0 or less (quantities of 49 and 50 stand for these), and slots above 6."""
    marks = F.when(F.col("l_quantity") == 50, -1.0).when(F.col("l_quantity") != 49, F.col("l_quantity"))
    item = F.struct(F.col("l_linenumber").alias("slot"), marks.alias("marks"), F.col("l_partkey").alias("part"), "l_suppkey", "l_extendedprice")
    bare = lambda items: F.transform(items, lambda x: F.struct(x["slot"].alias("slot"), x["marks"].alias("marks"), x["part"].alias("part")))
    nulls_last = lambda a, b: F.when(a < b, -1).when(a > b, 1).otherwise(0)
    key = lambda x: F.struct(x["slot"], x["marks"].isNull(), x["marks"], x["part"], x["l_suppkey"], x["l_extendedprice"])
    ordered = F.array_sort(F.collect_list(item), lambda a, b: nulls_last(key(a), key(b)))
    sections = t.lineitem.groupBy("l_orderkey", "l_returnflag").agg(bare(ordered).alias("items"))
    papers = sections.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_returnflag").alias("label"), "items"))).alias("sections"))
    body = papers.select(F.col("l_orderkey").alias("paper"), F.to_json(F.struct("sections")).alias("body"))
    s = body.select("paper", F.posexplode(F.from_json("body", PAPER)["sections"]).alias("s", "section")).select("paper", "s", F.posexplode("section.items").alias("i", "x"))
    m = F.col("x.marks")
    faults = F.array_compact(F.array(F.when(m.isNull(), F.struct(F.lit("marks").alias("what"), F.lit("required").alias("problem"))), F.when(m <= 0, F.struct(F.lit("marks").alias("what"), F.lit("must be above 0").alias("problem"))), F.when(F.col("x.slot") > 6, F.struct(F.lit("slot").alias("what"), F.lit("must be at most 6").alias("problem")))))
    rows = s.select("paper", "s", "i", F.explode(faults).alias("f"))
    return rows.select("paper", F.concat(F.lit("sections["), F.col("s").cast("string"), F.lit("].items["), F.col("i").cast("string"), F.lit("]."), F.col("f.what")).alias("path"), F.col("f.problem").alias("problem"))


#: Papers of orders as JSON texts, with faults by their numbers, in SQL that both engines read: an item is a line, a section the lines of one flag. Every eleventh text is cut off, some are of another kind.
MARKS_JSON = "CASE l_quantity WHEN 50 THEN ',\"marks\":-1' WHEN 49 THEN '' WHEN 48 THEN ',\"marks\":\"48\"' WHEN 47 THEN ',\"marks\":47.125' ELSE ',\"marks\":' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR(20)) END"
LABEL_JSON = "CASE WHEN l_orderkey % 37 = 0 THEN '1' ELSE CAST(n AS VARCHAR(20)) END"
HEAD_JSON = """'{\"schema_version\":' || CASE WHEN o % 13 = 0 THEN '9' ELSE '\"1.2\"' END || CASE WHEN o % 17 = 0 THEN '' ELSE ',\"title\":\"Paper\"' END || ',\"course_code\":\"C1\",\"subject_id\":' || CASE WHEN o % 19 = 0 THEN '\"x\"' ELSE '\"0f8fad5b-d9cb-469f-a165-70867728950e\"' END
    || CASE WHEN o % 23 = 0 THEN ',\"colour\":1' ELSE '' END || CASE WHEN o % 29 = 0 THEN ',\"duration_minutes\":90.5' ELSE '' END || ',\"total_marks\":' || CAST(total + CASE WHEN o % 7 = 0 THEN 1 ELSE 0 END AS VARCHAR(20)) || ',\"sections\":['"""


@query("""
    WITH n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag) - 1 AS s, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS i FROM lineitem),
    o AS (SELECT l_orderkey AS o, count(*) AS n, count(*) FILTER (l_quantity > 46) AS bad, CAST(sum(l_quantity) AS BIGINT) AS total FROM lineitem GROUP BY 1),
    f AS (SELECT o, '(document)' AS path, CASE WHEN o % 11 = 0 THEN 'is not JSON' ELSE 'must be an object' END AS fault FROM o WHERE o % 11 = 0 OR o % 31 = 0),
    ok AS (SELECT * FROM o WHERE o % 11 <> 0 AND o % 31 <> 0)
    SELECT o AS paper, path, fault FROM f
    UNION ALL SELECT o, 'schema_version', 'must be "1.2" (or "1.1", "1.0")' FROM ok WHERE o % 13 = 0 UNION ALL SELECT o, 'title', 'is required' FROM ok WHERE o % 17 = 0 UNION ALL SELECT o, 'subject_id', 'is not a valid id (UUID)' FROM ok WHERE o % 19 = 0
    UNION ALL SELECT o, 'colour', 'unknown field' FROM ok WHERE o % 23 = 0 UNION ALL SELECT o, 'duration_minutes', 'must be a whole number' FROM ok WHERE o % 29 = 0
    UNION ALL SELECT o, 'total_marks', 'The exam total is ' || (total + 1) || ' but the sections add up to ' || total FROM ok WHERE o % 7 = 0 AND bad = 0
    UNION ALL SELECT o, 'sections', 'Question number 1 is used twice' FROM ok WHERE o % 37 = 0 AND bad = 0 AND n > 1
    UNION ALL SELECT o, 'sections[' || s || '].items[' || i || '].marks', CASE l_quantity WHEN 50 THEN 'must be greater than 0' WHEN 49 THEN 'is required' WHEN 48 THEN 'must be a number' ELSE 'uses at most 2 decimal places' END FROM n JOIN ok ON o = l_orderkey WHERE l_quantity > 46""")
def jsn_blueprint(t: Tables) -> DataFrame:
    """Faults of papers as JSON texts, broken and foreign ones among them, each with its path."""
    tie = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    n = t.lineitem.withColumn("n", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_returnflag", *tie)))
    item = F.expr(f"'{{\"type\":\"question\",\"label\":\"' || {LABEL_JSON} || '\"' || {MARKS_JSON} || '}}'")
    papers = n.groupBy(F.col("l_orderkey").alias("o")).agg(F.sort_array(F.collect_list(F.struct("n", "l_returnflag", item.alias("j")))).alias("lines"), F.sum("l_quantity").cast("long").alias("total"))
    items = lambda flag: F.array_join(F.transform(F.filter("lines", lambda x: x["l_returnflag"] == flag), lambda x: x["j"]), ",")
    section = lambda flag: F.concat(F.lit('{"label":"'), flag, F.lit('","method":"diagram","items":['), items(flag), F.lit("]}"))
    papers = papers.withColumn("sections", F.array_join(F.transform(F.array_distinct(F.transform("lines", lambda x: x["l_returnflag"])), section), ","))
    body = F.concat(F.expr(HEAD_JSON), F.col("sections"), F.lit("]}"))
    papers = papers.withColumn("b", body).select(F.col("o").alias("doc"), F.when(F.col("o") % 11 == 0, F.expr("left(b, length(b) - 1)")).when(F.col("o") % 31 == 0, "[1, 2]").otherwise(F.col("b")).alias("body"))
    return blueprints.check(papers).select(F.col("doc").alias("paper"), "path", "fault")
