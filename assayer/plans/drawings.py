"""Drawings built from detections. A customer's lines are a page of 1000 by 1000 pixels: those accepted are its shapes, those under way its arrows, those returned its recognised lines, placed on a grid by their part and supplier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.operators import drawings
from assayer.registry import Tables, query
from assayer.sources.shared import bucketed

SIDE = 1000
#: Places, in SQL that both engines read.
CELL_X, CELL_Y = "(l_partkey * 37) % 9 * 100", "(l_suppkey * 61 + l_linenumber * 3) % 9 * 100"
QTY = "CAST(l_quantity AS BIGINT)"
TEXT = f"CASE {QTY} % 8 WHEN 0 THEN 'V' WHEN 1 THEN '( ' || p_name || ' |' WHEN 2 THEN p_name || ' ' || p_name || ' ' || p_name ELSE p_name END"
SURE = "round(0.25 + l_discount * 7.5, 4)"
SHAPE = {"x0": f"{CELL_X} + 10 + l_partkey % 7", "y0": f"{CELL_Y} + 10", "x1": f"{CELL_X} + 60 + l_partkey % 7 + {QTY} % 40", "y1": f"{CELL_Y} + 40 + {QTY} % 20"}
ARROW = {"tx": f"{CELL_X} + 45", "ty": f"{CELL_Y} + 25 + {QTY} % 40", "hx": f"greatest(0, {CELL_X} + 45 + (l_suppkey % 3 - 1) * 100)", "hy": f"greatest(0, {CELL_Y} + 25 + {QTY} % 40 + (l_linenumber % 3 - 1) * 100)"}
WORDS = {"x0": f"{CELL_X} + {QTY} % 5 * 15", "y0": f"{CELL_Y} + l_partkey % 6 * 15", "x1": f"{CELL_X} + {QTY} % 5 * 15 + 8 * length({TEXT})", "y1": f"{CELL_Y} + l_partkey % 6 * 15 + 12 + l_linenumber * 2"}
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount"]


def _of(kind: dict[str, str]) -> str:
    return ", ".join(f"CAST({v} AS BIGINT) AS {k}" for k, v in kind.items())


def _d(a: str, b: str) -> str:
    """Distance of boxes a and b in SQL."""
    return "sqrt(" + " + ".join(f"power(greatest({a}.{x}0 - {b}.{x}1, {b}.{x}0 - {a}.{x}1, 0), 2)" for x in "xy") + ")"


def _p(x: str, y: str, b: str) -> str:
    """Distance of a point and a box in SQL."""
    return "sqrt(" + " + ".join(f"power(greatest({b}{k}0 - {v}, {v} - {b}{k}1, 0), 2)" for k, v in (("x", x), ("y", y))) + ")"


SQL_DRAWING = rf"""
    rows_ AS (SELECT *, o_custkey AS page, row_number() OVER (PARTITION BY o_custkey ORDER BY {", ".join(ORDER)}) AS k, {SURE} AS confidence FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey),
    sh AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y0, x0, k) AS no FROM (SELECT page, k, p_type AS kind, {_of(SHAPE)}, confidence FROM rows_ WHERE l_returnflag = 'A' AND confidence >= 0.3)),
    ar AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY ty, tx, k) AS no, least(tx, hx) AS x0, least(ty, hy) AS y0, greatest(tx, hx) AS x1, greatest(ty, hy) AS y1 FROM (SELECT page, k, {_of(ARROW)}, {QTY} % 3 <> 0 AS headed, confidence FROM rows_ WHERE l_returnflag = 'N' AND confidence >= 0.3)),
    te AS (SELECT page, k, {TEXT} AS text, {_of(WORDS)}, confidence FROM rows_ WHERE l_returnflag = 'R'),
    bs AS (SELECT te.page, te.k, list_sort(list({{'x0': sh.x0, 'no': sh.no, 'x1': sh.x1}})) AS b FROM te JOIN sh ON sh.page = te.page AND least(te.y1, sh.y1) - greatest(te.y0, sh.y0) >= 0.5 * (te.y1 - te.y0) AND least(te.x1, sh.x1) > greatest(te.x0, sh.x0) GROUP BY 1, 2 HAVING count(*) > 1),
    wd AS (SELECT te.*, b, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM te LEFT JOIN bs USING (page, k)),
    ed AS (SELECT *, CASE WHEN b IS NOT NULL AND len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: x0 + (x1 - x0) * (length(array_to_string(w[1:i], ' ')) + 0.5) / length(array_to_string(w, ' '))) END AS e FROM wd),
    ct AS (SELECT *, CASE WHEN e IS NOT NULL THEN list_transform(range(1, len(b)), lambda i: list_position(list_transform(e, lambda x: abs(x - (b[i].x1 + b[i + 1].x0) / 2)), list_min(list_transform(e, lambda x: abs(x - (b[i].x1 + b[i + 1].x0) / 2))))) END AS cuts FROM ed),
    cu AS (SELECT *, coalesce(len(list_distinct(cuts)) = len(cuts) AND list_sort(cuts) = cuts, false) AS apart FROM ct),
    pc AS (SELECT page, k, CAST(j AS INTEGER) AS piece, array_to_string(w[(CASE WHEN j = 1 THEN 0 ELSE cuts[j - 1] END) + 1:CASE WHEN j = len(b) THEN len(w) ELSE cuts[j] END], ' ') AS text, greatest(x0, b[j].x0) AS x0, y0, least(x1, b[j].x1) AS x1, y1, confidence FROM (SELECT *, unnest(range(1, len(b) + 1)) AS j FROM cu WHERE apart)
           UNION ALL SELECT page, k, 0, text, x0, y0, x1, y1, confidence FROM cu WHERE NOT apart)"""


SQL_BUILD = rf"""
    WITH RECURSIVE {SQL_DRAWING},
    pt AS (SELECT page, no, 't' AS e, tx AS x, ty AS y FROM ar UNION ALL SELECT page, no, 'h', hx, hy FROM ar),
    nr AS (SELECT *, row_number() OVER (PARTITION BY page, no, e ORDER BY d, shape) AS place FROM (SELECT pt.page, pt.no, e, sh.no AS shape, {_p("pt.x", "pt.y", "sh.")} AS d FROM pt JOIN sh USING (page)) WHERE d <= 0.05 * sqrt(2000000)),
    tw AS (SELECT ar.page, ar.no, max(shape) FILTER (e = 't' AND place = 1) AS t1, max(d) FILTER (e = 't' AND place = 1) AS td, max(shape) FILTER (e = 't' AND place = 2) AS t2, max(shape) FILTER (e = 'h' AND place = 1) AS h1, max(d) FILTER (e = 'h' AND place = 1) AS hd, max(shape) FILTER (e = 'h' AND place = 2) AS h2 FROM ar LEFT JOIN nr ON nr.page = ar.page AND nr.no = ar.no GROUP BY 1, 2),
    en AS (SELECT page, no, CASE WHEN t1 = h1 AND td >= hd THEN t2 ELSE t1 END AS source, CASE WHEN t1 = h1 AND td < hd THEN h2 ELSE h1 END AS target FROM tw),
    ht AS (SELECT *, y1 - y0 AS h FROM pc WHERE trim(text) <> ''),
    ty AS (SELECT page, h AS typical FROM (SELECT page, h, row_number() OVER (PARTITION BY page ORDER BY h, k, piece) - 1 AS i, count(*) OVER (PARTITION BY page) AS n FROM ht) WHERE i = n // 2),
    tk AS (SELECT ht.* FROM ht JOIN ty USING (page) WHERE (length(regexp_replace(text, '[^a-zA-Z0-9]', '', 'g')) > 2 OR h >= 0.6 * typical)
           AND NOT (length(regexp_replace(text, '\s+', '', 'g')) <= 1 AND EXISTS (SELECT 1 FROM ar WHERE ar.page = ht.page AND {_p("ar.hx", "ar.hy", "ht.")} <= greatest(8, h)))),
    ins AS (SELECT tk.page, tk.k, tk.piece, sh.no FROM tk JOIN sh ON sh.page = tk.page AND (tk.x0 + tk.x1) // 2 BETWEEN sh.x0 AND sh.x1 AND (tk.y0 + tk.y1) // 2 BETWEEN sh.y0 AND sh.y1 QUALIFY row_number() OVER (PARTITION BY tk.page, tk.k, tk.piece ORDER BY (sh.x1 - sh.x0) * (sh.y1 - sh.y0), sh.no) = 1),
    outer_ AS (SELECT tk.*, row_number() OVER (PARTITION BY page ORDER BY y0, x0, k, piece) AS q FROM tk ANTI JOIN ins USING (page, k, piece)),
    st AS (SELECT page, q, [{{'x0': x0, 'x1': x1, 'y1': y1}}] AS tails, CAST(0 AS BIGINT) AS blk FROM outer_ WHERE q = 1
           UNION ALL SELECT page, q, CASE WHEN pos > 0 THEN tails[1:pos - 1] || [{{'x0': x0, 'x1': x1, 'y1': y1}}] || tails[pos + 1:] ELSE tails || [{{'x0': x0, 'x1': x1, 'y1': y1}}] END, CASE WHEN pos > 0 THEN pos - 1 ELSE len(tails) END
           FROM (SELECT o.page, o.q, o.x0, o.x1, o.y1, tails, CAST(coalesce(list_position(list_transform(tails, lambda b: o.y0 - b.y1 + 0.3 * h >= 0 AND o.y0 - b.y1 + 0.3 * h <= 1.3 * h AND least(b.x1, o.x1) - greatest(b.x0, o.x0) >= 0.3 * least(b.x1 - b.x0, o.x1 - o.x0)), true), 0) AS BIGINT) AS pos FROM st JOIN outer_ o ON o.page = st.page AND o.q = st.q + 1)),
    bl AS (SELECT outer_.*, blk FROM outer_ JOIN st USING (page, q)),
    bk AS (SELECT page, blk, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, arg_min(x0, q) AS fx0, arg_min(y0, q) AS fy0, arg_min(x1, q) AS fx1, arg_min(y1, q) AS fy1 FROM bl GROUP BY 1, 2),
    aw AS (SELECT page, no, tx, ty, hx, hy, sqrt(power(hx - tx, 2) + power(hy - ty, 2)) AS l FROM ar WHERE hx <> tx OR hy <> ty),
    al AS (SELECT page, blk, no AS arrow FROM (SELECT bk.page, blk, no, (((bk.x0 + bk.x1) // 2 - tx) * (hx - tx) + ((bk.y0 + bk.y1) // 2 - ty) * (hy - ty)) / (l * l) AS t, abs(((bk.x0 + bk.x1) // 2 - tx) * (hy - ty) - ((bk.y0 + bk.y1) // 2 - ty) * (hx - tx)) / l AS d,
           abs(hy - ty) / l * (bk.x1 - bk.x0) + abs(hx - tx) / l * (bk.y1 - bk.y0) AS across FROM bk JOIN aw USING (page)) WHERE t >= 0.1 AND t <= 0.9 AND d <= across QUALIFY row_number() OVER (PARTITION BY page, blk ORDER BY d, no) = 1),
    na AS (SELECT page, blk, no, d FROM (SELECT bk.page, blk, ar.no, {_d("bk", "ar")} AS d FROM bk JOIN ar USING (page)) WHERE d <= 0.04 * sqrt(2000000) QUALIFY row_number() OVER (PARTITION BY page, blk ORDER BY d, no) = 1),
    ns AS (SELECT page, blk, no, d FROM (SELECT bk.page, blk, sh.no, {_d("bk", "sh")} AS d FROM bk JOIN sh USING (page)) WHERE d <= 0.04 * sqrt(2000000) QUALIFY row_number() OVER (PARTITION BY page, blk ORDER BY d, no) = 1),
    op AS (SELECT bk.page, blk, ar.no, (source IS NULL AND {_p("tx", "ty", "bk.f")} <= 0.04 * sqrt(2000000)) OR (target IS NULL AND {_p("hx", "hy", "bk.f")} <= 0.04 * sqrt(2000000)) AS loose FROM bk JOIN ar USING (page) JOIN en ON en.page = ar.page AND en.no = ar.no),
    de AS (SELECT bk.page, bk.blk, CASE WHEN arrow IS NOT NULL AND NOT o1.loose THEN 'edge' WHEN na.no IS NOT NULL AND (ns.no IS NULL OR na.d <= ns.d) THEN CASE WHEN o2.loose THEN 'free' ELSE 'edge' END WHEN ns.no IS NOT NULL THEN 'node' ELSE 'free' END AS owner,
           CASE WHEN arrow IS NOT NULL AND NOT o1.loose THEN arrow WHEN na.no IS NOT NULL AND (ns.no IS NULL OR na.d <= ns.d) THEN na.no ELSE ns.no END AS no
           FROM bk LEFT JOIN al USING (page, blk) LEFT JOIN na ON na.page = bk.page AND na.blk = bk.blk LEFT JOIN ns ON ns.page = bk.page AND ns.blk = bk.blk LEFT JOIN op o1 ON o1.page = bk.page AND o1.blk = bk.blk AND o1.no = arrow LEFT JOIN op o2 ON o2.page = bk.page AND o2.blk = bk.blk AND o2.no = na.no),
    ch AS (SELECT page, blk, CASE WHEN owner = 'node' AND (turn > 1 OR held) THEN 'free' ELSE owner END AS owner, no FROM (SELECT de.*, row_number() OVER (PARTITION BY page, owner, no ORDER BY blk) AS turn, EXISTS (SELECT 1 FROM ins WHERE ins.page = de.page AND ins.no = de.no) AS held FROM de)),
    ow AS (SELECT tk.*, 'node' AS owner, ins.no FROM tk JOIN ins USING (page, k, piece) UNION ALL SELECT bl.* EXCLUDE (q, blk), ch.owner, ch.no FROM bl JOIN ch USING (page, blk)),
    la AS (SELECT page, owner, no, array_to_string(list_filter(regexp_split_to_array(string_agg(text, ' ' ORDER BY y0, x0, k, piece), '\s+'), lambda w: regexp_replace(w, '[.,;:()\[\]{{}}''"`|_~-]', '', 'g') <> ''), ' ') AS label, min(confidence) AS sure FROM ow WHERE owner <> 'free' GROUP BY 1, 2, 3)
    SELECT sh.page, 'node' AS kind, 'n' || sh.no AS id, NULL AS source, NULL AS target, coalesce(label, '') AS label, NULL AS directed, confidence, sure AS label_confidence FROM sh LEFT JOIN la ON la.page = sh.page AND la.no = sh.no AND la.owner = 'node'
    UNION ALL SELECT ar.page, 'edge', 'e' || ar.no, 'n' || source, 'n' || target, coalesce(label, ''), headed, confidence, sure FROM ar JOIN en ON en.page = ar.page AND en.no = ar.no LEFT JOIN la ON la.page = ar.page AND la.no = ar.no AND la.owner = 'edge'
    UNION ALL SELECT page, 'free', 'f' || row_number() OVER (PARTITION BY page ORDER BY y0, x0, k, piece), NULL, NULL, trim(regexp_replace(text, '\s+', ' ', 'g')), NULL, NULL, confidence FROM ow WHERE owner = 'free'"""


def detections(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """pages, shapes, arrows and texts."""
    from pyspark.sql import Window

    lines = t.lineitem.select(*ORDER, "l_returnflag").join(t.part.select("p_partkey", "p_name"), F.col("p_partkey") == F.col("l_partkey")).withColumn("p_name", F.when(F.col("l_returnflag") == "R", F.col("p_name")))
    rows = lines.join(t.orders.select("o_orderkey", F.col("o_custkey").alias("page")), F.col("o_orderkey") == F.col("l_orderkey"))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("page").orderBy(*ORDER)).cast("long")).withColumn("confidence", F.expr(SURE))
    rows = bucketed(rows.select("page", "k", "l_returnflag", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "p_name", "confidence"), "lines", "page")  # read by each of the tables below
    place = lambda kind: [F.expr(f"CAST({v} AS BIGINT)").alias(k) for k, v in kind.items()]
    of = lambda flag: rows.where(F.col("l_returnflag") == flag)
    pages = rows.select("page").distinct().select("page", F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"))
    shapes = of("A").select("page", "k", *place(SHAPE), "confidence")
    arrows = of("N").select("page", "k", *place(ARROW), F.expr(f"{QTY} % 3 <> 0").alias("headed"), "confidence")
    return pages, shapes, arrows, of("R").select("page", "k", F.expr(TEXT).alias("text"), *place(WORDS), "confidence")


@query(SQL_BUILD)
def gr_build(t: Tables) -> DataFrame:
    """Nodes, edges and free labels of every page."""
    return drawings.build(*detections(t))


@query(f"WITH {SQL_DRAWING} SELECT page, k, piece, text, x0, x1 FROM pc WHERE piece > 0")
def gr_split_text(t: Tables) -> DataFrame:
    """Lines over several shapes of their page, cut into the text of each."""
    pages, shapes, _, texts = detections(t)
    pages = drawings.reaches(pages)
    return drawings.split_texts(texts, drawings.numbered(shapes, ["y0", "x0"]), pages).where("piece > 0").select("page", "k", "piece", "text", "x0", "x1")
