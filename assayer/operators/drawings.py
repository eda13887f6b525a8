"""Drawings from detections: shapes become nodes, arrows edges between the shapes that their ends touch, and recognised lines labels of either.

A page's rows are dealt together once, and all tables that are staged lie in buckets of pages, so nothing that is joined by page and number is moved again.

What is near what is found by cells of a grid: boxes, widened by the reach that is asked for, meet in the cells that they cover, and a pair counts in the one cell that holds the corner of what they share. Reaches are shares of a page's diagonal, so a page has some four hundred cells at most.

Tables: pages(page, width, height), shapes(page, k, x0, y0, x1, y1, confidence), arrows(page, k, tx, ty, hx, hy, headed, confidence), texts(page, k, text, x0, y0, x1, y1, confidence); k orders what is otherwise equal. Coordinates are whole pixels.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.operators.state import fold
from assayer.sources.shared import bucketed, dealt_once

#: Reaches as shares of the diagonal and in pixels at least, and the least confidence of shapes and arrows.
ATTACH, BESIDE, LEAST_PX, LEAST_CONFIDENCE = 0.05, 0.04, 12, 0.3
#: Marks that are specks or outlines read as text.
STRAY = ".,;:()[]{}'\"`|_-~"


def gap(lo: Column, hi: Column, other_lo: Column, other_hi: Column) -> Column:
    return F.greatest(lo - other_hi, other_lo - hi, F.lit(0)).cast("double")


def root(x: Column, y: Column) -> Column:
    """The length of (x, y). Of whole numbers, equal lengths come out equal."""
    return F.sqrt(x * x + y * y)


def distance(a: str, b: str) -> Column:
    """Between the boxes a_x0 ... and b_x0 ...; a point is a box without extent."""
    c = lambda k, at: F.col(f"{k}_{at}")
    return root(*(gap(c(a, f"{x}0"), c(a, f"{x}1"), c(b, f"{x}0"), c(b, f"{x}1")) for x in "xy"))


def boxes(df: DataFrame, name: str, by: Column | float = 0.0, **corners: Column) -> DataFrame:
    """The table with its columns prefixed, but for page, and a widened box to meet others with."""
    corners = {k: corners.get(k, F.col(k)) for k in ("x0", "y0", "x1", "y1")} if not set(corners) >= {"x0", "y0", "x1", "y1"} else corners
    by = by if isinstance(by, Column) else F.lit(by)
    wide = {f"{name}_{k}": v for k, v in corners.items()} | {f"{name}__{k}": (v - by if k[1] == "0" else v + by).cast("double") for k, v in corners.items()}
    return df.select("page", *(F.col(c).alias(f"{name}_{c}") for c in df.columns if c != "page" and c not in corners), *(v.alias(k) for k, v in wide.items()))


def meeting(a: DataFrame, an: str, b: DataFrame, bn: str, pages: DataFrame) -> DataFrame:
    """Pairs of a page whose widened boxes meet, each once."""

    def dealt(df: DataFrame, n: str) -> DataFrame:
        cells = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(f"{n}__{lo}") / F.col("cell")), F.floor(F.col(f"{n}__{hi}") / F.col("cell"))))
        return df.join(pages.select("page", F.col("attach").alias("cell")), "page").select("*", cells("x0", "x1").alias("cx")).select("*", cells("y0", "y1").alias("cy"))

    pairs = dealt(a, an).join(dealt(b, bn).drop("cell"), ["page", "cx", "cy"])
    c = lambda n, k: F.col(f"{n}__{k}")
    for x in "xy":
        pairs = pairs.where((c(an, f"{x}0") <= c(bn, f"{x}1")) & (c(bn, f"{x}0") <= c(an, f"{x}1")) & (F.floor(F.greatest(c(an, f"{x}0"), c(bn, f"{x}0")) / F.col("cell")) == F.col(f"c{x}")))
    return pairs.drop("cell", "cx", "cy", *(f"{n}__{k}" for n in (an, bn) for k in ("x0", "y0", "x1", "y1")))


def reaches(pages: DataFrame) -> DataFrame:
    """pages with attach and beside."""
    diagonal = F.hypot(F.col("width").cast("double"), F.col("height").cast("double"))
    return pages.select("page", *(F.greatest(F.lit(float(LEAST_PX)), F.lit(share) * diagonal).alias(name) for name, share in (("attach", ATTACH), ("beside", BESIDE))))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """What is confident enough, with its number no on its page."""
    return rows.where(F.col("confidence") >= LEAST_CONFIDENCE).withColumn("no", F.row_number().over(Window.partitionBy("page").orderBy(*order, "k")))


def ends(arrows: DataFrame, shapes: DataFrame, pages: DataFrame) -> DataFrame:
    """page, no, source, target: for each numbered arrow the shapes nearest to its ends within reach. If both ends are nearest to one shape, the end farther from it (the tail, if as far) takes its next shape instead."""
    points = arrows.select("page", "no", F.explode(F.array(*(F.struct(F.lit(e).alias("end"), F.col(f"{e}x").alias("x"), F.col(f"{e}y").alias("y")) for e in "th"))).alias("p")).select("page", "no", "p.*")
    at = {k: F.col(k[0]) for k in ("x0", "y0", "x1", "y1")}
    reach = pages.select("page", "attach")
    met = meeting(boxes(points, "p", 0.0, **at), "p", boxes(shapes.join(reach, "page"), "s", F.col("attach")), "s", pages)
    d = distance("p", "s")
    near = met.select("page", F.col("p_no").alias("no"), F.col("p_end").alias("end"), d.alias("d"), F.col("s_no").alias("shape"), "s_attach").where("d <= s_attach")
    place = F.row_number().over(Window.partitionBy("page", "no", "end").orderBy("d", "shape"))
    two = near.withColumn("place", place).where("place <= 2").groupBy("page", "no").pivot("end", ["t", "h"]).agg(F.min_by("shape", "place").alias("s1"), F.min("d").alias("d1"), F.max(F.when(F.col("place") == 2, F.col("shape"))).alias("s2"))
    same = F.coalesce(F.col("t_s1") == F.col("h_s1"), F.lit(False))
    tail_moves = same & (F.col("t_d1") >= F.col("h_d1"))
    found = two.select("page", "no", F.when(tail_moves, F.col("t_s2")).otherwise(F.col("t_s1")).alias("source"), F.when(same & ~tail_moves, F.col("h_s2")).otherwise(F.col("h_s1")).alias("target"))
    return arrows.select("page", "no").join(found, ["page", "no"], "left")


def split_texts(texts: DataFrame, shapes: DataFrame, pages: DataFrame) -> DataFrame:
    """texts with piece: a line over several shapes side by side, each overlapping half its height, is cut at the word boundaries nearest the middles of the gaps between them; a word's place is taken from its characters. A piece has the part of the box over its shape. Lines whose cuts don't fall apart, of one word or over one shape stay whole (piece 0)."""
    met = meeting(boxes(texts, "t"), "t", boxes(shapes, "s"), "s", pages)
    c = F.col
    over = (F.least(c("t_y1"), c("s_y1")) - F.greatest(c("t_y0"), c("s_y0")) >= 0.5 * (c("t_y1") - c("t_y0"))) & (F.least(c("t_x1"), c("s_x1")) > F.greatest(c("t_x0"), c("s_x0")))
    beside = met.where(over).groupBy("page", c("t_k").alias("k")).agg(F.array_sort(F.collect_list(F.struct(c("s_x0").alias("x0"), c("s_no").alias("no"), c("s_x1").alias("x1")))).alias("b")).where(F.size("b") > 1)
    rows = texts.join(beside, ["page", "k"], "left").withColumn("w", F.filter(F.split("text", r"\s+"), lambda x: x != ""))
    n = F.size("w")
    width, length = c("x1") - c("x0"), F.length(F.array_join("w", " "))
    ends_of = F.transform(F.sequence(F.lit(1), n - 1), lambda i: c("x0") + width * (F.length(F.array_join(F.slice("w", 1, i), " ")) + 0.5) / length)
    many = F.col("b").isNotNull() & (n > 1)
    rows = rows.withColumn("e", F.when(many, ends_of))
    middles = F.transform(F.sequence(F.lit(1), F.size("b") - 1), lambda i: (F.element_at("b", i)["x1"] + F.element_at("b", i + 1)["x0"]) / 2)
    cuts = F.transform(middles, lambda m: F.array_position(F.transform("e", lambda x: F.abs(x - m)), F.array_min(F.transform("e", lambda x: F.abs(x - m)))).cast("int"))
    rows = rows.withColumn("cuts", F.when(many, cuts))
    apart = F.coalesce(F.size("cuts") == F.size(F.array_distinct("cuts")), F.lit(False)) & F.coalesce(F.array_sort("cuts") == F.col("cuts"), F.lit(False))
    starts, stops = F.concat(F.array(F.lit(0)), "cuts"), F.concat("cuts", F.array(n))
    pieces = F.transform("b", lambda s, i: F.struct((i + 1).alias("piece"), F.array_join(F.slice("w", F.get(starts, i) + 1, F.get(stops, i) - F.get(starts, i)), " ").alias("text"), F.greatest("x0", s["x0"]).alias("x0"), F.least("x1", s["x1"]).alias("x1")))
    whole = F.array(F.struct(F.lit(0).alias("piece"), F.col("text").alias("text"), F.col("x0").alias("x0"), F.col("x1").alias("x1")))
    out = rows.withColumn("p", F.explode(F.when(apart, pieces).otherwise(whole)))
    return out.select("page", "k", "p.piece", "p.text", "p.x0", "y0", "p.x1", "y1", "confidence")


def without_marks(texts: DataFrame, arrows: DataFrame, pages: DataFrame) -> DataFrame:
    """Texts that are no specks (two letters or digits at most, lower than 0.6 of the page's typical line) nor a single character on an arrow's head."""
    rows = texts.where(F.trim("text") != "").withColumn("h", F.col("y1") - F.col("y0"))
    w = Window.partitionBy("page").orderBy("h", "k", "piece")
    typical = rows.select("page", "h", (F.row_number().over(w) - 1).alias("i"), F.count("*").over(Window.partitionBy("page")).alias("n")).where("i = floor(n / 2)").select("page", F.col("h").alias("typical"))
    rows = rows.join(typical, "page").where((F.length(F.regexp_replace("text", r"[^\p{L}\p{N}]", "")) > 2) | (F.col("h") >= 0.6 * F.col("typical"))).drop("typical")
    single = rows.where(F.length(F.regexp_replace("text", r"\s+", "")) <= 1)
    met = meeting(boxes(single, "t", F.greatest(F.lit(8), F.col("h"))), "t", boxes(arrows.select("page", "hx", "hy"), "a", 0.0, x0=F.col("hx"), y0=F.col("hy"), x1=F.col("hx"), y1=F.col("hy")), "a", pages)
    marks = met.where(distance("t", "a") <= F.greatest(F.lit(8), F.col("t_h"))).select("page", F.col("t_k").alias("k"), F.col("t_piece").alias("piece")).distinct()
    return rows.join(marks, ["page", "k", "piece"], "left_anti").drop("h")


def stacked(texts: DataFrame) -> DataFrame:
    """texts with block: a line goes to the first block whose last line it begins below of, within its own height and a little, and overlaps sideways by 0.3 of the narrower; else it begins a block."""

    def step(tails: list, row: Any) -> tuple[list, tuple]:
        h = row.y1 - row.y0
        for i, (x0, x1, y1) in enumerate(tails):
            if 0 <= row.y0 - y1 + 0.3 * h <= 1.3 * h and min(x1, row.x1) - max(x0, row.x0) >= 0.3 * min(x1 - x0, row.x1 - row.x0):
                break
        else:
            i = len(tails)
            tails.append(None)
        tails[i] = (row.x0, row.x1, row.y1)
        return tails, (row.page, row.k, row.piece, i)

    found = fold(texts.select("page", "k", "piece", "x0", "y0", "x1", "y1"), "page", ["y0", "x0", "k", "piece"], "page long, k long, piece int, block int", list, step)
    return texts.join(found, ["page", "k", "piece"])


def along(blocks: DataFrame, arrows: DataFrame, pages: DataFrame) -> DataFrame:
    """page, block, arrow: the arrow that a block is written along. The block's middle falls on the middle eight tenths of the arrow's line, no farther off than the block reaches across it; the nearest such arrow."""
    size = F.col("x1") - F.col("x0") + F.col("y1") - F.col("y0")
    met = meeting(boxes(blocks.select("page", "block", "x0", "y0", "x1", "y1"), "b", size), "b", boxes(arrows.select("page", "no", "tx", "ty", "hx", "hy", "x0", "y0", "x1", "y1"), "a"), "a", pages)
    c = F.col
    dx, dy = c("a_hx") - c("a_tx"), c("a_hy") - c("a_ty")
    mx, my = F.floor((c("b_x0") + c("b_x1")) / 2) - c("a_tx"), F.floor((c("b_y0") + c("b_y1")) / 2) - c("a_ty")
    length = root(dx.cast("double"), dy.cast("double"))
    met = met.withColumn("l", length).where("l > 0").withColumns({"t": (mx * dx + my * dy) / (F.col("l") * F.col("l")), "d": F.abs(mx * dy - my * dx) / F.col("l")})
    across = F.abs(dy) / F.col("l") * (c("b_x1") - c("b_x0")) + F.abs(dx) / F.col("l") * (c("b_y1") - c("b_y0"))
    return met.where((F.col("t") >= 0.1) & (F.col("t") <= 0.9) & (F.col("d") <= across)).groupBy("page", c("b_block").alias("block")).agg(F.min_by("a_no", F.struct("d", "a_no")).alias("arrow"))


def nearest(blocks: DataFrame, others: DataFrame, pages: DataFrame, name: str) -> DataFrame:
    """page, block, {name}, {name}_d: the nearest of numbered boxes, within `beside`."""
    wide = blocks.join(pages.select("page", "beside"), "page")
    met = meeting(boxes(wide.select("page", "block", "beside", "x0", "y0", "x1", "y1"), "b", F.col("beside")), "b", boxes(others.select("page", "no", "x0", "y0", "x1", "y1"), "o"), "o", pages)
    near = met.select("page", F.col("b_block").alias("block"), F.col("o_no").alias("no"), distance("b", "o").alias("d"), "b_beside").where("d <= b_beside")
    return near.groupBy("page", "block").agg(F.min(F.struct("d", "no")).alias("m")).select("page", "block", F.col("m.no").alias(name), F.col("m.d").alias(f"{name}_d"))


def owners(texts: DataFrame, shapes: DataFrame, arrows: DataFrame, arrow_ends: DataFrame, pages: DataFrame) -> DataFrame:
    """texts with owner (`node`, `edge` or `free`) and no: what each labels. A line whose middle is in shapes labels the smallest. The others are stacked into blocks; a block labels the arrow that it is written along, else the nearest arrow within reach, if no shape is nearer, else the nearest shape within reach, if that has no text yet. A block at an arrow's end without a shape is a name, and free."""
    middle = {k: F.floor((F.col(f"{k[0]}0") + F.col(f"{k[0]}1")) / 2) for k in ("x0", "y0", "x1", "y1")}
    met = meeting(boxes(texts.select("page", "k", "piece", "x0", "y0", "x1", "y1"), "t", 0.0, **middle), "t", boxes(shapes.select("page", "no", "x0", "y0", "x1", "y1"), "s"), "s", pages)
    area = (F.col("s_x1") - F.col("s_x0")) * (F.col("s_y1") - F.col("s_y0"))
    held = met.groupBy("page", F.col("t_k").alias("k"), F.col("t_piece").alias("piece")).agg(F.min_by("s_no", F.struct(area, "s_no")).alias("no"))
    texts = texts.join(held, ["page", "k", "piece"], "left")
    texts = bucketed(texts, "held", "page")
    inside = texts.where("no IS NOT NULL")
    lines = bucketed(stacked(texts.where("no IS NULL").drop("no")), "outside", "page")
    top = F.struct("y0", "x0", "k", "piece")
    blocks = lines.groupBy("page", "block").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.min_by(F.struct("x0", "y0", "x1", "y1"), top).alias("first"))
    blocks = bucketed(blocks, "blocks", "page")
    met = blocks.join(along(blocks, arrows, pages), ["page", "block"], "left").join(nearest(blocks, arrows, pages, "near_arrow"), ["page", "block"], "left").join(nearest(blocks, shapes, pages, "near_shape"), ["page", "block"], "left")
    ends_of = arrows.select("page", "no", "tx", "ty", "hx", "hy").join(arrow_ends, ["page", "no"])
    for name in ("arrow", "near_arrow"):
        at = ends_of.select("page", F.col("no").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in ("tx", "ty", "hx", "hy", "source", "target")))
        met = met.join(at, ["page", name], "left")
        off = lambda e, n=name: root(*(gap(F.col(f"{n}_{e}{x}"), F.col(f"{n}_{e}{x}"), F.col(f"first.{x}0"), F.col(f"first.{x}1")) for x in "xy"))
        loose = [F.col(f"{name}_{end}").isNull() & (off(e) <= F.col("beside")) for e, end in (("t", "source"), ("h", "target"))]
        met = (met if "beside" in met.columns else met.join(pages.select("page", "beside"), "page")).withColumn(f"{name}_open", F.coalesce(loose[0] | loose[1], F.lit(False)))
    by_line = F.col("arrow").isNotNull() & ~F.col("arrow_open")
    by_arrow = F.col("near_arrow").isNotNull() & (F.col("near_shape").isNull() | (F.col("near_arrow_d") <= F.col("near_shape_d")))
    said = F.when(by_line, F.struct(F.lit("edge").alias("owner"), F.col("arrow").alias("no"))).when(by_arrow & F.col("near_arrow_open"), None).when(by_arrow, F.struct(F.lit("edge").alias("owner"), F.col("near_arrow").alias("no"))).when(F.col("near_shape").isNotNull(), F.struct(F.lit("node").alias("owner"), F.col("near_shape").alias("no")))
    met = met.select("page", "block", said["owner"].alias("owner"), said["no"].alias("no"))
    full = inside.select("page", "no").distinct().withColumn("full", F.lit(True)).withColumn("owner", F.lit("node"))
    met = met.join(full, ["page", "owner", "no"], "left").withColumn("turn", F.row_number().over(Window.partitionBy("page", "owner", "no").orderBy("block")))
    lost = F.coalesce((F.col("owner") == "node") & (F.col("full").isNotNull() | (F.col("turn") > 1)), F.lit(False)) | F.col("owner").isNull()
    chosen = met.select("page", "block", F.when(lost, "free").otherwise(F.col("owner")).alias("owner"), F.when(~lost, F.col("no")).alias("no"))
    every = lines.join(chosen, ["page", "block"]).drop("block")
    return inside.withColumn("owner", F.lit("node")).select(every.columns).unionByName(every)


def labels(owned: DataFrame) -> DataFrame:
    """page, owner, no, label, sure: the words of an element's lines in reading order without stray marks, and the least confidence."""
    parts = F.array_sort(F.collect_list(F.struct("y0", "x0", "k", "piece", "text")))
    words = F.filter(F.split(F.array_join(F.transform(parts, lambda p: p["text"]), " "), r"\s+"), lambda w: F.translate(w, STRAY, "") != "")
    return owned.where("owner <> 'free'").groupBy("page", "owner", "no").agg(F.array_join(words, " ").alias("label"), F.min("confidence").alias("sure"))


def build(pages: DataFrame, shapes: DataFrame, arrows: DataFrame, texts: DataFrame) -> DataFrame:
    """page, kind (`node`, `edge`, `free`), id, source, target, label, directed, confidence, label_confidence: the graph of each page. Ends near no shape are null. Free labels have the number of their order as id."""
    with dealt_once(pages.sparkSession):
        return bucketed(_built(pages, shapes, arrows, texts), "graphs", "page")


def _built(pages: DataFrame, shapes: DataFrame, arrows: DataFrame, texts: DataFrame) -> DataFrame:
    pages = bucketed(reaches(pages), "pages", "page")
    shapes = bucketed(numbered(shapes.drop("kind"), ["y0", "x0"]), "shapes", "page")
    least = lambda x: F.least(f"t{x}", f"h{x}")
    most = lambda x: F.greatest(f"t{x}", f"h{x}")
    arrows = numbered(arrows, ["ty", "tx"]).withColumns({"x0": least("x"), "y0": least("y"), "x1": most("x"), "y1": most("y")})
    arrows = bucketed(arrows, "arrows", "page")
    arrow_ends = bucketed(ends(arrows, shapes, pages), "ends", "page")
    pieces = bucketed(without_marks(split_texts(texts, shapes, pages), arrows, pages), "pieces", "page")
    owned = bucketed(owners(pieces, shapes, arrows, arrow_ends, pages), "owned", "page")
    said = labels(owned)
    node = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit("n"), F.col(c)))
    of = lambda kind: said.where(F.col("owner") == kind).drop("owner")
    label = F.coalesce("label", F.lit(""))
    nothing = F.lit(None).cast("string")
    nodes = shapes.join(of("node"), ["page", "no"], "left").select("page", F.lit("node").alias("kind"), F.concat(F.lit("n"), F.col("no")).alias("id"), nothing.alias("source"), nothing.alias("target"), label.alias("label"), F.lit(None).cast("boolean").alias("directed"), F.round("confidence", 4).alias("confidence"), F.col("sure").alias("label_confidence"))
    edges = arrows.join(arrow_ends, ["page", "no"]).join(of("edge"), ["page", "no"], "left").select("page", F.lit("edge").alias("kind"), F.concat(F.lit("e"), F.col("no")).alias("id"), node("source").alias("source"), node("target").alias("target"), label.alias("label"), F.col("headed").alias("directed"), F.round("confidence", 4).alias("confidence"), F.col("sure").alias("label_confidence"))
    place = F.row_number().over(Window.partitionBy("page").orderBy("y0", "x0", "k", "piece"))
    free = owned.where("owner = 'free'").select("page", F.lit("free").alias("kind"), F.concat(F.lit("f"), place).alias("id"), nothing.alias("source"), nothing.alias("target"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("label"), F.lit(None).cast("boolean").alias("directed"), F.lit(None).cast("double").alias("confidence"), F.col("confidence").alias("label_confidence"))
    return nodes.unionByName(edges).unionByName(free)
