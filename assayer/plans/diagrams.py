"""Diagrams: reference and student graphs of an order, compared; detections, alignment and labels on pages.

An order's lines that were not returned are the nodes of its reference graph, those not accepted the nodes of the student's; a node is a line number, labelled by its part. Each node has an edge to the next number; the student's edges from large quantities are drawn the wrong way round, and edges to numbers without a node dangle.
"""

from __future__ import annotations

from typing import Any

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions import udfs
from assayer.functions.text import norm_distance
from assayer.operators import assignment, fitting, graphs
from assayer.operators.state import fold
from assayer.registry import Tables, query
from assayer.sources.shared import staged

#: What labels, shapes and degrees weigh in the cost of a pair of nodes, and the most that is accepted.
LABEL, SHAPE, DEGREE, ACCEPT = 0.6, 0.25, 0.15, 0.7
#: Labels up to this distance are close.
CLOSE = 0.34


def _nodes(t: Tables, side: str) -> DataFrame:
    """graph, node, label, shape: of the lines with a number the first one."""
    gone = "R" if side == "truth" else "A"
    first = t.lineitem.where(F.col("l_returnflag") != gone).groupBy(F.col("l_orderkey").alias("graph"), F.col("l_linenumber").alias("node")).agg(F.min(F.struct("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")).alias("l"))
    rows = first.join(t.part.select("p_partkey", "p_name", "p_type"), F.col("l.l_partkey") == F.col("p_partkey"))
    label = F.lower("p_name") if side == "truth" else F.when(F.col("l.l_quantity") > 25, F.translate(F.lower("p_name"), "a", "e")).otherwise(F.lower("p_name"))
    return rows.select("graph", "node", label.alias("label"), F.col("p_type").alias("shape"))


def _edges_of(t: Tables, side: str, nodes: DataFrame) -> DataFrame:
    """graph, source, target with null ends where there is no node."""
    gone = "R" if side == "truth" else "A"
    n, up = F.col("l_linenumber"), F.col("l_linenumber") + 1
    turned = F.col("l_quantity") > 40 if side == "drawn" else F.lit(False)
    rows = t.lineitem.where(F.col("l_returnflag") != gone).select(F.col("l_orderkey").alias("graph"), F.when(turned, up).otherwise(n).alias("source"), F.when(turned, n).otherwise(up).alias("target")).distinct()
    there = nodes.select("graph", "node")
    for end in ("source", "target"):
        rows = rows.join(there.withColumnRenamed("node", end).withColumn("__ok", F.lit(True)), ["graph", end], "left").withColumn(end, F.when(F.col("__ok"), F.col(end))).drop("__ok")
    return rows.select("graph", "source", "target")


def with_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select("graph", F.explode(F.array("source", "target")).alias("node")).where("node IS NOT NULL")
    return nodes.join(ends.groupBy("graph", "node").agg(F.count("*").alias("degree")), ["graph", "node"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def node_pairs(truth: DataFrame, drawn: DataFrame) -> DataFrame:
    """graph, truth, drawn, cost, quality: nodes (graph, node, label, shape, degree) of each graph paired at the least total cost; pairs above ACCEPT are none. A graph is one drawing: its cost matrix is made in one task."""
    both = truth.withColumn("side", F.lit(0)).unionByName(drawn.withColumn("side", F.lit(1)))

    def step(sides: tuple[list, list], row: Any) -> tuple[tuple[list, list], None]:
        sides[row.side].append(row)
        return sides, None

    def pair(sides: tuple[list, list]) -> list[tuple]:
        a, b = sides
        if not a or not b:
            return []
        cost, quality = [], []
        for r in a:
            costs, qualities = [], []
            for s in b:
                shape = 0.0 if r.shape == s.shape else 0.5 if "SMALL" in (r.shape, s.shape) else 1.0  # SMALL stands for a shape that is not known
                apart = LABEL * udfs.label_distance(r.label or "", s.label or "") + SHAPE * shape
                costs.append(apart + DEGREE * abs(r.degree - s.degree) / max(1, r.degree, s.degree))
                qualities.append(1 - apart / (LABEL + SHAPE))
            cost.append(costs)
            quality.append(qualities)
        found = assignment.saving_of([[c if c <= ACCEPT else np.inf for c in row] for row in cost])
        return [(a[0].graph, a[i].node, b[j].node, cost[i][j], quality[i][j]) for i, j in found]

    return fold(both, "graph", ["side", "node"], "graph long, truth int, drawn int, cost double, quality double", lambda: ([], []), step, pair)


@query()
def gr_assign(t: Tables) -> DataFrame:
    return _compared(t)[2].select("graph", "truth", "drawn", F.round("cost", 6).alias("cost"))


def edge_states(truth: DataFrame, drawn: DataFrame, pairs: DataFrame) -> DataFrame:
    """graph, source, target, state of the edges (graph, source, target): a reference edge between paired nodes is present, or reversed, or else missing, as is any other; the student's other edges are extra (`dangling` without an end). Ends of extra edges are the student's nodes."""
    to = pairs.select("graph", F.col("truth").alias("__n"), F.col("drawn").alias("__d"))
    for end in ("source", "target"):
        truth = truth.join(to.withColumnsRenamed({"__n": end, "__d": f"d_{end}"}), ["graph", end], "left")
    there = drawn.where("source IS NOT NULL AND target IS NOT NULL").select("graph", "source", "target").distinct()
    ahead = there.select("graph", F.col("source").alias("d_source"), F.col("target").alias("d_target"), F.lit(True).alias("__ahead"))
    back = there.select("graph", F.col("target").alias("d_source"), F.col("source").alias("d_target"), F.lit(True).alias("__back"))
    key = ["graph", "d_source", "d_target"]
    known = truth.join(ahead, key, "left").join(back, key, "left").withColumn("state", F.when(F.col("__ahead"), "present").when(F.col("__back"), "reversed").otherwise("missing"))
    used = known.where("state <> 'missing'").select("graph", F.when(F.col("state") == "present", F.col("d_source")).otherwise(F.col("d_target")).alias("source"), F.when(F.col("state") == "present", F.col("d_target")).otherwise(F.col("d_source")).alias("target"))
    loose = F.col("source").isNull() | F.col("target").isNull()
    extra = drawn.join(used.withColumn("__used", F.lit(True)), ["graph", "source", "target"], "left").where("__used IS NULL").select("graph", "source", "target", F.when(loose, "dangling").otherwise("extra").alias("state"))
    return known.select("graph", "source", "target", "state").unionByName(extra)


def similarity(nodes: tuple[DataFrame, DataFrame], edges: tuple[DataFrame, DataFrame], pairs: DataFrame) -> DataFrame:
    """graph, similarity, node_score, edge_score, distance: 1 less the edit distance by the sizes of both graphs; the nodes' and the edges' own scores, in which a reversed edge is half."""
    count = lambda df, name: df.groupBy("graph").agg(F.count("*").alias(name))
    sums = pairs.groupBy("graph").agg(F.count("*").alias("k"), F.sum("quality").alias("q"))
    states = edge_states(*edges, pairs).groupBy("graph").agg(F.count_if(F.col("state") == "present").alias("present"), F.count_if(F.col("state") == "reversed").alias("turned"), F.count_if(F.col("state") != "present").alias("wrong"))
    rows = count(nodes[0], "n").join(count(nodes[1], "m"), "graph", "full")
    for other in (count(edges[0], "a"), count(edges[1], "b"), sums, states):
        rows = rows.join(other, "graph", "left")
    rows = rows.fillna(0)
    c = F.col
    distance = (c("n") + c("m") - c("k") - c("q")) + c("wrong")  # k pairs leave 1 - quality each, and the nodes alone 1 each
    size, lines = c("n") + c("m") + c("a") + c("b"), c("a") + c("b")
    share = lambda over, under: F.round(F.when(under == 0, 1.0).otherwise(over / F.nullif(under, F.lit(0))), 4)
    return rows.select("graph", F.round(F.greatest(F.lit(0.0), 1 - distance / size), 4).alias("similarity"), share(2 * c("q"), c("n") + c("m")).alias("node_score"), share(2 * (c("present") + 0.5 * c("turned")), lines).alias("edge_score"), F.round(distance, 4).alias("distance"))


def _compared(t: Tables) -> tuple:
    """Both graphs' nodes and edges, and the pairs: staged, as what follows reads them several times."""
    sides = ("truth", "drawn")
    nodes = tuple(staged(_nodes(t, s), f"nodes-{s}") for s in sides)
    edges = tuple(staged(_edges_of(t, s, n), f"edges-{s}") for s, n in zip(sides, nodes, strict=True))
    return nodes, edges, staged(node_pairs(*(with_degrees(n, e) for n, e in zip(nodes, edges, strict=True))), "pairs")


@query()
def gr_similarity(t: Tables) -> DataFrame:
    return similarity(*_compared(t))


@query()
def gr_edges(t: Tables) -> DataFrame:
    _, edges, pairs = _compared(t)
    return edge_states(*edges, pairs)


@query("""
    WITH t AS (SELECT DISTINCT l_orderkey AS graph, l_linenumber AS source, l_linenumber + 1 AS target FROM lineitem WHERE l_returnflag <> 'R'), d AS (SELECT DISTINCT l_orderkey AS graph, CASE WHEN l_quantity > 40 THEN l_linenumber + 1 ELSE l_linenumber END AS source, CASE WHEN l_quantity > 40 THEN l_linenumber ELSE l_linenumber + 1 END AS target FROM lineitem WHERE l_returnflag <> 'A'), k AS (SELECT graph, source, target FROM t UNION SELECT graph, source, target FROM d)
    SELECT k.graph, k.source, k.target, CASE WHEN EXISTS (SELECT 1 FROM t WHERE t.graph = k.graph AND t.source = k.source AND t.target = k.target) THEN
        CASE WHEN EXISTS (SELECT 1 FROM d WHERE d.graph = k.graph AND d.source = k.source AND d.target = k.target) THEN 'present' WHEN EXISTS (SELECT 1 FROM d WHERE d.graph = k.graph AND d.source = k.target AND d.target = k.source) THEN 'reversed' ELSE 'missing' END
        WHEN EXISTS (SELECT 1 FROM t WHERE t.graph = k.graph AND t.source = k.target AND t.target = k.source) THEN 'reversed of another' ELSE 'extra' END AS state FROM k""")
def gr_edges_by_number(t: Tables) -> DataFrame:
    """Edges of graphs whose nodes have the same names."""
    n, up = F.col("l_linenumber"), F.col("l_linenumber") + 1
    turned = F.col("l_quantity") > 40
    truth = t.lineitem.where("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("graph"), n.alias("source"), up.alias("target"))
    drawn = t.lineitem.where("l_returnflag <> 'A'").select(F.col("l_orderkey").alias("graph"), F.when(turned, up).otherwise(n).alias("source"), F.when(turned, n).otherwise(up).alias("target"))
    return graphs.compare_edges(truth, drawn, "graph", "source", "target")


def parts_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph, node, part: connected parts of each graph, direction ignored; a node without an edge is a part of its own."""
    name = lambda n: F.concat_ws("/", F.col("graph").cast("string"), F.lpad(n.cast("string"), 10, "0"))
    whole = edges.where("source IS NOT NULL AND target IS NOT NULL").select(name(F.col("source")).alias("s"), name(F.col("target")).alias("t"))
    found = graphs.connected(whole, "s", "t").select(F.col("node").alias("__k"), "part")
    rows = nodes.select("graph", "node", name(F.col("node")).alias("__k")).join(found, "__k", "left")
    return rows.select("graph", "node", F.coalesce("part", "__k").alias("part"))


def anomalies(nodes: tuple[DataFrame, DataFrame], edges: tuple[DataFrame, DataFrame], pairs: DataFrame) -> DataFrame:
    """graph, anomaly, student: nodes and edges of the student that the reference has not, dangling and reversed edges, and the nodes of parts beside the main one where the student's graph has more parts than the reference's. The main part has the most paired nodes, then the most nodes, then the first."""
    matched = pairs.select("graph", F.col("drawn").alias("node"), F.lit(1).alias("hit"))
    own = nodes[1].select("graph", "node")
    out = own.join(matched, ["graph", "node"], "left_anti").select("graph", F.lit("extra node").alias("anomaly"), F.col("node").cast("string").alias("student"))
    states = edge_states(*edges, pairs).where("state IN ('extra', 'dangling', 'reversed')")
    ends = F.concat(F.coalesce(F.col("source").cast("string"), F.lit("?")), F.lit(">"), F.coalesce(F.col("target").cast("string"), F.lit("?")))
    out = out.unionByName(states.select("graph", F.concat(F.col("state"), F.lit(" edge")).alias("anomaly"), ends.alias("student")))
    parts = parts_of(nodes[1], edges[1]).join(matched, ["graph", "node"], "left")
    sizes = parts.groupBy("graph", "part").agg(F.count("hit").alias("hits"), F.count("*").alias("size"))
    main = sizes.groupBy("graph").agg(F.count("*").alias("parts"), F.min(F.struct((-F.col("hits")).alias("h"), (-F.col("size")).alias("s"), "part")).alias("m"))
    reference = parts_of(nodes[0], edges[0]).groupBy("graph").agg(F.count_distinct("part").alias("wanted"))
    apart = main.join(reference, "graph", "left").where(F.col("parts") > F.greatest(F.lit(1), F.coalesce("wanted", F.lit(0)))).select("graph", F.col("m.part").alias("main"))
    return out.unionByName(parts.join(apart, "graph").where("part <> main").select("graph", F.lit("disconnected").alias("anomaly"), F.col("node").cast("string").alias("student")))


def extra_labels(free: DataFrame, known: DataFrame) -> DataFrame:
    """graph, anomaly, student: labels of free(graph, label) that stand beside no element and are no close match of any label that the reference has, known(graph, label). Equal labels meet first; only the others are measured against the labels of their own drawing."""
    rest = free.join(known.select("graph", "label").distinct(), ["graph", "label"], "left_anti").withColumn("__id", F.monotonically_increasing_id())
    rest = staged(rest, "labels")
    near = rest.join(known.select("graph", F.col("label").alias("__k")).distinct(), "graph").where(norm_distance(F.col("label"), F.col("__k")) <= CLOSE).select("__id").distinct()
    return rest.join(near, "__id", "left_anti").select("graph", F.lit("extra label").alias("anomaly"), F.col("label").alias("student"))


def _free_labels(t: Tables) -> DataFrame:
    """Labels that the student wrote beside no element: the containers named on small lines."""
    rows = t.lineitem.where("l_quantity <= 5").join(t.part.select("p_partkey", "p_name", "p_type"), F.col("p_partkey") == F.col("l_partkey"))
    return rows.select(F.col("l_orderkey").alias("graph"), F.lower(F.when(F.col("l_quantity") <= 2, F.concat("p_name", F.lit("s"))).otherwise(F.concat("p_type", F.lit(" "), "p_name"))).alias("label"))


@query()
def gr_anomalies(t: Tables) -> DataFrame:
    nodes, edges, pairs = _compared(t)
    return anomalies(nodes, edges, pairs).unionByName(extra_labels(_free_labels(t), nodes[0].select("graph", F.lower("label").alias("label"))))


@query()
def jsn_comparison_doc(t: Tables) -> DataFrame:
    """Each graph's comparison as a document: similarity, scores, the state of its edges and its pairs."""
    nodes, edges, pairs = _compared(t)
    states = edge_states(*edges, pairs).groupBy("graph").agg(F.sort_array(F.collect_list(F.struct("source", "target", "state"))).alias("edges"))
    matches = pairs.groupBy("graph").agg(F.sort_array(F.collect_list(F.struct("truth", "drawn", F.round("quality", 4).alias("quality")))).alias("nodes"))
    rows = similarity(nodes, edges, pairs).join(states, "graph", "left").join(matches, "graph", "left")
    return rows.select("graph", F.to_json(F.struct(F.lit(1).alias("version"), "similarity", "node_score", "edge_score", "distance", "nodes", "edges")).alias("body"))


@query()
def sc_diagram(t: Tables) -> DataFrame:
    """Of the diagrams of an answer (a customer's orders) the most similar, the first of equals, with the score of the component that is asked for (nodes) and a flag where it was read uncertainly."""
    rows = similarity(*_compared(t)).join(t.orders.select(F.col("o_orderkey").alias("graph"), "o_custkey", "o_orderstatus"), "graph")
    best = rows.groupBy(F.col("o_custkey").alias("answer")).agg(F.max_by(F.struct("graph", "similarity", "node_score", "o_orderstatus"), F.struct("similarity", -F.col("graph"))).alias("b"))
    return best.select("answer", F.col("b.graph").alias("best"), "b.similarity", "b.node_score", (F.col("b.o_orderstatus") == "P").alias("uncertain"))


@query("WITH e AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem) SELECT node, count(*) AS degree FROM (SELECT 's' || a AS node FROM e UNION ALL SELECT 'p' || b FROM e) GROUP BY 1")
def gr_degree(t: Tables) -> DataFrame:
    return graphs.degrees(_shipments(t), "source", "target")


def _shipments(t: Tables) -> DataFrame:
    """Suppliers and the parts they sent."""
    return t.lineitem.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("target")).distinct()


@query()
def gr_components(t: Tables) -> DataFrame:
    return graphs.connected(_shipments(t), "source", "target")


@query()
def join_greedy_detection(t: Tables) -> DataFrame:
    """Detections matched one to one to true boxes by score, greedily."""
    return assignment.greedy(assignment.detections(t.lineitem), 0.3).select("page", "id", "match")


@query()
def gr_nms(t: Tables) -> DataFrame:
    return assignment.suppressed(assignment.detections(t.lineitem), 0.3)


@query()
def win_row_bands(t: Tables) -> DataFrame:
    """Boxes of a page grouped into visual rows by running overlap."""
    return assignment.row_bands(assignment.detections(t.lineitem))


@query(f"""
    WITH s AS (SELECT *, CASE WHEN l_linenumber IS DISTINCT FROM lag(l_linenumber) OVER w + 1 THEN 1 ELSE 0 END AS turn, row_number() OVER w AS i FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_extendedprice, l_linenumber)),
    r AS (SELECT *, sum(turn) OVER (PARTITION BY l_orderkey ORDER BY i) AS run FROM s)
    SELECT l_orderkey, min(l_linenumber) AS first, count(*) AS length FROM r GROUP BY l_orderkey, run HAVING count(*) >= 3 AND min(l_linenumber) = 1""")
def win_list_run(t: Tables) -> DataFrame:
    """Runs 1, 2, 3 ... of three line numbers or more, in an order's lines by part."""
    return assignment.list_runs(t.lineitem, "l_orderkey", ["l_partkey", "l_suppkey", "l_extendedprice", "l_linenumber"], "l_linenumber")


@query()
def join_engine_align(t: Tables) -> DataFrame:
    """Engines' readings assigned to the detected lines of their page, the others clustered into extra lines."""
    boxes = assignment.detections(t.lineitem)
    engine = F.concat(F.lit("e"), (F.crc32("id") % 3).cast("string"))
    return assignment.aligned(boxes.withColumn("engine", engine))


@query()
def gr_detector_eval(t: Tables) -> DataFrame:
    """Over all pages: precision and recall of detections, average precision by score, and precision and recall of edges with and without their direction."""
    boxes = assignment.detections(t.lineitem)
    found = assignment.greedy(boxes, 0.3)
    true = boxes.agg(F.count_if("truth").alias("true"))
    ap = fitting.precision_curve(found, "score", "match").agg(F.sum(F.col("hits") * F.col("best")).alias("area"), F.sum("hits").alias("hits"), F.sum("n").alias("n"))
    states = gr_edges_by_number(t)
    s = F.col("state")
    edge = states.agg(F.count_if(s == "present").alias("right"), F.count_if(s.isin("present", "reversed")).alias("either"), F.count_if(s.isin("present", "reversed", "missing")).alias("wanted"), F.count_if(s.isin("present", "reversed of another", "extra")).alias("drawn"))
    rows = ap.crossJoin(true).crossJoin(edge)  # a row each
    share = lambda a, b, name: F.round(F.col(a) / F.nullif(F.col(b), F.lit(0)), 6).alias(name)
    return rows.select(share("hits", "n", "precision"), share("hits", "true", "recall"), share("area", "true", "average_precision"), share("right", "drawn", "edge_precision"), share("right", "wanted", "edge_recall"), share("either", "drawn", "edge_precision_undirected"), share("either", "wanted", "edge_recall_undirected"))


@query("""
    WITH s AS (SELECT l_orderkey AS page, l_linenumber * 10 AS x0, l_linenumber * 10 + 5 AS x1 FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL), b AS (SELECT page, unnest([x0, x1]) AS x FROM s),
    l AS (SELECT l_orderkey AS page, min(l_linenumber) * 10 - 8 AS x0, max(l_linenumber) * 10 + 14 AS x1 FROM lineitem GROUP BY 1), c AS (SELECT page, x0 AS x FROM l UNION SELECT page, x1 FROM l UNION SELECT b.page, b.x FROM b JOIN l ON l.page = b.page AND b.x > l.x0 AND b.x < l.x1)
    SELECT page, x AS x0, next AS x1 FROM (SELECT page, x, lead(x) OVER (PARTITION BY page ORDER BY x) AS next FROM c) WHERE next IS NOT NULL AND next - x >= 2""")
def ocr_cut_line(t: Tables) -> DataFrame:
    """A line over the whole width of a page's shapes, cut at their edges; slivers of less than two pixels are dropped."""
    n = F.col("l_linenumber") * 10
    line = t.lineitem.groupBy(F.col("l_orderkey").alias("page")).agg((F.min(n) - 8).alias("x0"), (F.max(n) + 14).alias("x1"))
    edges = t.lineitem.where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("page"), F.explode(F.array(n, n + 5)).alias("x"))
    inner = edges.join(line, "page").where("x > x0 AND x < x1").select("page", "x")
    cuts = inner.union(line.select("page", F.explode(F.array("x0", "x1")).alias("x"))).distinct()
    return cuts.select("page", F.col("x").alias("x0"), F.lead("x").over(Window.partitionBy("page").orderBy("x")).alias("x1")).where("x1 IS NOT NULL AND x1 - x0 >= 2")
