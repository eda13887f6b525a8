"""Graphs as edge tables: degrees, connected parts, comparison of two graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.sources.shared import staged


def degrees(edges: DataFrame, source: str, target: str) -> DataFrame:
    """node, degree; dangling ends don't count."""
    ends = edges.select(F.explode(F.array(source, target)).alias("node")).where("node IS NOT NULL")
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def connected(edges: DataFrame, source: str, target: str) -> DataFrame:
    """node, part: the smallest node reachable, whatever the direction. Nodes get whole numbers in their order first, which the rounds carry instead of the nodes. Alternates large and small stars, whose rounds grow with the logarithm of a part's size; each is staged, so lineage stays short."""
    given = edges.where(F.col(source).isNotNull() & F.col(target).isNotNull()).select(F.col(source).alias("s"), F.col(target).alias("t"))
    nodes = given.select(F.explode(F.array("s", "t")).alias("node")).distinct()
    nodes = staged(nodes.orderBy("node").select("node", F.monotonically_increasing_id().alias("n")), "nodes")  # partitions follow each other in order
    of = lambda end: nodes.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"))
    pairs = given.join(of("s"), "s").join(of("t"), "t")
    stars, seen = staged(pairs.select(F.greatest("n_s", "n_t").alias("u"), F.least("n_s", "n_t").alias("v")).where("u <> v").distinct(), "stars"), None
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = staged(large, "large-stars")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        stars = staged(small.where("u <> v").distinct(), "stars")
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            parts = nodes.join(stars.select(F.col("u").alias("n"), F.col("v").alias("m")), "n", "left").select("node", F.coalesce("m", "n").alias("m"))
            return parts.join(nodes.select(F.col("node").alias("part"), F.col("n").alias("m")), "m").select("node", "part")
        seen = now


def compare_edges(truth: DataFrame, drawn: DataFrame, graph: str, source: str, target: str) -> DataFrame:
    """Edges of simple graphs as present, reversed, missing or extra."""
    key = [graph, source, target]
    a, b = truth.select(*key).distinct().withColumn("__t", F.lit(True)), drawn.select(*key).distinct().withColumn("__d", F.lit(True))
    turned = drawn.select(graph, F.col(target).alias(source), F.col(source).alias(target)).distinct().withColumn("__r", F.lit(True))
    back = truth.select(graph, F.col(target).alias(source), F.col(source).alias(target)).distinct().withColumn("__b", F.lit(True))
    rows = a.join(b, key, "full").join(turned, key, "left").join(back, key, "left")
    state = F.when(F.col("__t") & F.col("__d"), "present").when(F.col("__t") & F.col("__r"), "reversed").when(F.col("__t"), "missing").when(F.col("__b"), "reversed of another").otherwise("extra")
    return rows.select(*key, state.alias("state"))
