"""Window, ranking and marking queries over line items, events and embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions import numbers, vectors
from assayer.operators import choice, islands
from assayer.plans import measures
from assayer.registry import Tables, query

#: Ties of line items: an order's line numbers are not unique.
TIES = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
SQL_TIES = ", ".join(TIES)


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, CAST(place AS INTEGER) AS place, place <= 3 AS counted FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, {SQL_TIES}) AS place FROM lineitem)")
def win_best_n(t: Tables) -> DataFrame:
    return choice.best_n(t.lineitem, ["l_orderkey"], "l_quantity", 3, *TIES).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "place", "counted")


@query(f"SELECT l_orderkey, slot, l_linenumber, l_partkey, l_extendedprice FROM (SELECT *, (l_linenumber + 1) // 2 AS slot, row_number() OVER (PARTITION BY l_orderkey, (l_linenumber + 1) // 2 ORDER BY l_quantity DESC, {SQL_TIES}) AS r FROM lineitem) WHERE r = 1")
def win_or_best(t: Tables) -> DataFrame:
    """Odd and even lines are alternatives of a slot."""
    items = t.lineitem.withColumn("slot", F.expr("(l_linenumber + 1) div 2").cast("int"))
    return choice.best_alternative(items, ["l_orderkey", "slot"], "l_quantity", *TIES).where("chosen").select("l_orderkey", "slot", "l_linenumber", "l_partkey", "l_extendedprice")


@query(f"""
    WITH i AS (SELECT *, (l_linenumber + 1) // 2 AS slot, row_number() OVER (PARTITION BY l_orderkey, (l_linenumber + 1) // 2 ORDER BY l_quantity DESC, {SQL_TIES}) = 1 AS chosen FROM lineitem),
    r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, chosen ORDER BY l_quantity DESC, slot, {SQL_TIES}) AS place FROM i)
    SELECT l_orderkey, slot, l_linenumber, l_partkey, l_extendedprice, CASE WHEN NOT chosen THEN 'other alternative scored higher' WHEN place > 2 THEN 'not among the best' ELSE 'counted' END AS outcome FROM r""")
def mk_choice(t: Tables) -> DataFrame:
    items = t.lineitem.withColumn("slot", F.expr("(l_linenumber + 1) div 2").cast("int")).withColumn("one", F.lit(1))
    return choice.choice_rules(items, "l_orderkey", "one", "slot", "l_linenumber", "l_quantity", 2, *TIES[1:]).select("l_orderkey", "slot", "l_linenumber", "l_partkey", "l_extendedprice", "outcome")


@query("SELECT l_orderkey, CAST(sum(q) AS DOUBLE) AS section_max FROM (SELECT l_orderkey, l_quantity AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC) AS r FROM lineitem) WHERE r <= 3 GROUP BY 1")
def mk_section_max(t: Tables) -> DataFrame:
    items = t.lineitem.withColumn("q", F.col("l_quantity").cast("decimal(18,4)"))
    return choice.section_max(items, ["l_orderkey"], "q", 3).select("l_orderkey", F.col("section_max").cast("double").alias("section_max"))


@query("SELECT l_orderkey, round(sum(CASE WHEN l_discount = 0 THEN -0.25 ELSE l_discount END), 4) + 0.0 AS total FROM lineitem GROUP BY 1")
def mk_negative(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg((F.round(F.sum(choice.negative(F.col("l_discount"), F.lit(0.25))), 4) + 0.0).alias("total"))


@query("SELECT l_orderkey, (l_linenumber + 1) // 2 AS slot, round(sum(l_quantity), 2) AS mark FROM lineitem WHERE l_quantity > 5 GROUP BY 1, 2")
def mk_slot_sum(t: Tables) -> DataFrame:
    return t.lineitem.where("l_quantity > 5").groupBy("l_orderkey", F.expr("(l_linenumber + 1) div 2").cast("int").alias("slot")).agg(F.round(F.sum("l_quantity"), 2).alias("mark"))


@query("""
    SELECT d.doc_id, CASE WHEN n_chars < 60 THEN NULL ELSE coalesce(l.quality * 2.0, round(n_chars % 7 / 2.0, 1)) END AS mark, CASE WHEN n_chars < 60 THEN 'not attempted' WHEN l.doc_id IS NOT NULL THEN 'teacher' ELSE 'machine' END AS by
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def mk_leaf_mark(t: Tables) -> DataFrame:
    """A teacher's mark wins over the machine's; what is too short was not attempted."""
    rows = t.documents.join(t.labels.withColumn("known", F.lit(True)), "doc_id", "left")
    short = F.col("n_chars") < 60
    mark = F.when(~short, F.coalesce(F.col("quality") * 2.0, F.round(F.col("n_chars") % 7 / 2.0, 1)))
    return rows.select("doc_id", mark.alias("mark"), F.when(short, "not attempted").when(F.col("known"), "teacher").otherwise("machine").alias("by"))


@query("SELECT l_orderkey, l_partkey, p_size, l_quantity FROM lineitem LEFT JOIN part ON p_partkey = l_partkey WHERE p_partkey IS NULL OR p_size <> l_quantity")
def mk_check_links(t: Tables) -> DataFrame:
    """Items whose part is unknown or of another size."""
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"), "left")
    return rows.where(F.col("p_partkey").isNull() | (F.col("p_size") != F.col("l_quantity"))).select("l_orderkey", "l_partkey", "p_size", "l_quantity")


@query("SELECT l_orderkey, count(*) AS lines, round(sum(l_quantity), 2) AS total, string_agg(l_linenumber || ':' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), ' ' ORDER BY l_linenumber, l_quantity) AS sheet FROM lineitem GROUP BY 1")
def mk_sheet(t: Tables) -> DataFrame:
    text = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))), lambda x: F.concat(x["l_linenumber"].cast("string"), F.lit(":"), x["l_quantity"].cast("long").cast("string")))
    return t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.round(F.sum("l_quantity"), 2).alias("total"), F.array_join(text, " ").alias("sheet"))


#: A paper: each order's section has slots of two alternatives, of which the best counts, and of the slots the two best; a slot's parts are summed. A teacher's mark (of approved lines) wins over the machine's, and lines without either are unmarked.
SQL_LEAVES = f"m AS (SELECT l_orderkey, l_linenumber AS alternative, (l_linenumber + 1) // 2 AS slot, CASE WHEN l_linestatus = 'F' THEN l_quantity WHEN l_discount > 0 THEN round(l_quantity * l_discount * 10, 2) END AS mark FROM lineitem)"


def leaf_marks(t: Tables) -> DataFrame:
    mark = F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).when(F.col("l_discount") > 0, F.round(F.col("l_quantity") * F.col("l_discount") * 10, 2))
    return t.lineitem.select("l_orderkey", F.col("l_linenumber").alias("alternative"), F.expr("(l_linenumber + 1) div 2").cast("int").alias("slot"), mark.alias("mark"))


@query(f"""
    WITH {SQL_LEAVES}, a AS (SELECT l_orderkey, slot, alternative, sum(CAST(mark AS DECIMAL(18, 2))) AS mark FROM m WHERE mark IS NOT NULL GROUP BY ALL),
    b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, slot ORDER BY mark DESC, alternative) = 1 AS chosen FROM a), c AS (SELECT *, chosen AND row_number() OVER (PARTITION BY l_orderkey, chosen ORDER BY mark DESC, slot, alternative) <= 2 AS counted FROM b),
    u AS (SELECT l_orderkey, count(*) FILTER (mark IS NULL) AS unmarked FROM m GROUP BY 1)
    SELECT o_orderkey, CAST(coalesce(sum(mark) FILTER (counted), 0) AS DOUBLE) AS total, count(DISTINCT slot) AS attempted, count(*) FILTER (counted) AS counted, coalesce(any_value(unmarked), 0) AS unmarked FROM orders LEFT JOIN u ON u.l_orderkey = o_orderkey LEFT JOIN c ON c.l_orderkey = o_orderkey GROUP BY 1""")
def rep_booklet_totals(t: Tables) -> DataFrame:
    """Leaf marks to slots, slots through the choice rules, and the total."""
    m = leaf_marks(t)
    slots = m.where("mark IS NOT NULL").groupBy("l_orderkey", "slot", "alternative").agg(F.sum(F.col("mark").cast("decimal(18,2)")).alias("mark")).withColumn("one", F.lit(1))
    ruled = choice.choice_rules(slots, "l_orderkey", "one", "slot", "alternative", "mark", 2)
    totals = ruled.groupBy("l_orderkey").agg(F.sum(F.when(F.col("counted"), F.col("mark"))).alias("total"), F.count_distinct("slot").alias("attempted"), F.count_if("counted").alias("counted"))
    unmarked = m.groupBy("l_orderkey").agg(F.count_if(F.col("mark").isNull()).alias("unmarked"))
    every = t.orders.select("o_orderkey").join(totals.join(unmarked, "l_orderkey", "full"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("attempted", "counted", "unmarked")]
    return every.select("o_orderkey", F.coalesce(F.col("total").cast("double"), F.lit(0.0)).alias("total"), *zero)


@query("SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY lower(p_name), p_partkey) AS INTEGER) AS code FROM part")
def win_row_number_code(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.lower("p_name"), "p_partkey")).alias("code"))


SQL_UNITS = """n AS (SELECT vec_id, label, vec_id // 50 AS answer, CAST(embedding AS DOUBLE[]) AS e, coalesce(nullif(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 0), 1) AS len FROM embeddings),
    o AS (SELECT *, lead(e) OVER w AS f, lead(len) OVER w AS flen FROM n WINDOW w AS (PARTITION BY answer ORDER BY vec_id)),
    u AS (SELECT vec_id, answer, 1 AS size, e AS unit FROM o UNION ALL SELECT vec_id, answer, 2, list_transform(list_zip(e, f), lambda p: p[1] / len + p[2] / flen) FROM o WHERE f IS NOT NULL)"""


def units(t: Tables) -> DataFrame:
    """vec_id, answer, size, unit: every sentence of an answer of 50, and every pair of neighbours as the sum of their unit vectors."""
    one = t.embeddings.select("vec_id", "label", F.expr("vec_id div 50").alias("answer"), F.transform("embedding", lambda x: x.cast("double")).alias("unit"))
    unit = lambda v: F.transform(v, lambda x: x / F.coalesce(F.nullif(vectors.norm(v), F.lit(0.0)), F.lit(1.0)))
    nxt = F.lead("unit").over(Window.partitionBy("answer").orderBy("vec_id"))
    two = one.withColumn("next", nxt).where("next IS NOT NULL").select("vec_id", "answer", F.lit(2).alias("size"), F.zip_with(unit(F.col("unit")), unit(F.col("next")), lambda a, b: a + b).alias("unit"))
    return one.select("vec_id", "answer", F.lit(1).alias("size"), "unit").unionByName(two)


@query(f"WITH {SQL_UNITS} SELECT vec_id, size, len(unit) AS dimension, round(list_sum(unit), 4) AS total, round(sqrt(list_inner_product(unit, unit)), 4) AS length FROM u")
def win_neighbour_pair(t: Tables) -> DataFrame:
    u = F.col("unit")
    return units(t).select("vec_id", "size", F.size("unit").cast("long").alias("dimension"), F.round(F.aggregate("unit", F.lit(0.0), lambda s, x: s + x), 4).alias("total"), F.round(vectors.norm(u), 4).alias("length"))


@query(f"""{measures.CENTROIDS}, {SQL_UNITS}, s AS (SELECT answer, vec_id, size, c.label, round(greatest(0, least(1, coalesce(list_cosine_similarity(unit, centroid), 0))), 6) AS similarity FROM u, c WHERE answer % 10 = c.label % 10)
    SELECT answer, label AS question, similarity, vec_id AS first, size FROM s QUALIFY row_number() OVER (PARTITION BY answer, label ORDER BY similarity DESC, size, vec_id) = 1""")
def emb_best_match(t: Tables) -> DataFrame:
    """The best sentence or neighbouring pair of each answer for its question, a sentence before a pair and the first of equals."""
    c = vectors.centroids(t.embeddings, "label", "embedding").withColumn("at", F.pmod("label", F.lit(10)))
    s = units(t).withColumn("at", F.pmod("answer", F.lit(10))).join(c, "at").select("answer", "vec_id", "size", "label", F.round(vectors.cosine(F.col("unit"), F.col("centroid")), 6).alias("similarity"))
    best = s.groupBy("answer", F.col("label").alias("question")).agg(F.max(F.struct("similarity", -F.col("size"), -F.col("vec_id"))).alias("b"))
    return best.select("answer", "question", "b.similarity", (-F.col("b.col3")).alias("first"), (-F.col("b.col2")).alias("size"))


@query("SELECT event_id, rank() OVER (PARTITION BY user_id ORDER BY round(value)) + (count(*) OVER (PARTITION BY user_id, round(value)) - 1) / 2.0 AS mean_rank FROM events")
def win_rank_avg(t: Tables) -> DataFrame:
    v = F.round("value")
    return t.events.select("event_id", (F.rank().over(Window.partitionBy("user_id").orderBy(v)) + (F.count("*").over(Window.partitionBy("user_id", v)) - 1) / 2.0).alias("mean_rank"))


@query("""
    WITH s AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS turn FROM events),
    r AS (SELECT *, sum(turn) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM s)
    SELECT user_id, CAST(run AS BIGINT) AS run, min(event_type) AS event_type, count(*) AS n FROM r GROUP BY 1, 2""")
def win_runs(t: Tables) -> DataFrame:
    return islands.runs(t.events, ["user_id"], ["ts", "event_id"], "event_type").groupBy("user_id", "run").agg(F.min("event_type").alias("event_type"), F.count("*").alias("n"))


@query("""
    WITH s AS (SELECT *, CASE WHEN l_quantity - lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_partkey, l_suppkey, l_extendedprice) > 5 THEN 1 ELSE 0 END AS turn, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_partkey, l_suppkey, l_extendedprice) AS i FROM lineitem),
    r AS (SELECT *, sum(CASE WHEN i = 1 THEN 1 ELSE turn END) OVER (PARTITION BY l_orderkey ORDER BY i) AS cluster FROM s)
    SELECT l_orderkey, CAST(cluster AS BIGINT) AS cluster, round(avg(l_quantity), 4) AS centre, count(*) AS n FROM r GROUP BY 1, 2""")
def win_cluster_1d(t: Tables) -> DataFrame:
    rows = islands.clusters(t.lineitem, ["l_orderkey"], "l_quantity", 5, ["l_partkey", "l_suppkey", "l_extendedprice"])
    return rows.groupBy("l_orderkey", "cluster").agg(F.round(F.avg("l_quantity"), 4).alias("centre"), F.count("*").alias("n"))


@query("""
    WITH p AS (SELECT user_id, event_id, value, CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END AS hit, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events),
    q AS (SELECT *, CAST(sum(hit) OVER (PARTITION BY user_id ORDER BY k) AS DOUBLE) / k AS precision_at FROM p),
    m AS (SELECT *, max(precision_at) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS best FROM q)
    SELECT user_id, round(sum(hit * best) / sum(hit), 6) AS average_precision FROM m GROUP BY 1 HAVING sum(hit) > 0""")
def win_ap(t: Tables) -> DataFrame:
    before, after = islands.running(t.events, ["user_id"], F.desc("value"), "event_id")
    rows = t.events.withColumn("hit", F.col("event_type").isin("purchase", "signup").cast("int")).withColumn("p", F.sum("hit").over(before) / F.count("*").over(before)).withColumn("best", F.max("p").over(after))
    return rows.groupBy("user_id").agg(F.sum("hit").alias("h"), F.sum(F.col("hit") * F.col("best")).alias("s")).where("h > 0").select("user_id", F.round(F.col("s") / F.col("h"), 6).alias("average_precision"))


@query("SELECT l_partkey, round(CAST(round(CAST(l_extendedprice AS DECIMAL(18, 4)) / 0.5, 0) * 0.5 AS DOUBLE), 4) AS half, round(CAST(round(CAST(l_extendedprice AS DECIMAL(18, 4)) / 0.25, 0) * 0.25 AS DOUBLE), 4) AS quarter FROM lineitem")
def mth_round_step(t: Tables) -> DataFrame:
    price = F.col("l_extendedprice")
    return t.lineitem.select("l_partkey", numbers.to_step(price, "0.5").cast("double").alias("half"), numbers.to_step(price, "0.25").cast("double").alias("quarter"))


@query("SELECT l_orderkey, CAST(round(CAST(count(*) FILTER (l_returnflag = 'A') AS DECIMAL(10, 4)) / count(*), 4) AS DOUBLE) AS credit FROM lineitem GROUP BY 1")
def mth_credit_places(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(F.round(F.count_if(F.col("l_returnflag") == "A").cast("decimal(10,4)") / F.count("*"), 4).cast("double").alias("credit"))


@query("SELECT event_id, CASE WHEN value >= 20 THEN 1.0 WHEN value >= 8 THEN 0.5 ELSE 0.0 END AS credit, least(abs(value - 20), abs(value - 8)) < 0.5 AS near FROM events")
def mth_band(t: Tables) -> DataFrame:
    v = F.col("value")
    return t.events.select("event_id", numbers.band(v, 8, 20).alias("credit"), numbers.near_edge(v, 8, 20, 0.5).alias("near"))


@query("""
    WITH e AS (SELECT l_shipmonth AS engine, l_returnflag AS class, avg(bad) AS eps FROM (SELECT month(l_shipdate) AS l_shipmonth, l_returnflag, CASE WHEN l_discount > 0.06 THEN 1.0 ELSE 0.0 END AS bad FROM lineitem) GROUP BY 1, 2),
    w AS (SELECT *, greatest(0.0, 0.5 * ln((1 - eps) / eps)) AS a FROM e)
    SELECT CAST(engine AS INTEGER) AS engine, class, round(a / max(a) OVER (PARTITION BY class), 6) AS weight FROM w""")
def mth_engine_weight(t: Tables) -> DataFrame:
    e = t.lineitem.groupBy(F.month("l_shipdate").alias("engine"), F.col("l_returnflag").alias("class")).agg(F.avg((F.col("l_discount") > 0.06).cast("double")).alias("eps"))
    a = numbers.engine_weight(F.col("eps"))
    return e.select("engine", "class", F.round(a / F.max(a).over(Window.partitionBy("class")), 6).alias("weight"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, CAST(l_quantity AS DECIMAL(18, 4)) >= 0 AND l_quantity <= p_size AND CAST(l_quantity AS DECIMAL(18, 4)) % 0.5 = 0 AS fine FROM lineitem JOIN part ON p_partkey = l_partkey")
def mth_mark_range(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", numbers.mark_in_range(F.col("l_quantity").cast("decimal(18,4)"), F.col("p_size").cast("decimal(18,4)"), "0.5").alias("fine"))


@query("SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size < 10 THEN 'small' END, CASE WHEN p_retailprice > 950 THEN 'bright' END, CASE WHEN p_type = 'PROMO' THEN 'glare' END], lambda x: x IS NOT NULL), ',') AS reasons FROM part")
def mth_quality_gate(t: Tables) -> DataFrame:
    reasons = F.array_compact(F.array(F.when(F.col("p_size") < 10, "small"), F.when(F.col("p_retailprice") > 950, "bright"), F.when(F.col("p_type") == "PROMO", "glare")))
    return t.part.select("p_partkey", F.array_join(reasons, ",").alias("reasons"))


#: A page's box of a line item, and of its order's first: made from its numbers.
BOX = "named_struct('x0', l_linenumber * 10, 'y0', cast(l_quantity as int), 'x1', l_linenumber * 10 + 5 + cast(l_quantity as int), 'y1', cast(l_quantity as int) + 12)"
SQL_BOX = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_linenumber * 10 AS x0, CAST(l_quantity AS INTEGER) AS y0, l_linenumber * 10 + 5 + CAST(l_quantity AS INTEGER) AS x1, CAST(l_quantity AS INTEGER) + 12 AS y1 FROM lineitem"


def _boxes(t: Tables, prefix: str) -> DataFrame:
    return t.lineitem.select(F.col("l_orderkey").alias("page"), *[F.col(c).alias(f"{prefix}_{c}") for c in TIES], F.expr(BOX).alias(prefix))


@query("""
    WITH p AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN CASE WHEN conv_id % 5 = 0 THEN 1 ELSE count(*) OVER (PARTITION BY conv_id) - turn END END AS n, count(*) OVER (PARTITION BY conv_id) AS pages FROM conversations),
    b AS (SELECT conv_id, count(n) >= 2 AND count(n) >= 0.4 * any_value(pages) AND count(DISTINCT n) = count(n) AND max(n) <= any_value(pages) + 2 AS trusted FROM p GROUP BY 1),
    g AS (SELECT *, last_value(n IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS follows FROM p)
    SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN trusted THEN coalesce(follows, -1) ELSE 0 END, turn) AS INTEGER) AS place FROM g JOIN b USING (conv_id)""")
def win_page_reorder(t: Tables) -> DataFrame:
    """Pages by the numbers written on them; unnumbered ones follow the last numbered page, cover pages stay first. Numbers are trusted if there are two or more, on two pages in five, all different and not above the pages by more than two. Questions are the numbered pages, numbered backwards; in every fifth conversation alike."""
    whole = Window.partitionBy("conv_id")
    pages = t.conversations.select("conv_id", "turn", "role", F.count("*").over(whole).alias("pages"))
    pages = pages.withColumn("n", F.when(F.col("role") == "user", F.when(F.col("conv_id") % 5 == 0, 1).otherwise(F.col("pages") - F.col("turn"))))
    trusted = pages.groupBy("conv_id").agg(((F.count("n") >= 2) & (F.count("n") >= 0.4 * F.max("pages")) & (F.count_distinct("n") == F.count("n")) & (F.max("n") <= F.max("pages") + 2)).alias("trusted"))
    follows = F.last("n", ignorenulls=True).over(whole.orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    rows = pages.withColumn("follows", follows).join(trusted, "conv_id")
    order = F.when(F.col("trusted"), F.coalesce("follows", F.lit(-1))).otherwise(0)
    return rows.select("conv_id", "turn", F.row_number().over(whole.orderBy(order, "turn")).alias("place"))


def _value_at(rows: DataFrame, key: str, value: str, **places: Column) -> DataFrame:
    """key and, for each name, the value at a place (from 0) of the key's sorted values, from counts of values: no list grows with the rows. A place is an expression of `n`, the number of values."""
    cells = rows.groupBy(key, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(key)
    cells = cells.withColumn("upto", F.sum("c").over(w.orderBy(value))).withColumn("n", F.sum("c").over(w))
    return cells.groupBy(key).agg(*[F.min(F.when(F.col("upto") > place, F.col(value))).alias(name) for name, place in places.items()])


@query("SELECT p_brand, list_sort(list(p_retailprice))[least(count(*) - 1, CAST(floor(0.02 * count(*)) AS BIGINT)) + 1] AS low, list_sort(list(p_retailprice))[least(count(*) - 1, CAST(floor(0.9 * count(*)) AS BIGINT)) + 1] AS high FROM part GROUP BY 1")
def mth_percentile_idx(t: Tables) -> DataFrame:
    at = lambda share: F.least(F.col("n") - 1, F.floor(F.lit(share) * F.col("n")))
    return _value_at(t.part, "p_brand", "p_retailprice", low=at(0.02), high=at(0.9))


@query("SELECT p_brand, list_sort(list(p_retailprice))[count(*) // 2 + 1] AS middle FROM part GROUP BY 1")
def mth_upper_median(t: Tables) -> DataFrame:
    return _value_at(t.part, "p_brand", "p_retailprice", middle=F.floor(F.col("n") / 2))


def _overlaps(t: Tables) -> DataFrame:
    """Pairs of boxes of a page that overlap, with the area they share and their own."""
    a, b = _boxes(t, "a"), _boxes(t, "b")
    meets = (a["page"] == b["page"]) & (F.col("a_l_linenumber") < F.col("b_l_linenumber"))
    for axis in "xy":
        meets &= (F.col(f"a.{axis}0") < F.col(f"b.{axis}1")) & (F.col(f"b.{axis}0") < F.col(f"a.{axis}1"))
    side = lambda axis: F.greatest(F.lit(0), F.least(f"a.{axis}1", f"b.{axis}1") - F.greatest(f"a.{axis}0", f"b.{axis}0"))
    area = lambda k: (F.col(f"{k}.x1") - F.col(f"{k}.x0")) * (F.col(f"{k}.y1") - F.col(f"{k}.y0"))
    rows = a.join(b, meets).drop(b["page"]).withColumns({"cut": side("x") * side("y"), "aa": area("a"), "ba": area("b")})
    return rows.withColumns({"iou": F.round(F.col("cut") / (F.col("aa") + F.col("ba") - F.col("cut")), 6), "inside": F.round(F.col("cut") / F.col("aa"), 6)})


@query(f"""
    WITH b AS ({SQL_BOX}), o AS (SELECT a.l_orderkey AS page, a.l_linenumber AS a_line, a.l_partkey AS a_part, b.l_linenumber AS b_line, b.l_partkey AS b_part,
        greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS cut, (a.x1 - a.x0) * (a.y1 - a.y0) AS aa, (b.x1 - b.x0) * (b.y1 - b.y0) AS ba
        FROM b a JOIN b ON b.l_orderkey = a.l_orderkey AND a.l_linenumber < b.l_linenumber)
    SELECT page, a_line, a_part, b_line, b_part, round(cut / (aa + ba - cut), 6) AS iou, round(cut / aa, 6) AS inside FROM o WHERE cut > 0""")
def mth_iou(t: Tables) -> DataFrame:
    return _overlaps(t).select("page", F.col("a_l_linenumber").alias("a_line"), F.col("a_l_partkey").alias("a_part"), F.col("b_l_linenumber").alias("b_line"), F.col("b_l_partkey").alias("b_part"), "iou", "inside")


SQL_BEST = f"""b AS ({SQL_BOX}), o AS (SELECT a.*, b.l_linenumber AS b_line, b.l_partkey AS b_part, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS cut, (a.x1 - a.x0) * (a.y1 - a.y0) AS aa, (b.x1 - b.x0) * (b.y1 - b.y0) AS ba, b.l_suppkey AS bs, b.l_extendedprice AS be
        FROM b a JOIN b ON b.l_orderkey = a.l_orderkey AND a.l_linenumber < b.l_linenumber),
    s AS (SELECT *, round(cut / (aa + ba - cut), 6) AS iou, round(cut / aa, 6) AS inside FROM o)"""


@query(f"""
    WITH {SQL_BEST}, r AS (SELECT *, CASE WHEN iou >= 0.5 THEN 1 WHEN inside >= 0.6 THEN 2 END AS pass, CASE WHEN iou >= 0.5 THEN iou ELSE inside END AS score FROM s)
    SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, b_line, b_part, pass, score FROM r WHERE pass IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice ORDER BY pass, score DESC, b_line, b_part, bs, be) = 1""")
def join_iou_best(t: Tables) -> DataFrame:
    """Of the boxes of a page that come later: the best by overlap, else the one that holds most of it."""
    rows = _overlaps(t).withColumn("pass", F.when(F.col("iou") >= 0.5, 1).when(F.col("inside") >= 0.6, 2)).where("pass IS NOT NULL")
    score = F.when(F.col("pass") == 1, F.col("iou")).otherwise(F.col("inside"))
    best = rows.groupBy("page", *[f"a_{c}" for c in TIES]).agg(F.min(F.struct("pass", (-score).alias("less"), *[f"b_{c}" for c in TIES])).alias("m"))
    return best.select(F.col("page").alias("l_orderkey"), F.col("a_l_linenumber").alias("l_linenumber"), F.col("a_l_partkey").alias("l_partkey"), F.col("a_l_extendedprice").alias("l_extendedprice"), F.col("m.b_l_linenumber").alias("b_line"), F.col("m.b_l_partkey").alias("b_part"), "m.pass", (-F.col("m.less")).alias("score"))


@query(f"""
    WITH {SQL_BEST}, h AS (SELECT * FROM s WHERE iou >= 0.3 QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice ORDER BY iou DESC, b_line, b_part, bs, be) = 1)
    SELECT b.l_orderkey, b.l_linenumber, b.l_partkey, b.l_extendedprice, coalesce(b_line, -1) AS line, coalesce(b_part, -1) AS part, h.b_line IS NULL AS new_line FROM b LEFT JOIN h ON h.l_orderkey = b.l_orderkey AND h.l_linenumber = b.l_linenumber AND h.l_partkey = b.l_partkey AND h.l_suppkey = b.l_suppkey AND h.l_extendedprice = b.l_extendedprice""")
def join_correction_match(t: Tables) -> DataFrame:
    """Each correction with the line it overlaps best, or as a new line where it overlaps none by 0.3."""
    ties = [f"a_{c}" for c in TIES]
    best = _overlaps(t).where("iou >= 0.3").groupBy("page", *ties).agg(F.min(F.struct((-F.col("iou")).alias("less"), *[f"b_{c}" for c in TIES])).alias("m"))
    rows = _boxes(t, "a").join(best, ["page", *ties], "left")
    return rows.select(F.col("page").alias("l_orderkey"), F.col("a_l_linenumber").alias("l_linenumber"), F.col("a_l_partkey").alias("l_partkey"), F.col("a_l_extendedprice").alias("l_extendedprice"), F.coalesce("m.b_l_linenumber", F.lit(-1)).alias("line"), F.coalesce("m.b_l_partkey", F.lit(-1)).alias("part"), F.col("m").isNull().alias("new_line"))


@query(f"""
    WITH b AS ({SQL_BOX}), d AS (SELECT a.l_orderkey AS page, a.l_linenumber AS a_line, a.l_partkey AS a_part, b.l_linenumber AS b_line, b.l_partkey AS b_part,
        round(sqrt(power(greatest(a.x0 - b.x1, b.x0 - a.x1, 0), 2) + power(greatest(a.y0 - b.y1, b.y0 - a.y1, 0), 2)), 6) AS distance FROM b a JOIN b ON b.l_orderkey = a.l_orderkey AND a.l_linenumber < b.l_linenumber)
    SELECT * FROM d WHERE distance <= 12""")
def mth_box_distance(t: Tables) -> DataFrame:
    """Boxes of a page within 12 pixels of each other."""
    a, b = _boxes(t, "a"), _boxes(t, "b")
    near = (a["page"] == b["page"]) & (F.col("a_l_linenumber") < F.col("b_l_linenumber"))
    for axis in "xy":
        near &= (F.col(f"a.{axis}0") <= F.col(f"b.{axis}1") + 12) & (F.col(f"b.{axis}0") <= F.col(f"a.{axis}1") + 12)
    rows = a.join(b, near).drop(b["page"]).withColumn("distance", F.round(numbers.box_distance("a", "b"), 6)).where("distance <= 12")
    return rows.select("page", F.col("a_l_linenumber").alias("a_line"), F.col("a_l_partkey").alias("a_part"), F.col("b_l_linenumber").alias("b_line"), F.col("b_l_partkey").alias("b_part"), "distance")


@query(f"""{measures.CENTROIDS}, s AS (SELECT vec_id // 50 AS answer, c.label, vec_id, round(greatest(0, least(1, list_cosine_similarity(CAST(embedding AS DOUBLE[]), centroid))), 6) AS s FROM embeddings, c WHERE (vec_id // 50) % 10 = c.label % 10),
    r AS (SELECT *, row_number() OVER (PARTITION BY answer, label ORDER BY s DESC, vec_id) AS place FROM s)
    SELECT answer, label AS question, round(avg(s), 5) AS relevance FROM r WHERE place <= 3 GROUP BY 1, 2""")
def srt_topk_similarity(t: Tables) -> DataFrame:
    """The mean of an answer's three sentences nearest to its question; a window keeps three of a group, no list grows."""
    c = vectors.centroids(t.embeddings, "label", "embedding").select(F.col("label").alias("question"), "centroid", F.pmod("label", F.lit(10)).alias("at"))
    s = t.embeddings.select("vec_id", "embedding", F.expr("vec_id div 50").alias("answer")).withColumn("at", F.pmod("answer", F.lit(10))).join(c, "at")
    s = s.select("answer", "question", "vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("centroid")), 6).alias("s"))
    place = F.row_number().over(Window.partitionBy("answer", "question").orderBy(F.desc("s"), "vec_id"))
    return s.withColumn("place", place).where("place <= 3").groupBy("answer", "question").agg(F.round(F.avg("s"), 5).alias("relevance"))
