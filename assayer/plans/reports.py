"""Report queries: units are orders (owner: customer, state: status), booklets are line items, the day is fixed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions import dates, numbers
from assayer.operators import latest, paging
from assayer.registry import TODAY, Tables, query

SQL_DAY = f"DATE '{TODAY}'"


def day(c):
    return F.date_format(c, "yyyy-MM-dd")


@query(f"""
    WITH o AS (SELECT o_custkey, count(*) AS owned, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'O' AND o_orderdate < {SQL_DAY}) AS overdue, max(o_orderdate) AS last_at FROM orders GROUP BY 1),
    l AS (SELECT o_custkey, count(*) AS booklets, count(*) FILTER (l_linestatus = 'F') AS approved, count(*) FILTER (l_linestatus <> 'F' AND o_orderstatus = 'O') AS pending FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
    SELECT c_custkey, c_name, coalesce(owned, 0) AS owned, coalesce(open, 0) AS open, coalesce(overdue, 0) AS overdue, coalesce(booklets, 0) AS booklets, coalesce(approved, 0) AS approved, coalesce(pending, 0) AS pending,
           strftime(last_at, '%Y-%m-%d') AS last_activity, CASE WHEN c_acctbal < 0 THEN 'suspended' WHEN coalesce(open, 0) = 0 THEN 'idle' ELSE 'active' END AS status
    FROM customer LEFT JOIN o ON o.o_custkey = c_custkey LEFT JOIN l ON l.o_custkey = c_custkey ORDER BY lower(c_name), c_custkey""")
def agg_sme_progress(t: Tables) -> DataFrame:
    """Owners with their units and booklets: two aggregates, left joins, a status."""
    is_open = F.col("o_orderstatus") == "O"
    units = t.orders.groupBy("o_custkey").agg(F.count("*").alias("owned"), F.count_if(is_open).alias("open"), F.count_if(is_open & (F.col("o_orderdate") < F.lit(TODAY))).alias("overdue"), F.max("o_orderdate").alias("last_at"))
    done = F.col("l_linestatus") == "F"
    work = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.count("*").alias("booklets"), F.count_if(done).alias("approved"), F.count_if(~done & is_open).alias("pending"))
    both = units.join(work, "o_custkey", "left")
    rows = t.customer.join(both, F.col("c_custkey") == F.col("o_custkey"), "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("owned", "open", "overdue", "booklets", "approved", "pending")]
    status = F.when(F.col("c_acctbal") < 0, "suspended").when(F.coalesce("open", F.lit(0)) == 0, "idle").otherwise("active")
    return rows.select("c_custkey", "c_name", *zero, day("last_at").alias("last_activity"), status.alias("status")).orderBy(F.lower("c_name"), "c_custkey")


@query(f"SELECT count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'P') AS submitted, count(*) FILTER (o_orderstatus = 'F') AS frozen, count(*) FILTER (o_orderstatus = 'O' AND o_orderdate < {SQL_DAY}) AS overdue FROM orders")
def agg_filtered_counts(t: Tables) -> DataFrame:
    s = F.col("o_orderstatus")
    return t.orders.agg(F.count_if(s == "O").alias("open"), F.count_if(s == "P").alias("submitted"), F.count_if(s == "F").alias("frozen"), F.count_if((s == "O") & (F.col("o_orderdate") < F.lit(TODAY))).alias("overdue"))


@query("SELECT l_linestatus, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1")
def agg_stage_counts(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_linestatus").pivot("l_returnflag", ["A", "N", "R"]).count().select("l_linestatus", *[F.coalesce(c, F.lit(0)).alias(c.lower()) for c in "ANR"])


@query("SELECT o_orderkey, o_orderstatus, count(l_orderkey) AS booklets, count(*) FILTER (l_linestatus = 'F') AS approved, count(*) FILTER (l_linestatus = 'O') AS waiting FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2")
def join_left_group(t: Tables) -> DataFrame:
    """Units with their booklets counted before the join, which keeps the shuffle to one row a unit."""
    s = F.col("l_linestatus")
    lines = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("booklets"), F.count_if(s == "F").alias("approved"), F.count_if(s == "O").alias("waiting"))
    rows = t.orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return rows.select("o_orderkey", "o_orderstatus", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("booklets", "approved", "waiting")])


@query("SELECT n_name, count(*) AS idle FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') GROUP BY 1")
def rep_idle_smes(t: Tables) -> DataFrame:
    busy = t.orders.where("o_orderstatus = 'O'").select("o_custkey")
    idle = t.customer.join(busy, F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    return idle.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("idle"))


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O' AND o_orderpriority = '1-URGENT') AS has_urgent FROM customer")
def semi_exists(t: Tables) -> DataFrame:
    urgent = t.orders.where("o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("has")).distinct()
    return t.customer.join(urgent, "c_custkey", "left").select("c_custkey", F.coalesce("has", F.lit(False)).alias("has_urgent"))


@query("SELECT conv_id, turn, role FROM conversations a WHERE NOT EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn > a.turn)")
def anti_not_exists(t: Tables) -> DataFrame:
    return latest.without_newer(t.conversations, "conv_id", "turn").select("conv_id", "turn", "role")


@query("SELECT DISTINCT ON (conv_id) conv_id, turn, role FROM conversations ORDER BY conv_id, turn DESC")
def win_latest_distinct_on(t: Tables) -> DataFrame:
    return latest.latest(t.conversations, ["conv_id"], F.desc("turn")).select("conv_id", "turn", "role")


@query("SELECT c.conv_id, c.turn, c.role FROM conversations c JOIN (SELECT conv_id, max(turn) AS m FROM conversations GROUP BY 1) x ON x.conv_id = c.conv_id AND x.m = c.turn")
def win_latest_groupmax(t: Tables) -> DataFrame:
    """The newest row in one scan and one partial aggregate."""
    return t.conversations.groupBy("conv_id").agg(F.max_by(F.struct("turn", "role"), "turn").alias("x")).select("conv_id", "x.turn", "x.role")


@query("SELECT conv_id, turn, role, first_place FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS first_place, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r = 1 AND role <> 'user'")
def win_latest_keep_first_position(t: Tables) -> DataFrame:
    return latest.latest_in_first_place(t.conversations, "conv_id", "turn", "turn", F.col("role") == "user").select("conv_id", "turn", "role", "first_place")


@query("SELECT conv_id, CAST(coalesce(max(turn), 0) + 1 AS BIGINT) AS next_version, count(turn) AS versions FROM conversations GROUP BY 1")
def agg_next_version(t: Tables) -> DataFrame:
    return latest.next_version(t.conversations, "conv_id", "turn")


@query("SELECT c_custkey, strftime((SELECT max(o_orderdate) FROM orders WHERE o_custkey = c_custkey), '%Y-%m-%d') AS last_order FROM customer")
def join_scalar_max(t: Tables) -> DataFrame:
    top = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("m"))
    return t.customer.join(top, "c_custkey", "left").select("c_custkey", day("m").alias("last_order"))


@query("SELECT o_orderkey, strftime((SELECT min(l_shipdate) FROM lineitem WHERE l_orderkey = o_orderkey), '%Y-%m-%d') AS first_ship FROM orders")
def join_scalar_min(t: Tables) -> DataFrame:
    low = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("m"))
    return t.orders.join(low, "o_orderkey", "left").select("o_orderkey", day("m").alias("first_ship"))


@query("SELECT p_partkey, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey) AS uses FROM part")
def join_scalar_count(t: Tables) -> DataFrame:
    n = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    return t.part.join(n, "p_partkey", "left").select("p_partkey", F.coalesce("n", F.lit(0)).alias("uses"))


@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_name IS NOT NULL AND o_orderpriority = '1-URGENT'")
def join_inner_composite(t: Tables) -> DataFrame:
    rows = t.orders.where("o_orderpriority = '1-URGENT'").join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select("o_orderkey", "c_name", "n_name")


@query("SELECT count(*) AS foreign_uses FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey <> c_nationkey")
def join_theta_cross_use(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return rows.where("s_nationkey <> c_nationkey").agg(F.count("*").alias("foreign_uses"))


@query("SELECT c_custkey, o_orderkey, o_totalprice FROM customer, LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1)")
def join_lateral_latest(t: Tables) -> DataFrame:
    newest = latest.latest(t.orders, ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey"))
    return t.customer.join(newest, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey", "o_totalprice")


@query("SELECT n_nationkey, c_custkey AS first_owner FROM (SELECT n_nationkey, c_custkey, row_number() OVER (PARTITION BY n_nationkey ORDER BY lower(c_name), c_custkey) AS r FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal >= 0) WHERE r = 1")
def join_first_match(t: Tables) -> DataFrame:
    able = t.customer.where("c_acctbal >= 0")
    first = latest.latest(able, ["c_nationkey"], F.lower("c_name"), F.col("c_custkey"))
    return t.nation.join(first, F.col("n_nationkey") == F.col("c_nationkey")).select("n_nationkey", F.col("c_custkey").alias("first_owner"))


@query("SELECT p_partkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS open_units FROM (SELECT DISTINCT p_partkey, o_orderkey FROM part JOIN lineitem ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O') GROUP BY 1")
def join_usage(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.orders.where("o_orderstatus = 'O'"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_partkey").alias("p_partkey"), "o_orderkey").distinct()
    return rows.groupBy("p_partkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",").alias("open_units"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA') AND c_custkey <> 7 ORDER BY lower(c_name), c_custkey")
def join_entitled(t: Tables) -> DataFrame:
    granted = t.nation.join(t.region.where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    return t.customer.where("c_custkey <> 7").join(granted, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select("c_custkey", "c_name").orderBy(F.lower("c_name"), "c_custkey")


@query("SELECT p_partkey, p_brand FROM part JOIN (SELECT l_partkey, count(DISTINCT l_suppkey) AS s FROM lineitem GROUP BY 1) ON l_partkey = p_partkey WHERE s >= 20 AND p_type <> 'PROMO' AND p_size > 0")
def join_choosable_papers(t: Tables) -> DataFrame:
    linked = t.lineitem.groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("s")).where("s >= 20")
    return t.part.where("p_type <> 'PROMO' AND p_size > 0").join(linked, F.col("p_partkey") == F.col("l_partkey")).select("p_partkey", "p_brand")


@query("""
    WITH d AS (SELECT doc_id, source, text, count(*) OVER (PARTITION BY sha256(text)) AS n, min(doc_id) OVER (PARTITION BY sha256(text)) AS first FROM documents)
    SELECT d.doc_id, CASE WHEN length(text) < 60 THEN 'too short' WHEN l.doc_id IS NULL THEN 'unknown' WHEN n > 1 AND first = d.doc_id THEN 'twice in the batch' WHEN n > 1 THEN 'uploaded before' ELSE 'fine' END AS verdict
    FROM d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def join_upload_checks(t: Tables) -> DataFrame:
    """The first failing rule of each file; copies meet by hash in a partial aggregate, not a window."""
    docs = t.documents.select("doc_id", F.length("text").alias("size"), F.sha2("text", 256).alias("h"))
    copies = docs.groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    known = t.labels.select("doc_id", F.lit(True).alias("known"))
    verdict = F.when(F.col("size") < 60, "too short").when(F.col("known").isNull(), "unknown").when((F.col("n") > 1) & (F.col("first") == F.col("doc_id")), "twice in the batch").when(F.col("n") > 1, "uploaded before").otherwise("fine")
    return docs.join(copies, "h").join(known, "doc_id", "left").select("doc_id", verdict.alias("verdict"))


@query("""
    SELECT DISTINCT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND (o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey = 5) OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey = 7) OR o_custkey = 3)""")
def join_blockers(t: Tables) -> DataFrame:
    live = t.orders.where("o_orderstatus <> 'F'")
    by = lambda cond: live.join(t.lineitem.where(cond), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")
    return by("l_partkey = 5").union(by("l_suppkey = 7")).union(live.where("o_custkey = 3").select("o_orderkey")).distinct()


@query("SELECT event_id, event_type, c_name, json_extract_string(props, '$.k') AS k FROM (SELECT * FROM events WHERE event_type IN ('click', 'purchase') ORDER BY ts DESC, event_id DESC LIMIT 10) LEFT JOIN customer ON c_custkey = user_id ORDER BY ts DESC, event_id DESC")
def srt_feed_topk(t: Tables) -> DataFrame:
    """The newest events before names are joined to them."""
    top = t.events.where(F.col("event_type").isin("click", "purchase")).orderBy(F.desc("ts"), F.desc("event_id")).limit(10)
    rows = top.join(t.customer, F.col("user_id") == F.col("c_custkey"), "left").orderBy(F.desc("ts"), F.desc("event_id"))
    return rows.select("event_id", "event_type", "c_name", F.get_json_object("props", "$.k").alias("k"))


@query("SELECT e.event_id, c_name, n_name FROM events e LEFT JOIN customer ON c_custkey = CAST(json_extract_string(props, '$.k') AS BIGINT) LEFT JOIN nation ON n_nationkey = c_nationkey WHERE event_type = 'error'")
def join_left_cast_key(t: Tables) -> DataFrame:
    errors = t.events.where("event_type = 'error'").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return errors.join(t.customer, F.col("k") == F.col("c_custkey"), "left").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("event_id", "c_name", "n_name")


@query("SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def prj_json_path(t: Tables) -> DataFrame:
    return t.events.groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_name, (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS total FROM customer WHERE c_acctbal > 0 ORDER BY lower(c_name), c_custkey LIMIT 20 OFFSET 40")
def win_total_over(t: Tables) -> DataFrame:
    return paging.page_with_total(t.customer.where("c_acctbal > 0"), [F.lower("c_name"), F.col("c_custkey")], 40, 20).select("c_custkey", "c_name", "total")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS placed FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25 OFFSET 50")
def srt_page(t: Tables) -> DataFrame:
    return t.orders.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).offset(50).limit(25).select("o_orderkey", day("o_orderdate").alias("placed"))


@query("SELECT s_suppkey, s_name FROM supplier ORDER BY lower(s_name), s_suppkey")
def srt_ci(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", "s_name").orderBy(F.lower("s_name"), "s_suppkey")


@query("SELECT event_id, user_id FROM events WHERE user_id = 8 ORDER BY ts DESC, event_id DESC LIMIT 30")
def srt_inbox(t: Tables) -> DataFrame:
    return t.events.where("user_id = 8").orderBy(F.desc("ts"), F.desc("event_id")).limit(30).select("event_id", "user_id")


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders ORDER BY o_orderdate, o_orderpriority, o_orderkey LIMIT 100")
def srt_units_ui(t: Tables) -> DataFrame:
    return t.orders.orderBy("o_orderdate", "o_orderpriority", "o_orderkey").limit(100).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("""
    SELECT * FROM (SELECT 'customer' AS hit_group, CAST(c_custkey AS VARCHAR) AS key, c_name AS hit FROM customer WHERE contains(lower(c_name), '12') ORDER BY lower(c_name), key LIMIT 5)
    UNION ALL SELECT * FROM (SELECT 'supplier', CAST(s_suppkey AS VARCHAR) AS key, s_name FROM supplier WHERE contains(lower(s_name), '12') ORDER BY lower(s_name), key LIMIT 5)
    UNION ALL SELECT * FROM (SELECT 'part', CAST(p_partkey AS VARCHAR) AS key, p_brand FROM part WHERE contains(lower(p_brand), '12') ORDER BY lower(p_brand), key LIMIT 5)
    UNION ALL SELECT * FROM (SELECT 'nation', CAST(n_nationkey AS VARCHAR) AS key, n_name FROM nation WHERE contains(lower(n_name), '12') ORDER BY lower(n_name), key LIMIT 5)
    UNION ALL SELECT * FROM (SELECT 'page', CAST(page_id AS VARCHAR) AS key, url FROM pages WHERE contains(lower(url), '12') ORDER BY lower(url), key LIMIT 5)""")
def srt_search_groups(t: Tables) -> DataFrame:
    made = [("customer", t.customer, "c_custkey", "c_name"), ("supplier", t.supplier, "s_suppkey", "s_name"), ("part", t.part, "p_partkey", "p_brand"), ("nation", t.nation, "n_nationkey", "n_name"), ("page", t.pages, "page_id", "url")]
    return paging.search_groups([(name, df.where(paging.contains_ci(text, "12")), F.col(key), F.col(text)) for name, df, key, text in made])


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring') OR contains(lower(p_type), 'ring')")
def flt_icontains(t: Tables) -> DataFrame:
    return t.part.where(paging.contains_ci("p_name", "RING") | paging.contains_ci("p_brand", "RING") | paging.contains_ci("p_type", "RING")).select("p_partkey", "p_name")


@query("SELECT c_custkey FROM customer WHERE starts_with(upper(replace(c_name, ' ', '')), 'CUSTOMER#00000001') OR contains(lower(c_name), '77')")
def flt_prefix_or_infix(t: Tables) -> DataFrame:
    return t.customer.where(F.startswith(F.upper(F.replace("c_name", F.lit(" "), F.lit(""))), F.lit("CUSTOMER#00000001")) | paging.contains_ci("c_name", "77")).select("c_custkey")


@query("SELECT p_partkey FROM part WHERE lower(p_type) = lower('Promo')")
def flt_ci_equal(t: Tables) -> DataFrame:
    return t.part.where(F.lower("p_type") == F.lower(F.lit("Promo"))).select("p_partkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus IN ('F', 'O')")
def flt_in_set(t: Tables) -> DataFrame:
    return t.orders.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & F.col("o_orderstatus").isin("F", "O")).select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_nationkey = 3")
def flt_tenant(t: Tables) -> DataFrame:
    return t.customer.where("c_nationkey = 3").select("c_custkey")


@query("SELECT event_id FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-03'")
def flt_utc_date(t: Tables) -> DataFrame:
    return t.events.where((F.col("ts") >= F.lit("2024-01-03").cast("timestamp")) & (F.col("ts") < F.lit("2024-01-04").cast("timestamp"))).select("event_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1997-07-01' AND o_orderdate < DATE '1997-10-01'")
def flt_half_open(t: Tables) -> DataFrame:
    return t.orders.where(dates.half_open(F.col("o_orderdate"), F.lit("1997-07-01").cast("date"), F.lit("1997-10-01").cast("date"))).select("o_orderkey")


@query("SELECT event_id FROM events WHERE NOT starts_with(event_type, 'sign')")
def flt_not_action_prefix(t: Tables) -> DataFrame:
    return t.events.where(~F.col("event_type").startswith("sign")).select("event_id")


@query(f"SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderdate < {SQL_DAY}")
def flt_overdue(t: Tables) -> DataFrame:
    return t.orders.where((F.col("o_orderstatus") == "O") & (F.col("o_orderdate") < F.lit(TODAY))).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey = 42 AND o_orderstatus = 'F' ORDER BY o_orderkey")
def flt_optional(t: Tables) -> DataFrame:
    given = paging.matching([F.col("o_custkey") == 42, F.col("o_orderstatus") == "F", None])
    return t.orders.where(given).select("o_orderkey").orderBy("o_orderkey")


@query("""
    SELECT role, count(*) AS units FROM (SELECT unnest(['admin', 'sme', 'governor']) AS role) r JOIN orders o ON role = 'admin' OR (role = 'sme' AND o_custkey = 42) OR (role = 'governor' AND o_orderstatus IN ('P', 'F')) GROUP BY 1""")
def flt_role_scope(t: Tables) -> DataFrame:
    """Whom a unit is shown to: an array of roles a row, so the units are read once."""
    roles = F.array_compact(F.array(F.lit("admin"), F.when(F.col("o_custkey") == 42, F.lit("sme")), F.when(F.col("o_orderstatus").isin("P", "F"), F.lit("governor"))))
    return t.orders.select(F.explode(roles).alias("role")).groupBy("role").agg(F.count("*").alias("units"))


@query("SELECT c_custkey, 'U-' || lpad(CAST(c_custkey AS VARCHAR), 4, '0') AS code FROM customer")
def prj_lpad_code(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.concat(F.lit("U-"), F.lpad(F.col("c_custkey").cast("string"), 4, "0")).alias("code"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'suspended' WHEN c_acctbal < 1000 THEN 'idle' ELSE 'active' END AS status FROM customer")
def prj_case_status(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.when(F.col("c_acctbal") < 0, "suspended").when(F.col("c_acctbal") < 1000, "idle").otherwise("active").alias("status"))


@query("SELECT p_partkey, coalesce(q, 0) AS quantity FROM part LEFT JOIN (SELECT l_partkey, sum(l_quantity) AS q FROM lineitem WHERE l_discount = 0.1 GROUP BY 1) ON l_partkey = p_partkey")
def prj_coalesce_zero(t: Tables) -> DataFrame:
    q = t.lineitem.where("l_discount = 0.1D").groupBy("l_partkey").agg(F.sum("l_quantity").alias("q"))
    return t.part.join(q, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", F.coalesce("q", F.lit(0.0)).alias("quantity"))


@query("SELECT conv_id, CAST(json_array_length(to_json(list(turn))) AS BIGINT) AS n FROM conversations GROUP BY 1")
def prj_json_length(t: Tables) -> DataFrame:
    return t.conversations.groupBy("conv_id").agg(F.json_array_length(F.to_json(F.collect_list("turn"))).cast("long").alias("n"))


@query("""
    WITH a AS (SELECT conv_id, max(turn) AS v FROM conversations WHERE conv_id < 70 GROUP BY 1), b AS (SELECT conv_id, max(turn) AS v FROM conversations WHERE conv_id >= 30 AND turn <> 3 GROUP BY 1)
    SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, CASE WHEN a.v IS NULL THEN 'added' WHEN b.v IS NULL THEN 'removed' ELSE 'v' || a.v || ' to v' || b.v END AS change
    FROM a FULL JOIN b ON a.conv_id = b.conv_id WHERE a.v IS DISTINCT FROM b.v""")
def prj_content_change(t: Tables) -> DataFrame:
    top = lambda cond, name: t.conversations.where(cond).groupBy("conv_id").agg(F.max("turn").alias(name))
    both = top("conv_id < 70", "a").join(top("conv_id >= 30 AND turn <> 3", "b"), "conv_id", "full").where(~F.col("a").eqNullSafe(F.col("b")))
    return both.select("conv_id", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise(F.concat(F.lit("v"), F.col("a").cast("string"), F.lit(" to v"), F.col("b").cast("string"))).alias("change"))


@query("SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M') AS last_activity FROM events WHERE event_type <> 'signup' GROUP BY 1")
def agg_max_time(t: Tables) -> DataFrame:
    return t.events.where("event_type <> 'signup'").groupBy("user_id").agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm").alias("last_activity"))


@query("""
    SELECT o_custkey, count(*) AS timed, CAST(sum(epoch(l_shipdate) - epoch(o_orderdate)) AS BIGINT) AS seconds, CAST(round(CAST(sum(epoch(l_shipdate) - epoch(o_orderdate)) AS DECIMAL(20, 4)) / 86400 / count(*), 1) AS DOUBLE) AS days
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate GROUP BY 1""")
def agg_turnaround(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).where("l_shipdate >= o_orderdate")
    out = rows.groupBy("o_custkey").agg(F.count("*").alias("timed"), F.sum(F.unix_seconds(F.col("l_shipdate").cast("timestamp")) - F.unix_seconds(F.col("o_orderdate").cast("timestamp"))).alias("seconds"))
    return out.withColumn("days", numbers.average_days(F.col("seconds"), F.col("timed")).cast("double"))


@query("SELECT o_orderpriority, CAST(round(CAST(100 * count(*) FILTER (o_orderstatus = 'F') AS DECIMAL(20, 4)) / count(*), 1) AS DOUBLE) AS frozen_percent FROM orders GROUP BY 1")
def agg_percent(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f")).select("o_orderpriority", numbers.percent(F.col("f"), F.col("n")).cast("double").alias("frozen_percent"))


@query(f"""
    SELECT strftime(q, '%Y-%m-%d') AS quarter, count(o_orderkey) AS units FROM (SELECT unnest(generate_series(date_trunc('quarter', {SQL_DAY}) - INTERVAL 9 MONTH, date_trunc('quarter', {SQL_DAY}), INTERVAL 3 MONTH)) AS q) LEFT JOIN orders ON date_trunc('quarter', o_orderdate) = q GROUP BY 1""")
def agg_quarter_counts(t: Tables) -> DataFrame:
    """The last four quarters, those without a unit as 0."""
    now = F.date_trunc("quarter", F.lit(TODAY))
    calendar = t.spark.range(1).select(F.explode(F.sequence(F.add_months(now, -9), F.to_date(now), F.expr("interval 3 months"))).alias("q"))
    counts = t.orders.groupBy(dates.quarter_start(F.col("o_orderdate")).alias("q")).agg(F.count("*").alias("n"))
    return calendar.join(counts, "q", "left").select(day("q").alias("quarter"), F.coalesce("n", F.lit(0)).alias("units"))


@query("SELECT CAST(CASE WHEN month(o_orderdate) >= 7 THEN year(o_orderdate) ELSE year(o_orderdate) - 1 END AS INTEGER) AS start_year, min(CASE WHEN month(o_orderdate) >= 7 THEN year(o_orderdate) || '-' || lpad(CAST((year(o_orderdate) + 1) % 100 AS VARCHAR), 2, '0') ELSE (year(o_orderdate) - 1) || '-' || lpad(CAST(year(o_orderdate) % 100 AS VARCHAR), 2, '0') END) AS label, count(*) AS units FROM orders GROUP BY 1")
def dt_academic_year(t: Tables) -> DataFrame:
    d = F.col("o_orderdate")
    return t.orders.groupBy(dates.academic_year(d).alias("start_year")).agg(F.min(dates.academic_label(d)).alias("label"), F.count("*").alias("units"))


@query("SELECT o_orderkey, CAST(quarter(o_orderdate) AS INTEGER) AS quarter, strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') AS starts FROM orders")
def dt_quarter(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.quarter("o_orderdate").alias("quarter"), day(dates.quarter_start(F.col("o_orderdate"))).alias("starts"))


@query(f"SELECT o_orderkey, CAST(date_diff('day', {SQL_DAY}, CAST(o_orderdate AS DATE)) AS INTEGER) AS days FROM orders")
def dt_days_until(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", dates.days_until(F.col("o_orderdate"), F.lit(TODAY)).alias("days"))


@query("SELECT event_id, round(CAST(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS DOUBLE) / 1000000, 6) AS seconds FROM events")
def dt_epoch_diff(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.round(dates.seconds_between(F.col("ts"), F.lit("2024-01-01").cast("timestamp")), 6).alias("seconds"))


@query("SELECT l_linestatus, count(*) FILTER (CAST(l_shipdate AS DATE) <= CAST(o_orderdate AS DATE)) AS on_time, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def dt_on_time(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy("l_linestatus").agg(F.count_if(dates.on_time(F.col("l_shipdate"), F.col("o_orderdate"))).alias("on_time"), F.count("*").alias("n"))


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def agg_distinct(t: Tables) -> DataFrame:
    return t.orders.where("o_orderstatus = 'O'").select("o_custkey").distinct()


@query("SELECT lower(p_type) AS folded, min_by(p_type, p_partkey) AS spelling FROM part GROUP BY 1")
def agg_distinct_ci(t: Tables) -> DataFrame:
    return t.part.groupBy(F.lower("p_type").alias("folded")).agg(F.min_by("p_type", "p_partkey").alias("spelling"))


@query("SELECT p_partkey, coalesce(a.n, 0) + coalesce(b.n, 0) AS keys FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) a ON a.l_partkey = p_partkey LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) b ON b.l_partkey = p_partkey")
def agg_key_counts(t: Tables) -> DataFrame:
    n = t.lineitem.where("l_returnflag = 'A'").select("l_partkey").unionByName(t.lineitem.where("l_returnflag = 'R'").select("l_partkey")).groupBy("l_partkey").agg(F.count("*").alias("n"))
    return t.part.join(n, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", F.coalesce("n", F.lit(0)).alias("keys"))


@query("SELECT l_orderkey, count(*) FILTER (l_quantity > 5) AS attempted, count(*) FILTER (l_linestatus = 'F') AS approved FROM lineitem GROUP BY 1")
def agg_tallies(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(F.count_if(F.col("l_quantity") > 5).alias("attempted"), F.count_if(F.col("l_linestatus") == "F").alias("approved"))


@query("SELECT count(*) FILTER (o_orderstatus = 'O') AS queued, count(*) FILTER (o_orderstatus = 'P') AS running FROM orders")
def agg_queue_depth(t: Tables) -> DataFrame:
    return t.orders.agg(F.count_if(F.col("o_orderstatus") == "O").alias("queued"), F.count_if(F.col("o_orderstatus") == "P").alias("running"))


@query("SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'view') AS unread FROM events GROUP BY 1")
def agg_unread(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(F.col("event_type") == "view").alias("unread"))


@query("SELECT source, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY 1")
def agg_storage(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(F.sum(F.octet_length("text")).alias("bytes"))


@query("SELECT flag, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN l_discount = 0 THEN 'full price' END, CASE WHEN l_tax = 0 THEN 'untaxed' END, CASE WHEN l_quantity < 3 THEN 'few' END], lambda x: x IS NOT NULL)) AS flag FROM lineitem) GROUP BY 1")
def agg_flag_counts(t: Tables) -> DataFrame:
    flags = F.array_compact(F.array(F.when(F.col("l_discount") == 0, "full price"), F.when(F.col("l_tax") == 0, "untaxed"), F.when(F.col("l_quantity") < 3, "few")))
    return t.lineitem.select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


@query("SELECT source, count(*) AS docs, count(*) FILTER (n_chars < 100) AS short, round(avg(n_chars), 4) AS mean_chars, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'de') AS de FROM documents GROUP BY 1")
def agg_page_summary(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(F.count("*").alias("docs"), F.count_if(F.col("n_chars") < 100).alias("short"), F.round(F.avg("n_chars"), 4).alias("mean_chars"), F.count_if(F.col("lang") == "en").alias("en"), F.count_if(F.col("lang") == "de").alias("de"))


@query("SELECT lang, count(*) AS docs, count(l.doc_id) AS labelled, count(*) FILTER (quality = 1) AS verified FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1")
def agg_truth_progress(t: Tables) -> DataFrame:
    labels = t.labels.withColumn("known", F.lit(1))
    return t.documents.join(labels, "doc_id", "left").groupBy("lang").agg(F.count("*").alias("docs"), F.count("known").alias("labelled"), F.count_if(F.col("quality") == 1).alias("verified"))


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2")
def agg_confusion(t: Tables) -> DataFrame:
    return t.labels.groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@query("SELECT source, round(sum(quality * greatest(n_chars, 1)) / sum(greatest(n_chars, 1)), 6) AS weighted FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def agg_weighted_mean(t: Tables) -> DataFrame:
    w = F.greatest("n_chars", F.lit(1))
    return t.documents.join(t.labels, "doc_id").groupBy("source").agg(F.round(F.sum(F.col("quality") * w) / F.sum(w), 6).alias("weighted"))


@query("SELECT event_type, median(value) AS middle FROM events GROUP BY 1")
def agg_median(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.median("value").alias("middle"))


@query("SELECT DISTINCT p_brand FROM part WHERE trim(p_brand) <> '' ORDER BY lower(p_brand), p_brand")
def agg_header_values(t: Tables) -> DataFrame:
    return t.part.where(F.trim("p_brand") != "").select("p_brand").distinct().orderBy(F.lower("p_brand"), "p_brand")


@query("SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1")
def agg_unit_count(t: Tables) -> DataFrame:
    return t.customer.groupBy("c_nationkey").agg(F.count("*").alias("n"))


@query("SELECT o_custkey, count(*) AS open, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS units FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def agg_group_by_owner(t: Tables) -> DataFrame:
    keys = F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda x: x.cast("string"))
    return t.orders.where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.count("*").alias("open"), F.array_join(keys, ",").alias("units"))


@query("SELECT count(*) AS pages, count(*) FILTER (contains(html, '<table')) AS with_tables, CAST(sum(length(html)) AS BIGINT) AS chars FROM pages")
def agg_detection(t: Tables) -> DataFrame:
    return t.pages.agg(F.count("*").alias("pages"), F.count_if(F.contains("html", F.lit("<table"))).alias("with_tables"), F.sum(F.length("html")).alias("chars"))


@query("SELECT source, CASE WHEN n < 5 THEN 'few documents' WHEN share > 0.8 THEN 'mostly one language' ELSE 'fine' END AS warning FROM (SELECT source, count(*) AS n, count(*) FILTER (lang = 'en') / count(*) AS share FROM documents GROUP BY 1)")
def agg_warnings(t: Tables) -> DataFrame:
    s = t.documents.groupBy("source").agg(F.count("*").alias("n"), (F.count_if(F.col("lang") == "en") / F.count("*")).alias("share"))
    return s.select("source", F.when(F.col("n") < 5, "few documents").when(F.col("share") > 0.8, "mostly one language").otherwise("fine").alias("warning"))


@query("SELECT role, count(*) AS calls, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY 1")
def agg_llm_usage(t: Tables) -> DataFrame:
    return t.conversations.groupBy("role").agg(F.count("*").alias("calls"), F.sum(F.length("text")).alias("chars"))


@query("SELECT reason, count(o_orderkey) AS n FROM (SELECT unnest(['1-URGENT', '2-HIGH', '9-NEVER']) AS reason) LEFT JOIN orders ON o_orderpriority = reason GROUP BY 1")
def agg_histogram_reason(t: Tables) -> DataFrame:
    """Every value of the enumeration, those that don't occur as 0."""
    enum = t.spark.createDataFrame([("1-URGENT",), ("2-HIGH",), ("9-NEVER",)], "reason string")
    n = t.orders.groupBy(F.col("o_orderpriority").alias("reason")).agg(F.count("*").alias("n"))
    return enum.join(n, "reason", "left").select("reason", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT o_orderkey, round(avg(l_discount) FILTER (l_returnflag <> 'R'), 6) AS confidence, count(*) FILTER (l_discount < 0.02) AS low, CAST(min(l_linenumber) AS INTEGER) AS first_line, CAST(max(l_linenumber) AS INTEGER) AS last_line FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def agg_segment_confidence(t: Tables) -> DataFrame:
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.avg(F.when(F.col("l_returnflag") != "R", F.col("l_discount"))), 6).alias("confidence"), F.count_if(F.col("l_discount") < 0.02).alias("low"), F.min("l_linenumber").alias("first_line"), F.max("l_linenumber").alias("last_line"))
    return lines.join(t.orders, "o_orderkey", "left_semi")


@query(f"""
    SELECT c_nationkey, count(*) AS lifetime, count(*) FILTER (o_orderdate >= DATE '2000-07-01' AND o_orderdate < DATE '2001-07-01') AS this_year, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'P') AS submitted, count(*) FILTER (o_orderstatus = 'F') AS frozen,
           CAST(round(CAST(100 * count(*) FILTER (o_orderstatus <> 'O') AS DECIMAL(20, 4)) / count(*), 1) AS DOUBLE) AS completion
    FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1""")
def rep_assignments(t: Tables) -> DataFrame:
    s, d = F.col("o_orderstatus"), F.col("o_orderdate")
    year = dates.half_open(d, F.lit("2000-07-01").cast("date"), F.lit("2001-07-01").cast("date"))
    out = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.count("*").alias("lifetime"), F.count_if(year).alias("this_year"), F.count_if(s == "O").alias("open"), F.count_if(s == "P").alias("submitted"), F.count_if(s == "F").alias("frozen"), F.count_if(s != "O").alias("done"))
    return out.withColumn("completion", numbers.percent(F.col("done"), F.col("lifetime")).cast("double")).drop("done")


@query("SELECT o_orderkey, c_name, n_name, o_orderstatus, coalesce(booklets, 0) AS booklets FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey LEFT JOIN (SELECT l_orderkey, count(*) AS booklets FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def rep_progress(t: Tables) -> DataFrame:
    n = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("booklets"))
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.select("o_orderkey", "c_name", "n_name", "o_orderstatus", F.coalesce("booklets", F.lit(0)).alias("booklets"))


@query("SELECT o_orderkey, coalesce(attempted, 0) AS attempted, coalesce(approved, 0) AS approved, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS total FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 50 OFFSET 100) LEFT JOIN (SELECT l_orderkey, count(*) AS attempted, count(*) FILTER (l_linestatus = 'F') AS approved FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def rep_unit_rows(t: Tables) -> DataFrame:
    page = paging.page_with_total(t.orders.where("o_orderstatus = 'O'").select("o_orderkey"), [F.col("o_orderkey")], 100, 50)
    tallies = t.lineitem.join(page.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").groupBy("l_orderkey").agg(F.count("*").alias("attempted"), F.count_if(F.col("l_linestatus") == "F").alias("approved"))
    return page.join(tallies, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("attempted", F.lit(0)).alias("attempted"), F.coalesce("approved", F.lit(0)).alias("approved"), "total")


@query("SELECT p_partkey, p_name, total FROM (SELECT p_partkey, p_name, count(*) OVER () AS total FROM part WHERE p_size < 20 AND (contains(lower(p_name), 'bolt') OR p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50))) ORDER BY lower(p_name), p_partkey LIMIT 30")
def rep_question_search(t: Tables) -> DataFrame:
    live = t.lineitem.where("l_quantity = 50").select(F.col("l_partkey").alias("p_partkey"), F.lit(True).alias("live")).distinct()
    found = t.part.where("p_size < 20").join(live, "p_partkey", "left").where(paging.contains_ci("p_name", "bolt") | F.col("live"))
    return paging.page_with_total(found, [F.lower("p_name"), F.col("p_partkey")], 0, 30).select("p_partkey", "p_name", "total")


@query("SELECT conv_id, turn, uses, first_len, (SELECT count(DISTINCT conv_id) FROM conversations) AS total FROM (SELECT conv_id, max(turn) AS turn, count(*) AS uses, min_by(length(text), turn) AS first_len FROM conversations GROUP BY 1) ORDER BY conv_id LIMIT 40 OFFSET 10")
def rep_blueprint_page(t: Tables) -> DataFrame:
    rows = t.conversations.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.count("*").alias("uses"), F.min_by(F.length("text").cast("long"), "turn").alias("first_len"))
    return paging.page_with_total(rows, [F.col("conv_id")], 10, 40).select("conv_id", "turn", "uses", "first_len", "total")


@query("SELECT a.conv_id, a.turn AS scored_turn, b.turn AS current_turn FROM (SELECT conv_id, max(turn) AS turn FROM conversations WHERE role = 'user' GROUP BY 1) a JOIN (SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY 1) b ON a.conv_id = b.conv_id AND a.turn < b.turn")
def rep_stale_answers(t: Tables) -> DataFrame:
    """Answers scored on a version that is no longer current, in one pass."""
    both = t.conversations.groupBy("conv_id").agg(F.max(F.when(F.col("role") == "user", F.col("turn"))).alias("scored_turn"), F.max("turn").alias("current_turn"))
    return both.where("scored_turn < current_turn")


@query("SELECT n_name AS name, 'nation' AS kind FROM nation UNION SELECT r_name, 'region' FROM region")
def set_union_counts(t: Tables) -> DataFrame:
    return t.nation.select(F.col("n_name").alias("name"), F.lit("nation").alias("kind")).union(t.region.select("r_name", F.lit("region"))).distinct()


@query("(SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') UNION ALL (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def set_sym_diff(t: Tables) -> DataFrame:
    """In one of two sets and not the other, by one aggregate instead of two anti-joins."""
    n = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.bool_or(F.col("o_orderstatus") == "O").alias("a"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("b"))
    return n.where("a <> b").select("k")


@query("SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R'")
def set_intersect_pairs(t: Tables) -> DataFrame:
    side = lambda f: t.lineitem.where(F.col("l_returnflag") == f).select("l_partkey", "l_suppkey")
    return side("A").intersect(side("R"))


@query("SELECT DISTINCT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) OR o_custkey = 9")
def set_reach(t: Tables) -> DataFrame:
    granted = t.customer.join(t.nation.where("n_regionkey = 1"), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select(F.col("c_custkey").alias("o_custkey"))
    owner = granted.union(t.spark.createDataFrame([(9,)], "o_custkey long")).distinct()
    return t.orders.join(owner, "o_custkey", "left_semi").select("o_orderkey")


@query("""
    SELECT r_name, any_value(feed) AS feed, count(DISTINCT c_custkey) AS owners, count(DISTINCT o_orderkey) AS units, count(DISTINCT o_orderkey) FILTER (o_orderstatus = 'O') AS open, count(DISTINCT o_orderkey) FILTER (o_orderstatus = 'P') AS submitted, count(DISTINCT o_orderkey) FILTER (o_orderstatus = 'F') AS frozen, strftime(max(o_orderdate), '%Y-%m-%d') AS newest, count(*) AS booklets, count(*) FILTER (l_linestatus = 'F') AS approved
    FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
    JOIN (SELECT n_regionkey AS k, string_agg(o_orderkey, ',' ORDER BY o_orderdate DESC, o_orderkey) AS feed FROM (SELECT n_regionkey, o_orderkey, o_orderdate FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey QUALIFY row_number() OVER (PARTITION BY n_regionkey ORDER BY o_orderdate DESC, o_orderkey) <= 8) GROUP BY 1) ON k = r_regionkey GROUP BY 1""")
def rep_dashboard(t: Tables) -> DataFrame:
    """By region owners, units by stage, the feed of the eight newest units, booklets; line items are counted by unit and units by owner before they are joined, and a region's newest are cut down before they are shuffled."""
    lines = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("b"), F.count_if(F.col("l_linestatus") == "F").alias("f"))
    s = F.col("o_orderstatus")
    rows = t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey").agg(F.count("*").alias("u"), F.count_if(s == "O").alias("open"), F.count_if(s == "P").alias("submitted"), F.count_if(s == "F").alias("frozen"), F.max("o_orderdate").alias("newest"), F.sum("b").alias("b"), F.sum("f").alias("f"))
    places = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    sums = [F.sum(a).alias(b) for a, b in (("u", "units"), ("open", "open"), ("submitted", "submitted"), ("frozen", "frozen"), ("b", "booklets"), ("f", "approved"))]
    newest = Window.partitionBy("r_name").orderBy(F.desc("o_orderdate"), "o_orderkey")
    top = t.orders.select("o_custkey", "o_orderkey", "o_orderdate").join(places.select("c_custkey", "r_name"), F.col("o_custkey") == F.col("c_custkey")).withColumn("at", F.row_number().over(newest)).where("at <= 8")
    feed = top.groupBy("r_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "o_orderkey"))), lambda x: x["o_orderkey"].cast("string")), ",").alias("feed"))
    return rows.join(places, F.col("o_custkey") == F.col("c_custkey")).join(feed, "r_name").groupBy("r_name", "feed").agg(F.count("*").alias("owners"), *sums, F.date_format(F.max("newest"), "yyyy-MM-dd").alias("newest"))


@query(f"""
    SELECT c_custkey, count(*) AS handed_in, count(*) FILTER (l_shipdate <= o_orderdate + INTERVAL 30 DAY) AS on_time, count(*) FILTER (l_linestatus = 'O') AS pending, CAST(round(CAST(100 * count(*) FILTER (l_shipdate <= o_orderdate + INTERVAL 30 DAY) AS DECIMAL(20, 4)) / count(*), 1) AS DOUBLE) AS on_time_percent,
        CAST(round(CAST(sum(date_diff('day', o_orderdate, l_shipdate)) FILTER (l_shipdate >= o_orderdate) AS DECIMAL(20, 4)) / nullif(count(*) FILTER (l_shipdate >= o_orderdate), 0), 1) AS DOUBLE) AS turnaround_days,
        count(*) FILTER (quarter(l_shipdate) = 1) AS q1, count(*) FILTER (quarter(l_shipdate) = 2) AS q2, count(*) FILTER (quarter(l_shipdate) = 3) AS q3, count(*) FILTER (quarter(l_shipdate) = 4) AS q4
    FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def rep_my_report(t: Tables) -> DataFrame:
    """An owner's hand-ins: on time within 30 days, still pending, the mean days taken and the counts by quarter."""
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    days = F.datediff("l_shipdate", "o_orderdate")
    quarters = [F.count_if(F.quarter("l_shipdate") == q).alias(f"q{q}") for q in (1, 2, 3, 4)]
    out = rows.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("handed_in"), F.count_if(days <= 30).alias("on_time"), F.count_if(F.col("l_linestatus") == "O").alias("pending"), F.sum(F.when(days >= 0, days)).alias("__s"), F.count_if(days >= 0).alias("__n"), *quarters)
    out = out.join(t.customer, "c_custkey", "left_semi").withColumn("on_time_percent", numbers.percent(F.col("on_time"), F.col("handed_in")).cast("double"))
    mean = F.round(F.col("__s").cast("decimal(20,4)") / F.nullif(F.col("__n"), F.lit(0)), 1).cast("double")
    return out.withColumn("turnaround_days", mean).drop("__s", "__n")
