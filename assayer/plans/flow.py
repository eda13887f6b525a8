"""Queries on changes of tables, event rules and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.operators import mutation, paging, state
from assayer.registry import TODAY, Tables, query
from assayer.sources import readers


def _base(t: Tables) -> DataFrame:
    """Customers as they were: all but those of one segment."""
    return t.customer.where("c_mktsegment <> 'BUILDING'").select("c_custkey", "c_mktsegment", F.lit(1).alias("version"))


def _changes(t: Tables) -> DataFrame:
    """Changes to the customers of every other nation, some of them to a version that doesn't follow."""
    return t.customer.where("c_nationkey % 2 = 0").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).otherwise(F.lit("CHANGED")).alias("c_mktsegment"), F.when(F.col("c_custkey") % 5 == 0, 7).otherwise(2).alias("version"))


SQL_BASE = "b AS (SELECT c_custkey, c_mktsegment, 1 AS version FROM customer WHERE c_mktsegment <> 'BUILDING'), n AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE 'CHANGED' END AS c_mktsegment, CASE WHEN c_custkey % 5 = 0 THEN 7 ELSE 2 END AS version FROM customer WHERE c_nationkey % 2 = 0)"


@query(f"WITH {SQL_BASE} SELECT coalesce(b.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN n.c_custkey IS NOT NULL AND (b.c_custkey IS NULL OR n.version = b.version + 1) THEN n.c_mktsegment ELSE b.c_mktsegment END AS c_mktsegment, CASE WHEN n.c_custkey IS NOT NULL AND (b.c_custkey IS NULL OR n.version = b.version + 1) THEN n.version ELSE b.version END AS version FROM b FULL JOIN n ON n.c_custkey = b.c_custkey")
def snk_upsert(t: Tables) -> DataFrame:
    return mutation.upsert(_base(t), _changes(t), "c_custkey", "version")


@query(f"WITH {SQL_BASE} SELECT CASE WHEN b.c_custkey IS NULL THEN 'created' WHEN b.c_mktsegment = n.c_mktsegment THEN 'unchanged' ELSE 'updated' END AS change, count(*) AS n FROM n LEFT JOIN b USING (c_custkey) GROUP BY 1")
def snk_roster_upsert(t: Tables) -> DataFrame:
    return mutation.change_classes(_base(t).drop("version"), _changes(t).drop("version"), "c_custkey").groupBy("change").agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn FROM (SELECT conv_id, max(turn) AS m FROM conversations WHERE turn < 4 GROUP BY 1) JOIN (SELECT conv_id, turn FROM conversations WHERE turn >= 3) USING (conv_id) WHERE turn = m + 1")
def snk_append_version(t: Tables) -> DataFrame:
    """Versions that may be appended: each the one after its newest."""
    from assayer.operators.latest import append_versions

    taken, _ = append_versions(t.conversations.where("turn < 4"), t.conversations.where("turn >= 3"), "conv_id", "turn")
    return taken.select("conv_id", "turn")


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events e WHERE event_id >= 500 AND NOT EXISTS (SELECT 1 FROM events x WHERE x.event_id < 500 AND x.user_id = e.user_id AND x.event_type = e.event_type) GROUP BY 1, 2")
def snk_insert_once(t: Tables) -> DataFrame:
    e = t.events.select("user_id", "event_type", "event_id")
    return mutation.insert_once(e.where("event_id < 500"), e.where("event_id >= 500"), ["user_id", "event_type"], F.col("event_id"))


@query("SELECT event_id, CASE WHEN user_id % 10 = 3 THEN NULL ELSE props END AS props FROM events")
def snk_redact(t: Tables) -> DataFrame:
    gone = t.events.where("user_id % 10 = 3").select("user_id")
    return mutation.redact(t.events.select("event_id", "user_id", "props"), gone, "user_id", ["props"]).select("event_id", "props")


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_orderkey % 10 <> 0 UNION ALL SELECT l_orderkey, l_partkey, 0.0 FROM lineitem WHERE l_orderkey % 10 = 0 AND l_linenumber = 1")
def snk_replace_children(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_orderkey", "l_partkey", "l_quantity")
    tens = t.orders.where("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    new = t.lineitem.where("l_orderkey % 10 = 0 AND l_linenumber = 1").select("l_orderkey", "l_partkey", F.lit(0.0).alias("l_quantity"))
    kept = lines.join(tens, "l_orderkey", "left_anti")
    return mutation.replace_children(kept, new, "l_orderkey")


@query("SELECT DISTINCT url, 'moved/' || substr(url, 9) AS renamed FROM pages WHERE starts_with(url, 'https://')")
def snk_relocate(t: Tables) -> DataFrame:
    return mutation.rename_prefix(t.pages, "url", "https://", "moved/").select("url", "renamed")


@query("SELECT coalesce(w.p_partkey, l.p_partkey) AS p_partkey, CASE WHEN l.p_partkey IS NULL THEN 'insert' WHEN w.p_partkey IS NULL THEN 'retire' WHEN w.c IS DISTINCT FROM l.c THEN 'new version' ELSE 'keep' END AS what FROM (SELECT p_partkey, CASE WHEN p_size < 10 THEN 'x' ELSE p_name END AS c FROM part WHERE p_size < 35) w FULL JOIN (SELECT p_partkey, p_name AS c FROM part WHERE p_size >= 5) l ON l.p_partkey = w.p_partkey")
def snk_rubric_plan(t: Tables) -> DataFrame:
    wanted = t.part.where("p_size < 35").select("p_partkey", F.when(F.col("p_size") < 10, "x").otherwise(F.col("p_name")).alias("c"))
    live = t.part.where("p_size >= 5").select("p_partkey", F.col("p_name").alias("c"))
    return mutation.plan_changes(wanted, live, "p_partkey", "c")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem l WHERE l_returnflag = 'N' AND NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey = l.l_orderkey AND x.l_returnflag = 'A')")
def snk_prefill(t: Tables) -> DataFrame:
    touched = t.lineitem.where("l_returnflag = 'A'").select("l_orderkey")
    return t.lineitem.where("l_returnflag = 'N'").join(touched, "l_orderkey", "left_anti").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query("SELECT o_orderkey, o_orderstatus, count(l_orderkey) AS lines, round(coalesce(sum(l_extendedprice), 0), 2) AS total, coalesce(max(l_quantity), 0) AS top FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY 1, 2")
def snk_snapshot_freeze(t: Tables) -> DataFrame:
    lines = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.round(F.sum("l_extendedprice"), 2).alias("total"), F.max("l_quantity").alias("top"))
    rows = t.orders.where("o_orderstatus = 'F'").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.select("o_orderkey", "o_orderstatus", F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("total", F.lit(0.0)).alias("total"), F.coalesce("top", F.lit(0.0)).alias("top"))


@query("SELECT c_custkey, '{\"name\":\"' || c_name || '\",\"segment\":\"' || c_mktsegment || '\"}' AS report FROM customer")
def snk_json_report(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))).alias("report"))


@query("""
    WITH s AS (SELECT user_id, max(ts) FILTER (event_type = 'view') AS served, count(*) FILTER (event_type = 'click' AND ts >= TIMESTAMP '2024-01-20') AS running FROM events GROUP BY 1),
    j AS (SELECT e.user_id, event_id, ts, served, running, row_number() OVER (PARTITION BY e.user_id ORDER BY ts, event_id) AS k FROM events e JOIN s USING (user_id) WHERE event_type = 'purchase' OR (event_type = 'click' AND ts < TIMESTAMP '2024-01-20'))
    SELECT user_id, event_id, CAST(row_number() OVER (ORDER BY k, served NULLS FIRST, user_id, ts, event_id) AS BIGINT) AS turn FROM j WHERE k <= 5 - running""")
def st_claim(t: Tables) -> DataFrame:
    """The order in which jobs are claimed. Purchases wait; clicks run under a lease, and those before the 20th have lost it and can be claimed again. A tenant has five running at most; in each round the one served (a view) least recently comes first, one never served before all, and its oldest job."""
    e, lost = t.events, F.lit("2024-01-20").cast("timestamp_ntz")
    click = F.col("event_type") == "click"
    tenant = e.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "view", F.col("ts"))).alias("served"), F.count_if(click & (F.col("ts") >= lost)).alias("running"))
    jobs = e.where((F.col("event_type") == "purchase") | (click & (F.col("ts") < lost))).select("user_id", "event_id", "ts")
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    fair = jobs.withColumn("k", k).join(tenant, "user_id").where(F.col("k") <= 5 - F.col("running"))
    return paging.numbered(fair, "turn", [F.col("k"), F.asc_nulls_first("served"), F.col("user_id"), F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "turn")


@query("SELECT user_id, event_id, CAST(least(5 * power(2, n - 1), 300) AS BIGINT) AS wait, n >= 3 AS fails FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'error')")
def st_retry(t: Tables) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = t.events.where("event_type = 'error'").select("user_id", "event_id", n.alias("n"))
    return rows.select("user_id", "event_id", F.least(F.lit(5) * F.pow(F.lit(2), F.col("n") - 1), F.lit(300)).cast("long").alias("wait"), (F.col("n") >= 3).alias("fails"))


@query("SELECT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS merged FROM events GROUP BY 1, 2, 3")
def st_due_sweep(t: Tables) -> DataFrame:
    """One notice a user, kind and day."""
    return t.events.groupBy("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("merged"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '3599.999999' SECOND PRECEDING AND CURRENT ROW) AS hits FROM events")
def st_sliding_log(t: Tables) -> DataFrame:
    """Hits of a user in the hour before each; a row exactly an hour back doesn't count."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy(at).rangeBetween(-3_599_999_999, 0)
    return t.events.select("event_id", F.count("*").over(w).alias("hits"))


@query()
def st_fixed_window(t: Tables) -> DataFrame:
    """Windows of a day that start at a user's first hit: the n-th hit of its window."""
    return state.first_hit_windows(t.events, "user_id", "ts", "event_id", 86_400)


@query("""
    WITH f AS (SELECT user_id, event_id, ts, event_type, CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS reset FROM events), g AS (SELECT *, sum(reset) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS spell FROM f),
    n AS (SELECT *, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, spell ORDER BY ts, event_id) AS BIGINT) AS failed FROM g)
    SELECT user_id, event_id, failed % 2 AS failed, failed > 0 AND failed % 2 = 0 AS locked FROM n WHERE event_type = 'error'""")
def st_lockout(t: Tables) -> DataFrame:
    """Failures since the last success; at two the count starts anew and the user is locked out."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = t.events.withColumn("spell", F.sum((F.col("event_type") != "error").cast("int")).over(w)).where("event_type = 'error'")
    n = F.row_number().over(Window.partitionBy("user_id", "spell").orderBy("ts", "event_id"))
    return rows.select("user_id", "event_id", n.cast("long").alias("n")).select("user_id", "event_id", (F.col("n") % 2).alias("failed"), (F.col("n") % 2 == 0).alias("locked"))


@query("SELECT user_id, event_type, min(event_id) AS job FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2")
def st_enqueue(t: Tables) -> DataFrame:
    """A job a key, unless one is waiting already."""
    return t.events.where(F.col("event_type").isin("click", "view")).groupBy("user_id", "event_type").agg(F.min("event_id").alias("job"))


@query("SELECT user_id, event_id, ts_next IS NULL OR ts_next > ts + INTERVAL 6 HOUR AS expired FROM (SELECT user_id, event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ts_next FROM events)")
def st_lease(t: Tables) -> DataFrame:
    """A lease of six hours expires unless the next heartbeat comes in time."""
    nxt = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = t.events.select("user_id", "event_id", "ts", nxt.alias("nxt"))
    return rows.select("user_id", "event_id", (F.col("nxt").isNull() | (F.col("nxt") > F.col("ts") + F.expr("interval 6 hours"))).alias("expired"))


@query("SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M') AS last_seen, count(*) AS events FROM events GROUP BY 1")
def st_audit(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm").alias("last_seen"), F.count("*").alias("events"))


@query("SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM documents x WHERE sha256(x.text) = sha256(d.text) AND x.doc_id < d.doc_id)")
def st_dup_upload(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", F.sha2("text", 256).alias("h"))
    first = d.groupBy("h").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    return d.join(first, "h").where("doc_id > first").select("doc_id")


@query("SELECT o_custkey, count(*) AS waiting FROM orders WHERE o_orderstatus = 'O' GROUP BY 1 HAVING count(*) >= 6")
def st_quota(t: Tables) -> DataFrame:
    return t.orders.where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.count("*").alias("waiting")).where("waiting >= 6")


@query(f"SELECT o_orderstatus, count(*) AS ready FROM orders WHERE o_orderdate <= DATE '{TODAY}' - INTERVAL 30 DAY GROUP BY 1")
def st_periodic(t: Tables) -> DataFrame:
    return t.orders.where(F.col("o_orderdate") <= F.date_sub(F.lit(TODAY), 30)).groupBy("o_orderstatus").agg(F.count("*").alias("ready"))


def _edges(t: Tables) -> DataFrame:
    """Suppliers and the parts they sent fifty of."""
    return t.lineitem.where("l_quantity = 50").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("target")).distinct()


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'png' ELSE 'refused' END AS kind FROM pages")
def src_media_sniff(t: Tables) -> DataFrame:
    """Files by their first bytes; pages are PDF, JPEG and PNG files in turn, and HTML, which is refused."""
    n = F.col("page_id") % 4
    head = F.when(n == 0, F.unhex(F.lit("255044462D312E37"))).when(n == 1, F.unhex(F.lit("FFD8FFE0"))).when(n == 2, F.unhex(F.lit("89504E470D0A1A0A"))).otherwise(F.unhex(F.lit("")))
    return t.pages.select("page_id", F.coalesce(readers.media_kind(F.concat(head, F.col("html").cast("binary"))), F.lit("refused")).alias("kind"))


@query("SELECT doc_id, text FROM documents d JOIN labels USING (doc_id) WHERE quality = 1")
def src_jsonl_truth(t: Tables) -> DataFrame:
    manifest = t.documents.select("doc_id", "text").join(t.labels.select("doc_id", F.when(F.col("quality") == 1, "verified").otherwise("prefilled").alias("status")), "doc_id")
    return readers.verified_truth(manifest).select("doc_id", "text")


@query(f"""
    SELECT line, usn, name, CASE WHEN usn IS NULL OR usn = '' THEN 'roll number missing' WHEN name IS NULL OR name = '' THEN 'name missing' WHEN line > {readers.ROSTER_ROWS} + 1 THEN 'too many rows' WHEN first < line THEN 'same roll number as line ' || first END AS error
    FROM (SELECT *, min(line) OVER (PARTITION BY usn) AS first FROM (SELECT CAST(c_custkey + 1 AS BIGINT) AS line, upper(regexp_replace('u ' || c_nationkey || c_mktsegment, '\\s+', '', 'g')) AS usn, trim(c_name) AS name FROM customer))""")
def src_csv_roster(t: Tables) -> DataFrame:
    lines = t.customer.select((F.col("c_custkey") + 1).alias("line"), F.concat(F.lit("u "), F.col("c_nationkey").cast("string"), F.col("c_mktsegment")).alias("usn"), F.col("c_name").alias("name"))
    return readers.roster(lines)


@query("SELECT doc_id, coalesce(quality, toxic) AS mark FROM documents JOIN labels USING (doc_id)")
def src_answer_set(t: Tables) -> DataFrame:
    answers = t.documents.join(t.labels, "doc_id", "left").select(F.col("doc_id").alias("id"), F.lit("q").alias("question"), F.col("toxic").alias("teacher_mark"))
    marks = t.labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("mark"))
    questions = t.spark.createDataFrame([("q", 1)], "code string, max_marks int")
    return readers.answer_set(answers, marks, questions).select(F.col("id").alias("doc_id"), "mark")


@query("SELECT l_orderkey, CAST(sum(CASE WHEN i = n - 1 THEN 1000 - (1000 // n) * (n - 1) ELSE 1000 // n END) AS BIGINT) AS total, CAST(max(CASE WHEN i = n - 1 THEN 1000 - (1000 // n) * (n - 1) ELSE 1000 // n END) AS BIGINT) AS largest FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) GROUP BY 1")
def src_weight_split(t: Tables) -> DataFrame:
    lines = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n")).select("l_orderkey", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    part = readers.split_weight(F.lit(1000), F.col("n"), F.col("i")).cast("long")
    return lines.groupBy("l_orderkey").agg(F.sum(part).alias("total"), F.max(part).alias("largest"))


@query("SELECT w FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w  FROM conversations) WHERE w IN (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) FROM benchmark)")
def src_word_list(t: Tables) -> DataFrame:
    split = lambda df: df.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("w")).distinct()
    return readers.known_words(split(t.conversations), split(t.benchmark))


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 4 ORDER BY c_custkey")
def src_table(t: Tables) -> DataFrame:
    return t.customer.where("c_nationkey = 4").select("c_custkey", "c_name").orderBy("c_custkey")


@query("SELECT l_orderkey, l_returnflag, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS segments FROM lineitem GROUP BY 1, 2")
def seg_answers(t: Tables) -> DataFrame:
    parts = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"].cast("string"))
    return t.lineitem.groupBy("l_orderkey", "l_returnflag").agg(F.array_join(parts, ",").alias("segments"))


@query("WITH p AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'R'), q AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'A') SELECT (SELECT count(*) FROM p) AS predicted, (SELECT count(*) FROM q) AS truth, (SELECT count(*) FROM p JOIN q USING (l_orderkey, l_linenumber)) AS correct")
def seg_summarise(t: Tables) -> DataFrame:
    """Predicted, true and correct starts from one aggregate."""
    s = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.bool_or(F.col("l_returnflag") != "R").alias("p"), F.bool_or(F.col("l_returnflag") != "A").alias("q"))
    return s.agg(F.count_if("p").alias("predicted"), F.count_if("q").alias("truth"), F.count_if(F.col("p") & F.col("q")).alias("correct"))


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'unlabelled' WHEN quality = toxic THEN 'disagree' ELSE 'agree' END AS opinion FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def sc_disagree(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels.withColumn("known", F.lit(True)), "doc_id", "left")
    return rows.select("doc_id", F.when(F.col("known").isNull(), "unlabelled").when(F.col("quality") == F.col("toxic"), "disagree").otherwise("agree").alias("opinion"))
