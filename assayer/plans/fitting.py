"""Fitting queries: similarity is event value / 30, the mark is the event type's place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.operators import fitting
from assayer.registry import Tables, query

SQL_F = "f AS (SELECT event_id, user_id, CAST(least(1000, round(value * 30)) AS INTEGER) AS sim, CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 AS mark FROM events)"


def _features(t: Tables) -> DataFrame:
    """sim in thousandths, mark from 0 to 4."""
    return t.events.select("event_id", "user_id", F.least(F.lit(1000), F.round(F.col("value") * 30)).cast("int").alias("sim"), (F.get_json_object("props", "$.k").cast("int") % 5).alias("mark"))


def _grid_errors(t: Tables) -> DataFrame:
    """Sums of errors by pair of the grid and third: features are counted by (sim, mark) before they meet the grid, so what is multiplied does not grow with the rows."""
    cells = _features(t).groupBy("sim", "mark").agg(F.count("*").alias("n"))
    rows = cells.crossJoin(F.broadcast(fitting.band_grid(t.spark, 100)))
    credit = F.when(F.col("sim") >= F.col("whole"), 4).when(F.col("sim") >= F.col("half"), 2).otherwise(0)
    third = F.when(F.col("mark") < 2, 0).when(F.col("mark") < 4, 1).otherwise(2)
    return rows.groupBy("half", "whole", third.alias("third")).agg((F.sum(F.abs(credit - F.col("mark")) * F.col("n")) / F.sum("n")).alias("mae"))


@query(f"""
    WITH {SQL_F}, g AS (SELECT h AS half, u AS whole FROM (SELECT unnest(range(0, 901, 100)) AS h), (SELECT unnest(range(100, 976, 100)) AS u) WHERE u > h),
    e AS (SELECT half, whole, CASE WHEN mark < 2 THEN 0 WHEN mark < 4 THEN 1 ELSE 2 END AS third, avg(abs((CASE WHEN sim >= whole THEN 4 WHEN sim >= half THEN 2 ELSE 0 END) - mark)) AS mae FROM f, g GROUP BY 1, 2, 3)
    SELECT CAST(half AS INTEGER) AS half, CAST(whole AS INTEGER) AS whole, round(avg(mae), 6) AS balanced FROM e GROUP BY 1, 2""")
def fit_balanced_mae(t: Tables) -> DataFrame:
    return _grid_errors(t).groupBy("half", "whole").agg(F.round(F.avg("mae"), 6).alias("balanced"))


@query(f"""
    WITH {SQL_F}, g AS (SELECT h AS half, u AS whole FROM (SELECT unnest(range(0, 901, 100)) AS h), (SELECT unnest(range(100, 976, 100)) AS u) WHERE u > h),
    e AS (SELECT half, whole, CASE WHEN mark < 2 THEN 0 WHEN mark < 4 THEN 1 ELSE 2 END AS third, avg(abs((CASE WHEN sim >= whole THEN 4 WHEN sim >= half THEN 2 ELSE 0 END) - mark)) AS mae FROM f, g GROUP BY 1, 2, 3)
    SELECT CAST(half AS INTEGER) AS half, CAST(whole AS INTEGER) AS whole, round(avg(mae), 6) AS balanced FROM e GROUP BY 1, 2 ORDER BY round(avg(mae), 12), half, whole LIMIT 1""")
def fit_grid_bands(t: Tables) -> DataFrame:
    b = _grid_errors(t).groupBy("half", "whole").agg(F.avg("mae").alias("balanced"))
    return fitting.first_best(b, [], "balanced", "half", "whole").select("half", "whole", F.round("balanced", 6).alias("balanced"))


@query(f"WITH {SQL_F} SELECT CAST(c AS INTEGER) AS tenths, round(avg(abs(c * 0.4 - mark)), 6) AS mae FROM f, (SELECT unnest(range(0, 11)) AS c) GROUP BY 1 ORDER BY round(avg(abs(c * 0.4 - mark)), 9), tenths LIMIT 1")
def fit_constant(t: Tables) -> DataFrame:
    cells = _features(t).groupBy("mark").agg(F.count("*").alias("n")).withColumn("tenths", F.explode(F.sequence(F.lit(0), F.lit(10))))
    e = cells.groupBy("tenths").agg((F.sum(F.abs(F.col("tenths") * 0.4 - F.col("mark")) * F.col("n")) / F.sum("n")).alias("mae"))
    return e.orderBy(F.round("mae", 9), "tenths").limit(1).select("tenths", F.round("mae", 6).alias("mae"))


@query(f"""
    WITH {SQL_F}, k AS (SELECT user_id, (row_number() OVER (ORDER BY user_id) - 1) % 5 AS fold FROM (SELECT DISTINCT user_id FROM f)), x AS (SELECT f.*, fold FROM f JOIN k USING (user_id)),
    m AS (SELECT o.fold, sum(x.mark) AS s, count(*) AS n FROM x JOIN (SELECT DISTINCT fold FROM k) o ON o.fold <> x.fold GROUP BY 1)
    SELECT CAST(x.fold AS INTEGER) AS fold, round(avg(abs(x.mark - s / n)), 6) AS mae, count(*) AS answers FROM x JOIN m USING (fold) GROUP BY 1""")
def fit_cv(t: Tables) -> DataFrame:
    """Each fold's error under the mean of the others: sums of all less its own."""
    f = _features(t)
    folds = fitting.ranked(f.select("user_id").distinct(), "user_id", "place").select("user_id", ((F.col("place") - 1).cast("int") % 5).alias("fold"))
    cells = f.join(folds, "user_id").groupBy("fold", "mark").agg(F.count("*").alias("n"))
    own = cells.groupBy("fold").agg(F.sum(F.col("mark") * F.col("n")).alias("s"), F.sum("n").alias("m"))
    total = own.agg(F.sum("s").alias("all_s"), F.sum("m").alias("all_m"))
    mean = own.crossJoin(F.broadcast(total)).select("fold", ((F.col("all_s") - F.col("s")) / (F.col("all_m") - F.col("m"))).alias("mean"))
    return cells.join(mean, "fold").groupBy("fold").agg(F.round(F.sum(F.abs(F.col("mark") - F.col("mean")) * F.col("n")) / F.sum("n"), 6).alias("mae"), F.sum("n").alias("answers"))


@query("""
    WITH x AS (SELECT n_chars AS a, quality AS b FROM documents JOIN labels USING (doc_id)), r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM x)
    SELECT round(coalesce(corr(ra, rb), 0), 6) AS spearman FROM r""")
def fit_spearman(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels, "doc_id").select("n_chars", "quality")
    return fitting.spearman(rows, "n_chars", "quality").select(F.round("spearman", 6).alias("spearman"))


#: Answers' features, in SQL that both engines read: k is the event's number. Two criteria of fixed credit (a list's share of three, a number within 5 of 10), one by similarity, worth two marks of four; similarity and relevance in thousandths.
FEATURES = {
    "question": "CAST(user_id % 20 AS INTEGER)", "mark": "CAST(k % 5 AS INTEGER)", "sim": "CAST(least(1000, round(value * 30)) AS INTEGER)",
    "listed": "CASE k % 4 WHEN 0 THEN 0e0 WHEN 1 THEN 0.3333e0 WHEN 2 THEN 0.6667e0 ELSE 1e0 END", "counted": "CASE WHEN abs(value - 10) <= 5 THEN 1e0 ELSE 0e0 END", "relevance": "CASE WHEN event_id % 50 <> 0 THEN CAST(event_id * 37 % 1000 AS INTEGER) END",
    "contradicting": "event_type = 'error' AND event_id % 3 = 0", "unfamiliar": "event_id % 9 = 0", "words": "CAST(event_id % 40 AS INTEGER)",
}
SQL_A = "a AS (SELECT event_id, " + ", ".join(f"{v} AS {k}" for k, v in FEATURES.items()) + " FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"
#: The bands and limits that an answer is marked and flagged with before they are fitted.
HALF, WHOLE, MARGIN, RELEVANCE, SOFT, BLANK = 450, 650, 50, 250, 400, 3
ERROR = "abs(round((listed + counted + {credit}) / 0.5e0) * 0.5e0 - mark)"
BAND = f"CASE WHEN sim >= {WHOLE} THEN 2e0 WHEN sim >= {HALF} THEN 1e0 ELSE 0e0 END"
THIRD = "CASE WHEN mark < 2 THEN 0 WHEN mark < 4 THEN 1 ELSE 2 END"
DISTANCE = f"least(abs(sim - {HALF}), abs(sim - {WHOLE}))"
ALWAYS = "words < {blank} OR contradicting OR coalesce(relevance < {low}, false) OR coalesce(unfamiliar AND relevance < {soft}, false)"
MODELS = {"trigram": "sim", "shifted": "CAST(least(1000, sim + 100) AS INTEGER)", "noisy": "CAST((sim * 7 + event_id * 13) % 1001 AS INTEGER)"}


def answers(t: Tables) -> DataFrame:
    """A row of features an answer."""
    rows = t.events.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return rows.select("event_id", *(F.expr(v).alias(k) for k, v in FEATURES.items()))


@query(f"WITH {SQL_A} SELECT event_id, question, mark, 4.0 AS max_marks, round(listed + counted, 4) AS fixed, sim / 1000.0 AS similarity, relevance / 1000.0 AS relevance, contradicting, unfamiliar, words FROM a".replace("4.0 AS", "4e0 AS").replace("1000.0", "1000e0"))
def fit_features(t: Tables) -> DataFrame:
    """Every answer's numbers, from which marks under any bands and flags under any limits follow."""
    rows = answers(t)
    return rows.select("event_id", "question", "mark", F.lit(4.0).alias("max_marks"), F.round(F.col("listed") + F.col("counted"), 4).alias("fixed"), (F.col("sim") / 1000).alias("similarity"), (F.col("relevance") / 1000).alias("relevance"), "contradicting", "unfamiliar", "words")


@query(f"""
    WITH {SQL_A}, x AS (SELECT *, {ERROR.format(credit=BAND)} AS miss, ({ALWAYS.format(blank=BLANK, low=RELEVANCE, soft=SOFT)}) OR {DISTANCE} < {MARGIN} AS flagged FROM a)
    SELECT CASE WHEN grouping(question) = 1 THEN 'all' ELSE CAST(question AS VARCHAR) END AS question, count(*) AS answers, 4e0 AS max_marks, round(avg(miss), 6) AS mae, round(avg(CASE WHEN miss <= 0.5 THEN 1e0 ELSE 0e0 END), 6) AS within_half, round(avg(CASE WHEN flagged THEN 1e0 ELSE 0e0 END), 6) AS flagged FROM x GROUP BY ROLLUP (question)""")
def fit_accuracy(t: Tables) -> DataFrame:
    """How far marks are off, by question and over all, with the share that is flagged."""
    x = answers(t).select("question", F.expr(ERROR.format(credit=BAND)).alias("miss"), F.expr(f"({ALWAYS.format(blank=BLANK, low=RELEVANCE, soft=SOFT)}) OR {DISTANCE} < {MARGIN}").alias("f"))
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    out = x.rollup("question").agg(F.grouping("question").alias("g"), F.count("*").alias("answers"), F.round(F.avg("miss"), 6).alias("mae"), share(F.col("miss") <= 0.5).alias("within_half"), share(F.col("f")).alias("flagged"))
    return out.select(F.when(F.col("g") == 1, "all").otherwise(F.col("question").cast("string")).alias("question"), "answers", F.lit(4.0).alias("max_marks"), "mae", "within_half", "flagged")


@query(f"""
    WITH {SQL_A}, v AS (SELECT list_sort(list(relevance)) AS v FROM a WHERE relevance IS NOT NULL AND words >= 1), h AS (SELECT low, greatest(low, soft) AS soft FROM (SELECT v[least(len(v) - 1, CAST(floor(0.02 * len(v)) AS BIGINT)) + 1] AS low, v[least(len(v) - 1, CAST(floor(0.1 * len(v)) AS BIGINT)) + 1] AS soft FROM v)),
    x AS (SELECT low, soft, {ERROR.format(credit=BAND)} > 0.5 AS disagree, {ALWAYS.format(blank=BLANK, low="low", soft="soft")} AS always, {DISTANCE} AS distance FROM a, h),
    m AS (SELECT low, soft, CAST(k * 10 AS INTEGER) AS margin, avg(CASE WHEN always OR distance < k * 10 THEN 1e0 ELSE 0e0 END) AS rate, sum(CASE WHEN disagree AND (always OR distance < k * 10) THEN 1e0 ELSE 0e0 END) / sum(CASE WHEN disagree THEN 1e0 ELSE 0e0 END) AS recall FROM x, (SELECT unnest(range(0, 11)) AS k) GROUP BY 1, 2, 3)
    SELECT low AS relevance_min, soft AS relevance_soft, margin, round(recall, 6) AS recall, round(rate, 6) AS rate FROM m WHERE rate <= 0.4 OR margin = {MARGIN} ORDER BY rate > 0.4, recall DESC, rate, margin <> {MARGIN}, margin LIMIT 1""")
def fit_flags(t: Tables) -> DataFrame:
    """Limits of relevance from low places of what genuine answers have, by counts of values; then the margin that catches most disagreements while four in ten are flagged at most."""
    a = answers(t)
    cells = a.where("relevance IS NOT NULL AND words >= 1").groupBy("relevance").agg(F.count("*").alias("n")).withColumn("one", F.lit(1))
    w = Window.partitionBy("one")  # a row a thousandth
    upto = cells.withColumn("upto", F.sum("n").over(w.orderBy("relevance"))).withColumn("total", F.sum("n").over(w))
    at = lambda p: F.min(F.when(F.col("upto") > F.least(F.col("total") - 1, F.floor(F.lit(p) * F.col("total"))), F.col("relevance")))
    limits = upto.agg(at(0.02).alias("low"), at(0.1).alias("soft")).select("low", F.greatest("low", "soft").alias("soft"))
    x = a.crossJoin(F.broadcast(limits)).select(F.expr(ERROR.format(credit=BAND) + " > 0.5").alias("disagree"), F.expr(ALWAYS.format(blank=BLANK, low="low", soft="soft")).alias("always"), F.expr(DISTANCE).alias("distance"))  # one row
    best = fitting.margin_search(x, MARGIN)
    return best.crossJoin(F.broadcast(limits)).select(F.col("low").alias("relevance_min"), F.col("soft").alias("relevance_soft"), F.col("margin").cast("int").alias("margin"), F.round("recall", 6).alias("recall"), F.round("rate", 6).alias("rate"))


@query(f"""
    WITH {SQL_A}, k AS (SELECT question, (row_number() OVER (ORDER BY question) - 1) % 5 AS fold FROM (SELECT DISTINCT question FROM a)), g AS (SELECT h AS half, u AS whole FROM (SELECT unnest(range(0, 901, 100)) AS h), (SELECT unnest(range(100, 976, 100)) AS u) WHERE u > h),
    s AS ({" UNION ALL ".join(f"SELECT '{m}' AS model, question, listed, counted, mark, {e} AS sim FROM a" for m, e in MODELS.items())}),
    c AS (SELECT model, fold, {THIRD} AS third, sim, sum({ERROR.format(credit="0e0")}) AS e0, sum({ERROR.format(credit="1e0")}) AS e1, sum({ERROR.format(credit="2e0")}) AS e2, count(*) AS n FROM s JOIN k USING (question) GROUP BY 1, 2, 3, 4),
    e AS (SELECT model, o.fold, half, whole, third, sum(CASE WHEN sim >= whole THEN e2 WHEN sim >= half THEN e1 ELSE e0 END) / sum(n) AS mae FROM c, g, (SELECT DISTINCT fold FROM k) o WHERE o.fold <> c.fold GROUP BY 1, 2, 3, 4, 5),
    b AS (SELECT model, fold, half, whole FROM (SELECT model, fold, half, whole, avg(mae) AS balanced FROM e GROUP BY 1, 2, 3, 4) QUALIFY row_number() OVER (PARTITION BY model, fold ORDER BY round(balanced, 12), half, whole) = 1),
    h AS (SELECT model, third, sum(CASE WHEN sim >= whole THEN e2 WHEN sim >= half THEN e1 ELSE e0 END) AS error, sum(n) AS n FROM c JOIN b USING (model, fold) GROUP BY 1, 2),
    v AS (SELECT model, avg(error / n) AS balanced, sum(error) / sum(n) AS mae FROM h GROUP BY 1),
    r AS (SELECT model, rank() OVER (PARTITION BY model ORDER BY sim) + (count(*) OVER (PARTITION BY model, sim) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY model ORDER BY mark) + (count(*) OVER (PARTITION BY model, mark) - 1) / 2.0 AS rb FROM s),
    p AS (SELECT model, coalesce(corr(ra, rb), 0) AS spearman FROM r GROUP BY 1)
    SELECT model, round(spearman, 6) AS spearman, round(balanced, 6) AS cv_balanced, round(mae, 6) AS cv_mae, CAST(row_number() OVER (ORDER BY round(balanced, 9), -round(spearman, 9), model) AS INTEGER) AS place FROM v JOIN p USING (model)""")
def fit_model_table(t: Tables) -> DataFrame:
    """Models of similarity by their cross-validated balanced error, then by rank correlation; folds are of questions."""
    a = answers(t)
    folds = fitting.ranked(a.select("question").distinct(), "question", "place").select("question", ((F.col("place") - 1).cast("int") % 5).alias("fold"))
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.expr(e).alias("sim")) for m, e in MODELS.items())))
    rows = a.select("question", "listed", "counted", "mark", each.alias("m")).select("question", "listed", "counted", "mark", "m.model", "m.sim")
    errors = rows.join(folds, "question").select("model", "fold", "sim", F.expr(THIRD).alias("third"), *(F.expr(ERROR.format(credit=f"{c}e0")).alias(f"e{c}") for c in range(3)))
    cv = fitting.cross_validated(fitting.band_cube(errors, ["model", "fold"], 100), ["model"], "fold", fitting.band_grid(t.spark, 100), 100)
    ranks = None
    for m in MODELS:
        one = fitting.spearman(rows.where(F.col("model") == m), "sim", "mark").withColumn("model", F.lit(m))
        ranks = one if ranks is None else ranks.unionByName(one)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.round("balanced", 9), -F.round("spearman", 9), "model"))  # a row a model
    return cv.join(ranks, "model").select("model", F.round("spearman", 6).alias("spearman"), F.round("balanced", 6).alias("cv_balanced"), F.round("mae", 6).alias("cv_mae"), place.cast("int").alias("place"))
