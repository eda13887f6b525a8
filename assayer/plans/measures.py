"""Text, array, JSON and vector queries over documents, conversations, pages and embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions import numbers, text, vectors
from assayer.registry import Tables, query

STOP = "[" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "]"
#: NFKC changes none of the tables' texts; of what they hold, case folding differs from lower case in sharp s only.
SQL_TOKENS = "regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[a-z0-9]+')"


@query(f"SELECT doc_id, CAST(len({SQL_TOKENS}) AS INTEGER) AS tokens, CAST(len(list_distinct({SQL_TOKENS})) AS INTEGER) AS distinct_tokens FROM documents")
def str_tokens(t: Tables) -> DataFrame:
    x = text.tokens(F.col("text"))
    return t.documents.select("doc_id", F.size(x).alias("tokens"), F.size(F.array_distinct(x)).alias("distinct_tokens"))


@query(f"SELECT doc_id, CAST(len(list_filter({SQL_TOKENS}, lambda x: NOT list_contains({STOP}, x))) AS INTEGER) AS content FROM documents")
def str_content_tokens(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(text.content_tokens(F.col("text"))).alias("content"))


@query(rf"SELECT doc_id, CAST(len(list_filter(regexp_extract_all(text, '\p{{L}}+(?:[''’-]\p{{L}}+)*'), lambda x: length(x) >= 2)) AS INTEGER) AS words FROM documents")
def str_words(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(text.words(F.col("text"))).alias("words"))


@query(f"SELECT doc_id, sha256(lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')))) AS h FROM documents")
def str_normalise_ocr(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2(text.flat(F.col("text")), 256).alias("h"))


SQL_LINE = "trim(regexp_replace(url, '[^A-Za-z0-9]+', ' ', 'g'))"
PAIRS = f"SELECT x.page_id, x.a, y.a AS b FROM (SELECT page_id, {SQL_LINE} AS a FROM pages) x JOIN (SELECT page_id, {SQL_LINE} AS a FROM pages) y ON y.page_id = x.page_id + 1"


def line_of(url: str = "url") -> Column:
    """A page's address as a line of words."""
    return F.trim(F.regexp_replace(url, "[^A-Za-z0-9]+", " "))


def _pairs(t: Tables) -> DataFrame:
    """Each page's line with the next page's: two readings of a line."""
    after = t.pages.select((F.col("page_id") - 1).alias("page_id"), line_of().alias("b"))
    return t.pages.select("page_id", line_of().alias("a")).join(after, "page_id")


def _sql_words(a: str, b: str) -> str:
    """Edit distance of word lists: a letter for each distinct word of the two."""
    spelled = lambda x: f"array_to_string(list_transform({x}, lambda w: chr(CAST(33 + list_position(k, w) AS INTEGER))), '')"
    return f"levenshtein({spelled(a)}, {spelled(b)})"


@query(f"SELECT page_id, CAST(levenshtein(a, b) AS INTEGER) AS distance, CAST({_sql_words('x', 'y')} AS INTEGER) AS word_edits FROM (SELECT *, list_distinct(list_concat(x, y)) AS k FROM (SELECT *, string_split(a, ' ') AS x, string_split(b, ' ') AS y FROM ({PAIRS})))")
def str_levenshtein(t: Tables) -> DataFrame:
    """Of the characters, and of the words."""
    return _pairs(t).select("page_id", F.levenshtein("a", "b").alias("distance"), text.list_edits(F.split("a", " "), F.split("b", " ")).alias("word_edits"))


@query(f"SELECT page_id, round(least(1.0, levenshtein(a, b) / length(b)), 6) AS cer FROM ({PAIRS})")
def str_cer(t: Tables) -> DataFrame:
    return _pairs(t).select("page_id", F.round(text.cer(F.col("a"), F.col("b")), 6).alias("cer"))


@query(f"SELECT page_id, round(levenshtein(a, b) / greatest(length(a), length(b)), 4) AS d FROM ({PAIRS})")
def str_norm_distance(t: Tables) -> DataFrame:
    return _pairs(t).select("page_id", F.round(text.norm_distance(F.col("a"), F.col("b")), 4).alias("d"))


@query("SELECT doc_id, sha256(replace(lower(text), 'ß', 'ss')) AS h FROM documents")
def str_normalise_scoring(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2(text.folded(F.col("text")), 256).alias("h"))


@query(f"SELECT w, CAST(CASE WHEN regexp_matches(w, '[0-9]') OR length(w) <= 3 THEN 0 WHEN length(w) <= 6 THEN 1 ELSE 2 END AS INTEGER) AS edits, count(*) AS n FROM (SELECT unnest({SQL_TOKENS}) AS w FROM documents) GROUP BY 1")
def str_allowed_edits(t: Tables) -> DataFrame:
    w = t.documents.select(F.explode(text.tokens(F.col("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return w.select("w", text.allowed_edits(F.col("w")).alias("edits"), "n")


@query(f"""
    WITH w AS (SELECT doc_id, unnest(list_distinct({SQL_TOKENS})) AS w FROM documents), v AS (SELECT DISTINCT unnest({SQL_TOKENS}) AS w FROM benchmark)
    SELECT d.doc_id, round(avg(CASE WHEN v.w IS NOT NULL THEN 1.0 WHEN w.w IS NOT NULL THEN 0.0 END), 6) AS fit FROM documents d LEFT JOIN w USING (doc_id) LEFT JOIN v ON v.w = w.w GROUP BY 1""")
def str_lexicon_fit(t: Tables) -> DataFrame:
    """The share of a document's distinct words that the vocabulary knows; null without words."""
    known = t.benchmark.select(F.explode(text.tokens(F.col("text"))).alias("w")).distinct().withColumn("known", F.lit(1.0))
    w = t.documents.select("doc_id", F.explode_outer(F.array_distinct(text.tokens(F.col("text")))).alias("w")).join(known, "w", "left")
    return w.groupBy("doc_id").agg(F.round(F.avg(F.when(F.col("w").isNotNull(), F.coalesce("known", F.lit(0.0)))), 6).alias("fit"))


@query(r"SELECT page_id, replace(replace(stem, '#', '.'), '?', '.') AS stem, ext, regexp_matches(stem, '^[0-9]{1,3}$') AS is_number FROM (SELECT page_id, regexp_replace(trim(l), '(.)\.[^.]*$', '\1') AS stem, lower(regexp_extract(l, '.(\.[^.]*)$', 1)) AS ext FROM (SELECT page_id, list_extract(string_split(url, '/'), -1) || CASE page_id % 3 WHEN 0 THEN '.PNG' WHEN 1 THEN '.tar.Gz' ELSE '' END AS l FROM pages))")
def str_file_stem(t: Tables) -> DataFrame:
    """A name's stem, its extension in lower case, and whether it is a roll number."""
    name = F.concat("url", F.when(F.col("page_id") % 3 == 0, ".PNG").when(F.col("page_id") % 3 == 1, ".tar.Gz").otherwise(""))
    rows = t.pages.select("page_id", text.file_stem(name).alias("stem"), text.extension(name).alias("ext"))
    return rows.select("page_id", F.translate("stem", "#?", "..").alias("stem"), "ext", F.col("stem").rlike("^[0-9]{1,3}$").alias("is_number"))


@query("SELECT c_custkey, upper(replace(c_name, ' ', '')) AS code FROM customer")
def str_canonical(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", text.canonical_code(F.col("c_name")).alias("code"))


@query("SELECT page_id, replace(replace(replace(url, '\\', '\\\\'), '%', '\\%'), '_', '\\_') AS escaped FROM pages")
def str_like_escape(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.like_escape(F.col("url")).alias("escaped"))


@query("SELECT doc_id, sha256(text) AS h FROM documents")
def str_sha256(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2("text", 256).alias("h"))


@query("SELECT doc_id, CASE WHEN length(l) > 120 THEN left(l, 119) || '…' ELSE l END AS first FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1] AS l FROM documents)")
def str_first_line(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.first_line(F.col("text")).alias("first"))


@query(f"SELECT conv_id, turn, sha256(regexp_replace(regexp_replace((turn + 1) || ') Ans: ' || text, '{text.ANSWER_LABEL}', ''), '{text.ANSWER_WORD}', '')) AS body FROM conversations")
def str_strip_label(t: Tables) -> DataFrame:
    labelled = F.concat((F.col("turn") + 1).cast("string"), F.lit(") Ans: "), "text")
    return t.conversations.select("conv_id", "turn", F.sha2(text.strip_label(labelled), 256).alias("body"))


@query("SELECT page_id, url FROM pages ORDER BY page_id")
def src_natural_key(t: Tables) -> DataFrame:
    return t.pages.orderBy(text.natural_key(F.col("url"))).select("page_id", "url")


@query("SELECT doc_id, CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'val' ELSE 'test' END AS part FROM (SELECT doc_id, CAST('0x' || left(sha256(CAST(doc_id AS VARCHAR)), 8) AS BIGINT) % 100 AS b FROM documents)")
def src_hash_split(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.hash_split(F.col("doc_id").cast("string")).alias("part"))


@query(f"""
    WITH x AS (SELECT doc_id, unnest(list_distinct({SQL_TOKENS})) AS w FROM documents), y AS (SELECT item_id, unnest(list_distinct({SQL_TOKENS})) AS w FROM benchmark),
    nx AS (SELECT doc_id, count(*) AS n FROM x GROUP BY 1), ny AS (SELECT item_id, count(*) AS m FROM y GROUP BY 1), p AS (SELECT doc_id, item_id, count(*) AS shared FROM x JOIN y USING (w) GROUP BY 1, 2 HAVING count(*) > 20)
    SELECT doc_id, item_id, round(shared / (n + m - shared), 6) AS jaccard FROM p JOIN nx USING (doc_id) JOIN ny USING (item_id)""")
def set_jaccard(t: Tables) -> DataFrame:
    """Pairs that share more than 20 tokens: a similarity join by prefixes, so a token that all documents hold is no key."""
    from assayer.operators import similarity

    d = t.documents.select(F.col("doc_id").alias("x"), F.array_distinct(text.tokens(F.col("text"))).alias("set"))
    b = t.benchmark.select(F.col("item_id").alias("y"), F.array_distinct(text.tokens(F.col("text"))).alias("set"))
    met = similarity.overlapping(d, b, 21)
    return met.select(F.col("x").alias("doc_id"), F.col("y").alias("item_id"), F.round(F.col("both") / (F.col("n_x") + F.col("n_y") - F.col("both")), 6).alias("jaccard"))


@query(f"SELECT DISTINCT w FROM (SELECT unnest({SQL_TOKENS}) AS w FROM benchmark UNION ALL SELECT unnest({SQL_TOKENS}) FROM conversations)")
def set_vocabulary(t: Tables) -> DataFrame:
    every = t.benchmark.select("text").union(t.conversations.select("text"))
    return every.select(F.explode(text.tokens(F.col("text"))).alias("w")).distinct()


@query(f"SELECT lower(w) AS folded, min_by(w, CAST(pos AS HUGEINT) * 10000000000 + doc_id) AS spelling FROM (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM documents)) GROUP BY 1")
def set_ordered_union(t: Tables) -> DataFrame:
    """Terms ignoring case, the first spelling kept."""
    w = t.documents.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1))).alias("at", "w"))
    return w.groupBy(F.lower("w").alias("folded")).agg(F.min_by("w", F.struct("at", "doc_id")).alias("spelling"))


@query(f"SELECT doc_id, CAST(ceil(len({SQL_TOKENS}) / 30.0) AS INTEGER) AS chunks, CAST(len({SQL_TOKENS}) % 30 AS INTEGER) AS rest FROM documents")
def arr_chunk(t: Tables) -> DataFrame:
    c = t.documents.select("doc_id", text.chunks(text.tokens(F.col("text"))).alias("c"))
    return c.select("doc_id", F.size("c").alias("chunks"), F.when(F.size("c") == 0, 0).otherwise(F.size(F.element_at("c", -1)) % 30).alias("rest"))


@query(f"SELECT doc_id, sha256(array_to_string(w, ' ')) AS firsts FROM (SELECT doc_id, list(w ORDER BY pos) AS w FROM (SELECT doc_id, w, min(pos) AS pos FROM (SELECT doc_id, unnest(x) AS w, generate_subscripts(x, 1) AS pos FROM (SELECT doc_id, {SQL_TOKENS} AS x FROM documents)) GROUP BY 1, 2) GROUP BY 1)")
def arr_dict_merge(t: Tables) -> DataFrame:
    x = F.array_distinct(text.tokens(F.col("text")))
    return t.documents.select("doc_id", F.array_join(x, " ").alias("firsts")).where("firsts <> ''").withColumn("firsts", F.sha2("firsts", 256))


@query(f"SELECT count(*) FILTER (list_contains({SQL_TOKENS}, 'the')) AS with_the, count(*) FILTER (len({SQL_TOKENS}) > 100) AS long FROM documents")
def arr_flags(t: Tables) -> DataFrame:
    x = t.documents.select(text.tokens(F.col("text")).alias("x"))
    return x.agg(F.count_if(F.array_contains("x", "the")).alias("with_the"), F.count_if(F.size("x") > 100).alias("long"))


@query(f"SELECT conv_id, turn, list_has_any({SQL_TOKENS}, ['idiot', 'moron', 'the']) AS overlaps FROM conversations")
def arr_disjoint(t: Tables) -> DataFrame:
    terms = F.array(*[F.lit(w) for w in ("idiot", "moron", "the")])
    return t.conversations.select("conv_id", "turn", F.arrays_overlap(text.tokens(F.col("text")), terms).alias("overlaps"))


@query("SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'numeric' WHEN event_type = 'click' THEN 'list' ELSE 'other' END AS kind, CASE WHEN event_type = 'purchase' THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS expected, CASE WHEN event_type = 'click' THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS required FROM events")
def jsn_params(t: Tables) -> DataFrame:
    """A tagged union: one struct with a branch for each type."""
    k = F.from_json("props", "k double")["k"]
    kind = F.col("event_type")
    return t.events.select("event_id", F.when(kind == "purchase", "numeric").when(kind == "click", "list").otherwise("other").alias("kind"), F.when(kind == "purchase", k).alias("expected"), F.when(kind == "click", k).alias("required"))


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(greatest(0, least(1, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 4) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 7")
def mth_cosine(t: Tables) -> DataFrame:
    b = t.embeddings.select((F.col("vec_id") - 7).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return t.embeddings.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")).join(b, "a").select("a", "b", F.round(vectors.cosine(F.col("x"), F.col("y")), 4).alias("cosine"))


CENTROIDS = "WITH e AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings), m AS (SELECT label, pos, avg(x) AS x FROM e GROUP BY 1, 2), c AS (SELECT label, list(x ORDER BY pos) AS centroid FROM m GROUP BY 1)"


def _to_centroids(t: Tables) -> DataFrame:
    c = vectors.centroids(t.embeddings, "label", "embedding").withColumnRenamed("label", "to_label")
    rows = t.embeddings.crossJoin(F.broadcast(c))  # a vector a label: ten rows on the right
    return rows.select("vec_id", "label", "to_label", F.round(vectors.cosine(F.col("embedding"), F.col("centroid")), 6).alias("similarity"))


@query(f"{CENTROIDS} SELECT label, round(avg(top), 3) AS relevance FROM (SELECT label, vec_id, list_avg(list_sort(list(s), 'DESC')[:3]) AS top FROM (SELECT e.label, vec_id, round(greatest(0, least(1, list_cosine_similarity(CAST(embedding AS DOUBLE[]), centroid))), 6) AS s FROM embeddings e, c) GROUP BY 1, 2) GROUP BY 1")
def emb_relevance(t: Tables) -> DataFrame:
    per = _to_centroids(t).groupBy("label", "vec_id").agg(vectors.top_mean(F.collect_list("similarity")).alias("top"))
    return per.groupBy("label").agg(F.round(F.avg("top"), 3).alias("relevance"))


@query(f"{CENTROIDS} SELECT vec_id, CASE WHEN s >= 0.4 THEN 1.0 WHEN s >= 0.25 THEN 0.5 ELSE 0.0 END AS credit FROM (SELECT vec_id, round(greatest(0, least(1, list_cosine_similarity(CAST(embedding AS DOUBLE[]), centroid))), 3) AS s FROM embeddings JOIN c USING (label))")
def sc_semantic(t: Tables) -> DataFrame:
    own = _to_centroids(t).where("label = to_label")
    return own.select("vec_id", numbers.band(F.round("similarity", 3), 0.25, 0.4).alias("credit"))


@query("""
    WITH s AS (SELECT conv_id, turn, role, sha256(text) AS h FROM conversations), a AS (SELECT conv_id, string_agg(h, ',' ORDER BY turn) AS now, count(*) AS n FROM s GROUP BY 1),
    b AS (SELECT conv_id, string_agg(h, ',' ORDER BY turn) AS before, count(*) AS m FROM s WHERE NOT (role = 'user' AND conv_id % 3 = 0) GROUP BY 1)
    SELECT conv_id, n AS vectors, coalesce(n = m AND now = before, false) AS reused FROM a LEFT JOIN b USING (conv_id)""")
def emb_cache(t: Tables) -> DataFrame:
    """Answers whose stored vectors are used again: as many as there are sentences, and every sentence's hash the same. Stored are those of an earlier reading, which had no questions in every third conversation."""
    s = t.conversations.select("conv_id", "turn", "role", F.sha2("text", 256).alias("h"))
    hashes = F.transform(F.array_sort(F.collect_list(F.struct("turn", "h"))), lambda x: x["h"])
    now = s.groupBy("conv_id").agg(hashes.alias("now"))
    before = s.where("NOT (role = 'user' AND conv_id % 3 = 0)").groupBy("conv_id").agg(hashes.alias("before"))
    return now.join(before, "conv_id", "left").select("conv_id", F.size("now").cast("long").alias("vectors"), F.coalesce(F.col("now") == F.col("before"), F.lit(False)).alias("reused"))


@query()
def emb_trigram(t: Tables) -> DataFrame:
    return vectors.trigram_slots(t.benchmark, "item_id", "text")
