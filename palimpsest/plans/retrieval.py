"""Retrieval queries: benchmark items asked of the conversations' messages, and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text as tx
from ..functions.scalars import dot, normalized
from ..io import table
from ..operators import lexical, search, vectors
from ..operators import retrieval as rt
from .views import MESSAGES_SQL, VERSIONS_SQL, messages, versions

TOKENS_SQL = r"regexp_extract_all(lower({0}), '[a-z0-9_]+|[\x{{3400}}-\x{{9fff}}]')"
STOP_SQL = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
#: tf, df, lengths and query terms in SQL, over all messages and all benchmark items.
BM25_SQL = f"""{MESSAGES_SQL},
docs AS (SELECT message_id AS doc_id, {TOKENS_SQL.format("text")} AS toks FROM messages),
tf AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS token FROM docs) t GROUP BY 1, 2),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
st AS (SELECT count(*) AS n_docs, greatest(avg(len(toks)), 1.0) AS avgdl FROM docs),
q AS (SELECT item_id AS query_id, token, count(*) AS qf FROM (SELECT item_id, unnest({TOKENS_SQL.format("text")}) AS token FROM benchmark) t GROUP BY 1, 2),
bm AS (SELECT q.query_id, tf.doc_id, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(toks) / avgdl)) * (1 + ln(qf))) AS score,
  sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(toks) / avgdl))) AS plain
  FROM q JOIN df USING (token) JOIN tf USING (token) JOIN docs USING (doc_id), st GROUP BY 1, 2),
bmr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bm)"""
#: Keyword route: the item's first four words as phrase, the item's tokens as query tokens.
KEYWORD_SQL = f"""kq AS (SELECT item_id AS query_id, lower(regexp_extract(text, '^\\w+ \\w+')) AS phrase, list_distinct({TOKENS_SQL.format("text")}) AS qt FROM benchmark),
kd AS (SELECT doc_id, list_distinct(toks) AS dt, lower(text) AS low FROM docs JOIN messages ON message_id = doc_id),
kw AS (SELECT query_id, doc_id, CASE WHEN phrase <> '' AND contains(low, phrase) THEN 2.5 ELSE 0.0 END + len(list_intersect(qt, dt)) / greatest(len(qt), 1) AS score FROM kq, kd),
kwr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM kw WHERE score > 0)"""


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select(F.lit(0).alias("scope"), F.col("message_id").alias("doc_id"), "conv_id", "text", tx.simple_tokens(F.col("text")).alias("toks"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.lit(0).alias("scope"), F.col("item_id").alias("query_id"), "text", tx.simple_tokens(F.col("text")).alias("qt"))


def _bm25(spark: SparkSession, sf_dir: str, distinct_query: bool = False) -> DataFrame:
    return rt.bm25(_docs(spark, sf_dir), _items(spark, sf_dir), F.col("toks"), F.col("qt"), distinct_query)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns, F.round("score", 6).alias("score"))


@query("bm25_topk", f"WITH {BM25_SQL} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM bmr WHERE rank <= 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best messages of every item."""
    return _rounded(lexical.top_k(_docs(spark, sf_dir), _items(spark, sf_dir), F.col("toks"), F.col("qt"), 10), "query_id", "doc_id", "rank")


@query(
    "bm25_bounded",
    f"WITH {BM25_SQL}, qn AS (SELECT query_id, count(*) AS n FROM q GROUP BY 1), s AS (SELECT query_id, doc_id, 1 - exp(-plain / greatest(n, 1)) AS score FROM bm JOIN qn USING (query_id)) "
    "SELECT query_id, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS n FROM s) t WHERE n <= 10",
)
def bm25_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores between 0 and 1 that compare across items; the ten best of each."""
    return _rounded(lexical.bounded_top_k(_docs(spark, sf_dir), _items(spark, sf_dir), F.col("toks"), F.col("qt"), 10), "query_id", "doc_id")


@query("bm25_rowmax", f"WITH {BM25_SQL} SELECT query_id, count(*) AS n, round(sum(s), 4) AS mass FROM (SELECT query_id, plain / greatest(max(plain) OVER (PARTITION BY query_id), 1e-12) AS s FROM bm) t GROUP BY query_id")
def bm25_rowmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.row_max_bm25(_bm25(spark, sf_dir, distinct_query=True)).groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("mass"))


@query(
    "tokenise_counts",
    f"SELECT token, count(*) AS n, count(DISTINCT conv_id) AS convs FROM (SELECT conv_id, unnest(list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+(?:[''_-][A-Za-z0-9]+)*|[\\x{{3400}}-\\x{{4dbf}}\\x{{4e00}}-\\x{{9fff}}]'), lambda x: lower(x)), lambda x: x NOT IN ({STOP_SQL}))) AS token FROM conversations) t GROUP BY token",
)
def tokenise_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "conversations").select("conv_id", F.explode(tx.lexical_tokens(F.col("text"))).alias("token"))
    return tokens.groupBy("token").agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("convs"))


def _keyword(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    phrase = F.lower(F.regexp_extract("text", r"^\w+ \w+", 0))  # ASCII words, as in the tokens
    asked = _items(spark, sf_dir).select("scope", "query_id", F.array_distinct("qt").alias("tokens"), F.filter(F.array(phrase), lambda p: p != "").alias("phrases"))
    held = _docs(spark, sf_dir).select("scope", "doc_id", "text", F.array_distinct("toks").alias("tokens"))
    return rt.ranked(search.keyword_best(held, asked, k), k, ["scope", "query_id"])


@query("keyword_route", f"WITH {BM25_SQL}, {KEYWORD_SQL} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM kwr WHERE rank <= 5")
def keyword_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_keyword(spark, sf_dir, 5), "query_id", "doc_id", "rank")


@query(
    "rrf_fusion",
    f"WITH {BM25_SQL}, {KEYWORD_SQL}, f AS (SELECT query_id, doc_id, 0.30 / (60 + rank) AS s, 'bm25' AS path FROM bmr WHERE rank <= 30 UNION ALL SELECT query_id, doc_id, 0.15 / (60 + rank), 'keyword' FROM kwr WHERE rank <= 30) "
    "SELECT query_id, doc_id, round(sum(s), 9) AS score, string_agg(path, ',' ORDER BY path) AS paths FROM f GROUP BY 1, 2",
)
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = lexical.top_k(_docs(spark, sf_dir), _items(spark, sf_dir), F.col("toks"), F.col("qt"), rt.CANDIDATES)
    exact = _keyword(spark, sf_dir, rt.CANDIDATES)
    found = rt.fused([("bm25", words, rt.WEIGHTS["bm25"]), ("keyword", exact, rt.WEIGHTS["keyword"])])
    return found.select("query_id", "doc_id", F.round("score", 9).alias("score"), F.array_join("matched_paths", ",").alias("paths"))


TIMES_SQL = f"""{VERSIONS_SQL}, w AS (SELECT version_id, system_to, strftime(ts, '%Y-%m-%d') AS ws, CASE WHEN version_id % 4 = 0 THEN NULL ELSE strftime(ts + INTERVAL 3 DAY, '%Y-%m-%d') END AS we FROM versions),
modes AS (SELECT * FROM (VALUES ('none', NULL, NULL), ('current', NULL, NULL), ('point', '2024-01-10', NULL), ('before', '2024-01-10', NULL), ('after', '2024-01-10', NULL), ('range', '2024-01-08', '2024-01'), ('point', NULL, NULL)) t(mode, target, target_end)),
v AS (SELECT mode, target, version_id, CASE WHEN mode = 'none' THEN true WHEN mode = 'current' THEN system_to IS NULL WHEN coalesce(target, '') = '' THEN true WHEN mode = 'point' THEN ws <= target AND target < coalesce(we, 'z')
  WHEN mode = 'before' THEN ws < target WHEN mode = 'after' THEN ws >= target ELSE ws <= coalesce(target_end, target) AND coalesce(we, 'z') >= target END AS valid FROM w, modes)"""


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.when(F.col("version_id") % 4 == 0, F.lit(None)).otherwise(F.date_format(F.col("ts") + F.expr("INTERVAL 3 DAYS"), "yyyy-MM-dd"))
    w = versions(spark, sf_dir).select("version_id", "system_to", F.date_format("ts", "yyyy-MM-dd").alias("ws"), end.alias("we"))
    modes = [("none", None, None), ("current", None, None), ("point", "2024-01-10", None), ("before", "2024-01-10", None), ("after", "2024-01-10", None), ("range", "2024-01-08", "2024-01"), ("point", None, None)]
    asked = spark.createDataFrame(modes, "mode string, target string, target_end string")
    args = (F.col("mode"), F.col("target"), F.col("target_end"), F.col("ws"), F.col("we"), F.col("system_to").isNull())
    return w.join(F.broadcast(asked)).withColumns({"valid": rt.time_valid(*args), "score": rt.time_score(*args)})


@query("time_validity_modes", f"WITH {TIMES_SQL} SELECT mode, target, count(*) AS n, count(*) FILTER (WHERE valid) AS valid FROM v GROUP BY 1, 2")
def time_validity_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _timed(spark, sf_dir).groupBy("mode", "target").agg(F.count("*").alias("n"), F.count_if("valid").alias("valid"))


@query(
    "structured_route",
    f"WITH {TIMES_SQL} SELECT mode, target, version_id, round(CASE WHEN version_id % 3 = 0 THEN 1.0 WHEN version_id % 3 = 1 THEN 0.8 ELSE 0.0 END + CASE WHEN mode = 'none' THEN 0 WHEN mode = 'current' THEN CASE WHEN valid THEN 1 ELSE 0 END WHEN coalesce(target, '') = '' THEN 0.1 "
    "WHEN mode IN ('point', 'range') THEN CASE WHEN valid THEN 1 ELSE 0 END ELSE CASE WHEN valid THEN 0.8 ELSE 0 END END, 6) AS score FROM v",
)
def structured_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity and time scores: an entity that is named, in the subject, or nowhere."""
    subject = F.when(F.col("version_id") % 3 == 1, "about Nuuk town").otherwise("nothing")
    named = F.when(F.col("version_id") % 3 == 0, F.array(F.lit("NUUK"))).otherwise(F.array(F.lit("other")))
    scored = _timed(spark, sf_dir).withColumn("entity", rt.entity_score(F.array(F.lit("Nuuk")), named, subject, F.lit("")))
    return scored.select("mode", "target", "version_id", F.round(F.col("entity") + F.col("score"), 6).alias("score"))


DOT_SQL = "pairs AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, list_sum(list_transform(list_zip(q.embedding, d.embedding), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))) AS score FROM embeddings q, embeddings d WHERE q.vec_id % 100 = 0)"


def _nearest(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    docs = v.select(F.lit(0).alias("scope"), F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("v"))
    asked = v.where("vec_id % 100 = 0").select(F.lit(0).alias("scope"), F.col("vec_id").alias("query_id"), F.lit(0).alias("part"), F.col("embedding").cast("array<double>").alias("v"))
    return search.semantic(docs, asked, k)


@query("dot_topk", f"WITH {DOT_SQL} SELECT query_id, doc_id, rank, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM pairs) t WHERE rank <= 10")
def dot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact vector search: every hundredth vector asks all."""
    return _nearest(spark, sf_dir, 10).select("query_id", "doc_id", "rank", F.round("score", 5).alias("score"))


@query(
    "multi_query_rrf",
    f"WITH {DOT_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM pairs) SELECT query_id // 200 AS question, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM r WHERE rank <= 30 GROUP BY 1, 2",
)
def multi_query_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two expansions of a question, each ranked, fused with weight 1."""
    top = _nearest(spark, sf_dir, rt.CANDIDATES)
    return rt.fused([("semantic:q", top.withColumn("query_id", F.floor(F.col("query_id") / 200)), 1.0)]).select(F.col("query_id").alias("question"), "doc_id", F.round("score", 9).alias("score"))


@query(
    "cosine_matrix_topk",
    "WITH c AS (SELECT label, vec_id, embedding FROM embeddings WHERE vec_id % 100 = 0), b AS (SELECT vec_id, embedding FROM embeddings), "
    "n AS (SELECT c.vec_id AS candidate_id, b.vec_id AS skill_id, list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s FROM c, b) "
    "SELECT candidate_id, skill_id, round(s, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY round(s, 9) DESC, skill_id) AS n FROM n) t WHERE n <= 3",
)
def cosine_matrix_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest bank entries of every candidate."""
    v = table(spark, sf_dir, "embeddings").select(F.lit(0).alias("scope"), "vec_id", normalized(F.col("embedding")).alias("v"))
    asked = v.where("vec_id % 100 = 0").select("scope", F.col("vec_id").alias("query_id"), F.lit(0).alias("part"), "v")
    found = vectors.nearest(v.withColumnRenamed("vec_id", "doc_id"), asked, 3)
    return found.select(F.col("query_id").alias("candidate_id"), F.col("doc_id").alias("skill_id"), F.round("score", 5).alias("score"))


@query(
    "jaccard_nearest",
    f"WITH {MESSAGES_SQL}, d AS (SELECT message_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS s FROM messages), q AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS s FROM benchmark), "
    "p AS (SELECT item_id, message_id, len(list_intersect(q.s, d.s)) AS i, len(q.s) + len(d.s) AS t FROM q, d) "
    "SELECT item_id, message_id, round(i / (t - i), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(i / (t - i), 9) DESC, message_id) AS n FROM p WHERE i / (t - i) >= 0.15) x WHERE n = 1",
)
def jaccard_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most similar message of every item by token sets, at 0.15 or more: shared tokens are counted by an equi-join."""
    sized = lambda df, key: df.select(key, F.explode("s").alias("token"), F.size("s").alias("n"))
    d = sized(messages(spark, sf_dir).select("message_id", tx.set_tokens(F.col("text")).alias("s")), "message_id")
    q = sized(table(spark, sf_dir, "benchmark").select("item_id", tx.set_tokens(F.col("text")).alias("s")), "item_id").withColumnRenamed("n", "nq")
    shared = q.join(d, "token").groupBy("item_id", "message_id").agg(F.count("*").alias("i"), (F.first("n") + F.first("nq")).alias("t"))
    scored = shared.select("item_id", "message_id", (F.col("i") / (F.col("t") - F.col("i"))).alias("score")).where("score >= 0.15")
    return rt.ranked(scored, 1, ["item_id"], key="message_id").select("item_id", "message_id", F.round("score", 6).alias("score"))


@query(
    "hash_embedding",
    "WITH t AS (SELECT item_id, sha256(unnest(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r]+'), lambda x: x <> ''))) AS h FROM benchmark), "
    "x AS (SELECT item_id, CAST(('0x' || substr(h, 1, 8)) AS BIGINT) % 384 AS idx, sum(CASE WHEN CAST(('0x' || substr(h, 9, 2)) AS BIGINT) % 2 = 0 THEN 1.0 ELSE -1.0 END) AS x FROM t GROUP BY 1, 2) "
    "SELECT item_id, idx, round(x / sqrt(sum(x * x) OVER (PARTITION BY item_id)), 6) AS value FROM x WHERE x <> 0",
)
def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.array_remove(F.split(F.lower("text"), r"[ \t\n\r]+"), "")
    return rt.hash_embedding(table(spark, sf_dir, "benchmark"), tokens, "item_id").select("item_id", "idx", F.round("value", 6).alias("value"))


@query(
    "query_profile",
    f"""WITH t AS (SELECT item_id, list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)), lambda x: x NOT IN ({STOP_SQL})) AS k, regexp_extract_all(text, '\\b[A-Z][A-Za-z0-9''-]+') AS e FROM benchmark)
SELECT item_id, array_to_string(list_slice(list_filter(k, lambda x, i: list_position(k, x) = i), 1, 12), ' ') AS keywords, array_to_string(list_slice(list_filter(e, lambda x, i: list_position(e, x) = i), 1, 8), ' ') AS entities FROM t""",
)
def query_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twelve distinct keywords and eight capitalised words of every item, in order."""
    p = rt.query_profile(F.col("text"), tx.STOP_WORDS, "[A-Za-z0-9]+")
    return table(spark, sf_dir, "benchmark").select("item_id", p.alias("p")).select("item_id", F.array_join("p.keywords", " ").alias("keywords"), F.array_join("p.entities", " ").alias("entities"))


@query(
    "strategy_depth",
    "SELECT event_id, CASE event_type WHEN 'click' THEN 'semantic' WHEN 'view' THEN 'bm25' WHEN 'error' THEN 'keyword' ELSE 'hybrid' END AS strategy, least(3, greatest(1, event_id % 7)) AS depth, least(24, greatest(1, event_id % 40)) AS top_k FROM events",
)
def strategy_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.when(F.col("event_type") == "click", "vector").when(F.col("event_type") == "view", " BM25 ").when(F.col("event_type") == "error", "exact").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select(
        "event_id", rt.strategy(asked).alias("strategy"), rt.depth((F.col("event_id") % 7).cast("string")).alias("depth"), rt.top_k(F.col("event_id") % 40).alias("top_k")
    )


@query(
    "source_route",
    f"WITH {BM25_SQL}, cited AS (SELECT DISTINCT conv_id FROM conversations WHERE role = 'system'), free AS (SELECT doc_id FROM docs WHERE doc_id // 1000 NOT IN (SELECT conv_id FROM cited)), "
    "d2 AS (SELECT * FROM docs WHERE doc_id IN (SELECT doc_id FROM free)), tf2 AS (SELECT * FROM tf WHERE doc_id IN (SELECT doc_id FROM free)), df2 AS (SELECT token, count(*) AS df FROM tf2 GROUP BY 1), st2 AS (SELECT count(*) AS n_docs, greatest(avg(len(toks)), 1.0) AS avgdl FROM d2), "
    "b AS (SELECT q.query_id, doc_id, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(toks) / avgdl)) * (1 + ln(qf))) AS score FROM q JOIN df2 USING (token) JOIN tf2 USING (token) JOIN d2 USING (doc_id), st2 GROUP BY 1, 2) "
    "SELECT query_id, 'source:' || CAST(doc_id AS VARCHAR) AS evidence_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM b) t WHERE rank <= 3",
)
def source_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 over the messages that no memory covers; the filter comes before the statistics."""
    covered = table(spark, sf_dir, "conversations").where("role = 'system'").select("conv_id")
    free = _docs(spark, sf_dir).join(covered, "conv_id", "left_anti")
    top = lexical.top_k(free, _items(spark, sf_dir), F.col("toks"), F.col("qt"), 3)
    return top.select("query_id", F.concat(F.lit("source:"), F.col("doc_id").cast("string")).alias("evidence_id"), "rank", F.round("score", 6).alias("score"))


@query(
    "kind_filtered_search",
    rf"""WITH {MESSAGES_SQL}, d AS (SELECT message_id AS doc_id, role, {TOKENS_SQL.format("text")} AS toks FROM messages), w AS (SELECT * FROM (VALUES (0, ['user']), (1, ['assistant', 'system']), (2, ['user', 'assistant', 'system'])) t(k, roles)),
dk AS (SELECT k, doc_id, toks FROM d JOIN w ON list_contains(roles, role)), st AS (SELECT k, count(*) AS n_docs, greatest(avg(len(toks)), 1.0) AS avgdl FROM dk GROUP BY k),
tf AS (SELECT k, doc_id, token, count(*) AS tf FROM (SELECT k, doc_id, unnest(toks) AS token FROM dk) t GROUP BY 1, 2, 3), df AS (SELECT k, token, count(*) AS df FROM tf GROUP BY 1, 2),
q AS (SELECT item_id % 3 AS k, item_id AS query_id, token, count(*) AS qf FROM (SELECT item_id, unnest({TOKENS_SQL.format("text")}) AS token FROM benchmark) t GROUP BY 1, 2, 3),
b AS (SELECT q.query_id, tf.doc_id, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * (1 + ln(qf)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(toks) / avgdl))) AS score FROM q JOIN df USING (k, token) JOIN tf USING (k, token) JOIN dk ON dk.k = tf.k AND dk.doc_id = tf.doc_id JOIN st ON st.k = tf.k GROUP BY 1, 2)
SELECT query_id, doc_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM b) t WHERE rank <= 5""",
)
def kind_filtered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item asks the messages of some roles only; the filter comes before the statistics."""
    kinds = F.when(F.col("query_id") % 3 == 0, F.array(F.lit("user"))).when(F.col("query_id") % 3 == 1, F.array(F.lit("system"), F.lit("assistant")))
    role = messages(spark, sf_dir).select(F.col("message_id").alias("doc_id"), F.col("role").alias("kind"))
    docs, asked = rt.scoped_by_kinds(_docs(spark, sf_dir).join(role, "doc_id"), _items(spark, sf_dir).withColumn("kinds", kinds))
    return _rounded(lexical.top_k(docs, asked, F.col("toks"), F.col("qt"), 5), "query_id", "doc_id", "rank")


@query("dot_self_check", "SELECT vec_id, label, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 5) AS self FROM embeddings")
def dot_self_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's product with itself: 1 where it is normalised."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.round(dot(F.col("embedding"), F.col("embedding")), 5).alias("self"))
