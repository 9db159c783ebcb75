"""Skill-bank queries: routing gates, batch filling, clustering, transactional edits, publishing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text as tx
from ..io import table
from ..operators import skills as sk

_TOKENS = r"regexp_extract_all(lower({0}), '[a-z0-9_]+|[\x{{3400}}-\x{{9fff}}]')"
#: Scores of skills (suppliers) for queries (parts) from the order lines.
SCORES_SQL = "scores AS (SELECT l_partkey AS query_id, l_suppkey AS skill_id, max(l_discount * 10) AS score, max(l_quantity / 50) AS semantic FROM lineitem GROUP BY 1, 2)"


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_partkey").alias("query_id"), F.col("l_suppkey").alias("skill_id")).agg(F.max(F.col("l_discount") * 10).alias("score"), F.max(F.col("l_quantity") / 50).alias("semantic"))


@query(
    "skill_route_gates",
    f"WITH {SCORES_SQL}, r AS (SELECT *, row_number() OVER w AS rank FROM scores WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, skill_id)), second AS (SELECT query_id, score AS second FROM r WHERE rank = 2), "
    "p AS (SELECT r.*, second, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, skill_id) AS place FROM r LEFT JOIN second USING (query_id) WHERE score >= 0.3 AND semantic >= 0.4), "
    "best AS (SELECT query_id FROM p WHERE place = 1 AND (second IS NULL OR score - second >= 0.05)) "
    "SELECT query_id, skill_id, place AS rank, CASE WHEN place <= 2 THEN 'selected' ELSE 'nearby' END AS band FROM p WHERE query_id IN (SELECT query_id FROM best) AND place <= 5",
)
def skill_route_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sk.route(_scores(spark, sf_dir), top_k=2, disclose_k=3, min_score=0.3, min_semantic=0.4, margin=0.05)


BATCHES_SQL = "b AS (SELECT o_custkey % 40 AS batch_id, l_partkey AS candidate_id, l_suppkey AS skill_id, max(l_extendedprice) AS score FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2, 3)"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return lines.groupBy((F.col("o_custkey") % 40).alias("batch_id"), F.col("l_partkey").alias("candidate_id"), F.col("l_suppkey").alias("skill_id")).agg(F.max("l_extendedprice").alias("score"))


#: The guarantee that belongs to a bank of twelve.
GUARANTEED, BANK = 3, 12


@query(
    "batch_bank_fill",
    f"WITH {BATCHES_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY batch_id, candidate_id ORDER BY score DESC, skill_id) AS n FROM b), "
    f"best AS (SELECT batch_id, skill_id, bool_or(n <= {GUARANTEED}) AS sure, max(score) AS score FROM f GROUP BY 1, 2), "
    f"p AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY sure DESC, score DESC, skill_id) AS place FROM best) SELECT batch_id, skill_id, sure, place FROM p WHERE sure OR place <= {BANK}",
)
def batch_bank_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates of all batches, each sure of its best three skills."""
    return sk.batch_fill(_scored(spark, sf_dir), GUARANTEED, BANK)


KMEANS_SQL = """cent AS (SELECT label AS cluster, embedding AS c FROM embeddings JOIN (SELECT min(vec_id) AS vec_id FROM embeddings GROUP BY label) f USING (vec_id)),
s AS (SELECT e.vec_id AS point_id, cluster, round(list_sum(list_transform(list_zip(e.embedding, c), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))), 9) AS s FROM embeddings e, cent),
a AS (SELECT point_id, cluster FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY s DESC, cluster) AS n FROM s) t WHERE n = 1)"""


def _assigned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    points = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), F.col("embedding").alias("v"), "label")
    centroids = points.groupBy(F.col("label").alias("cluster")).agg(F.min_by("v", "point_id").alias("c"))
    return points.select("point_id", "v"), sk.assign(points.select("point_id", "v"), centroids)


@query("kmeans_assign", f"WITH {KMEANS_SQL} SELECT point_id, cluster FROM a")
def kmeans_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One assignment step; the first vector of each label is its centre."""
    return _assigned(spark, sf_dir)[1]


@query(
    "kmeans_update",
    f"WITH {KMEANS_SQL}, p AS (SELECT cluster, generate_subscripts(embedding, 1) - 1 AS idx, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings JOIN a ON point_id = vec_id), m AS (SELECT cluster, idx, avg(x) AS m FROM p GROUP BY 1, 2) "
    "SELECT cluster, CAST(idx AS INTEGER) AS idx, round(m / greatest(sqrt(sum(m * m) OVER (PARTITION BY cluster)), 1e-12), 6) AS value FROM m",
)
def kmeans_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, assigned = _assigned(spark, sf_dir)
    return sk.update(points, assigned).select("cluster", "idx", F.round("value", 6).alias("value"))


@query("bounded_clusters")
def bounded_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recursive bounded clustering, the label being a hard boundary (iterative; tests hold its invariants)."""
    points = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("bucket"), F.col("vec_id").alias("point_id"), F.col("embedding").alias("v"))
    return sk.cluster(points)


@query(
    "message_segments",
    r"""WITH RECURSIVE l AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS at_row, regexp_replace(coalesce(nullif(role, ''), 'unknown') || ': ' || text, '^\s+|\s+$', '', 'g') AS line FROM conversations WHERE trim(coalesce(text, '')) <> ''),
p AS (SELECT conv_id, at_row, line, sum(length(line) + 1) OVER (PARTITION BY conv_id ORDER BY at_row) AS upto FROM l),
n AS (SELECT a.conv_id, a.at_row, count(b.at_row) + 1 AS many FROM p a LEFT JOIN p b ON a.conv_id = b.conv_id AND b.at_row > a.at_row AND b.at_row < a.at_row + 4 AND b.upto - a.upto + length(a.line) + 1 <= 1400 GROUP BY 1, 2),
w AS (SELECT conv_id, 0 AS at_row, 0 AS segment FROM l GROUP BY 1 UNION ALL SELECT w.conv_id, w.at_row + n.many, w.segment + 1 FROM w JOIN n ON n.conv_id = w.conv_id AND n.at_row = w.at_row JOIN l ON l.conv_id = w.conv_id AND l.at_row = w.at_row + n.many)
SELECT w.conv_id AS conversation_id, w.segment, string_agg(line, chr(10) ORDER BY l.at_row) AS text FROM w JOIN n ON n.conv_id = w.conv_id AND n.at_row = w.at_row JOIN l ON l.conv_id = w.conv_id AND l.at_row >= w.at_row AND l.at_row < w.at_row + n.many GROUP BY 1, 2""",
)
def message_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy segments of the conversations."""
    said = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conversation_id"), "turn", F.col("role").alias("speaker"), F.col("text").alias("content"))
    return sk.segments(said)


@query("skill_crud")
def skill_crud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered edits of one bank per nation, all or none; the customers are its skills, each edited once (sequential within tied skills; a test holds it against a plain loop)."""
    who = table(spark, sf_dir, "customer")
    bank, key = F.col("c_nationkey").cast("string"), F.col("c_custkey")
    held = who.select(
        bank.alias("bank"), F.lit("access").alias("side"), F.col("c_name").alias("skill_id"), F.lit(1).alias("version"), F.lower("c_name").alias("name"), F.lit("Use when a place is asked for").alias("description"),
        F.array(F.lower("c_name"), F.lit("look twice")).alias("content"),
    )
    text, number = F.lit(None).cast("string"), F.lit(None).cast("double")
    kind = F.get(F.array(*[F.lit(x) for x in sk.OPERATIONS]), (key % 8).cast("int"))
    near = F.coalesce(F.lag("c_name").over(Window.partitionBy("c_nationkey").orderBy("c_custkey")), F.col("c_name"))
    edits = who.select(
        bank.alias("bank"), key.cast("int").alias("seq"), kind.alias("operation"), F.when(kind == "add_skill", F.concat(F.lit("new_"), "c_name")).otherwise(F.col("c_name")).alias("skill_id"),
        F.when(kind == "move_content", near).alias("target_skill_id"), F.when(kind == "add_skill", number).otherwise(F.lit(1.0)).alias("expected_version"),
        F.concat(F.lit("about "), "c_name").alias("name"), F.lit("Use before the answer is made").alias("description"), F.array(F.concat(F.lit("seen "), "c_name")).alias("content"), number.alias("content_index"),
        F.when(kind.isin("update_content", "delete_content", "move_content"), F.lit("look twice")).otherwise(text).alias("expected_content"), F.concat(F.lit("read "), "c_name").alias("new_content"),
    )
    return sk.apply_operations(held, edits)


@query(
    "publish_snapshot",
    "SELECT c_custkey AS skill_id, 'old' AS origin, 2 AS bank_version FROM customer WHERE c_custkey % 9 <> 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT DISTINCT o_custkey, 'staged', 2 FROM orders WHERE o_orderstatus = 'P'",
)
def publish_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("skill_id"), F.lit("old").alias("origin"))
    staged = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("skill_id"), F.lit("staged").alias("origin")).distinct()
    return sk.publish(customer, staged, customer.where("skill_id % 9 = 0").select("skill_id"), 2)


_RULES_SQL = [
    ("trim(name) = ''", "name is empty"), ("trim(description) = ''", "description is empty"), ("len(content) = 0", "content is empty"), ("length(name) > 60", "name too long"), ("length(description) > 200", "description too long"),
    ("length(txt) > 600", "content too long"), ("len(content) > 3", "too many items"), ("len(list_filter(content, lambda x: length(x) > 200)) > 0", "item too long"),
    (f"regexp_matches(combined, '{sk.SYSTEM_IDS}')", "system ids"),
    ("answer <> '' AND (len(list_filter(list_concat([name, description], content), lambda x: trim(regexp_replace(lower(x), '[^a-z0-9\\x{3400}-\\x{9fff}]+', ' ', 'g')) = trim(regexp_replace(answer, '[^a-z0-9\\x{3400}-\\x{9fff}]+', ' ', 'g')))) > 0 OR length(answer) > 3 AND regexp_matches(lower(combined), '"
     + sk.ORDERED_ANSWER + "' || regexp_escape(answer)))", "reference answer"),
    ("len(list_filter(entities, lambda e: length(e) > 3 AND contains(lower(combined), lower(e)))) > 0", "question entity"), ("len(list_filter(gold, lambda g: contains(combined, g))) > 0", "gold message id"),
    *[(f"contains(lower(txt), '{m}')", f"case narrative: {m}") for m in sk.NARRATIVE],
    ("NOT (" + " OR ".join(f"contains(lower(description), '{w}')" for w in sk.TRIGGERS) + ")", "no trigger wording"),
    ("side = 'construction' AND regexp_matches(combined, '" + sk.UNSUPPORTED_KIND.replace("'", "''") + "')", "unsupported memory kind"), (f"side = 'construction' AND regexp_matches(combined, '{sk.GUESSED_PLACE}')", "guessed place"),
    (f"side = 'construction' AND regexp_matches(combined, '{sk.STORAGE_MUTATION}')", "storage mutation"), (f"side = 'access' AND regexp_matches(combined, '{sk.AGENT_LOOP}')", "agent loop"),
    (f"side = 'access' AND regexp_matches(combined, '{sk.FIXED_RETRIEVAL}')", "fixed retrieval"), (f"side = 'access' AND regexp_matches(combined, '{sk.EVIDENCE_BYPASS}')", "evidence bypass"),
]
PAYLOAD_SQL = r"""pay AS (SELECT doc_id, coalesce(regexp_extract(text, '^[^\n]{0,70}'), '') AS name, CASE WHEN lang = 'en' THEN 'Use when ' ELSE '' END || coalesce(regexp_extract(text, '[A-Z][^\n]{0,220}'), '') AS description,
  list_slice(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> ''), 1, 4) AS content, CASE WHEN lang = 'en' THEN 'construction' ELSE 'access' END AS side,
  lower(trim(coalesce(regexp_extract(text, '^\w+ \w+'), ''))) AS answer, list_slice(regexp_extract_all(coalesce(text, ''), '[A-Z][a-z]+'), 3, 3) AS entities, [coalesce(source, '')] AS gold FROM documents),
ruled AS (SELECT *, array_to_string(content, chr(10)) AS txt, concat_ws(' ', name, description, array_to_string(content, chr(10))) AS combined FROM pay)"""


@query(
    "payload_validation",
    f"WITH {PAYLOAD_SQL} SELECT doc_id, array_to_string(list_filter([{', '.join(f'CASE WHEN {bad} THEN ' + chr(39) + text + chr(39) + ' END' for bad, text in _RULES_SQL)}], lambda x: x IS NOT NULL), '; ') AS errors FROM ruled",
)
def payload_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules that a skill made of each document's first lines breaks."""
    d = table(spark, sf_dir, "documents").withColumn("t", F.coalesce("text", F.lit("")))
    content = F.slice(F.filter(F.split("t", "\n"), lambda x: F.trim(x) != ""), 1, 4)
    english = F.col("lang") == "en"
    found = sk.violations(
        F.regexp_extract("t", r"^[^\n]{0,70}", 0), F.concat(F.when(english, "Use when ").otherwise(""), F.regexp_extract("t", r"[A-Z][^\n]{0,220}", 0)), content, F.when(english, "construction").otherwise("access"),
        F.regexp_extract("t", r"^\w+ \w+", 0), F.slice(F.regexp_extract_all("t", F.lit("[A-Z][a-z]+"), F.lit(0)), 3, 1), F.array(F.coalesce("source", F.lit(""))),
    )
    return d.select("doc_id", F.array_join(found, "; ").alias("errors"))


_ACTS = ("update", "merge the", "keep every", "repeat", "set", "search with another", "return the", "abstain from the", "read the", "Run the", "retry each", "state the expected")
_THINGS = ("memory", "record", "search", "top-k", "answer", "query", "evidence", "database", "step", "A1 reply", "depth", "target version")
_WISHES_SQL = f"""w AS (SELECT o_orderkey AS skill_id, CASE WHEN o_orderstatus = 'O' THEN 'access' ELSE 'construction' END AS side,
  'Use when ' || {[*_ACTS]}[o_custkey % {len(_ACTS)} + 1] || ' ' || {[*_THINGS]}[o_orderkey % {len(_THINGS)} + 1] AS description,
  [{[*_ACTS]}[o_orderkey % {len(_ACTS)} + 1] || ' ' || {[*_THINGS]}[o_custkey % {len(_THINGS)} + 1], {[*_THINGS]}[(o_orderkey + o_custkey) % {len(_THINGS)} + 1] || ' to ' || {[*_ACTS]}[(o_orderkey * 7 + o_custkey) % {len(_ACTS)} + 1]] AS content FROM orders),
wc AS (SELECT *, concat_ws(' ', 'a skill', description, array_to_string(content, chr(10))) AS combined, list_filter(content, lambda x: NOT CASE WHEN side = 'construction' THEN regexp_matches(x, '{sk.MUTATING_ITEM}') ELSE regexp_matches(x, '{sk.EVIDENCE_BYPASS}') END) AS kept FROM w)"""


def _wishes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A skill of each order, whose wording its keys choose."""
    o = table(spark, sf_dir, "orders")
    word = lambda words, at: F.get(F.array(*[F.lit(x) for x in words]), (at % len(words)).cast("int"))
    a, c = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        a.alias("skill_id"), F.when(F.col("o_orderstatus") == "O", "access").otherwise("construction").alias("side"), F.concat(F.lit("Use when "), word(_ACTS, c), F.lit(" "), word(_THINGS, a)).alias("description"),
        F.array(F.concat(word(_ACTS, a), F.lit(" "), word(_THINGS, c)), F.concat(word(_THINGS, a + c), F.lit(" to "), word(_ACTS, a * 7 + c))).alias("content"),
    )


@query(
    "skill_side_rules",
    f"WITH {_WISHES_SQL} SELECT skill_id, array_to_string(list_filter([{', '.join(f'CASE WHEN {bad} THEN ' + chr(39) + text + chr(39) + ' END' for bad, text in _RULES_SQL[-4:])}], lambda x: x IS NOT NULL), '; ') AS errors FROM wc",
)
def skill_side_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What skills may not ask for on their side: changes of the store, loops, another retrieval, answers without evidence."""
    found = sk.violations(F.lit("a skill"), F.col("description"), F.col("content"), F.col("side"))
    told = F.filter(found, lambda x: x.isin("storage mutation", "agent loop", "fixed retrieval", "evidence bypass"))
    return _wishes(spark, sf_dir).select("skill_id", F.array_join(told, "; ").alias("errors"))


@query(
    "skill_content_filters",
    f"WITH {_WISHES_SQL} SELECT skill_id, array_to_string(kept, '; ') AS kept, len(kept) > 0 AS used, NOT ({' OR '.join(f'regexp_matches(lower(description || chr(32) || array_to_string(content, chr(32))), {chr(39)}{p}{chr(39)})' for p in sk.RETRIEVAL_ACTIONS)}) AS answers FROM wc",
)
def skill_content_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items that a run may use, whether a skill has any, and whether it fits a single answer."""
    kept = sk.usable_content(F.col("side"), F.col("content"))
    return _wishes(spark, sf_dir).select("skill_id", F.array_join(kept, "; ").alias("kept"), (F.size(kept) > 0).alias("used"), sk.answer_compatible(F.col("description"), F.col("content")).alias("answers"))


BANK_SQL = rf"""sk AS (SELECT item_id AS skill_id, regexp_extract(text, '^\w+') AS name, text AS description, embedding AS v FROM benchmark JOIN embeddings ON vec_id = item_id),
sg AS (SELECT conv_id AS query_id, turn AS part, text, embedding AS v FROM conversations JOIN embeddings ON vec_id = (conv_id * 7 + turn) % (SELECT count(*) FROM embeddings)),
rd AS (SELECT skill_id, {_TOKENS.format("name || '. ' || description")} AS t FROM sk), rs AS (SELECT count(*) AS n_docs, greatest(avg(len(t)), 1.0) AS avgdl FROM rd),
rtf AS (SELECT skill_id, token, count(*) AS tf FROM (SELECT skill_id, unnest(t) AS token FROM rd) x GROUP BY 1, 2), rdf AS (SELECT token, count(*) AS df FROM rtf GROUP BY 1),
rq AS (SELECT query_id, part, list_distinct({_TOKENS.format("text")}) AS q FROM sg),
rb AS (SELECT query_id, part, skill_id, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / avgdl))) AS s FROM (SELECT query_id, part, unnest(q) AS token FROM rq) x JOIN rdf USING (token) JOIN rtf USING (token) JOIN rd USING (skill_id), rs GROUP BY 1, 2, 3),
rl AS (SELECT query_id, skill_id, max(1 - exp(-s / greatest(len(q), 1))) AS lexical FROM rb JOIN rq USING (query_id, part) GROUP BY 1, 2),
rm AS (SELECT query_id, skill_id, max(list_cosine_similarity(CAST(sg.v AS DOUBLE[]), CAST(sk.v AS DOUBLE[]))) AS semantic FROM sg, sk GROUP BY 1, 2),
ranked AS (SELECT query_id, skill_id, 0.70 * semantic + 0.30 * coalesce(lexical, 0) AS score, semantic, coalesce(lexical, 0) AS lexical FROM rm LEFT JOIN rl USING (query_id, skill_id))"""


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    item, said = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "conversations")
    held = item.join(v, F.col("vec_id") == F.col("item_id")).select(F.lit("access").alias("side"), F.col("item_id").alias("skill_id"), F.regexp_extract("text", r"^\w+", 0).alias("name"), F.col("text").alias("description"), "v")
    parts = said.join(v, F.col("vec_id") == (F.col("conv_id") * 7 + F.col("turn")) % max(1, v.count())).select(F.lit("access").alias("side"), F.col("conv_id").alias("query_id"), F.col("turn").alias("part"), "text", "v")
    return sk.ranked_skills(held, parts, tx.simple_tokens)


@query("skill_ranking", f"WITH {BANK_SQL} SELECT query_id, skill_id, rank, round(score, 6) AS score, round(semantic, 6) AS semantic, round(lexical, 6) AS lexical FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, skill_id) AS rank FROM ranked) t WHERE rank <= 10")
def skill_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first stage: conversations, in segments, ask the items as skills; ten candidates each."""
    top = sk.first_stage(_ranked(spark, sf_dir), 10, 2, 3)
    return top.select("query_id", "skill_id", "rank", *[F.round(c, 6).alias(c) for c in ("score", "semantic", "lexical")])


@query(
    "skill_routing",
    rf"""WITH {BANK_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, skill_id) AS rank FROM ranked), k AS (SELECT * FROM f WHERE rank <= 12),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS p FROM k WHERE score >= 0.05 AND semantic >= 0.05) t WHERE p <= 12 AND skill_id % 3 <> 0),
d AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM c), l AS (SELECT d.query_id FROM d LEFT JOIN k s ON s.query_id = d.query_id AND s.rank = 2 WHERE d.place = 1 AND (s.score IS NULL OR d.score - s.score >= 0.002)),
t AS (SELECT k.*, place FROM k LEFT JOIN (SELECT query_id, skill_id, place FROM d WHERE place <= 3 AND query_id IN (SELECT query_id FROM l)) x USING (query_id, skill_id))
SELECT query_id, 'selected' AS band, place, skill_id, rank, round(score, 6) AS score FROM t WHERE place IS NOT NULL
UNION ALL SELECT query_id, 'nearby', n, skill_id, rank, round(score, 6) FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM t WHERE place IS NULL) u WHERE n <= 5""",
)
def skill_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole route of the conversations to the items as skills; every third item asks for a search of its own and is left out of an answer."""
    wish = F.when(F.col("item_id") % 3 == 0, "search again").otherwise("read what is there")
    held = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("skill_id"), F.lit("").alias("description"), F.array(wish).alias("content"))
    found = sk.routed(_ranked(spark, sf_dir), held, "access", 3, 12, 5, 0.05, 0.05, 0.002, answer_only=True)
    return found.select("query_id", "band", "place", "skill_id", "rank", F.round("score", 6).alias("score"))


VERDICTS_SQL = """v AS (SELECT user_id AS query_id, event_id AS seq, event_type AS skill_id, CASE WHEN value > 20 THEN 'r' || event_id ELSE '' END AS reason, CASE WHEN value < 150 THEN 'said' END AS trigger_evidence,
  CASE WHEN event_id % 3 = 0 THEN 'No gap here' WHEN event_id % 3 = 1 THEN 'the date' ELSE ' ' END AS unresolved_gap FROM events)"""


@query(
    "skill_rerank",
    f"WITH {VERDICTS_SQL}, shown AS (SELECT DISTINCT user_id AS query_id, event_type AS skill_id FROM events WHERE event_type <> 'error'), ok AS (SELECT query_id, skill_id, min(seq) AS seq FROM v JOIN shown USING (query_id, skill_id) WHERE trim(reason) <> '' AND trim(coalesce(trigger_evidence, '')) <> '' AND unresolved_gap = 'the date' GROUP BY 1, 2) "
    "SELECT query_id, place, skill_id, 'r' || seq AS reason FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY seq, skill_id) AS place FROM ok) t WHERE place <= 3",
)
def skill_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reranker's replies as a table: shown, first, reasoned and not self-refuting choices, three each."""
    e = table(spark, sf_dir, "events")
    gap = F.when(F.col("event_id") % 3 == 0, "No gap here").when(F.col("event_id") % 3 == 1, "the date").otherwise(" ")
    replies = e.select(
        F.col("user_id").alias("query_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("skill_id"), F.when(F.col("value") > 20, F.concat(F.lit("r"), F.col("event_id").cast("string"))).otherwise("").alias("reason"),
        F.when(F.col("value") < 150, "said").alias("trigger_evidence"), gap.alias("unresolved_gap"),
    )
    return sk.reranked(e.where("event_type <> 'error'").select(F.col("user_id").alias("query_id"), F.col("event_type").alias("skill_id")), replies, 3, "access")


BATCH_SQL = rf"""bs AS (SELECT item_id AS skill_id, text AS words, a.embedding AS dv, b.embedding AS cv FROM benchmark JOIN embeddings a ON a.vec_id = item_id JOIN embeddings b ON b.vec_id = item_id + 200),
bc AS (SELECT conv_id % 20 AS batch_id, conv_id AS candidate_id, string_agg(text, ' ' ORDER BY turn) AS words, any_value(a.embedding) AS dv, any_value(b.embedding) AS cv FROM conversations JOIN embeddings a ON a.vec_id = conv_id % (SELECT count(*) FROM embeddings) JOIN embeddings b ON b.vec_id = (conv_id * 3 + 1) % (SELECT count(*) FROM embeddings) GROUP BY 1, 2),
xd AS (SELECT skill_id, {_TOKENS.format("words")} AS t FROM bs), xs AS (SELECT count(*) AS n_docs, greatest(avg(len(t)), 1.0) AS avgdl FROM xd), xtf AS (SELECT skill_id, token, count(*) AS tf FROM (SELECT skill_id, unnest(t) AS token FROM xd) x GROUP BY 1, 2),
xdf AS (SELECT token, count(*) AS df FROM xtf GROUP BY 1), xq AS (SELECT candidate_id, unnest(list_distinct({_TOKENS.format("words")})) AS token FROM bc),
xb AS (SELECT candidate_id, skill_id, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / avgdl))) AS s FROM xq JOIN xdf USING (token) JOIN xtf USING (token) JOIN xd USING (skill_id), xs GROUP BY 1, 2),
xl AS (SELECT candidate_id, skill_id, s / greatest(max(s) OVER (PARTITION BY candidate_id), 1e-12) AS lexical FROM xb),
xp AS (SELECT batch_id, candidate_id, skill_id, list_cosine_similarity(CAST(bc.dv AS DOUBLE[]), CAST(bs.dv AS DOUBLE[])) AS description, list_cosine_similarity(CAST(bc.cv AS DOUBLE[]), CAST(bs.cv AS DOUBLE[])) AS content FROM bc, bs),
xc AS (SELECT batch_id, candidate_id, skill_id, description, content, coalesce(lexical, 0) AS lexical, round(0.5 * description + 0.3 * content + 0.2 * coalesce(lexical, 0), 9) AS score FROM xp LEFT JOIN xl USING (candidate_id, skill_id)),
fo AS (SELECT DISTINCT conv_id % 20 AS batch_id, conv_id AS candidate_id, conv_id % 40 AS skill_id FROM conversations WHERE role = 'system'),
ev AS (SELECT xc.*, fo.skill_id IS NOT NULL AS forced, row_number() OVER (PARTITION BY batch_id, candidate_id ORDER BY score DESC, skill_id) AS rank FROM xc LEFT JOIN fo USING (batch_id, candidate_id, skill_id)),
bk AS (SELECT batch_id, skill_id, bool_or(rank <= 2 OR forced) AS sure, max(CASE WHEN rank <= 5 THEN score END) AS extra, avg(CASE WHEN score >= 0.55 THEN 1.0 ELSE 0.0 END) AS coverage FROM ev GROUP BY 1, 2),
cr AS (SELECT *, count(*) FILTER (WHERE sure) OVER (PARTITION BY batch_id) AS crowd FROM bk WHERE sure OR extra IS NOT NULL),
sh AS (SELECT batch_id, skill_id FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY sure DESC, CASE WHEN sure AND crowd > 25 THEN coverage END DESC NULLS LAST, CASE WHEN NOT sure THEN extra END DESC NULLS LAST, CASE WHEN sure THEN skill_id END ASC NULLS FIRST, skill_id DESC) AS place FROM cr) t WHERE place <= 25)"""


@query(
    "batch_retrieval",
    f"WITH {BATCH_SQL} SELECT batch_id, candidate_id, skill_id, round(description, 6) AS description, round(content, 6) AS content, round(lexical, 6) AS lexical, score, forced, row_number() OVER (PARTITION BY batch_id, candidate_id ORDER BY score DESC, skill_id) AS rank FROM ev JOIN sh USING (batch_id, skill_id)",
)
def batch_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations, in batches, against the items as the bank: composite scores, sure and forced skills, fill to 25, the relation table."""
    v = lambda key, name: table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias(key), F.col("embedding").alias(name))
    bank = table(spark, sf_dir, "benchmark").select(F.lit("access").alias("side"), F.col("item_id").alias("skill_id"), F.col("text").alias("words"), F.col("item_id").alias("a"), (F.col("item_id") + 200).alias("b"))
    said = table(spark, sf_dir, "conversations")
    n = max(1, table(spark, sf_dir, "embeddings").count())
    told = said.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("words"))
    told = told.select(F.lit("access").alias("side"), (F.col("conv_id") % 20).alias("batch_id"), F.col("conv_id").alias("candidate_id"), "words", (F.col("conv_id") % n).alias("a"), ((F.col("conv_id") * 3 + 1) % n).alias("b"))
    scored = sk.batch_scores(told.join(v("a", "description_v"), "a").join(v("b", "content_v"), "b"), bank.join(v("a", "description_v"), "a").join(v("b", "content_v"), "b"), tx.simple_tokens)
    wanted = said.where("role = 'system'").select((F.col("conv_id") % 20).alias("batch_id"), F.col("conv_id").alias("candidate_id"), (F.col("conv_id") % 40).alias("skill_id"))
    shown = sk.batch_relations(scored, wanted)
    return shown.select("batch_id", "candidate_id", "skill_id", *[F.round(c, 6).alias(c) for c in ("description", "content", "lexical")], "score", "forced", "rank")


_UNIT = "list_transform(CAST({0} AS DOUBLE[]), lambda x: x / greatest(sqrt(list_sum(list_transform(CAST({0} AS DOUBLE[]), lambda y: y * y))), 1e-12) * {1})"


@query(
    "composed_vectors",
    f"WITH w AS (SELECT a.vec_id, list_transform(list_zip({_UNIT.format('a.embedding', 0.45)}, {_UNIT.format('b.embedding', 0.35)}, {_UNIT.format('c.embedding', 0.20)}), lambda x: x[1] + x[2] + x[3]) AS v FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 JOIN embeddings c ON c.vec_id = a.vec_id + 2) "
    "SELECT vec_id, round(v[1] / sqrt(list_sum(list_transform(v, lambda y: y * y))), 6) + 0.0 AS first, round(v[len(v)] / sqrt(list_sum(list_transform(v, lambda y: y * y))), 6) + 0.0 AS last FROM w",
)
def composed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Description, content and solves (three neighbouring vectors) as one weighted unit vector."""
    v = table(spark, sf_dir, "embeddings")
    at = lambda k, name: v.select((F.col("vec_id") - k).alias("vec_id"), F.col("embedding").alias(name))
    both = at(0, "d").join(at(1, "c"), "vec_id").join(at(2, "s"), "vec_id").select("vec_id", sk.composed(F.col("d"), F.col("c"), F.col("s")).alias("v"))
    return both.select("vec_id", (F.round(F.col("v")[0], 6) + 0.0).alias("first"), (F.round(F.element_at("v", -1), 6) + 0.0).alias("last"))


@query("skill_buckets", "SELECT CASE WHEN lang = 'en' THEN 'access/' || upper(trim(coalesce(source, ''))) ELSE 'construction' END AS bucket, count(*) AS n FROM documents GROUP BY 1")
def skill_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("lang") == "en", "access").otherwise("construction")
    return table(spark, sf_dir, "documents").groupBy(sk.bucket(side, F.col("source")).alias("bucket")).agg(F.count("*").alias("n"))


@query(
    "skill_plan_errors",
    """WITH op AS (SELECT CAST(l_suppkey AS VARCHAR) AS bank, l_orderkey * 10 + l_linenumber AS seq, l_returnflag, l_linestatus, l_partkey, l_orderkey FROM lineitem)
SELECT DISTINCT CAST(s_suppkey AS VARCHAR) AS bank, 'the bank has changed since the plan was made' AS error FROM supplier WHERE s_acctbal < 0
UNION SELECT bank, 'not resolved once: ' || o FROM (SELECT bank, CAST(l_orderkey AS VARCHAR) AS o, count(*) AS n FROM op GROUP BY 1, 2) t WHERE n > 1
UNION SELECT bank, 'operation of the other side: ' || seq FROM op WHERE l_linestatus = 'F' AND l_returnflag = 'N'
UNION SELECT bank, 'skill was not shown: ' || l_partkey FROM op WHERE l_returnflag = 'R' AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_retailprice < 1900)""",
)
def skill_plan_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as operations on their supplier's bank: the checks before a plan is applied."""
    lines = table(spark, sf_dir, "lineitem").withColumn("bank", F.col("l_suppkey").cast("string"))
    kind = F.when(F.col("l_returnflag") == "R", "delete_skill").otherwise("add_skill")
    side = F.when((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "N"), "construction").otherwise("access")
    ops = lines.select(
        "bank", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), kind.alias("operation"), F.col("l_partkey").cast("string").alias("skill_id"), F.lit(None).cast("string").alias("target_skill_id"), side.alias("side"),
        F.array(F.col("l_orderkey")).alias("source_candidate_ids"),
    )
    known = lines.select("bank", F.col("l_orderkey").alias("candidate_id"))
    banks = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("bank"), F.lit("access").alias("side"), F.lit(1).alias("base_version"), F.when(F.col("s_acctbal") < 0, 2).otherwise(1).alias("current_version"))
    cheap = table(spark, sf_dir, "part").where("p_retailprice < 1900").select(F.col("p_partkey").cast("string").alias("skill_id"))
    shown = lines.select("bank", F.col("l_partkey").cast("string").alias("skill_id")).distinct().join(cheap, "skill_id", "left_semi")
    return sk.plan_errors(ops, shown, known, known, banks)
