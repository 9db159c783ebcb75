"""Hybrid search over the conversations as memories, asked by the benchmark items.

The turns of users and assistants are memories (two turns are versions of one), those of the
system are raw messages that no memory covers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import text as tx
from ..io import table
from ..operators import retrieval as rt
from ..operators import search, textindex
from ..operators.graph import cut

#: Turns that a task cuts into fields.
TEXTS = 5_000
FIRST_WORDS, NAMES = r"^\w+ \w+", "[A-Z][a-z]+"
LEXICAL_SQL = r"[A-Za-z0-9]+(?:[''_-][A-Za-z0-9]+)*|[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]"
STOP_SQL = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)


def _tok(x: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({x}, '{LEXICAL_SQL}'), lambda x: lower(x)), lambda x: x NOT IN ({STOP_SQL}))"


BASE_SQL = rf"""turns AS (SELECT conv_id * 1000 + turn AS doc_id, conv_id, turn, role, text FROM conversations),
mem AS (SELECT doc_id, conv_id * 10 + turn // 2 AS memory_id, text AS content, role AS subject, 'said' AS predicate, regexp_extract(text, '{FIRST_WORDS}') AS object_text,
  list_slice(regexp_extract_all(lower(text), '[a-z0-9]+'), 1, 3) AS keywords, list_slice(regexp_extract_all(text, '{NAMES}'), 1, 2) AS entities,
  printf('2024-01-%02d', conv_id % 28 + 1) AS world_start, CASE WHEN turn % 2 = 0 THEN printf('2024-02-%02d', turn + 1) END AS world_end, turn % 2 = 1 AS current FROM turns WHERE role <> 'system'),
src AS (SELECT doc_id, role AS speaker, text AS content FROM turns WHERE role = 'system'),
qs AS (SELECT item_id AS query_id, trim(text) AS query, trim(regexp_extract(text, '{FIRST_WORDS}')) AS kw, list_slice(regexp_extract_all(text, '{NAMES}'), 1, 2) AS entities,
  ['none', 'current', 'point', 'before', 'range'][item_id % 5 + 1] AS time_mode, CASE WHEN item_id % 5 >= 2 THEN '2024-01-15' END AS target, CASE WHEN item_id % 5 = 4 THEN '2024-01-20' END AS target_end, 1 + item_id % 2 AS depth FROM benchmark),
lq AS (SELECT *, CASE WHEN kw <> '' THEN kw ELSE query END AS lexical FROM qs)"""


def _bm25_sql(name: str, rows: str, tokens: str) -> str:
    return f"""{name}_d AS (SELECT doc_id, {tokens} AS toks FROM {rows}),
{name}_tf AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS token FROM {name}_d) t GROUP BY 1, 2),
{name}_df AS (SELECT token, count(*) AS df FROM {name}_tf GROUP BY 1),
{name}_st AS (SELECT count(*) AS n_docs, greatest(avg(len(toks)), 1.0) AS avgdl FROM {name}_d),
{name}_q AS (SELECT query_id, token, count(*) AS qf FROM (SELECT query_id, unnest({_tok('lexical')}) AS token FROM lq) t GROUP BY 1, 2),
{name}_s AS (SELECT query_id, doc_id, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * (1 + ln(qf)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(toks) / avgdl))) AS score
  FROM {name}_q JOIN {name}_df USING (token) JOIN {name}_tf USING (token) JOIN {name}_d USING (doc_id), {name}_st GROUP BY 1, 2)"""


WEIGHTED_SQL = "list_concat(" + ", ".join(["list_concat(" + _tok("content") + ", " + _tok("predicate") + ")"]) + ", list_concat(list_concat(" + _tok("predicate") + ", list_concat(" + _tok("object_text") + ", " + _tok("object_text") + ")), list_concat(list_concat(" + _tok("array_to_string(keywords, ' ')") + ", " + _tok("array_to_string(keywords, ' ')") + "), list_concat(" + _tok("subject") + ", " + _tok("array_to_string(entities, ' ')") + "))))"
SEARCH_SQL = "concat_ws(' ', nullif(content, ''), nullif(subject, ''), nullif(predicate, ''), nullif(object_text, ''), nullif(array_to_string(keywords, ' '), ''), nullif(array_to_string(entities, ' '), ''))"
_HASHED = "SELECT {key}, sha256(unnest(list_filter(regexp_split_to_array(lower({text}), '[ \\t\\n\\r]+'), lambda x: x <> ''))) AS h FROM {rows}"
_PLACED = "SELECT {key}, CAST(('0x' || substr(h, 1, 8)) AS BIGINT) % 384 AS idx, sum(CASE WHEN CAST(('0x' || substr(h, 9, 2)) AS BIGINT) % 2 = 0 THEN 1.0 ELSE -1.0 END) AS x FROM ({hashed}) h GROUP BY ALL"
SEMANTIC_SQL = f"""sq AS (SELECT query_id, 0 AS part, query AS s FROM qs WHERE query <> '' UNION ALL SELECT query_id, 1, kw FROM qs WHERE kw <> '' AND kw <> query),
dv AS (SELECT doc_id, idx, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS x FROM ({_PLACED.format(key='doc_id', hashed=_HASHED.format(key='doc_id', text='content', rows='mem'))}) t WHERE x <> 0),
qv AS (SELECT query_id, part, idx, x / sqrt(sum(x * x) OVER (PARTITION BY query_id, part)) AS x FROM ({_PLACED.format(key='query_id, part', hashed=_HASHED.format(key='query_id, part', text='s', rows='sq'))}) t WHERE x <> 0),
dots AS (SELECT query_id, part, doc_id, sum(qv.x * dv.x) AS score FROM qv JOIN dv USING (idx) GROUP BY 1, 2, 3),
sem_all AS (SELECT query_id, part, doc_id, round(coalesce(score, 0), 9) AS score FROM (SELECT DISTINCT query_id, part FROM qv) a CROSS JOIN (SELECT DISTINCT doc_id FROM dv) b LEFT JOIN dots USING (query_id, part, doc_id)),
semantic AS (SELECT query_id, part, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, part ORDER BY score DESC, doc_id) AS rank FROM sem_all) t JOIN qs USING (query_id) WHERE rank <= 30 * depth)"""


def _ranked_sql(name: str, scores: str) -> str:
    return f"{name} AS (SELECT query_id, doc_id, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM {scores}) t JOIN qs USING (query_id) WHERE rank <= 30 * depth)"


VALID_SQL = """CASE WHEN time_mode = 'none' THEN true WHEN time_mode = 'current' THEN current WHEN coalesce(target, '') = '' THEN true WHEN time_mode = 'point' THEN coalesce(world_start, '') <= target AND target < coalesce(world_end, 'z')
  WHEN time_mode = 'before' THEN coalesce(world_start <> '' AND world_start < target, false) ELSE coalesce(world_start, '') <= coalesce(target_end, target) AND coalesce(world_end, 'z') >= target END"""
KEYWORD_SQL = f"""md AS (SELECT doc_id, lower({SEARCH_SQL}) AS low, list_distinct({_tok(f'lower({SEARCH_SQL})')}) AS dt FROM mem),
mq AS (SELECT query_id, list_filter(CASE WHEN kw = query THEN [query] ELSE [kw, query] END, lambda p: p <> '') AS phrases, list_distinct({_tok("kw || ' ' || query")}) AS qt FROM qs),
kw_s AS (SELECT query_id, doc_id, coalesce(list_sum(list_transform(list_filter(phrases, lambda p: contains(low, lower(p))), lambda p: 2.0 + least(len(list_filter(regexp_split_to_array(p, '[ \\t\\n\\r]+'), lambda w: w <> '')), 4) * 0.25)), 0) + len(list_intersect(qt, dt)) / greatest(len(qt), 1) AS score FROM mq, md),
kw_p AS (SELECT * FROM kw_s WHERE score > 0)"""
STRUCTURED_SQL = f"""st_s AS (SELECT query_id, doc_id, coalesce(list_sum(list_transform(qs.entities, lambda e: CASE WHEN list_contains(list_transform(mem.entities, lambda x: lower(x)), lower(e)) THEN 1.0 WHEN contains(lower(subject), lower(e)) THEN 0.8 WHEN contains(lower(content), lower(e)) THEN 0.4 ELSE 0.0 END)), 0)
  + len(list_intersect(qt, dt)) / greatest(len(qt), 1)
  + CASE WHEN time_mode = 'none' THEN 0 WHEN time_mode = 'current' THEN CASE WHEN current THEN 1 ELSE 0 END WHEN NOT ({VALID_SQL}) THEN 0 WHEN time_mode = 'before' THEN 0.8 ELSE 1 END AS score
  FROM qs JOIN mq USING (query_id), mem JOIN md USING (doc_id)),
st_p AS (SELECT * FROM st_s WHERE score > 0)"""
ROUTES_SQL = ",\n".join(
    [
        BASE_SQL, SEMANTIC_SQL, _bm25_sql("b", "mem", WEIGHTED_SQL), _ranked_sql("bm25", "b_s"), KEYWORD_SQL, _ranked_sql("keyword", "kw_p"), STRUCTURED_SQL, _ranked_sql("structured", "st_p"),
        _bm25_sql("o", "src", _tok("concat_ws(' ', nullif(speaker, ''), nullif(content, ''))")), _ranked_sql("source", "o_s"),
    ]
)
HYBRID_SQL = f"""{ROUTES_SQL},
shares AS (SELECT query_id, doc_id, 0.40 / n / (60 + rank) AS s, 0 AS route, 'semantic' AS path FROM semantic JOIN (SELECT query_id, count(*) AS n FROM sq GROUP BY 1) c USING (query_id)
  UNION ALL SELECT query_id, doc_id, 0.30 / (60 + rank), 1, 'bm25' FROM bm25 UNION ALL SELECT query_id, doc_id, 0.15 / (60 + rank), 2, 'keyword' FROM keyword
  UNION ALL SELECT query_id, doc_id, 0.15 / (60 + rank), 3, 'structured' FROM structured UNION ALL SELECT query_id, doc_id, 0.35 / (60 + rank), 4, 'source' FROM source),
paths AS (SELECT query_id, doc_id, string_agg(path, ',' ORDER BY route) AS paths FROM (SELECT DISTINCT query_id, doc_id, route, path FROM shares) t GROUP BY 1, 2),
fused AS (SELECT query_id, doc_id, sum(s) AS score FROM shares GROUP BY 1, 2),
facts AS (SELECT doc_id, memory_id, entities, world_start, world_end, current FROM mem UNION ALL SELECT doc_id, doc_id, [speaker], NULL, NULL, true FROM src),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, memory_id ORDER BY round(score, 9) DESC, doc_id) AS n FROM fused JOIN facts USING (doc_id)) t WHERE n = 1),
weighed AS (SELECT o.query_id, doc_id, memory_id, score * CASE WHEN len(list_intersect(list_transform(q.entities, lambda x: lower(x)), list_transform(o.entities, lambda x: lower(x)))) > 0 THEN 1.10 ELSE 1 END
  * CASE WHEN time_mode = 'current' AND current THEN 1.05 ELSE 1 END * CASE WHEN time_mode = 'none' OR coalesce(target, '') = '' THEN 1 WHEN {VALID_SQL} THEN 1.20 ELSE 0.50 END AS score FROM once o JOIN qs q USING (query_id)),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM weighed)"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations dealt out, so that texts are worked on in as many tasks as they need, however few files or row groups they lie in."""
    turns = table(spark, sf_dir, "conversations")
    n = -(-turns.count() // TEXTS)
    return turns.repartition(n, "conv_id", "turn") if n > 1 else turns


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _turns(spark, sf_dir).where("role <> 'system'")
    return said.select(
        F.lit(0).alias("scope"), (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), (F.col("conv_id") * 10 + F.floor(F.col("turn") / 2)).alias("memory_id"), F.col("text").alias("content"), F.col("role").alias("subject"),
        F.lit("said").alias("predicate"), F.regexp_extract("text", FIRST_WORDS, 0).alias("object_text"), F.slice(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)), 1, 3).alias("keywords"),
        F.slice(F.regexp_extract_all("text", F.lit(NAMES), F.lit(0)), 1, 2).alias("entities"), F.format_string("2024-01-%02d", (F.col("conv_id") % 28 + 1).cast("long")).alias("world_start"),
        F.when(F.col("turn") % 2 == 0, F.format_string("2024-02-%02d", (F.col("turn") + 1).cast("long"))).alias("world_end"), (F.col("turn") % 2 == 1).alias("current"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).where("role = 'system'").select(F.lit(0).alias("scope"), (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.col("role").alias("speaker"), F.col("text").alias("content"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.filter(F.array(F.regexp_extract("text", FIRST_WORDS, 0)), lambda x: x != "")
    mode = F.get(F.array(*[F.lit(m) for m in ("none", "current", "point", "before", "range")]), (F.col("item_id") % 5).cast("int"))
    return table(spark, sf_dir, "benchmark").select(
        F.lit(0).alias("scope"), F.col("item_id").alias("query_id"), F.trim("text").alias("query"), first.alias("expansions"), first.alias("keywords"), F.slice(F.regexp_extract_all("text", F.lit(NAMES), F.lit(0)), 1, 2).alias("entities"),
        mode.alias("time_mode"), F.when(F.col("item_id") % 5 >= 2, "2024-01-15").alias("target"), F.when(F.col("item_id") % 5 == 4, "2024-01-20").alias("target_end"), (1 + F.col("item_id") % 2).cast("string").alias("depth"),
    )


def _vectors(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, v: hash vectors as their non-zero places; texts: keys, text (those of one key count as one text)."""
    once = texts.groupBy(*keys).agg(F.array_join(F.collect_list("text"), " ").alias("text"))
    return rt.hash_vectors(once, F.array_remove(F.split(F.lower("text"), r"[ \t\n\r]+"), ""), keys)


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    held, free, queries = cut(memories(spark, sf_dir)), cut(sources(spark, sf_dir)), asked(spark, sf_dir)  # fields are cut out of the texts once for all routes
    expanded = queries.select("scope", "query_id", F.posexplode(search.semantic_queries()).alias("part", "text"))
    return held, free, queries, _vectors(held.select("scope", "doc_id", F.col("content").alias("text")), ["scope", "doc_id"]), _vectors(expanded, ["scope", "query_id", "part"])


@query("hybrid_topk", f"WITH {HYBRID_SQL} SELECT query_id, rank, doc_id, memory_id, round(score, 9) AS score, paths FROM top JOIN paths USING (query_id, doc_id) WHERE rank <= 8")
def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five routes (semantic with expansions, boosted BM25, keyword, structured, uncovered sources), fusion, one hit per memory, multipliers, the eight best."""
    found = search.hybrid(*_inputs(spark, sf_dir))
    return found.select("query_id", "rank", "doc_id", "memory_id", F.round("score", 9).alias("score"), F.array_join("matched_paths", ",").alias("paths"))


@query("hybrid_stemmed")
def hybrid_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with stems (the stemmer has no SQL; a test holds it against loops)."""
    return search.hybrid(*_inputs(spark, sf_dir), tokens=search.stemmed_lexical).select("query_id", "rank", "doc_id", F.round("score", 9).alias("score"), F.array_join("matched_paths", ",").alias("paths"))


@query("multipliers_rank", f"WITH {HYBRID_SQL} SELECT query_id, count(*) AS n, min(round(score, 9)) AS least, max(round(score, 9)) AS best FROM weighed GROUP BY query_id")
def multipliers_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many hits the routes give each query, and the range of their scores after the multipliers."""
    held, free, queries, vectors, query_vectors = _inputs(spark, sf_dir)
    hits = search.fused({name: cut(route) for name, route in search.routes(held, free, queries, vectors, query_vectors).items()}, queries)
    every = search.finished(hits, search.facts(held, free), queries, 1 << 30)
    return every.groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.min("score"), 9).alias("least"), F.round(F.max("score"), 9).alias("best"))


def _route(name: str):
    sql = f"WITH {ROUTES_SQL} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM {name}"

    @query(f"{name}_search", sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search.routes(*_inputs(spark, sf_dir), only=(name,))[name].select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))

    return run


for _name in ("bm25", "keyword", "structured", "source"):
    _route(_name)


@query("semantic_search", f"WITH {ROUTES_SQL} SELECT query_id, part, doc_id, rank FROM semantic")
def semantic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each expansion's nearest memories by hash vectors."""
    return search.routes(*_inputs(spark, sf_dir), only=("semantic",))["semantic"].select("query_id", F.when(F.col("part") > 0, 1).otherwise(0).alias("part"), "doc_id", "rank")


@query(
    "two_round_access",
    f"""WITH {ROUTES_SQL}, f AS (SELECT query_id, doc_id, min(rank) AS rank FROM bm25 WHERE rank <= 16 GROUP BY 1, 2),
e AS (SELECT query_id, doc_id, search, rank FROM (SELECT query_id, doc_id, 0 AS search, rank FROM keyword WHERE rank <= 12 UNION ALL SELECT query_id, doc_id, 1, rank FROM structured WHERE rank <= 12 UNION ALL SELECT query_id, doc_id, 2, rank FROM source WHERE rank <= 12) t),
b AS (SELECT query_id, doc_id, -1 AS search, rank FROM f UNION ALL SELECT * FROM e),
o AS (SELECT query_id, doc_id, min(search * 1000 + rank) AS seen FROM b GROUP BY 1, 2)
SELECT query_id, place, doc_id, seen < 0 AS first_round FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY seen, doc_id) AS place FROM o) t WHERE place <= 32""",
)
def two_round_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen hits first, then three supplemental searches of twelve, merged in order up to 32."""
    found = search.routes(*_inputs(spark, sf_dir), only=("bm25", "keyword", "structured", "source"))
    more = None
    for k, name in enumerate(("keyword", "structured", "source")):
        part = found[name].where("rank <= 12").select("scope", "query_id", F.lit(k).alias("search"), "rank", "doc_id")
        more = part if more is None else more.unionByName(part)
    return search.two_rounds(found["bm25"].where("rank <= 16"), more).select("query_id", "place", "doc_id", "first_round")


@query(
    "phrase_search",
    rf"""WITH {BASE_SQL}, d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM turns), q AS (SELECT query_id, regexp_extract_all(lower(kw), '[a-z0-9]+') AS q FROM qs),
p AS (SELECT query_id, doc_id, len(list_filter(generate_series(1, len(t)), lambda i: t[i:i + len(q) - 1] = q)) AS n FROM d, q WHERE len(q) > 0 AND len(t) > 0)
SELECT query_id, rank, doc_id, n FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, doc_id) AS rank FROM p WHERE n > 0) t WHERE rank <= 10""",
)
def phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The item's first two words as one phrase in the messages."""
    every = memories(spark, sf_dir).select("scope", "doc_id", F.col("content").alias("text")).unionByName(sources(spark, sf_dir).select("scope", "doc_id", F.col("content").alias("text")))
    words = lambda text: F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    first = asked(spark, sf_dir).select("scope", "query_id", F.coalesce(F.get("keywords", F.lit(0)), F.lit("")).alias("text"))
    return search.phrase_search(every, first, words, 10).select("query_id", "rank", "doc_id", "n")


HISTORY_SQL = "h AS (SELECT doc_id, conv_id * 10 + turn AS system_from, lead(conv_id * 10 + turn) OVER (PARTITION BY conv_id, turn // 2 ORDER BY turn) AS system_to, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM turns), half AS (SELECT max(system_from) // 2 AS half FROM h)"


@query(
    "phrase_search_as_of",
    rf"""WITH {BASE_SQL}, {HISTORY_SQL}, q AS (SELECT query_id, regexp_extract_all(lower(kw), '[a-z0-9]+') AS q FROM qs),
p AS (SELECT query_id, doc_id, len(t) AS size, len(list_filter(generate_series(1, len(t)), lambda i: t[i:i + len(q) - 1] = q)) AS n FROM h, q WHERE len(q) > 0 AND len(t) > 0),
f AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS df FROM p WHERE n > 0), s AS (SELECT count(*) AS n_all, avg(len(t)) AS avgdl FROM h),
b AS (SELECT query_id, doc_id, n, CASE WHEN ln((n_all - df + 0.5) / (df + 0.5)) > 0 THEN ln((n_all - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * size / avgdl)) AS score FROM f, s)
SELECT query_id, rank, doc_id, n, round(score, 6) AS score FROM (SELECT b.*, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM b JOIN h USING (doc_id), half WHERE system_from <= half AND (system_to IS NULL OR system_to > half)) t WHERE rank <= 10""",
)
def phrase_search_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The item's first two words in the turns in force half way through the history; two turns are versions of one memory, and each half of the history is a segment of its own."""
    own = Window.partitionBy("conv_id", F.floor(F.col("turn") / 2)).orderBy("turn")
    turn = table(spark, sf_dir, "conversations").withColumn("system_from", F.col("conv_id") * 10 + F.col("turn")).withColumn("system_to", F.lead("system_from").over(own))
    turn = turn.select(F.lit(0).alias("scope"), (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text", "system_from", "system_to")
    half = turn.agg(F.floor(F.max("system_from") / 2)).first()[0]
    words = lambda text: F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    (early, early_sizes), (late, late_sizes) = (textindex.segment(turn.where(part), words(F.col("text"))) for part in (F.col("system_from") <= half, F.col("system_from") > half))
    first = asked(spark, sf_dir).select("scope", "query_id", F.coalesce(F.get("keywords", F.lit(0)), F.lit("")).alias("text"))
    hits = textindex.phrase_hits(cut(early.unionByName(late)), early_sizes.unionByName(late_sizes), turn, first, words(F.col("text")), F.lit(half), 10)
    return hits.select("query_id", "rank", "doc_id", "n", F.round("score", 6).alias("score"))
