"""Queries on the store's records: commits, traces, cases and the joins that read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import scalars
from ..functions.scalars import normalized
from ..io import table
from ..operators import candidates as cd
from ..operators import records as rc
from ..operators import retrieval as rt
from ..operators import store, vectors
from ..operators.graph import dealt
from ..sources import artifacts
from .views import LINES_SQL, MESSAGES_SQL, VERSIONS_SQL, messages, order_lines, versions

NOTE = "candidate_id string, action string"

#: A conversation's memories (customers) and a plan of decisions on them (suppliers).
PLAN_SQL = """held AS (SELECT printf('mem_c_%04d', c_custkey) AS memory_id, printf('mem_c_%04d_v1', c_custkey) AS version_id, c_mktsegment AS memory_kind, c_name AS content, 'old ' || c_nationkey AS subject, c_acctbal / 10000 AS importance FROM customer),
plan AS (SELECT s_suppkey AS seq, 'cand_' || s_suppkey AS candidate_id, ['ADD', 'UPDATE', 'MERGE', 'DELETE', 'SKIP'][s_suppkey % 5 + 1] AS action, CASE WHEN s_suppkey % 5 IN (1, 2, 3) THEN printf('mem_c_%04d', s_suppkey) END AS target, s_name AS content, CASE WHEN s_suppkey % 2 = 0 THEN 'new ' || s_nationkey END AS subject,
  s_acctbal / 10000 AS importance FROM supplier),
top AS (SELECT max(c_custkey) AS m FROM customer),
fresh AS (SELECT printf('mem_c_%04d', m + row_number() OVER (ORDER BY seq)) AS memory_id, 1 AS version_no, candidate_id, content, subject, importance, NULL AS parent, 'add' AS update_type FROM plan, top WHERE action = 'ADD'
  UNION ALL SELECT target, 2, candidate_id, plan.content, coalesce(plan.subject, held.subject), CASE WHEN action = 'MERGE' THEN greatest(plan.importance, held.importance) ELSE plan.importance END, version_id, lower(action) FROM plan JOIN held ON held.memory_id = target WHERE action IN ('UPDATE', 'MERGE'))"""


def _plan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    number = lambda c: F.format_string("mem_c_%04d", F.col(c).cast("long"))
    given = {
        "version_id": F.concat(number("c_custkey"), F.lit("_v1")), "memory_id": number("c_custkey"), "conversation_id": F.lit("c"), "version_no": F.lit(1), "memory_kind": F.col("c_mktsegment"), "subject": F.concat(F.lit("old "), F.col("c_nationkey").cast("string")),
        "content": F.col("c_name"), "content_hash": F.substring(F.sha2("c_name", 256), 1, 16), "system_from": F.lit(1).cast("long"), "importance": F.col("c_acctbal") / 10000,
    }
    fields = [f.split() for f in store.VERSIONS.split(", ")]
    held = table(spark, sf_dir, "customer").select(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields])
    s = table(spark, sf_dir, "supplier")
    kind = F.get(F.array(*[F.lit(a) for a in store.ACTIONS]), (F.col("s_suppkey") % 5).cast("int"))
    told = {
        "seq": F.col("s_suppkey"), "candidate_id": F.concat(F.lit("cand_"), F.col("s_suppkey").cast("string")), "action": kind, "target_memory_id": F.when((F.col("s_suppkey") % 5).isin(1, 2, 3), number("s_suppkey")), "supersedes_version_id": F.lit(None).cast("string"),
        "content": F.col("s_name"), "subject": F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("new "), F.col("s_nationkey").cast("string"))), "importance": F.col("s_acctbal") / 10000,
    }
    kinds = dict(fields)
    rest = {n: F.lit(None).cast(kinds[n]) for n in ("memory_kind", "predicate", "object_text", "world_start", "world_end", "entities", "keywords", "confidence")}
    return held, s.select(*[c.alias(n) for n, c in (told | rest).items()])


@query(
    "plan_application",
    f"""WITH {PLAN_SQL} SELECT memory_id, 1 AS version_no, content, subject, round(importance, 6) AS importance, CASE WHEN action IS NOT NULL THEN 2 END AS system_to, CASE action WHEN 'UPDATE' THEN 'superseded' WHEN 'MERGE' THEN 'merged' WHEN 'DELETE' THEN 'retracted' END AS end_reason
FROM (SELECT held.*, action FROM held LEFT JOIN plan ON target = memory_id) t UNION ALL SELECT memory_id, version_no, content, subject, round(importance, 6), NULL, NULL FROM fresh""",
)
def plan_application(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All versions after a plan of additions, updates, merges, deletions and skips."""
    out = store.apply_plan(*_plan(spark, sf_dir), "c", commit=2)["versions"]
    return out.select("memory_id", "version_no", "content", "subject", F.round("importance", 6).alias("importance"), "system_to", "end_reason")


@query(
    "plan_changes",
    f"""WITH {PLAN_SQL} SELECT candidate_id, memory_id || '_v' || version_no AS version_id, update_type, CASE WHEN parent IS NOT NULL THEN array_to_string(list_filter([CASE WHEN content <> o.c THEN 'content' END, CASE WHEN importance IS DISTINCT FROM o.i THEN 'importance' END, CASE WHEN subject <> o.s THEN 'subject' END], lambda x: x IS NOT NULL), ',') END AS changed
FROM fresh LEFT JOIN (SELECT version_id AS v, content AS c, importance AS i, subject AS s FROM held) o ON o.v = parent""",
)
def plan_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change events of the plan: which fields differ from the version before."""
    events = store.apply_plan(*_plan(spark, sf_dir), "c", commit=2)["events"]
    return events.select("candidate_id", "version_id", "update_type", F.array_join(F.array_sort(F.map_keys("changed")), ",").alias("changed"))


def _committed(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    held, plan = _plan(spark, sf_dir)
    said = table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("cand_"), F.col("l_suppkey").cast("string")).alias("candidate_id")).agg(F.collect_list(F.col("l_partkey").cast("string")).alias("source_message_ids"))
    inputs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("message_id"))
    return rc.commit_plan(held, plan, plan.select("candidate_id").join(said, "candidate_id", "left").withColumn("source_message_ids", F.coalesce("source_message_ids", F.array().cast("array<string>"))), inputs, "c", 2)


@query(
    "commit_records",
    f"""WITH {PLAN_SQL}, src AS (SELECT DISTINCT 'cand_' || l_suppkey AS candidate_id, l_partkey AS message_id FROM lineitem)
SELECT 'inputs' AS kind, count(DISTINCT l_partkey) AS n FROM lineitem UNION ALL SELECT 'candidates', count(*) FROM plan UNION ALL SELECT 'candidate_edges', count(*) FROM src JOIN plan USING (candidate_id)
UNION ALL SELECT 'decisions', count(*) FROM plan UNION ALL SELECT 'version_edges', count(*) FROM src JOIN fresh USING (candidate_id) UNION ALL SELECT 'inherited', count(*) FROM src JOIN fresh USING (candidate_id) UNION ALL SELECT 'parents', count(*) FROM fresh WHERE parent IS NOT NULL UNION ALL SELECT 'commit', 1""",
)
def commit_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of each kind one commit writes."""
    found = _committed(spark, sf_dir)
    out = None
    for kind in ("inputs", "candidates", "candidate_edges", "decisions", "version_edges", "inherited", "parents", "commit"):
        part = found[kind].agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("decision_records", f"WITH {PLAN_SQL} SELECT printf('decision_%d_%03d', 2, row_number() OVER (ORDER BY seq) - 1) AS decision_id, candidate_id, action, target AS target_memory_id FROM plan")
def decision_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.decision_records(_plan(spark, sf_dir)[1], F.lit(2)).select("decision_id", "candidate_id", "action", "target_memory_id")


@query(
    "row_allocation",
    f"WITH {PLAN_SQL} SELECT candidate_id, CASE WHEN action IN ('ADD', 'UPDATE', 'MERGE') THEN (SELECT count(*) FROM events) + n END AS row_id, CASE WHEN action = 'ADD' THEN printf('mem_c_%04d', (SELECT count(*) FROM events) + a) END AS opened_memory_id FROM (SELECT *, CAST(sum(CASE WHEN action IN ('ADD', 'UPDATE', 'MERGE') THEN 1 ELSE 0 END) OVER (ORDER BY seq) AS BIGINT) AS n, CAST(sum(CASE WHEN action = 'ADD' THEN 1 ELSE 0 END) OVER (ORDER BY seq) AS BIGINT) AS a FROM plan) t",
)
def row_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of inserted versions run over all conversations and go on from the versions that there are (the events), so a conversation's memory numbers skip."""
    return rc.allocated(_plan(spark, sf_dir)[1], "c", F.lit(table(spark, sf_dir, "events").count())).select("candidate_id", "row_id", "opened_memory_id")


@query(
    "stored_row_ids",
    f"""WITH {PLAN_SQL}, last AS (SELECT (SELECT max(c_custkey) FROM customer) + (SELECT max(s_suppkey) FROM supplier) AS r),
n AS (SELECT candidate_id, row_number() OVER (ORDER BY seq) AS k FROM plan WHERE action IN ('ADD', 'UPDATE', 'MERGE'))
SELECT 'c' AS conversation_id, memory_id, 1 AS version_no, CAST(right(memory_id, length(memory_id) - 6) AS BIGINT) AS row_id FROM held
UNION ALL SELECT 'd', printf('mem_d_%04d', s_suppkey), 1, (SELECT max(c_custkey) FROM customer) + s_suppkey FROM supplier
UNION ALL SELECT 'c', memory_id, version_no, r + k FROM fresh JOIN n USING (candidate_id), last""",
)
def stored_row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan applied to a store of two conversations with row ids: c holds the customers, d the suppliers, inserted later."""
    held, plan = _plan(spark, sf_dir)
    first = held.withColumn("row_id", F.regexp_extract("memory_id", r"(\d+)$", 1).cast("long"))
    s = table(spark, sf_dir, "supplier").crossJoin(first.select(F.max("row_id").alias("_last")))
    memory = F.format_string("mem_d_%04d", F.col("s_suppkey").cast("long"))
    told = {"version_id": F.concat(memory, F.lit("_v1")), "memory_id": memory, "conversation_id": F.lit("d"), "version_no": F.lit(1), "content": F.col("s_name"), "system_from": F.lit(1), "row_id": F.col("_last") + F.col("s_suppkey")}
    second = s.select(*[told.get(n, F.lit(None)).cast(t).alias(n) for n, t in first.dtypes])
    out = store.apply_plan(first.unionByName(second), plan, "c", commit=2)["versions"]
    return out.select("conversation_id", "memory_id", "version_no", "row_id")


RELATIONS_SQL = "rel AS (SELECT l_orderkey AS candidate_id, (l_linenumber * 1000000 + l_partkey) * 10000 + l_suppkey AS seq, CASE l_returnflag WHEN 'A' THEN 'SKIP' WHEN 'N' THEN 'ADD' ELSE 'skip' END AS action, CASE WHEN l_linestatus = 'F' THEN 'duplicate_of' WHEN l_quantity > 25 THEN 'supports' ELSE 'unrelated' END AS relation, CAST(l_suppkey AS VARCHAR) AS version_id FROM lineitem)"


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_linestatus") == "F", "duplicate_of").when(F.col("l_quantity") > 25, "supports").otherwise("unrelated")
    action = F.when(F.col("l_returnflag") == "A", "SKIP").when(F.col("l_returnflag") == "N", "ADD").otherwise("skip")
    each = F.struct(kind.alias("relation_type"), F.col("l_suppkey").cast("string").alias("target_version_id"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("candidate_id"), F.expr("(l_linenumber * 1000000 + l_partkey) * 10000 + l_suppkey").alias("seq"), action.alias("action"), F.array(each).alias("relations"))


@query("relation_edges", f"WITH {RELATIONS_SQL} SELECT DISTINCT candidate_id, version_id, relation FROM rel WHERE relation <> 'unrelated'")
def relation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.relation_edges(_decisions(spark, sf_dir))


@query(
    "construction_decisions",
    f"WITH {RELATIONS_SQL}, f AS (SELECT candidate_id, min_by(action, seq) AS action FROM rel GROUP BY 1), s AS (SELECT candidate_id, bool_or(relation = 'duplicate_of') AS dup, count(DISTINCT relation || version_id) AS n FROM rel WHERE relation <> 'unrelated' AND version_id IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal > 0) GROUP BY 1) "
    "SELECT o_orderkey AS candidate_id, CASE WHEN upper(action) = 'SKIP' AND coalesce(dup, false) THEN 'SKIP' ELSE 'ADD' END AS action, coalesce(n, 0) AS n_relations FROM orders LEFT JOIN f ON f.candidate_id = o_orderkey LEFT JOIN s ON s.candidate_id = o_orderkey",
)
def construction_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One decision for every candidate: a skip needs a visible duplicate."""
    known = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("candidate_id"))
    seen = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").cast("string").alias("version_id"))
    return cd.decided(_decisions(spark, sf_dir), known, seen).select("candidate_id", "action", F.when(F.col("relations").isNull(), 0).otherwise(F.size("relations")).cast("long").alias("n_relations"))


@query(
    "candidate_admission",
    """WITH r AS (SELECT conv_id, turn, trim(text) AS content, CASE role WHEN 'user' THEN 'fact' ELSE 'event' END AS kind, conv_id * 1000 + turn AS src, role FROM conversations),
a AS (SELECT *, row_number() OVER (PARTITION BY conv_id, substr(sha256(content), 1, 16) ORDER BY turn) AS n FROM r WHERE content <> '' AND turn < 30 AND role <> 'system')
SELECT printf('cand_%s_%s_%03d', CAST(conv_id AS VARCHAR), CAST(conv_id AS VARCHAR), row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS candidate_id, kind AS memory_kind, CAST(src AS VARCHAR) AS sources, substr(sha256(content), 1, 16) AS content_hash, least(1.0, turn / 4.0) AS importance, 0.8 AS confidence FROM a WHERE n = 1""",
)
def candidate_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as extracted facts: sources must lie in the session and not be a system's."""
    c = table(spark, sf_dir, "conversations")
    own = (F.col("conv_id") * 1000 + F.col("turn")).cast("string")
    text, many = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    replies = c.select(
        F.col("conv_id").cast("string").alias("conversation_id"), F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("position"), F.when(F.col("role") == "user", "FACT").otherwise("odd").alias("memory_kind"), F.col("text").alias("content"),
        text.alias("subject"), text.alias("predicate"), text.alias("object_text"), text.alias("world_start"), text.alias("world_end"), F.array(own, own, F.lit("elsewhere")).alias("source_message_ids"), many.alias("entities"), many.alias("keywords"),
        (F.col("turn") / 4).cast("string").alias("importance"), F.lit("bad").alias("confidence"),
    )
    allowed = c.where("role <> 'system'").select(F.col("conv_id").cast("string").alias("session_id"), own.alias("message_id"))
    return cd.admitted(replies, allowed).select("candidate_id", "memory_kind", F.array_join("source_message_ids", ",").alias("sources"), "content_hash", "importance", "confidence")


HASHED_SQL = "v AS (SELECT c_custkey AS id, 'c' || c_nationkey AS conversation_id, substr(sha256(c_mktsegment || (c_custkey // 7)), 1, 16) AS content_hash, CASE WHEN c_acctbal < 0 THEN 5 END AS system_to FROM customer)"


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("c_mktsegment", F.floor(F.col("c_custkey") / 7).cast("string"))
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("version_id"), F.concat(F.lit("c"), F.col("c_nationkey").cast("string")).alias("conversation_id"), F.substring(F.sha2(text, 256), 1, 16).alias("content_hash"),
        F.lit(1).alias("system_from"), F.when(F.col("c_acctbal") < 0, 5).alias("system_to"), F.lit(None).cast("string").alias("end_reason"),
    )


@query(
    "standalone_insert",
    f"WITH {HASHED_SQL}, n AS (SELECT DISTINCT 'c' || s_nationkey AS conversation_id, substr(sha256('BUILDING' || (s_suppkey // 7)), 1, 16) AS content_hash FROM supplier) "
    "SELECT conversation_id, content_hash, count(*) AS n FROM (SELECT conversation_id, content_hash FROM v UNION ALL SELECT conversation_id, content_hash FROM n WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.conversation_id = n.conversation_id AND v.content_hash = n.content_hash AND system_to IS NULL)) t GROUP BY 1, 2",
)
def standalone_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions whose text is active in their conversation already are not inserted again."""
    text = F.concat(F.lit("BUILDING"), F.floor(F.col("s_suppkey") / 7).cast("string"))
    new = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("version_id"), F.concat(F.lit("c"), F.col("s_nationkey").cast("string")).alias("conversation_id"), F.substring(F.sha2(text, 256), 1, 16).alias("content_hash"))
    return rc.inserted(_hashed(spark, sf_dir), new).groupBy("conversation_id", "content_hash").agg(F.count("*").alias("n"))


@query(
    "standalone_close",
    f"WITH {HASHED_SQL} SELECT CAST(id AS VARCHAR) AS version_id, CASE WHEN system_to IS NULL AND o IS NOT NULL THEN 9 ELSE system_to END AS system_to, CASE WHEN system_to IS NULL AND o IS NOT NULL THEN 'retracted' END AS end_reason FROM v LEFT JOIN (SELECT DISTINCT o_custkey AS o FROM orders WHERE o_orderstatus = 'P') x ON o = id",
)
def standalone_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").cast("string").alias("version_id"), F.lit(9).alias("commit_id"), F.lit("retracted").alias("end_reason")).distinct()
    return rc.closed(_hashed(spark, sf_dir), asked).select("version_id", "system_to", "end_reason")


TRACE_SQL = f"""h AS (SELECT l_orderkey AS run_id, l_linenumber AS rank, CASE l_returnflag WHEN 'A' THEN 'source' WHEN 'N' THEN 'external' ELSE 'version' END AS kind, CAST(l_partkey AS VARCHAR) AS id, l_mode AS mode FROM {LINES_SQL})"""


def _traced(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    prefix = F.when(F.col("l_returnflag") == "A", "source:").when(F.col("l_returnflag") == "N", "mem0:").otherwise("")
    lines = order_lines(spark, sf_dir).withColumn("evidence_id", F.concat(prefix, F.col("l_partkey").cast("string"))).withColumn("run_id", F.col("l_orderkey"))
    hits = lines.select("run_id", F.lit("a").alias("action_id"), "evidence_id", F.col("l_linenumber").alias("rank"), F.lit(1.0).alias("score"))
    context = lines.where("l_mode IN ('AIR', 'RAIL')").select("run_id", F.col("l_linenumber").alias("context_index"), "evidence_id", F.lit("x").alias("text"))
    evidence = lines.where("l_mode = 'AIR'").select("run_id", F.col("l_linenumber").alias("evidence_index"), "evidence_id")
    part = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").cast("string").alias("id"))
    return rc.access_trace(hits, context, evidence, part.withColumnRenamed("id", "version_id"), part.withColumnRenamed("id", "message_id"))


@query("access_trace_workspace", f"WITH {TRACE_SQL} SELECT run_id, kind, id, rank, EXISTS (SELECT 1 FROM h c WHERE c.run_id = h.run_id AND c.kind = h.kind AND c.id = h.id AND c.mode IN ('AIR', 'RAIL')) AS kept_in_workspace FROM h")
def access_trace_workspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked hits by kind of id, and whether the answer's context shows them."""
    return _traced(spark, sf_dir)["hits"].select("run_id", "kind", "id", "rank", "kept_in_workspace")


@query("access_trace_evidence", f"WITH {TRACE_SQL} SELECT run_id, kind, id, min(rank) AS evidence_index FROM h WHERE mode = 'AIR' AND (kind = 'external' OR id IN (SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE p_size > 10)) GROUP BY 1, 2, 3")
def access_trace_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence whose version or message is not stored is left out."""
    return _traced(spark, sf_dir)["evidence"].select("run_id", "kind", "id", "evidence_index")


@query("used_versions", f"WITH {TRACE_SQL} SELECT o_custkey AS conversation_id, id AS version_id, count(DISTINCT run_id) AS times FROM h JOIN orders ON o_orderkey = run_id WHERE mode = 'AIR' AND kind = 'version' AND id IN (SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE p_size > 10) AND o_orderstatus = 'F' GROUP BY 1, 2")
def used_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("conversation_id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("running").alias("status"))
    return rc.used_versions(_traced(spark, sf_dir)["evidence"], runs)


@query(
    "qa_gold_bridge",
    "WITH c AS (SELECT user_id AS qa_id, max_by(event_type, event_id) AS question, max(event_id) AS e FROM events GROUP BY 1) SELECT DISTINCT qa_id, unnest([question, CAST(e % 3 AS VARCHAR)]) AS message_id FROM c",
)
def qa_gold_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases upserted in the order of events, and their gold messages."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("qa_id"), "event_id", F.array("event_type", (F.col("event_id") % 3).cast("string")).alias("gold_message_ids"))
    last = store.latest(e, ["qa_id"], F.desc("event_id"))
    first = store.latest(e, ["qa_id"], F.col("event_id"))
    return rc.qa_cases(first, last)[1]


@query("skill_traces", "SELECT o_orderkey AS commit_id, o_custkey AS conversation_id FROM orders WHERE o_orderkey <= (SELECT max(o_orderkey) // 2 FROM orders) AND o_orderkey IN (SELECT l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 40)")
def skill_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commits up to a point that processed one of the (large) parts."""
    commits = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("commit_id"), F.col("o_custkey").alias("conversation_id"))
    inputs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("commit_id"), F.col("l_partkey").alias("message_id"))
    return rc.skill_traces(commits, inputs, table(spark, sf_dir, "part").where("p_size > 40").select(F.col("p_partkey").alias("message_id")), table(spark, sf_dir, "orders").agg(F.floor(F.max("o_orderkey") / 2)).first()[0])


@query(
    "inspect_chain",
    f"""WITH {VERSIONS_SQL}, {MESSAGES_SQL}, e AS (SELECT event_id AS version_id, conv_id AS c FROM events JOIN (SELECT DISTINCT conv_id FROM conversations) x ON conv_id = event_id % 50), a AS (SELECT user_id % 10 AS conversation_id, user_id AS memory_id, max(event_id) // 2 AS as_of FROM events GROUP BY 1, 2)
SELECT v.memory_id, v.version_id, version_no, count(m.message_id) AS n_sources, min(m.message_id) AS first_source FROM versions v JOIN a ON a.conversation_id = v.conversation_id AND a.memory_id = v.memory_id AND v.system_from <= as_of LEFT JOIN e ON e.version_id = v.version_id LEFT JOIN messages m ON m.conv_id = e.c GROUP BY 1, 2, 3""",
)
def inspect_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each memory's versions up to half its life, with their source messages."""
    events = table(spark, sf_dir, "events")
    asked = events.groupBy((F.col("user_id") % 10).alias("conversation_id"), F.col("user_id").alias("memory_id")).agg(F.floor(F.max("event_id") / 2).alias("as_of"))
    said = messages(spark, sf_dir)
    edges = events.select(F.col("event_id").alias("version_id"), (F.col("event_id") % 50).alias("conv_id")).join(said, "conv_id").select("version_id", "message_id")
    found = rc.inspected(versions(spark, sf_dir).withColumn("content", F.col("kind")), edges, said.select("message_id", F.col("role").alias("content")), asked)
    return found.select("memory_id", "version_id", "version_no", F.size("sources").cast("long").alias("n_sources"), F.get(F.col("sources"), F.lit(0))["message_id"].alias("first_source"))


@query("version_examples", "SELECT version_id, place, message_id FROM (SELECT *, row_number() OVER (PARTITION BY version_id ORDER BY message_id) AS place FROM (SELECT DISTINCT l_suppkey AS version_id, l_partkey AS message_id FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 25) t) x WHERE place <= 6")
def version_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("version_id"), F.col("l_partkey").alias("message_id"))
    return rc.examples(lines, table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("message_id"))).select("version_id", "place", "message_id")


@query(
    "inherited_as_of",
    f"WITH {VERSIONS_SQL}, cut AS (SELECT max(event_id) // 2 AS c FROM events) SELECT conversation_id, event_id // 4 AS message_id, min(version_no) AS depth FROM versions JOIN events ON event_id = version_id, cut WHERE system_from <= c AND (system_to IS NULL OR system_to > c) GROUP BY 1, 2",
)
def inherited_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages that the versions in force at half of all commits rest on."""
    half = table(spark, sf_dir, "events").agg(F.floor(F.max("event_id") / 2)).first()[0]
    v = versions(spark, sf_dir)
    closure = v.select("version_id", F.floor(F.col("version_id") / 4).alias("message_id"), F.col("version_no").alias("depth"))
    return rc.inherited_as_of(closure, v, F.lit(half))


@query(
    "current_search_chain",
    "SELECT o_orderkey AS run_id, coalesce(string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) FILTER (WHERE l_returnflag <> 'R' AND l_partkey IS NOT NULL), '') AS ids FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1",
)
def current_search_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search steps without the hits that are no longer current."""
    # a hit without a part is none; lines that agree in all that names a hit share its flag, so they stay or go together
    name = F.concat_ws("/", F.col("l_partkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_extendedprice").cast("string"), "l_returnflag")
    lines = table(spark, sf_dir, "lineitem").where("l_partkey IS NOT NULL").select(F.col("l_orderkey").alias("run_id"), F.struct(F.col("l_linenumber").isNull().alias("last"), "l_linenumber", "l_partkey").alias("k"), name.alias("version_id"), "l_returnflag")
    held = lines.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "version_id"))), lambda x: F.struct(x["version_id"].alias("version_id"))).alias("returned"))
    steps = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.lit(0).alias("step_index")).join(held, "run_id", "left").withColumn("returned", F.coalesce("returned", F.expr("cast(array() as array<struct<version_id:string>>)")))
    found = rc.current_chain(steps, lines.where("l_returnflag <> 'R'").select("run_id", "version_id"))
    return found.select("run_id", F.array_join(F.transform("returned_version_ids", lambda x: F.split_part(x, F.lit("/"), F.lit(1))), ",").alias("ids"))


RELATED_SQL = r"""c AS (SELECT s_suppkey AS candidate_id, substr(sha256(s_name), 1, 16) AS h, 'n' || s_nationkey AS subject, CASE WHEN s_suppkey % 2 = 0 THEN 'near' END AS predicate, lower(lpad(CAST(s_suppkey AS VARCHAR), 4, '0')) AS e FROM supplier),
m AS (SELECT c_custkey AS version_id, substr(sha256(replace(c_name, 'Customer', 'Supplier')), 1, 16) AS h, 'n' || c_nationkey AS subject, CASE WHEN c_custkey % 3 = 0 THEN 'near' ELSE 'far' END AS predicate, lower(c_name) AS low, lower(c_mktsegment) AS e FROM customer),
r AS (SELECT candidate_id, version_id, 1 AS k, 'hash' AS path, row_number() OVER (PARTITION BY candidate_id ORDER BY version_id) AS n FROM c JOIN m USING (h)
 UNION ALL SELECT candidate_id, version_id, 2, 'slot', row_number() OVER (PARTITION BY candidate_id ORDER BY version_id) FROM c JOIN m ON m.subject = c.subject AND m.predicate = c.predicate
 UNION ALL SELECT candidate_id, version_id, 3, 'entity', row_number() OVER (PARTITION BY candidate_id ORDER BY version_id) FROM c JOIN m ON contains(m.subject || chr(10) || low, c.e) OR m.e = c.e),"""


@query(
    "related_memories",
    rf"""WITH {RELATED_SQL}
g AS (SELECT candidate_id, version_id, count(*) AS p, string_agg(path, ',' ORDER BY k) AS paths FROM r WHERE n <= 5 GROUP BY 1, 2)
SELECT candidate_id, place, version_id, paths FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY p DESC, version_id) AS place FROM g) t WHERE place <= 8""",
)
def related_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories (customers) related to candidates (suppliers) by text, slot or entity."""
    return rc.related(*_related_inputs(spark, sf_dir), 5).select("candidate_id", "place", "version_id", "paths")


def _related_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    digest = lambda c: F.substring(F.sha2(c, 256), 1, 16)
    c = table(spark, sf_dir, "supplier").select(
        F.lit(0).alias("scope"), F.col("s_suppkey").alias("candidate_id"), digest(F.col("s_name")).alias("content_hash"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("subject"),
        F.when(F.col("s_suppkey") % 2 == 0, "near").alias("predicate"), F.array(F.lpad(F.col("s_suppkey").cast("string"), 4, "0")).alias("entities"),
    )
    m = table(spark, sf_dir, "customer").select(
        F.lit(0).alias("scope"), F.col("c_custkey").alias("version_id"), digest(F.replace(F.col("c_name"), F.lit("Customer"), F.lit("Supplier"))).alias("content_hash"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("subject"),
        F.when(F.col("c_custkey") % 3 == 0, "near").otherwise("far").alias("predicate"), F.array("c_mktsegment").alias("entities"), F.col("c_name").alias("content"),
    )
    return c, m


@query(
    "related_semantic",
    rf"""WITH {RELATED_SQL}
v AS (SELECT vec_id, embedding, (SELECT count(*) FROM embeddings) AS n FROM embeddings),
x AS (SELECT s_suppkey AS candidate_id, c_custkey AS version_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS score FROM supplier JOIN v a ON a.vec_id = s_suppkey % a.n, customer JOIN v b ON b.vec_id = c_custkey % b.n),
e AS (SELECT candidate_id, version_id, k, path, 1.0 AS score FROM r WHERE n <= 5
 UNION ALL SELECT candidate_id, version_id, 4, 'semantic', score FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY score DESC, version_id) AS n FROM x) t WHERE n <= 5),
g AS (SELECT candidate_id, version_id, count(*) AS p, string_agg(path, ',' ORDER BY k) AS paths, max(score) AS score FROM e GROUP BY 1, 2)
SELECT candidate_id, place, version_id, paths, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY p DESC, score DESC, version_id) AS place FROM g) t WHERE place <= 8""",
)
def related_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the five memories of the nearest vectors beside the other routes."""
    v = table(spark, sf_dir, "embeddings").select(F.lit(0).alias("scope"), "vec_id", normalized(F.col("embedding")).alias("v"))
    n = max(1, v.count())
    of = lambda name, key, to: table(spark, sf_dir, name).select(F.col(key).alias(to), (F.col(key) % n).alias("vec_id"))
    own = Window.partitionBy("vec_id").orderBy("version_id")  # of the memories of one vector the five first outrank the rest
    few = of("customer", "c_custkey", "version_id").withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= 5)
    # a vector stands under its least memory: outside the five best of these, five memories come before all of its own
    held = few.groupBy("vec_id").agg(F.array_sort(F.collect_list("version_id")).alias("ids")).withColumn("doc_id", F.col("ids")[0])
    asking = of("supplier", "s_suppkey", "candidate_id")
    asked = v.join(asking, "vec_id", "left_semi").select("scope", F.col("vec_id").alias("query_id"), F.lit(0).alias("part"), "v")
    hits = vectors.nearest(v.join(held, "vec_id").select("scope", "doc_id", "v"), asked, 5)
    every = hits.join(held.select("doc_id", "ids"), "doc_id").select("query_id", F.explode("ids").alias("version_id"), F.round("score", 9).alias("score"))
    best = rt.ranked(every, 5, ["query_id"], key="version_id").select(F.col("query_id").alias("vec_id"), "version_id", "score")
    near = asking.join(best, "vec_id").select("candidate_id", "version_id", "score")
    return rc.related(*_related_inputs(spark, sf_dir), 5, near).select("candidate_id", "place", "version_id", "paths", F.round("score", 6).alias("score"))


@query(
    "related_pool",
    "WITH r AS (SELECT l_suppkey AS batch_id, l_orderkey AS candidate_id, l_linenumber AS place, l_partkey AS version_id, 1 + l_linenumber % 3 AS p, l_discount AS s FROM lineitem), "
    "g AS (SELECT batch_id, version_id, min(CASE WHEN place = 1 THEN candidate_id END) AS first, max(p * 100 + s) AS x FROM r GROUP BY 1, 2) "
    "SELECT batch_id, version_id, place, first IS NOT NULL AS sure FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY first IS NULL, first, x DESC, version_id) AS place FROM g) t WHERE place <= 24",
)
def related_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate's best memory first, then the best of all, 24 a batch."""
    lines = table(spark, sf_dir, "lineitem")
    r = lines.select(F.col("l_suppkey").alias("batch_id"), F.col("l_orderkey").alias("seq"), F.col("l_linenumber").alias("place"), F.col("l_partkey").alias("version_id"), (1 + F.col("l_linenumber") % 3).alias("n_paths"), F.col("l_discount").alias("score"))
    return rc.pool(dealt(r, lines.count(), "batch_id"))


@query("judged_predictions", "SELECT o_orderkey AS qa_id, o_custkey AS conversation_id, CASE WHEN o_totalprice > 150000 THEN 'C' WHEN o_totalprice > 80000 THEN 'P' ELSE 'I' END AS label FROM orders")
def judged_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions with their one judgment each; a missing or repeated one would raise."""
    o = table(spark, sf_dir, "orders")
    label = F.when(F.col("o_totalprice") > 150000, "C").when(F.col("o_totalprice") > 80000, "P").otherwise("I")
    return rc.judged(o.select(F.col("o_orderkey").alias("qa_id"), F.col("o_custkey").alias("conversation_id")), o.select(F.col("o_orderkey").alias("qa_id"), label.alias("label")))


@query("work_items", "SELECT o_custkey AS conversation_id, o_orderkey AS qa_id, CASE WHEN o_totalprice > 80000 THEN 'P' ELSE 'I' END AS label, o_orderpriority AS question FROM orders WHERE o_totalprice <= 150000 AND o_orderstatus <> 'P'")
def work_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is to be diagnosed: answers judged not correct, without errors, with their question."""
    o = table(spark, sf_dir, "orders").withColumn("qa_id", F.col("o_orderkey"))
    label = F.when(F.col("o_totalprice") > 150000, "C").when(F.col("o_totalprice") > 80000, "P").otherwise("I")
    found = rc.work_items(o.select("qa_id", F.col("o_custkey").alias("conversation_id"), F.when(F.col("o_orderstatus") == "P", "failed").alias("error")), o.select("qa_id", label.alias("label"), F.lit("r").alias("reason")), o.select("qa_id", F.col("o_orderpriority").alias("question")))
    return found.select("conversation_id", "qa_id", "label", "question")


INFO_SQL = "info AS (SELECT c_custkey AS qa_id, c_name AS question, c_mktsegment AS reference, true AS from_dataset FROM customer WHERE c_acctbal > 2000 UNION ALL SELECT o_custkey, min_by(o_orderpriority, o_orderkey), min_by(o_orderstatus, o_orderkey), false FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 2000) GROUP BY 1)"


def _info(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "customer").where("c_acctbal > 2000").select(F.col("c_custkey").alias("qa_id"), F.col("c_name").alias("question"), F.col("c_mktsegment").alias("reference"))
    runs = table(spark, sf_dir, "orders").select(F.lit("run").alias("run"), F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("qa_id"), F.col("o_orderpriority").alias("question"), F.col("o_orderstatus").alias("reference"))
    return rc.question_info(known, runs)


@query("question_info", f"WITH {INFO_SQL} SELECT * FROM info")
def question_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions by the dataset, else as first seen over the runs."""
    return _info(spark, sf_dir)


@query(
    "flip_items",
    f"WITH {INFO_SQL}, c AS (SELECT 'chain' || n_regionkey AS chain, min(n_name) AS ok, max(n_name) AS bad FROM nation GROUP BY 1), e AS (SELECT 'chain' || l_suppkey % 7 AS chain, ['C2W', 'W2C', 'W2W', 'C2C'][l_linenumber % 4 + 1] AS direction, o_custkey AS qa_id, CASE WHEN l_returnflag = 'A' THEN l_mode END AS given, l_linenumber AS age FROM {LINES_SQL} JOIN orders ON o_orderkey = l_orderkey) "
    "SELECT e.qa_id, e.chain, direction, coalesce(given, CASE WHEN direction = 'W2W' THEN ok ELSE ok END) AS first_run, bad AS second_run, CASE WHEN direction = 'W2W' THEN greatest(1, age - 3) END AS failure_age, coalesce(question, '') AS question FROM e JOIN c USING (chain) LEFT JOIN info ON info.qa_id = e.qa_id WHERE direction <> 'C2C'",
)
def flip_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed flips with their chain's defaults and question; entries of unknown chains and kinds are left out."""
    chains = table(spark, sf_dir, "nation").groupBy(F.concat(F.lit("chain"), F.col("n_regionkey").cast("string")).alias("chain")).agg(F.min("n_name").alias("correct_run"), F.max("n_name").alias("wrong_run")).withColumns({"from_run": F.col("correct_run"), "to_run": F.col("wrong_run")})
    lines = order_lines(spark, sf_dir).join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    way = F.get(F.array(*[F.lit(x) for x in ("C2W", "W2C", "W2W", "C2C")]), (F.col("l_linenumber") % 4).cast("int"))
    given, none = F.when(F.col("l_returnflag") == "A", F.col("l_mode")), F.lit(None).cast("string")
    entries = lines.select(
        F.concat(F.lit("chain"), (F.col("l_suppkey") % 7).cast("string")).alias("chain"), way.alias("direction"), F.col("o_custkey").alias("qa_id"), given.alias("ok_run"), none.alias("wrong_run"), given.alias("before_run"), none.alias("after_run"), (F.col("l_linenumber") - 3).alias("failure_age")
    )
    found = rc.flip_items(chains, entries, _info(spark, sf_dir))
    return found.select("qa_id", "chain", "direction", F.coalesce("before_run", "ok_run").alias("first_run"), F.coalesce("after_run", "bad_run").alias("second_run"), "failure_age", "question")


@query(
    "contrastive_cases",
    "WITH p AS (SELECT DISTINCT o_orderkey, o_orderstatus, l_linestatus FROM orders JOIN lineitem ON l_orderkey = o_orderkey) SELECT o_orderstatus || '__' || o_orderkey AS case_key, CASE o_orderstatus WHEN 'F' THEN 'C2W' WHEN 'O' THEN 'W2W' ELSE 'W2C' END AS direction, string_agg(CASE l_linestatus WHEN 'F' THEN 'construction' ELSE 'access' END, ',' ORDER BY l_linestatus) AS sides, "
    "CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS direction_rank FROM p GROUP BY o_orderkey, o_orderstatus",
)
def contrastive_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The projections of a case together, construction first, regressions before improvements."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linestatus").distinct()
    way = F.when(F.col("o_orderstatus") == "F", "C2W").when(F.col("o_orderstatus") == "O", "W2W").otherwise("W2C")
    packages = table(spark, sf_dir, "orders").join(lines, "o_orderkey").select(F.col("o_orderstatus").alias("chain"), F.col("o_orderkey").cast("string").alias("qa_id"), way.alias("direction"), F.when(F.col("l_linestatus") == "F", "construction").otherwise("access").alias("side"))
    return rc.contrastive_cases(packages).select("case_key", "direction", F.array_join("sides", ",").alias("sides"), "direction_rank")


@query(
    "evidence_repair",
    "WITH h AS (SELECT DISTINCT l_orderkey AS run_id, CAST(l_partkey AS VARCHAR) AS memory_id, l_partkey || '_v' || l_linenumber AS version_id, l_linenumber AS rank FROM lineitem), e AS (SELECT l_orderkey AS run_id, l_linenumber AS position, CASE WHEN l_returnflag = 'A' THEN CAST(l_partkey AS VARCHAR) WHEN l_returnflag = 'N' THEN l_partkey || '_v' || l_linenumber ELSE 'none' END AS evidence_id FROM lineitem), "
    "f AS (SELECT run_id, memory_id, min_by(version_id, rank) AS found FROM h GROUP BY 1, 2) SELECT e.run_id, position, coalesce(h.version_id, f.found) AS version_id FROM e LEFT JOIN h ON h.run_id = e.run_id AND h.version_id = evidence_id LEFT JOIN f ON f.run_id = e.run_id AND f.memory_id = evidence_id WHERE coalesce(h.version_id, f.found) IS NOT NULL",
)
def evidence_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memory ids among the evidence become the first version returned for them; unknown ids go."""
    own = F.concat_ws("_v", F.col("l_partkey").cast("string"), F.col("l_linenumber").cast("string"))
    lines = table(spark, sf_dir, "lineitem")
    hits = lines.select(F.col("l_orderkey").alias("run_id"), F.col("l_partkey").cast("string").alias("memory_id"), own.alias("version_id"), F.lit(0).alias("step_index"), F.col("l_linenumber").alias("rank"))
    cited = F.when(F.col("l_returnflag") == "A", F.col("l_partkey").cast("string")).when(F.col("l_returnflag") == "N", own).otherwise("none")
    return cd.repaired(lines.select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("position"), cited.alias("evidence_id")), hits)


@query("existence_lookup", f"WITH {MESSAGES_SQL} SELECT event_id, event_id IN (SELECT message_id FROM messages) AS known, user_id IN (SELECT conv_id FROM conversations) AS in_scope FROM events")
def existence_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a message is stored, and whether its conversation is."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_id").alias("message_id"), F.col("user_id").alias("conv_id"))
    known = messages(spark, sf_dir).select("message_id").distinct().withColumn("known", F.lit(True))
    scope = table(spark, sf_dir, "conversations").select("conv_id").distinct().withColumn("in_scope", F.lit(True))
    out = e.join(known, "message_id", "left").join(scope, "conv_id", "left")
    return out.select("event_id", F.coalesce("known", F.lit(False)).alias("known"), F.coalesce("in_scope", F.lit(False)).alias("in_scope"))


@query("sanitized_memories", f"WITH {VERSIONS_SQL} SELECT version_id, memory_id, kind FROM versions")
def sanitized_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories with the shown fields only."""
    held = versions(spark, sf_dir).select(F.struct("version_id", "memory_id", "kind", "props", "value").alias("m"))
    return held.select(rc.sanitized(F.col("m"), ("version_id", "memory_id", "kind")).alias("m")).select("m.*")


@query("snapshot_vectors", f"WITH {VERSIONS_SQL} SELECT version_id, memory_id, len(embedding) AS dim FROM versions JOIN embeddings ON vec_id = version_id % (SELECT count(*) FROM embeddings) WHERE system_to IS NULL")
def snapshot_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of the versions in force."""
    held = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    return store.snapshot(versions(spark, sf_dir)).select("version_id", "memory_id", (F.col("version_id") % max(1, held.count())).alias("vec_id")).join(held, "vec_id").select("version_id", "memory_id", F.size("v").alias("dim"))


@query("payload_scan", "SELECT vec_id AS point_id, label FROM embeddings")
def payload_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payload of a vector store; the scan never reads a vector."""
    return artifacts.payloads(table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "point_id"), ["label"])


@query("keep_first_failures", "SELECT user_id, event_type, min(event_id) AS event_id FROM events WHERE event_type <> 'view' GROUP BY 1, 2")
def keep_first_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An append log in which the first row of a failure stays."""
    log = table(spark, sf_dir, "events").where("event_type <> 'view'")
    return store.latest(log, ["user_id", "event_type"], F.col("event_id")).select("user_id", "event_type", "event_id")


@query(
    "interactive_budget",
    "WITH a AS (SELECT user_id AS run_id, event_id AS step, CASE event_type WHEN 'click' THEN 'search' WHEN 'view' THEN 'inspect' ELSE 'answer' END AS action, event_id % 13 AS version_id FROM events), "
    "n AS (SELECT *, row_number() OVER (PARTITION BY run_id, action ORDER BY step) AS n FROM a), k AS (SELECT * FROM n WHERE n <= CASE action WHEN 'search' THEN 4 WHEN 'inspect' THEN 3 ELSE 1 END) "
    "SELECT run_id, version_id, min(step) AS first_step FROM k WHERE action <> 'answer' GROUP BY 1, 2",
)
def interactive_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded actions within their budgets (four searches, three inspections) and the hits as first seen."""
    kind = F.when(F.col("event_type") == "click", "search").when(F.col("event_type") == "view", "inspect").otherwise("answer")
    actions = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("step"), kind.alias("action"), F.array(F.col("event_id") % 13).alias("returned"))
    return rc.first_seen(rc.within_budget(actions, {"search": 4, "inspect": 3, "answer": 1}).where("action <> 'answer'"))


@query("stable_hashes", """SELECT event_id, substr(sha256('{"k":' || json_extract_string(props, '$.k') || ',"type":"' || event_type || '"}'), 1, 16) AS digest FROM events""")
def stable_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of records by their sorted JSON."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", scalars.stable_hash({"type": F.col("event_type"), "k": F.get_json_object("props", "$.k").cast("long")}).alias("digest"))
