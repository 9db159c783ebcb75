"""Queries at the borders of the model calls: replies, made of table rows, become checked rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import scalars
from ..io import table
from ..operators import candidates as cd
from ..operators import replies as rp
from ..operators.graph import dealt
from ..operators import skills as sk
from .views import LINES_SQL, order_lines

KINDS_SQL = ", ".join(f"'{k}'" for k in cd.KINDS)
#: Distinct values of a list in their first order.
FIRST_SQL = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"


@query(
    "access_plan",
    r"""WITH r AS (SELECT event_id, event_type AS question, CASE WHEN event_id % 3 = 0 THEN [] ELSE ['a', ' b ', '', 'c', 'd'] END AS q, event_id % 2 = 0 AS src, CASE event_type WHEN 'click' THEN 'RANGE' WHEN 'view' THEN 'before' ELSE 'whenever' END AS mode, CASE WHEN event_id % 5 = 0 THEN '  ' ELSE '2024-01/2024-03' END AS target FROM events)
SELECT event_id, CASE WHEN len(q) > 0 THEN 'a,b,c' WHEN src THEN question ELSE '' END AS queries, CASE mode WHEN 'RANGE' THEN 'range' WHEN 'before' THEN 'before' ELSE 'none' END AS time_mode, nullif(trim(target), '') AS target_time,
CASE WHEN mode = 'RANGE' AND trim(target) <> '' THEN '2024-01' ELSE nullif(trim(target), '') END AS split_target, CASE WHEN mode = 'RANGE' AND trim(target) <> '' THEN '2024-03' END AS split_end FROM r""",
)
def access_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans of the second round: caps, enumerations, defaults, and a range in one text split in two."""
    e = table(spark, sf_dir, "events")
    many, text = F.lit(None).cast("array<string>"), F.lit(None).cast("string")
    raw = e.select(
        "event_id", F.col("event_type").alias("question"), F.when(F.col("event_id") % 3 == 0, many).otherwise(F.array(*[F.lit(x) for x in ("a", " b ", "", "c", "d")])).alias("additional_queries"), many.alias("keywords"), many.alias("entities"),
        F.lit(None).cast("boolean").alias("include_history"), (F.col("event_id") % 2 == 0).alias("include_sources"), F.when(F.col("event_type") == "click", "RANGE").when(F.col("event_type") == "view", "before").otherwise("whenever").alias("time_mode"),
        F.when(F.col("event_id") % 5 == 0, "  ").otherwise("2024-01/2024-03").alias("target_time"), text.alias("target_time_end"), many.alias("evidence_requirements"),
    )
    split = rp.time_window(F.col("raw_mode"), F.col("raw_target"), F.lit(None).cast("string"))
    planned = rp.access_plan(raw.withColumns({"raw_mode": F.col("time_mode"), "raw_target": F.col("target_time")}))
    return planned.select("event_id", F.array_join("additional_queries", ",").alias("queries"), "time_mode", "target_time", split["target"].alias("split_target"), split["target_end"].alias("split_end"))


@query(
    "requested_kinds",
    f"SELECT doc_id, array_to_string(CASE WHEN len(list_filter([source, 'event', lang], lambda k: k IN ({KINDS_SQL}))) > 0 AND doc_id % 2 = 0 THEN ['event'] END, ',') AS kinds FROM documents",
)
def requested_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds that exist; where none does there is no filter."""
    asked = F.when(F.col("doc_id") % 2 == 0, F.array("source", F.lit("event"), F.lit("event"), "lang")).otherwise(F.array("source", "lang"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(rp.known_kinds(asked), ",").alias("kinds"))


@query(
    "external_query",
    "SELECT o_orderkey, concat_ws(chr(10), trim(o_orderpriority), CASE WHEN o_orderstatus <> trim(o_orderpriority) THEN o_orderstatus END, 'Exact anchors: ' || CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus || ', x' ELSE 'x' END, CASE WHEN o_orderkey % 3 = 0 THEN 'Target time: 2024' END) AS query FROM orders",
)
def external_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that an external search is asked."""
    o, none = table(spark, sf_dir, "orders"), F.lit(None).cast("string")
    words = F.when(F.col("o_orderkey") % 2 == 0, F.array("o_orderstatus", F.lit(" x "))).otherwise(F.array(F.lit("x"), F.lit("")))
    asked = rp.external_query(F.col("o_orderpriority"), F.array("o_orderstatus", "o_orderpriority"), words, F.array(F.lit("x")), F.when(F.col("o_orderkey") % 3 == 0, "2024"), none)
    return o.select("o_orderkey", asked.alias("query"))


@query(
    "external_hits",
    "SELECT event_id, 'mem0:' || CASE WHEN event_id % 4 = 0 THEN 'rank-' || event_id ELSE CAST(event_id AS VARCHAR) END AS version_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE '' END AS content, CASE WHEN event_id % 3 = 0 THEN 'plan' ELSE 'fact' END AS memory_kind, "
    "CASE WHEN event_id % 3 = 1 THEN '2024' ELSE CAST(user_id AS VARCHAR) END AS world_start, CASE WHEN event_id % 5 = 0 THEN 'm1,m2' WHEN event_id % 5 = 1 THEN 'plain' ELSE '' END AS sources, CASE WHEN event_id % 2 = 0 THEN 0.0 ELSE 0.25 END AS score, CASE WHEN event_id % 2 = 0 THEN 0.5 ELSE 0.25 END AS confidence FROM events",
)
def external_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an external search, with their fallbacks, as hits."""
    k, none = F.col("event_id"), F.lit(None).cast("string")
    meta = F.create_map(
        F.lit("memory_kind"), F.when(k % 3 == 0, "plan"), F.lit("session_time"), F.when(k % 3 == 1, "2024"), F.lit("source_message_ids"), F.when(k % 5 == 0, '["m1","m2"]').when(k % 5 == 1, "plain")
    )
    rows = table(spark, sf_dir, "events").select(
        "event_id", k.alias("rank"), F.when(k % 4 != 0, k.cast("string")).alias("id"), none.alias("memory_id"), none.alias("memory"), F.when(k % 2 == 0, F.col("event_type")).alias("data"), F.when(k % 2 == 1, 0.25).alias("score"), F.col("user_id").cast("string").alias("created_at"),
        F.lit(None).cast("array<string>").alias("categories"), meta.alias("metadata"),
    )
    return rp.external_hits(rows).select("event_id", "version_id", "content", "memory_kind", "world_start", F.array_join("source_message_ids", ",").alias("sources"), "score", "confidence")


@query(
    "single_pass_answers",
    "SELECT o_orderkey AS run_id, CASE WHEN o_orderstatus = 'P' THEN 'No information available.' ELSE o_orderpriority END AS answer, coalesce(l.n, 0) AS n_context, CASE WHEN l.first IS NOT NULL THEN CAST(l.first AS VARCHAR) ELSE '' END AS evidence FROM orders "
    "LEFT JOIN (SELECT l_orderkey, count(*) AS n, min_by(l_partkey, l_linenumber * 1000000 + l_partkey) AS first FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey",
)
def single_pass_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search, one answer: evidence must have been shown, an empty answer is the refusal."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("rank"), F.col("l_partkey").cast("string").alias("version_id"))
    first = lines.groupBy("run_id").agg(F.min_by("version_id", "rank").alias("v"))
    told = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "run_id").join(first, "run_id", "left")
    answers = told.select("run_id", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).otherwise("  ").alias("answer"), F.array("v", F.lit("unseen")).alias("evidence"))
    return rp.single_pass(lines, answers, cd.REFUSAL).select("run_id", "answer", F.size("context").cast("long").alias("n_context"), F.array_join("evidence", ",").alias("evidence"))


@query(
    "judge_batches",
    f"WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_mode = 'AIR' THEN 'X' ELSE l_linestatus END AS label, l_mode FROM {LINES_SQL}), f AS (SELECT l_orderkey, bool_and(label IN ('O', 'F')) AS fit FROM r GROUP BY 1) "
    "SELECT l_orderkey * 10 + l_linenumber AS qa_id, CASE WHEN fit THEN label END AS label, CASE WHEN fit THEN l_mode END AS reason, NOT fit AS fallback FROM r JOIN f USING (l_orderkey)",
)
def judge_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgments of a batch count if all its items come back in order with a known label."""
    key = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("qa_id")
    lines = order_lines(spark, sf_dir).select(F.col("l_orderkey").alias("batch_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount").alias("position"), key, F.when(F.col("l_mode") == "AIR", "X").otherwise(F.concat(F.lower("l_linestatus"), F.lit(" "))).alias("label"), F.col("l_mode").alias("reason"))
    return rp.judgments(lines.select("batch_id", "position", "qa_id"), lines, ("O", "F"))


DIAGNOSIS_SQL = """d AS (SELECT o_orderkey AS run_id, CASE o_orderstatus WHEN 'F' THEN 'C' WHEN 'O' THEN 'P' ELSE 'I' END AS judge_label, o_orderkey % 3 > 0 AS asked, o_orderkey % 7 = 0 AS contradiction, o_orderkey % 2 = 0 AS abstain, CASE WHEN o_orderkey % 5 = 0 THEN 'OTHER' ELSE 'WRONG_DATE' END AS failure_mode, o_custkey % 2 = 0 AS learn FROM orders),
c AS (SELECT l_orderkey AS run_id, bool_and(l_linestatus = 'F' AND l_quantity > 5) AS full_claims FROM lineitem GROUP BY 1), s AS (SELECT d.*, (CASE WHEN asked THEN coalesce(full_claims, false) ELSE abstain END) AND NOT contradiction AS sufficient FROM d LEFT JOIN c USING (run_id))"""


@query("answer_diagnosis", f"WITH {DIAGNOSIS_SQL} SELECT run_id, sufficient, judge_label <> 'C' AND sufficient AS problem, failure_mode, judge_label <> 'C' AND sufficient AND learn AND failure_mode <> 'OTHER' AS learnable FROM s")
def answer_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the answer, given a sufficient context, is to blame, and whether a skill could learn from it."""
    k = F.col("o_orderkey")
    reports = table(spark, sf_dir, "orders").select(
        k.alias("run_id"), F.when(F.col("o_orderstatus") == "F", "C").when(F.col("o_orderstatus") == "O", "P").otherwise("I").alias("judge_label"), F.when(k % 3 > 0, "x").otherwise(" ").alias("reference"), (k % 7 == 0).alias("contradiction"), (k % 2 == 0).alias("supports_abstention"),
        F.when(k % 5 > 0, " wrong_date ").alias("failure_mode"), F.lit("when").alias("observable_trigger"), F.lit("do").alias("corrective_operation"), (F.col("o_custkey") % 2 == 0).alias("requested_learnable"),
    )
    claims = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.when(F.col("l_linestatus") == "F", "full").otherwise("PARTIAL").alias("coverage"), F.when(F.col("l_quantity") > 5, 1).otherwise(0).alias("n_support"))
    return rp.answer_diagnosis(reports, claims)


@query(
    "access_ladder",
    "SELECT user_id, CASE WHEN n IS NULL THEN 'no_evidence_needed' WHEN m = 0 THEN 'all_returned' WHEN s = 0 THEN 'not_in_store' ELSE 'not_returned' END AS verdict FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE NOT r) AS m, count(*) FILTER (WHERE NOT r AND s) AS s FROM "
    "(SELECT user_id, event_id % 9 AS id, bool_or(value > 40) AS r, bool_or(event_id % 9 > 6) AS s FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) t GROUP BY 1) x USING (user_id)",
)
def access_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an access run missed what it needed, by sets of ids."""
    own, bought = (F.col("event_id") % 9).cast("string"), F.col("event_type") == "purchase"
    runs = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.collect_set(F.when(bought, own)).alias("needed"), F.collect_set(F.when(bought & (F.col("value") > 40), own)).alias("returned"), F.collect_set(F.when(F.col("event_id") % 9 > 6, own)).alias("stored")
    )
    return runs.select("user_id", rp.access_ladder(F.col("needed"), F.col("returned"), F.col("stored")).alias("verdict"))


@query(
    "construction_diagnosis",
    "WITH f AS (SELECT l_orderkey AS qa_id, min(l_linenumber) AS last FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT l_orderkey AS qa_id, l_linenumber AS commit_id, l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN f ON f.qa_id = l_orderkey WHERE o_orderstatus <> 'O' AND (last IS NULL OR l_linenumber <= last)",
)
def construction_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history of screened cases up to the first wrong commit."""
    history = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("qa_id"), F.col("l_linenumber").alias("commit_id"), "l_partkey", "l_returnflag")
    screened = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("qa_id"), (F.col("o_orderstatus") != "O").alias("problem"))
    first = history.where("l_returnflag = 'R'").groupBy("qa_id").agg(F.min("commit_id").alias("commit_id"))
    return rp.construction_history(screened, history, first).select("qa_id", "commit_id", "l_partkey")


@query("diagnosis_routes", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'CONSTRUCTION' WHEN value > 50 THEN 'ACCESS' ELSE 'NONE' END AS route FROM events")
def diagnosis_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", rp.diagnosis_route(F.col("event_type") == "error", F.col("value") > 50).alias("route"))


@query(
    "attributed_claims",
    f"SELECT l_orderkey AS case_id, CASE l_linestatus WHEN 'F' THEN 'access' ELSE 'construction' END AS side, l_mode AS claim, CASE WHEN l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 20) AND l_linestatus = 'F' THEN CAST(l_partkey AS VARCHAR) ELSE '' END AS ids FROM (SELECT DISTINCT l_orderkey, l_linestatus, l_mode, min(l_partkey) OVER (PARTITION BY l_orderkey, l_linestatus, l_mode) AS l_partkey FROM {LINES_SQL}) t",
)
def attributed_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of both sides with the ids that their side may cite."""
    side = F.when(F.col("l_linestatus") == "F", "access").otherwise("construction")
    lines = order_lines(spark, sf_dir).groupBy(F.col("l_orderkey").alias("case_id"), side.alias("side"), F.col("l_mode").alias("claim")).agg(F.min("l_partkey").cast("string").alias("p"))
    large = table(spark, sf_dir, "part").where("p_size > 20").select(F.col("p_partkey").cast("string").alias("p"))
    allowed = lines.where("side = 'access'").join(large, "p").select("case_id", "side", F.col("p").alias("id"))
    return rp.attributed(lines.select("case_id", "side", "claim", F.array("p", "p").alias("ids")), allowed).select("case_id", "side", "claim", F.array_join("ids", ",").alias("ids"))


@query(
    "candidate_generation",
    """WITH c AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'access' ELSE 'construction' END AS side, CASE p_partkey % 4 WHEN 0 THEN 'add' WHEN 1 THEN '' ELSE 'perhaps' END AS said, ['C2W', 'W2C', 'W2W'][p_partkey % 3 + 1] AS transition, p_size % 2 AS related, CASE WHEN p_size > 5 THEN p_name ELSE ' ' END AS solves, p_size > 10 AS whole FROM part)
SELECT p_partkey, CASE WHEN said = 'add' THEN 'ADD' WHEN transition = 'W2C' THEN 'PRESERVE' WHEN related > 0 THEN 'REVISE' ELSE 'ADD' END AS intent, array_to_string(list_filter([CASE WHEN trim(solves) = '' THEN 'solves is empty' END, CASE WHEN side = 'access' AND NOT whole THEN 'no complete mechanism' END], lambda x: x IS NOT NULL), '; ') AS errors FROM c""",
)
def candidate_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intent and errors of generated candidates."""
    k, none = F.col("p_partkey"), F.lit(None).cast("string")
    raw = F.create_map(*[x for f in rp.SIGNATURE for x in (F.lit(f), F.when(F.col("p_size") > 10, "y").otherwise(F.when(F.lit(f) != "failed_behavior", "y")))])
    intent = rp.maintenance_intent(F.when(k % 4 == 0, "add").when(k % 4 == 1, "").otherwise("perhaps"), none, F.get(F.array(F.lit("C2W"), F.lit("W2C"), F.lit("w2w")), (k % 3).cast("int")), F.col("p_size") % 2)
    errors = rp.candidate_errors(F.when(k % 2 == 0, "access").otherwise("construction"), F.when(F.col("p_size") > 5, F.col("p_name")).otherwise(" "), rp.signature(raw), F.array().cast("array<string>"))
    return table(spark, sf_dir, "part").select("p_partkey", intent.alias("intent"), F.array_join(errors, "; ").alias("errors"))


OWNERS_SQL = "own AS (SELECT DISTINCT 'b' || l_suppkey AS bank, 'draft_' || l_linenumber AS draft_id, 'cand_' || l_partkey AS source_id FROM lineitem)"


def _owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    return table(spark, sf_dir, "lineitem").select(name("b", "l_suppkey").alias("bank"), name("draft_", "l_linenumber").alias("draft_id"), name("cand_", "l_partkey").alias("source_id")).distinct()


@query(
    "remapped_sources",
    f"WITH {OWNERS_SQL}, alone AS (SELECT bank, source_id, min(draft_id) AS d FROM own GROUP BY 1, 2 HAVING count(DISTINCT draft_id) = 1), op AS (SELECT 'b' || l_suppkey AS bank, l_orderkey * 10 + l_linenumber AS seq, ['cand_' || l_partkey, 'draft_1', 'nowhere'] AS cited FROM lineitem), "
    "k AS (SELECT DISTINCT bank, draft_id AS id, draft_id AS d FROM own UNION SELECT bank, source_id, d FROM alone), e AS (SELECT bank, seq, unnest(cited) AS id FROM op) SELECT op.bank, op.seq, coalesce(x.ids, '') AS drafts FROM op LEFT JOIN (SELECT bank, seq, string_agg(DISTINCT d, ',' ORDER BY d) AS ids FROM e JOIN k USING (bank, id) GROUP BY 1, 2) x USING (bank, seq)",
)
def remapped_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited sources stand for the draft that alone owns them."""
    lines = table(spark, sf_dir, "lineitem")
    ops = lines.select(F.concat(F.lit("b"), F.col("l_suppkey").cast("string")).alias("bank"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.array(F.concat(F.lit("cand_"), F.col("l_partkey").cast("string")), F.lit("draft_1"), F.lit("nowhere")).alias("cited"))
    return rp.remapped_sources(ops, _owners(spark, sf_dir)).select("bank", "seq", F.array_join("draft_ids", ",").alias("drafts"))


@query(
    "cluster_errors",
    """WITH m AS (SELECT DISTINCT o_custkey AS cluster_id, o_orderkey AS c FROM orders), d AS (SELECT o_custkey AS cluster_id, l_linenumber AS draft, o_orderkey AS c FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'A'), r AS (SELECT o_custkey AS cluster_id, o_orderkey + CASE WHEN o_orderkey % 50 = 0 THEN 1000000000 ELSE 0 END AS c FROM orders WHERE o_orderstatus = 'P'),
s AS (SELECT c_custkey AS cluster_id, CASE WHEN c_nationkey < 12 THEN 'access' ELSE 'construction' END AS side FROM customer)
SELECT DISTINCT cluster_id, 'unknown rejected: ' || c AS error FROM r WHERE c >= 1000000000 UNION SELECT DISTINCT cluster_id, 'used and rejected: ' || c FROM d WHERE (cluster_id, c) IN (SELECT cluster_id, c FROM r) UNION SELECT cluster_id, 'left out: ' || c FROM m WHERE (cluster_id, c) NOT IN (SELECT cluster_id, c FROM d) AND (cluster_id, c) NOT IN (SELECT cluster_id, c FROM r)
UNION SELECT cluster_id, 'too few sources: ' || draft FROM (SELECT cluster_id, draft, count(DISTINCT c) AS n FROM d GROUP BY 1, 2) x JOIN s USING (cluster_id) WHERE side = 'access' AND n < 2 UNION SELECT cluster_id, 'too many drafts: ' || n FROM (SELECT cluster_id, count(DISTINCT draft) AS n FROM d GROUP BY 1) x WHERE n > 5""",
)
def cluster_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the summaries of clusters (customers) of candidates (orders) leave out or contradict."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cluster_id"), F.col("o_orderkey").alias("candidate_id"), "o_orderstatus")
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("candidate_id"), F.col("l_linenumber").alias("draft"))
    out = o.where("o_orderstatus = 'P'").select("cluster_id", F.when(F.col("candidate_id") % 50 == 0, F.col("candidate_id") + 1000000000).otherwise(F.col("candidate_id")).alias("candidate_id"))
    sides = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cluster_id"), F.when(F.col("c_nationkey") < 12, "access").otherwise("construction").alias("side"))
    rows, n = table(spark, sf_dir, "lineitem").count(), o.count()
    drafts = dealt(o, rows, "candidate_id").join(dealt(lines, rows, "candidate_id"), "candidate_id").select("cluster_id", "draft", "candidate_id")
    return dealt(rp.cluster_errors(o, drafts, out, sides), n, "cluster_id", "error").distinct()


@query(
    "policy_errors",
    "WITH n AS (SELECT l_orderkey AS bank, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'N') AS a, count(*) FILTER (WHERE l_returnflag = 'R') AS d FROM lineitem GROUP BY 1), b AS (SELECT n.*, l.s FROM n JOIN (SELECT o_orderkey, o_custkey % 40 AS s FROM orders) l ON o_orderkey = bank) "
    "SELECT bank, 'too many operations' AS error FROM b WHERE n > 3 UNION ALL SELECT bank, 'too many additions' FROM b WHERE a > 1 UNION ALL SELECT bank, 'the bank is full' FROM b WHERE s + a - d > 35",
)
def policy_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("bank"), F.when(F.col("l_returnflag") == "N", "add_skill").when(F.col("l_returnflag") == "R", "delete_skill").otherwise("add_content").alias("operation"))
    banks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("bank"), (F.col("o_custkey") % 40).alias("size"), F.lit(35).alias("cap"))
    return rp.policy_errors(ops, banks)


@query(
    "draft_provenance",
    "WITH c AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'C2W' WHEN 'O' THEN '' ELSE 'W2W' END AS t, o_orderkey % 4 AS age, CASE WHEN o_totalprice > 100000 THEN 'ADD' ELSE 'REVISE' END AS intent FROM orders) "
    "SELECT l_suppkey AS draft_id, coalesce(string_agg(DISTINCT nullif(t, ''), ',' ORDER BY nullif(t, '')), '') AS transitions, max(age) AS failure_age, CASE WHEN count(DISTINCT intent) = 1 THEN min(intent) ELSE 'REVISE' END AS intent FROM lineitem JOIN c ON o_orderkey = l_orderkey GROUP BY 1",
)
def draft_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What drafts (suppliers) inherit from their sources (orders)."""
    k = F.col("o_orderkey")
    held = table(spark, sf_dir, "orders").select(k.alias("candidate_id"), F.when(F.col("o_orderstatus") == "F", "C2W").when(F.col("o_orderstatus") == "O", "").otherwise("W2W").alias("transition"), (k % 4).alias("failure_age"), F.when(F.col("o_totalprice") > 100000, "ADD").otherwise("REVISE").alias("intent"), F.lit("why").alias("why"))
    drafts = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("draft_id"), F.col("l_orderkey").alias("position"), F.col("l_orderkey").alias("candidate_id"))
    return rp.draft_provenance(drafts, held).select("draft_id", "transitions", "failure_age", "intent")


@query(
    "stable_cluster_ids",
    """SELECT o_custkey, 'cluster_' || substr(sha256('["' || string_agg(CAST(o_orderkey AS VARCHAR), '","' ORDER BY CAST(o_orderkey AS VARCHAR)) || '"]'), 1, 10) AS cluster_id FROM orders GROUP BY 1""",
)
def stable_cluster_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of clusters by the set of their members."""
    held = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("ids"))
    return held.select("o_custkey", rp.stable_id(F.lit("cluster"), F.col("ids")).alias("cluster_id"))


PACKAGES_SQL = """p AS (SELECT l_partkey AS diagnosis_id, l_orderkey * 10 + l_linenumber AS position, CASE l_returnflag WHEN 'A' THEN 'ANSWER_FAILURE' WHEN 'N' THEN 'ACCESS_FAILURE' ELSE 'NOTE' END AS kind, CASE WHEN l_linestatus = 'F' THEN 'completed' ELSE 'open' END AS status, l_quantity > 10 AS problem, CASE WHEN l_quantity < 45 THEN false END AS review,
  l_discount > 0.02 AS learnable, l_suppkey AS conversation_id FROM lineitem)"""


@query(
    "package_gate",
    f"WITH {PACKAGES_SQL} SELECT diagnosis_id, min(position) AS position, min_by(kind, position) AS diagnosis_type FROM p WHERE kind IN ('ANSWER_FAILURE', 'ACCESS_FAILURE') AND status = 'completed' AND problem AND review = false AND (kind <> 'ANSWER_FAILURE' OR learnable) AND conversation_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1",
)
def package_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages that may teach, each diagnosis once."""
    kind = F.when(F.col("l_returnflag") == "A", "ANSWER_FAILURE").when(F.col("l_returnflag") == "N", "ACCESS_FAILURE").otherwise("NOTE")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("diagnosis_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"), kind.alias("diagnosis_type"), F.when(F.col("l_linestatus") == "F", "completed").otherwise("open").alias("status"), (F.col("l_quantity") > 10).alias("problem_found"),
        F.when(F.col("l_quantity") < 45, F.lit(False)).alias("review_required"), F.lit(True).alias("sufficient"), (F.col("l_discount") > 0.02).alias("learnable"), F.lit(True).alias("eligible"), F.lit("memory_answering_procedure").alias("failure_scope"), F.col("l_suppkey").alias("conversation_id"),
    )
    train = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("conversation_id"))
    return rp.package_gate(rows, ("ANSWER_FAILURE", "ACCESS_FAILURE"), train).select("diagnosis_id", "position", "diagnosis_type")


@query("diagnosis_eligible", "SELECT event_id, 'legacy' AS rule FROM events WHERE event_type <> 'error' AND value / 100 < 0.5 UNION ALL SELECT event_id, 'judge' FROM events WHERE event_type <> 'error' AND event_type <> 'view'")
def diagnosis_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers worth a diagnosis, by score and by label."""
    e = table(spark, sf_dir, "events")
    rows = e.select("event_id", F.when(F.col("event_type") == "error", "failed").alias("error"), (F.col("value") / 100).alias("f1"), F.when(F.col("event_type") == "view", "C").otherwise("I").alias("label"))
    return rp.eligible(rows, legacy=True).select("event_id", F.lit("legacy").alias("rule")).unionByName(rp.eligible(rows).select("event_id", F.lit("judge").alias("rule")))


@query("source_candidates", "SELECT 'cand_' || o_orderkey AS candidate_id FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 2 = 0 AND o_totalprice < 100000")
def source_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey").cast("string")
    rows = table(spark, sf_dir, "orders").select(
        F.concat(F.when(F.col("o_orderstatus") == "F", "cand_").otherwise("draft_"), k).alias("candidate_id"), F.when(F.col("o_custkey") % 2 == 0, "access").otherwise("construction").alias("side"), F.when(F.col("o_totalprice") >= 100000, "c1").otherwise("").alias("source_cluster_id")
    )
    return rp.source_candidates(rows, "access", "cand_").select("candidate_id")


@query(
    "split_errors",
    "WITH s AS (SELECT o_orderstatus AS set, o_custkey AS unit FROM orders), n AS (SELECT unit, count(*) AS n, count(DISTINCT set) AS sets FROM s GROUP BY 1), k AS (SELECT c_custkey AS unit FROM customer WHERE c_acctbal > -500) "
    "SELECT 'missing' AS error, unit FROM k WHERE unit NOT IN (SELECT unit FROM n) UNION ALL SELECT 'unknown', unit FROM n WHERE unit NOT IN (SELECT unit FROM k) UNION ALL SELECT 'overlap', unit FROM n WHERE sets > 1 UNION ALL SELECT 'duplicate', unit FROM n WHERE n > sets",
)
def split_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("set"), F.col("o_custkey").alias("unit"))
    return rp.split_errors(split, table(spark, sf_dir, "customer").where("c_acctbal > -500").select(F.col("c_custkey").alias("unit")))


@query(
    "nested_skill_ids",
    "SELECT event_id, event_type || CASE WHEN event_type <> CAST(user_id AS VARCHAR) THEN ',' || CAST(user_id AS VARCHAR) END AS ids FROM (SELECT event_id, least(event_type, CAST(user_id AS VARCHAR)) AS event_type, greatest(event_type, CAST(user_id AS VARCHAR)) AS user_id FROM events) t",
)
def nested_skill_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every skill_id in a JSON text, at any depth."""
    nested = F.format_string('{"a": [{"skill_id": "%s", "b": {"skill_id" : "%s", "id": 3}}], "skill_id": ""}', "event_type", F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(rp.keys_anywhere(nested), ",").alias("ids"))


@query("used_skills", "SELECT user_id % 10 AS conversation_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS skills FROM events GROUP BY 1")
def used_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The skills that a conversation used, whatever their version."""
    named = F.concat("event_type", F.lit("_v"), (F.col("event_id") % 4).cast("string"))
    return table(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("conversation_id")).agg(F.array_join(F.array_sort(F.collect_set(scalars.without_version(named))), ",").alias("skills"))


@query("embedding_texts", "SELECT p_partkey, p_name || '. ' || p_type AS text FROM part")
def embedding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", sk.embedding_text(F.col("p_name"), F.col("p_type")).alias("text"))
