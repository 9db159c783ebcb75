"""Queries on the store: snapshots, joins, lineage, change feed, set operations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import scalars
from ..io import table
from ..operators import graph, store
from ..operators.graph import dealt
from ..sources import temporal
from .views import MESSAGES_SQL, SCOPES, VERSIONS_SQL, messages, versions

#: The commit at half of the history, and the one after all.
AS_OF_SQL, NEXT_SQL = "(SELECT max(event_id) // 2 FROM events)", "(SELECT max(event_id) + 1 FROM events)"


def as_of(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "events").agg(F.floor(F.max("event_id") / 2)).first()[0] or 0


@query("snapshot_pruned", f"WITH {VERSIONS_SQL} SELECT version_id, memory_id, version_no, kind FROM versions WHERE system_from <= {AS_OF_SQL} // 4 AND (system_to IS NULL OR system_to > {AS_OF_SQL} // 4)")
def snapshot_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An early snapshot from a layout by eras, of which it opens the folders of its time."""
    half = as_of(spark, sf_dir)
    at, span = f"{graph.shared_folder(spark)}/versions-{uuid.uuid4().hex}", max(1, half // 8)
    temporal.write(versions(spark, sf_dir), at, span)
    return temporal.snapshot(spark, at, span, half // 4).select("version_id", "memory_id", "version_no", "kind")


@query("snapshot_asof", f"WITH {VERSIONS_SQL} SELECT version_id, memory_id, version_no, kind FROM versions WHERE system_from <= {AS_OF_SQL} AND (system_to IS NULL OR system_to > {AS_OF_SQL})")
def snapshot_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.snapshot(versions(spark, sf_dir), None, as_of(spark, sf_dir)).select("version_id", "memory_id", "version_no", "kind")


@query("snapshot_current", f"WITH {VERSIONS_SQL} SELECT version_id, memory_id, version_no FROM versions WHERE system_to IS NULL")
def snapshot_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.snapshot(versions(spark, sf_dir)).select("version_id", "memory_id", "version_no")


@query("snapshot_history", f"WITH {VERSIONS_SQL} SELECT version_id, memory_id, version_no FROM versions WHERE system_from <= {AS_OF_SQL}")
def snapshot_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.snapshot(versions(spark, sf_dir), None, as_of(spark, sf_dir), include_history=True).select("version_id", "memory_id", "version_no")


@query("version_intervals", f"WITH {VERSIONS_SQL} SELECT memory_id, version_no, system_from, system_to, system_to - system_from AS span FROM versions")
def version_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions(spark, sf_dir).select("memory_id", "version_no", "system_from", "system_to", (F.col("system_to") - F.col("system_from")).alias("span"))


@query(
    "uncovered_messages",
    f"WITH {MESSAGES_SQL}, edges AS (SELECT DISTINCT user_id * 1000 + event_id % 5 AS message_id FROM events WHERE event_id <= {AS_OF_SQL}) "
    "SELECT DISTINCT m.message_id, m.conv_id, m.turn FROM messages m JOIN (SELECT DISTINCT conv_id FROM conversations WHERE role = 'assistant') c USING (conv_id) "
    "WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.message_id = m.message_id)",
)
def uncovered_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of processed sessions that no candidate up to a commit cites."""
    cited = table(spark, sf_dir, "events").where(F.col("event_id") <= as_of(spark, sf_dir)).select((F.col("user_id") * 1000 + F.col("event_id") % 5).alias("message_id"))
    processed = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id")
    return messages(spark, sf_dir).join(processed, "conv_id", "left_semi").join(cited, "message_id", "left_anti").select("message_id", "conv_id", "turn").distinct()


@query(
    "context_union_all",
    f"WITH {VERSIONS_SQL}, {MESSAGES_SQL} "
    "SELECT CAST(version_id AS VARCHAR) AS evidence_id, 'version' AS id_kind, kind, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM versions WHERE system_to IS NULL "
    "UNION ALL SELECT 'source:' || CAST(message_id AS VARCHAR), 'source', role, NULL FROM messages WHERE turn = 0 "
    "UNION ALL SELECT 'mem0:' || CAST(page_id AS VARCHAR), 'external', NULL, NULL FROM pages",
)
def context_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three kinds of evidence under one id column."""
    own = versions(spark, sf_dir).where(store.visible(None)).select(F.col("version_id").cast("string").alias("evidence_id"), "kind", F.get_json_object("props", "$.k").cast("int").alias("k"))
    said = messages(spark, sf_dir).where("turn = 0").select(F.concat(F.lit(scalars.SOURCE_PREFIX), F.col("message_id").cast("string")).alias("evidence_id"), F.col("role").alias("kind"))
    other = table(spark, sf_dir, "pages").select(F.concat(F.lit(scalars.EXTERNAL_PREFIX), F.col("page_id").cast("string")).alias("evidence_id"))
    every = own.unionByName(said, allowMissingColumns=True).unionByName(other, allowMissingColumns=True)
    return every.select("evidence_id", scalars.id_kind(F.col("evidence_id")).alias("id_kind"), "kind", "k")


@query("latest_per_key", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type <> 'error') t WHERE n = 1")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.latest(table(spark, sf_dir, "events").where("event_type <> 'error'"), ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type")


@query(
    "content_hash_dups",
    "SELECT source, substr(sha256(text), 1, 16) AS content_hash, count(*) AS n, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY source, substr(sha256(text), 1, 16) HAVING count(*) > 1",
)
def content_hash_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("source", "doc_id", scalars.content_hash(F.col("text")).alias("content_hash"))
    return hashed.groupBy("source", "content_hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query(
    "evidence_semi_anti",
    "SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') THEN 'found' ELSE 'missing' END AS state FROM customer",
)
def evidence_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted ids that exist and those that are missing."""
    wanted, have = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return wanted.join(have, "c_custkey", "left_semi").withColumn("state", F.lit("found")).unionByName(wanted.join(have, "c_custkey", "left_anti").withColumn("state", F.lit("missing")))


@query(
    "undecided_left_join",
    "SELECT o.o_orderkey, o.o_orderstatus, l.n_lines FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) l ON l.l_orderkey = o.o_orderkey WHERE o.o_orderdate >= TIMESTAMP '1999-01-01'",
)
def undecided_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with their decisions, those without one kept."""
    decided = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_lines"))
    return table(spark, sf_dir, "orders").where("o_orderdate >= TIMESTAMP '1999-01-01'").select("o_orderkey", "o_orderstatus").join(decided, "o_orderkey", "left")


@query(
    "backward_version_join",
    f"WITH {VERSIONS_SQL} SELECT a.version_id, max(b.version_no) AS parent_no FROM versions a LEFT JOIN versions b ON b.memory_id = a.memory_id AND b.version_no < a.version_no AND b.kind <> 'error' WHERE a.kind = 'purchase' GROUP BY a.version_id",
)
def backward_version_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each change the latest earlier version of its memory that is not an error (an as-of join as one window)."""
    own = Window.partitionBy("memory_id").orderBy("version_no").rowsBetween(Window.unboundedPreceding, -1)
    found = versions(spark, sf_dir).withColumn("parent_no", F.max(F.when(F.col("kind") != "error", F.col("version_no"))).over(own))
    return found.where("kind = 'purchase'").select("version_id", "parent_no")


@query(
    "array_overlap_join",
    "WITH carts AS (SELECT l_orderkey, list(DISTINCT l_suppkey) AS supp FROM lineitem GROUP BY 1), wanted AS (SELECT list(s_suppkey) AS w FROM supplier WHERE s_nationkey = 3) "
    "SELECT l_orderkey, len(list_intersect(supp, w)) AS n_shared FROM carts, wanted WHERE list_has_any(supp, w)",
)
def array_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id array meets a wanted set: exploded ids against the set, never array against array."""
    wanted = table(spark, sf_dir, "supplier").where("s_nationkey = 3").select(F.col("s_suppkey").alias("l_suppkey"))
    pairs = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(wanted, "l_suppkey", "left_semi")
    return pairs.groupBy("l_orderkey").agg(F.countDistinct("l_suppkey").alias("n_shared"))


@query(
    "source_lookup",
    "SELECT e.event_id, c.role, coalesce(c.text, 'unknown') AS content FROM (SELECT event_id, user_id AS conv_id, event_id % 4 AS turn FROM events WHERE event_type = 'signup') e LEFT JOIN conversations c USING (conv_id, turn)",
)
def source_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "events").where("event_type = 'signup'").select("event_id", F.col("user_id").alias("conv_id"), (F.col("event_id") % 4).alias("turn"))
    return wanted.join(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], "left").select("event_id", "role", F.coalesce("text", F.lit("unknown")).alias("content"))


@query(
    "field_diff",
    f"WITH {VERSIONS_SQL}, d AS (SELECT version_id, kind, lag(kind) OVER w AS kind0, props, lag(props) OVER w AS props0, version_no FROM versions WINDOW w AS (PARTITION BY memory_id ORDER BY version_no)) "
    "SELECT version_id, kind IS DISTINCT FROM kind0 AS kind_changed, props IS DISTINCT FROM props0 AS props_changed, CAST(kind IS DISTINCT FROM kind0 AS INTEGER) + CAST(props IS DISTINCT FROM props0 AS INTEGER) AS n_changed FROM d WHERE version_no > 1",
)
def field_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Window.partitionBy("memory_id").orderBy("version_no")
    df = versions(spark, sf_dir).withColumns({"kind0": F.lag("kind").over(own), "props0": F.lag("props").over(own)}).where("version_no > 1")
    diff = store.changed_fields({"kind": (F.col("kind0"), F.col("kind")), "props": (F.col("props0"), F.col("props"))})
    return df.select("version_id", diff.alias("d")).select(
        "version_id", F.map_contains_key("d", F.lit("kind")).alias("kind_changed"), F.map_contains_key("d", F.lit("props")).alias("props_changed"), F.size("d").alias("n_changed")
    )


@query(
    "scd2_close",
    f"WITH {VERSIONS_SQL}, hit AS (SELECT DISTINCT user_id AS memory_id FROM events WHERE event_type = 'error' AND event_id > {AS_OF_SQL}) "
    f"SELECT version_id, CASE WHEN system_to IS NULL AND h.memory_id IS NOT NULL THEN {NEXT_SQL} ELSE system_to END AS system_to, CASE WHEN system_to IS NULL AND h.memory_id IS NOT NULL THEN 'retracted' WHEN system_to IS NOT NULL THEN 'superseded' END AS end_reason FROM versions LEFT JOIN hit h USING (memory_id)",
)
def scd2_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = table(spark, sf_dir, "events").where((F.col("event_type") == "error") & (F.col("event_id") > as_of(spark, sf_dir))).select(F.col("user_id").alias("memory_id")).distinct().withColumn("hit", F.lit(True))
    closed = F.col("system_to").isNull() & F.coalesce("hit", F.lit(False))
    return versions(spark, sf_dir).join(hit, "memory_id", "left").select(
        "version_id", F.when(closed, F.lit(table(spark, sf_dir, "events").agg(F.max("event_id") + 1).first()[0]).cast("long")).otherwise(F.col("system_to")).alias("system_to"),
        F.when(closed, "retracted").when(F.col("system_to").isNotNull(), "superseded").alias("end_reason"),
    )


@query(
    "lineage_closure",
    "WITH RECURSIVE parents AS (SELECT event_id AS version_id, event_id // 2 AS parent_id FROM events WHERE event_id > 0), direct AS (SELECT event_id AS version_id, user_id AS message_id FROM events), "
    "walk AS (SELECT version_id, message_id, 0 AS depth FROM direct UNION ALL SELECT p.version_id, w.message_id, w.depth + 1 FROM parents p JOIN walk w ON w.version_id = p.parent_id) "
    "SELECT version_id, message_id, min(depth) AS depth FROM walk GROUP BY 1, 2",
)
def lineage_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message that a version rests on; a version's parent is the one of half its number."""
    events = table(spark, sf_dir, "events")
    parents = events.where("event_id > 0").select(F.col("event_id").alias("version_id"), F.floor(F.col("event_id") / 2).alias("parent_version_id"))
    return store.lineage(events.select(F.col("event_id").alias("version_id"), F.col("user_id").alias("message_id")), parents)


@query(
    "lineage_delta",
    "WITH RECURSIVE parents AS (SELECT event_id AS version_id, event_id // 2 AS parent_id FROM events WHERE event_id > 0), "
    f"walk AS (SELECT event_id AS version_id, event_id AS node, 0 AS depth FROM events WHERE event_id > {AS_OF_SQL} UNION ALL SELECT w.version_id, p.parent_id, w.depth + 1 FROM parents p JOIN walk w ON w.node = p.version_id) "
    "SELECT version_id, user_id AS message_id, min(depth) AS depth FROM walk JOIN events ON event_id = node GROUP BY 1, 2",
)
def lineage_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the later half of the history adds to the closure of the earlier half."""
    events, half = table(spark, sf_dir, "events"), as_of(spark, sf_dir)
    direct = events.select(F.col("event_id").alias("version_id"), F.col("user_id").alias("message_id"))
    parents = events.where("event_id > 0").select(F.col("event_id").alias("version_id"), F.floor(F.col("event_id") / 2).alias("parent_version_id"))
    stored = store.lineage(direct.where(F.col("version_id") <= half), parents.where(F.col("version_id") <= half))
    return store.lineage_delta(stored, direct.where(F.col("version_id") > half), parents.where(F.col("version_id") > half))


@query(
    "prune_unused",
    f"WITH {VERSIONS_SQL} SELECT conversation_id, count(*) AS active, count(*) FILTER (WHERE u.c_custkey IS NOT NULL) AS used, count(*) FILTER (WHERE u.c_custkey IS NULL) AS pruned, max(system_from) + 1 AS close_at FROM versions LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) u ON u.c_custkey = memory_id WHERE system_to IS NULL GROUP BY conversation_id",
)
def prune_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("memory_id"), F.lit(1).alias("u"))
    active = versions(spark, sf_dir).where(store.visible(None)).join(used, "memory_id", "left")
    return active.groupBy("conversation_id").agg(F.count("*").alias("active"), F.count("u").alias("used"), F.count_if(F.col("u").isNull()).alias("pruned"), (F.max("system_from") + 1).alias("close_at"))


@query(
    "orphan_fk_check",
    "SELECT 'lineitem.l_orderkey' AS fk, count(*) AS orphans FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) "
    "UNION ALL SELECT 'labels.doc_id', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) "
    "UNION ALL SELECT 'events.user_id', count(*) FROM events WHERE user_id NOT IN (SELECT conv_id FROM conversations)",
)
def orphan_fk_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    out = None
    for child, key, parent, parent_key in (("lineitem", "l_orderkey", "orders", "o_orderkey"), ("labels", "doc_id", "documents", "doc_id"), ("events", "user_id", "conversations", "conv_id")):
        part = store.orphans(t(child), key, t(parent), parent_key).agg(F.lit(f"{child}.{key}").alias("fk"), F.count("*").alias("orphans"))
        out = part if out is None else out.unionByName(part)
    return out


@query("duplicate_key_check", "SELECT o_custkey, o_orderdate, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_key_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.duplicate_keys(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderdate"])


@query("distinct_sessions", "SELECT role, count(DISTINCT conv_id) AS sessions, max(turn) AS last_turn FROM conversations GROUP BY role")
def distinct_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.countDistinct("conv_id").alias("sessions"), F.max("turn").alias("last_turn"))


@query(
    "upsert_messages",
    f"SELECT event_id % greatest({AS_OF_SQL}, 1) AS key, max_by(event_id, event_id) AS event_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY 1",
)
def upsert_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later batches replace earlier rows of a key; the later half of the events brings the keys of the earlier half again."""
    half = as_of(spark, sf_dir)
    events = table(spark, sf_dir, "events").select((F.col("event_id") % max(1, half)).alias("key"), "event_id", "event_type")
    last = lambda df: store.latest(df, ["key"], F.desc("event_id"))
    return store.upsert(last(events.where(F.col("event_id") < half)), last(events.where(F.col("event_id") >= half)), ["key"])


@query("insert_if_absent", "SELECT user_id AS conv_id, 'events' AS origin FROM (SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT conv_id FROM conversations)) t UNION ALL SELECT DISTINCT conv_id, 'conversations' FROM conversations")
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "conversations").select("conv_id").distinct().withColumn("origin", F.lit("conversations"))
    return store.insert_absent(old, table(spark, sf_dir, "events").select(F.col("user_id").alias("conv_id"), F.lit("events").alias("origin")), ["conv_id"])


@query(
    "related_routes_join",
    "WITH cand AS (SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer), hits AS ("
    "SELECT a.c_custkey AS candidate, b.c_custkey AS memory, 1 AS route FROM cand a JOIN customer b ON b.c_nationkey = a.c_nationkey AND b.c_mktsegment = a.c_mktsegment AND b.c_custkey <> a.c_custkey "
    "UNION ALL SELECT a.c_custkey, n.s_suppkey, 2 FROM cand a JOIN supplier n ON n.s_nationkey = a.c_nationkey), "
    "best AS (SELECT candidate, memory, min(route) AS route FROM hits GROUP BY 1, 2) "
    "SELECT candidate, memory, route FROM (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY route, memory) AS n FROM best) t WHERE n <= 8",
)
def related_routes_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates and related memories over several routes, the first route of each pair kept, a bounded number each.

    A group's nine smallest memories (one may be the candidate itself) are all that can be among
    the first eight, so they are found before the join, as one list a group; a candidate's own
    eight are chosen within its row, and no pair that falls away is ever a row.
    """
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    groups = customer.select(F.col("c_custkey").alias("candidate"), "c_nationkey", "c_mktsegment")

    def smallest(df: DataFrame, keys: list[str], memory: str, n: int, name: str) -> DataFrame:
        once = df.select(*keys, F.col(memory).alias("memory")).distinct().withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("memory")))
        return once.where(F.col("n") <= n).groupBy(*keys).agg(F.array_sort(F.collect_list("memory")).alias(name))

    # Eight of the other route may be taken already: sixteen hold eight new ones.
    met = groups.join(smallest(customer, ["c_nationkey", "c_mktsegment"], "c_custkey", 9, "same"), ["c_nationkey", "c_mktsegment"], "left")
    met = met.join(smallest(supplier.withColumnRenamed("s_nationkey", "c_nationkey"), ["c_nationkey"], "s_suppkey", 16, "near"), "c_nationkey", "left")
    every = lambda name: F.array_sort(F.array_distinct(F.flatten(F.collect_list(name)))).alias(name)
    own = dealt(met.select("candidate", "same", "near"), customer.count(), "candidate").groupBy("candidate").agg(every("same"), every("near"))  # a repeated candidate has the lists of all its groups
    same = F.filter("same", lambda m: m != F.col("candidate"))
    routed = lambda ids, route: F.transform(ids, lambda m: F.struct(m.alias("memory"), F.lit(route).alias("route")))
    best = F.slice(F.concat(routed(same, 1), routed(F.array_except("near", same), 2)), 1, 8)
    return own.select("candidate", F.explode(best).alias("hit")).select("candidate", "hit.memory", "hit.route")


@query(
    "run_vs_run_sets",
    "SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN b.user_id IS NULL THEN 'before_only' WHEN a.user_id IS NULL THEN 'after_only' ELSE 'shared' END AS side FROM "
    f"(SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND event_id <= {AS_OF_SQL}) a FULL OUTER JOIN (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND event_id > {AS_OF_SQL}) b ON a.user_id = b.user_id",
)
def run_vs_run_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buyers of the first half of the history, of the second, and of both."""
    late = F.col("event_id") > as_of(spark, sf_dir)
    bought = table(spark, sf_dir, "events").where("event_type = 'purchase'").groupBy("user_id").agg(F.min(late).alias("first"), F.max(late).alias("last"))
    side = F.when(F.col("first") != F.col("last"), "shared").when(F.col("last"), "after_only").otherwise("before_only")
    return bought.select("user_id", side.alias("side"))


@query(
    "run_vs_run_cases",
    "WITH cases AS (SELECT DISTINCT event_type, user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events), "
    "a AS (SELECT user_id, k FROM cases WHERE event_type = 'purchase'), b AS (SELECT user_id, k FROM cases WHERE event_type = 'signup') "
    "SELECT user_id, k, 'shared' AS side FROM (SELECT * FROM a INTERSECT SELECT * FROM b) t UNION ALL "
    "SELECT user_id, k, 'before_only' FROM (SELECT * FROM a EXCEPT SELECT * FROM b) t UNION ALL SELECT user_id, k, 'after_only' FROM (SELECT * FROM b EXCEPT SELECT * FROM a) t",
)
def run_vs_run_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases (user and k) of two runs, the purchases and the signups, over all events of both."""
    seen = table(spark, sf_dir, "events").where("event_type IN ('purchase', 'signup')")
    sides = seen.groupBy("user_id", F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.min("event_type").alias("least"), F.max("event_type").alias("most"))
    side = F.when(F.col("least") != F.col("most"), "shared").when(F.col("least") == "purchase", "before_only").otherwise("after_only")
    return sides.select("user_id", "k", side.alias("side"))


@query(
    "snapshot_diff",
    "WITH o AS (SELECT c_custkey AS id, c_acctbal AS v FROM customer WHERE c_mktsegment <> 'BUILDING'), n AS (SELECT c_custkey AS id, CASE WHEN c_nationkey < 5 THEN c_acctbal + 1 ELSE c_acctbal END AS v FROM customer WHERE c_mktsegment <> 'MACHINERY') "
    "SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NULL THEN 'tombstone' WHEN o.id IS NULL THEN 'new' ELSE 'changed' END AS state FROM o FULL OUTER JOIN n ON o.id = n.id WHERE o.v IS DISTINCT FROM n.v OR o.id IS NULL OR n.id IS NULL",
)
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as two snapshots: one segment new, one gone, some nations changed."""
    c = table(spark, sf_dir, "customer")
    old = c.where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"))
    new = c.where("c_mktsegment <> 'MACHINERY'").select(F.col("c_custkey").alias("id"), F.when(F.col("c_nationkey") < 5, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")).alias("v"))
    return graph.snapshot_diff(old, new, "id", ["v"])


@query(
    "first_seen_steps",
    "SELECT conversation_id, step, version_id FROM (SELECT user_id % 10 AS conversation_id, event_id % 6 AS step, CAST(floor(value) AS BIGINT) AS version_id, min(event_id % 6) OVER (PARTITION BY user_id % 10, CAST(floor(value) AS BIGINT)) AS first_step FROM events) t WHERE step = first_step",
)
def first_seen_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that no earlier step of the run returned; repeats within the first step stay."""
    steps = table(spark, sf_dir, "events").select((F.col("user_id") % SCOPES).alias("conversation_id"), (F.col("event_id") % 6).alias("step"), F.floor("value").cast("long").alias("version_id"))
    first = F.min("step").over(Window.partitionBy("conversation_id", "version_id"))
    return steps.withColumn("first_step", first).where("step = first_step").drop("first_step")


@query(
    "first_n_per_category",
    "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) t WHERE n <= 5",
)
def first_n_per_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("source").orderBy("doc_id")
    return table(spark, sf_dir, "documents").select("source", "doc_id", F.row_number().over(w).alias("n")).where("n <= 5").drop("n")


@query(
    "json_extract_coalesce",
    "SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k, coalesce(json_extract_string(props, '$.missing'), event_type) AS label FROM events",
)
def json_extract_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", F.coalesce(F.get_json_object("props", "$.k").try_cast("long"), F.lit(-1)).alias("k"), F.coalesce(F.get_json_object("props", "$.missing"), "event_type").alias("label")
    )


@query(
    "message_id_roundtrip",
    "SELECT conv_id, turn, printf('%s_s%02d_m%03d', CAST(conv_id AS VARCHAR), conv_id % 7, turn) AS message_id, CAST(conv_id AS VARCHAR) AS conversation, CAST(conv_id % 7 AS INTEGER) AS session, CAST(turn AS INTEGER) AS parsed_turn FROM conversations",
)
def message_id_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "conversations").withColumn("message_id", scalars.message_id(F.col("conv_id"), F.col("conv_id") % 7, F.col("turn")))
    return made.withColumn("p", scalars.parsed_message_id(F.col("message_id"))).select("conv_id", "turn", "message_id", "p.conversation", "p.session", F.col("p.turn").alias("parsed_turn"))


@query(
    "normalise_rows",
    "SELECT doc_id, coalesce(nullif(trim(CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN lang END), ''), source) AS reference, CASE WHEN doc_id % 2 = 0 THEN 'evidence_ids' ELSE 'evidence' END AS origin FROM documents",
)
def normalise_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Older rows name their answer otherwise: the reference unless empty, else the answer."""
    reference = F.when(F.col("doc_id") % 3 == 0, F.lit("")).when(F.col("doc_id") % 3 == 1, F.col("lang"))
    held = scalars.require(scalars.reference_or_answer(scalars.optional_text(reference), F.col("source")), "a row has neither reference nor answer")
    return table(spark, sf_dir, "documents").select(
        "doc_id", held.alias("reference"), F.when(F.col("doc_id") % 2 == 0, "evidence_ids").otherwise("evidence").alias("origin")
    )


@query(
    "timestamp_minmax",
    "SELECT user_id, min_by(strftime(ts, '%Y-%m-%d'), ts) AS first_day, max_by(strftime(ts, '%Y-%m-%d'), ts) AS last_day FROM events GROUP BY user_id",
)
def timestamp_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least and greatest time by value, returned as the raw text."""
    raw = table(spark, sf_dir, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("raw"))
    at = scalars.timestamp(F.col("raw"))
    return raw.groupBy("user_id").agg(F.min_by("raw", at).alias("first_day"), F.max_by("raw", at).alias("last_day"))


@query(
    "dq_ladder",
    """WITH l AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE p_partkey IS NULL) AS lost, count(*) FILTER (WHERE l_discount >= 0.1) AS broken FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size < 50) p ON p_partkey = l_partkey GROUP BY 1)
SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'not_in_dataset' WHEN n IS NULL THEN 'no_run' WHEN o_totalprice > 400000 THEN 'mismatch' WHEN o_orderpriority = '5-LOW' THEN 'no_commit' WHEN lost > 0 THEN 'gold_missing' WHEN o_orderstatus = 'P' THEN 'model_error'
  WHEN broken > 0 THEN 'component_error' ELSE 'ok' END AS quality FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) c ON c_custkey = o_custkey LEFT JOIN l ON l_orderkey = o_orderkey""",
)
def dq_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first data problem of each answer (order): question unknown, no completed run, another prediction, no commit, a gold message (part) that is gone, a model's error, a component's."""
    known = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("known"))
    gold = table(spark, sf_dir, "part").where("p_size < 50").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("there"))
    runs = table(spark, sf_dir, "lineitem").join(gold, "l_partkey", "left").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.count_if(F.col("there").isNull()).alias("lost"), F.count_if(F.col("l_discount") >= 0.1).alias("broken"))
    checks = [
        (F.col("known").isNull(), "not_in_dataset"), (F.col("n").isNull(), "no_run"), (F.col("o_totalprice") > 400000, "mismatch"), (F.col("o_orderpriority") == "5-LOW", "no_commit"), (F.col("lost") > 0, "gold_missing"),
        (F.col("o_orderstatus") == "P", "model_error"), (F.col("broken") > 0, "component_error"),
    ]
    return table(spark, sf_dir, "orders").join(known, "o_custkey", "left").join(runs, "o_orderkey", "left").select("o_orderkey", scalars.first_problem(checks).alias("quality"))


@query(
    "recovery_queries",
    r"""WITH h AS (SELECT conv_id, turn, role, text, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))[:320] AS line FROM conversations),
s AS (SELECT conv_id, count(*) AS n, string_agg('- ' || line, chr(10) ORDER BY turn) FILTER (WHERE line <> '') AS lines, string_agg(coalesce(nullif(role, ''), 'unknown') || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS session FROM h GROUP BY 1)
SELECT item_id, 'Question: ' || trim(text) || chr(10) || 'First retrieval returned ' || coalesce(n, 0) || ' memories.' || chr(10) || 'Returned memory contents:' || chr(10) || coalesce(lines, '- (none)') AS query, coalesce(session, '') AS session FROM benchmark LEFT JOIN s ON conv_id = item_id""",
)
def recovery_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item with the turns of the conversation of its number: as the hits of a first search, and as a session."""
    turn = F.struct("turn", F.col("role").alias("speaker"), F.col("text").alias("content"))
    told = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("item_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    both = table(spark, sf_dir, "benchmark").join(told, "item_id", "left")
    return both.select("item_id", scalars.recovery_query(F.col("text"), F.col("turns.content")).alias("query"), F.coalesce(scalars.session_text(F.col("turns")), F.lit("")).alias("session"))


@query(
    "resume_antijoin",
    "SELECT event_id FROM (SELECT event_id, user_id, event_type FROM events) e WHERE NOT EXISTS (SELECT 1 FROM (SELECT user_id, max_by(event_type, event_id) AS last FROM events GROUP BY user_id) s WHERE s.user_id = e.user_id AND s.last IN ('purchase', 'signup'))",
)
def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work whose key is not yet done: the latest status of each key decides, retryable ones run again."""
    events = table(spark, sf_dir, "events")
    done = events.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last")).where("last IN ('purchase', 'signup')")
    return events.join(done, "user_id", "left_anti").select("event_id")


@query(
    "connected_components",
    "SELECT o_orderkey AS node, min(o_orderkey) OVER (PARTITION BY o_custkey) AS root FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) t WHERE n > 1",
)
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order is tied to its customer's next: the components are the customers' chains."""
    own = Window.partitionBy("o_custkey").orderBy(F.xxhash64("o_orderkey"))
    following = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("a"), F.lead("o_orderkey").over(own).alias("b"))
    return graph.components(following.where("b IS NOT NULL"))


@query("write_set_components")
def write_set_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose write sets (part and supplier of their lines) meet; no SQL, tests hold it against union-find."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("a"), "l_partkey", "l_suppkey")
    # Each writer of a row is tied to its least writer: as many edges as lines, whatever the group's size.
    first = lines.groupBy("l_partkey", "l_suppkey").agg(F.min("a").alias("b"))
    alone = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("a"), F.col("o_orderkey").alias("b"))
    return graph.components(lines.join(first, ["l_partkey", "l_suppkey"]).select("a", "b").unionByName(alone))
