"""Queries on traces and histories: what was returned, kept, used, learned and published."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..io import table
from ..operators import skills, store
from ..operators.graph import dealt
from .views import VERSIONS_SQL, versions


@query(
    "construction_history",
    f"WITH {VERSIONS_SQL}, d AS (SELECT l_orderkey AS commit_id, l_partkey AS message_id, l_linenumber FROM lineitem WHERE l_returnflag = 'A') "
    "SELECT d.message_id, d.commit_id, o.o_orderstatus AS status, v.version_no FROM d JOIN orders o ON o.o_orderkey = d.commit_id LEFT JOIN versions v ON v.version_id = d.commit_id",
)
def construction_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs with their commits, and the version that each commit made if it made one."""
    inputs = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("commit_id"), F.col("l_partkey").alias("message_id"))
    commits = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("commit_id"), F.col("o_orderstatus").alias("status"))
    made = versions(spark, sf_dir).select(F.col("version_id").alias("commit_id"), "version_no")
    return inputs.join(commits, "commit_id").join(made, "commit_id", "left").select("message_id", "commit_id", "status", "version_no")


@query(
    "access_trace_hits",
    "WITH a AS (SELECT o_custkey AS run_id, o_orderkey AS action, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS step FROM orders), "
    "h AS (SELECT run_id, step, l_partkey AS version_id, row_number() OVER (PARTITION BY action ORDER BY l_linenumber, l_partkey, l_suppkey) AS rank FROM a JOIN lineitem ON l_orderkey = action) "
    "SELECT run_id, step, rank, version_id, EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = h.version_id AND p.p_partkey % 2 = 0) AS kept FROM h",
)
def access_trace_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked hits of each action of a run, flagged if the agent kept them in view."""
    orders, lines, parts = (table(spark, sf_dir, name) for name in ("orders", "lineitem", "part"))
    rows = lines.count()
    actions = dealt(orders.select("o_custkey", "o_orderkey"), orders.count(), "o_custkey").select(
        F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("action"), (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("step")
    )
    rank = F.row_number().over(Window.partitionBy("action").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    of = dealt(lines.select(F.col("l_orderkey").alias("action"), "l_linenumber", "l_partkey", "l_suppkey"), rows, "action")
    hits = dealt(actions, rows, "action").join(of, "action").select("run_id", "step", rank.alias("rank"), F.col("l_partkey").alias("version_id"))
    shown = parts.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("version_id")).distinct().withColumn("kept", F.lit(True))
    return dealt(hits, rows, "version_id").join(dealt(shown, rows, "version_id"), "version_id", "left").select("run_id", "step", "rank", "version_id", F.coalesce("kept", F.lit(False)).alias("kept"))


@query(
    "evidence_export",
    "SELECT l_orderkey AS run_id, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS evidence, count(DISTINCT l_suppkey) AS n_sources FROM lineitem GROUP BY l_orderkey",
)
def evidence_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's evidence in its order, as one text."""
    ordered = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    ids = F.array_join(F.transform(ordered, lambda x: x["l_partkey"].cast("string")), ",")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(ids.alias("evidence"), F.countDistinct("l_suppkey").alias("n_sources"))


@query(
    "context_merge",
    "WITH h AS (SELECT l_orderkey // 50 AS question, l_partkey AS version_id, CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END AS phase, l_orderkey * 10 + l_linenumber AS position FROM lineitem), "
    "f AS (SELECT question, version_id, min(phase * 100000000 + position) AS spot FROM h GROUP BY 1, 2) SELECT question, version_id, n FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY spot, version_id) AS n FROM f) t WHERE n <= 32",
)
def context_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-seen hits over the initial and the supplemental searches, at most 32 a question."""
    phase = F.when(F.col("l_linestatus") == "O", 0).otherwise(1)
    lines = table(spark, sf_dir, "lineitem")
    hits = lines.select(F.floor(F.col("l_orderkey") / 50).alias("question"), F.col("l_partkey").alias("version_id"), (phase * 100_000_000 + F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    first = dealt(hits, lines.count(), "question").groupBy("question", "version_id").agg(F.min("at").alias("at"))
    w = Window.partitionBy("question").orderBy("at", "version_id")
    return first.select("question", "version_id", F.row_number().over(w).alias("n")).where("n <= 32")


@query(
    "needed_vs_returned",
    "WITH n AS (SELECT l_orderkey AS qa_id, list(DISTINCT l_suppkey) AS needed, list(DISTINCT l_suppkey) FILTER (WHERE l_returnflag <> 'R') AS returned FROM lineitem GROUP BY 1) "
    "SELECT qa_id, len(needed) AS n_needed, len(needed) - len(list_intersect(needed, coalesce(returned, []))) AS n_missing FROM n",
)
def needed_vs_returned(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.candidates import missing_evidence

    seen = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("qa_id")).agg(
        F.collect_set("l_suppkey").alias("needed"), F.collect_set(F.when(F.col("l_returnflag") != "R", F.col("l_suppkey"))).alias("returned")
    )
    return seen.select("qa_id", F.size("needed").alias("n_needed"), F.size(missing_evidence(F.col("needed"), F.col("returned"))).alias("n_missing"))


@query(
    "flip_projection",
    "SELECT doc_id AS case_id, part FROM (SELECT doc_id, unnest(list_filter([CASE WHEN quality = 0 THEN 'access' END, CASE WHEN toxic = 1 THEN 'construction' END, CASE WHEN quality = 0 AND toxic = 1 THEN 'answer' END], lambda x: x IS NOT NULL)) AS part FROM labels) t",
)
def flip_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No to three report rows per case, by its attributions."""
    parts = F.array_compact(
        F.array(F.when(F.col("quality") == 0, F.lit("access")), F.when(F.col("toxic") == 1, F.lit("construction")), F.when((F.col("quality") == 0) & (F.col("toxic") == 1), F.lit("answer")))
    )
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("case_id"), F.explode(parts).alias("part"))


@query(
    "example_ladder",
    "WITH e AS (SELECT a.c_custkey AS wanted, b.s_suppkey AS example, CASE WHEN b.s_nationkey = a.c_nationkey THEN 0 WHEN n1.n_regionkey = n2.n_regionkey THEN 1 ELSE 2 END AS rung FROM customer a JOIN nation n1 ON n1.n_nationkey = a.c_nationkey, supplier b JOIN nation n2 ON n2.n_nationkey = b.s_nationkey) "
    "SELECT wanted, min(example) AS example, rung FROM e WHERE (wanted, rung) IN (SELECT wanted, min(rung) FROM e GROUP BY wanted) GROUP BY wanted, rung",
)
def example_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first example of the best rung: same nation, else same region, else any; rungs are looked up, pairs never built."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    examples = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_nationkey", "n_regionkey")
    wanted = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("wanted"), "n_nationkey", "n_regionkey")
    same = examples.groupBy("n_nationkey").agg(F.min("s_suppkey").alias("same"))
    near = examples.groupBy("n_regionkey").agg(F.min("s_suppkey").alias("near"))
    out = wanted.join(same, "n_nationkey", "left").join(near, "n_regionkey", "left").join(examples.agg(F.min("s_suppkey").alias("every")))
    rung = F.when(F.col("same").isNotNull(), 0).when(F.col("near").isNotNull(), 1).otherwise(2)
    return out.select("wanted", F.coalesce("same", "near", "every").alias("example"), rung.alias("rung"))


#: Operations (orders) with their candidates (parts of their returned lines) and whether their payload is valid.
GATE_SQL = "c AS (SELECT DISTINCT l_orderkey AS op, l_partkey // 20 AS candidate FROM lineitem WHERE l_returnflag = 'R'), o AS (SELECT op, count(DISTINCT candidate) AS support, op IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') AS valid FROM c GROUP BY op)"


@query(
    "publication_gate",
    f"WITH {GATE_SQL}, bad AS (SELECT op FROM o WHERE support < 2 OR NOT valid), lost AS (SELECT DISTINCT candidate FROM c WHERE op IN (SELECT op FROM bad)) "
    "SELECT op, support, op NOT IN (SELECT op FROM bad) AND op NOT IN (SELECT op FROM c WHERE candidate IN (SELECT candidate FROM lost)) AS published FROM o",
)
def publication_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations with enough support and a valid payload; one that shares a candidate with a rejected one falls with it."""
    return skills.publication_gate(*_gate(spark, sf_dir), least=2)


@query(
    "publication_closure",
    f"""WITH RECURSIVE {GATE_SQL}, lost AS (SELECT op FROM o WHERE support < 2 OR NOT valid UNION SELECT b.op FROM lost JOIN c a USING (op) JOIN c b USING (candidate)) SELECT op, support, op NOT IN (SELECT op FROM lost) AS published FROM o""",
)
def publication_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, the rejection going on from candidate to operation until nothing changes."""
    return skills.publication_gate(*_gate(spark, sf_dir), least=2, closed=True)


def _gate(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("op"), F.floor(F.col("l_partkey") / 20).alias("candidate"))
    return c, table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("op"))


@query(
    "best_version",
    "SELECT l_suppkey AS bank, l_linenumber AS version, round(f1, 6) AS f1 FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY round(f1, 9) DESC, l_linenumber) AS n FROM (SELECT l_suppkey, l_linenumber, avg(l_discount) AS f1 FROM lineitem GROUP BY 1, 2) t) u WHERE n = 1",
)
def best_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each bank's version of the best validation score, the earliest of equals."""
    scored = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("bank"), F.col("l_linenumber").alias("version")).agg(F.avg("l_discount").alias("f1"))
    return store.latest(scored, ["bank"], F.round("f1", 9).desc(), F.col("version")).select("bank", "version", F.round("f1", 6).alias("f1"))


@query(
    "fixed_batches",
    "SELECT source, CAST(floor((n - 1) / 10) AS BIGINT) AS batch, count(*) AS size, min(doc_id) AS first_doc FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) t GROUP BY 1, 2",
)
def fixed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates in batches of ten by their order."""
    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    batched = table(spark, sf_dir, "documents").select("source", "doc_id", F.floor((place - 1) / 10).alias("batch"))
    return batched.groupBy("source", "batch").agg(F.count("*").alias("size"), F.min("doc_id").alias("first_doc"))


@query(
    "dataset_split_apply",
    "WITH s AS (SELECT * FROM (VALUES ('train', 'AUTOMOBILE'), ('train', 'BUILDING'), ('validation', 'FURNITURE'), ('test', 'HOUSEHOLD'), ('test', 'UNKNOWN')) v(set, unit)) "
    "SELECT set, count(*) AS n, round(count(*) * 1.0 / (SELECT count(*) FROM customer), 6) AS share FROM customer JOIN s ON unit = c_mktsegment GROUP BY set",
)
def dataset_split_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a stated split; units that the data lacks are ignored."""
    split = spark.createDataFrame([("train", "AUTOMOBILE"), ("train", "BUILDING"), ("validation", "FURNITURE"), ("test", "HOUSEHOLD"), ("test", "UNKNOWN")], "set string, unit string")
    customer = table(spark, sf_dir, "customer")
    counted = customer.join(split, F.col("unit") == F.col("c_mktsegment")).groupBy("set").agg(F.count("*").alias("n"))
    return counted.join(customer.agg(F.count("*").alias("total"))).select("set", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))
