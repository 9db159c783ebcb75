"""Evaluation queries: answers scored, labels counted, runs compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions import scalars
from ..functions import text as tx
from ..io import table
from ..operators import evaluation as ev

#: Answers: each turn predicts the turn after it; categories 1 to 5 by conversation.
ANSWERS_SQL = "answers AS (SELECT * FROM (SELECT conv_id * 1000 + turn AS qa_id, conv_id, conv_id % 5 + 1 AS category, text AS prediction, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reference FROM conversations) t WHERE reference IS NOT NULL)"


def _norm_sql(column: str) -> str:
    punctuation = tx.PUNCTUATION.replace("'", "''")
    plain = f"translate(lower({column}), '{punctuation}', '')"
    return f"list_filter(string_split(trim(regexp_replace({plain}, '\\s+', ' ', 'g')), ' '), lambda x: x NOT IN ('', 'a', 'an', 'the', 'and'))"


def _f1_sql(p: str, r: str) -> str:
    shared = f"list_sum(list_transform(list_distinct(list_intersect({p}, {r})), lambda t: least(len(list_filter({p}, lambda x: x = t)), len(list_filter({r}, lambda x: x = t)))))"
    return f"CASE WHEN len({p}) = 0 AND len({r}) = 0 THEN 1.0 WHEN len({p}) = 0 OR len({r}) = 0 THEN 0.0 ELSE 2.0 * coalesce({shared}, 0) / (len({p}) + len({r})) END"


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    following = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("qa_id"), "conv_id", (F.col("conv_id") % 5 + 1).alias("category"), F.col("text").alias("prediction"), following.alias("reference")).where("reference IS NOT NULL")


@query("token_f1", f"WITH {ANSWERS_SQL}, n AS (SELECT qa_id, {_norm_sql('prediction')} AS p, {_norm_sql('reference')} AS r FROM answers) SELECT qa_id, len(p) AS n_p, len(r) AS n_r, round({_f1_sql('p', 'r')}, 6) AS f1 FROM n")
def token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = _answers(spark, sf_dir).select("qa_id", tx.answer_tokens(F.col("prediction")).alias("p"), tx.answer_tokens(F.col("reference")).alias("r"))
    return tokens.select("qa_id", F.size("p").cast("long").alias("n_p"), F.size("r").cast("long").alias("n_r"), F.round(tx.token_f1(F.col("p"), F.col("r")), 6).alias("f1"))


def _parts_sql(column: str) -> str:
    return f"list_transform(string_split({column}, ','), lambda y: {_norm_sql('y')})"


_MULTI = f"list_avg(list_transform(rs, lambda r: list_max(list_transform(ps, lambda p: {_f1_sql('p', 'r')}))))"


@query(
    "category_f1",
    f"WITH {ANSWERS_SQL}, n AS (SELECT qa_id, category, prediction, {_norm_sql('prediction')} AS p, {_norm_sql("CASE WHEN category = 3 THEN trim(string_split(reference, ';')[1]) ELSE reference END")} AS r, {_parts_sql('prediction')} AS ps, {_parts_sql('reference')} AS rs FROM answers) "
    f"SELECT qa_id, category, round(CASE WHEN category = 5 THEN CASE WHEN contains(lower(prediction), 'no information available') OR contains(lower(prediction), 'not mentioned') THEN 1.0 ELSE 0.0 END WHEN category = 1 THEN {_MULTI} ELSE {_f1_sql('p', 'r')} END, 6) AS f1 FROM n",
)
def category_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category-aware scores of all categories, without stems."""
    scored = tx.answer_f1(F.col("prediction"), F.col("reference"), F.col("category"), stem=False)
    return _answers(spark, sf_dir).select("qa_id", "category", F.round(scored, 6).alias("f1"))


@query("stemmed_f1")
def stemmed_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with stems, all categories (the stemmer has no SQL; tests hold exact values)."""
    scored = tx.answer_f1(F.col("prediction"), F.col("reference"), F.col("category"))
    return _answers(spark, sf_dir).select("qa_id", "category", F.round(scored, 6).alias("f1"))


LABELS_SQL = "labelled AS (SELECT l.doc_id AS qa_id, d.source AS conversation_id, d.doc_id % 5 + 1 AS category, CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 'C' WHEN l.quality = 1 THEN 'P' ELSE 'I' END AS label FROM labels l JOIN documents d USING (doc_id))"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "C").when(F.col("quality") == 1, "P").otherwise("I")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("conversation_id"))
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select(F.col("doc_id").alias("qa_id"), "conversation_id", (F.col("doc_id") % 5 + 1).alias("category"), label.alias("label"))


@query(
    "grouping_sets_metrics",
    f"WITH {LABELS_SQL} SELECT conversation_id, category, grouping(conversation_id, category) AS level, count(*) AS n, round(avg(CASE label WHEN 'C' THEN 1.0 ELSE 0.0 END), 6) AS strict, round(avg(CASE label WHEN 'C' THEN 1.0 WHEN 'P' THEN 0.5 ELSE 0.0 END), 6) AS partial "
    "FROM labelled GROUP BY GROUPING SETS ((conversation_id, category), (conversation_id), (category), ())",
)
def grouping_sets_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.summary(_labelled(spark, sf_dir)).select("conversation_id", "category", "level", "n", F.round("strict", 6).alias("strict"), F.round("partial", 6).alias("partial"))


@query("pivot_labels", f"WITH {LABELS_SQL} SELECT category, count(*) FILTER (WHERE label = 'C') AS C, count(*) FILTER (WHERE label = 'P') AS P, count(*) FILTER (WHERE label = 'I') AS I FROM labelled GROUP BY category")
def pivot_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.label_counts(_labelled(spark, sf_dir), "category")


RUNS_SQL = "before AS (SELECT doc_id AS qa_id, CASE WHEN quality = 1 THEN 'C' ELSE 'W' END AS label FROM labels), after AS (SELECT doc_id AS qa_id, CASE WHEN toxic = 0 THEN 'C' ELSE 'W' END AS label FROM labels)"


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "qa_id")
    graded = lambda good: F.when(good, "C").otherwise("W").alias("label")
    return labels.select("qa_id", graded(F.col("quality") == 1)), labels.select("qa_id", graded(F.col("toxic") == 0))


@query("run_transition_matrix", f"WITH {RUNS_SQL} SELECT b.label AS label_before, a.label AS label_after, count(*) AS n FROM before b JOIN after a USING (qa_id) GROUP BY 1, 2")
def run_transition_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.transitions(*_runs(spark, sf_dir))


@query(
    "iteration_cases",
    f"WITH {RUNS_SQL}, ages AS (SELECT doc_id AS qa_id, max(doc_id % 3) AS age FROM labels GROUP BY 1) "
    "SELECT qa_id, b.label || '2' || a.label AS transition, CASE WHEN b.label = 'W' AND a.label = 'W' THEN coalesce(age, 0) + 1 WHEN b.label = 'C' AND a.label = 'W' THEN 1 ELSE 0 END AS failure_age FROM before b JOIN after a USING (qa_id) LEFT JOIN ages USING (qa_id) WHERE NOT (b.label = 'C' AND a.label = 'C')",
)
def iteration_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    ages = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("qa_id")).agg(F.max(F.col("doc_id") % 3).alias("age"))
    return ev.iteration_cases(*_runs(spark, sf_dir), ages)


@query(
    "coverage_fraction",
    "SELECT l_suppkey AS skill_id, count(*) AS n, count(*) FILTER (WHERE l_discount >= 0.055) AS covered, max_by(l_orderkey, l_extendedprice * 1000000 - l_orderkey) AS best, coalesce(max(l_extendedprice) >= 60000, false) AS linked FROM lineitem GROUP BY l_suppkey",
)
def coverage_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations at the threshold of all, and the best relation of each skill, linked if it reaches the gate."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("skill_id")).agg(
        F.count("*").alias("n"), F.count_if(F.col("l_discount") >= 0.055).alias("covered"), F.max_by("l_orderkey", F.col("l_extendedprice") * 1000000 - F.col("l_orderkey")).alias("best"),
        F.coalesce(F.max("l_extendedprice") >= 60000, F.lit(False)).alias("linked"),
    )


@query(
    "first_good_row",
    "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'error' THEN 1 ELSE 0 END, event_id) AS n FROM events) t WHERE n = 1",
)
def first_good_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = F.when(F.col("event_type") == "error", F.col("event_type"))
    return ev.first_good(table(spark, sf_dir, "events"), "user_id", error, F.col("event_id")).select("user_id", "event_id", "event_type")


@query(
    "rating_summary",
    "SELECT category, round(avg(score), 3) AS mean, count(*) FILTER (WHERE score >= 4) AS c, count(*) FILTER (WHERE score = 3) AS p, count(*) FILTER (WHERE score <= 2) AS i FROM (SELECT event_type AS category, CAST(floor(value) AS BIGINT) % 5 + 1 AS score FROM events) t GROUP BY category",
)
def rating_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = table(spark, sf_dir, "events").select(F.col("event_type").alias("category"), (F.floor("value").cast("long") % 5 + 1).alias("score")).withColumn("label", scalars.score_label(F.col("score")))
    counted = [F.count_if(F.col("label") == x).alias(x.lower()) for x in "CPI"]
    return rated.groupBy("category").agg(F.round(F.avg("score"), 3).alias("mean"), *counted)


@query(
    "usage_histogram",
    "SELECT skill_id, count(*) AS n, count(DISTINCT user_id) AS users FROM (SELECT user_id, unnest([event_type, 'k' || CAST(event_id % 7 AS VARCHAR)]) AS skill_id FROM events) t GROUP BY skill_id",
)
def usage_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = F.explode(F.array("event_type", F.concat(F.lit("k"), (F.col("event_id") % 7).cast("string"))))
    return table(spark, sf_dir, "events").select("user_id", used.alias("skill_id")).groupBy("skill_id").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query(
    "diagnosis_rollup",
    "SELECT user_id % 10 AS conversation_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'purchase') AS problems FROM events GROUP BY ROLLUP (user_id % 10)",
)
def diagnosis_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("conversation_id", F.col("user_id") % 10)
    return events.rollup("conversation_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("event_type") == "purchase").alias("problems"))


SPLIT_SIZES = (3, 1, 1)


@query(
    "balanced_split",
    "WITH c AS (SELECT event_type AS unit, user_id % 4 AS category, count(*) AS n FROM events GROUP BY 1, 2), u AS (SELECT DISTINCT unit FROM c), "
    "plans AS (SELECT a.unit AS v, b.unit AS t FROM u a, u b WHERE a.unit <> b.unit), tot AS (SELECT category, sum(n) AS total FROM c GROUP BY 1), "
    "sets AS (SELECT v, t, s.set, s.share FROM plans, (VALUES ('train', 0.6), ('validation', 0.2), ('test', 0.2)) s(set, share)), "
    "g AS (SELECT v, t, set, share, category, total, coalesce((SELECT sum(n) FROM c WHERE c.category = tot.category AND CASE WHEN c.unit = v THEN 'validation' WHEN c.unit = t THEN 'test' ELSE 'train' END = set), 0) AS n FROM sets, tot), "
    "o AS (SELECT v, t, round(sum(e), 12) AS objective FROM (SELECT v, t, set, power(sum(n) / sum(total) - any_value(share), 2) + avg(power(n / total - share, 2)) AS e FROM g GROUP BY v, t, set) x GROUP BY v, t), "
    "best AS (SELECT * FROM o ORDER BY objective, sha256('{\"test\": [\"' || t || '\"], \"train\": [' || (SELECT string_agg('\"' || unit || '\"', ', ' ORDER BY unit) FROM u WHERE unit NOT IN (v, t)) || '], \"validation\": [\"' || v || '\"]}') LIMIT 1) "
    "SELECT CASE WHEN unit = v THEN 'validation' WHEN unit = t THEN 'test' ELSE 'train' END AS set, unit, round(objective, 9) AS objective FROM u, best",
)
def balanced_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units dealt to three sets so that sizes and categories come closest to the shares; every allocation is looked at."""
    counts = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("unit"), (F.col("user_id") % 4).alias("category")).agg(F.count("*").alias("n"))
    return ev.balanced_split(counts, SPLIT_SIZES)


#: Answers of runs, made of orders: run, conversation, category, score, rating, error, tokens, steps.
RESULTS_SQL = """res AS (SELECT o_orderkey AS qa_id, 'run' || o_orderstatus AS run, o_custkey % 10 AS conversation_id, CASE WHEN o_custkey % 6 > 0 THEN o_custkey % 6 END AS category, round(o_totalprice / 500000, 6) AS f1, CAST(floor(o_totalprice / 100000) AS BIGINT) % 5 + 1 AS rating,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'failed' END AS error, o_orderkey % 900 AS tokens, o_orderkey % 4 + 1 AS steps FROM orders)"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("qa_id"), F.concat(F.lit("run"), "o_orderstatus").alias("run"), (c % 10).alias("conversation_id"), F.when(c % 6 > 0, c % 6).alias("category"), F.round(F.col("o_totalprice") / 500000, 6).alias("f1"),
        (F.floor(F.col("o_totalprice") / 100000) % 5 + 1).alias("rating"), F.when(F.col("o_orderpriority") == "5-LOW", "failed").alias("error"), (k % 900).alias("tokens"), (k % 4 + 1).alias("steps"),
    )


_REPORT = "count(*) AS n, count(error) AS errors, sum(tokens) AS tokens, round(avg(steps), 6) AS mean_steps, round(avg(f1), 6) AS mean_f1"


@query("eval_report", f"WITH {RESULTS_SQL} SELECT run, NULL AS category, {_REPORT} FROM res GROUP BY 1 UNION ALL SELECT run, category, {_REPORT} FROM res WHERE category IS NOT NULL GROUP BY 1, 2")
def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, errors, tokens, steps and scores of each run, over all and by category; answers without a category count in the total only."""
    return ev.report(_results(spark, sf_dir), "run", "category")


@query("run_summary", f"WITH {RESULTS_SQL} SELECT conversation_id, NULL AS category, {_REPORT} FROM res GROUP BY 1 UNION ALL SELECT conversation_id, category, {_REPORT} FROM res WHERE category IS NOT NULL GROUP BY 1, 2")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.report(_results(spark, sf_dir), "conversation_id", "category")


@query(
    "baseline_table",
    f"WITH {RESULTS_SQL} SELECT run, " + ", ".join(f"coalesce(printf('%.1f%%', 100 * avg(f1) FILTER (WHERE category = {c})), 'n/a') AS c{c}" for c in (1, 2, 4, 3, 5)) + " FROM res GROUP BY run",
)
def baseline_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category means as percentages, the categories in their customary order."""
    return ev.category_table(_results(spark, sf_dir), "run")


@query(
    "rating_distribution",
    f"WITH {RESULTS_SQL} SELECT run, category, count(*) AS n, round(avg(rating), 3) AS mean, " + ", ".join(f"count(*) FILTER (WHERE rating = {r}) AS r{r}" for r in (5, 4, 3, 2, 1)) + " FROM res WHERE category IS NOT NULL GROUP BY 1, 2",
)
def rating_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of the ratings, five first, and their mean."""
    return ev.ratings(_results(spark, sf_dir).where("category IS NOT NULL"), ["run", "category"])


_RATE = "round(100.0 * count(*) FILTER (WHERE rating {0}) / count(*), 1)"


@query("label_rates", f"WITH {RESULTS_SQL} SELECT run, category, count(*) AS n, {_RATE.format('>= 4')} AS c, {_RATE.format('= 3')} AS p, {_RATE.format('<= 2')} AS i, {_RATE.format('>= 3')} AS cp FROM res WHERE category IS NOT NULL GROUP BY 1, 2")
def label_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of correct, partial and incorrect answers, and of correct or partial ones."""
    judged = _results(spark, sf_dir).where("category IS NOT NULL").withColumn("label", scalars.score_label(F.col("rating")))
    return ev.rates(judged, ["run", "category"])


@query(
    "bundle_metrics",
    f"WITH {RESULTS_SQL}, j AS (SELECT *, CASE WHEN rating >= 4 THEN 1.0 ELSE 0.0 END AS c, CASE WHEN rating >= 4 THEN 1.0 WHEN rating = 3 THEN 0.5 ELSE 0.0 END AS p FROM res) "
    "SELECT conversation_id, category, grouping(conversation_id, category) AS level, count(*) AS n, round(avg(c), 6) AS strict, round(avg(p), 6) AS partial, count(error) AS errors, sum(tokens) AS tokens, round(avg(steps), 6) AS mean_steps FROM j GROUP BY GROUPING SETS ((conversation_id, category), (conversation_id), (category), ())",
)
def bundle_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict and partial-aware scores, errors, tokens and steps for every grouping of conversation and category."""
    judged = _results(spark, sf_dir).withColumn("label", scalars.score_label(F.col("rating")))
    found = ev.summary(judged, usage=True)
    return found.select("conversation_id", "category", "level", "n", F.round("strict", 6).alias("strict"), F.round("partial", 6).alias("partial"), "errors", "tokens", F.round("mean_steps", 6).alias("mean_steps"))


@query(
    "data_quality_counts",
    "WITH j AS (SELECT l_orderkey AS qa_id, l_suppkey % 10 AS conversation_id, CASE l_returnflag WHEN 'A' THEN 'C' WHEN 'N' THEN 'P' ELSE '?' END AS label FROM lineitem), e AS (SELECT o_orderkey AS qa_id, o_custkey % 10 AS conversation_id FROM orders WHERE o_orderstatus <> 'P') "
    "SELECT 'duplicates' AS kind, count(*) AS n FROM (SELECT qa_id FROM j GROUP BY 1 HAVING count(*) > 1) t UNION ALL SELECT 'invalid_labels', count(*) FROM j WHERE label NOT IN ('C', 'P', 'I') UNION ALL SELECT 'missing', count(*) FROM e WHERE qa_id NOT IN (SELECT qa_id FROM j) "
    "UNION ALL SELECT 'extras', count(DISTINCT qa_id) FROM j WHERE qa_id NOT IN (SELECT qa_id FROM e) UNION ALL SELECT 'wrong_conversation', count(*) FROM j JOIN e USING (qa_id) WHERE j.conversation_id <> e.conversation_id",
)
def data_quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("l_returnflag") == "A", "C").when(F.col("l_returnflag") == "N", "P").otherwise("?")
    judged = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("qa_id"), (F.col("l_suppkey") % 10).alias("conversation_id"), label.alias("label"))
    expected = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("qa_id"), (F.col("o_custkey") % 10).alias("conversation_id"))
    return ev.quality_counts(judged, expected)


@query("embedding_kinds", "SELECT len(embedding) AS dim, label, count(*) AS n FROM embeddings GROUP BY 1, 2")
def embedding_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dimensions that are stored, as the compatibility probe sees them."""
    return table(spark, sf_dir, "embeddings").groupBy(F.size("embedding").alias("dim"), "label").agg(F.count("*").alias("n"))


@query(
    "bank_filter_report",
    "SELECT s_nationkey % 2 = 0 AS access, count(*) AS n, count(*) FILTER (WHERE u) AS kept, count(*) FILTER (WHERE NOT u) AS dropped, coalesce(100 * count(*) FILTER (WHERE NOT u) // nullif(count(*), 0), 0) AS percent FROM (SELECT *, s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49) AS u FROM supplier) t GROUP BY 1",
)
def bank_filter_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of a bank's sides when unused skills go, in whole per cent."""
    used = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("skill_id"))
    held = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("skill_id"), (F.col("s_nationkey") % 2 == 0).alias("access"))
    return ev.filter_report(held, used, "access")


@query(
    "pipeline_summary",
    "SELECT side, count(*) FILTER (WHERE k = 'candidate') AS candidates, count(DISTINCT CASE WHEN k = 'cluster' THEN id END) AS clusters, count(*) FILTER (WHERE k = 'draft') AS drafts, count(*) FILTER (WHERE k = 'rejected') AS rejected, count(*) FILTER (WHERE k = 'official') AS official FROM "
    "(SELECT CASE WHEN l_linestatus = 'F' THEN 'access' ELSE 'construction' END AS side, ['candidate', 'cluster', 'draft', 'rejected', 'official'][l_linenumber % 5 + 1] AS k, l_partkey AS id FROM lineitem) t GROUP BY side",
)
def pipeline_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.get(F.array(*[F.lit(k) for k in ("candidate", "cluster", "draft", "rejected", "official")]), (F.col("l_linenumber") % 5).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_linestatus") == "F", "access").otherwise("construction").alias("side"), kind.alias("kind"), F.col("l_partkey").alias("id"))
    return ev.pipeline_summary(rows)


@query("outcome_counts", "SELECT user_id % 10 AS conversation_id, count(*) FILTER (WHERE event_type = 'click') AS ok, count(*) FILTER (WHERE event_type = 'view') AS no_change, count(*) FILTER (WHERE event_type = 'error') AS error, count(*) FILTER (WHERE event_type NOT IN ('click', 'view', 'error')) AS no_problem FROM events GROUP BY 1")
def outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "click", "ok").when(F.col("event_type") == "view", "no_change").when(F.col("event_type") == "error", "error").otherwise("no_problem")
    return ev.outcomes(table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("conversation_id"), status.alias("status")), "conversation_id")


@query("category_histogram", f"WITH {RESULTS_SQL} SELECT conversation_id, category, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY category) AS BIGINT) AS total FROM res GROUP BY 1, 2")
def category_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of each category by conversation, and over all conversations."""
    return ev.histogram(_results(spark, sf_dir), "conversation_id", "category")


@query("qa_whitelist", f"WITH {RESULTS_SQL} SELECT qa_id, run FROM res WHERE qa_id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def qa_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions that a list names."""
    listed = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("qa_id"))
    return _results(spark, sf_dir).join(listed, "qa_id", "left_semi").select("qa_id", "run")


@query("completed_items", f"WITH {RESULTS_SQL} SELECT run, count(*) AS rows, count(DISTINCT qa_id) FILTER (WHERE error IS NULL) AS completed, bool_and(error IS NULL) AS whole FROM res GROUP BY 1")
def completed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a checkpoint holds: rows, the ids that need no second run, and whether nothing is left."""
    return ev.completed(_results(spark, sf_dir), "run")
