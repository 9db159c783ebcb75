"""Scores, label counts and run comparisons as grouped aggregates."""

from __future__ import annotations

import hashlib
import json
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LABELS = ("C", "P", "I")


def summary(results: DataFrame, label: str = "label", usage: bool = False) -> DataFrame:
    """conversation_id, category (null for all), count, strict and partial-aware means, with ``usage`` also errors, tokens and steps: every grouping of both keys in one pass."""
    used = [F.count("error").alias("errors"), F.sum("tokens").alias("tokens"), F.avg("steps").alias("mean_steps")] if usage else []
    own = results.withColumns({"_c": F.col("conversation_id"), "_k": F.col("category")})
    return own.groupingSets([["_c", "_k"], ["_c"], ["_k"], []], "_c", "_k").agg(
        F.grouping_id().alias("level"),
        F.count("*").alias("n"),
        F.avg(F.when(F.col(label) == "C", 1.0).otherwise(0.0)).alias("strict"),
        F.avg(F.when(F.col(label) == "C", 1.0).when(F.col(label) == "P", 0.5).otherwise(0.0)).alias("partial"),
        *used,
    ).withColumnsRenamed({"_c": "conversation_id", "_k": "category"})


def label_counts(judged: DataFrame, key: str, label: str = "label", labels: tuple[str, ...] = LABELS) -> DataFrame:
    """One column per label; the labels are stated, so no extra pass looks for them."""
    return judged.groupBy(key).pivot(label, list(labels)).agg(F.count(F.lit(1))).na.fill(0, list(labels))


def transitions(before: DataFrame, after: DataFrame, key: str = "qa_id", label: str = "label") -> DataFrame:
    """label_before, label_after, n over the keys of both runs."""
    b = after.select(key, F.col(label).alias("label_after"))
    return before.select(key, F.col(label).alias("label_before")).join(b, key).groupBy("label_before", "label_after").agg(F.count("*").alias("n"))


def iteration_cases(before: DataFrame, after: DataFrame, ages: DataFrame, key: str = "qa_id") -> DataFrame:
    """Rows of both runs with their transition; of those still wrong, how many rounds they have been so."""
    b = after.select(key, F.col("label").alias("_after"))
    both = before.select(key, F.col("label").alias("_before")).join(b, key).join(ages, key, "left")
    way = F.concat(F.col("_before"), F.lit("2"), F.col("_after"))
    age = F.when(way == "W2W", F.coalesce("age", F.lit(0)) + 1).when(way == "C2W", F.lit(1)).otherwise(F.lit(0))
    return both.select(key, way.alias("transition"), age.alias("failure_age")).where("transition <> 'C2C'")


def first_good(rows: DataFrame, key: str, error: Column, order: Column) -> DataFrame:
    """For each key its first row without an error, else its first row."""
    from .store import latest

    return latest(rows, [key], error.isNotNull().cast("int"), order)


def report(results: DataFrame, key: str, category: str) -> DataFrame:
    """key, category (null: over all), n, errors, tokens, mean_steps, mean_f1; answers without a category count over all only."""
    own = results.withColumn("_k", F.col(category))
    found = own.groupingSets([[key, "_k"], [key]], key, "_k").agg(
        F.grouping("_k").alias("_all"), F.count("*").alias("n"), F.count("error").alias("errors"), F.sum("tokens").alias("tokens"), F.round(F.avg("steps"), 6).alias("mean_steps"), F.round(F.avg("f1"), 6).alias("mean_f1")
    )
    return found.where("_all = 1 OR _k IS NOT NULL").withColumnRenamed("_k", category).drop("_all")


#: The customary order of the categories in a table.
CATEGORY_ORDER = (1, 2, 4, 3, 5)


def category_table(results: DataFrame, key: str) -> DataFrame:
    """key and a column for each category with its mean as a percentage, n/a without answers."""
    mean = lambda c: F.avg(F.when(F.col("category") == c, F.col("f1")))
    return results.groupBy(key).agg(*[F.when(mean(c).isNull(), "n/a").otherwise(F.format_string("%.1f%%", 100 * mean(c))).alias(f"c{c}") for c in CATEGORY_ORDER])


def ratings(results: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, mean (three decimals) and how often each rating was given, five first."""
    return results.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg("rating"), 3).alias("mean"), *[F.count_if(F.col("rating") == r).alias(f"r{r}") for r in (5, 4, 3, 2, 1)])


def rates(judged: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n and the per cent (one decimal) of each label and of correct or partial ones."""
    share = lambda cond: F.round(100.0 * F.count_if(cond) / F.count("*"), 1)
    label = F.col("label")
    return judged.groupBy(*keys).agg(F.count("*").alias("n"), *[share(label == x).alias(x.lower()) for x in LABELS], share(label.isin("C", "P")).alias("cp"))


def quality_counts(judged: DataFrame, expected: DataFrame) -> DataFrame:
    """kind, n: judgments that repeat, have no valid label, are missing, were not asked for, or sit in another conversation."""
    twice = judged.groupBy("qa_id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicates").alias("kind"))
    invalid = judged.where(~F.col("label").isin(*LABELS)).select(F.lit("invalid_labels").alias("kind"))
    missing = expected.join(judged, "qa_id", "left_anti").select(F.lit("missing").alias("kind"))
    extra = judged.select("qa_id").distinct().join(expected, "qa_id", "left_anti").select(F.lit("extras").alias("kind"))
    moved = judged.join(expected.select("qa_id", F.col("conversation_id").alias("_c")), "qa_id").where("conversation_id <> _c").select(F.lit("wrong_conversation").alias("kind"))
    every = twice.unionByName(invalid).unionByName(missing).unionByName(extra).unionByName(moved)
    kinds = judged.sparkSession.createDataFrame([(k,) for k in ("duplicates", "invalid_labels", "missing", "extras", "wrong_conversation")], "kind string")
    return kinds.join(every.groupBy("kind").agg(F.count("*").alias("n")), "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))


def filter_report(held: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """key, n, kept, dropped and the whole per cent dropped, when only used skills stay."""
    marked = held.join(used.select("skill_id").distinct().withColumn("_u", F.lit(1)), "skill_id", "left")
    return marked.groupBy(key).agg(F.count("*").alias("n"), F.count("_u").alias("kept"), F.count_if(F.col("_u").isNull()).alias("dropped")).withColumn("percent", F.floor(100 * F.col("dropped") / F.col("n")))


def pipeline_summary(rows: DataFrame) -> DataFrame:
    """side and its numbers of candidates, (distinct) clusters, drafts, rejected and official skills; rows: side, kind, id."""
    n = lambda k: F.count_if(F.col("kind") == k)
    return rows.groupBy("side").agg(
        n("candidate").alias("candidates"), F.count_distinct(F.when(F.col("kind") == "cluster", F.col("id"))).alias("clusters"), n("draft").alias("drafts"), n("rejected").alias("rejected"), n("official").alias("official")
    )


def outcomes(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("ok", "no_change", "error", "no_problem")])


def histogram(rows: DataFrame, key: str, category: str) -> DataFrame:
    """key, category, n and the category's total over all keys."""
    counted = rows.groupBy(key, category).agg(F.count("*").alias("n"))
    return counted.withColumn("total", F.sum("n").over(Window.partitionBy(category)))


def completed(rows: DataFrame, key: str) -> DataFrame:
    """key, rows, completed (ids with a row without an error) and whole (no row has an error)."""
    good = F.col("error").isNull()
    return rows.groupBy(key).agg(F.count("*").alias("rows"), F.count_distinct(F.when(good, F.col("qa_id"))).alias("completed"), F.min(good).alias("whole"))


def balanced_split(counts: DataFrame, sizes: tuple[int, int, int]) -> DataFrame:
    """set, unit: the allocation of units to (train, validation, test) whose counts per category come closest to the sizes.

    counts: unit, category, n for a few units (a dozen at most: every allocation is looked at).
    The objective is the squared error of the sets' shares of all items plus the mean over the
    categories of theirs; of equal ones the least SHA-256 of the allocation's sorted JSON wins.
    """
    spark = counts.sparkSession
    units = [r[0] for r in counts.select("unit").distinct().orderBy("unit").limit(17).collect()]
    if len(units) > 16 or sum(sizes) != len(units):
        raise ValueError("the sizes must add up to at most 16 units")
    names = ("train", "validation", "test")
    plans = []
    for first in combinations(range(len(units)), sizes[0]):
        rest = [k for k in range(len(units)) if k not in first]
        for second in combinations(rest, sizes[1]):
            sets = [0 if k in first else 1 if k in second else 2 for k in range(len(units))]
            listed = json.dumps({name: [str(u) for u, s in zip(units, sets, strict=True) if s == k] for k, name in enumerate(names)}, sort_keys=True)
            plans.append((hashlib.sha256(listed.encode()).hexdigest(), sets))
    share = F.create_map(*[x for k, s in enumerate(sizes) for x in (F.lit(k), F.lit(s / len(units)))])
    placed = spark.createDataFrame(plans, "plan string, sets array<int>").select("plan", F.posexplode("sets").alias("k", "set"))
    index = spark.createDataFrame([(k, u) for k, u in enumerate(units)], "k int, unit " + dict(counts.dtypes)["unit"])
    items = placed.join(index, "k").join(counts, "unit").groupBy("plan", "category", "set").agg(F.sum("n").alias("n"))
    total = counts.groupBy("category").agg(F.sum("n").alias("total"))
    grid = placed.select("plan", "set").distinct().crossJoin(total)
    full = grid.join(items, ["plan", "category", "set"], "left").na.fill(0, ["n"])
    by_category = full.groupBy("plan", "set").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.avg(F.pow(F.col("n") / F.col("total") - share[F.col("set")], 2)).alias("spread"))
    objective = by_category.groupBy("plan").agg(F.round(F.sum(F.pow(F.col("n") / F.col("total") - share[F.col("set")], 2) + F.col("spread")), 12).alias("objective"))
    best = objective.orderBy("objective", "plan").limit(1)
    named = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("set") + 1)
    return placed.join(best, "plan").join(index, "k").select(named.alias("set"), "unit", F.round("objective", 9).alias("objective"))
