"""The bitemporal store: append-mostly versions with system and world time, as functions of DataFrames.

A state is a dictionary of DataFrames; applying a plan of decisions gives a new one.  A plan is
checked before anything is built from it and raises as a whole, so a failed plan leaves no trace.
Versions of different conversations are independent, so every step joins on conversation first.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut, dealt

ACTIONS = ("ADD", "UPDATE", "MERGE", "DELETE", "SKIP")
DIFFED = ("subject", "predicate", "object_text", "content", "world_start", "world_end", "importance", "confidence", "memory_kind")

VERSIONS = (
    "version_id string, memory_id string, conversation_id string, version_no int, memory_kind string, subject string, predicate string, object_text string, content string, "
    "content_hash string, world_start string, world_end string, system_from long, system_to long, end_reason string, entities array<string>, keywords array<string>, "
    "importance double, confidence double, parent_version_id string, update_type string"
)


class PlanError(ValueError):
    """A plan that cannot be applied; nothing of it takes effect."""


def visible(as_of: Column | None, start: str = "system_from", end: str = "system_to") -> Column:
    """The snapshot predicate: in force at a commit, or now if there is none."""
    if as_of is None:
        return F.col(end).isNull()
    return (F.col(start) <= as_of) & (F.col(end).isNull() | (F.col(end) > as_of))


def snapshot(versions: DataFrame, conversation=None, as_of=None, include_history: bool = False) -> DataFrame:
    """A conversation's (or all) versions as of a commit (or now); with history also those already closed by then."""
    out = versions if conversation is None else versions.where(F.col("conversation_id") == F.lit(conversation))
    at = None if as_of is None else F.lit(as_of)
    if include_history:
        return out if at is None else out.where(F.col("system_from") <= at)
    return out.where(visible(at))


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same keys; missing columns become null."""
    both = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    return latest(both, keys, F.desc("_batch")).drop("_batch")


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(keys).join(old, keys, "left_anti"), allowMissingColumns=True)


def _require_none(bad: DataFrame, what: str) -> None:
    row = bad.take(1)
    if row:
        raise PlanError(f"{what}: {row[0]}")


def check_plan(versions: DataFrame, decisions: DataFrame, conversation: str, base_commit: int | None, current_commit: int | None) -> None:
    """Raises PlanError unless the base is current, the actions are known, the targets active and used once, and no added text is active already."""
    if base_commit != current_commit:
        raise PlanError(f"the plan was made on commit {base_commit}, the store is at {current_commit}")
    _require_none(decisions.where(~F.col("action").isin(*ACTIONS)), "unknown action")
    changing = decisions.where(F.col("action").isin("UPDATE", "MERGE", "DELETE"))
    active = snapshot(versions, conversation)
    _require_none(changing.join(active, changing["target_memory_id"] == active["memory_id"], "left_anti"), "no active target")
    _require_none(changing.groupBy("target_memory_id").count().where("count > 1"), "a target is changed twice")
    _require_none(decisions.groupBy("candidate_id").count().where("count > 1"), "a candidate is decided twice")
    added = decisions.where("action = 'ADD'").withColumn("content_hash", F.substring(F.sha2("content", 256), 1, 16))
    _require_none(added.join(active, "content_hash", "left_semi"), "the text is active already")


def apply_plan(versions: DataFrame, decisions: DataFrame, conversation: str, commit: int, base_commit: int | None = None, current_commit: int | None = None) -> dict[str, DataFrame]:
    """New versions, change events and parent edges after a plan of decisions on one conversation.

    decisions: seq, candidate_id, action, target_memory_id, supersedes_version_id and the fields
    of a version.  ADD opens a memory (and closes the version it supersedes, whose world_end
    becomes the new world_start unless set); UPDATE closes the current version and opens the next
    with missing fields inherited; MERGE also unites entities and keywords and keeps the larger
    importance and confidence; DELETE closes; SKIP only records.

    Where ``versions`` have a row_id (long, numbered over all conversations in the order of
    insertion), new versions go on from the highest in the order of seq, and an ADD's memory is
    numbered on from the conversation's own highest row, so its numbers skip what others inserted.
    Without that column the number in the conversation's highest memory id takes its place.  A
    plan holds a session's candidates, thirty at most, so its numbering is one small group.
    """
    check_plan(versions, decisions, conversation, base_commit, current_commit)
    d = decisions.alias("d")
    active = snapshot(versions, conversation)
    numbered = "row_id" in versions.columns
    own = F.col("row_id") if numbered else F.regexp_extract("memory_id", r"(\d+)$", 1).cast("long")
    here = F.col("conversation_id") == conversation
    highest = versions.where(here).select(F.coalesce(F.max(own), F.lit(0)).alias("m"))

    added = d.where("d.action = 'ADD'").withColumn("_k", F.row_number().over(Window.orderBy("seq"))).crossJoin(highest)
    memory = F.format_string(f"mem_{conversation}_%04d", F.col("m") + F.col("_k"))
    fields = ("memory_kind", "subject", "predicate", "object_text", "content", "world_start", "world_end", "entities", "keywords", "importance", "confidence")
    opened = added.select(
        memory.alias("memory_id"), F.lit(1).alias("version_no"), *[F.col(f"d.{f}").alias(f) for f in fields], F.col("d.supersedes_version_id").alias("parent_version_id"), F.lit("add").alias("update_type"),
        F.col("d.candidate_id").alias("candidate_id"),
    )

    changed = d.where("d.action IN ('UPDATE', 'MERGE')").join(active.alias("t"), F.col("d.target_memory_id") == F.col("t.memory_id"))
    merge = F.col("d.action") == "MERGE"
    united = lambda f: F.array_distinct(F.concat(F.coalesce(f"t.{f}", F.array().cast("array<string>")), F.coalesce(f"d.{f}", F.array().cast("array<string>"))))
    inherited = lambda f: F.coalesce(f"d.{f}", f"t.{f}")
    next_fields = []
    for f in fields:
        if f in ("entities", "keywords"):
            next_fields.append(F.when(merge, united(f)).otherwise(inherited(f)).alias(f))
        elif f in ("importance", "confidence"):
            next_fields.append(F.when(merge, F.greatest(f"d.{f}", f"t.{f}")).otherwise(inherited(f)).alias(f))
        else:
            next_fields.append(inherited(f).alias(f))
    following = changed.select(
        "t.memory_id", (F.col("t.version_no") + 1).alias("version_no"), *next_fields, F.col("t.version_id").alias("parent_version_id"), F.lower("d.action").alias("update_type"), "d.candidate_id"
    )
    fresh = opened.unionByName(following).select(
        F.concat_ws("_v", "memory_id", "version_no").alias("version_id"), "memory_id", F.lit(conversation).alias("conversation_id"), "version_no", *fields,
        F.substring(F.sha2("content", 256), 1, 16).alias("content_hash"), F.lit(commit).cast("long").alias("system_from"), F.lit(None).cast("long").alias("system_to"),
        F.lit(None).cast("string").alias("end_reason"), "parent_version_id", "update_type", "candidate_id",
    )

    closing = (
        d.where("d.action IN ('UPDATE', 'MERGE', 'DELETE')")
        .join(active.alias("t"), F.col("d.target_memory_id") == F.col("t.memory_id"))
        .select(
            F.col("t.version_id").alias("_closed"),
            F.when(F.col("d.action") == "DELETE", "retracted").when(merge, "merged").otherwise("superseded").alias("_reason"),
            F.when(F.col("d.action") == "DELETE", F.col("d.world_end")).alias("_world_end"),
        )
        .unionByName(
            d.where("d.action = 'ADD' AND d.supersedes_version_id IS NOT NULL").select(
                F.col("d.supersedes_version_id").alias("_closed"), F.lit("superseded").alias("_reason"), F.col("d.world_start").alias("_world_end")
            )
        )
    )
    _require_none(closing.join(active, closing["_closed"] == active["version_id"], "left_anti"), "nothing active to supersede")
    kept = (
        versions.join(closing, versions["version_id"] == closing["_closed"], "left")
        .withColumn("world_end", F.when(F.col("_closed").isNotNull(), F.coalesce("world_end", "_world_end")).otherwise(F.col("world_end")))
        .withColumn("system_to", F.when(F.col("_closed").isNotNull(), F.lit(commit)).otherwise(F.col("system_to")))
        .withColumn("end_reason", F.coalesce("_reason", "end_reason"))
        .drop("_closed", "_reason", "_world_end")
    )
    before = versions.select(F.col("version_id").alias("parent_version_id"), F.struct(*[F.col(c) for c in DIFFED]).alias("before"))
    events = fresh.join(before, "parent_version_id", "left").select(
        F.lit(commit).cast("long").alias("commit_id"), "candidate_id", "version_id", "parent_version_id", "update_type",
        F.when(F.col("before").isNotNull(), changed_fields({c: (F.col(f"before.{c}"), F.col(c)) for c in DIFFED})).alias("changed"),
    )
    if numbered:
        inserts = decisions.where("action IN ('ADD', 'UPDATE', 'MERGE')").select("candidate_id", F.row_number().over(Window.orderBy("seq")).alias("_k"))
        last = versions.select(F.coalesce(F.max("row_id"), F.lit(0)).alias("_last"))
        fresh = fresh.join(inserts.crossJoin(last).select("candidate_id", (F.col("_last") + F.col("_k")).alias("row_id")), "candidate_id")
    return {
        "versions": kept.unionByName(fresh.drop("candidate_id").select(*kept.columns)),
        "events": events,
        "parents": fresh.where("parent_version_id IS NOT NULL").select("version_id", "parent_version_id"),
    }


def changed_fields(pairs: dict[str, tuple[Column, Column]]) -> Column:
    """Map of the fields whose text differs to struct(before, after)."""
    names = F.array(*[F.lit(n) for n in pairs])
    values = F.array(*[F.struct(a.cast("string").alias("before"), b.cast("string").alias("after")) for a, b in pairs.values()])
    return F.map_filter(F.map_from_arrays(names, values), lambda _, v: ~v["before"].eqNullSafe(v["after"]))


#: Rounds of ``lineage`` before it looks for cycles; a chain of 2 ** PLAIN_ROUNDS versions needs no more.
PLAIN_ROUNDS = 6


def lineage(direct: DataFrame, parents: DataFrame) -> DataFrame:
    """version_id, message_id, depth: every message a version rests on, by the shortest chain of parents.

    direct: version_id, message_id (and depth, else 0); parents: version_id, parent_version_id.
    Paths double: a round joins what is known within 2^k steps to the ancestors that lie exactly
    2^k steps away, so a chain of n versions takes about log2(n) rounds, and the last is the one
    without such ancestors.  A round's rows are set beside the earlier ones; the shortest chains
    are taken once at the end.  Where chains are longer than 2^PLAIN_ROUNDS there may be a cycle,
    whose ancestors never end: from there on a round that neither finds a pair nor shortens one is
    the last, since any shortest chain that is still missing has an end of every length, whose
    pair that round would have found.  Every step is dealt out by its number of rows.
    """
    pair = ["version_id", "message_id"]
    known = direct if "depth" in direct.columns else direct.withColumn("depth", F.lit(0))
    least = lambda df, rows: cut(dealt(df, rows, *pair).groupBy(*pair).agg(F.min("depth").cast("int").alias("depth")))
    mark = lambda df: tuple(df.agg(F.count("*"), F.coalesce(F.sum("depth"), F.lit(0))).first())
    known = cut(known.select(*pair, F.col("depth").cast("int").alias("depth")))
    known = least(known, known.count())
    edges = cut(parents.select("version_id", "parent_version_id").where("version_id IS NOT NULL AND parent_version_id IS NOT NULL"))
    jump = cut(dealt(edges, edges.count(), "version_id", "parent_version_id").distinct())
    size, ahead, before = known.count(), jump.count(), None
    for k in itertools.count():
        ends = known.select(F.col("version_id").alias("parent_version_id"), "message_id", (F.col("depth") + F.lit(1 << k)).alias("depth"))
        rows = size + ahead
        step = dealt(jump, rows, "parent_version_id").join(dealt(ends, rows, "parent_version_id"), "parent_version_id")
        step = least(step.select(*pair, "depth"), rows)
        found = step.count()
        if found == 0:
            return least(known, size) if k else known
        known, size = known.unionByName(step), size + found
        if k >= PLAIN_ROUNDS:
            known = least(known, size)
            size, now = known.count(), mark(known)
            if now == before:
                return known
            before = now
        far = jump.select(F.col("version_id").alias("parent_version_id"), F.col("parent_version_id").alias("far"))
        further = dealt(jump, ahead, "parent_version_id").join(dealt(far, ahead, "parent_version_id"), "parent_version_id").select("version_id", F.col("far").alias("parent_version_id"))
        jump = cut(dealt(further, ahead, "version_id", "parent_version_id").distinct())
        ahead = jump.count()
        if ahead == 0:
            return least(known, size)


def lineage_delta(closure: DataFrame, direct: DataFrame, parents: DataFrame) -> DataFrame:
    """The rows that a commit adds to a stored closure: those of its own versions, so that the closure never has to be built anew.

    closure: version_id, message_id, depth; direct, parents: of the commit's versions, whose
    parents are old or new.  Of the closure only the rows of old parents are read, each one step
    further away; doubling runs over the commit's own versions alone.  An edge that starts at an
    old version would change rows that are stored and raises.
    """
    rows = closure.count()
    own = cut(dealt(parents.select("version_id", "parent_version_id"), parents.count(), "version_id", "parent_version_id").distinct())
    new = own.select("version_id").unionByName(direct.select("version_id"))
    new = cut(dealt(new, new.count(), "version_id").distinct())
    by = lambda df, key: dealt(df, rows, key)
    _require_none(by(closure.select("version_id"), "version_id").join(by(new, "version_id"), "version_id", "left_semi"), "a stored version gains a message or a parent")
    held = closure.select(F.col("version_id").alias("parent_version_id"), "message_id", "depth")
    from_old = by(own, "parent_version_id").join(by(held, "parent_version_id"), "parent_version_id").select("version_id", "message_id", F.col("depth") + 1)
    base = direct.select("version_id", "message_id", F.lit(0).alias("depth")).union(from_old)
    return lineage(base, own.join(new.withColumnRenamed("version_id", "parent_version_id"), "parent_version_id", "left_semi"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")
