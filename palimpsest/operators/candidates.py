"""What is done around a model's replies: replies come as tables and leave as checked rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import bounded, clean_list, content_hash, optional_text

KINDS = ("event", "fact", "preference", "relationship", "plan", "profile", "state")
MAX_CANDIDATES = 30
RELATIONS = ("supports", "contradicts", "supersedes", "duplicate_of", "refines")
REFUSAL = "No information available."


def admitted(replies: DataFrame, allowed: DataFrame, kinds: tuple[str, ...] = KINDS, most: int = MAX_CANDIDATES) -> DataFrame:
    """Extracted facts that may enter the store.

    replies: conversation_id, session_id, position and the raw fields; allowed: session_id,
    message_id.  Of the first ``most`` replies those with a text and a source of their session
    stay, the first of equal texts; unknown kinds become "event"; ids count the survivors.
    """
    first = replies.where(F.col("position") < most).withColumn("content", F.trim(F.coalesce("content", F.lit("")))).where("content <> ''")
    cited = first.select("session_id", "position", F.posexplode(F.array_distinct("source_message_ids")).alias("k", "message_id")).join(allowed.select("session_id", "message_id").distinct(), ["session_id", "message_id"], "left_semi")
    sources = cited.groupBy("session_id", "position").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "message_id"))), lambda x: x["message_id"]).alias("sources"))
    kind = F.lower(F.coalesce("memory_kind", F.lit("event")))
    rows = first.drop("source_message_ids").join(sources, ["session_id", "position"]).withColumns(
        {
            "memory_kind": F.when(kind.isin(*kinds), kind).otherwise("event"), "subject": F.coalesce(optional_text(F.col("subject")), F.lit("conversation participants")),
            "predicate": optional_text(F.col("predicate")), "object_text": optional_text(F.col("object_text")), "world_start": optional_text(F.col("world_start")), "world_end": optional_text(F.col("world_end")),
            "entities": clean_list(F.coalesce("entities", F.array().cast("array<string>")), 100), "keywords": clean_list(F.coalesce("keywords", F.array().cast("array<string>")), 100),
            "importance": bounded(F.col("importance"), 0.5), "confidence": bounded(F.col("confidence"), 0.8), "content_hash": content_hash(F.col("content")),
        }
    )
    own = Window.partitionBy("session_id", "content_hash").orderBy("position")
    unique = rows.withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n")
    ordinal = F.row_number().over(Window.partitionBy("session_id").orderBy("position")) - 1
    return unique.withColumn("candidate_id", F.format_string("cand_%s_%s_%03d", "conversation_id", "session_id", ordinal)).withColumnRenamed("sources", "source_message_ids")


def rejected_sessions(replies: DataFrame, kept: DataFrame) -> DataFrame:
    """Sessions that had replies of which none was admitted."""
    return replies.select("session_id").distinct().join(kept, "session_id", "left_anti")


def decided(decisions: DataFrame, candidates: DataFrame, visible_ids: DataFrame) -> DataFrame:
    """One decision for each candidate: relations of known kind to visible versions; a SKIP without a duplicate becomes an ADD; none given is an ADD."""
    edges = decisions.select("candidate_id", F.explode_outer("relations").alias("r")).select("candidate_id", "r.relation_type", F.col("r.target_version_id").alias("version_id")).where(F.col("relation_type").isin(*RELATIONS))
    seen = edges.join(visible_ids.select("version_id").distinct(), "version_id", "left_semi").groupBy("candidate_id").agg(F.array_sort(F.collect_set(F.struct("relation_type", "version_id"))).alias("relations"))
    first = decisions.groupBy("candidate_id").agg(F.min_by("action", "seq").alias("action"))
    out = candidates.select("candidate_id").join(first, "candidate_id", "left").join(seen, "candidate_id", "left")
    duplicate = F.exists(F.coalesce("relations", F.array().cast("array<struct<relation_type:string,version_id:string>>")), lambda r: r["relation_type"] == "duplicate_of")
    return out.withColumn("action", F.when((F.upper("action") == "SKIP") & duplicate, "SKIP").otherwise("ADD"))


def answered(prediction: Column, evidence: Column, context: Column) -> tuple[Column, Column]:
    """Answer and evidence within the shown context; an empty answer is the fixed refusal."""
    return F.coalesce(optional_text(prediction), F.lit(REFUSAL)), F.array_intersect(evidence, context)


def missing_evidence(needed: Column, returned: Column) -> Column:
    return F.array_except(needed, returned)


def sufficient(claims: Column) -> Column:
    """All claims fully covered, supported and not contradicted; claims: array of struct(coverage, support, contradicted)."""
    return (F.size(claims) > 0) & F.forall(claims, lambda c: (c["coverage"] == "FULL") & (F.size(c["support"]) > 0) & ~F.coalesce(c["contradicted"], F.lit(False)))


def repaired(evidence: DataFrame, hits: DataFrame) -> DataFrame:
    """run_id, position, version_id: memory ids replaced by the first version returned for them, unknown ids left out."""
    first = hits.groupBy("run_id", "memory_id").agg(F.min_by("version_id", F.struct("step_index", "rank")).alias("found"))
    own = hits.select("run_id", F.col("version_id").alias("evidence_id")).distinct().withColumn("known", F.lit(True))
    out = evidence.join(own, ["run_id", "evidence_id"], "left").join(first.withColumnRenamed("memory_id", "evidence_id"), ["run_id", "evidence_id"], "left")
    return out.select("run_id", "position", F.when(F.col("known"), F.col("evidence_id")).otherwise(F.col("found")).alias("version_id")).where("version_id IS NOT NULL")
