"""The borders of the model calls: raw fields of replies as tables in, checked and normalised rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import EXTERNAL_PREFIX, clean_list, optional_text
from .candidates import KINDS
from .graph import cut, dealt

# The caps and enumerations of replies.
TIME_MODES = ("none", "current", "point", "before", "after", "range")
MAX_QUERIES, MAX_KEYWORDS, MAX_ENTITIES, MAX_REQUIREMENTS, MAX_KINDS = 3, 12, 8, 6, 6
INTENTS = ("ADD", "REVISE", "REMOVE", "PRESERVE")
SIGNATURE = ("observable_trigger", "evidence_precondition", "failed_behavior", "corrective_operation", "safety_boundary")
UNLEARNABLE = ("GENERIC_INSTRUCTION_FOLLOWING", "OTHER")
SOLVES_CHARS, WHY_CHARS, REASON_WORDS = 600, 600, 24
MAX_OPERATIONS, MAX_ADDS = 3, 1


def _list(value: Column) -> Column:
    return F.coalesce(value, F.array().cast("array<string>"))


def known_kinds(requested: Column, allowed: tuple[str, ...] = KINDS) -> Column:
    """The requested kinds that exist; null (no filter) if none does."""
    kept = F.filter(clean_list(_list(requested), MAX_KINDS), lambda k: k.isin(*allowed))
    return F.when(F.size(kept) > 0, kept)


def time_window(mode: Column, target: Column, target_end: Column) -> Column:
    """struct(mode, target, target_end): unknown modes are none; a range "a/b" without an end is split."""
    lowered = F.lower(F.coalesce(mode, F.lit("none")))
    mode = F.when(lowered.isin(*TIME_MODES), lowered).otherwise("none")
    target, target_end = optional_text(target), optional_text(target_end)
    split = (mode == "range") & F.contains(F.coalesce(target, F.lit("")), F.lit("/")) & target_end.isNull()
    return F.struct(
        mode.alias("mode"), F.when(split, F.split_part(target, F.lit("/"), F.lit(1))).otherwise(target).alias("target"),
        F.when(split, F.regexp_replace(target, "^[^/]*/", "")).otherwise(target_end).alias("target_end"),
    )


def access_plan(replies: DataFrame, question: str = "question") -> DataFrame:
    """Plans of the second round within their caps; asking for sources without a query asks the question again.

    replies: question, additional_queries, keywords, entities, include_history, include_sources,
    time_mode, target_time, target_time_end, evidence_requirements; other columns stay.
    """
    asked = clean_list(_list(F.col("additional_queries")), MAX_QUERIES)
    sources = F.coalesce("include_sources", F.lit(False))
    return replies.withColumns(
        {
            "additional_queries": F.when(sources & (F.size(asked) == 0), F.array(question)).otherwise(asked), "keywords": clean_list(_list(F.col("keywords")), MAX_KEYWORDS), "entities": clean_list(_list(F.col("entities")), MAX_ENTITIES),
            "evidence_requirements": clean_list(_list(F.col("evidence_requirements")), MAX_REQUIREMENTS), "include_history": F.coalesce("include_history", F.lit(False)), "include_sources": sources,
            "time_mode": time_window(F.col("time_mode"), F.col("target_time"), F.col("target_time_end"))["mode"], "target_time": optional_text(F.col("target_time")), "target_time_end": optional_text(F.col("target_time_end")),
        }
    )


def external_query(query: Column, expansions: Column, keywords: Column, entities: Column, target: Column, target_end: Column) -> Column:
    """The text that an external search is asked: distinct lines of queries, anchors and times."""
    trimmed = lambda v: F.filter(F.transform(F.filter(_list(v), lambda x: x.isNotNull()), lambda x: F.trim(x)), lambda x: x != "")
    anchors = F.array_distinct(F.concat(trimmed(keywords), F.filter(_list(entities), lambda x: x.isNotNull() & (x != ""))))
    time = lambda label, v: F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(label), v))
    lines = F.concat(F.array(F.trim(query)), trimmed(expansions), F.array(F.when(F.size(anchors) > 0, F.concat(F.lit("Exact anchors: "), F.array_join(anchors, ", "))), time("Target time: ", target), time("Target time end: ", target_end)))
    return F.array_join(F.array_distinct(F.filter(lines, lambda x: x.isNotNull() & (x != ""))), "\n")


def external_hits(rows: DataFrame, prefix: str = EXTERNAL_PREFIX, sources_key: str = "source_message_ids", time_key: str = "session_time") -> DataFrame:
    """External search rows (rank, id, memory_id, memory, data, score, created_at, categories, metadata map) as the store's hits; the keys name two entries of the metadata."""
    filled = lambda *cs: F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in cs])
    meta = lambda k: F.col("metadata")[k]
    own = F.coalesce(filled(F.col("id"), F.col("memory_id")), F.concat(F.lit("rank-"), F.col("rank").cast("string")))
    raw = meta(sources_key)
    ids = F.when(raw.isNull() | (raw == ""), F.array().cast("array<string>")).otherwise(F.coalesce(F.from_json(raw, "array<string>"), F.array(raw)))
    return rows.select(
        *[c for c in rows.columns if c not in ("id", "memory_id", "memory", "data", "score", "created_at", "categories", "metadata")], F.concat(F.lit(prefix), own).alias("version_id"), own.alias("memory_id"), F.coalesce(filled(F.col("memory"), F.col("data")), F.lit("")).alias("content"),
        F.coalesce(filled(meta("memory_kind")), F.lit("fact")).alias("memory_kind"), F.coalesce(filled(meta("subject")), F.lit("")).alias("subject"), filled(meta("world_start"), meta(time_key), F.col("created_at")).alias("world_start"),
        F.coalesce("categories", F.array().cast("array<string>")).alias("entities"), ids.alias("source_message_ids"), F.coalesce("score", F.lit(0.0)).alias("score"), F.when(F.coalesce("score", F.lit(0.0)) != 0, F.col("score")).otherwise(0.5).alias("confidence"),
    )


def single_pass(hits: DataFrame, answers: DataFrame, refusal: str) -> DataFrame:
    """One-search runs: run_id, step, answer, evidence; evidence lies within the hits in their order, an empty answer is the refusal.

    hits: run_id, rank, version_id; answers: run_id, answer, evidence.
    """
    shown = hits.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "version_id"))), lambda x: x["version_id"]).alias("context"))
    both = answers.join(shown, "run_id", "left").withColumn("context", _list(F.col("context")))
    return both.select("run_id", F.lit(1).alias("n_searches"), F.coalesce(optional_text(F.col("answer")), F.lit(refusal)).alias("answer"), F.array_intersect(_list(F.col("evidence")), "context").alias("evidence"), "context")


def judgments(items: DataFrame, replies: DataFrame, labels: tuple[str, ...] = ("C", "P", "I")) -> DataFrame:
    """qa_id, label, reason, fallback: batch judgments that name exactly the batch's items in order; items of other batches are to be judged one by one.

    items: batch_id, position, qa_id; replies: batch_id, position, qa_id, label, reason.  A label
    outside the enumeration also calls for the fallback; reasons keep their first 24 words.
    """
    label = F.upper(F.trim("label"))
    r = replies.select("batch_id", "position", F.col("qa_id").alias("_qa"), F.when(label.isin(*labels), label).alias("label"), "reason")
    both = items.join(r, ["batch_id", "position"], "full_outer")
    fit = F.min((F.col("qa_id").eqNullSafe(F.col("_qa")) & F.col("label").isNotNull()).cast("int")).over(Window.partitionBy("batch_id"))
    short = F.array_join(F.slice(F.split(F.trim(F.coalesce("reason", F.lit(""))), r"\s+"), 1, REASON_WORDS), " ")
    return both.withColumn("_fit", fit).where("qa_id IS NOT NULL").select("qa_id", F.when(F.col("_fit") == 1, F.col("label")).alias("label"), F.when(F.col("_fit") == 1, short).alias("reason"), (F.col("_fit") == 0).alias("fallback"))


def answer_diagnosis(reports: DataFrame, claims: DataFrame) -> DataFrame:
    """run_id, sufficient, problem, failure_mode, learnable.

    reports: run_id, judge_label, reference, contradiction, supports_abstention, failure_mode,
    observable_trigger, corrective_operation, requested_learnable; claims: run_id, coverage,
    n_support.  With a reference the context suffices if all claims are fully covered with support,
    without one if it supports abstention; never against a contradiction.
    """
    full = claims.groupBy("run_id").agg(F.min(((F.upper("coverage") == "FULL") & (F.col("n_support") > 0)).cast("int")).alias("_full"))
    both = reports.join(full, "run_id", "left")
    asked = F.trim(F.coalesce("reference", F.lit(""))) != ""
    clear = ~F.coalesce("contradiction", F.lit(False))
    sufficient = F.when(asked, F.coalesce(F.col("_full"), F.lit(0)) == 1).otherwise(F.coalesce("supports_abstention", F.lit(False))) & clear
    mode = F.upper(F.trim(F.coalesce("failure_mode", F.lit("OTHER"))))
    given = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    problem = F.col("judge_label").isin("P", "I", "W") & F.col("sufficient")
    out = both.withColumn("sufficient", sufficient).withColumn("problem", problem).withColumn("failure_mode", mode)
    learnable = F.col("problem") & F.coalesce("requested_learnable", F.lit(False)) & given("observable_trigger") & given("corrective_operation") & ~F.col("failure_mode").isin(*UNLEARNABLE)
    return out.select("run_id", "sufficient", "problem", "failure_mode", learnable.alias("learnable"))


def access_ladder(needed: Column, returned: Column, in_store: Column) -> Column:
    """Why an access run is or is not to blame: nothing needed, nothing missing, missing from the store, or not returned."""
    missing = F.array_except(_list(needed), _list(returned))
    return F.when(F.size(_list(needed)) == 0, "no_evidence_needed").when(F.size(missing) == 0, "all_returned").when(F.size(F.array_intersect(missing, _list(in_store))) == 0, "not_in_store").otherwise("not_returned")


def construction_history(screened: DataFrame, history: DataFrame, first_error: DataFrame) -> DataFrame:
    """The construction history of screened items up to their first wrong commit; screened: qa_id, problem; history: qa_id, commit_id, more; first_error: qa_id, commit_id (must be known)."""
    unknown = first_error.join(history, ["qa_id", "commit_id"], "left_anti").take(1)
    if unknown:
        raise ValueError(f"unknown commit: {unknown[0]}")
    cut = history.join(screened.where("problem").select("qa_id"), "qa_id", "left_semi").join(first_error.select("qa_id", F.col("commit_id").alias("_last")), "qa_id", "left")
    return cut.where("_last IS NULL OR commit_id <= _last").drop("_last")


def diagnosis_route(construction_problem: Column, access_problem: Column) -> Column:
    """Which component a case goes to: construction comes first, since access cannot find what was never stored."""
    return F.when(F.coalesce(construction_problem, F.lit(False)), "CONSTRUCTION").when(F.coalesce(access_problem, F.lit(False)), "ACCESS").otherwise("NONE")


def attributed(claims: DataFrame, allowed: DataFrame) -> DataFrame:
    """claims (case_id, side, claim, ids) with the ids that their side may cite; those with neither text nor ids are left out; allowed: case_id, side, id."""
    each = claims.select("case_id", "side", "claim", F.posexplode_outer(F.array_distinct(_list(F.col("ids")))).alias("k", "id"))
    ok = each.join(allowed.select("case_id", "side", "id").distinct().withColumn("_ok", F.lit(True)), ["case_id", "side", "id"], "left")
    kept = ok.groupBy("case_id", "side", "claim").agg(F.array_sort(F.collect_list(F.when(F.col("_ok"), F.struct("k", "id")))).alias("x"))
    return kept.select("case_id", "side", F.trim("claim").alias("claim"), F.transform("x", lambda x: x["id"]).alias("ids")).where("claim <> '' OR size(ids) > 0")


def signature(raw: Column) -> Column:
    """The five trimmed fields of a mechanism (a map), or null if one is missing."""
    fields = [F.trim(F.coalesce(raw[f], F.lit(""))) for f in SIGNATURE]
    whole = fields[0] != ""
    for f in fields[1:]:
        whole = whole & (f != "")
    return F.when(whole, F.struct(*[f.alias(n) for f, n in zip(fields, SIGNATURE, strict=True)]))


def maintenance_intent(said: Column, hint: Column, transition: Column, n_related: Column) -> Column:
    """The stated intent if it is one, else by the transition: kept gains are preserved, failures revise what is related, all else adds."""
    stated = F.upper(F.coalesce(optional_text(said), optional_text(hint), F.lit("")))
    way = F.upper(F.coalesce(transition, F.lit("")))
    return F.when(stated.isin(*INTENTS), stated).when(way == "W2C", "PRESERVE").when(way.isin("C2W", "W2W") & (n_related > 0), "REVISE").otherwise("ADD")


def candidate_errors(side: Column, solves: Column, mechanism: Column, payload_errors: Column) -> Column:
    """What is wrong with a generated candidate beyond its payload."""
    solves = F.trim(F.coalesce(solves, F.lit("")))
    own = F.array_compact(F.array(F.when(solves == "", "solves is empty"), F.when((side == "access") & mechanism.isNull(), "no complete mechanism"), F.when(F.length(solves) > SOLVES_CHARS, "solves too long")))
    return F.concat(payload_errors, own)


def remapped_sources(operations: DataFrame, ownership: DataFrame) -> DataFrame:
    """bank, seq, draft_ids: a cited source candidate stands for the draft that alone owns it; drafts stay, the rest is dropped.

    operations: bank, seq, cited (array); ownership: bank, draft_id, source_id.
    """
    alone = ownership.groupBy("bank", "source_id").agg(F.count_distinct("draft_id").alias("n"), F.min("draft_id").alias("owner")).where("n = 1")
    drafts = ownership.select("bank", F.col("draft_id").alias("id"), F.col("draft_id").alias("draft")).distinct()
    known = drafts.unionByName(alone.select("bank", F.col("source_id").alias("id"), F.col("owner").alias("draft")).join(drafts.select("bank", "id"), ["bank", "id"], "left_anti"))
    each = operations.select("bank", "seq", F.explode("cited").alias("id")).join(known, ["bank", "id"])
    found = each.groupBy("bank", "seq").agg(F.sort_array(F.collect_set("draft")).alias("draft_ids"))
    return operations.select("bank", "seq").join(found, ["bank", "seq"], "left").withColumn("draft_ids", _list(F.col("draft_ids")))


def cluster_errors(members: DataFrame, drafts: DataFrame, rejected: DataFrame, sides: DataFrame) -> DataFrame:
    """cluster_id, error: what a cluster's summary leaves out or contradicts.

    members: cluster_id, candidate_id; drafts: cluster_id, draft, candidate_id (a row for each
    source); rejected: cluster_id, candidate_id; sides: cluster_id, side.
    """
    keys = ["cluster_id", "candidate_id"]
    rows = members.count()
    told = {"member": members, "used": drafts, "rejected": rejected}
    every = None
    for name, df in told.items():
        # Null meets nothing, so a null key is only told of by its own table.
        own = df.select(*keys, *[F.lit(name == n).alias(n) for n in told], F.when(F.col("cluster_id").isNull() | F.col("candidate_id").isNull(), name).alias("alone"))
        every = own if every is None else every.unionByName(own)
    once = dealt(every, 3 * rows, *keys).groupBy(*keys, "alone").agg(*[F.max(n).alias(n) for n in told])
    say = lambda when, text, c="candidate_id": F.when(when, F.struct(F.concat(F.lit(text), F.col(c).cast("string")).alias("error")))
    member, used, out = (F.col(n) for n in told)
    found = F.array_compact(F.array(say(used & ~member, "unknown source: "), say(out & ~member, "unknown rejected: "), say(used & out, "used and rejected: "), say(member & ~used & ~out, "left out: ")))
    by_candidate = once.select("cluster_id", F.explode(found).alias("x")).select("cluster_id", "x.error")

    n = cut(dealt(drafts.select("cluster_id", "draft", "candidate_id"), 2 * rows, "cluster_id", "draft").groupBy("cluster_id", "draft").agg(F.count_distinct("candidate_id").alias("n")))
    few = n.join(sides, "cluster_id").where("side = 'access' AND n < 2").select("cluster_id", F.concat(F.lit("too few sources: "), F.col("draft").cast("string")).alias("error"))
    many = n.groupBy("cluster_id").agg(F.count("draft").alias("n")).where("n > 5").select("cluster_id", F.concat(F.lit("too many drafts: "), F.col("n").cast("string")).alias("error"))
    return by_candidate.unionByName(few).unionByName(many)


def policy_errors(operations: DataFrame, banks: DataFrame, most: int = MAX_OPERATIONS, adds: int = MAX_ADDS) -> DataFrame:
    """bank, error: plans with too many operations or additions, or that would pass the bank's cap; banks: bank, size, cap."""
    n = operations.groupBy("bank").agg(F.count("*").alias("n"), F.count_if(F.col("operation") == "add_skill").alias("a"), F.count_if(F.col("operation") == "delete_skill").alias("d"))
    both = n.join(banks, "bank")
    found = F.array_compact(F.array(F.when(F.col("n") > most, "too many operations"), F.when(F.col("a") > adds, "too many additions"), F.when(F.col("size") + F.col("a") - F.col("d") > F.col("cap"), "the bank is full")))
    return both.select("bank", F.explode(found).alias("error"))


def draft_provenance(drafts: DataFrame, candidates: DataFrame) -> DataFrame:
    """draft_id, transitions, failure_age, intent, why: what a draft inherits from its sources.

    drafts: draft_id, position, candidate_id; candidates: candidate_id, transition, failure_age,
    intent, why.  Mixed intents are a revision.
    """
    met = drafts.join(candidates, "candidate_id")
    said = lambda c: F.nullif(F.col(c), F.lit(""))
    why = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(said("why").isNotNull(), F.struct("position", "why")))), lambda x: x["why"]))
    return met.groupBy("draft_id").agg(
        F.array_join(F.sort_array(F.collect_set(said("transition"))), ",").alias("transitions"), F.max("failure_age").alias("failure_age"),
        F.when(F.count_distinct("intent") == 1, F.min("intent")).otherwise("REVISE").alias("intent"), F.substring(F.array_join(why, " | "), 1, WHY_CHARS).alias("why"),
    )


def stable_id(prefix: Column, ids: Column, chars: int = 10) -> Column:
    """A name that the set of ids gives, in whatever order they come."""
    return F.concat_ws("_", prefix, F.substring(F.sha2(F.to_json(F.sort_array(F.transform(ids, lambda x: x.cast("string")))), 256), 1, chars))


def package_gate(packages: DataFrame, accepted: tuple[str, ...], train: DataFrame) -> DataFrame:
    """Packages that may teach: of an accepted type, completed, with a problem and no review, answer failures learnable, of a training conversation; each diagnosis once.

    packages: diagnosis_id, position, diagnosis_type, status, problem_found, review_required,
    sufficient, learnable, eligible, failure_scope, conversation_id.
    """
    true, false = (lambda c: F.coalesce(F.col(c), F.lit(False))), (lambda c: ~F.coalesce(F.col(c), F.lit(True)))
    taught = (F.col("diagnosis_type") != "ANSWER_FAILURE") | (true("sufficient") & true("learnable") & true("eligible") & (F.coalesce("failure_scope", F.lit("")) == "memory_answering_procedure"))
    ok = packages.where(F.col("diagnosis_type").isin(*accepted) & (F.col("status") == "completed") & true("problem_found") & false("review_required") & taught).join(train.select("conversation_id").distinct(), "conversation_id", "left_semi")
    w = Window.partitionBy("diagnosis_id").orderBy("position")
    return ok.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def eligible(results: DataFrame, legacy: bool = False) -> DataFrame:
    """Answers worth a diagnosis: by score below 0.5 (legacy) or by a judge's label other than C; none with an error."""
    return results.where(F.col("error").isNull() & ((F.col("f1") < 0.5) if legacy else (F.col("label") != "C")))


def source_candidates(candidates: DataFrame, side: str, prefix: str) -> DataFrame:
    """Candidates of a side that come from a diagnosis, not from a cluster; raises ValueError on a repeated id."""
    own = candidates.where(F.col("candidate_id").startswith(prefix) & (F.coalesce("source_cluster_id", F.lit("")) == "") & (F.col("side") == side))
    twice = own.groupBy("candidate_id").count().where("count > 1").take(1)
    if twice:
        raise ValueError(f"repeated candidate: {twice[0].candidate_id}")
    return own


def without_stale(candidates: DataFrame, clean: bool) -> DataFrame:
    """Candidates for a merge; those of a clean set lose their references to the bank."""
    empty = {"related_existing_skill_ids": F.array().cast("array<string>"), "expected_skill_version": F.lit(None).cast("int")}
    return candidates.withColumns(empty) if clean else candidates


def required_ids(ids: DataFrame, allowed: DataFrame, key: str) -> None:
    """Raises ValueError if an id is not allowed."""
    bad = ids.select(key).join(allowed.select(key), key, "left_anti").take(1)
    if bad:
        raise ValueError(f"unknown id: {bad[0][key]}")


def split_errors(split: DataFrame, expected: DataFrame) -> DataFrame:
    """error, unit: units that a split lists twice in a set, in two sets, not at all, or without knowing them; split: set, unit; expected: unit."""
    n = split.groupBy("unit").agg(F.count("*").alias("n"), F.count_distinct("set").alias("sets"))
    every = n.join(expected.select("unit").distinct().withColumn("known", F.lit(True)), "unit", "full_outer")
    found = F.array_compact(F.array(F.when(F.col("n").isNull(), "missing"), F.when(F.col("known").isNull(), "unknown"), F.when(F.col("sets") > 1, "overlap"), F.when(F.col("n") > F.col("sets"), "duplicate")))
    return every.select(F.explode(found).alias("error"), "unit")


def keys_anywhere(document: Column, key: str = "skill_id") -> Column:
    """All text values of a key at any depth of a JSON text, distinct and sorted."""
    name = key.replace("\\", "\\\\")
    found = F.regexp_extract_all(F.coalesce(document, F.lit("")), F.lit(r'"' + name + r'"\s*:\s*("(?:[^"\\]|\\.)*"|-?\d+(?:\.\d+)?)'), F.lit(1))
    text = F.transform(found, lambda x: F.when(x.startswith('"'), F.get_json_object(F.concat(F.lit('{"x":'), x, F.lit("}")), "$.x")).otherwise(x))
    return F.array_sort(F.array_distinct(F.filter(text, lambda x: x != "")))


def gate_phase(work: DataFrame, attempted: DataFrame, keys: list[str]) -> None:
    """Raises ValueError until every item has been attempted by the phase before (status completed, model_error or data_error)."""
    done = attempted.where(F.lower("status").isin("completed", "model_error", "data_error")).select(*keys)
    missing = work.select(*keys).join(done, keys, "left_anti")
    first = missing.take(1)
    if first:
        raise ValueError(f"{missing.count()} items not attempted, such as {first[0]}")
