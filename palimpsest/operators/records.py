"""What the store keeps beside the versions: provenance of a commit, traces of an access run, cases, and the joins that read them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from . import store
from .candidates import RELATIONS

DIRECT = "direct_support"
SHOWN_FIELDS = ("version_id", "memory_id", "content", "memory_kind", "subject", "predicate", "object_text", "world_start", "world_end", "source_message_ids")


def edges(rows: DataFrame, key: str, messages: str = "source_message_ids") -> DataFrame:
    """key, message_id, relation: each direct source once."""
    return rows.select(key, F.explode(messages).alias("message_id")).dropDuplicates().withColumn("relation", F.lit(DIRECT))


def allocated(decisions: DataFrame, conversation: str, highest_row: Column, own_highest: Column | None = None) -> DataFrame:
    """decisions with row_id (of those that insert a version) and the memory id that an ADD opens.

    Rows are numbered over all conversations, one for each inserted version in the order of seq;
    memories go on from the conversation's own highest row (``highest_row`` unless given), one for
    each ADD, so the numbers of one conversation's memories skip between plans.  A plan holds a
    session's candidates, thirty at most, so its numbering is one small group.
    """
    inserts, adds = F.col("action").isin("ADD", "UPDATE", "MERGE"), F.col("action") == "ADD"
    so_far = lambda kind: F.sum(kind.cast("long")).over(Window.partitionBy(F.lit(conversation)).orderBy("seq"))
    numbered = decisions.withColumn("row_id", F.when(inserts, F.coalesce(highest_row, F.lit(0)) + so_far(inserts)))
    number = F.coalesce(highest_row if own_highest is None else own_highest, F.lit(0)) + so_far(adds)
    return numbered.withColumn("opened_memory_id", F.when(adds, F.format_string("mem_%s_%04d", F.lit(conversation), number)))


def decision_records(decisions: DataFrame, commit: Column) -> DataFrame:
    """One row for each decision, SKIP included: its id, what it did and that it was accepted."""
    at = F.row_number().over(Window.partitionBy("commit_id").orderBy("seq")) - 1
    numbered = decisions.withColumn("commit_id", commit).withColumn("decision_index", at)
    return numbered.select(
        F.format_string("decision_%d_%03d", F.col("commit_id").cast("long"), "decision_index").alias("decision_id"), "commit_id", "candidate_id", "decision_index", "action", "target_memory_id", F.lit("accepted").alias("validation_status")
    )


def relation_edges(decisions: DataFrame) -> DataFrame:
    """candidate_id, version_id, relation: the stored relations; "unrelated" and unknown kinds are dropped."""
    each = decisions.select("candidate_id", F.explode("relations").alias("r")).select("candidate_id", F.col("r.target_version_id").alias("version_id"), F.lower("r.relation_type").alias("relation"))
    return each.where(F.col("relation").isin(*RELATIONS) & F.col("version_id").isNotNull()).dropDuplicates()


def commit_plan(versions: DataFrame, decisions: DataFrame, candidates: DataFrame, inputs: DataFrame, conversation: str, commit: int, base_commit: int | None = None, current_commit: int | None = None) -> dict[str, DataFrame]:
    """All that a commit adds to the store, or PlanError and nothing.

    Beside the tables of ``store.apply_plan``: commit, inputs (commit_id, message_id), candidates,
    candidate_edges, decisions, relations, version_edges and inherited (the messages that the new
    versions rest on, by the shortest chain).  candidates: candidate_id, source_message_ids and
    fields; inputs: message_id.
    """
    state = store.apply_plan(versions, decisions, conversation, commit, base_commit, current_commit)
    at = F.lit(commit).cast("long")
    sources = candidates.select("candidate_id", "source_message_ids")
    made = state["events"].select("candidate_id", "version_id").join(sources, "candidate_id")
    direct = edges(made, "version_id")
    with_relations = decisions if "relations" in decisions.columns else decisions.withColumn("relations", F.expr("cast(array() as array<struct<relation_type:string,target_version_id:string>>)"))
    return state | {
        "commit": versions.sparkSession.createDataFrame([(commit, conversation, "committed")], "commit_id long, conversation_id string, status string"),
        "inputs": inputs.select("message_id").dropDuplicates().withColumn("commit_id", at),
        "candidates": candidates.withColumn("commit_id", at),
        "candidate_edges": edges(candidates, "candidate_id"),
        "decisions": decision_records(decisions, at),
        "relations": relation_edges(with_relations),
        "version_edges": direct,
        "inherited": store.lineage(direct.select("version_id", "message_id"), state["parents"]),
    }


def inserted(versions: DataFrame, new: DataFrame) -> DataFrame:
    """versions with new ones (conversation_id, content_hash) whose text is not active in its conversation yet; of equal new texts one stays."""
    active = store.snapshot(versions).select("conversation_id", "content_hash").distinct()
    fresh = new.dropDuplicates(["conversation_id", "content_hash"]).join(active, ["conversation_id", "content_hash"], "left_anti")
    return versions.unionByName(fresh, allowMissingColumns=True)


def closed(versions: DataFrame, closing: DataFrame) -> DataFrame:
    """versions after closing active ones; closing: version_id, commit_id, end_reason.  Closed ones stay as they are."""
    asked = closing.select("version_id", F.col("commit_id").alias("_at"), F.col("end_reason").alias("_why"))
    both = versions.join(asked, "version_id", "left")
    now = F.col("system_to").isNull() & F.col("_at").isNotNull()
    return both.withColumn("end_reason", F.when(now, F.col("_why")).otherwise(F.col("end_reason"))).withColumn("system_to", F.when(now, F.col("_at")).otherwise(F.col("system_to"))).select(*versions.columns)


def access_trace(hits: DataFrame, context: DataFrame, evidence: DataFrame, versions: DataFrame, messages: DataFrame) -> dict[str, DataFrame]:
    """The rows of a finished access run, by kind of id.

    hits: run_id, action_id, evidence_id, rank, score; context: run_id, context_index, evidence_id,
    text; evidence: run_id, evidence_index, evidence_id.  A hit is kept in the workspace if the
    answer's context shows it.  Evidence that names no stored version or message is left out, the
    run is kept.
    """
    kind = scalars.id_kind(F.col("evidence_id"))
    bare = scalars.bare_id(F.col("evidence_id"))
    seen = context.select("run_id", "evidence_id").distinct().withColumn("_seen", F.lit(True))
    ranked = hits.join(seen, ["run_id", "evidence_id"], "left").select("run_id", "action_id", kind.alias("kind"), bare.alias("id"), "rank", "score", F.coalesce("_seen", F.lit(False)).alias("kept_in_workspace"))
    shown = context.select("run_id", kind.alias("kind"), bare.alias("id"), "context_index", "text")
    known = versions.select(F.lit("version").alias("kind"), F.col("version_id").alias("id")).unionByName(messages.select(F.lit("source").alias("kind"), F.col("message_id").alias("id"))).distinct()
    cited = evidence.select("run_id", kind.alias("kind"), bare.alias("id"), "evidence_index")
    stored = cited.where("kind = 'external'").unionByName(cited.where("kind <> 'external'").join(known, ["kind", "id"], "left_semi").select(*cited.columns))
    first = stored.groupBy("run_id", "kind", "id").agg(F.min("evidence_index").alias("evidence_index"))
    return {"hits": ranked, "context": shown, "evidence": first}


def qa_cases(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cases with later ones in place of earlier of the same qa_id, and qa_id, message_id of the gold messages that they name."""
    cases = store.upsert(old, new, ["qa_id"])
    return cases, cases.select("qa_id", F.explode("gold_message_ids").alias("message_id")).dropDuplicates()


def skill_traces(commits: DataFrame, inputs: DataFrame, messages: DataFrame, as_of: int | None = None) -> DataFrame:
    """The commits, once each, that processed one of the messages, up to a commit; commits: commit_id, conversation_id, more."""
    asked = inputs.join(messages.select("message_id").distinct(), "message_id", "left_semi").select("commit_id").distinct()
    return (commits if as_of is None else commits.where(F.col("commit_id") <= as_of)).join(asked, "commit_id", "left_semi")


def inspected(versions: DataFrame, version_edges: DataFrame, messages: DataFrame, asked: DataFrame) -> DataFrame:
    """The version chain of each asked memory with its source messages in order; asked: conversation_id, memory_id, as_of."""
    chain = versions.join(asked.select("conversation_id", "memory_id", "as_of"), ["conversation_id", "memory_id"]).where("as_of IS NULL OR system_from <= as_of")
    said = version_edges.join(messages.select("message_id", F.col("content").alias("said")), "message_id")
    held = said.groupBy("version_id").agg(F.array_sort(F.collect_set(F.struct("message_id", "said"))).alias("sources"))
    return chain.join(held, "version_id", "left").select("memory_id", "version_id", "version_no", "content", "system_from", "system_to", F.coalesce("sources", F.expr("cast(array() as array<struct<message_id:string,said:string>>)")).alias("sources"))


def examples(version_edges: DataFrame, messages: DataFrame, most: int = 6) -> DataFrame:
    """version_id, place, message_id: each version's first messages in order, at most ``most``."""
    w = Window.partitionBy("version_id").orderBy("message_id")
    met = version_edges.select("version_id", "message_id").dropDuplicates().join(messages.select("message_id").distinct(), "message_id", "left_semi")
    return met.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def used_versions(evidence: DataFrame, runs: DataFrame) -> DataFrame:
    """conversation_id, version_id, times: the versions that finished runs cite."""
    return evidence.join(runs.where("status = 'completed'").select("run_id", "conversation_id"), "run_id").where("kind = 'version'").groupBy("conversation_id", F.col("id").alias("version_id")).agg(F.countDistinct("run_id").alias("times"))


def inherited_as_of(closure: DataFrame, versions: DataFrame, as_of: Column | None) -> DataFrame:
    """conversation_id, message_id, depth: the messages that the versions in force rest on, each by its shortest chain."""
    now = versions.where(store.visible(as_of)).select("version_id", "conversation_id")
    return closure.join(now, "version_id").groupBy("conversation_id", "message_id").agg(F.min("depth").alias("depth"))


def current_chain(steps: DataFrame, current: DataFrame) -> DataFrame:
    """Search steps with only current ids in their nested hits; steps: run_id, step_index, returned (array of struct with version_id); current: run_id, version_id."""
    hit = steps.select("run_id", "step_index", F.posexplode("returned").alias("k", "hit"))
    kept = hit.join(current.select("run_id", F.col("version_id").alias("_v")).distinct(), (F.col("hit.version_id") == F.col("_v")) & (hit["run_id"] == current["run_id"]), "left_semi")
    ids = kept.groupBy("run_id", "step_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", F.col("hit.version_id").alias("v")))), lambda x: x["v"]).alias("returned_version_ids"))
    return steps.select("run_id", "step_index").join(ids, ["run_id", "step_index"], "left").withColumn("returned_version_ids", F.coalesce("returned_version_ids", F.array().cast("array<string>")))


def sanitized(memory: Column, fields: tuple[str, ...] = SHOWN_FIELDS) -> Column:
    """A memory struct with the shown fields only."""
    return F.struct(*[memory[f].alias(f) for f in fields])


def related(candidates: DataFrame, memories: DataFrame, k: int, semantic: DataFrame | None = None, cap: int = 8) -> DataFrame:
    """candidate_id, version_id, paths, score: memories related to each candidate, by number of paths, then score, at most ``cap``.

    candidates, memories: scope, id, content_hash, subject, predicate, entities (memories also
    content).  Routes: the same text; the same subject and predicate; one of the candidate's first
    five entities as an entity of the memory or anywhere in its text or subject; and ``semantic``
    (candidate_id, version_id, score).  Each route keeps the k smallest ids of a candidate.  The
    first two look a key's k + 1 smallest memories up, so a key that many share costs no pairs.
    """
    from .search import held_phrases

    def by_key(keys: list[str], path: str) -> DataFrame:
        w = Window.partitionBy("scope", *keys).orderBy("version_id")
        few = memories.where(" AND ".join(f"{c} IS NOT NULL" for c in keys)).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).select("scope", *keys, "version_id")
        return candidates.select("scope", "candidate_id", *keys).join(few, ["scope", *keys]).select("candidate_id", "version_id", F.lit(path).alias("path"), F.lit(1.0).alias("score"))

    own = candidates.select("scope", "candidate_id", F.explode(F.slice(F.array_distinct(F.coalesce("entities", F.array().cast("array<string>"))), 1, 5)).alias("term")).select("scope", "candidate_id", F.lower("term").alias("term"))
    named = memories.select("scope", F.col("version_id").alias("doc_id"), F.explode(F.coalesce("entities", F.array().cast("array<string>"))).alias("term")).withColumn("term", F.lower("term")).withColumn("field", F.lit("entities"))
    inside = held_phrases(memories.withColumnRenamed("version_id", "doc_id"), {"content": F.concat_ws("\n", "subject", "content")}, own)
    w = Window.partitionBy("scope", "term").orderBy("doc_id")
    few = named.unionByName(inside).select("scope", "term", "doc_id").withColumn("_n", F.dense_rank().over(w)).where(F.col("_n") <= k).dropDuplicates()  # ranked before equal rows fall, so that Spark cuts before the exchange
    met = own.join(few, ["scope", "term"]).select("candidate_id", F.col("doc_id").alias("version_id")).dropDuplicates()
    mine = Window.partitionBy("candidate_id").orderBy("version_id")
    entity = met.withColumn("_n", F.row_number().over(mine)).where(F.col("_n") <= k).select("candidate_id", "version_id", F.lit("entity").alias("path"), F.lit(1.0).alias("score"))
    every = by_key(["content_hash"], "hash").unionByName(by_key(["subject", "predicate"], "slot")).unionByName(entity)
    if semantic is not None:
        every = every.unionByName(semantic.select("candidate_id", "version_id", F.lit("semantic").alias("path"), "score"))
    order = F.array(*[F.lit(p) for p in ("hash", "slot", "entity", "semantic")])
    found = every.groupBy("candidate_id", "version_id").agg(F.array_sort(F.collect_set(F.struct(F.array_position(order, F.col("path")).alias("k"), "path"))).alias("p"), F.max("score").alias("score"))
    rank = Window.partitionBy("candidate_id").orderBy(F.size("p").desc(), F.col("score").desc(), "version_id")
    top = found.withColumn("place", F.row_number().over(rank)).where(F.col("place") <= cap)
    return top.select("candidate_id", "place", "version_id", F.array_join(F.transform("p", lambda x: x["path"]), ",").alias("paths"), "score")


def pool(related_hits: DataFrame, most: int = 24) -> DataFrame:
    """batch_id, version_id, place: each candidate's best first, then the best of all by number of paths and score, at most ``most``.

    related_hits: batch_id, seq (the candidate's order), candidate_id, place, version_id, n_paths, score.
    """
    best = F.min(F.when(F.col("place") == 1, F.col("seq")))
    once = related_hits.groupBy("batch_id", "version_id").agg(best.alias("first"), F.max(F.struct("n_paths", "score")).alias("x"))
    w = Window.partitionBy("batch_id").orderBy(F.col("first").isNull(), F.col("first"), F.col("x.n_paths").desc(), F.col("x.score").desc(), "version_id")
    return once.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("batch_id", "version_id", "place", F.col("first").isNotNull().alias("sure"))


def judged(predictions: DataFrame, judgments: DataFrame) -> DataFrame:
    """predictions with their one judgment; raises ValueError where one is missing, repeated or too many."""
    n = judgments.groupBy("qa_id").agg(F.count("*").alias("n"))
    both = predictions.select("qa_id").withColumn("p", F.lit(1)).join(n, "qa_id", "full_outer")
    bad = both.where("n IS NULL OR p IS NULL OR n > 1").select("qa_id").take(1)
    if bad:
        raise ValueError(f"not judged once: {bad[0].qa_id}")
    return predictions.join(judgments, "qa_id")


def work_items(predictions: DataFrame, judgments: DataFrame, questions: DataFrame, not_correct: tuple[str, ...] = ("P", "I", "W")) -> DataFrame:
    """The answers to diagnose: judged not correct and without error, with their question; raises ValueError on a repeated key or an unknown question."""
    wrong = judgments.where(F.col("label").isin(*not_correct)).select("qa_id", "label", "reason")
    items = predictions.where("error IS NULL").join(wrong, "qa_id")
    twice = items.groupBy("conversation_id", "qa_id").count().where("count > 1").take(1)
    if twice:
        raise ValueError(f"repeated item: {twice[0].qa_id}")
    unknown = items.join(questions, "qa_id", "left_anti").take(1)
    if unknown:
        raise ValueError(f"no such question: {unknown[0].qa_id}")
    return items.join(questions, "qa_id")


def question_info(dataset: DataFrame, runs: DataFrame) -> DataFrame:
    """qa_id, question, reference, from_dataset: the dataset's row, else the first seen over the sorted runs; runs: run, seq, qa_id, question, reference."""
    own = dataset.groupBy("qa_id").agg(F.first("question").alias("question"), F.first("reference").alias("reference")).withColumn("from_dataset", F.lit(True))
    seen = runs.groupBy("qa_id").agg(F.min_by(F.struct("question", "reference"), F.struct("run", "seq")).alias("x")).select("qa_id", "x.question", "x.reference", F.lit(False).alias("from_dataset"))
    return own.unionByName(seen.join(own, "qa_id", "left_anti"))


def flip_items(chains: DataFrame, entries: DataFrame, info: DataFrame) -> DataFrame:
    """One row for each listed flip, in the order of qa_id and chain.

    chains: chain, correct_run, wrong_run, from_run, to_run; entries: chain, direction, qa_id,
    ok_run, wrong_run, before_run, after_run, failure_age (nulls: the chain's own).  Entries of
    unknown chains are left out; a question that nothing knows is empty.
    """
    c = chains.select("chain", F.col("correct_run").alias("_ok"), F.col("wrong_run").alias("_bad"), F.col("from_run").alias("_from"), F.col("to_run").alias("_to"))
    both = entries.where(F.col("direction").isin("C2W", "W2C", "W2W")).join(c, "chain").join(info.select("qa_id", "question", "reference"), "qa_id", "left")
    stays = F.col("direction") == "W2W"
    return both.select(
        "qa_id", "chain", "direction", F.when(stays, F.coalesce("before_run", "_from")).alias("before_run"), F.when(stays, F.coalesce("after_run", "_to")).alias("after_run"), F.when(~stays, F.coalesce("ok_run", "_ok")).alias("ok_run"),
        F.when(~stays, F.coalesce("wrong_run", "_bad")).alias("bad_run"), F.when(stays, F.greatest(F.lit(1), F.coalesce("failure_age", F.lit(1)))).alias("failure_age"), F.coalesce("question", F.lit("")).alias("question"), F.coalesce("reference", F.lit("")).alias("reference"),
    )


def contrastive_cases(packages: DataFrame) -> DataFrame:
    """case_key, direction, sides, place: the packages of a case together, construction first; regressions first, then by key.

    packages: chain, qa_id, direction, side.  Raises ValueError where a case has two directions or
    a side twice.  place orders the cases of the (bounded) learning round.
    """
    key = F.concat_ws("__", F.coalesce("chain", F.lit("chain")), "qa_id")
    cases = packages.groupBy(key.alias("case_key")).agg(F.min("direction").alias("direction"), F.countDistinct("direction").alias("_d"), F.count("*").alias("_n"), F.countDistinct("side").alias("_s"), F.sort_array(F.collect_set("side"), asc=False).alias("sides"))
    bad = cases.where("_d <> 1 OR _n <> _s").take(1)
    if bad:
        raise ValueError(f"inconsistent case: {bad[0].case_key}")
    return cases.select("case_key", "direction", "sides", case_order(F.col("direction")).alias("direction_rank"))


def case_order(direction: Column) -> Column:
    return F.when(direction == "C2W", 0).when(direction == "W2W", 1).when(direction == "W2C", 2).otherwise(3)


def within_budget(actions: DataFrame, budgets: dict[str, int]) -> DataFrame:
    """The recorded actions of each run up to the budget of their kind; actions: run_id, step, action, more."""
    limit = F.create_map(*[x for k, n in budgets.items() for x in (F.lit(k), F.lit(n))])
    w = Window.partitionBy("run_id", "action").orderBy("step")
    return actions.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= F.coalesce(limit[F.col("action")], F.lit(0))).drop("_n")


def first_seen(actions: DataFrame) -> DataFrame:
    """run_id, version_id, first_step: every returned hit once, at its first step; actions: run_id, step, returned."""
    return actions.select("run_id", "step", F.explode("returned").alias("version_id")).groupBy("run_id", "version_id").agg(F.min("step").alias("first_step"))
