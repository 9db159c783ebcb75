"""Operators of the engine on small fixtures with exact values."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import porter, scalars
from palimpsest.functions import text as tx
from palimpsest.operators import candidates, evaluation, records, replies, retrieval, search, skills, store
from palimpsest.sources import artifacts, datasets, sinks
from palimpsest.streaming import ingest


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("word", "stem"),
    [("running", "run"), ("runs", "run"), ("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("conditional", "condit"), ("adoption", "adopt"), ("agencies", "agenc"),
     ("research", "research"), ("painting", "paint"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("generalization", "gener"), ("sky", "sky"), ("dies", "die")],
)
def test_stems(word, stem):
    assert porter.stem(word) == stem


# The examples of the published algorithm, word by word.
EXAMPLES = (
    "feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size tanned tan falling fall hissing hiss fizzed fizz failing fail rational ration "
    "digitizer digit operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous triplicate triplic formative form formalize formal electrical electr hopeful hope goodness good "
    "revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend communism commun "
    "activate activ homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controlling control roll roll vietnamization vietnam predication predic"
).split()


@pytest.mark.parametrize(("word", "stem"), [*zip(EXAMPLES[::2], EXAMPLES[1::2], strict=True)])
def test_published_stems(word, stem):
    assert porter.stem(word) == stem


def test_answer_scores(spark):
    assert one(spark, tx.normalize_answer(F.lit("The cats, and a dog!"))) == "cats dog"
    score = lambda p, r, c=None: one(spark, tx.answer_f1(F.col("p"), F.col("r"), None if c is None else F.lit(c)), p=p, r=r)
    assert score("running", "runs") == 1.0
    assert score("cat cat", "cat") == pytest.approx(2 / 3)
    assert score("Paris, cycling", "Paris, cycling", 1) == 1.0
    assert score("Seattle", "Seattle; because she moved", 3) == 1.0
    assert score("No information available.", "x", 5) == 1.0
    assert score("I cannot infer that.", "x", 5) == 0.0
    assert score("", "", 4) == 1.0
    assert score("Oslo", "", 4) == 0.0
    assert score("Rome", "Rome, Paris", 1) == 0.5


def test_tokens(spark):
    assert one(spark, tx.lexical_tokens(F.lit("The state-of-the-art won't stop: 中文 Data_1"))) == ["state-of-the-art", "won't", "stop", "中", "文", "data_1"]
    assert one(spark, tx.stemmed(tx.lexical_tokens(F.lit("adoption agencies v2")))) == ["adopt", "agenc", "v2"]


def test_scalars(spark):
    made = scalars.message_id(F.lit("conv-1"), F.lit(2), F.lit(7))
    assert one(spark, made) == "conv-1_s02_m007"
    assert tuple(one(spark, scalars.parsed_message_id(made))) == ("conv-1", 2, 7)
    assert tuple(one(spark, scalars.parsed_message_id(F.lit("other")))) == (None, None, None)
    assert one(spark, scalars.bounded(F.lit("7"), 0.5)) == 1.0
    assert one(spark, scalars.bounded(F.lit("x"), 0.5)) == 0.5
    assert json.loads(one(spark, scalars.json_object_text(F.lit('say ```json\n{"a": 1}\n``` ok')))) == {"a": 1}
    assert one(spark, scalars.json_object_text(F.lit('x {"a": {"b": 2}} y'))) == '{"a": {"b": 2}}'
    assert one(spark, scalars.json_object_text(F.lit("none"))) is None
    assert one(spark, scalars.json_array(F.lit("broken"))) == []
    assert one(spark, scalars.filled(F.lit("{a} and {b} {c}"), {"a": F.lit(1), "b": F.lit("x")})) == "1 and x {c}"
    assert one(spark, scalars.clean_list(F.array(F.lit(" a"), F.lit(""), F.lit("a"), F.lit("b")), 1)) == ["a"]
    assert str(one(spark, scalars.timestamp(F.lit("1:56 pm on 8 May, 2023")))) == "2023-05-08 13:56:00"
    assert one(spark, scalars.percent(F.lit(1), F.lit(8))) == "12.5%"
    assert [one(spark, scalars.id_kind(F.lit(x))) for x in ("source:a", "mem0:b", "c_v1")] == ["source", "external", "version"]
    assert one(spark, scalars.cosine(F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(6.0), F.lit(8.0)))) == pytest.approx(1.0)


def test_iteration_cases(spark):
    runs = lambda labels: spark.createDataFrame(labels, "qa_id string, label string")
    ages = spark.createDataFrame([("w2w", 2)], "qa_id string, age int")
    rows = evaluation.iteration_cases(runs([("c2w", "C"), ("w2c", "W"), ("w2w", "W"), ("c2c", "C")]), runs([("c2w", "W"), ("w2c", "C"), ("w2w", "W"), ("c2c", "C")]), ages).collect()
    assert {(r.qa_id, r.transition, r.failure_age) for r in rows} == {("c2w", "C2W", 1), ("w2c", "W2C", 0), ("w2w", "W2W", 3)}


def _state(spark):
    base = {"conversation_id": "c", "version_no": 1, "memory_kind": "fact", "system_from": 1, "importance": 0.5, "confidence": 0.5}
    rows = [
        {**base, "version_id": "mem_c_0001_v1", "memory_id": "mem_c_0001", "content": "lives in Boston", "content_hash": "b", "entities": ["Boston"], "keywords": ["home"]},
        {**base, "version_id": "mem_c_0002_v1", "memory_id": "mem_c_0002", "content": "has a cat", "content_hash": "k", "entities": ["cat"], "importance": 0.9},
    ]
    return spark.createDataFrame(rows, store.VERSIONS)


DECISION = (
    "seq int, candidate_id string, action string, target_memory_id string, supersedes_version_id string, memory_kind string, subject string, predicate string, object_text string, content string, "
    "world_start string, world_end string, entities array<string>, keywords array<string>, importance double, confidence double"
)


def _decisions(spark, *rows):
    return spark.createDataFrame([{"seq": k, "candidate_id": f"cand{k}", **r} for k, r in enumerate(rows)], DECISION)


def test_plan_supersedes_updates_merges_and_deletes(spark):
    plan = _decisions(
        spark,
        {"action": "ADD", "content": "lives in Seattle", "world_start": "2023-05", "supersedes_version_id": "mem_c_0001_v1", "memory_kind": "fact"},
        {"action": "MERGE", "target_memory_id": "mem_c_0002", "entities": ["Tom", "cat"], "importance": 0.1, "content": "has a cat Tom"},
        {"action": "SKIP", "content": "has a cat"},
    )
    out = store.apply_plan(_state(spark), plan, "c", commit=2)
    rows = {r.version_id: r for r in out["versions"].collect()}
    old = rows["mem_c_0001_v1"]
    assert (old.system_to, old.end_reason, old.world_end) == (2, "superseded", "2023-05")
    assert rows["mem_c_0003_v1"].parent_version_id == "mem_c_0001_v1"
    merged = rows["mem_c_0002_v2"]
    assert (merged.entities, merged.importance, merged.memory_kind) == (["cat", "Tom"], 0.9, "fact")
    assert rows["mem_c_0002_v1"].end_reason == "merged"
    event = next(r for r in out["events"].collect() if r.version_id == "mem_c_0002_v2")
    assert set(event.changed) == {"content"}
    now = {r.version_id for r in store.snapshot(out["versions"], "c").collect()}
    assert now == {"mem_c_0003_v1", "mem_c_0002_v2"}
    assert store.snapshot(out["versions"], "c", as_of=1).count() == 2
    assert store.snapshot(out["versions"], "c", include_history=True).count() == 4
    gone = store.apply_plan(out["versions"], _decisions(spark, {"action": "DELETE", "target_memory_id": "mem_c_0002", "world_end": "2024"}), "c", commit=3)["versions"]
    last = gone.where("version_id = 'mem_c_0002_v2'").first()
    assert (last.system_to, last.end_reason, last.world_end) == (3, "retracted", "2024")


@pytest.mark.parametrize(
    "bad",
    [{"action": "UPDATE", "target_memory_id": "mem_c_0099"}, {"action": "JUMP"}, {"action": "ADD", "content": "x", "supersedes_version_id": "nope"}],
)
def test_failed_plan_raises(spark, bad):
    with pytest.raises(store.PlanError):
        store.apply_plan(_state(spark), _decisions(spark, bad), "c", commit=2)
    with pytest.raises(store.PlanError):
        store.apply_plan(_state(spark), _decisions(spark, {"action": "SKIP"}), "c", commit=2, base_commit=1, current_commit=2)


def test_row_ids_go_on_from_the_store(spark):
    """Rows are numbered over all conversations, memories on from the conversation's own highest row."""
    other = spark.createDataFrame([{"version_id": "mem_d_0003_v1", "memory_id": "mem_d_0003", "conversation_id": "d", "version_no": 1, "content": "x", "content_hash": "x", "system_from": 1}], store.VERSIONS)
    held = _state(spark).unionByName(other).withColumn("row_id", F.when(F.col("memory_id") == "mem_d_0003", 7).otherwise(F.substring("memory_id", -1, 1).cast("int") + 3).cast("long"))
    plan = _decisions(spark, {"action": "UPDATE", "target_memory_id": "mem_c_0002", "content": "two cats"}, {"action": "ADD", "content": "a"}, {"action": "SKIP"}, {"action": "ADD", "content": "b"})
    out = store.apply_plan(held, plan, "c", commit=2)["versions"]
    assert out.columns == held.columns and out.count() == 6
    assert {(r.memory_id, r.version_no, r.row_id) for r in out.where("row_id > 7").collect()} == {("mem_c_0002", 2, 8), ("mem_c_0006", 1, 9), ("mem_c_0007", 1, 10)}
    empty = store.apply_plan(held.limit(0), _decisions(spark, {"action": "ADD", "content": "a"}), "c", commit=1)["versions"].collect()
    assert [(r.memory_id, r.row_id) for r in empty] == [("mem_c_0001", 1)]


def test_lineage_takes_the_shortest_way(spark):
    direct = spark.createDataFrame([("a", "m1"), ("c", "m1"), ("b", "m2")], "version_id string, message_id string")
    parents = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("d", "a")], "version_id string, parent_version_id string")
    got = {tuple(r) for r in store.lineage(direct, parents).collect()}
    assert got == {("a", "m1", 0), ("b", "m1", 1), ("b", "m2", 0), ("c", "m1", 0), ("c", "m2", 1), ("d", "m1", 1), ("d", "m2", 2)}


def test_bm25_by_hand(spark):
    import math

    docs = spark.createDataFrame([(0, 1, ["a", "b", "a"]), (0, 2, ["b"]), (1, 3, ["a"])], "scope int, doc_id int, t array<string>")
    asked = spark.createDataFrame([(0, 9, ["a", "a"])], "scope int, query_id int, q array<string>")
    rows = retrieval.bm25(docs, asked, F.col("t"), F.col("q")).collect()
    idf = math.log(1 + (2 - 1 + 0.5) / 1.5)
    assert [(r.doc_id, round(r.score, 9)) for r in rows] == [(1, round(idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / 2)) * (1 + math.log(2)), 9))]


def test_fusion_keeps_the_order_of_routes(spark):
    hits = lambda rows: spark.createDataFrame(rows, "scope int, query_id int, doc_id int, rank int")
    fused = {r.doc_id: r for r in retrieval.fused([("semantic:q0", hits([(0, 1, 7, 1)]), 0.4), ("bm25", hits([(0, 1, 7, 2), (0, 1, 8, 1)]), 0.3)]).collect()}
    assert fused[7].matched_paths == ["semantic", "bm25"]
    assert fused[7].score == pytest.approx(0.4 / 61 + 0.3 / 62)


SKILLS = "bank string, side string, skill_id string, version int, name string, description string, content array<string>"
EDITS = (
    "bank string, seq int, operation string, skill_id string, target_skill_id string, expected_version double, name string, description string, content array<string>, content_index double, "
    "expected_content string, new_content string"
)


def _edits(spark, *rows):
    names = [f.split()[0] for f in EDITS.split(", ")]
    return spark.createDataFrame([tuple({"seq": k, **r}.get(n) for n in names) for k, r in enumerate(rows)], EDITS)


def test_skill_edits_are_all_or_none(spark):
    when = "Use when dates are asked"
    held = spark.createDataFrame(
        [("b1", "access", "s", 1, "S", when, ["x", "y"]), ("b1", "access", "t", 4, "T", when, ["k"]), ("b1", "access", "u", 1, "U", when, ["a", "a"]), ("b2", "access", "s", 3, "S", when, ["x"]), ("b3", "access", "s", 2, "S", when, ["x"]), ("b4", "access", "s", 2, "S", when, ["x"])],
        SKILLS,
    )
    ops = _edits(
        spark,
        {"bank": "b1", "operation": "update_content", "skill_id": "s", "expected_version": 1.0, "expected_content": "y", "content_index": 9.0, "new_content": " z "},
        {"bank": "b1", "operation": "add_content", "skill_id": "s", "content": ["x", "w "]}, {"bank": "b1", "operation": "move_content", "skill_id": "s", "target_skill_id": "t", "expected_content": "x"},
        {"bank": "b1", "operation": "rename_skill", "skill_id": "t", "name": " T two "}, {"bank": "b1", "operation": "update_description", "skill_id": "t", "description": "Apply before answering"},
        {"bank": "b1", "operation": "add_skill", "skill_id": "s", "name": "N", "description": "Use if asked", "content": ["new "]}, {"bank": "b1", "operation": "delete_content", "skill_id": "u", "content_index": 1.0},
        {"bank": "b1", "operation": "delete_skill", "skill_id": "u"},
        {"bank": "b2", "operation": "add_content", "skill_id": "s", "expected_version": 3.0, "new_content": "w"}, {"bank": "b2", "operation": "delete_skill", "skill_id": "s", "expected_version": 9.0},
        {"bank": "b3", "operation": "update_description", "skill_id": "s", "description": "no trigger here"},
        {"bank": "b4", "operation": "delete_content", "skill_id": "s", "expected_content": "gone", "content_index": 0.0},
    )
    rows = {(r.bank, r.skill_id): r for r in skills.apply_operations(held, ops).collect()}
    assert (rows["b1", "s"].version, rows["b1", "s"].status, rows["b1", "s"].content) == (2, "staged", ["z", "w"])
    assert (rows["b1", "t"].version, rows["b1", "t"].name, rows["b1", "t"].description, rows["b1", "t"].content) == (5, "T two", "Apply before answering", ["k", "x"])
    assert (rows["b1", "s_5"].version, rows["b1", "s_5"].content, rows["b1", "s_5"].side) == (1, ["new"], "access")
    assert rows["b1", "u"].status == "deleted" and all(r.error is None for (b, _), r in rows.items() if b == "b1")
    for bank, version, why in (("b2", 3, "at version 3"), ("b3", 2, "no trigger wording"), ("b4", 2, "gone")):
        r = rows[bank, "s"]
        assert (r.version, r.status, r.content, r.description) == (version, "active", ["x"], when) and why in r.error


def test_payload_rules(spark):
    def broken(name="N", description="Use when asked", content=("do it",), **asked):
        row = {"n": name, "d": description, "c": list(content), "s": asked.get("side"), "r": asked.get("reference"), "e": asked.get("entities"), "g": asked.get("gold")}
        df = spark.createDataFrame([tuple(row.values())], "n string, d string, c array<string>, s string, r string, e array<string>, g array<string>")
        return df.select(skills.violations(*map(F.col, "ndcsreg")).alias("x")).first().x

    assert broken() == []
    assert broken(" ", "", []) == ["name is empty", "description is empty", "content is empty", "no trigger wording"]
    assert broken("n" * 61, "when " + "d" * 200, ["x" * 201] * 4) == ["name too long", "description too long", "content too long", "too many items", "item too long"]
    assert broken(content=["see mem_c_0001_v2"]) == ["system ids"]
    assert broken(content=["answer only with Paris (a+b"], reference="paris (a+b") == ["reference answer"]
    assert broken(content=["answer first. Then visit paris"], reference="Paris") == []
    assert broken(name="Paris!", reference="paris") == ["reference answer"]
    assert broken(content=["ask Melanie"], entities=["Mel", "melanie"]) == ["question entity"]
    assert broken(content=["The user said so", "m17"], gold=["m17"]) == ["gold message id", "case narrative: the user said"]
    assert broken(content=["write memory_kind = fact"], side="Construction") == ["unsupported memory kind"]
    assert broken(content=["write memory_kind = fact"], side="access") == []


def test_clusters_are_bounded_and_stay_in_their_bucket(spark):
    rng = np.random.default_rng(1)
    points = [(b, 100 * k + j, rng.normal(size=8).tolist()) for k, b in enumerate("pq") for j in range(60)] + [("r", 900 + j, [1.0] * 8) for j in range(40)]
    rows = skills.cluster(spark.createDataFrame(points, "bucket string, point_id long, v array<double>"), target=8, most=10).collect()
    assert len(rows) == len(points)
    sizes = {}
    for r in rows:
        sizes.setdefault((r.bucket, r.cluster), []).append(r.point_id)
    assert max(map(len, sizes.values())) <= 10
    v = rng.normal(size=(50, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    assert set(skills.spherical_kmeans(v, 5)) <= set(range(5))


def test_segments_match_a_loop(spark):
    said = [(c, t, "user", "x" * n) for c, turns in {1: [10, 700, 700, 5, 5, 5, 5, 5], 2: [2000, 3], 3: [0, 4]}.items() for t, n in enumerate(turns)]
    got = {}
    for r in skills.segments(spark.createDataFrame(said, "conversation_id long, turn int, speaker string, content string")).collect():
        got.setdefault(r.conversation_id, {})[r.segment] = r.text.count("\n") + 1
    # 10 and 700 fit; 700 more would pass 1400 with its line ends
    assert {c: [s[k] for k in sorted(s)] for c, s in got.items()} == {1: [2, 4, 2], 2: [1, 1], 3: [1]}


def test_candidates_and_decisions(spark):
    schema = (
        "conversation_id string, session_id string, position int, memory_kind string, subject string, predicate string, object_text string, content string, world_start string, world_end string, "
        "source_message_ids array<string>, entities array<string>, keywords array<string>, importance string, confidence string"
    )
    base = {"conversation_id": "c", "session_id": "s", "source_message_ids": ["m2", "m1", "m2"], "importance": "2", "confidence": "bad"}
    replies = [
        {**base, "position": 0, "content": " lives in Rome ", "memory_kind": "FACT"}, {**base, "position": 1, "content": "lives in Rome"}, {**base, "position": 2, "content": "no source", "source_message_ids": ["zz"]},
        {**base, "position": 3, "content": ""}, {**base, "position": 4, "content": "likes tea", "memory_kind": "odd"},
    ]
    allowed = spark.createDataFrame([("s", "m1"), ("s", "m2")], "session_id string, message_id string")
    got = sorted(candidates.admitted(spark.createDataFrame(replies, schema), allowed).collect(), key=lambda r: r.position)
    assert [(r.candidate_id, r.memory_kind, r.source_message_ids, r.importance, r.confidence, r.subject) for r in got] == [
        ("cand_c_s_000", "fact", ["m2", "m1"], 1.0, 0.8, "conversation participants"), ("cand_c_s_001", "event", ["m2", "m1"], 1.0, 0.8, "conversation participants"),
    ]
    decisions = spark.createDataFrame(
        [(0, "a", "SKIP", [("duplicate_of", "v1")]), (0, "b", "SKIP", [("duplicate_of", "hidden")]), (0, "c", "ADD", [])], "seq int, candidate_id string, action string, relations array<struct<relation_type:string,target_version_id:string>>"
    )
    known = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "candidate_id string")
    rows = {r.candidate_id: r.action for r in candidates.decided(decisions, known, spark.createDataFrame([("v1",)], "version_id string")).collect()}
    assert rows == {"a": "SKIP", "b": "ADD", "c": "ADD", "d": "ADD"}


def test_datasets(spark, tmp_path):
    samples = [
        {"sample_id": s, "conversation": {"speaker_a": "A", "session_10": [{"speaker": "B", "text": "y", "dia_id": "D10:1"}], "session_2": [{"speaker": "A", "text": "x", "dia_id": "D1:1"}], "session_2_date_time": "1:56 pm on 8 May, 2023"},
         "qa": [{"question": "q", "answer": "x", "category": 2, "evidence": ["D1:1", ""]}, {"question": "r", "answer": 5, "category": "odd"}]}
        for s in ("conv-1", "conv-2")
    ]
    path = tmp_path / "samples.json"
    path.write_text(json.dumps(samples))
    messages, questions = datasets.read_dataset(spark, str(path))
    rows = sorted(messages.collect(), key=lambda r: (r.conversation_id, r.session_index))
    assert [(r.message_id, r.role, r.session_id, r.occurred_at) for r in rows[:2]] == [("conv-1:D1:1", "user", "conv-1_s02", "1:56 pm on 8 May, 2023"), ("conv-1:D10:1", "assistant", "conv-1_s10", None)]
    asked = {r.qa_id: r for r in questions.collect()}
    assert [tuple(e) for e in asked["conv-2_qa_0000"].evidence] == [("", "conv-2:D1:1")]
    assert (asked["conv-1_qa_0000"].category, asked["conv-1_qa_0001"].category) == (2, None)

    path = tmp_path / "haystack.json"
    path.write_text(json.dumps([{"question_id": "q1", "question": "?", "answer": "a", "haystack_session_ids": ["s1", "s2"], "haystack_dates": ["2023"], "answer_session_ids": ["s2"]}, {"question_id": "q2"}]))
    sessions, questions = datasets.read_dataset(spark, str(path))
    assert {(r.conversation_id, r.session_id, r.session_time) for r in sessions.collect()} == {("q1", "s1", "2023"), ("q1", "s2", None), ("q2", "session_q2", None)}
    assert [tuple(e) for e in questions.where("qa_id = 'q1'").first().evidence] == [("s2", "")]

    folder = tmp_path / "files"
    folder.mkdir()
    session = {"session_id": "s", "time": "2023-05-10", "messages": [{"message_id": "m1", "role": "user", "content": "hi"}, {"message_id": "m2", "role": "assistant", "content": "yo", "time": "2023-06"}]}
    (folder / "qa_1.json").write_text(json.dumps({"id": 1, "sessions": [session], "qas": [{"qa_id": "a", "question": "?", "answer": "x", "type": "temporal"}]}))
    (folder / "qa_two.json").write_text(json.dumps({"sessions": session, "qas": {"qa_id": "b", "question": "?", "answer": "x", "type": "single"}}))
    messages, questions = datasets.read_dataset(spark, str(folder))
    assert {(r.conversation_id, r.message_id, r.occurred_at) for r in messages.collect()} == {(c, m, t) for c in ("1", "qa_two") for m, t in (("m1", "2023-05-10"), ("m2", "2023-06"))}
    assert {(r.conversation_id, r.qa_id) for r in questions.collect()} == {("1", "a"), ("qa_two", "b")}


def test_json_lines_and_versions(spark, tmp_path):
    path = tmp_path / "rows.jsonl"
    path.write_text('{"a": 1}\nbroken\n{"a": 2}\n')
    assert sorted(r.a for r in datasets.read_json_lines(spark, str(path), "a int", strict=False).collect()) == [1, 2]
    assert [r.line for r in datasets.malformed_lines(spark, str(path), "a int").collect()] == ["broken"]
    with pytest.raises(Exception, match="(?i)malformed"):
        datasets.read_json_lines(spark, str(path), "a int").collect()
    at = str(tmp_path / "state")
    assert sinks.current_version(spark, at) is None
    for v in (1, 2):
        sinks.publish_version(spark.range(v), at, v)
    assert sinks.read_current(spark, at).count() == 2
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.create(spark.range(1), f"{at}/version=1")
    sinks.complete(spark.range(3), spark.range(3), "id")
    with pytest.raises(ValueError, match="missing"):
        sinks.complete(spark.range(2), spark.range(3), "id")


def test_stream_ingest_takes_each_commit_once(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    batch = spark.createDataFrame([("c", 1, "a"), ("c", 2, "b"), ("d", 1, "x")], "conversation string, commit_id int, content string")
    batch.write.parquet(source)
    spark.createDataFrame([], batch.schema).write.parquet(target)

    def apply(df, _):
        ingest.pending(df, spark.read.parquet(target), ["conversation", "commit_id"]).write.mode("append").parquet(target)

    for run in range(2):
        ingest.ingest(spark.readStream.schema(batch.schema).parquet(source), apply, str(tmp_path / f"cp{run}")).awaitTermination()
    rows = ingest.closed_intervals(spark.read.parquet(target), ["conversation"]).collect()
    assert {(r.conversation, r.version_no, r.system_from, r.system_to) for r in rows} == {("c", 1, 1, 2), ("c", 2, 2, None), ("d", 1, 1, None)}


def test_update_keeps_what_it_does_not_name(spark):
    plan = _decisions(spark, {"action": "UPDATE", "target_memory_id": "mem_c_0002", "content": "has two cats", "confidence": 0.5}, {"action": "SKIP", "candidate_id": "s"})
    state = _state(spark)
    before = {r.version_id: r for r in state.collect()}["mem_c_0002_v1"]
    out = store.apply_plan(state, plan, "c", commit=2)["versions"]
    rows = {r.version_id: r for r in out.collect()}
    new, old = rows["mem_c_0002_v2"], rows["mem_c_0002_v1"]
    assert (old.system_to, old.end_reason) == (2, "superseded")
    assert (new.content, new.confidence, new.version_no, new.parent_version_id, new.update_type, new.system_to) == ("has two cats", 0.5, 2, "mem_c_0002_v1", "update", None)
    assert (new.subject, new.memory_kind, new.entities, new.world_start) == (before.subject, before.memory_kind, before.entities, before.world_start)
    assert len(rows) == len(before_ids := {r.version_id for r in state.collect()}) + 1 and before_ids < set(rows)


def test_a_commit_records_everything_or_nothing(spark):
    plan = _decisions(spark, {"action": "UPDATE", "candidate_id": "a", "target_memory_id": "mem_c_0002", "content": "x"}, {"action": "SKIP", "candidate_id": "b"}).withColumn(
        "relations", F.when(F.col("candidate_id") == "b", F.expr("array(named_struct('relation_type', 'DUPLICATE_OF', 'target_version_id', 'mem_c_0002_v1'), named_struct('relation_type', 'unrelated', 'target_version_id', 'v'))"))
    )
    facts = spark.createDataFrame([("a", ["m1", "m1", "m2"]), ("b", ["m3"])], "candidate_id string, source_message_ids array<string>")
    inputs = spark.createDataFrame([("m1",), ("m2",), ("m3",), ("m3",)], "message_id string")
    out = records.commit_plan(_state(spark), plan, facts, inputs, "c", 2)
    rows = lambda k, *cs: sorted(tuple(r[c] for c in cs) for r in out[k].collect())
    assert rows("decisions", "decision_id", "candidate_id", "action") == [("decision_2_000", "a", "UPDATE"), ("decision_2_001", "b", "SKIP")]
    assert rows("relations", "candidate_id", "version_id", "relation") == [("b", "mem_c_0002_v1", "duplicate_of")]
    assert rows("version_edges", "version_id", "message_id") == [("mem_c_0002_v2", "m1"), ("mem_c_0002_v2", "m2")]
    assert rows("candidate_edges", "candidate_id", "message_id") == [("a", "m1"), ("a", "m2"), ("b", "m3")]
    assert rows("inputs", "message_id") == [("m1",), ("m2",), ("m3",)] and rows("commit", "commit_id", "status") == [(2, "committed")]
    with pytest.raises(store.PlanError):
        records.commit_plan(_state(spark), plan, facts, inputs, "c", 2, base_commit=0, current_commit=1)


def test_joins_that_raise(spark):
    p = spark.createDataFrame([("q1", "c", None), ("q2", "c", None)], "qa_id string, conversation_id string, error string")
    j = lambda *rows: spark.createDataFrame(rows, "qa_id string, label string, reason string")
    q = spark.createDataFrame([("q1", "?")], "qa_id string, question string")
    assert records.judged(p, j(("q1", "C", ""), ("q2", "P", ""))).count() == 2
    for bad in (j(("q1", "C", "")), j(("q1", "C", ""), ("q2", "P", ""), ("q2", "P", "")), j(("q1", "C", ""), ("q2", "P", ""), ("q3", "I", ""))):
        with pytest.raises(ValueError, match="not judged once"):
            records.judged(p, bad)
    assert [r.qa_id for r in records.work_items(p, j(("q1", "I", ""), ("q2", "C", "")), q).collect()] == ["q1"]
    with pytest.raises(ValueError, match="no such question"):
        records.work_items(p, j(("q2", "I", "")), q)
    with pytest.raises(ValueError, match="repeated item"):
        records.work_items(p.unionByName(p), j(("q1", "I", "")), q)
    packages = lambda *rows: spark.createDataFrame(rows, "chain string, qa_id string, direction string, side string")
    for bad in (packages(("x", "q", "C2W", "access"), ("x", "q", "W2C", "construction")), packages(("x", "q", "C2W", "access"), ("x", "q", "C2W", "access"))):
        with pytest.raises(ValueError, match="inconsistent case"):
            records.contrastive_cases(bad)
    items = spark.createDataFrame([("c", "q1"), ("c", "q2")], "conversation_id string, qa_id string")
    done = spark.createDataFrame([("c", "q1", "COMPLETED"), ("c", "q2", "running")], "conversation_id string, qa_id string, status string")
    with pytest.raises(ValueError, match="1 items not attempted"):
        replies.gate_phase(items, done, ["conversation_id", "qa_id"])
    replies.gate_phase(items.limit(1), done, ["conversation_id", "qa_id"])
    with pytest.raises(ValueError, match="unknown id"):
        replies.required_ids(items, items.limit(0), "qa_id")
    with pytest.raises(ValueError, match="unknown commit"):
        replies.construction_history(spark.createDataFrame([("q", True)], "qa_id string, problem boolean"), spark.createDataFrame([("q", 1)], "qa_id string, commit_id int"), spark.createDataFrame([("q", 2)], "qa_id string, commit_id int"))


def test_helpers_of_replies(spark):
    assert one(spark, scalars.bare_id(F.lit("source:m1"))) == "m1" and one(spark, scalars.bare_id(F.lit("v1"))) == "v1"
    assert one(spark, scalars.conversation_of(F.lit("conv-1_qa_0003"))) == "conv-1"
    assert one(spark, scalars.without_version(F.lit("sk_a_v12"))) == "sk_a"
    assert one(spark, scalars.clipped(F.lit("  a \n b " + "x" * 400))) == "a b " + "x" * 316
    assert one(spark, scalars.parsed_label(F.lit(" c "), ("C", "P"))) == "C"
    with pytest.raises(Exception, match="unknown label"):
        one(spark, scalars.parsed_label(F.lit("Z"), ("C", "P")))
    assert one(spark, scalars.normalized(F.expr("array(3.0D, 4.0D)"))) == [0.6, 0.8]
    told = lambda r, a: one(spark, scalars.reference_answer(F.lit(r).cast("string"), F.lit(a).cast("string")))
    assert (told("r", "a"), told(" ", "a"), told("", None)) == ("r", "a", "")
    with pytest.raises(Exception, match="neither reference nor answer"):
        told(None, None)
    answer, evidence = candidates.answered(F.lit("  "), F.expr("array('a', 'b')"), F.expr("array('b', 'c')"))
    assert (one(spark, answer), one(spark, evidence)) == ("No information available.", ["b"])
    claims = lambda *c: F.array(*[F.struct(F.lit(x).alias("coverage"), F.expr(f"array_repeat('v', {n})").alias("support"), F.lit(z).alias("contradicted")) for x, n, z in c])
    assert one(spark, candidates.sufficient(claims(("FULL", 1, False)))) and not one(spark, candidates.sufficient(claims(("FULL", 1, False), ("PARTIAL", 1, False)))) and not one(spark, candidates.sufficient(claims(("FULL", 0, False))))
    replies_of = spark.createDataFrame([("s1",), ("s2",)], "session_id string")
    assert [r.session_id for r in candidates.rejected_sessions(replies_of, replies_of.limit(1)).collect()] == [r.session_id for r in replies_of.collect()[1:]]
    assert one(spark, replies.keys_anywhere(F.lit('{"skill_id": "a", "x": [{"skill_id":"b \\" c"}, {"skill_id": 3}], "skill_id2": "no"}'))) == ["3", 'b " c', "a"] or one(spark, replies.keys_anywhere(F.lit('{"skill_id": "a", "x": [{"skill_id":"b"}, {"skill_id": 3}], "skill_id2": "no"}'))) == ["3", "a", "b"]


def test_hybrid_with_stems_matches_loops(spark):
    """BM25 with field boosts and stems, alone (no vectors, no keywords), against plain loops."""
    import math
    from collections import Counter

    memories = [(0, k, k // 2, t, s, p, o, kw, en, None, None, k % 2 == 1) for k, (t, s, p, o, kw, en) in enumerate([
        ("Adopted a puppy named Rex", "Ann", "adopted", "puppy", ["dogs"], ["Ann", "Rex"]), ("Running in the parks", "Bob", "runs", "park", [], []), ("The agency was adopting dogs", "Ann", "works", "agency", ["adoption"], []), ("Nothing of note", "Cy", None, None, None, None),
    ])]
    schema = "scope int, doc_id int, memory_id int, content string, subject string, predicate string, object_text string, keywords array<string>, entities array<string>, world_start string, world_end string, current boolean"
    asked = [(0, 1, "Who adopts dogs and runs?", None, None, None, "none", None, None, "1"), (0, 2, "agencies", None, None, None, "none", None, None, "1"), (0, 3, "", None, None, None, "none", None, None, "1")]
    queries = spark.createDataFrame(asked, "scope int, query_id int, query string, expansions array<string>, keywords array<string>, entities array<string>, time_mode string, target string, target_end string, depth string")
    vectors = spark.createDataFrame([], "scope int, doc_id int, v array<double>")
    found = search.routes(spark.createDataFrame(memories, schema), None, queries, vectors, spark.createDataFrame([], "scope int, query_id int, part int, v array<double>"), search.stemmed_lexical, only=("bm25",))["bm25"]

    def tokens(text):
        import re

        return [porter.stem(t) if t.isalpha() else t for t in re.findall(r"[a-z0-9]+(?:['_-][a-z0-9]+)*", (text or "").lower()) if t not in tx.STOP_WORDS]

    docs = [[*tokens(m[3]), *tokens(m[5]) * 2, *tokens(m[6]) * 2, *tokens(" ".join(m[7] or [])) * 2, *tokens(m[4]), *tokens(" ".join(m[8] or []))] for m in memories]
    df = Counter(t for d in docs for t in set(d))
    average = sum(map(len, docs)) / len(docs)
    want = {}
    for _, q, text, *_ in asked:
        for k, d in enumerate(docs):
            s = sum(math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / average)) * (1 + math.log(n)) for t, n in Counter(tokens(text)).items() if t in d)
            if s:
                want[q, k] = round(s, 9)
    assert {(r.query_id, r.doc_id): round(r.score, 9) for r in found.collect()} == want and len(want) == 4


def test_semantic_search_by_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    d, q = rng.normal(size=(200, 6)), rng.normal(size=(9, 6))
    monkeypatch.setattr(search, "VECTOR_VALUES", 18)  # three queries a block
    docs = spark.createDataFrame([(k % 2, k, v.tolist()) for k, v in enumerate(d)] + [(0, 999, None)], "scope int, doc_id int, v array<double>").repartition(3)
    asked = spark.createDataFrame([(k % 2, k, 0, v.tolist()) for k, v in enumerate(q)], "scope int, query_id int, part int, v array<double>")
    got = {(r.query_id, r.rank): r.doc_id for r in search.semantic(docs, asked, 5).collect()}
    for k in range(9):
        own = [j for j in range(200) if j % 2 == k % 2]
        best = sorted(own, key=lambda j: (-round(float(d[j] @ q[k]), 9), j))[:5]
        assert [got[k, r + 1] for r in range(5)] == best
    assert search.semantic(docs, asked.limit(0), 5).count() == 0


def test_phrases_and_keywords(spark):
    docs = spark.createDataFrame([(0, 1, "The big cat sat."), (0, 2, "a bigcatalogue"), (0, 3, "cat big"), (0, 4, None)], "scope int, doc_id int, text string").withColumn("tokens", F.array_distinct(tx.simple_tokens(F.col("text"))))
    asked = spark.createDataFrame([(0, 1, ["Big Cat"], ["big", "cat"]), (0, 2, ["gca"], [])], "scope int, query_id int, phrases array<string>, tokens array<string>")
    got = {(r.query_id, r.doc_id): r.score for r in search.keyword_scores(docs, asked).collect()}
    assert got == {(1, 1): 2.5 + 1.0, (1, 3): 1.0, (2, 2): 2.25}
    found = search.phrase_search(docs.select("scope", "doc_id", "text"), spark.createDataFrame([(0, 7, "big CAT"), (0, 8, "sat big")], "scope int, query_id int, text string"), tx.simple_tokens, 3)
    assert [(r.query_id, r.doc_id, r.n) for r in found.collect()] == [(7, 1, 1)]


def test_routes_keep_the_best_of_each_task(spark, monkeypatch):
    monkeypatch.setattr(search, "PRODUCT_VALUES", 60)
    monkeypatch.setattr(search, "VECTOR_VALUES", 40)  # several blocks of queries
    rnd = random.Random(8)
    words = ["ann", "bob", "sea", "sun", "map", "Rio", "oak"]
    docs = [(k % 2, k, " ".join(rnd.choices(words, k=5)), rnd.choice(["Ann said", None]), rnd.choice([["Rio"], ["ANN", "oak"], None]), rnd.choice(["2024-01-02", "2024-03-01", None]), None, k % 3 == 0) for k in range(80)]
    held = spark.createDataFrame(docs, "scope int, doc_id int, content string, subject string, entities array<string>, world_start string, world_end string, current boolean").repartition(2)
    held = held.withColumn("text", F.col("content")).withColumn("tokens", F.array_distinct(tx.simple_tokens(F.col("text"))))
    queries = [(k % 2, k, rnd.sample(words, 2), rnd.choice(["none", "current", "point", "before"]), rnd.choice(["2024-02-01", None]), None) for k in range(12)]
    asked = spark.createDataFrame(queries, "scope int, query_id int, entities array<string>, time_mode string, target string, target_end string")
    asked = asked.withColumn("phrases", F.array(F.array_join("entities", " "))).withColumn("tokens", F.array_distinct(tx.simple_tokens(F.array_join("entities", " "))))
    top = lambda df: sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in retrieval.ranked(df, 3, ["scope", "query_id"]).collect())
    best = search.keyword_best(held, asked, 3)
    assert top(best) == top(search.keyword_scores(held, asked)) and best.count() <= 3 * 12 * held.rdd.getNumPartitions()
    q = asked.select("scope", "query_id", F.col("entities").alias("wanted"), F.col("tokens").alias("asked"), "time_mode", "target", "target_end")
    low = F.transform(F.coalesce("entities", F.array().cast("array<string>")), F.lower)
    time = F.coalesce(retrieval.time_score(*[F.col(c) for c in ("time_mode", "target", "target_end", "world_start", "world_end", "current")]), F.lit(0.0))
    plain = retrieval.entity_score(F.col("wanted"), low, F.coalesce("subject", F.lit("")), F.col("content")) + retrieval.overlap_share(F.col("asked"), F.col("tokens")) + time
    pairs = held.join(q, "scope").select("scope", "query_id", "doc_id", plain.alias("score")).where("score > 0")
    assert top(search.structured_best(held, asked, asked.select("scope", "query_id", "tokens"), 3)) == top(pairs)
    assert search.keyword_best(held.limit(0), asked, 3).count() == 0 and search.keyword_best(held, asked.limit(0), 3).count() == 0


def test_artifacts(spark, tmp_path):
    rows = {"a/conv-1": 2, "a/conv-2": 1}
    for folder, n in rows.items():
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "p.jsonl").write_text('{"qa_id": "q"}\n' * n)
    got = artifacts.run_rows(spark, str(tmp_path), "a", "p.jsonl", "qa_id string")
    assert sorted((r.folder, r.qa_id) for r in got.collect()) == [("conv-1", "q"), ("conv-1", "q"), ("conv-2", "q")]
    (tmp_path / "b_conv-9").mkdir()
    (tmp_path / "b_conv-9" / "p.jsonl").write_text('{"qa_id": "z"}\n')
    assert [r.folder for r in artifacts.run_rows(spark, str(tmp_path), "b", "p.jsonl", "qa_id string").collect()] == ["b_conv-9"]
    with pytest.raises(FileNotFoundError):
        artifacts.run_rows(spark, str(tmp_path), "none", "p.jsonl", "qa_id string")
    bank = tmp_path / "bank"
    bank.mkdir()
    schema = "side string, skill_id string, bank_version int"
    (bank / "access_v1.json").write_text('{"side": "access", "skill_id": "a", "bank_version": 1}\n')
    with pytest.raises(ValueError, match="0 files of the construction"):
        artifacts.bank(spark, str(bank), schema)
    (bank / "construction_v1.json").write_text('{"side": "construction", "skill_id": "b", "bank_version": 1}\n')
    assert artifacts.bank(spark, str(bank), schema).count() == 2
    (bank / "construction_v1.json").write_text('{"side": "access", "skill_id": "b", "bank_version": 1}\n')
    with pytest.raises(ValueError, match="other side"):
        artifacts.bank(spark, str(bank), schema)
    assert artifacts.substituted({"a": ["${X}/y", 3]}, {"X": "1"}) == {"a": ["1/y", 3]}
    with pytest.raises(KeyError):
        artifacts.substituted("${NOPE}", {})
    v = spark.createDataFrame([([1.5, -2.25, 0.0],), ([],)], "v array<float>")
    assert [r.x for r in v.select(artifacts.decoded(artifacts.encoded("v")).alias("x")).collect()] == [[1.5, -2.25, 0.0], []]
    cache = spark.createDataFrame([("v1", "f", "m", 2, [1.0, 2.0]), ("v2", "old", "m", 2, [1.0, 2.0]), ("v3", "f", "m", 2, [1.0])], "version_id string, fingerprint string, model string, dim int, v array<double>")
    have, todo = artifacts.fresh_vectors(cache, spark.createDataFrame([("v1", "f"), ("v2", "f"), ("v3", "f")], "version_id string, fingerprint string"), "m", 2)
    assert ([r.version_id for r in have.collect()], sorted(r.version_id for r in todo.collect())) == (["v1"], ["v2", "v3"])
    artifacts.compatible(cache, "m", 2)
    with pytest.raises(ValueError, match="stored vectors"):
        artifacts.compatible(cache, "other", 2)
    skills_of = spark.createDataFrame([("access", "a", 1), ("construction", "b", 1)], schema)
    for _ in range(2):  # the second time does nothing
        artifacts.publish_bank(skills_of, str(tmp_path / "published"), 1, "t1")
    assert sinks.current_version(spark, str(tmp_path / "published")) == 1
    assert artifacts.clone(spark, str(tmp_path / "published"), str(tmp_path / "next")) == 1
    with pytest.raises(FileExistsError):
        artifacts.clone(spark, str(tmp_path / "published"), str(tmp_path / "next"))
    new = skills_of.withColumn("bank_version", F.lit(2))
    assert {k: sorted(r.bank_version for r in df.collect()) for k, df in artifacts.variants(skills_of, new).items()} == {"full": [2, 2], "access-only": [1, 2], "construction-only": [1, 2]}
    artifacts.export(skills_of, str(tmp_path / "export"))
    assert spark.read.json(str(tmp_path / "export")).count() == 2
    reports = spark.createDataFrame([("d1", "done", True, None, "p"), ("d2", "done", False, None, "p"), ("d3", "failed", None, "e", None)], "diagnosis_id string, status string, problem_found boolean, error string, package string")
    artifacts.publish_reports(reports, str(tmp_path / "reports"))
    assert [spark.read.json(str(tmp_path / "reports" / k)).count() for k in ("progress", "errors", "packages")] == [3, 1, 1]
    partial = str(tmp_path / "partial")
    for q in ("q2", "q1", "q2"):
        sinks.append(spark.createDataFrame([(q,)], "qa_id string"), partial)
    with pytest.raises(ValueError, match="missing"):
        artifacts.publish_checkpoint(spark, partial, spark.createDataFrame([("q1",), ("q2",), ("q3",)], "qa_id string"), str(tmp_path / "final"))
    artifacts.publish_checkpoint(spark, partial, spark.createDataFrame([("q1",), ("q2",)], "qa_id string"), str(tmp_path / "final"))
    assert [r.qa_id for r in spark.read.parquet(str(tmp_path / "final")).collect()] == ["q1", "q2"] and not (tmp_path / "partial").exists()
    hashes = artifacts.file_hashes(spark, str(bank))
    assert hashes.count() == 2 and artifacts.directory_hash(hashes) == artifacts.directory_hash(hashes.orderBy(F.desc("path")))
    assert artifacts.manifest(spark, "r", {"a": "h"}, "created").first().inputs == {"a": "h"}
    log = spark.createDataFrame([("c", 1, "x"), ("c", 2, "y"), ("d", 1, "z")], "candidate_id string, seq int, text string")
    assert sorted((r.candidate_id, r.text, r.revisions) for r in artifacts.revised(log).collect()) == [("c", "y", 2), ("d", "z", 1)]
    banks = spark.createDataFrame([(1, "s", 1), (2, "s", 1), (3, "s", 2)], "bank_version int, skill_id string, version int")
    assert [tuple(r) for r in artifacts.holding(banks, spark.createDataFrame([("s", 1)], "skill_id string, version int")).collect()] == [("s", 1, 2)]
    memories = spark.createDataFrame([("ns:c", 1, "s1"), ("c", 2, "s1"), ("ns:d", 3, "s1")], "scope_id string, id int, session_id string")
    assert [r.id for r in artifacts.scoped(memories, "ns", F.lit("c")).collect()] == [1] and [r.id for r in artifacts.scoped(memories, "", F.lit("c")).collect()] == [2]
    sessions = spark.createDataFrame([("c", "s1"), ("c", "s2"), ("e", "s1")], "conversation_id string, session_id string")
    assert [tuple(r) for r in artifacts.sessions_held(sessions, memories, "ns").collect()] == [("c", "s1")]


def test_retries_and_sessions_of_activity(spark):
    work = spark.createDataFrame([("a",), ("b",), ("c",)], "qa_id string")
    attempts = spark.createDataFrame([("a", 1, "error"), ("a", 2, "done"), ("b", 1, "done"), ("b", 2, "error")], "qa_id string, at int, status string")
    assert sorted(r.qa_id for r in ingest.retryable(work, attempts, ["qa_id"], "at", ("done",)).collect()) == ["b", "c"]
    events = spark.createDataFrame([(1, "2024-01-01 00:00:00", 1.0), (1, "2024-01-01 00:20:00", 2.0), (1, "2024-01-01 02:00:00", 4.0)], "user_id int, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r.n, r.value) for r in ingest.session_activity(events).collect()) == [(1, 4.0), (2, 3.0)]


def test_large_buckets_are_parted_before_they_are_clustered(spark, monkeypatch):
    monkeypatch.setattr(skills, "GROUP_POINTS", 60)
    rng = np.random.default_rng(1)
    points = [("p", j, rng.normal(size=4).tolist()) for j in range(200)] + [("q", 500 + j, [1.0, 0.0, 0.0, 0.0]) for j in range(150)]
    rows = skills.cluster(spark.createDataFrame(points, "bucket string, point_id long, v array<double>"), target=8, most=10).collect()
    assert sorted(r.point_id for r in rows) == sorted(p[1] for p in points)
    sizes = {}
    for r in rows:
        sizes.setdefault((r.bucket, r.cluster), []).append(r.point_id)
    assert max(map(len, sizes.values())) <= 10
