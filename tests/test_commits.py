"""Commits over several tables: whole or not at all, whatever step fails; the store and the text index on top."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import store, textindex
from palimpsest.sources import commits, sinks


def _two(spark, n):
    return {"a": spark.range(n, n + 3), "b": spark.createDataFrame([(f"row {n}",)], "s string")}


def _state(spark, at, commit=None):
    m = commits.manifest(spark, at, commit)
    return m["commit"], {t: sorted(map(tuple, commits.read(spark, at, t, commit).collect())) for t in m["tables"]}


def test_tables_are_read_as_of_a_commit(spark, tmp_path):
    at = str(tmp_path / "store")
    assert commits.head(spark, at) == 0
    assert commits.commit(spark, at, _two(spark, 0), 0) == 1
    first = _state(spark, at)
    assert commits.commit(spark, at, {"a": spark.range(10, 11)}, 1, {"b": spark.createDataFrame([("new",)], "s string")}) == 2
    assert _state(spark, at, 1) == first
    assert _state(spark, at) == (2, {"a": [(0,), (1,), (2,), (10,)], "b": [("new",)]})
    assert commits.compact(spark, at, "a", ["id"], 1) == 3 and _state(spark, at)[1] == _state(spark, at, 2)[1]
    assert len(commits.manifest(spark, at)["tables"]["a"]["folders"]) == 1
    commits.vacuum(spark, at)
    assert _state(spark, at)[1]["a"] == [(0,), (1,), (2,), (10,)]
    assert len(glob.glob(f"{at}/data/a/*")) == 1
    with pytest.raises(KeyError):
        commits.read(spark, at, "c")


@pytest.mark.parametrize("fails_at", range(6))
def test_a_commit_that_fails_at_any_step_leaves_the_old_state(spark, tmp_path, monkeypatch, fails_at):
    """Every call to the file system or to a writer may be the last; a reader then sees the old state, or the new one whole."""
    at = str(tmp_path / "store")
    commits.commit(spark, at, _two(spark, 0), 0)
    old, steps = _state(spark, at), []

    def breaking(f):
        def run(*args, **kw):
            steps.append(f.__name__)
            if len(steps) == fails_at + 1:
                raise OSError("the machine is gone")
            return f(*args, **kw)

        return run

    with monkeypatch.context() as m:
        m.setattr(commits, "_fs", breaking(commits._fs))
        m.setattr(commits, "put_if_absent", breaking(commits.put_if_absent))
        m.setattr(type(spark.range(1).write), "parquet", breaking(type(spark.range(1).write).parquet))
        try:
            commits.commit(spark, at, _two(spark, 100), 1)
        except OSError:
            pass
    now = _state(spark, at)
    assert now == old or now == (2, {"a": [(0,), (1,), (2,), (100,), (101,), (102,)], "b": [("row 0",), ("row 100",)]})
    if now == old:  # and the next writer goes on from there
        assert commits.commit(spark, at, _two(spark, 100), 1) == 2
    commits.vacuum(spark, at)
    assert _state(spark, at)[1]["a"][-1] == (102,)


def test_of_two_writers_on_one_base_one_wins(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "store")
    commits.commit(spark, at, _two(spark, 0), 0)
    real = commits.put_if_absent

    def slow(spark_, path, text):  # another writer publishes while this one still writes its rows
        monkeypatch.setattr(commits, "put_if_absent", real)
        commits.commit(spark, at, {"a": spark.range(50, 51)}, 1)
        return real(spark_, path, text)

    monkeypatch.setattr(commits, "put_if_absent", slow)
    with pytest.raises(commits.CommitConflict):
        commits.commit(spark, at, _two(spark, 200), 1)
    assert _state(spark, at)[1]["a"][-1] == (50,)
    with pytest.raises(commits.CommitConflict):
        commits.commit(spark, at, _two(spark, 200), 1)


def test_published_versions_always_have_a_current_one(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "bank")
    assert sinks.current_version(spark, at) is None
    for v in (3, 4, 1):
        sinks.publish_version(spark.range(v), at, v)
        assert sinks.current_version(spark, at) == v and sinks.read_current(spark, at).count() == v
    monkeypatch.setattr(commits, "put_if_absent", lambda *a: (_ for _ in ()).throw(OSError()))
    with pytest.raises(OSError):
        sinks.publish_version(spark.range(9), at, 9)
    assert sinks.current_version(spark, at) == 1


DECISIONS = (
    "seq int, candidate_id string, action string, target_memory_id string, supersedes_version_id string, memory_kind string, subject string, predicate string, object_text string, content string, "
    "world_start string, world_end string, entities array<string>, keywords array<string>, importance double, confidence double"
)


def _decision(seq, action, content=None, target=None, **kw):
    row = dict.fromkeys(c.split()[0] for c in DECISIONS.split(", "))
    return tuple((row | {"seq": seq, "candidate_id": f"c{seq}", "action": action, "content": content, "target_memory_id": target} | kw).values())


def _words(text):
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


def test_plans_are_committed_with_their_text_index(spark, tmp_path):
    at = str(tmp_path / "store")
    plans = [
        [_decision(1, "ADD", "the red house on the hill"), _decision(2, "ADD", "a blue boat")],
        [_decision(1, "UPDATE", "the red house by the sea", "mem_c_0001"), _decision(2, "ADD", "red house, red house")],
        [_decision(1, "DELETE", None, "mem_c_0002"), _decision(2, "SKIP")],
    ]
    plain = spark.createDataFrame([], store.VERSIONS)
    for n, rows in enumerate(plans):
        decisions = spark.createDataFrame(rows, DECISIONS)
        before = {f: os.path.getmtime(f) for f in glob.glob(f"{at}/data/**/*.parquet", recursive=True)}
        assert commits.commit_plan(spark, at, decisions, "c", n, _words) == n + 1
        assert {f: os.path.getmtime(f) for f in before} == before  # what is stored is not written again
        plain = spark.createDataFrame(store.apply_plan(plain, decisions, "c", n + 1)["versions"].collect(), store.VERSIONS)
        columns = ["version_id", "memory_id", "version_no", "content", "system_from", "system_to", "end_reason", "world_end"]
        assert sorted(map(tuple, commits.versions(spark, at).select(columns).collect()), key=str) == sorted(map(tuple, plain.select(columns).collect()), key=str)
    with pytest.raises(store.PlanError):
        commits.commit_plan(spark, at, spark.createDataFrame(plans[0], DECISIONS), "c", 1, _words)
    assert commits.head(spark, at) == 3

    asked = spark.createDataFrame([("c", 1, "red house"), ("c", 2, "the red house"), ("c", 3, "house red"), ("c", 4, "boat"), ("c", 5, "green"), ("c", 6, "")], "scope string, query_id int, text string")
    now = commits.versions(spark, at).select(F.col("version_id").alias("doc_id"), "system_from", "system_to")

    def hits(as_of, history=False):
        found = textindex.phrase_hits(commits.read(spark, at, "postings"), commits.read(spark, at, "lengths"), now, asked, _words(F.col("text")), None if as_of is None else F.lit(as_of), 5, history)
        out = {}
        for r in found.collect():
            out.setdefault(r.query_id, []).append((r["rank"], r.doc_id, r.n))
        return {q: [x[1:] for x in sorted(v)] for q, v in out.items()}

    one, two, three, old = "mem_c_0001_v2", "mem_c_0002_v1", "mem_c_0003_v1", "mem_c_0001_v1"
    assert hits(None) == {1: [(three, 2), (one, 1)], 2: [(one, 1)], 3: [(three, 1)]}
    assert hits(1) == {1: [(old, 1)], 2: [(old, 1)], 4: [(two, 1)]}
    assert hits(3, True)[4] == [(two, 1)] and {d for d, _ in hits(3, True)[2]} == {one, old}


def test_a_commit_reads_the_segment_of_its_own_rows_only(spark, tmp_path):
    """The folders that a commit adds name its own rows; a search of the merged index finds what the segments hold."""
    at = str(tmp_path / "store")
    for n in range(3):
        docs = spark.createDataFrame([("c", f"d{n}{k}", f"word{n} shared text") for k in range(4)], "scope string, doc_id string, content string")
        postings, lengths = textindex.segment(docs, F.split("content", " "))
        commits.commit(spark, at, {"postings": postings, "lengths": lengths}, n)
        folder = commits.manifest(spark, at)["tables"]["postings"]["folders"][-1]
        assert {r.doc_id[1] for r in spark.read.parquet(f"{at}/{folder}").collect()} == {str(n)}
    before = sorted(map(tuple, commits.read(spark, at, "postings").select("token", "doc_id").collect()))
    commits.compact(spark, at, "postings", ["token"], 2)
    assert sorted(map(tuple, commits.read(spark, at, "postings").select("token", "doc_id").collect())) == before
