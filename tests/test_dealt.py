"""Steps that are dealt out by their number of rows: tasks of bounded size, the same results."""

from __future__ import annotations

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as registry
from palimpsest.operators import graph

SF = "/root/testdata/sf0.001"


def _oracle(name: str, sf_dir: str, columns: list[str]) -> Counter:
    con = duckdb.connect()
    for t in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{t}'")
    found = con.execute(registry.oracle_sql()[name])
    at = [[d[0] for d in found.description].index(c) for c in columns]
    return Counter(tuple(row[i] for i in at) for row in found.fetchall())


def _same(spark, name: str, sf_dir: str):
    df = registry.queries()[name](spark, sf_dir)
    assert Counter(tuple(r) for r in df.collect()) == _oracle(name, sf_dir, df.columns)
    return df


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["access_trace_hits", "cluster_errors", "related_pool", "context_merge"])
def test_tasks_hold_a_bounded_number_of_rows(spark, monkeypatch, name):
    monkeypatch.setattr(graph, "TASK_ROWS", 500)
    assert "REPARTITION_BY_NUM" in _plan(_same(spark, name, SF))


def test_one_task_is_left_to_the_planner(spark):
    df = spark.range(10)
    assert graph.dealt(df, graph.TASK_ROWS, "id") is df
    assert graph.dealt(df, 3 * graph.TASK_ROWS, "id").rdd.getNumPartitions() == 3


def test_related_memories_of_repeated_customers(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT CASE WHEN i < 20 THEN 1 ELSE i END AS c_custkey, 'n' || i AS c_name, CAST(CASE WHEN i = 5 THEN 2 ELSE 1 END AS INTEGER) AS c_nationkey, 'A' AS c_mktsegment FROM range(60) r(i)) TO '{tmp_path}/customer.parquet'")
    con.execute(f"COPY (SELECT i AS s_suppkey, CAST(1 + i % 2 AS INTEGER) AS s_nationkey FROM range(50) r(i)) TO '{tmp_path}/supplier.parquet'")
    df = _same(spark, "related_routes_join", str(tmp_path))
    assert "UnionExec" not in _plan(df) and "Union" not in _plan(df)  # no pair of either route is a row


def test_lineage_of_long_chains_and_cycles_in_small_tasks(spark, monkeypatch):
    from palimpsest.operators import store

    monkeypatch.setattr(graph, "TASK_ROWS", 100)
    edges = {(v, v - 1) for v in range(1, 90)} | {(v, v // 2) for v in range(60, 90)} | {(200, 201), (201, 202), (202, 200), (203, 200)}
    told = [(v, v % 7) for v in [*range(90), 200, 203, 203]]
    best = {}
    for start in {v for v, _ in told} | {v for e in edges for v in e}:
        seen, now, depth = set(), {start}, 0
        while now:
            seen |= now
            for v, m in told:
                if v in now:
                    best.setdefault((start, m), depth)
            now, depth = {p for v, p in edges if v in now} - seen, depth + 1
    df = store.lineage(spark.createDataFrame(told, "version_id long, message_id long"), spark.createDataFrame(sorted(edges), "version_id long, parent_version_id long"))
    assert sorted(tuple(r) for r in df.collect()) == sorted((v, m, d) for (v, m), d in best.items())


@pytest.mark.parametrize("name", ["lineage_closure", "lineage_delta"])
def test_lineage_queries_in_small_tasks(spark, monkeypatch, name):
    monkeypatch.setattr(graph, "TASK_ROWS", 200)
    _same(spark, name, SF)


@pytest.mark.parametrize("name", ["publication_closure", "publication_gate", "connected_components"])
def test_ties_in_small_tasks(spark, monkeypatch, name):
    monkeypatch.setattr(graph, "TASK_ROWS", 500)
    _same(spark, name, SF)


def test_skills_meet_segments_in_blocks(spark, monkeypatch):
    import numpy as np

    from palimpsest.functions import text as tx
    from palimpsest.operators import skills as sk

    monkeypatch.setattr(sk, "BLOCK", 7)
    r = np.random.default_rng(3)
    v = r.normal(size=(60, 5))
    segments = [("access", i // 3, i % 3, f"word{i % 4}", v[i].tolist()) for i in range(40)]
    bank = [("access", i, f"word{i % 3}", "which", v[40 + i].tolist()) for i in range(20)]
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    want = {(q, s): max(float(unit[i] @ unit[40 + s]) for i in range(40) if i // 3 == q) for q in range(14) for s in range(20)}
    found = sk.ranked_skills(spark.createDataFrame(bank, "side string, skill_id long, name string, description string, v array<double>"), spark.createDataFrame(segments, "side string, query_id long, part long, text string, v array<double>"), tx.simple_tokens)
    got = {(x["query_id"], x["skill_id"]): x["semantic"] for x in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert "CartesianProduct" not in _plan(found)


def test_turns_of_one_row_group_are_dealt_out(spark, monkeypatch, tmp_path):
    from palimpsest.plans import memory

    for t in ("conversations", "benchmark"):
        duckdb.sql(f"COPY (FROM '{SF}/{t}.parquet') TO '{tmp_path}/{t}.parquet'")
    monkeypatch.setattr(memory, "TEXTS", 20, raising=False)
    held, _, _, vectors, _ = memory._inputs(spark, str(tmp_path))
    assert memory.memories(spark, str(tmp_path)).rdd.getNumPartitions() == 5 and len(held.inputFiles()) == 5
    assert "Generate" not in _plan(vectors)  # a text's tokens are not rows
    _same(spark, "multipliers_rank", str(tmp_path))


def test_hash_vectors_are_made_within_their_rows(spark, monkeypatch):
    from pyspark.sql import functions as F

    from palimpsest.operators import retrieval as rt
    from palimpsest.plans import memory

    monkeypatch.setattr(rt, "VECTOR_ROWS", 2)
    texts = [(0, 1, "the cat sat on the mat"), (0, 2, None), (0, 3, "  \n"), (0, 4, "Été 北京 été"), (1, 4, "a b"), (0, 5, "the cat"), (0, 5, "sat")]
    docs = spark.createDataFrame(texts, "scope int, doc_id int, text string")
    got = {(r.scope, r.doc_id): {p.idx: p.value for p in r.v} for r in memory._vectors(docs, ["scope", "doc_id"]).collect()}
    want: dict = {}
    tokens = F.array_remove(F.split(F.lower("text"), r"\s+"), "")
    for r in rt.hash_embedding(docs.select(F.struct("scope", "doc_id").alias("k"), "text"), tokens, "k").collect():
        want.setdefault(tuple(r.k), {})[r.idx] = r.value
    assert got == want and len(got) == 4
    assert rt.hash_vectors(docs.where("doc_id IN (2, 3)"), tokens, ["doc_id"]).count() == 0


@pytest.mark.parametrize("most", [1, 7, 1000])
def test_products_meet_shared_words_only(monkeypatch, most):
    import numpy as np
    import pyarrow as pa

    from palimpsest.operators import search

    monkeypatch.setattr(search, "PRODUCT_VALUES", most)
    r = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(9)]
    weights = r.integers(0, 3, (9, 4)).astype(float)
    texts = [[f"w{i}" for i in r.integers(0, 14, n)] for n in (6, 0, 11, 3)] + [None]
    counts = np.array([[(t or []).count(w) for w in vocabulary] for t in texts], float)
    words = search._by_word(weights)
    row, word, n = search._known(pa.array(texts, pa.list_(pa.string())), pa.array(vocabulary))
    assert np.array_equal(search._product(len(texts), row, word, n, words), counts @ weights)
    none = search._known(pa.array(texts, pa.list_(pa.string())), pa.array([], pa.string()))
    assert len(none[0]) == 0 and not search._product(3, *none, search._by_word(np.zeros((0, 2)))).any()


def test_stated_queries_take_no_job_for_each_partition(spark, monkeypatch):
    from palimpsest.operators import search

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        queries = spark.createDataFrame([(0, k, [("a", 1.0)], [], 0) for k in range(9)], "scope int, query_id int, tokens array<struct<token: string, x: double>>, terms array<struct<term: string, x: double>>, at int").repartition(60, "query_id")
        spark.sparkContext.setJobGroup("asked", "asked")
        blocks = list(search._asked_blocks(queries))
        assert sorted(i for b in blocks for i in b.ids) == list(range(9)) and len(spark.sparkContext.statusTracker().getJobIdsForGroup("asked")) < 30
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
