"""Queries on keys and shapes that only larger tables have, against their SQL."""

import duckdb
import numpy as np
import pyarrow as pa

from palimpsest import catalog
from palimpsest.functions import text as tx
from palimpsest.operators import graph, vectors


def _agrees(spark, folder, name, tables):
    """The query's rows over a folder of tables (name: rows, schema) are those of its SQL; the rows, sorted."""
    c = duckdb.connect()
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    answer = c.execute(catalog.oracle_sql()[name])
    columns = [x[0] for x in answer.description]
    want = sorted(map(str, answer.fetchall()))
    got = sorted(str(tuple(r)) for r in catalog.queries()[name](spark, str(folder)).select(*columns).collect())
    assert got == want
    return got


def test_a_chain_keeps_its_order_with_keys_above_a_million(spark, tmp_path):
    lines = [(1, 1_500_000, 1, 2.0, "N"), (1, 7, 2, 2.0, "N"), (1, 2_000_001, 3, 2.0, "A"), (1, 5, 4, 2.0, "R"), (1, None, 5, 2.0, "N"), (2, 3, 1, 1.0, "R"), (2, 3, 1, 1.0, "N"), (2, 1_000_009, 0, 1.0, None)]
    tables = {"orders": ([(1,), (2,), (3,)], "o_orderkey long"), "lineitem": (lines, "l_orderkey long, l_partkey long, l_linenumber int, l_extendedprice double, l_returnflag string")}
    assert _agrees(spark, tmp_path, "current_search_chain", tables) == ["(1, '1500000,7,2000001')", "(2, '3')", "(3, '')"]


def test_equal_vectors_are_compared_once(spark, monkeypatch):
    """The vectors of 3,000 documents and 600 queries, of which 30 and 20 differ, with ties across vectors; the answers are those of brute force."""
    rng = np.random.default_rng(3)
    few, asks = rng.normal(size=(30, 8)), rng.normal(size=(20, 8))
    few[7], few[8] = few[1], np.append(few[1][:-1], few[1][-1] + 1e-13)
    d, q = rng.integers(0, 30, 3000), rng.integers(0, 20, 600)
    seen = []
    plain = vectors.in_cells
    monkeypatch.setattr(vectors, "in_cells", lambda docs: (seen.append(docs.count()), plain(docs))[1])
    docs = spark.createDataFrame([(0, i, few[k].tolist()) for i, k in enumerate(d.tolist())], "scope int, doc_id long, v array<double>")
    queries = spark.createDataFrame([(0, i, 0, asks[k].tolist()) for i, k in enumerate(q.tolist())], "scope int, query_id long, part int, v array<double>")
    got = sorted((r.query_id, r["rank"], r.doc_id) for r in vectors.nearest(docs, queries, 7).collect())
    scores = np.round(asks[q] @ few[d].T, 9)
    assert got == [(i, n + 1, j) for i, s in enumerate(scores) for n, j in enumerate(np.lexsort((np.arange(3000), -s))[:7].tolist())]
    assert seen and max(seen) <= 30


def test_a_forest_is_handed_on_when_it_is_full(spark, monkeypatch):
    monkeypatch.setattr(graph, "FOREST_NODES", 100, raising=False)
    batches = [pa.RecordBatch.from_pydict({"a": list(range(k, k + 50)), "b": list(range(k + 1, k + 51))}) for k in range(0, 2000, 50)]
    out = list(graph._forest(iter(batches)))
    assert len(out) > 10 and max(b.num_rows for b in out) <= 200
    assert list(graph._forest(iter([]))) == []
    monkeypatch.undo()
    edges = spark.createDataFrame([(k, k + 1) for k in range(300)], "a long, b long")
    assert {r.root for r in graph.components(edges).collect()} == {0}


def test_stems_keep_the_lists(spark):
    """Nulls, empty lists and slices of lists keep their places; a repeated word is stemmed once in a batch."""
    rows = [["running", "naïve", None, "x1ing"], None, [], ["running", "ponies"]]
    assert tx.stemmed.func(pa.array(rows, pa.list_(pa.string())).slice(1)).to_pylist() == [[], [], ["run", "poni"]]
    df = spark.createDataFrame([(r,) for r in rows], "t array<string>").select(tx.stemmed("t").alias("s"))
    assert [r.s for r in df.collect()] == [["run", "naïve", None, "x1ing"], [], [], ["run", "poni"]]
