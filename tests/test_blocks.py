"""Vectors and queries as blocks: what is written grows with them and not with their pairs, and the answers stay exact."""

import duckdb
import numpy as np

from palimpsest import catalog
from palimpsest.operators import records as rc
from palimpsest.operators import vectors


def _frame(spark, v, key):
    return spark.createDataFrame([(0, n, 0, x.tolist()) for n, x in enumerate(v)], f"scope int, {key} long, part int, v array<double>")


def test_no_row_is_made_for_each_cell_that_a_query_meets(spark, monkeypatch):
    """Random vectors: no bound spares a cell, so every one of 600 queries meets all cells; a row for each of them before."""
    monkeypatch.setattr(vectors, "QUERY_PART", 200)
    rnd = np.random.default_rng(8)
    d, q = rnd.normal(size=(900, 32)), rnd.normal(size=(600, 32))
    docs, asked = _frame(spark, d, "doc_id").drop("part"), _frame(spark, q, "query_id")
    cells, parts = vectors.in_cells(docs), vectors.parted(asked)
    told = vectors.bounds(cells.cells, parts, 5)
    assert parts.count() == 3 and told.count() == 3 * cells.cells.count() == 90
    found = vectors.compared(cells, parts, told.where("first"), 5)
    plan = vectors.compared(cells, parts, vectors.remaining(told, found, 5), 5, found)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate explode(sequence(0, (chunks" not in plan
    got = sorted((r.query_id, r["rank"], r.doc_id) for r in vectors.nearest(docs, asked, 5).collect())
    scores = np.round(q @ d.T, 9)
    assert got == [(i, n + 1, j) for i, s in enumerate(scores) for n, j in enumerate(np.lexsort((np.arange(900), -s))[:5].tolist())]


def test_queries_meet_only_cells_that_their_bound_reaches(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CHUNK", 150)
    rnd = np.random.default_rng(2)
    v = (rnd.normal(size=(12, 16)) * 4)[rnd.integers(12, size=2000)] + rnd.normal(size=(2000, 16)) * 0.3
    cells, asked = vectors.in_cells(_frame(spark, v, "doc_id").drop("part")), vectors.parted(_frame(spark, v[::100], "query_id"))
    blocks = cells.blocks.select("cell", "doc_id", "v", "around").toArrow().to_pylist()
    assert sum(len(b["doc_id"]) for b in blocks) == 2000 and 10 <= len(blocks) <= 20
    assert max(len(b["doc_id"]) for b in blocks) <= 3 * 150
    told = vectors.bounds(cells.cells, asked, 5)
    found = vectors.compared(cells, asked, told.where("first"), 5)
    met = 0
    for sure in (None, found):
        asking = vectors._asking(cells.cells, asked, 5, sure)
        pairs = asking.withColumnsRenamed({"v": "q"}).drop("scope").crossJoin(cells.blocks).toArrow().combine_chunks()
        best = None
        for n in range(pairs.num_rows):
            at = {x: pairs.column(x)[n] for x in pairs.column_names}
            reach, least = (np.frombuffer(at[x].as_buffer()) for x in ("reach", "least"))
            best = best or vectors.Best(least, 5)
            met += best.meet_block(np.frombuffer(at["q"].as_buffer()).reshape(20, -1), reach, at)
    assert 0 < met < 0.5 * 20 * 2000


def test_ties_of_a_whole_block_go_to_the_smaller_ids():
    """Scores that are all equal, ids as text, blocks in any order."""
    import pyarrow as pa

    best = vectors.Best(np.array([-np.inf, -np.inf]), 3)
    q = np.array([[1.0, 0.0], [0.0, 1.0]])
    for ids in (["m", "c", "x", "q"], ["b", "z", "a", "y"]):
        best.meet(q, np.array([9.0, 9.0]), np.full(2, -np.inf), np.array([[1.0, float(n)] for n in range(4)]), pa.array(ids))
    top = best.settle().to_pydict()
    assert top["query"] == [0, 0, 0, 1, 1, 1] and top["doc_id"] == ["a", "b", "c", "q", "y", "a"]
    assert best.least.tolist() == [1.0, 2.0]


def test_related_by_vectors_that_many_share(spark, tmp_path):
    """Nine vectors, three of them equal, for 200 customers and 40 suppliers."""
    rnd = np.random.default_rng(4)
    v = rnd.normal(size=(9, 6)).round(3).tolist()
    v[4] = v[7] = v[1]
    tables = {
        "embeddings": ([(n, x) for n, x in enumerate(v)], "vec_id long, embedding array<float>"),
        "customer": ([(n, f"Customer#{n:09d}", n % 7, "AUTO" if n % 2 else "0007") for n in range(200)], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string"),
        "supplier": ([(n, f"Supplier#{n:09d}", n % 7) for n in range(40)], "s_suppkey long, s_name string, s_nationkey int"),
    }
    c = duckdb.connect()
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    answer = c.execute(catalog.oracle_sql()["related_semantic"])
    columns = [x[0] for x in answer.description]
    want = sorted(map(str, answer.fetchall()))
    assert sorted(str(tuple(r)) for r in catalog.queries()["related_semantic"](spark, str(tmp_path)).select(*columns).collect()) == want


def test_a_memory_named_twice_takes_one_place(spark):
    """An entity that is also in the text counts once among the k smallest."""
    memories = spark.createDataFrame([(0, n, f"h{n}", "s", "p", ["Ann"], f"ann says {n}") for n in range(9)], "scope int, version_id long, content_hash string, subject string, predicate string, entities array<string>, content string")
    candidates = spark.createDataFrame([(0, 1, "none", "other", None, ["ann"])], "scope int, candidate_id long, content_hash string, subject string, predicate string, entities array<string>")
    df = rc.related(candidates, memories, 3)
    assert [(r.version_id, r.paths) for r in df.orderBy("place").collect()] == [(0, "entity"), (1, "entity"), (2, "entity")]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert any("WindowGroupLimit" in line and "dense_rank" in line for line in plan.split("\n"))
