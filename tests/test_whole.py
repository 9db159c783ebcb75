"""Queries over whole tables and operators without a bound, on small fixtures with exact values."""

import os
from collections import Counter

import pytest

from palimpsest import catalog
from palimpsest.io import table
from palimpsest.operators import store

SF = "/root/testdata/sf0.01"


def _write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_every_candidate_of_a_batch_is_sure_of_three(spark, tmp_path):
    lines = [(c, 100 * c + k, 10.0 * c - k) for c in (1, 2, 3, 27) for k in range(5)]
    _write(spark, tmp_path, "orders", [(1, 40)], "o_orderkey long, o_custkey long")
    _write(spark, tmp_path, "lineitem", [(1, *x) for x in lines], "l_orderkey long, l_partkey long, l_suppkey long, l_extendedprice double")
    rows = catalog.queries()["batch_bank_fill"](spark, str(tmp_path)).collect()
    assert {r.skill_id for r in rows if r.sure} == {100 * c + k for c in (1, 2, 3, 27) for k in range(3)}
    assert len(rows) == 12


def test_runs_are_compared_over_all_ids(spark, tmp_path):
    events = [(0, 1, "purchase", 5), (5000, 1, "signup", 5), (5001, 2, "purchase", 5), (5002, 1, "signup", 6), (5003, 1, "signup", 6), (9999, 3, "view", 7), (9999, 2, "purchase", 5)]
    _write(spark, tmp_path, "events", [(i, u, t, f'{{"k": {k}}}') for i, u, t, k in events], "event_id long, user_id long, event_type string, props string")
    rows = catalog.queries()["run_vs_run_cases"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in rows) == [(1, 5, "shared"), (1, 6, "after_only"), (2, 5, "before_only")]


def _union_find(orders, lines):
    parent = {o: o for o in orders}

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    first = {}
    for o, *row in lines:
        a, b = sorted((find(o), find(first.setdefault(tuple(row), o))))
        parent[b] = a
    return {o: find(o) for o in orders}


def test_write_sets_meet_in_a_chain_and_a_hub(spark, tmp_path):
    chain = [(o, 10 * o + d, 1) for o in range(200, 100, -1) for d in (0, 10)]
    hub = [(o, 7, 7) for o in range(300, 500)] + [(o, o, 8) for o in range(300, 310)]
    lines = [*chain, *hub, (600, 1, 1), (601, 1, 2), (601, 1, 2)]
    orders = [*range(101, 201), *range(300, 500), 600, 601, 602]
    _write(spark, tmp_path, "orders", [(o,) for o in orders], "o_orderkey long")
    _write(spark, tmp_path, "lineitem", lines, "l_orderkey long, l_partkey long, l_suppkey long")
    got = {r.node: r.root for r in catalog.queries()["write_set_components"](spark, str(tmp_path)).collect()}
    assert got == _union_find(orders, lines)
    assert Counter(got.values()) == {101: 100, 300: 200, 600: 1, 601: 1, 602: 1}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_write_sets_of_the_tables(spark):
    orders = [r[0] for r in table(spark, SF, "orders").select("o_orderkey").collect()]
    lines = [tuple(r) for r in table(spark, SF, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").collect()]
    got = {r.node: r.root for r in catalog.queries()["write_set_components"](spark, SF).collect()}
    assert got == _union_find(orders, lines)
    sizes = Counter(got.values())
    assert max(sizes.values()) > 8


def test_lineage_has_no_depth_limit(spark):
    direct = spark.createDataFrame([(0, 7)], "version_id long, message_id long").coalesce(1)
    parents = spark.createDataFrame([(k + 1, k) for k in range(103)], "version_id long, parent_version_id long").coalesce(1)
    got = {tuple(r) for r in store.lineage(direct, parents).collect()}
    assert got == {(k, 7, k) for k in range(104)}


def test_lineage_ends_on_a_cycle(spark):
    direct = spark.createDataFrame([(0, 7)], "version_id long, message_id long")
    parents = spark.createDataFrame([(1, 0), (2, 1), (0, 2)], "version_id long, parent_version_id long")
    assert {tuple(r) for r in store.lineage(direct, parents).collect()} == {(0, 7, 0), (1, 7, 1), (2, 7, 2)}


def test_runs_keep_every_label(spark, tmp_path):
    _write(spark, tmp_path, "labels", [(k, 0, 1) for k in range(33)], "doc_id long, quality int, toxic int")
    found = catalog.queries()
    assert [tuple(r) for r in found["run_transition_matrix"](spark, str(tmp_path)).collect()] == [("W", "W", 33)]
    assert {(r.qa_id, r.failure_age) for r in found["iteration_cases"](spark, str(tmp_path)).collect()} == {(k, k % 3 + 1) for k in range(33)}
