"""Snapshots that prune files, and scans of a store that answers in pages."""

import json
import os
import sys

from pyspark.sql import functions as F

from palimpsest.sources import paged, temporal

STORE = '''"""A store of 1000 memories that notes what it is asked."""
import json, os

LOG = {log!r}

def count(scope):
    return len([k for k in range(1000) if scope is None or k % 4 == scope])

def fetch(offset, limit, columns, scope):
    rows = [k for k in range(1000) if scope is None or k % 4 == scope][offset : offset + limit]
    with open(os.path.join(LOG, f"{{os.getpid()}}-{{offset}}"), "a") as out:
        out.write(json.dumps([offset, limit, columns, scope]) + "\\n")
    whole = lambda k: {{"memory_id": k, "scope": k % 4, "text": f"memory {{k}}", "vector": [0.0] * 384}}
    return [{{c: whole(k)[c] for c in columns}} for k in rows]
'''


def test_a_snapshot_opens_the_files_of_its_time(spark, tmp_path):
    rows = [(k, k, k + 3 if k % 5 else None) for k in range(400)] + [(1000, None, None), (1001, 0, 399)]
    df = spark.createDataFrame(rows, "version_id long, system_from long, system_to long")
    at = str(tmp_path / "versions")
    temporal.write(df, at, 20)
    files = lambda d: set(d.inputFiles())
    every = files(spark.read.parquet(at))
    for as_of in (0, 19, 20, 57, 399, 10_000, None):
        got = temporal.snapshot(spark, at, 20, as_of)
        want = {v for v, a, b in rows if a is not None and (b is None if as_of is None else a <= as_of and (b is None or b > as_of))}
        assert {r.version_id for r in got.collect()} == want
    early = temporal.snapshot(spark, at, 20, 30)
    scan = early._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in scan and "_from" in scan
    read = {r.f for r in early.select(F.input_file_name().alias("f")).distinct().collect()}
    assert len(read) < len(every) / 4 and early.columns == df.columns


def test_pages_are_fetched_side_by_side_without_the_vectors(spark, tmp_path, monkeypatch):
    log = tmp_path / "log"
    log.mkdir()
    (tmp_path / "paged_store_of_test.py").write_text(STORE.format(log=str(log)))
    spark.sparkContext.addPyFile(str(tmp_path / "paged_store_of_test.py"))
    monkeypatch.syspath_prepend(str(tmp_path))
    monkeypatch.setenv("PYTHONPATH", os.pathsep.join([str(tmp_path), os.environ.get("PYTHONPATH", "")]))
    paged.register(spark)
    asked = lambda: sorted(tuple(json.dumps(x) for x in json.loads(line)) for f in log.iterdir() for line in f.read_text().splitlines())

    def scan(**options):
        for f in log.iterdir():
            f.unlink()
        return spark.read.format("paged").schema("memory_id long, scope long, text string").option("store", "paged_store_of_test:").option("run", 1).option("scopeColumn", "scope").options(**options).load()

    whole = scan()
    assert whole.rdd.getNumPartitions() == 4
    assert sorted(r.memory_id for r in whole.collect()) == list(range(1000))
    assert {x[0] for x in asked()} == {"0", "256", "512", "768"} and all("vector" not in x[2] for x in asked())
    assert sorted(r.memory_id for r in scan(offset="512").collect()) == list(range(512, 1000))
    own = scan().where("scope = 3 AND memory_id > 500")
    assert sorted(r.memory_id for r in own.collect()) == [k for k in range(501, 1000) if k % 4 == 3]
    assert {x[3] for x in asked()} == {"3"} and len(asked()) == 1
    sys.modules.pop("paged_store_of_test", None)
