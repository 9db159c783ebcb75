"""Keyed streaming state: late, early and repeated sessions, restarts in between, and gaps that are given up."""

import random
import time

from pyspark.sql import functions as F

from palimpsest.sources import commits
from palimpsest.streaming import ordered

SCHEMA = "conversation_id string, session_no long, session_id string"


def _run(spark, tmp_path, wait="1 hour"):
    """One start of the stream over all files that have arrived; state and store stay."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ordered.run_to_end(ordered.in_order(stream, wait), str(tmp_path / "store"), "sessions", str(tmp_path / "state"))


def _arrive(spark, tmp_path, rows):
    spark.createDataFrame([(c, n, f"{c}{n}") for c, n in rows], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def _held(spark, tmp_path):
    rows = commits.read(spark, str(tmp_path / "store"), "sessions").collect()
    return sorted((r.conversation_id, r.commit_id, r.session_no, r.late) for r in rows)


def test_restarts_give_the_batch_result(spark, tmp_path):
    rnd = random.Random(3)
    every = [(c, n) for c in "abc" for n in range(12)]
    rnd.shuffle(every)
    parts = [every[:10], every[5:20], every[18:30], every[30:] + every[:6] + [("a", None), (None, 1), ("b", -1)]]
    for part in parts:  # each start goes on from the checkpoint of the last
        _arrive(spark, tmp_path, part)
        _run(spark, tmp_path)
    assert _held(spark, tmp_path) == sorted((c, n + 1, n, False) for c in "abc" for n in range(12))
    before = commits.head(spark, str(tmp_path / "store"))
    _arrive(spark, tmp_path, every[:9])
    _run(spark, tmp_path)
    assert len(_held(spark, tmp_path)) == 36 and commits.head(spark, str(tmp_path / "store")) >= before


def test_a_gap_is_given_up_and_filled_late(spark, tmp_path):
    own = lambda: [x for x in _held(spark, tmp_path) if x[0] == "a"]
    _arrive(spark, tmp_path, [("a", 0), ("a", 2), ("a", 3)])
    _run(spark, tmp_path, "3 seconds")
    assert own() == [("a", 1, 0, False)]
    time.sleep(4)
    _arrive(spark, tmp_path, [("b", 0)])  # time goes on for what waits behind the gap
    _run(spark, tmp_path, "3 seconds")
    assert own() == [("a", 1, 0, False), ("a", 2, 2, False), ("a", 3, 3, False)]
    _arrive(spark, tmp_path, [("a", 1), ("a", 2)])
    _run(spark, tmp_path, "3 seconds")
    assert own()[-1] == ("a", 4, 1, True) and len(_held(spark, tmp_path)) == 5


def test_a_batch_that_runs_again_adds_nothing(spark, tmp_path):
    write = ordered.committed(str(tmp_path / "store"), "t")
    for number in (0, 0, 1, 1):
        write(spark.range(3).withColumn("n", F.lit(number)), number)
    assert commits.read(spark, str(tmp_path / "store"), "t").count() == 6 and commits.head(spark, str(tmp_path / "store")) == 2
