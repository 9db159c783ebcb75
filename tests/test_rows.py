"""Small rules on rows: normalising, first problems, rendered queries, merges of candidate sets."""

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import scalars
from palimpsest.operators import replies


def test_a_row_without_reference_and_answer_raises(spark):
    df = spark.createDataFrame([("r", "a"), ("", "a"), ("", None), (None, "a")], "reference string, answer string")
    both = scalars.reference_or_answer(F.col("reference"), F.col("answer"))
    assert [r.x for r in df.select(both.alias("x")).collect()] == ["r", "a", "", "a"]
    with pytest.raises(Exception, match="neither"):
        spark.createDataFrame([(None, None)], "reference string, answer string").select(scalars.require(both, "neither").alias("x")).collect()


def test_the_first_problem_counts(spark):
    df = spark.createDataFrame([(True, True), (False, True), (None, True), (False, None)], "a boolean, b boolean")
    assert [r.x for r in df.select(scalars.first_problem([(F.col("a"), "one"), (F.col("b"), "two")]).alias("x")).collect()] == ["one", "two", "two", "ok"]


def test_rendered_queries(spark):
    df = spark.createDataFrame([(" who? ", ["a  b\n c", None, "x" * 400], [("ann", "hi"), (None, None)]), (None, None, None)], "q string, hits array<string>, turns array<struct<speaker string, content string>>")
    first, second = df.select(scalars.recovery_query(F.col("q"), F.col("hits")).alias("r"), scalars.session_text(F.col("turns")).alias("s")).collect()
    assert first.r == "Question: who?\nFirst retrieval returned 3 memories.\nReturned memory contents:\n- a b c\n- " + "x" * 320
    assert second.r == "Question: \nFirst retrieval returned 0 memories.\nReturned memory contents:\n- (none)"
    assert first.s == "ann: hi\nunknown: "


def test_a_clean_set_loses_its_references_to_the_bank(spark):
    df = spark.createDataFrame([("c1", ["s1", "s2"], 3)], "candidate_id string, related_existing_skill_ids array<string>, expected_skill_version int")
    assert tuple(replies.without_stale(df, True).first()) == ("c1", [], None)
    assert tuple(replies.without_stale(df, False).first()) == ("c1", ["s1", "s2"], 3)
