"""Versions laid out by the eras in which they were in force, so that a snapshot reads the files of its time only.

An era is a range of ``span`` commits.  A version lies in the folder of the era in which it began
and of the era in which it ended (the open ones in one of their own), so the predicate of a
snapshot is a predicate on folders first: those that began later, or ended earlier, are never
opened.  Most versions end soon after they began, so the folders lie near the diagonal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import visible

#: The era of the end of an open version: later than all.
OPEN = 2**31 - 1


def _era(commit: Column, span: int) -> Column:
    return F.floor(commit / F.lit(span)).cast("int")


def write(versions: DataFrame, path: str, span: int) -> None:
    """Writes versions (system_from, system_to and any other columns) as a new layout; rows without a begin belong to no snapshot and are left out."""
    placed = versions.where("system_from IS NOT NULL").withColumn("_from", _era(F.col("system_from"), span)).withColumn("_to", F.coalesce(_era(F.col("system_to"), span), F.lit(OPEN)))
    # The rows of a folder are dealt by their begin too: a folder that holds a third of all rows is written by many tasks.
    placed.repartition("_from", "_to", F.pmod(F.xxhash64("system_from"), F.lit(8))).write.mode("errorifexists").partitionBy("_from", "_to").parquet(path)


def snapshot(spark: SparkSession, path: str, span: int, as_of: int | None) -> DataFrame:
    """The versions in force at a commit, or now: the snapshot predicate over the folders that can hold them."""
    held = spark.read.option("basePath", path).parquet(path)
    if as_of is None:
        return held.where(F.col("_to") == OPEN).drop("_from", "_to")
    era = as_of // span
    near = held.where((F.col("_from") <= era) & (F.col("_to") >= era))
    return near.where(visible(F.lit(as_of))).drop("_from", "_to")
