"""Writes that either take place as a whole or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import commits


def create(df: DataFrame, path: str) -> None:
    """Writes a new run; an existing one is never overwritten."""
    df.write.mode("errorifexists").parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def publish_version(df: DataFrame, path: str, version: int) -> str:
    """Writes a state as a version folder of its own, then publishes it; a reader sees the old or the new state, at every moment one of them.

    What is published is a log: each entry is created under the next free name and none is ever
    changed or removed, so there is no moment without a current version.
    """
    spark = df.sparkSession
    at = f"{path}/version={version}"
    df.write.mode("errorifexists").parquet(at)
    log = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_published")
    log.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(log)
    while not commits.put_if_absent(spark, f"{path}/_published/{len(_published(spark, path)):012d}", str(version)):
        pass  # another writer took the name: the next one
    return at


def _published(spark: SparkSession, path: str) -> list[str]:
    return [n for n in commits._names(spark, f"{path}/_published") if n.isdigit()]


def current_version(spark: SparkSession, path: str) -> int | None:
    found = _published(spark, path)
    return int(commits._text(spark, f"{path}/_published/{found[-1]}")) if found else None


def read_current(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/version={current_version(spark, path)}")


def complete(rows: DataFrame, expected: DataFrame, key: str) -> None:
    """Raises ValueError unless the rows have each expected key once and no other."""
    n = rows.groupBy(key).agg(F.count("*").alias("n")).join(expected.select(key).distinct().withColumn("e", F.lit(1)), key, "full_outer")
    bad = n.where("n IS NULL OR e IS NULL OR n > 1").take(1)
    if bad:
        raise ValueError(f"missing, unexpected or repeated: {bad[0][key]}")
