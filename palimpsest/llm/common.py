"""Helpers that the operators of this folder share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that are turned into Python objects at once; long texts make larger pieces costly.
SLICE_ROWS = 128


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def mapped(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names of one's own that clash with none of df's, whatever those are."""
    mark = "_"
    while any(c.lower() in {(mark + n).lower() for n in names} for c in df.columns):
        mark += "_"
    return [mark + n for n in names]


def saved(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage by a reliable checkpoint.

    The folder is the session's ``spark.checkpoint.dir``; only where that is unset and Spark runs
    on one machine (tests) does a folder of its own take its place.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not at and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: a folder of one machine would lose checkpoints with its executor")
        sc.setCheckpointDir(at or "/tmp/checkpoints")
    return df.checkpoint(eager=True)


def shuffle_width(spark: SparkSession) -> int:
    """Partitions for hand-made buckets: the session's own number, which follows the size of its input."""
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
