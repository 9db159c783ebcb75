"""Queries that run as streams with state."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..io import table
from ..operators.graph import shared_folder
from ..sources import commits
from ..streaming import ordered


@query("ordered_turns", "SELECT CAST(conv_id AS VARCHAR) AS conversation_id, turn AS session_no, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS commit_id, false AS late FROM conversations")
def ordered_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations' turns as sessions of a stream that brings each twice, committed in order and once."""
    # A stream reads folders; the table may be a file in one or a folder of its own.
    turns = spark.readStream.schema(table(spark, sf_dir, "conversations").schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/conversations.parquet*")
    sessions = turns.select(
        F.col("conv_id").cast("string").alias("conversation_id"), F.col("turn").cast("long").alias("session_no"), F.concat_ws("-", "conv_id", "turn").alias("session_id"),
        F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"),
    )
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    ordered.run_to_end(ordered.in_order(sessions), f"{folder}/store", "sessions", f"{folder}/state")
    return commits.read(spark, f"{folder}/store", "sessions").select("conversation_id", "session_no", "commit_id", "late")
