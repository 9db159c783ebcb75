"""The engine's tables as views over the driver's, as DataFrames and as the same in SQL.

* versions: each event is a version of its user's memory, closed by the user's next event.
* messages: the turns of the conversations, a session being a conversation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..io import table

SCOPES = 10

VERSIONS_SQL = f"""versions AS (
  SELECT event_id AS version_id, user_id AS memory_id, user_id % {SCOPES} AS conversation_id, event_type AS kind, value, ts, props,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version_no,
    event_id AS system_from, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS system_to
  FROM events)"""
#: Order lines with a mode made of their discount.
LINES_SQL = "(SELECT *, CASE WHEN l_discount > 0.05 THEN 'AIR' WHEN l_discount > 0.02 THEN 'RAIL' ELSE 'SHIP' END AS l_mode FROM lineitem) lineitem"
MESSAGES_SQL = "messages AS (SELECT conv_id * 1000 + turn AS message_id, conv_id, turn, role, text FROM conversations)"


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("version_id"),
        F.col("user_id").alias("memory_id"),
        (F.col("user_id") % SCOPES).alias("conversation_id"),
        F.col("event_type").alias("kind"),
        "value",
        "ts",
        "props",
        F.row_number().over(own).alias("version_no"),
        F.col("event_id").alias("system_from"),
        F.lead("event_id").over(own).alias("system_to"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"), "conv_id", "turn", "role", "text")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.when(F.col("l_discount") > 0.05, "AIR").when(F.col("l_discount") > 0.02, "RAIL").otherwise("SHIP")
    return table(spark, sf_dir, "lineitem").withColumn("l_mode", mode)
