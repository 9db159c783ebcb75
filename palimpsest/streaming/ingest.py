"""Incremental ingest: sessions of a conversation in order, each commit once, late ones by commit and not by event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import latest


def pending(incoming: DataFrame, committed: DataFrame, keys: list[str]) -> DataFrame:
    """Work that is not yet committed; running the same input again adds nothing."""
    return incoming.dropDuplicates(keys).join(committed.select(*keys).distinct(), keys, "left_anti")


def retryable(work: DataFrame, attempts: DataFrame, keys: list[str], order: str, terminal: tuple[str, ...]) -> DataFrame:
    """Work whose latest attempt did not end for good."""
    done = latest(attempts, keys, F.desc(order)).where(F.col("status").isin(*terminal))
    return work.join(done.select(*keys), keys, "left_anti")


def closed_intervals(changes: DataFrame, keys: list[str], at: str = "commit_id") -> DataFrame:
    """The change feed as intervals: each change holds until the next of its key."""
    from pyspark.sql import Window

    own = Window.partitionBy(*keys).orderBy(at)
    return changes.withColumns({"version_no": F.row_number().over(own), "system_from": F.col(at), "system_to": F.lead(at).over(own)})


def ingest(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs ``apply`` on each micro-batch; the checkpoint makes a batch take effect once if ``apply`` is idempotent per batch id."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def session_activity(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a user's events by a gap in event time; events later than ``late`` are left out by the watermark."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("value")).select("user_id", "w.start", "w.end", "n", "value")
