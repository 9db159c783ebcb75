"""Sessions of a conversation committed in their order from a stream that brings them late, early and repeatedly.

Spark keeps a state for each conversation in the query's checkpoint: the number it waits for, the
running commit, the numbers it gave up on, and the sessions that came ahead of a gap.  A session
whose turn it is is committed at once, with all that waited behind it.  A gap is given up when the
watermark is ``wait`` past the first session behind it; what fills it afterwards is committed on
arrival, marked late, for commits follow the order of commits and not of event time.  A session
that is committed or waits already is dropped.  The state holds what waits and the gaps given up,
not what was committed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import commits

OUTPUT = "conversation_id string, session_no long, session_id string, commit_id long, late boolean"
STATE = "next_no long, commit_id long, gaps array<long>, waiting array<long>, ids array<string>, due array<long>"


def _advance(next_no: int, commit: int, gaps: set[int], held: dict[int, tuple[str, int]], arrived: list[tuple[int, str, int]], now: int) -> tuple[int, int, list[tuple]]:
    """What a conversation commits after new arrivals (number, id, due) at a watermark; gaps and held are changed in place."""
    out = []
    for number, name, due in sorted(arrived):
        if number in gaps:
            commit += 1
            gaps.discard(number)
            out.append((number, name, commit, True))
        elif number >= next_no:
            held.setdefault(number, (name, due))
    while held:
        first = min(held)
        if first > next_no:
            if held[first][1] > now:
                break
            gaps.update(range(next_no, first))
        commit += 1
        out.append((first, held.pop(first)[0], commit, False))
        next_no = first + 1
    return next_no, commit, out


def in_order(sessions: DataFrame, wait: str = "1 hour", first_no: int = 0) -> DataFrame:
    """conversation_id, session_no, session_id, commit_id, late of a stream of sessions.

    sessions: conversation_id string, session_no long, session_id string.  Rows without a
    conversation or a number, and numbers below ``first_no``, are left out.
    """
    wait_ms = int(pd.Timedelta(wait).total_seconds() * 1000)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        next_no, commit, gaps, waiting, ids, due = state.get if state.exists else (first_no, 0, [], [], [], [])
        gaps, held = set(gaps), dict(zip(waiting, zip(ids, due, strict=True), strict=True))
        arrived = [] if state.hasTimedOut else [(int(n), s, int(t.timestamp() * 1000) + wait_ms) for b in batches for n, s, t in zip(b["session_no"], b["session_id"], b["arrived"], strict=True) if n >= first_no]
        now = state.getCurrentWatermarkMs()
        next_no, commit, out = _advance(next_no, commit, gaps, held, arrived, now)
        order = sorted(held)
        state.update((next_no, commit, sorted(gaps), order, [held[n][0] for n in order], [held[n][1] for n in order]))
        if held:
            state.setTimeoutTimestamp(max(held[order[0]][1], now + 1))
        yield pd.DataFrame([(key[0], *row) for row in out], columns=["conversation_id", "session_no", "session_id", "commit_id", "late"])

    named = sessions.where("conversation_id IS NOT NULL AND session_no IS NOT NULL").select(
        F.col("conversation_id").cast("string").alias("conversation_id"), F.col("session_no").cast("long").alias("session_no"), F.col("session_id").cast("string").alias("session_id"), F.current_timestamp().alias("arrived")
    )
    keyed = named.withWatermark("arrived", "0 seconds").groupBy("conversation_id")
    return keyed.applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def committed(path: str, table: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that adds each micro-batch to a table of the commit log exactly once.

    The manifest of a batch names it; a batch that a restart runs again finds itself named and
    adds nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        base = commits.head(spark, path)
        if commits.manifest(spark, path, base)["note"].get("batch", -1) < number:
            commits.commit(spark, path, {table: batch}, base, note={"batch": number})

    return write


def run_to_end(ordered: DataFrame, path: str, table: str, checkpoint: str) -> None:
    """Runs a stream over what has arrived and adds its output to a table of the commit log."""
    query = ordered.writeStream.foreachBatch(committed(path, table)).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
