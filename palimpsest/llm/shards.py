"""Contiguous shards of near equal bytes from global prefix sums.

Rows are ordered by doc_id (ties by the row's place in the scan), one total per range partition
goes to the driver, and each task adds the prefix of its partition to its own running sum; the
row whose middle byte lies in the k-th of ``shards`` equal parts of all bytes goes to shard k.

Plan: scan -> project to 28 bytes a row -> one range exchange -> checkpoint (so that totals and
assignment see the same partitions, also after a loss) -> two narrow passes.  The text itself is
never shuffled.  What the driver holds is one total per partition and one number per shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, saved, text_or_empty

SHARDS = 24
ROW_BYTES = 8


def shard_documents(docs: DataFrame, shards: int = SHARDS, row_bytes: int = ROW_BYTES) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row of docs (doc_id, text).

    Null text has size ``row_bytes`` and the checksum of no bytes; null doc_ids come first;
    rows that repeat a doc_id stay neighbours in the order of the scan; an empty table gives no
    rows.  Slots run from 0 without gaps in each shard.
    """
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text_or_empty()) + F.lit(row_bytes)).cast("long").alias("size"),
        F.crc32(text_or_empty().cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("row_no"),
    )
    ordered = saved(sized.repartitionByRange("doc_id", "row_no").sortWithinPartitions("doc_id", "row_no").select("doc_id", "size", "text_crc32"))

    totals = ordered.groupBy(F.spark_partition_id().alias("part")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    base: dict[int, tuple[int, int]] = {}
    bytes_before = rows_before = 0
    for part, size, rows in sorted(map(tuple, totals.collect())):
        base[part] = (bytes_before, rows_before)
        bytes_before += size
        rows_before += rows
    total = max(1, bytes_before)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        before, row = base.get(TaskContext.get().partitionId(), (0, 0))
        for batch in batches:
            if not batch.num_rows:
                continue
            size = batch.column(1).to_numpy()
            ends = before + np.cumsum(size)
            # The middle byte decides; doubled to stay with whole numbers.
            shard = np.minimum(shards - 1, (2 * ends - size) * shards // (2 * total))
            index = row + np.arange(len(size))
            before, row = int(ends[-1]), row + len(size)
            yield batch, shard, index

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, int] = {}
        for _, shard, index in placed(batches):
            for s, at in zip(*np.unique(shard, return_index=True), strict=True):
                least.setdefault(int(s), int(index[at]))
        yield pa.RecordBatch.from_arrays([pa.array(list(least), pa.int64()), pa.array(list(least.values()), pa.int64())], names=["shard", "first"])

    first = np.zeros(shards, np.int64)
    for shard, at in mapped(ordered, firsts, "shard long, first long").groupBy("shard").agg(F.min("first")).collect():
        first[shard] = at

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, shard, index in placed(batches):
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pc.cast(pa.array(shard), pa.int32()), pa.array(index - first[shard], pa.int64())], names=["doc_id", "size", "text_crc32", "shard", "slot"]
            )

    return mapped(ordered, assign, "doc_id long, size long, text_crc32 long, shard int, slot long")
