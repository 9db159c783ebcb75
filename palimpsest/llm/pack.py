"""Packing of documents into token windows by best-fit decreasing.

Each task packs what it scans, in blocks of a bounded number of tokens, so no token is shuffled.
In a block the pieces are placed longest first; a segment tree whose leaves are the remaining
capacities 0..window finds the tightest open window that still takes the piece.  Documents longer
than a window are first cut into full windows, which need no search, and a tail.

Plan: scan -> mapInArrow, no exchange.  A lost task is rerun on the same split and gives the same
windows, since their numbers come from the partition's number and a counter in it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mapped, slices
from .encoders import word_ids

WINDOW = 4096
#: Tokens that a task holds before it packs them (16 MB of ids).
BLOCK_TOKENS = 4_000_000
#: Windows that one partition may number.
WINDOWS_PER_PARTITION = 1 << 36

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class CapacityTree:
    """Open windows by remaining capacity, with the least capacity of at least x in log(window) steps."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.stacks: list[list[int]] = [[] for _ in range(window + 1)]

    def _change(self, at: int, by: int) -> None:
        at += self.size
        count = self.count
        while at:
            count[at] += by
            at >>= 1

    def push(self, capacity: int, window_no: int) -> None:
        if capacity:
            self.stacks[capacity].append(window_no)
            self._change(capacity, 1)

    def pop_tightest(self, need: int) -> tuple[int, int] | None:
        """(capacity, window) of the open window with the least capacity >= need, taken out of the tree."""
        count, at = self.count, need + self.size
        if not count[at]:
            # Climb until a right sibling holds something, then descend to its leftmost leaf.
            while True:
                if at == 1:
                    return None
                if not at & 1 and count[at + 1]:
                    at += 1
                    break
                at >>= 1
            while at < self.size:
                at <<= 1
                if not count[at]:
                    at += 1
        capacity = at - self.size
        found = self.stacks[capacity].pop()
        self._change(capacity, -1)
        return capacity, found


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[int], list[int], int]:
    """Window number and offset of each piece (lengths 1..window), and how many windows there are."""
    tree, n = CapacityTree(window), 0
    where, offset = [0] * len(lengths), [0] * len(lengths)
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        need = lengths[k]
        found = tree.pop_tightest(need)
        if found is None:
            found = (window, n)
            n += 1
        capacity, where[k] = found
        offset[k] = window - capacity
        tree.push(capacity - need, where[k])
    return where, offset, n


def cut(total: int, window: int) -> list[tuple[int, int]]:
    """(start, length) of a document's full windows and its tail."""
    return [(at, min(window, total - at)) for at in range(0, total, window)]


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, block_tokens: int = BLOCK_TOKENS, text: Column | str = "text"
) -> DataFrame:
    """One row per piece of a document: its ids (unsigned little-endian 32-bit) and its place in a sequence.

    docs: doc_id and text.  A null text counts as empty, so its document is the end id alone;
    doc_id may be null or repeated, each row is packed as a document of its own; other columns
    are ignored.  An empty table gives no rows.  Sequences hold at most ``window`` ids and belong
    to one partition; what is left of one is padding.
    """
    column = F.col(text) if isinstance(text, str) else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        base = TaskContext.get().partitionId() * WINDOWS_PER_PARTITION
        held: list[tuple[int, int, bytes, int]] = []
        tokens = 0

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal base
            where, offset, n = best_fit_decreasing([len(ids) >> 2 for _, _, ids, _ in held], window)
            for at in range(0, len(held), 4096):
                some = held[at : at + 4096]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x[0] for x in some], pa.int64()),
                        pa.array([x[1] for x in some], pa.int64()),
                        pa.array([len(x[2]) >> 2 for x in some], pa.int64()),
                        pa.array([x[2] for x in some], pa.binary()),
                        pa.array([x[3] for x in some], pa.int64()),
                        pa.array([base + w for w in where[at : at + 4096]], pa.int64()),
                        pa.array(offset[at : at + 4096], pa.int64()),
                    ],
                    names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )
            base += n

        for batch in slices(batches):
            for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encoder.ids(body or "") + end
                total = len(ids) >> 2
                held += [(doc_id, at, ids[4 * at : 4 * (at + n)], total) for at, n in cut(total, window)]
                tokens += total
                if tokens >= block_tokens:
                    yield from packed()
                    held, tokens = [], 0
        if held:
            yield from packed()

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), column.alias("text")), run, SCHEMA)


def with_checksum(pieces: DataFrame) -> DataFrame:
    """Pieces with the CRC-32 of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def checksum(ids: bytes) -> int:
    return zlib.crc32(ids)
