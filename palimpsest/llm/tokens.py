"""Token counts of whole texts by overlap resynchronisation.

A huge document is encoded in overlapping chunks with offsets.  Two neighbouring chunks are
spliced at a position where both begin a pre-token and which lies far enough from the first
chunk's end that the cut cannot have changed it; where there is none, the first chunk is
widened and encoded again.  Only one chunk's encoding is held at a time.

Why such a splice is exact: the pre-tokenizer scans from left to right and looks at most a few
characters ahead.  If position p begins a pre-token of the whole text, the rest of its encoding
is the encoding of text[p:]; a chunk that begins before p and also begins a pre-token there goes
on in the same way until close to its own end.  ``margin`` covers the look-ahead and the longest
special string.

Plan: scan -> mapInArrow, no exchange.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, slices
from .encoders import spaced_counts, special_strings

CHUNK_CHARS = 16_384
OVERLAP_CHARS = 256
#: Look-ahead of the pre-tokenizer's pattern, in characters.
LOOK_AHEAD = 8

SCHEMA = "doc_id long, n_bytes long, n_tokens long, n_chunks int, n_widened int"


def starts(encoding) -> list[int]:
    """Positions at which a pre-token of the encoding begins, in order."""
    out, last = [], None
    for word, (at, _) in zip(encoding.word_ids, encoding.offsets, strict=True):
        if word is None or word != last:
            out.append(at)
        last = word
    return out


def resynchronised(tok, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> tuple[list[int], int, int]:
    """Ids of a text from overlapping chunks; how many chunks there were, and how often one was widened."""
    margin = LOOK_AHEAD + max([0, *map(len, special_strings(tok))])
    overlap = max(overlap, 2 * margin + 2)
    chunk = max(chunk, 2 * overlap)
    ids: list[int] = []
    n = len(text)
    at, chunks, widened = 0, 0, 0  # at: where a pre-token of the whole text begins; ids holds what comes before
    encoded = tok.encode(text[:chunk], add_special_tokens=False)
    left, right = 0, min(n, chunk)
    while True:
        chunks += 1
        if right >= n:
            ids += [i for i, (s, _) in zip(encoded.ids, encoded.offsets, strict=True) if left + s >= at]
            return ids, chunks, widened
        wide = overlap
        while True:
            begin = max(at + 1, right - wide)
            end = min(n, begin + max(chunk, 2 * wide))
            following = tok.encode(text[begin:end], add_special_tokens=False)
            ours = {left + s for s in starts(encoded)}
            limit = min(right, end) - margin
            # A splice next to white space or inside a byte-split character never counts as a beginning of its own.
            common = [p for s in starts(following) if begin < (p := begin + s) <= limit and p in ours and p > at]
            if common or right >= n:
                break
            # No stable boundary: take more of the text into this chunk and try again with a wider overlap.
            widened += 1
            wide *= 2
            right = min(n, right + wide)
            encoded = tok.encode(text[left:right], add_special_tokens=False)
        if right >= n:
            continue
        splice = common[-1]
        ids += [i for i, (s, _) in zip(encoded.ids, encoded.offsets, strict=True) if at <= left + s < splice]
        encoded, left, right, at = following, begin, end, splice


def token_counts(docs: DataFrame, tokenizer: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, n_chunks and n_widened of every row of docs (doc_id, text).

    Null text counts as empty (0 tokens, 1 chunk).  Rows with a repeated or null doc_id are
    counted each for itself; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = spaced_counts(tokenizer)
        for batch in slices(batches):
            n_tokens, n_chunks, n_widened, n_bytes = [], [], [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                n_bytes.append(len(text.encode()))
                if len(text) <= chunk:
                    n, k, w = counts.count(text), 1, 0
                else:
                    ids, k, w = resynchronised(counts.tok, text, chunk, overlap)
                    n = len(ids)
                n_tokens.append(n)
                n_chunks.append(k)
                n_widened.append(w)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(n_chunks, pa.int32()), pa.array(n_widened, pa.int32())],
                names=["doc_id", "n_bytes", "n_tokens", "n_chunks", "n_widened"],
            )

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, SCHEMA)
