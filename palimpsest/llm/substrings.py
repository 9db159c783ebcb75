"""Substring dedup: removal of word windows that also start earlier, by a recompression parse.

Naming is by content: a run of two equal words and a pair of adjacent words get a 64-bit hash of
what they stand for, so equal substrings get equal symbols in every document without a shared
dictionary; the Spark rounds bring equal names together.

* Round 1 parses each text: a run of exactly two equal words becomes one symbol, then a pair of
  symbols whose names throw (left, right) becomes one.  Both look at their direct neighbours
  only and no symbol is longer than two words, so in equal windows of ``window`` words all
  symbols that begin at places ``EDGE`` to ``window - EDGE - 2`` are the same.  The least of them
  (by its mixed name) is the window's anchor: equal windows have equal anchors at equal places.
  An anchor's high-level name covers the ``window - REACH + 1`` words around it that lie in
  every window it anchors.  Names met twice reveal the long repeats.
* Round 2 takes only the documents with such anchors and, of each of their windows under such an
  anchor, the name of the whole window; the first of equal ones in the order (doc_id, start)
  stays, all others are removed.  Here equal means equal by two hashes of 64 bits that share
  neither byte values nor multipliers, so what a first name reveals is verified by the second.

Equal names within a task are settled there: only one entry of each goes to the exchange, so a
passage that a third of all rows share costs one entry per task and never gathers in one place.

Plan: scan -> blobs by name -> exchange -> anchors by row -> join with the texts -> blobs by name
-> exchange -> removals by row -> join with the texts.  Both joins go by row in one query, so the
texts are exchanged once and that exchange is read twice.  Nothing reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, shuffle_width, slices
from .hashing import AGAIN_STEP, hashed_words, mix, planes, sequence_hashes, signed, unplaned

WINDOW = 20
#: Words at either edge of a window whose symbols may depend on what lies outside: a run that
#: the edge cuts changes at most two words, and a pair at most one more.
EDGE = 3
#: Words that a task holds before it deals them out.
BLOCK_WORDS = 2_000_000
RUN, LEFT, RIGHT, RANK = (np.uint64(k) for k in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3))
#: Stands for a null doc_id, which comes before all others.
NO_DOC = np.iinfo(np.int64).min
NAME_BYTES = 6
NAME_SHIFT = np.uint64(64 - 8 * NAME_BYTES)


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _by_row(column: pa.Array, again: bool = False) -> list[np.ndarray]:
    """The word hashes of each text of a column."""
    h, at = hashed_words(column, again=again)
    return [h[a:b] for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)]


def symbols(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One round of recompression over word hashes: names of the symbols, and where each begins."""
    n = len(h)
    if not n:
        return h, np.zeros(0, np.int64)
    begins = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    twos = begins[np.diff(np.append(begins, n)) == 2]
    name, single, keep = h.copy(), np.ones(n, bool), np.ones(n, bool)
    name[twos] = mix(h[twos] + RUN)
    single[twos] = False
    keep[twos + 1] = False
    at = np.flatnonzero(keep)
    name, single = name[at], single[at]
    right = (mix(name ^ LEFT) & np.uint64(1)).astype(bool)
    joins = np.flatnonzero(~right[:-1] & right[1:] & single[:-1] & single[1:])
    merged = mix(mix(name[joins] + LEFT) * RIGHT + name[joins + 1])
    keep = np.ones(len(name), bool)
    keep[joins + 1] = False
    name[joins] = merged
    return name[keep], at[keep]


def anchors(h: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The anchor's word position for each window of the text."""
    n = len(h)
    if n < window:
        return np.zeros(0, np.int64)
    name, at = symbols(h)
    rank = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    rank[at] = mix(name ^ RANK) >> np.uint64(1)
    places = window - 2 * EDGE - 1
    seen = np.lib.stride_tricks.sliding_window_view(rank[EDGE : n - EDGE - 1], places)
    return np.arange(n - window + 1) + EDGE + seen.argmin(axis=1)


def context_names(h: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """At p the name of the words p to p + 7 (for 20); an anchor at a takes the one at a - EDGE."""
    return sequence_hashes(h, window - (window - 2 * EDGE - 1) + 1)


def row_id(docs: DataFrame) -> DataFrame:
    """docs as doc_id, text and _rid, which rows share only if they agree in both."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.withColumn("_rid", F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), F.coalesce("text", F.lit(""))))


def _cut(order: np.ndarray, bucket: np.ndarray, width: int, columns: list[tuple[np.ndarray, int]]) -> list[list[bytes | None]]:
    """For each bucket the blobs of the columns, in the given order of rows."""
    ends = np.searchsorted(bucket[order], np.arange(width + 1))
    return [[planes(c[order[a:b]], w) if a < b else None for c, w in columns] for a, b in zip(ends, ends[1:], strict=False)]


def _blobs(parts: list[list[bytes | None]], names: list[str]) -> Iterator[pa.RecordBatch]:
    for k, row in enumerate(parts):
        if any(x is not None for x in row):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(pa.array([x], pa.binary()) for x in row)], names=["bucket", *names])


def _read(batches: list[pa.RecordBatch], columns: list[tuple[str, int]]) -> list[np.ndarray]:
    out = []
    for name, width in columns:
        found = [unplaned(x, width) for b in batches for x in b.column(name).to_pylist() if x is not None]
        out.append(np.concatenate(found) if found else np.zeros(0, np.uint64))
    return out


def _bucket(x: np.ndarray, width: int) -> np.ndarray:
    return ((mix(x) >> np.uint64(33)) * np.uint64(width)) >> np.uint64(31)


def _repeated_anchors(rows: DataFrame, window: int, width: int) -> DataFrame:
    """_rid, a: anchors whose name is met twice or more in the corpus."""
    columns = [("name", NAME_BYTES), ("rid", 8), ("a", 4), ("known_rid", 8), ("known_a", 4)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, int]] = []
        seen: set[int] = set()
        words = 0

        def dealt() -> Iterator[pa.RecordBatch]:
            name = np.concatenate([x for x, _, _ in held]) >> NAME_SHIFT
            a = np.concatenate([x for _, x, _ in held]).astype(np.uint64)
            rid = np.repeat(np.array([r for *_, r in held], np.int64).view(np.uint64), [len(x) for x, _, _ in held])
            order = np.lexsort((a, name))
            name, a, rid = name[order], a[order], rid[order]
            first = np.append(True, name[1:] != name[:-1])
            twice = ~first | ~np.append(first[1:], True)
            one = np.flatnonzero(first)
            known = np.flatnonzero(twice)  # met twice in this block: settled, whatever the others say
            to, to_known = _bucket(name[one], width), _bucket(rid[known], width)
            left = _cut(one[np.argsort(to, kind="stable")], _bucket(name, width), width, [(name, NAME_BYTES), (rid, 8), (a, 4)])
            right = _cut(known[np.argsort(to_known, kind="stable")], _bucket(rid, width), width, [(rid, 8), (a, 4)])
            yield from _blobs([x + y for x, y in zip(left, right, strict=True)], [c for c, _ in columns])

        for batch in slices(batches):
            for rid, h in zip(batch.column(0).to_pylist(), _by_row(batch.column(1)), strict=True):
                if len(h) >= window and rid not in seen:
                    seen.add(rid)
                    a = np.unique(anchors(h, window))
                    held.append((context_names(h, window)[a - EDGE], a, rid))
                    words += len(h)
            if words >= BLOCK_WORDS:
                yield from dealt()
                held, words = [], 0
                seen.clear()
        if held:
            yield from dealt()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, rid, a, known_rid, known_a = _read([*batches], columns)
        order = np.argsort(name, kind="stable")
        name, rid, a = name[order], rid[order], a[order]
        twice = np.zeros(len(name), bool)
        twice[1:] = name[1:] == name[:-1]
        twice[:-1] |= twice[1:].copy()
        rid, a = np.concatenate([rid[twice], known_rid]), np.concatenate([a[twice], known_a])
        for at in range(0, len(rid), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(signed(rid[at : at + 200_000])), pa.array(a[at : at + 200_000].astype(np.int32))], names=["_rid", "a"])

    schema = "bucket int, " + ", ".join(f"{c} binary" for c, _ in columns)
    return mapped(mapped(rows.select("_rid", "text"), deal, schema).repartition(width, "bucket"), meet, "_rid long, a int")


def _runs(rid: np.ndarray, doc: np.ndarray, s: np.ndarray) -> list[np.ndarray]:
    """rid, doc, first, last of each run of consecutive starts of a row."""
    if not len(s):
        return [rid, doc, s, s]
    order = np.lexsort((s, doc, rid))
    rid, doc, s = rid[order], doc[order], s[order]
    at = np.flatnonzero(np.append(True, (rid[1:] != rid[:-1]) | (doc[1:] != doc[:-1]) | (s[1:] > s[:-1] + 1)))
    return [rid[at], doc[at], s[at], s[np.append(at[1:], len(s)) - 1]]


def _removed_windows(marked: DataFrame, window: int, width: int) -> DataFrame:
    """_rid, doc, first, last: intervals of starts of windows that also start earlier; marked: _rid, doc_id, text, places."""
    columns = [("name", 8), ("other", 8), ("k", 4), ("s", 4), ("rid", 8), ("doc", 8), ("gone_rid", 8), ("gone_doc", 8), ("gone_first", 4), ("gone_last", 4)]

    def heads(name: np.ndarray, other: np.ndarray) -> np.ndarray:
        """For each of the sorted windows the first that equals it."""
        first = np.append(True, (name[1:] != name[:-1]) | (other[1:] != other[:-1]))
        return np.flatnonzero(first)[np.cumsum(first) - 1]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int, int]] = []
        seen: set[int] = set()
        words = 0

        def dealt() -> Iterator[pa.RecordBatch]:
            sizes = [len(x[0]) for x in held]
            name, other, s, home = (np.concatenate([x[j] for x in held]) for j in range(4))
            rid, doc = np.array([x[4] for x in held], np.int64), np.array([x[5] for x in held], np.int64)
            k = np.repeat(np.arange(len(held)), sizes)
            order = np.lexsort((s, doc[k], other, name))
            name, other, s, k, home = name[order], other[order], s[order], k[order], home[order]
            head = heads(name, other) if len(name) else np.zeros(0, np.int64)
            # Later than the block's first of its name: removed for sure.  The first ones go on to be compared.
            later = (doc[k] > doc[k[head]]) | (s > s[head]) & (doc[k] == doc[k[head]])
            gone, stay = np.flatnonzero(later), np.flatnonzero(~later)
            to = _bucket(home, width)
            by = stay[np.argsort(to[stay], kind="stable")]
            ends = np.searchsorted(to[by], np.arange(width + 1))
            gone_rid, gone_doc, first, last = _runs(rid[k[gone]].view(np.uint64), doc[k[gone]], s[gone])
            to_gone = _bucket(gone_rid, width)
            right = _cut(np.argsort(to_gone, kind="stable"), to_gone, width, [(gone_rid, 8), (gone_doc.view(np.uint64), 8), (first.astype(np.uint64), 4), (last.astype(np.uint64), 4)])
            parts = []
            for b in range(width):
                rows = by[ends[b] : ends[b + 1]]
                left: list[bytes | None] = [None] * 6
                if len(rows):
                    used, local = np.unique(k[rows], return_inverse=True)
                    left = [planes(name[rows], 8), planes(other[rows], 8), planes(local, 4), planes(s[rows], 4), planes(rid[used].view(np.uint64), 8), planes(doc[used].view(np.uint64), 8)]
                parts.append(left + right[b])
            yield from _blobs(parts, [c for c, _ in columns])

        for batch in slices(batches):
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _by_row(batch.column(2)), _by_row(batch.column(2), again=True), batch.column(3).to_pylist(), strict=True)
            for rid, doc, h, h2, places in rows:
                if rid in seen:
                    continue
                seen.add(rid)
                a = anchors(h, window)
                s = np.flatnonzero(np.isin(a, places))
                held.append((sequence_hashes(h, window)[s], sequence_hashes(h2, window, AGAIN_STEP)[s], s, context_names(h, window)[a[s] - EDGE], rid, NO_DOC if doc is None else doc))
                words += len(s)
            if words >= BLOCK_WORDS:
                yield from dealt()
                held, words = [], 0
                seen.clear()
        if held:
            yield from dealt()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[list[np.ndarray]] = [[], [], [], [], []]
        gone: list[list[np.ndarray]] = [[], [], [], []]
        for batch in batches:
            for row in range(batch.num_rows):
                name, other, k, s, rid, doc, g_rid, g_doc, g_first, g_last = _read([batch.slice(row, 1)], columns)
                k = k.astype(np.int64)
                for to, x in zip(got, (name, other, s.astype(np.int64), rid[k], doc[k].view(np.int64)), strict=True):
                    to.append(x)
                for to, x in zip(gone, (g_rid, g_doc.view(np.int64), g_first.astype(np.int64), g_last.astype(np.int64)), strict=True):
                    to.append(x)
        if not got[0]:
            return
        name, other, s, rid, doc = (np.concatenate(x) for x in got)
        if len(name):
            order = np.lexsort((s, doc, other, name))
            name, other, s, rid, doc = name[order], other[order], s[order], rid[order], doc[order]
            head = heads(name, other)
            later = (doc > doc[head]) | ((doc == doc[head]) & (s > s[head]))
            for to, x in zip(gone, _runs(rid[later], doc[later], s[later]), strict=True):
                to.append(x)
        rid, doc, first, last = (np.concatenate(x) for x in gone)
        for x in range(0, len(rid), 200_000):
            y = slice(x, x + 200_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(rid[y])), pa.array(doc[y]), pa.array(first[y].astype(np.int32)), pa.array(last[y].astype(np.int32))], names=["_rid", "doc", "first", "last"]
            )

    schema = "bucket int, " + ", ".join(f"{c} binary" for c, _ in columns)
    return mapped(mapped(marked.select("_rid", "doc_id", "text", "places"), deal, schema).repartition(width, "bucket"), meet, "_rid long, doc long, first int, last int")


def keep_mask(n: int, intervals: list[tuple[int, int]], window: int = WINDOW) -> np.ndarray:
    """True for the words of n that no window starting in one of the intervals covers."""
    change = np.zeros(n + 1, np.int64)
    for first, last in intervals:
        change[first] += 1
        change[min(n, last + window)] -= 1
    return np.cumsum(change)[:n] == 0


def dedup_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text of every row of docs (doc_id, text).

    A word is removed if a window of ``window`` words covers it whose words also stand earlier:
    in a smaller doc_id, or in the same document at an earlier start.  Windows are judged on the
    input.  kept_text joins the kept words by one space.  Null and empty texts have no words;
    a null doc_id comes before all others; rows that share a doc_id are one document in this
    order, so exact repeats of a row do not remove each other; texts shorter than a window lose
    nothing; an empty table gives no rows; other columns are ignored.  ``window`` is at least 8.
    """
    if window < 2 * EDGE + 2:
        raise ValueError("the window is too short for the parse")
    width = shuffle_width(docs.sparkSession)
    rows = row_id(docs)
    places = _repeated_anchors(rows, window, width).groupBy("_rid").agg(F.collect_set("a").alias("places"))
    marked = rows.join(places, "_rid")
    gone = _removed_windows(marked, window, width).groupBy("_rid").agg(F.collect_list(F.struct("doc", "first", "last")).alias("gone"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n_words, n_removed, kept = [], [], []
            for doc, text, intervals in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = tokens(text)
                n_words.append(len(words))
                if intervals:
                    # Rows that agree in _rid alone differ in doc_id.
                    own = [(x["first"], x["last"]) for x in intervals if x["doc"] == (NO_DOC if doc is None else doc)]
                    mask = keep_mask(len(words), own, window)
                    words = [w for w, k in zip(words, mask.tolist(), strict=True) if k]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"]
            )

    return mapped(rows.join(gone, "_rid", "left").select("doc_id", "text", "gone"), apply, "doc_id long, n_words long, n_removed long, kept_text string")


def digest(deduped: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    return deduped.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def sha256(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()
