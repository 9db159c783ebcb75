"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are normalised (lower case, letters and digits, one space between words).  An
item of n characters may be met with k = ERROR_PER_MILLE * n / 1000 edits; it is cut into k + 1
pieces, so wherever it stands with at most k edits, one piece stands unchanged.  One Aho-Corasick
pass over a text finds all piece hits.  Each hit opens the window in which its item may stand;
windows that meet become one, and one run of Myers' bit-parallel distance over it, on whole-number
bit vectors of any length, gives every end with at most k edits.  So a text costs its length for
each item that it shares a piece with, however often the piece repeats.

Plan: scan -> mapInArrow, no exchange.  The items are a stated query set against all rows: they
reach the tasks in blocks of at most ``BLOCK_BYTES``, one pass over the documents for each block.
"""

from __future__ import annotations

import bisect
import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, slices

ERROR_PER_MILLE = 80
#: Items with fewer characters after normalising are met exactly and as whole words only.
MIN_ITEM_CHARS = 20
BLOCK_BYTES = 4_000_000

SCHEMA = "doc_id long, item_id long, distance long, item_chars long, start long, end long"
ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "item_id", "distance", "item_chars", "start", "end")])

Item = tuple[int, str]

#: ASCII other than letters and digits becomes a space; bytes of other characters stay.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def normalised(text: str) -> str:
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_TABLE).split()).decode("utf-8", "surrogatepass")


def budget(chars: int) -> int:
    return chars * ERROR_PER_MILLE // 1000 if chars >= MIN_ITEM_CHARS else 0


def _whole(flat: str, start: int, end: int) -> bool:
    """Whether neither edge of a place cuts a word; scripts written without spaces (from U+2E80 on) have no such edges."""
    edge = lambda at: 0 < at < len(flat) and " " not in flat[at - 1 : at + 1] and max(flat[at - 1 : at + 1]) < "\u2e80"
    return not edge(start) and not edge(end)


def pieces(item: str) -> list[tuple[int, str]]:
    """(offset, piece) of the item's budget + 1 pieces of near equal length."""
    n = budget(len(item)) + 1
    cuts = [k * len(item) // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _column_scores(pattern: str, text: str) -> Iterator[int]:
    """The least distance of the pattern to a part of the text that ends there, for each end from 1 on.

    Bit j of the vectors is row j + 1 of the distance matrix; a column costs a few operations on
    whole numbers.
    """
    m = len(pattern)
    at: dict[str, int] = {}
    for j, ch in enumerate(pattern):
        at[ch] = at.get(ch, 0) | 1 << j
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    for ch in text:
        eq = at.get(ch, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        plus = down | ~(xh | up) & full
        minus = up & xh
        if plus & high:
            score += 1
        elif minus & high:
            score -= 1
        plus, minus = plus << 1 & full, minus << 1 & full
        up = minus | ~(xv | plus) & full
        down = plus & xv
        yield score


def myers(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the best place of the pattern in the text with at most ``most`` edits, the first of equals."""
    if not pattern:
        return (0, 0)
    best = (len(pattern), 0)
    for end, score in enumerate(_column_scores(pattern, text), 1):
        if score < best[0]:
            best = (score, end)
    return best if best[0] <= most else None


def ends(pattern: str, text: str, most: int) -> list[tuple[int, int]]:
    """(distance, end) of every end with at most ``most`` edits that no neighbouring end betters; of a flat stretch the first."""
    out: list[tuple[int, int]] = []
    before = len(pattern) + 1
    held: tuple[int, int] | None = None
    for end, score in enumerate(_column_scores(pattern, text), 1):
        if score < before:
            held = (score, end) if score <= most else None
        elif score > before:
            if held:
                out.append(held)
            held = None
        before = score
    if held:
        out.append(held)
    return out


@functools.lru_cache(maxsize=4)
def _matcher(items: tuple[Item, ...]):
    """Aho-Corasick tree over all pieces of a block's items; a piece may belong to several."""
    import ahocorasick

    owners: dict[str, list[tuple[int, int]]] = {}
    for k, (_, item) in enumerate(items):
        for offset, piece in pieces(item):
            owners.setdefault(piece, []).append((k, offset))
    tree = ahocorasick.Automaton()
    for piece, where in owners.items():
        tree.add_word(piece, (len(piece), where))
    tree.make_automaton()
    return tree


def find_items(flat: str, items: tuple[Item, ...]) -> list[tuple[int, int, int, int]]:
    """(item's index, distance, start, end) in the normalised text: each item's verified places, apart from each other."""
    diagonals: dict[int, set[int]] = {}
    for end, (size, where) in _matcher(items).iter(flat):
        for k, offset in where:
            diagonals.setdefault(k, set()).add(end + 1 - size - offset)
    out = []
    for k, starts in sorted(diagonals.items()):
        item = items[k][1]
        out += [(k, *place) for place in _places(flat, item, sorted(starts))]
    return out


def _places(flat: str, item: str, starts: list[int]) -> list[tuple[int, int, int]]:
    """(distance, start, end) of an item's places from the starts of its diagonals; of overlapping ones the least distance stays, then the first."""
    most, m = budget(len(item)), len(item)
    if not most:
        exact: list[int] = []
        for start in starts:
            if start >= 0 and flat.startswith(item, start) and (not exact or start >= exact[-1] + m) and (m >= MIN_ITEM_CHARS or _whole(flat, start, start + m)):
                exact.append(start)
        return [(0, s, s + m) for s in exact]
    found: list[tuple[int, int]] = []
    k = 0
    while k < len(starts):
        a, b, alone = starts[k] - most, starts[k] + m + most, starts[k]
        k += 1
        while k < len(starts) and starts[k] - most <= b:
            b, alone = starts[k] + m + most, -1
            k += 1
        if alone >= 0 and flat.startswith(item, alone):
            found.append((0, alone + m))
            continue
        a = max(0, a)
        found += [(distance, a + end) for distance, end in ends(item, flat[a:b], most)]
    kept: list[tuple[int, int, int]] = []
    for distance, end in sorted(found):
        at = bisect.bisect_left(kept, end, key=lambda p: p[1])  # kept places that begin before this end
        if at and kept[at - 1][2] > end - (m - distance):  # it begins there at the latest: they overlap
            continue
        start = end - m
        if distance:
            # From its end backwards, the place's start: the reversed pattern over the reversed text.
            back = myers(item[::-1], flat[max(0, end - m - distance) : end][::-1], distance)
            start = max(0, end - (back[1] if back else m))
        if not at or kept[at - 1][2] <= start:
            kept.insert(at, (distance, start, end))
    return kept


def blocks(benchmark: DataFrame) -> Iterator[tuple[Item, ...]]:
    """The normalised items (null and empty ones left out, equal texts once, least id first) in blocks of bounded size."""
    held: list[Item] = []
    size = 0
    rows = benchmark.where("text is not null").select(F.col("item_id").cast("long"), "text").orderBy("item_id", "text")
    for item_id, text in rows.toLocalIterator():
        flat = normalised(text)
        if not flat:
            continue
        held.append((item_id, flat))
        size += len(flat.encode())
        if size >= BLOCK_BYTES:
            yield tuple(held)
            held, size = [], 0
    if held:
        yield tuple(held)


def _in_original(text: str, flat: str, places: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """Places of the normalised text as code points of the text itself, by whole words."""
    spans = [m.span() for m in _WORD.finditer(text)]
    words = flat.split(" ")
    if len(words) != len(spans):  # lower case may turn one character into several: a word may fall apart
        return [(0, len(text))] * len(places)
    ends, at = [], 0
    for w in words:
        at += len(w)
        ends.append(at)
        at += 1
    return [(spans[min(bisect.bisect_left(ends, a + 1), len(spans) - 1)][0], spans[min(bisect.bisect_left(ends, b), len(spans) - 1)][1]) for _, _, a, b in places]


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, distance, item_chars, start and end of every place of an item in a text.

    Only rows with a hit are returned.  start and end are code points of the text (whole words).
    Null and empty texts hold no item; null and empty items match nothing, very short ones
    (MIN_ITEM_CHARS) only exactly and as whole words; an item that repeats is reported under each of its ids; repeated rows are searched
    each for itself; empty tables give no rows; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for items in blocks(benchmark):
        found = saved(docs.mapInArrow(functools.partial(_report, items=items), SCHEMA))
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], SCHEMA) if out is None else out


def _report(batches: Iterator[pa.RecordBatch], items: tuple[Item, ...]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            flat = normalised(text or "")
            if places := find_items(flat, items):
                for (k, distance, _, _), (a, b) in zip(places, _in_original(text, flat, places), strict=True):
                    rows.append((doc_id, items[k][0], distance, len(items[k][1]), a, b))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(6)], schema=ARROW)


def without_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all columns, whose text holds no item.

    Null and empty texts hold none and stay; null, empty and repeated items change nothing; each
    of repeated rows is judged for itself; without items or rows docs comes back as it is.
    """
    at = docs.columns.index("text")
    for items in blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                yield batch.filter(pa.array([not find_items(normalised(t or ""), items) for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def digest(found: DataFrame) -> DataFrame:
    """One row for each document and item that it holds: its best distance and the number of places."""
    return found.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"), F.count("*").alias("n_places"), F.min("start").alias("first_start"))
