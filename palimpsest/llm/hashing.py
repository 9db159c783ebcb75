"""Hashes of words and of word sequences, alike in every process, and packed columns of them.

Words are hashed straight from an Arrow column's bytes, all texts of a batch at once: a word's
hash is the sum of a table value of each byte times a power of its place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that sums of products spread over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: The odd multiplier of the polynomials.
STEP = np.uint64(0x9E3779B97F4A7C15)
#: White space: space and U+0009 to U+000D.
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_CASED = mix(np.arange(1, 257, dtype=np.uint64))
_LOWER = _CASED[np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256))]
#: Byte values and multiplier of a second hash of words, which shares nothing with the first.
_AGAIN = mix(np.arange(1001, 1257, dtype=np.uint64))
AGAIN_STEP = np.uint64(0xD6E8FEB86659FD93)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, nulls as empty, and where each row begins and the last ends."""
    column = column.fill_null("") if column.null_count else column
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return held, at - at[0]


def hashed_words(column: pa.Array, lower: bool = False, again: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a string column (A-Z as a-z if ``lower``) and each row's bounds among them; ``again``: the second hash, of words as they are."""
    data, rows = _bytes(column)
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = rows[:-1][rows[:-1] < len(data)]
    begins[heads] = inside[heads]  # a word never goes on from one row into the next
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(rows), np.int64)
    used = np.cumsum(inside)
    first = used[starts] - 1  # among the bytes of words
    size = np.diff(np.append(first, used[-1]))
    powers = np.full(int(size.max()), AGAIN_STEP if again else STEP, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers)
    place = np.arange(used[-1]) - np.repeat(first, size)
    h = mix(np.add.reduceat((_AGAIN if again else _LOWER if lower else _CASED)[data[inside]] * powers[place], first))
    return h, np.searchsorted(starts, rows)


def word_hashes(text: str | None, lower: bool = False) -> np.ndarray:
    return hashed_words(pa.array([text], pa.string()), lower)[0]


def sequence_hashes(h: np.ndarray, n: int, step: np.uint64 = STEP) -> np.ndarray:
    """Hash of each n consecutive entries of h."""
    if len(h) < n:
        return h[:0]
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out *= step
        out += h[k : len(h) - n + 1 + k]
    return mix(out)


def sorted_distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) > 1 else x


def planes(a: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each entry, byte by byte: bytes that hardly change lie together and compress."""
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplaned(blob: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(blob) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(blob, np.uint8).reshape(width, -1).T
    return out.view("<u8").ravel()


def signed(a: np.ndarray) -> np.ndarray:
    return a.astype(np.uint64).view(np.int64)
