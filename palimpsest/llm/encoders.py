"""Exact, memoising front ends of two public tokenizer files.

A text over a proven alphabet is cut into the tokenizer's own pre-tokens here; each distinct
pre-token is encoded once per worker by the library's model and remembered in a bounded table.
Every other text (special strings, characters outside that alphabet) goes to the library whole,
so the ids are the library's own either way.
"""

from __future__ import annotations

import functools
import os
import re
from array import array

#: Entries after which a table is emptied; bounds a worker's memory to about 120 MB.
MEMO_ENTRIES = 800_000
#: Pre-tokens longer than this are encoded but not remembered.
MEMO_PART_CHARS = 64

# Characters on which both regex engines agree, and their classes.
UNPROVEN = re.compile("[^\t\n\r\x20-\x7e\xa1-\xac\xae-\xff]")
LOWER = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
UPPER = "A-Z\xc0-\xd6\xd8-\xde"
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
SUFFIXES = "'s|'t|'re|'ve|'m|'ll|'d"


def load(path: str):
    """The tokenizer of a file, without truncation or padding, one thread per worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def special_strings(tok) -> list[str]:
    return [t.content for t in tok.get_added_tokens_decoder().values()]


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Memo(dict):
    """Pre-token to value; a missing one is made by the library's model."""

    def __init__(self, tok, value):
        super().__init__()
        self.model, self.letters, self.value = tok.model, _byte_letters(), value

    def __missing__(self, part: str):
        found = self.value(self.model.tokenize(part.encode().decode("latin-1").translate(self.letters)))
        if len(part) <= MEMO_PART_CHARS:
            self[part] = found
        return found


class _Encoder:
    def __init__(self, path: str, value):
        self.tok = load(path)
        special = special_strings(self.tok)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.memo = _Memo(self.tok, value)

    def proven(self, text: str) -> bool:
        if len(self.memo) > MEMO_ENTRIES:
            self.memo.clear()
        return not (UNPROVEN.search(text) or self.special and self.special.search(text))


class WordIds(_Encoder):
    """Ids for a tokenizer that lower-cases, drops white space and never joins across it."""

    CUT = re.compile(f"{SUFFIXES}|[{LOWER}]+|[{NUMBERS}]|[^\\s{LOWER}{NUMBERS}]+").findall

    def __init__(self, path: str):
        super().__init__(path, lambda tokens: array("I", [t.id for t in tokens]).tobytes())

    def ids(self, text: str) -> bytes:
        """The ids of a text as unsigned 32-bit numbers of the machine's byte order."""
        if self.proven(text):
            return b"".join(map(self.memo.__getitem__, self.CUT(text.lower())))
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()


class SpacedCounts(_Encoder):
    """Numbers of tokens for a byte-level BPE whose pre-tokens take one leading space."""

    CUT = re.compile(f"{SUFFIXES}| ?[{LOWER}{UPPER}]+| ?[{NUMBERS}]+| ?[^\\s{LOWER}{UPPER}{NUMBERS}]+|\\s+(?!\\S)|\\s+").findall

    def __init__(self, path: str):
        super().__init__(path, len)

    def count(self, text: str) -> int:
        if self.proven(text):
            return sum(map(self.memo.__getitem__, self.CUT(text)))
        return len(self.tok.encode(text, add_special_tokens=False).ids)


@functools.lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One encoder per worker process; tasks of a reused worker share its table."""
    return WordIds(path)


@functools.lru_cache(maxsize=2)
def spaced_counts(path: str) -> SpacedCounts:
    return SpacedCounts(path)
