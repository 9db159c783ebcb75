"""Porter's suffix stripper (1980), with the usual revisions for short and irregular words."""

from __future__ import annotations

import functools

# Irregular words and the suffix tables of the published algorithm.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning",
    "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "fulli": "ful", "logi": "log",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = "al ance ence er ic able ible ant ement ment ent sion tion ou ism ate iti ous ive ize".split()


def _vowels(word: str) -> list[bool]:
    out: list[bool] = []
    for ch in word:
        out.append(ch in "aeiou" or (ch == "y" and bool(out) and not out[-1]))
    return out


def _measure(stem: str) -> int:
    v = _vowels(stem)
    return sum(a and not b for a, b in zip(v, v[1:], strict=False))


def _short_end(word: str) -> bool:
    """Consonant, vowel, consonant other than w, x, y; a vowel and a consonant count where they are all."""
    v = _vowels(word)
    if len(word) >= 3 and not v[-3] and v[-2] and not v[-1] and word[-1] not in "wxy":
        return True
    return len(word) == 2 and v[0] and not v[1]


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and not _vowels(word)[-1]


def _replaced(word: str, table: dict[str, str]) -> str:
    for suffix in sorted(table, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            if suffix == "logi":
                return stem + "log" if _measure(stem + "l") > 0 else word
            return stem + table[suffix] if _measure(stem) > 0 else word
    return word


@functools.lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    word = word.lower()
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    # 1a: plurals
    if word.endswith("ies"):
        word = word[:-1] if len(word) == 4 else word[:-2]
    elif word.endswith("sses"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    # 1b: past and progressive
    if word.endswith("ied"):
        word = word[:-1] if len(word) == 4 else word[:-2]
    elif word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix):
                base = word[: -len(suffix)]
                if any(_vowels(base)):
                    if base.endswith(("at", "bl", "iz")):
                        base += "e"
                    elif _double(base):
                        base = base if base[-1] in "lsz" else base[:-1]
                    elif _measure(base) == 1 and _short_end(base):
                        base += "e"
                    word = base
                break
    # 1c: final y after a consonant that is not the first letter
    if word.endswith("y") and len(word) > 2 and not _vowels(word[:-1])[-1]:
        word = word[:-1] + "i"
    # 2: a long -alli is taken again after it has become -al
    if word.endswith("alli") and _measure(word[:-4]) > 0:
        word = _replaced(word[:-2], STEP2)
    else:
        word = _replaced(word, STEP2)
    word = _replaced(word, STEP3)
    # 4
    for suffix in sorted(STEP4, key=len, reverse=True):
        if word.endswith(suffix):
            cut = word[:-3] if suffix in ("sion", "tion") else word[: -len(suffix)]  # their first letter stays
            if _measure(cut) > 1:
                word = cut
            break
    # 5
    if word.endswith("e"):
        cut = word[:-1]
        if _measure(cut) > 1 or (_measure(cut) == 1 and not _short_end(cut)):
            word = cut
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word
