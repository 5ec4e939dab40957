"""Porter's suffix stripper, from the description in Program 14(3), 1980."""

from __future__ import annotations

import re

#: Fixed suffix tables of steps 2, 3 and 4.
STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize"


def _shape(word: str) -> str:
    """v or c for each letter; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or ch == "y" and out[-1:] == "c" else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _shape(word)))


def _short(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and len(word) >= 3 and word[-1] not in "wxy"


def _table(word: str, pairs: list[tuple[str, str]]) -> str:
    """Replace the longest suffix of the table, if a measure is left before it."""
    for suffix, new in sorted(pairs, key=lambda p: -len(p[0])):
        if word.endswith(suffix):
            rest = word[: len(word) - len(suffix)]
            return rest + new if _measure(rest) else word
    return word


def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    for suffix, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            word = word[: len(word) - len(suffix)] + new
            break
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    else:
        for suffix in ("ed", "ing"):
            rest = word[: -len(suffix)]
            if word.endswith(suffix) and "v" in _shape(rest):
                word = rest
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _short(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _table(word, [tuple(p.split(":")) for p in STEP2.split()])
    word = _table(word, [tuple(p.split(":")) for p in STEP3.split()])
    for suffix in sorted([*STEP4.split(), "ion"], key=len, reverse=True):
        if word.endswith(suffix):
            rest = word[: -len(suffix)]
            if _measure(rest) > 1 and (suffix != "ion" or rest[-1:] in ("s", "t")):
                word = rest
            break
    if word.endswith("e") and (_measure(word[:-1]) > 1 or _measure(word[:-1]) == 1 and not _short(word[:-1])):
        word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word
