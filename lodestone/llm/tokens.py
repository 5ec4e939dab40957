"""Matches of the GPT-2 style pattern over a whole block of texts at once, on arrays.

The pattern is `'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`.
With each code point's class (letter, number, white space, other) its matches are: runs of one
class; of white space before a non-space the last character stands apart, and joins what follows
if it is U+0020; an apostrophe that starts a match and one of the seven endings form a match.
"""

from __future__ import annotations

import base64

import numpy as np
import public_tokenizers
import regex

OTHER, LETTER, NUMBER, SPACE = range(4)
_CLASSES: list[np.ndarray] = []


def classes() -> np.ndarray:
    """Class of every code point, by the same library that reads the pattern."""
    if not _CLASSES:
        table = np.zeros(0x110000, np.uint8)
        every = np.delete(np.arange(0x110000, dtype="<u4"), np.s_[0xD800:0xE000]).tobytes().decode("utf-32-le")
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, every):
                first, last = ord(every[m.start()]), ord(every[m.end() - 1])
                table[first : last + 1] = kind
        table[0xD800:0xE000] = OTHER
        _CLASSES.append(table)
    return _CLASSES[0]


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the byte offset of each with the total at the end."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.ones(len(points), np.int64)
    if len(points) != len(data):
        size += (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    at = np.zeros(len(points) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    return points, at


def matches(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Byte offsets at which a match starts, for texts end to end with offsets `at`; sorted."""
    points, byte_at = code_points(data)
    n = len(points)
    if n == 0:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    first = np.zeros(n + 1, bool)  # first code point of a text; the end counts as one
    first[np.searchsorted(byte_at, at[:-1])] = True
    first[n] = True
    start = first[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    before_word = np.zeros(n, bool)  # white space right before a non-space of the same text
    before_word[:-1] = space[:-1] & ~space[1:] & ~first[1:n]
    start |= before_word
    start[1:] &= ~((before_word & (points == 0x20))[:-1])
    tick = np.flatnonzero(start & (points == 0x27))
    if len(tick):
        padded = np.concatenate([np.where(first[1:], 0, 1).astype(bool), [False]])  # next code point is of the same text
        ext = np.concatenate([points, np.zeros(3, np.uint32)])
        one, two = ext[tick + 1], ext[tick + 2]
        in_one = padded[tick]
        in_two = in_one & padded[np.minimum(tick + 1, n)]
        short = in_one & np.isin(one, [ord(c) for c in "stmd"])
        long = in_two & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        hit, size = tick[short | long], np.where(short, 2, 3)[short | long]
        start[hit + 1] = False
        end = hit + size
        start[end[end < n]] = True
    return byte_at[:-1][start]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def path(name: str) -> str:
    return public_tokenizers.path(name)
