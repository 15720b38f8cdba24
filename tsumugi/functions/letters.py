"""Unicode text as numpy arrays of letters: one normal form used by every matching operator.

``letters`` keeps letters and digits (kana, kanji, the long-vowel mark) after compatibility
normalisation and case folding; spaces, line breaks, punctuation, symbols and invisible
characters vanish.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np


#: Code points of the planes that hold letters, digits and marks.
PLANES = 0x40000


@functools.cache
def keep_table(digits: bool = True) -> np.ndarray:
    """For each code point, whether it is a letter (or digit)."""
    kinds = "LN" if digits else "L"
    out = np.zeros(0x110000, bool)  # no letters stand beyond the third plane
    out[:PLANES] = np.fromiter((unicodedata.category(chr(i))[0] in kinds for i in range(PLANES)), bool, PLANES)
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def letter_codes(text: str | None, digits: bool = True) -> np.ndarray:
    """Code points of the letters of ``text``; empty for null."""
    if not text:
        return np.empty(0, np.uint32)
    cp = code_points(unicodedata.normalize("NFKC", text).casefold())
    return cp[keep_table(digits)[cp]]


def letters(text: str | None, digits: bool = True) -> str:
    return letter_codes(text, digits).tobytes().decode("utf-32-le")


def ngram_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each window of ``n`` codes, by doubling: O(log n) array passes."""
    if len(codes) < n:
        return np.empty(0, np.uint64)
    size = len(codes) - n + 1
    h, w, at = np.zeros(size, np.uint64), _mix(codes.astype(np.uint64)), 0
    width, rest = 1, n
    while rest:
        if rest & 1:
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + w[at : at + size])
            at += width
        rest >>= 1
        if rest:
            w = _mix(w[: len(w) - width] * np.uint64(0x9E3779B97F4A7C15) + w[width:])
            width *= 2
    return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel: O(len(a) * len(b) / word)."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        m = where.get(ch)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")
