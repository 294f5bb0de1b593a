"""Texts as arrays of code points: skip-and-fold table, rolling hashes, word runs, all vectorised over a batch."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache

import numpy as np

_U = np.uint64
#: Odd bases of the two rolling hashes (fixed values: results of different tasks must agree).
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


@cache
def fold_table() -> np.ndarray:
    """Of each code point: 0 to skip it (neither letter nor digit), else its lower-case code point."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if (ch := chr(c)).isalnum():
            table[c] = ord(ch.lower()[0])
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser; makes polynomial hashes modulo 2^64 safe against repetitive texts."""
    x = x.astype(_U)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@cache
def _mixed(seed: int) -> np.ndarray:
    """mix() of the folded code point of each code point, 0 where it is skipped."""
    folded = fold_table()
    return np.where(folded > 0, mix(folded.astype(_U) + _U(seed << 32)), _U(0))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        size = max(4096, 1 << (n - 1).bit_length())
        known = np.ones(size, _U)
        known[1:] = _U(base)
        known = np.multiply.accumulate(known)
        _POWERS[base] = known
    return known


def codepoints(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' code points in one array, and where each text starts (one more entry than texts)."""
    whole = "".join([t for t in texts if t])
    cp = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts)), out=starts[1:])
    return cp, starts


def rolling_hashes(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit rolling polynomial hashes of each text's letters and digits; other characters are skipped.

    No canonical text is built: a character adds table[c] * base^(number of kept characters before it). A null
    text hashes like none of the others.
    """
    cp, starts = codepoints(texts)
    kept = np.zeros(len(cp) + 1, np.int64)
    np.cumsum(fold_table()[cp] > 0, out=kept[1:])
    nth = kept[:-1] - np.repeat(kept[starts[:-1]], np.diff(starts))
    null = np.fromiter((t is None for t in texts), bool, len(texts))
    result = []
    for seed, base in enumerate(BASES):
        total = np.zeros(len(cp) + 1, _U)
        np.cumsum(_mixed(seed)[cp] * powers(base, int(nth.max(initial=0)) + 1)[nth], out=total[1:])
        h = mix(total[starts[1:]] - total[starts[:-1]])
        result.append(np.where(null, _U(0x5851F42D4C957F2D + seed), h))
    return result[0], result[1]


def word_runs(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every run of letters and digits: its text's index, start in the text, length, and 64-bit hash, folded."""
    cp, starts = codepoints(texts)
    keep = fold_table()[cp] > 0
    where = np.flatnonzero(keep)
    if not len(where):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(_U)
    owner = np.searchsorted(starts, where, "right") - 1
    first = np.append(True, (np.diff(where) > 1) | (np.diff(owner) > 0))
    begin = np.flatnonzero(first)
    length = np.diff(np.append(begin, len(where)))
    nth = np.arange(len(where)) - np.repeat(begin, length)
    total = np.zeros(len(where) + 1, _U)
    np.cumsum(_mixed(0)[cp[where]] * powers(BASES[0], int(length.max()))[nth], out=total[1:])
    h = mix(total[begin + length] - total[begin])
    own = owner[begin]
    return own, where[begin] - starts[own], length, h
