"""64-bit hashes of the words of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

_random = np.random.default_rng(20240229)
_BYTE = _random.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads each bit of 64-bit numbers over all."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of every word in order; words by ASCII white space, A-Z lowered."""
    data = np.frombuffer(b" ".join(texts).lower() + b" ", np.uint8)
    blank = _BLANK[data]
    inside = np.flatnonzero(~blank)
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    firsts = np.flatnonzero(np.diff(inside, prepend=-2) > 1)
    lengths = np.diff(np.append(firsts, len(inside)))
    place = np.arange(len(inside)) - np.repeat(firsts, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), _BASE, np.uint64))
    words = mixed(np.add.reduceat(_BYTE[data[inside]] * powers[place], firsts) + lengths.astype(np.uint64))
    ends = np.cumsum([len(t) + 1 for t in texts])
    return np.searchsorted(ends, inside[firsts], side="right"), words
