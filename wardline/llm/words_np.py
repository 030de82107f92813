"""Words and their hashes over UTF-8 buffers, in numpy.

A word is a run of ASCII letters and digits and non-ASCII bytes; A-Z count as
a-z. A run longer than PIECE_BYTES counts as several words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from wardline.llm.common import PIECE_BYTES, row_blocks

_BYTES = np.arange(256)
_ASCII_WORD = np.isin(_BYTES, np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", np.uint8))
IS_WORD = _ASCII_WORD | (_BYTES >= 0x80)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint64) + 1
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = _powers(_BASE, PIECE_BYTES + 1)
_INV = _powers(_INVERSE, PIECE_BYTES + 1)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values (uint64 arithmetic wraps)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _hash_slice(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and word starts of at most PIECE_BYTES bytes; words also end at ``breaks``."""
    inside = IS_WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = breaks[breaks < len(data)]
    first[at] = inside[at]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    at = breaks[(breaks > 0) & (breaks <= len(data))] - 1
    last[at] = inside[at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    total = np.cumsum(LOWER[data] * _POW[:len(data)])
    before = np.where(starts > 0, total[starts - 1], np.uint64(0)) if len(starts) else total[:0]
    return mix((total[ends] - before) * _INV[starts]), starts


def hashed_blocks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, word hashes, row of each word) for blocks of whole rows."""
    for lo, hi in row_blocks(offsets):
        start, end = int(offsets[lo]), int(offsets[hi])
        if end - start <= PIECE_BYTES:
            h, at = _hash_slice(data[start:end], offsets[lo:hi] - start)
            yield lo, hi, h, np.searchsorted(offsets[lo + 1:hi + 1] - start, at, side="right") + lo
            continue
        parts = []
        while start < end:  # one long row, cut where no word is cut
            stop = min(start + PIECE_BYTES, end)
            if stop < end:
                gaps = np.flatnonzero(~IS_WORD[data[start:stop]])
                stop = start + int(gaps[-1]) + 1 if len(gaps) else stop
            parts.append(_hash_slice(data[start:stop], np.zeros(1, np.int64))[0])
            start = stop
        h = np.concatenate(parts)
        yield lo, hi, h, np.full(len(h), lo, np.int64)
