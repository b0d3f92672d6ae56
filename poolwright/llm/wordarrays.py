"""Words and word windows of many texts at once, as numpy arrays.

A word is `[^\\x20\\x09-\\x0D]+`. Words and windows are named by 64-bit polynomial hashes read off prefix sums, so a
window of any length costs the same, and no Python object is made for a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_P, _Q = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_POWERS: dict[int, np.ndarray] = {}
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            have = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 1 << 16), base, np.uint64)]), dtype=np.uint64)
        _POWERS[base] = have
    return have[:n]


def forget_powers() -> None:
    """Drops the tables of powers, which would otherwise travel with every function that uses them."""
    _POWERS.clear()


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit value over all bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(32))


def ranges_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _P) -> np.ndarray:
    """A hash of values[start:end] for each pair, from one prefix sum; `base` is odd, so it has an inverse."""
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _powers(base, n), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _powers(pow(base, -1, 2**64), n + 1)[starts])


class Words:
    """The words of a string column: `hash` by word, `first` has the index of each text's first word (one more at the end)."""

    def __init__(self, column: pa.Array, separators: np.ndarray = SEPARATORS, fold: np.ndarray | None = None):
        self.data, self.offsets = raw(column)
        data = self.data if fold is None else fold[self.data]
        self.folded = data
        n = len(data)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = ~separators[data]
        cut = np.zeros(n + 1, bool)
        cut[self.offsets] = True
        self.starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
        self.ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.doc = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        self._hash: np.ndarray | None = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = ranges_hash(_BYTE[self.folded], self.starts, self.ends)
        return self._hash

    def windows(self, k: int, base: int = _Q) -> tuple[np.ndarray, np.ndarray]:
        """The hash of the k words from each position on, and whether they lie in one text."""
        n = len(self.starts)
        at = np.arange(n)
        fits = at + k <= self.first[1:][self.doc] if n else np.zeros(0, bool)
        out = np.zeros(n, np.uint64)
        here = at[fits]
        out[here] = ranges_hash(self.hash, here, here + k, base)
        return out, fits


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, null as empty, and where each text starts (one more at the end)."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return data, (offsets - offsets[0] if len(column) else np.zeros(1, np.int64))


def sliding(values: np.ndarray, width: int, choose: np.ufunc) -> np.ndarray:
    """choose.reduce(values[i:i + width]) for each i that has a whole window (choose: np.minimum or np.maximum)."""
    done, out = 1, values
    while done * 2 <= width:
        out = choose(out[: len(out) - done], out[done:]) if len(out) > done else out[:0]
        done *= 2
    rest = width - done
    return choose(out[: len(out) - rest], out[rest:]) if rest and len(out) > rest else out if not rest else out[:0]
