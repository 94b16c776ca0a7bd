"""Column-wise text helpers: whole Arrow string columns as numpy byte arrays.

Every function works on the UTF-8 bytes of many texts at once. Texts are taken in groups of about
``GROUP_BYTES`` bytes, so memory follows the group (or the longest single text), not the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

GROUP_BYTES = 1 << 20


def text_groups(column: pa.Array, group_bytes: int = GROUP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield ``(first_row, end_row, bytes, offsets)``: the texts first..end-1 end to end, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:                       # a null slot may span bytes: take lengths, not differences
        valid = column.is_valid().to_numpy(zero_copy_only=False)
        lengths = np.where(valid, np.diff(offsets), 0)
        if (lengths != np.diff(offsets)).any():
            column = column.fill_null("")
            yield from text_groups(column, group_bytes)
            return
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + group_bytes, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, data[offsets[lo]:offsets[hi]], (offsets[lo:hi + 1] - offsets[lo])
        lo = hi


#: space and the controls 0x09-0x0D: the white space between words
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

LONG_SLICE = 512
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    if n:
        out[0] = 1
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


_POW: dict[int, np.ndarray] = {}
#: longest table of powers that is kept; a longer text makes its own
KEPT_POWERS = 2 << 20


def powers(base: int, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2^64; a short table is kept for the next call."""
    if n > KEPT_POWERS:
        return _powers(base, n)
    have = _POW.get(base)
    if have is None or len(have) < n:
        _POW[base] = have = _powers(base, max(n, 1 << 16))
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (public splitmix64 constants): spreads polynomial hashes over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``data[starts[i]:ends[i]]`` (bytes or code points): differences of one running polynomial sum."""
    n = len(data)
    inverse = pow(_BASE, -1, 1 << 64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n), out=sums[1:])
    h = mix((sums[ends] - sums[starts]) * powers(inverse, n + 1)[starts] + (ends - starts).astype(np.uint64))
    for i in np.flatnonzero(ends - starts > LONG_SLICE):     # a polynomial over many terms has known collisions
        h[i] = xxhash.xxh64_intdigest(data[starts[i]:ends[i]].tobytes())
    return h


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without white space; a text's end ends a run."""
    n = len(data)
    inside = ~SPACE[data]
    before = np.zeros(n + 1, bool)                            # the byte before belongs to a word of the same text
    before[1:] = inside
    before[offsets] = False
    after = np.zeros(n + 1, bool)
    after[:n] = inside
    after[offsets] = False
    return np.flatnonzero(inside & ~before[:n]), np.flatnonzero(inside & ~after[1:]) + 1


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``starts[i] .. starts[i] + lengths[i] - 1`` for every i, end to end."""
    total = int(lengths.sum())
    out = np.ones(total, np.int64)
    some = lengths > 0
    s, k = starts[some], lengths[some]
    if not len(s):
        return np.zeros(0, np.int64)
    at = np.cumsum(k) - k
    out[at[0]] = s[0]
    out[at[1:]] = s[1:] - (s[:-1] + k[:-1] - 1)
    return np.cumsum(out)


class IntTable:
    """Map from non-negative integers to integers in open-addressing arrays, looked up a column at a time."""

    MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray, values: np.ndarray, probes: int):
        self.keys, self.values, self.probes = keys, values, probes
        self.shift = np.uint64(64 - (len(keys).bit_length() - 1))
        self.last = len(keys) - 1

    @classmethod
    def build(cls, keys: np.ndarray, values: np.ndarray) -> IntTable:
        bits = max(4, int(4 * max(len(keys), 1)).bit_length())
        out = cls(np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64), 1)
        slot = out.slots(np.asarray(keys, np.int64))
        todo = np.arange(len(keys))
        while len(todo):                        # each round, one key takes each free slot; the rest move on
            free = todo[out.keys[slot[todo]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            placed = free[first]
            out.keys[slot[placed]] = keys[placed]
            out.values[slot[placed]] = values[placed]
            todo = np.setdiff1d(todo, placed, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & out.last
            out.probes += bool(len(todo))
        return out

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * self.MULTIPLIER) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray, missing: int = -1) -> np.ndarray:
        slot = self.slots(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], missing)
        todo = np.flatnonzero((found != keys) & (found >= 0))
        for _ in range(self.probes):
            if not len(todo):
                break
            slot_t = (slot[todo] + 1) & self.last
            slot[todo] = slot_t
            found = self.keys[slot_t]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[slot_t[hit]]
            todo = todo[~hit & (found >= 0)]
        return out
