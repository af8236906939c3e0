"""Words and their hashes, computed over whole Arrow string buffers with numpy.

Word: a maximal run of bytes outside space and 0x09-0x0D, after lower-casing A-Z. UTF-8 keeps every byte of a
multi-byte character above 0x7F, so byte runs and character runs are the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
LONG = 64

_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds); bijective."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: Odd constants of the word hash's chains; masks that keep the first bytes of a little-endian word.
_CHAIN = np.array([0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0xABC98388FB8FAC03, 0x8CB92BA72F3D8DD7], np.uint64)
_upto = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_byte_value = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_base = 0xC2B2AE3D27D4EB4F
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^i and B^-i modulo 2^64 for i < n: for sums that are compared with the bytes themselves afterwards."""
    if not _tables or len(_tables["up"]) < n:
        size = max(n, SLICE_BYTES + 4096)
        for name, base in (("up", _base), ("down", pow(_base, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _tables[name] = np.cumprod(steps)
    if n > 4 * SLICE_BYTES:  # a single huge text: don't keep the large tables
        up, down = _tables.pop("up"), _tables.pop("down")
        return up[:n], down[:n]
    return _tables["up"][:n], _tables["down"][:n]


def slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets into them) for runs of rows of about SLICE_BYTES; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, np.int64)[column.offset : column.offset + n + 1]
    if column.null_count:
        column = column.fill_null("")
        _, ends, data = column.buffers()
        at = np.frombuffer(ends, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + SLICE_BYTES, "right")) - 1)
        yield first, raw[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, word starts, word ends, and for each row the index of its first word (one more at the end)."""
    low = _lower[raw]
    gap = _space[raw]
    start, end = ~gap, ~gap
    if len(raw):
        edge = np.zeros(len(raw) + 1, bool)
        edge[at] = True
        start[1:] &= gap[:-1] | edge[1:-1]
        end[:-1] &= gap[1:] | edge[1:-1]
    s = np.flatnonzero(start)
    return low, s, np.flatnonzero(end) + 1, np.searchsorted(s, at)


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and each row's first word.

    Words go through two 64-bit chains, eight bytes a step and neither linear, that are folded at the end; those of over
    LONG bytes through BLAKE2b. Different words share a hash with a chance of about 2^-64, whatever their form."""
    low, s, e, rows = words(raw, at)
    if not len(s):
        return np.zeros(0, np.uint64), rows
    n = e - s
    eight = np.ndarray((len(low) + 1,), np.uint64, np.concatenate([low, np.zeros(8, np.uint8)]), strides=(1,))
    a = mix(n.astype(np.uint64) * _CHAIN[0] + (eight[s] & _upto[np.minimum(n, 8)]))
    more, j = np.flatnonzero((n > 8) & (n <= LONG)), 8
    two = a[more] ^ _CHAIN[1]
    back = np.arange(len(more))
    while len(back):
        i = more[back]
        lane = eight[s[i] + j] & _upto[np.minimum(n[i] - j, 8)]
        a[i] = mix(a[i] * _CHAIN[2] + lane)
        two[back] = mix((two[back] ^ lane) * _CHAIN[3] + np.uint64(j))
        j += 8
        back = back[n[more[back]] > j]
    a[more] = mix(a[more] ^ (two * _CHAIN[0]))
    for i in np.flatnonzero(n > LONG):
        a[i] = int.from_bytes(hashlib.blake2b(low[s[i] : e[i]].tobytes(), digest_size=8).digest(), "little")
    return a, rows


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the distinct k-word shingles of one row's word hashes, sorted; fewer than k words make one."""
    if not len(h):
        return h
    take = min(k, len(h))
    n = len(h) - take + 1
    out = np.full(n, take, np.uint64)
    for j in range(take):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + h[j : j + n])
    return np.unique(out)
