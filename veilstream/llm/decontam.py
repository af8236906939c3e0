"""Benchmark decontamination by q-gram filtering and banded alignment.

Texts are normalised: A-Z lower-cased, every run of white space one space. A benchmark passage counts as found where some
stretch of a document matches a window of the passage (the whole passage, or any `window` bytes of a longer one)
with at most `errors` edits per hundred bytes. By the q-gram lemma, a window of w bytes with e edits keeps at least
w + 1 - q - q*e of its q-grams in order, on diagonals that differ by e at most; so the shared q-grams are counted in
overlapping bands of diagonals, in overlapping stretches of the passage, and only bands that reach that count are
verified, by alignment within the band.

The q-grams of the benchmark are broadcast while they fit `broadcast_bytes`; a larger benchmark is cut into parts of that
size, each read over all documents. Documents are scanned whole, in one narrow pass per part. Passages shorter than
`least` normalised bytes count where they stand exactly, between word boundaries (within a few edits they would match by
chance); they are found by hashes of the stretches of their length. Null and empty texts match nothing, items without id or
text are left out; repeated rows of documents are each matched, equal rows of the benchmark once; of several places of an
item in a document the first found counts. Other columns are ignored, or stay in clean(). An empty table of either gives no
matches.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstream.llm.textnum import _byte_value, _lower, _powers, _space, slices

Q = 12
WINDOW, LEAST, ERRORS = 160, 60, 5
BROADCAST_BYTES = 4 << 20
#: Shared q-grams looked at together.
HITS = 2_000_000

_word = np.zeros(256, bool)
_word[48:58] = _word[65:91] = _word[97:123] = True
_word[128:] = True


def normalise(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with single spaces, and row offsets into them."""
    low = np.where(_space[raw], 32, _lower[raw]).astype(np.uint8)
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] != 32) | (low[:-1] != 32)
    keep[at[:-1][at[:-1] < len(low)]] = True
    counts = np.concatenate([[0], np.cumsum(keep)])
    return low[keep], counts[at]


def grams(low: np.ndarray) -> np.ndarray:
    """A 64-bit value of the Q bytes from each position."""
    n = len(low) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    b = low.astype(np.uint64)
    two = b[:-1] | b[1:] << np.uint64(8)
    four = two[:-2] | two[2:] << np.uint64(16)
    a = four[:n] | four[4 : 4 + n] << np.uint64(32)
    x = a * np.uint64(0x9E3779B97F4A7C15) ^ (four[8 : 8 + n] * np.uint64(0xC2B2AE3D27D4EB4F))
    x ^= x >> np.uint64(32)
    return x * np.uint64(0xD6E8FEB86659FD93)


def runs(low: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the first and last q-gram of each stretch of one repeated byte within a row."""
    n = len(low) - Q + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    equal = np.concatenate([[0], np.cumsum(low[1:] == low[:-1])])
    where = np.flatnonzero(equal[Q - 1 :] - equal[:n] == Q - 1)
    row = np.searchsorted(at, where, "right") - 1
    inside = where + Q <= at[row + 1]
    where, row = where[inside], row[inside]
    cut = np.flatnonzero((np.diff(where) != 1) | (np.diff(row) != 0))
    edges = np.concatenate([[0], cut + 1, [len(where)]])
    return (where[edges[:-1]], where[edges[1:] - 1]) if len(where) else (where, where)


def _spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, .. of n each."""
    n = np.maximum(n, 0)
    return np.repeat(start - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum())


def prefixes(low: np.ndarray) -> np.ndarray:
    """Sums modulo 2^64 that give the hash of any stretch: see hashed()."""
    sums = np.zeros(len(low) + 1, np.uint64)
    np.cumsum(_byte_value[low] * _powers(len(low) + 1)[0][:-1], out=sums[1:])
    return sums


def hashed(sums: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    return (sums[start + size] - sums[start]) * _powers(len(sums))[1][start]


class Index:
    """The q-grams of some passages, and a bitmap that tells most others apart; of short ones, the hashes by length.

    The q-grams of a run of one byte are all the same, and would meet all of such a run elsewhere. Runs meet as wholes, with their
    begins and their ends on one diagonal: an alignment of few edits that holds no more of one run than of the other has one of these,
    and one that holds parts of both alone has either."""

    def __init__(self, items: list[tuple[int, bytes]], least: int = Q):
        self.items = items
        keys, item, pos, same = [], [], [], [(np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))]
        short: dict[int, list[tuple[int, int]]] = {}
        for k, (_, text) in enumerate(items):
            if len(text) < max(least, Q):
                own = hashed(prefixes(np.frombuffer(text, np.uint8)), np.array([0]), len(text))
                short.setdefault(len(text), []).append((int(own[0]), k))
                continue
            low = np.frombuffer(text, np.uint8)
            g, (first, last) = grams(low), runs(low, np.array([0, len(low)]))
            same.append((g[first], np.full(len(first), k), first, last))
            plain = np.ones(len(g), bool)
            plain[_spread(first, last - first + 1)] = False
            keys.append(g[plain])
            item.append(np.full(plain.sum(), k))
            pos.append(np.flatnonzero(plain))
        keys_ = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(keys_, kind="stable")
        self.keys = keys_[order]
        self.item = np.concatenate(item)[order] if item else np.zeros(0, int)
        self.pos = np.concatenate(pos)[order] if pos else np.zeros(0, int)
        self.short = {n: (np.array([h for h, _ in sorted(x)], np.uint64), np.array([k for _, k in sorted(x)])) for n, x in short.items()}
        # stretches of one repeated byte: q-gram, item, positions of the first and the last
        self.runs = [np.concatenate(x) for x in zip(*same, strict=True)]
        order = np.argsort(self.runs[0], kind="stable")
        self.runs = [x[order] for x in self.runs]
        self.bitmap = np.zeros(1 << 20, bool)
        self.bitmap[self.keys >> np.uint64(44)] = True

    def counts(self, g: np.ndarray) -> np.ndarray:
        """How many places in the items have each q-gram."""
        n = np.zeros(len(g), np.int64)
        some = np.flatnonzero(self.bitmap[g >> np.uint64(44)])
        n[some] = np.searchsorted(self.keys, g[some], "right") - np.searchsorted(self.keys, g[some], "left")
        return n

    def meet(self, g: np.ndarray, first: np.ndarray, last: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As hits(), of the runs of g (first, last), for positions from begin to before end."""
        some = np.flatnonzero((first < end) & (last >= begin))
        value, item, a, b = self.runs
        lo, hi = np.searchsorted(value, g[first[some]], "left"), np.searchsorted(value, g[first[some]], "right")
        own, other = np.repeat(some, hi - lo), _spread(lo, hi - lo)
        s, t, a, b = first[own], last[own], a[other], b[other]
        parts = []
        for shift, low, high, keep in ((a - s, s, np.minimum(t, s + b - a), None), (b - t, np.maximum(s, t - b + a), t, t - s != b - a)):
            low, high = np.maximum(low, begin), np.minimum(high, end - 1)
            n = np.maximum(high - low + 1, 0) if keep is None else np.where(keep, np.maximum(high - low + 1, 0), 0)
            pos = _spread(low, n)
            parts.append((pos, np.repeat(item[other], n), pos + np.repeat(shift, n)))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def hits(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position in g, item, position in item) of every shared q-gram but those of runs."""
        some = np.flatnonzero(self.bitmap[g >> np.uint64(44)])
        lo, hi = np.searchsorted(self.keys, g[some], "left"), np.searchsorted(self.keys, g[some], "right")
        n = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum())
        return np.repeat(some, n), self.item[at], self.pos[at]


def edits(passage: np.ndarray, text: np.ndarray, limit: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the stretch of text nearest to the passage, if within the limit. Sellers' alignment; text is
    the passage's band, so it is longer by 2*limit at most beyond its slack."""
    n = len(text)
    cost, start = np.zeros(n + 1, np.int32), np.arange(n + 1)
    ramp = np.arange(n + 1)
    for i, c in enumerate(passage, 1):
        diagonal = cost[:-1] + (text != c)
        up = cost[1:] + 1
        best = np.empty(n + 1, np.int32)
        from_ = np.empty(n + 1, start.dtype)
        best[0], from_[0] = i, 0
        take = diagonal <= up
        best[1:] = np.where(take, diagonal, up)
        from_[1:] = np.where(take, start[:-1], start[1:])
        key = (best - ramp) * (1 << 20) + ramp  # leftward steps: a running minimum of best - column
        low = np.minimum.accumulate(key)
        src = low & ((1 << 20) - 1)
        cost, start = best[src] + (ramp - src).astype(np.int32), from_[src]
        if cost.min() > limit:
            return None
    end = int(cost.argmin())
    return (int(cost[end]), int(start[end]), end) if cost[end] <= limit else None


def exact(index: Index, low: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """As find(), for short passages."""
    if not index.short or not len(low):
        return []
    edge = np.ones(len(low) + 1, bool)  # no word goes on across it
    edge[1:-1] = ~(_word[low[:-1]] & _word[low[1:]])
    edge[at] = True
    starts = np.flatnonzero(edge[:-1] & (low != 32))
    row = np.searchsorted(at, starts, "right") - 1
    sums, found = prefixes(low), {}
    for n, (keys, items) in index.short.items():
        some = starts + n <= at[row + 1]
        s, r = starts[some], row[some]
        s, r = s[edge[s + n]], r[edge[s + n]]
        h = hashed(sums, s, n)
        lo, hi = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
        for j in np.flatnonzero(hi > lo):
            for k in items[lo[j] : hi[j]]:
                key = int(r[j]), int(k)
                if key not in found and low[s[j] : s[j] + n].tobytes() == index.items[key[1]][1]:
                    found[key] = int(s[j] - at[r[j]])
    return [(r, k, start, start + len(index.items[k][1]), 0) for (r, k), start in found.items()]


def find(index: Index, low: np.ndarray, at: np.ndarray, window: int, errors: int) -> list[tuple[int, int, int, int, int]]:
    """(row, item, start, end, edits) of the first stretch of each row found for each item.

    Rows are gone through in stretches of text with about HITS shared q-grams, so that a long run of few characters in both
    sides needs no more memory; a stretch goes on into the next as far as a match can reach."""
    g = grams(low)
    if not len(g) or not len(index.keys) + len(index.runs[0]):
        return []
    first, last = runs(low, at) if len(index.runs[0]) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    counts = index.counts(g)
    if len(first):
        met = np.searchsorted(index.runs[0], g[first], "right") - np.searchsorted(index.runs[0], g[first], "left")
        counts[_spread(first, last - first + 1)] += np.repeat(2 * met, last - first + 1)
    sums = np.cumsum(counts)
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    begin, reach = 0, 2 * window + 4 * (window * errors // 100 + 1) + Q
    while begin < len(g):
        before = int(sums[begin - 1]) if begin else 0
        end = max(int(np.searchsorted(sums, before + HITS, "right")), begin + reach)
        shared = [x + begin if i == 0 else x for i, x in enumerate(index.hits(g[begin : end + reach]))]
        if len(first):
            shared = [np.concatenate(x) for x in zip(shared, index.meet(g, first, last, begin, end + reach), strict=True)]
        _find_in(index, low, at, shared, window, errors, found)
        begin = end
    return [(r, k, *v) for (r, k), v in found.items()]


def _find_in(
    index: Index,
    low: np.ndarray,
    at: np.ndarray,
    shared: list[np.ndarray],
    window: int,
    errors: int,
    found: dict[tuple[int, int], tuple[int, int, int]],
) -> None:
    """find() for shared q-grams (position, item, position in item), added to found."""
    pos, item, inner = shared
    row = np.searchsorted(at, pos, "right") - 1
    inside = pos + Q <= at[row + 1]
    pos, item, inner, row = pos[inside], item[inside], inner[inside], row[inside]
    if not len(pos):
        return
    length = np.array([len(t) for _, t in index.items])
    w = np.minimum(length, window)
    e = w * errors // 100
    need = np.maximum(w + 1 - Q - Q * e, 1)
    # overlapping bands of 2*wide diagonals, and overlapping stretches of 2*window passage positions
    diagonal, wide = pos - inner, np.maximum(e, 1)[item]
    ruled: set[tuple[int, int, int, int]] = set()
    for shift in (0, 1):
        band = (diagonal + shift * wide) // (2 * wide)
        for part in (0, 1):
            stretch = (inner + part * window) // (2 * window)
            order = np.lexsort((stretch, band, item, row))
            r, k, d, t = row[order], item[order], band[order], stretch[order]
            new = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (k[1:] != k[:-1]) | (d[1:] != d[:-1]) | (t[1:] != t[:-1])]))
            count = np.diff(np.append(new, len(r)))
            for b, c in zip(new[count >= need[k[new]]], count[count >= need[k[new]]], strict=True):
                key = int(r[b]), int(k[b])
                if key in found:
                    continue
                own = order[b : b + c]
                passage = np.frombuffer(index.items[key[1]][1], np.uint8)
                size, limit = int(w[key[1]]), int(e[key[1]])
                ins = np.sort(inner[own])
                # windows of the passage that hold enough of the shared q-grams
                i = 0
                while i < len(ins) and key not in found:
                    j = int(np.searchsorted(ins, ins[i] + size - Q, "right"))
                    if j - i < need[key[1]]:
                        i += 1
                        continue
                    first = int(min(ins[i], len(passage) - size))
                    mid = int(np.median(diagonal[own]))
                    lo, hi = max(int(at[key[0]]), first + mid - 3 * limit - 2), min(int(at[key[0] + 1]), first + mid + size + 3 * limit + 2)
                    tried = (*key, first, lo)
                    got = None if tried in ruled else edits(passage[first : first + size], low[lo:hi], limit)
                    ruled.add(tried)
                    if got:
                        found[key] = (lo + got[1] - int(at[key[0]]), lo + got[2] - int(at[key[0]]), got[0])
                    i += 1
                if key in found or len(passage) <= size:
                    continue
                # then every other window that holds enough; a window's edits are at most one from those of the window beside it
                mid = int(np.median(diagonal[own]))
                begins = np.arange(max(0, int(ins[0]) - size + Q), min(len(passage) - size, int(ins[-1])) + 1)
                held = np.searchsorted(ins, begins + size - Q, "right") - np.searchsorted(ins, begins, "left")
                begins, i = begins[held >= need[key[1]]], 0
                while i < len(begins):
                    first = int(begins[i])
                    lo, hi = max(int(at[key[0]]), first + mid - 3 * limit - 2), min(int(at[key[0] + 1]), first + mid + size + 3 * limit + 2)
                    n, s, t = edits(passage[first : first + size], low[lo:hi], size)
                    if n <= limit:
                        found[key] = (lo + s - int(at[key[0]]), lo + t - int(at[key[0]]), n)
                        break
                    i = int(np.searchsorted(begins, first + n - limit))


def _normal(text: str | None) -> bytes:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return normalise(raw, np.array([0, len(raw)]))[0].tobytes().strip()


def _parts(benchmark: DataFrame, broadcast_bytes: int) -> list[Broadcast]:
    """The normalised items (item_id, text) in broadcasts of about broadcast_bytes; the driver holds one part at a time."""
    items = benchmark.select("item_id", "text").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // broadcast_bytes)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(n, 1)))
    out = []
    for i in range(n):
        own = sorted((r.item_id, _normal(r.text)) for r in items.where(part == i).collect() if r.text and r.item_id is not None)
        own = [x for x in own if x[1]]
        if own:
            out.append(benchmark.sparkSession.sparkContext.broadcast(own))
    return out


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    errors: int = ERRORS,
    least: int = LEAST,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """doc_id, item_id, start, end (bytes of the normalised text), edits: one row for each document and passage found in it."""
    schema = "doc_id long, item_id long, start int, end int, edits int"

    def one(shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value, least)
            for batch in batches:
                ids, out = batch.column(0), []
                for first, raw, at in slices(batch.column(1)):
                    low, at2 = normalise(raw, at)
                    out += [
                        (
                            ids[first + r].as_py(),
                            index.items[k][0],
                            s,
                            e,
                            d,
                        ) for r, k, s, e, d in find(index, low, at2, window, errors) + exact(index, low, at2)
                    ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o[i] for o in out], pa.int64() if i < 2 else pa.int32()) for i in range(5)],
                    ["doc_id", "item_id", "start", "end", "edits"],
                )

        return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)

    parts = _parts(benchmark, broadcast_bytes)
    if not parts:
        return docs.sparkSession.createDataFrame([], schema)
    return functools.reduce(DataFrame.union, [one(p) for p in parts])


def clean(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    errors: int = ERRORS,
    least: int = LEAST,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """docs without the rows in which a passage was found; columns stay. One narrow pass a part, no join."""

    def without(rows: DataFrame, shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value, least)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for first, raw, at in slices(batch.column("text")):
                    low, at2 = normalise(raw, at)
                    keep[[first + x[0] for x in find(index, low, at2, window, errors) + exact(index, low, at2)]] = False
                yield batch.filter(pa.array(keep))

        return rows.mapInArrow(run, rows.schema)

    return functools.reduce(without, _parts(benchmark, broadcast_bytes), docs)
