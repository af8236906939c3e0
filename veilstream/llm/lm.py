"""Stupid-backoff scores of documents under the trigram model of the whole corpus.

A word's score after two others is c(three) / c(the two with any next word) where the three occur, else BACKOFF times its
score after one: c(two) / c(the first with any next word) where the two occur, else BACKOFF * c(word) / N. A text's
second word begins with the pair, its first with c(word) / N. The scored documents are the corpus itself, so an occurrence
does not count for itself: `own` is taken off the counts of three, two and what they follow (own = 0 scores with plain
counts, where nothing would ever be backed off from). A document's score is the sum of the logarithms, each in millionths, so
sums don't depend on their order. Counts cover every row and every n-gram.

Documents become blocks of about CHUNK words, written once. Each block's distinct n-grams with their counts there go to the
count table's partition of their hash, as sorted keys packed in one row a partition; so a frequent n-gram is one key a block,
however often it occurs. The partition adds up, and answers each block with the totals in the order of its keys. Blocks and their
answers meet in the end and give sums for their documents. Threes go first, then pairs and words, each step written out
before the next so that its shuffle files can go.

Rows of one doc_id are scored as one document; rows without doc_id too, and give one row. Null texts and texts without
words have score 0 and no tokens. An empty table gives no rows. Only doc_id and text are read. Different n-grams share a 64-bit
key with a chance of 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstream.llm.store import Store
from veilstream.llm.textnum import mix, slices, word_hashes

BACKOFF = 0.4
CHUNK = 400_000  # words of a block
PER_BUCKET, LEAST_BUCKETS = 800_000, 32
ROWS = "bucket int, chunk long, kind int, payload binary"


def _log(x: np.ndarray | float) -> np.ndarray:
    return np.rint(np.log(x) * 1e6).astype(np.int64)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0x9FB21C651E98DF25) + b)


def _three(pair: np.ndarray, c: np.ndarray) -> np.ndarray:
    return mix(pair * np.uint64(0xD1B54A32D192ED03) + c)


def _pack(*arrays: np.ndarray) -> bytes:
    """The arrays' types and lengths, and their bytes by place: all first bytes, then all second ones."""
    head = np.array([(len(a), a.dtype.itemsize) for a in arrays], np.int64).tobytes()
    planes = (np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(planes))


def _unpack(data: bytes, n: int) -> list[np.ndarray]:
    """n arrays of unsigned integers."""
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 16 * n, []
    for size, width in np.frombuffer(raw, np.int64, 2 * n).reshape(-1, 2).tolist():
        planes = np.frombuffer(raw, np.uint8, size * width, at).reshape(width, size)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").ravel())
        at += size * width
    return out


def _small(x: np.ndarray) -> np.ndarray:
    """x in the fewest bytes that hold its largest."""
    most = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


@dataclass
class Words:
    """The words of some rows as hashes."""

    ids: np.ndarray  # doc_id of each row
    known: np.ndarray  # whether it has one
    h: np.ndarray
    first: np.ndarray  # first word of each row, and the number of words

    def packed(self) -> bytes:
        distinct, place = np.unique(self.h, return_inverse=True)
        return _pack(
            self.ids.view(np.uint64),
            self.known.view(np.uint8),
            _small(np.diff(self.first)),
            np.diff(distinct, prepend=np.uint64(0)),
            _small(place),
        )

    @staticmethod
    def unpacked(data: bytes) -> Words:
        ids, known, sizes, gaps, place = _unpack(data, 5)
        return Words(
            ids.view(np.int64),
            known.view(bool),
            np.cumsum(gaps.astype(np.uint64), dtype=np.uint64)[place],
            np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]),
        )

    def __post_init__(self) -> None:
        before = np.full(len(self.h) + 2, 2, np.int8)  # the number of words before each one in its row, up to 2
        before[self.first + 1] = 1
        before[self.first] = 0
        self.second, self.third = np.flatnonzero(before[: len(self.h)] > 0), np.flatnonzero(before[: len(self.h)] > 1)
        self.followed = before[1 : len(self.h) + 1] > 0  # by a word of the row
        self.followed[-1:] = False
        self.pair = np.zeros(len(self.h), np.uint64)  # of each word and the one before
        self.pair[self.second] = _pair(self.h[self.second - 1], self.h[self.second])

    def keys(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of all words (0), pairs (1) or threes (2), and the places of their last words."""
        if kind == 2:
            return _three(self.pair[self.third - 1], self.h[self.third]), self.third
        return (self.pair[self.second], self.second) if kind else (self.h, np.arange(len(self.h)))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    parts, n = [], 0

    def whole() -> Words:
        ids, known, words, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
        return Words(ids, known, words, np.concatenate([[0], np.cumsum(sizes)]))

    for batch in batches:
        ids, known = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), batch.column(0).is_valid().to_numpy(zero_copy_only=False)
        for at, raw, offsets in slices(batch.column(1)):
            h, first = word_hashes(raw, offsets)
            rows = slice(at, at + len(offsets) - 1)
            parts.append((ids[rows], known[rows], h, np.diff(first)))
            n += len(h)
            if n >= CHUNK:
                yield whole()
                parts, n = [], 0
    if parts:
        yield whole()


def blocks(docs: DataFrame) -> DataFrame:
    """chunk, words, payload: the documents' words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for i, w in enumerate(_blocks(batches)):
            yield pa.RecordBatch.from_arrays(
                [pa.array([first + i]), pa.array([len(w.h)]), pa.array([w.packed()], pa.binary())],
                ["chunk", "words", "payload"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "chunk long, words long, payload binary")


def _table(rows: list[tuple]) -> pa.Table:
    kinds = [("bucket", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()), ("payload", pa.binary())]
    return pa.table({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(kinds)})


def counts(words: DataFrame, kinds: list[int], buckets: int) -> DataFrame:
    """Answers to blocks (bucket, chunk, kind, payload): the totals of their distinct n-grams of kinds, of those in a bucket in the order
    of keys; how often they occur, and of words and pairs how often they are followed."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, payload in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                w, rows = Words.unpacked(payload.as_py()), []
                for kind in kinds:
                    key, last = w.keys(kind)
                    if kind == 2:
                        distinct, n = np.unique(key, return_counts=True)
                        sums = [n]
                    else:
                        distinct, of, n = np.unique(key, return_inverse=True, return_counts=True)
                        sums = [n, np.bincount(of[w.followed[last]], minlength=len(distinct))]
                    bucket = ((distinct >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
                    ends = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
                    for b in np.flatnonzero(np.diff(ends)):
                        at = slice(ends[b], ends[b + 1])
                        rows.append((int(b), chunk, kind, _pack(np.diff(distinct[at], prepend=np.uint64(0)), *(_small(x[at]) for x in sums))))
                yield from _table(rows).to_batches(max_chunksize=256)

    def answer(table: pa.Table) -> pa.Table:
        bucket, rows = table["bucket"][0].as_py(), []
        for kind in kinds:
            mine = table.filter(pa.compute.equal(table["kind"], kind))
            if not mine.num_rows:
                continue
            got = [_unpack(p.as_py(), 2 if kind == 2 else 3) for p in mine["payload"]]
            keys = [np.cumsum(g[0], dtype=np.uint64) for g in got]
            _, of = np.unique(np.concatenate(keys), return_inverse=True)
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
            totals = [np.bincount(of, np.concatenate([g[i] for g in got]).astype(float)).astype(np.int64)[of] for i in range(1, len(got[0]))]
            for i, chunk in enumerate(mine["chunk"].to_pylist()):
                rows.append((bucket, chunk, kind, _pack(*(_small(t[ends[i] : ends[i + 1]]) for t in totals))))
        return _table(rows)

    # as many partitions as buckets, whatever the session's number of shuffle partitions
    return words.mapInArrow(ask, ROWS).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(answer, ROWS)


def score(docs: DataFrame, own: int = 1) -> DataFrame:
    """doc_id, n_tokens, n_seen (tokens whose three occur elsewhere), score (sum of logarithms)."""
    store = Store(docs.sparkSession, "lm")
    words = store.keep(blocks(docs), "words")
    n, chunks = words.agg(F.coalesce(F.sum("words"), F.lit(0)), F.count("*")).first()
    buckets = max(LEAST_BUCKETS, -(-n // PER_BUCKET))
    threes = store.keep(counts(words.select("chunk", "words", "payload"), [2], buckets), "threes")
    store.release()
    others = store.keep(counts(words.select("chunk", "words", "payload"), [0, 1], buckets), "others")
    store.release()

    def total(table: pa.Table) -> pa.Table:
        kinds, at = table["kind"].to_numpy(), table["bucket"].to_numpy()
        w = Words.unpacked(table["payload"][int(np.flatnonzero(kinds < 0)[0])].as_py())
        found = []
        for kind in range(3):
            own_rows = np.flatnonzero(kinds == kind)
            parts = [_unpack(table["payload"][int(i)].as_py(), 1 if kind == 2 else 2) for i in own_rows[np.argsort(at[own_rows])]]
            _, of = np.unique(w.keys(kind)[0], return_inverse=True)
            found.append(
                [
                    np.concatenate(x).astype(np.int64)[of] if len(of) else of for x in (
                        zip(*parts, strict=True) if parts else [of] * (1 if kind == 2 else 2)
                    )
                ]
            )
        (c1, f1), (c2, f2), (c3,) = found
        value, seen = np.zeros(len(w.h), np.int64), np.zeros(len(w.h), bool)
        pairs, first = np.zeros((len(w.h), 2), np.int64), np.ones(len(w.h), bool)
        pairs[w.second], first[w.second] = np.column_stack([c2, f2]), False
        less = lambda c, f: _log(np.maximum(c - own, 1)) - _log(np.maximum(f - own, 1))
        two = w.second[c2 > own]
        back = np.setdiff1d(w.second, two, assume_unique=True)
        value[two] = less(pairs[two, 0], f1[two - 1])
        alone = _log(np.maximum(c1 - own + 1, 1)) - int(_log(float(max(n - own + 1, 1))))
        value[first] = alone[first]
        value[back] = alone[back] + int(_log(BACKOFF))
        three = c3 > own
        value[w.third[~three]] += int(_log(BACKOFF))
        seen[w.third[three]] = True
        value[w.third[three]] = less(c3[three], pairs[w.third[three] - 1, 1])
        sums = [np.concatenate([[0], np.cumsum(x)])[w.first] for x in (value, seen.astype(np.int64))]
        return pa.table(
            {"doc_id": pa.array(w.ids, mask=~w.known), "n_tokens": np.diff(w.first), "n_seen": np.diff(sums[1]), "score": np.diff(sums[0])}
        )

    asked = words.select(F.lit(-1).alias("bucket"), "chunk", F.lit(-1).alias("kind"), "payload")
    met = threes.union(others).union(asked).repartition(max(chunks, 1), "chunk")
    each = met.groupBy("chunk").applyInArrow(total, "doc_id long, n_tokens long, n_seen long, score long")
    sums = each.groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in ("n_tokens", "n_seen", "score")])
    return sums.withColumn("score", F.col("score") / F.lit(1e6))


SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), t AS (
  SELECT doc_id, unnest(w) AS c, unnest(list_prepend(NULL, w[1:len(w) - 1])) AS b, unnest(list_prepend(NULL, list_prepend(NULL, w))[1:len(w)]) AS a FROM w WHERE len(w) > 0
), c1 AS (SELECT c AS w, count(*) AS n FROM t GROUP BY c
), f1 AS (SELECT b, count(*) AS n FROM t WHERE b IS NOT NULL GROUP BY b
), c2 AS (SELECT b, c, count(*) AS n FROM t WHERE b IS NOT NULL GROUP BY b, c
), f2 AS (SELECT a, b, count(*) AS n FROM t WHERE a IS NOT NULL GROUP BY a, b
), c3 AS (SELECT a, b, c, count(*) AS n FROM t WHERE a IS NOT NULL GROUP BY a, b, c
), n AS (SELECT round(ln(count(*)) * 1e6)::BIGINT AS n, round(ln(0.4) * 1e6)::BIGINT AS off FROM t
), s AS (
  SELECT t.doc_id, coalesce(c3.n > 1, false) AS seen, (
    CASE WHEN c3.n > 1 THEN round(ln(c3.n - 1) * 1e6) - round(ln(f2.n - 1) * 1e6)
      ELSE CASE WHEN t.a IS NULL THEN 0 ELSE n.off END + CASE WHEN c2.n > 1 THEN round(ln(c2.n - 1) * 1e6) - round(ln(f1.n - 1) * 1e6)
        ELSE CASE WHEN t.b IS NULL THEN 0 ELSE n.off END + round(ln(c1.n) * 1e6) - n.n END END)::BIGINT AS v
  FROM t CROSS JOIN n JOIN c1 ON c1.w = t.c LEFT JOIN f1 ON f1.b = t.b LEFT JOIN c2 ON c2.b = t.b AND c2.c = t.c
    LEFT JOIN f2 ON f2.a = t.a AND f2.b = t.b LEFT JOIN c3 ON c3.a = t.a AND c3.b = t.b AND c3.c = t.c
), d AS (SELECT doc_id, count(*) AS n_tokens, sum(seen::INT)::BIGINT AS n_seen, sum(v)::BIGINT AS v FROM s GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n_tokens, 0)::BIGINT AS n_tokens, coalesce(n_seen, 0)::BIGINT AS n_seen, coalesce(v, 0) / 1e6::DOUBLE AS score FROM documents LEFT JOIN d USING (doc_id)
"""
