"""Document quality by a linear-chain conditional random field over lines.

Every line gets shares of character classes, word shapes and repetition, its own and its two neighbours'. The field
labels lines bad or good; training takes each line's label from its document. Forward-backward marginals, weighted by
line length, make a document's share of good text, and a logistic curve fitted on the training documents turns that
share into the score.

At most `train_docs` labelled documents (smallest hash of doc_id first) are fitted on, with all their lines. They have at
most `train_lines` lines together: a document longer than what is left of these is skipped whole and the next is tried,
but a label none of whose documents fits gives its shortest. Every line of every text is scored. Null texts and texts without characters get the score of an empty document,
the curve at the mean share. An id with several labels takes its largest. Repeated rows are scored each. With no labels
the score is 1. Equal scores stay equal; other columns are ignored. An empty table gives no rows. Labels, lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilstream.llm.crf import Adam, posterior, transition_counts, true_transitions
from veilstream.llm.textnum import slices, word_hashes, words

TRAIN_DOCS, TRAIN_LINES = 6000, 384_000
SPARE = 4
WIDTH = 16

_class = np.full(256, 9, np.uint8)  # 9: other
_class[65:91] = 0
_class[97:123] = 1
_class[48:58] = 2
_class[[9, 11, 12, 13, 32]] = 3
_class[[ord(c) for c in ".,;:?'\"()-"]] = 4
_class[ord("!")] = 5
_class[[ord(c) for c in "*%$#&@^~=+<>{}[]\\/_`"]] = 6
_class[ord("|")] = 7
_class[128:] = 8


def lines(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (n, WIDTH) of all lines with characters, their lengths, and each row's first line (one more at the end)."""
    cut = np.flatnonzero(raw == 10)
    start = np.unique(np.concatenate([at[:-1], cut + 1]))
    start = start[start < len(raw)]
    if not len(start):
        return np.zeros((0, WIDTH)), np.zeros(0), np.zeros(len(at), np.int64)
    kind = _class[raw]
    sums = np.zeros((10, len(raw) + 1), np.int32)
    for c in range(10):
        np.cumsum((kind == c) & (raw != 10), out=sums[c, 1:])
    end = np.append(start[1:], len(raw))
    counts = (sums[:, end] - sums[:, start]).T.astype(float)
    n = counts.sum(1)
    keep = n > 0
    start, end, counts, n = start[keep], end[keep], counts[keep], n[keep]
    low, s, e, first = words(raw, at)
    h, _ = word_hashes(raw, at)
    same = np.zeros(len(h) + 1, np.int32)
    if len(h) > 1:
        again = np.zeros(len(h), bool)
        again[1:] = h[1:] == h[:-1]
        again[2:] |= h[2:] == h[:-2]
        same[1:] = np.cumsum(again)
    w0, w1 = np.searchsorted(s, start), np.searchsorted(s, end)
    nw = np.maximum(w1 - w0, 1)
    letters = np.maximum(counts[:, 0] + counts[:, 1] + counts[:, 8], 1)
    x = np.column_stack(
        [
            counts / n[:, None],
            counts[:, 0] / letters,
            (same[w1] - same[w0]) / nw,
            np.minimum(nw, 40) / 40,
            np.minimum(n / nw, 20) / 20,
            (counts[:, 5] + counts[:, 6] + counts[:, 7]) / nw,
            np.ones(len(n)),
        ]
    )
    return x, n, np.searchsorted(start, at)


def neighbours(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Each line's features beside those of the lines before and after it in its row; zeros past the ends."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    edge = at[:-1][np.diff(at) > 0]
    before[edge] = 0
    after[at[1:][np.diff(at) > 0] - 1] = 0
    return np.concatenate([x, before, after], 1)


@dataclass
class Model:
    weights: np.ndarray  # (3 * WIDTH, 2)
    trans: np.ndarray  # (2, 2)
    curve: tuple[float, float]
    empty: float

    def shares(self, x: np.ndarray, n: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Length-weighted share of good text; nan for rows without lines."""
        if not len(x):
            return np.full(len(at) - 1, np.nan)
        good = posterior(neighbours(x, at) @ self.weights, at, self.trans)[0][:, 1]
        sums, sizes = np.concatenate([[0], np.cumsum(good * n)]), np.concatenate([[0], np.cumsum(n)])
        with np.errstate(invalid="ignore"):
            return (sums[at[1:]] - sums[at[:-1]]) / (sizes[at[1:]] - sizes[at[:-1]])

    def scores(self, x: np.ndarray, n: np.ndarray, at: np.ndarray) -> np.ndarray:
        share = np.nan_to_num(self.shares(x, n, at), nan=self.empty)
        return 1 / (1 + np.exp(-(self.curve[0] * share + self.curve[1])))


def fit(x: np.ndarray, n: np.ndarray, at: np.ndarray, y: np.ndarray, steps: int = 150) -> Model:
    """x, n: lines' features and lengths; at: first line of each document; y: the documents' labels."""
    of = np.repeat(y, np.diff(at))
    full, w, t, adam = neighbours(x, at), np.zeros((3 * WIDTH, 2)), np.zeros((2, 2)), Adam(0.1)
    seen, hot = true_transitions(of, at, 2), np.eye(2)[of]
    for _ in range(steps):
        emit = full @ w
        p, a, b = posterior(emit, at, t)
        w2 = adam.step("w", w, full.T @ (p - hot) / len(of) + 1e-4 * w)
        t = np.clip(adam.step("t", t, (transition_counts(a, b, emit, at, t) - seen) / len(of) + 1e-3 * t), -2, 2)
        w = w2
        adam.k += 1
    model = Model(w, t, (1.0, 0.0), 0.5)
    share = model.shares(x, n, at)
    model.empty = float(np.nanmean(share))
    share = np.nan_to_num(share, nan=model.empty)
    a = b = 0.0
    for _ in range(50):  # Newton steps of a logistic regression with a small ridge
        q = 1 / (1 + np.exp(-(a * share + b)))
        g = np.array([((q - y) * share).sum() + 0.1 * a, (q - y).sum() + 0.01 * b])
        v = q * (1 - q) + 1e-9
        h = np.array([[(v * share * share).sum() + 0.1, (v * share).sum()], [(v * share).sum(), v.sum() + 0.01]])
        da, db = np.linalg.solve(h, g)
        a, b = a - da, b - db
    model.curve = (float(a), float(b))
    return model


def remainder(doc_id: Column, modulus: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def choose(sizes: list[tuple], total: int) -> list[tuple]:
    """(doc_id, label) of those of (doc_id, label, lines), in their order, to fit on."""
    chosen = []
    for doc, label, n in sizes:
        if n <= total:
            chosen.append((doc, label))
            total -= n
    for label in sorted({x[1] for x in sizes} - {x[1] for x in chosen}):
        chosen.append(min((x for x in sizes if x[1] == label), key=lambda x: x[2])[:2])
    return chosen


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_lines: int = TRAIN_LINES) -> Model | None:
    usable = labels.where(
        F.col("quality").isin(0, 1) & (remainder(F.col("doc_id"), 5) != 0)
    ).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    # only documents of small hashes are put in order: some SPARE times as many as are taken
    n = usable.count()
    small = F.xxhash64("doc_id") <= F.lit(min(int(2**64 * (SPARE * (train_docs + 16) / max(n, 1))), 2**64 - 1) - 2**63)
    chosen = usable.where(small).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    n_lines = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x != ""))
    sizes = docs.select("doc_id", n_lines.alias("n")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.sum("n").alias("n"))
    sizes = [tuple(r) for r in sizes.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]  # train_docs rows at most
    if not sizes:
        return None
    fitted = docs.sparkSession.createDataFrame(choose(sizes, train_lines), f"doc_id {labels.schema['doc_id'].dataType.simpleString()}, quality int")
    rows = docs.select("doc_id", "text").join(F.broadcast(fitted), "doc_id").select("text", "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, raw, at in slices(batch.column(0)):
                x, n, first = lines(raw, at)
                for i in range(len(at) - 1):
                    own = slice(first[i], first[i + 1])
                    out.append((x[own].astype(np.float32).tobytes(), n[own].astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.binary()), batch.column(1)],
                ["x", "n", "quality"],
            )

    got = rows.mapInArrow(run, "x binary, n binary, quality int").collect()
    if not got:
        return None
    got = sorted(got, key=lambda r: (bytes(r.x), r.quality))
    x = np.concatenate([np.frombuffer(r.x, np.float32).reshape(-1, WIDTH) for r in got]).astype(float)
    n = np.concatenate([np.frombuffer(r.n, np.float32) for r in got]).astype(float)
    at = np.concatenate([[0], np.cumsum([len(r.n) // 4 for r in got])])
    return fit(x, n, at, np.array([r.quality for r in got])) if len(x) else None


def score(docs: DataFrame, model: Model | None, name: str = "score") -> DataFrame:
    """docs with the score in a column `name`, instead of any of that name; every other column stays."""
    kept = docs.drop(name)
    schema = T.StructType([*kept.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, raw, at in slices(batch.column("text")):
                out.append(model.scores(*lines(raw, at)) if model else np.ones(len(at) - 1))
            yield batch.append_column(name, pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64()))

    return kept.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    s = score(docs.select("doc_id", "text"), train(docs, labels))
    return s.select(
        "doc_id",
        (remainder(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= least).cast("int").alias("predicted"),
    )
