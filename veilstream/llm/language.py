"""Language of code-switched text by a linear-chain conditional random field over words.

Every word gets character bigrams and trigrams (with its boundaries, so also affixes), its first three and last four
bytes, and itself as a lexicon entry; each indexes a table of weights per language. Learned transitions say how
often a text stays in a language from word to word. Forward-backward marginals, weighted by word length, are summed
over the text; the language with the largest share is predicted and the share is the score.

Fitted on are whole texts of documents with a language, every word of every text labelled. Languages share `train_docs`
documents and `train_chars` characters evenly, rarest first; what one leaves goes to the next. Within a language texts
come by smallest hash; one longer than what is left of the share is skipped, and the next is tried. A language of which
no text fits gives its shortest candidate, so each with a text that may be fitted on can be predicted. A text
that is null or has no letter gives `und` with score 0. Without training documents every text gives `und`. Ties go to the language that sorts first. Repeated
rows are each labelled. Other columns are ignored; an empty table gives no rows. lang, source and doc_id are never inputs of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstream.llm.crf import Adam, posterior, transition_counts, true_transitions
from veilstream.llm.quality import remainder
from veilstream.llm.textnum import slices, word_hashes, words

TRAIN_DOCS, TRAIN_CHARS = 1200, 1_800_000
#: So many times a language's share of documents, by hash, are expected to be looked at for the sample.
SPARE = 4
#: Tables have 2^BITS weights a language each, fewer where all of them would have over WEIGHTS together (64 MB).
BITS, WEIGHTS = 17, 1 << 24
TABLES = 5  # bigram, trigram, head, tail, word

_letter = np.zeros(256, bool)
_letter[65:91] = _letter[97:123] = True
_letter[128:] = True


@dataclass
class Words:
    """The distinct words of some rows: features as positions in the tables, and each word's type."""

    gram_of: np.ndarray  # (m,) type of each n-gram position
    grams: np.ndarray  # (m, 2) table positions of the bigram and trigram there
    whole: np.ndarray  # (types, 3) table positions of head, tail, word
    size: np.ndarray  # (types,) letters' bytes
    type_of: np.ndarray  # (words,)
    first: np.ndarray  # first word of each row


def table_bits(languages: int) -> int:
    bits = BITS
    while bits > 8 and (TABLES << bits) * languages > WEIGHTS:
        bits -= 1
    return bits


def look(raw: np.ndarray, at: np.ndarray, bits: int = BITS) -> Words:
    def _slot(x: np.ndarray, table: int) -> np.ndarray:
        y = (x + np.uint64(table + 1)) * np.uint64(0x9E3779B97F4A7C15)
        return (y >> np.uint64(64 - bits)).astype(np.int64) + (table << bits)

    low, s, e, first = words(raw, at)
    h, _ = word_hashes(raw, at)
    _, one, type_of = np.unique(h, return_index=True, return_inverse=True)
    s, e = s[one], e[one]
    n = e - s
    padded = np.concatenate([[32, 32, 32, 32], low, [32, 32, 32, 32]]).astype(np.uint64)

    def byte(i: np.ndarray, back: int, until: np.ndarray | int) -> np.ndarray:
        """The byte `back` positions on, or a space outside its word."""
        return np.where(until, padded[i + back + 4], np.uint64(32))

    of = np.repeat(np.arange(len(n)), n + 1)  # positions from the space before a word to its last byte
    k = np.arange(len(of)) - np.repeat(np.concatenate([[0], np.cumsum(n + 1)])[:-1], n + 1) - 1
    i = s[of] + k
    m = n[of]
    b0, b1, b2 = byte(i, 0, k >= 0), byte(i, 1, k + 1 < m), byte(i, 2, k + 2 < m)
    two = b0 << np.uint64(8) | b1
    grams = np.column_stack([_slot(two, 0), _slot(two << np.uint64(8) | b2, 1)])
    head = sum((byte(s, j, n > j) << np.uint64(8 * j) for j in range(3)), np.zeros(len(s), np.uint64))
    tail = sum((byte(e, -1 - j, n > j) << np.uint64(8 * j) for j in range(4)), np.zeros(len(s), np.uint64))
    letters = np.concatenate([[0], np.cumsum(_letter[low])])
    return Words(of, grams, np.column_stack([_slot(head, 2), _slot(tail, 3), _slot(h[one], 4)]), letters[e] - letters[s], type_of, first)


@dataclass
class Model:
    names: list[str]
    table: np.ndarray  # (TABLES << bits, languages)
    trans: np.ndarray

    @property
    def bits(self) -> int:
        return (len(self.table) // TABLES).bit_length() - 1

    def emit(self, w: Words) -> np.ndarray:
        """Scores of types."""
        both = self.table[w.grams[:, 0]] + self.table[w.grams[:, 1]]
        begins = np.flatnonzero(np.diff(w.gram_of, prepend=-1))
        return np.add.reduceat(both, begins, 0) + self.table[w.whole].sum(1) if len(begins) else np.zeros((0, len(self.names)))

    def predict(self, raw: np.ndarray, at: np.ndarray) -> tuple[list[str], list[float]]:
        w = look(raw, at, self.bits)
        share = np.zeros((len(at) - 1, len(self.names)))
        if len(w.type_of):
            p = posterior(self.emit(w)[w.type_of].astype(float), w.first, self.trans)[0]
            size = w.size[w.type_of]
            sums = np.concatenate([np.zeros((1, p.shape[1])), np.cumsum(p * size[:, None], 0)])
            share = sums[w.first[1:]] - sums[w.first[:-1]]
        names, scores = [], []
        for i, row in enumerate(share):
            text = raw[at[i] : at[i + 1]]
            total = row.sum()
            known = total > 0 and (_letter[text[text < 128]].any() or any(c.isalpha() for c in text.tobytes().decode("utf-8", "replace")))
            best = int(row.argmax())
            names.append(self.names[best] if known else "und")
            scores.append(min(1.0, max(0.0, float(row[best] / total))) if known else 0.0)
        return names, scores


def fit(w: Words, langs: list[str], steps: int = 30) -> Model:
    """langs: the language of each row."""
    names = sorted(set(langs))
    y = np.repeat([names.index(x) for x in langs], np.diff(w.first))
    model = Model(names, np.zeros((TABLES << table_bits(len(names)), len(names)), np.float32), np.zeros((len(names), len(names))))
    adam, seen, hot = Adam(0.05), true_transitions(y, w.first, len(names)), np.eye(len(names))[y]
    sums, grow = np.zeros_like(model.table, dtype=np.float64), 0.3  # AdaGrad on the sparse tables
    at = np.concatenate([w.grams.ravel(), w.whole.ravel()])
    of = np.concatenate([np.repeat(w.gram_of, 2), np.repeat(np.arange(len(w.whole)), 3)])
    for _ in range(steps):
        emit = model.emit(w)[w.type_of].astype(float)
        p, a, b = posterior(emit, w.first, model.trans)
        model.trans = np.clip(
            adam.step("t", model.trans, (transition_counts(a, b, emit, w.first, model.trans) - seen) / max(len(y), 1) + 1e-2 * model.trans),
            -2.5,
            2.5,
        )
        adam.k += 1
        for c in range(len(names)):
            by_type = np.bincount(w.type_of, (p - hot)[:, c], len(w.whole))
            g = np.bincount(at, by_type[of], len(model.table)) + 1e-3 * model.table[:, c]
            sums[:, c] += g * g
            model.table[:, c] -= (grow * g / (np.sqrt(sums[:, c]) + 1e-6)).astype(np.float32)
    return model


def choose(sizes: list[tuple[str, int, int]], docs: int, chars: int) -> list[tuple[str, int, int]]:
    """Of (language, hash, characters) the texts to fit on, each language's share filled by smallest hash."""
    of: dict[str, list[tuple[str, int, int]]] = {}
    for x in sorted(sizes, key=lambda x: (x[1], x[2])):
        of.setdefault(x[0], []).append(x)
    chosen: list[tuple[str, int, int]] = []
    order = sorted(of, key=lambda k: (sum(x[2] for x in of[k]), k))
    for i, lang in enumerate(order):
        n, left = max(docs // (len(order) - i), 1), chars // (len(order) - i)
        own: list[tuple[str, int, int]] = []
        for x in of[lang]:
            if len(own) < n and x[2] <= left:
                own.append(x)
                left -= x[2]
        own = own or [min(of[lang], key=lambda x: (x[2], x[1]))]
        docs, chars = max(docs - len(own), 0), max(chars - sum(x[2] for x in own), 0)
        chosen += own
    return chosen


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS) -> Model | None:
    spark = docs.sparkSession
    usable = docs.where(F.col("lang").isNotNull() & (remainder(F.col("doc_id"), 4) != 2) & F.col("text").rlike(r"\p{L}"))
    usable = usable.select("lang", "text", F.xxhash64("doc_id", "text").alias("_veil_o"))
    counts = sorted(((r.lang, r.n) for r in usable.groupBy("lang").agg(F.count_distinct("_veil_o").alias("n")).collect()), key=lambda x: (x[1], x[0]))
    if not counts:
        return None
    upto, left = [], train_docs
    for i, (lang, n) in enumerate(counts):  # few rows of each language are looked at
        share = max(left // (len(counts) - i), 1)
        look_at = SPARE * (share + 16)  # so many that none is hardly possible
        upto.append((lang, int(2**64 * (look_at / n)) - 2**63 if n > look_at else 2**63 - 1))
        left -= min(share, n)
    limits = F.broadcast(spark.createDataFrame(upto, "lang string, _veil_upto long"))
    some = usable.join(limits, "lang").where(F.col("_veil_o") <= F.col("_veil_upto"))
    sizes = [tuple(r) for r in some.select("lang", "_veil_o", F.length("text").alias("n")).distinct().collect()]
    chosen = F.broadcast(spark.createDataFrame([x[:2] for x in choose(sizes, train_docs, train_chars)], "lang string, _veil_o long"))
    rows = sorted(
        usable.join(chosen, ["lang", "_veil_o"]).groupBy("lang", "_veil_o").agg(F.first("text").alias("text")).collect(),
        key=lambda r: (r._veil_o, r.lang),
    )
    texts = pa.array([r.text for r in rows], pa.large_string())
    parts = [(raw, at) for _, raw, at in slices(texts)]
    if not parts:
        return None
    raw = np.concatenate([p[0] for p in parts])
    at = np.concatenate(
        [[0], *(p[1][1:] + before for p, before in zip(parts, np.cumsum([0, *(len(p[0]) for p in parts)]), strict=False))]
    ).astype(np.int64)
    w = look(raw, at, table_bits(len({r.lang for r in rows})))
    return fit(w, [r.lang for r in rows]) if len(w.type_of) else None


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    model = train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 64 MB at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            names, scores = [], []
            for _, raw, at in slices(batch.column(2)):
                a, b = m.predict(raw, at) if m else (["und"] * (len(at) - 1), [0.0] * (len(at) - 1))
                names += a
                scores += b
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
