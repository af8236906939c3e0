"""MinHash near-duplicate detection.

Texts become sets of distinct k-word shingles; equal sets are one class with one node. Universal hash minima
(multiply-shift) are cut into bands; nodes that agree on a band are candidates. A pair counts only when its full sets
meet the threshold. Components come from alternating large-star and small-star.

Texts travel for nodes that may have a partner, nothing else; all other steps work on ids, band keys and one byte of each
minimum. First each node is confirmed with one node, the smallest of a bucket, of those the one it shares most bands
with; components from these links settle most buckets. In a bucket that still holds several components, every node outside
its most frequent one is compared with all nodes of other components by their signatures, in blocks of bounded size, so
that neither all pairs of a bucket nor pairs within a component are ever made. A node's TOP likeliest pairs are confirmed and join
components; then, in the buckets still open, every likely pair of different components is compared on full sets, in the
same blocks and in the first bucket that both share, and no pair is a row anywhere. Nothing is capped.

Band misses: a pair at similarity s misses all bands with probability (1 - s^rows)^bands; with 28 bands of 5 rows
that is 7e-8 at 0.85 and 2e-5 at 0.80. The signature filter passes pairs below the threshold by MARGIN at most, over
four standard deviations. Sets are compared as 64-bit hashes of shingles (see textnum), equal ones by 128-bit digests.

Edge cases: null text and text without words have an empty set (n_shingles 0) and link with nothing. Rows of a
repeated doc_id are judged each by its own text. Rows without doc_id take part; component_id is null where no row of a
component has one. Identical rows are each returned. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilstream.llm.bitmap import MAYBE, maybe_in
from veilstream.llm.components import components
from veilstream.llm.store import Store
from veilstream.llm.textnum import mix, shingles, slices, word_hashes

BANDS, ROWS = 28, 5
#: Over four standard deviations of the share of 140 minima that agree, at the threshold.
MARGIN = 0.13
#: Sizes of the pieces in which groups are worked on: pairs of one node, nodes outside a bucket's main component, others.
PAIRS, REST, OTHERS, SHINGLES = 256, 256, 2048, 400_000
TOP = 2
#: Names of columns added to a caller's table.
ROW, ONCE = "_veil_row", "_veil_once"


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    seed = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    return seed[:n] | np.uint64(1), seed[n:]


def minima(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest top half of a*x+b modulo 2^64 over the set, for each (a, b)."""
    best = np.full(len(a), 0xFFFFFFFF, np.uint64)
    for i in range(0, len(s), 4096):
        best = np.minimum(best, ((a[:, None] * s[None, i : i + 4096] + b[:, None]) >> np.uint64(32)).min(1))
    return best.astype(np.uint32)


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """(n, bands) 64-bit keys of the minima (n, bands * rows) of each band and its number."""
    by_band = sig.reshape(len(sig), bands, -1).astype(np.uint64)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), by_band.shape[:2])
    for j in range(by_band.shape[2]):
        key = mix(key * np.uint64(0x9FB21C651E98DF25) + by_band[:, :, j])
    return key


def row_key(doc_id: Column, text: Column) -> Column:
    """128 bits that tell rows of different doc_id or text apart."""
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))))


def signatures(docs: DataFrame, k: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, at (row_key), n_shingles; null for empty sets: digest of the set, keys (bands) and sig (a byte a minimum)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _coefficients(bands * rows)
        for batch in batches:
            ns, digests, sigs = [], [], []
            for _, raw, at in slices(batch.column(2)):
                h, first = word_hashes(raw, at)
                for i in range(len(at) - 1):
                    s = shingles(h[first[i] : first[i + 1]], k)
                    ns.append(len(s))
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    sigs.append(minima(s, a, b))
            n = pa.array(ns, pa.int64())
            m = np.stack(sigs) if sigs else np.zeros((0, bands * rows), np.uint32)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * bands, pa.int32()), pa.array(band_keys(m, bands).ravel().view(np.int64)))
            packed = pa.array([x.tobytes() if c else None for x, c in zip(m.astype(np.uint8), ns, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), n, pa.array(digests, pa.binary()), keys, packed],
                ["doc_id", "at", "n_shingles", "digest", "keys", "sig"],
            )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("doc_id"), F.col("text")).alias("at"), "text")
    return source.mapInArrow(run, "doc_id long, at binary, n_shingles long, digest binary, keys array<long>, sig binary")


def _sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    for _, raw, at in slices(texts):
        h, first = word_hashes(raw, at)
        for i in range(len(at) - 1):
            yield shingles(h[first[i] : first[i + 1]], k)


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common > 0 and 100 * common >= percent * (len(a) + len(b) - common)


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Of distinct (u, v), those whose full shingle sets have 100*intersection >= percent*union. texts: node, text.

    A node's pairs are dealt over pieces of about PAIRS; each piece gets the text of u first, then those of its v."""
    pieces = pairs.groupBy("u").agg(F.ceil(F.count("*") / PAIRS).alias("pieces"))
    dealt = pairs.join(pieces, "u").select("u", F.pmod(F.xxhash64("v"), "pieces").alias("piece"), F.col("v").alias("node"))
    heads = pieces.select("u", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"), F.col("u").alias("node"))
    asked = dealt.withColumn("role", F.lit(1)).union(heads.withColumn("role", F.lit(0)))
    got = asked.join(texts, "node").select("u", "piece", "role", "node", "text").repartition("u", "piece").sortWithinPartitions("u", "piece", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.zeros(0, np.uint64)
        for batch in batches:
            us, roles, nodes = (batch.column(i).to_numpy() for i in (0, 2, 3))
            keep = np.zeros(len(us), bool)
            for j, s in enumerate(_sets(batch.column(4), k)):
                if roles[j] == 0:
                    head = s
                else:
                    keep[j] = _linked(head, s, percent)
            yield pa.RecordBatch.from_arrays([pa.array(us[keep]), pa.array(nodes[keep])], ["u", "v"])

    return got.mapInArrow(run, "u long, v long")


class Block:
    """The nodes outside a bucket's main component that one task compares with others: role 0 of a group's rows."""

    def __init__(self, percent: int, bands: int, rows: int):
        self.percent, self.bands, self.rows = percent, bands, rows
        self.least = int(np.ceil((percent / 100 - MARGIN) * bands * rows))
        self.group, self.node, self.comp, self.n, self.sig = None, *(np.zeros(0, np.int64) for _ in range(3)), np.zeros((0, bands * rows), np.uint8)

    def parts(self, batch: pa.RecordBatch) -> Iterator[tuple[bool, int, slice, tuple]]:
        """(whether another group begins, role, rows, their node, comp, n, sig and band) of each run of rows of one group and
        role. Rows: key, block, part, role, band, node, comp, n, sig, ..."""
        group = np.column_stack([batch.column(i).to_numpy() for i in range(3)])
        role, band, node, comp, n = (batch.column(i).to_numpy() for i in range(3, 8))
        sig = np.frombuffer(b"".join(batch.column(8).to_pylist()), np.uint8).reshape(-1, self.bands * self.rows)
        change = (group[1:] != group[:-1]).any(1) | (role[1:] != role[:-1])
        starts = np.flatnonzero(np.concatenate([[True], change])) if len(role) else []
        for a, b in zip(starts, [*starts[1:], len(role)], strict=True):
            new = self.group is None or (group[a] != self.group).any()
            if new:
                self.group, self.node, self.comp, self.n, self.sig = group[a].copy(), node[:0], comp[:0], n[:0], sig[:0]
            own = slice(a, b)
            if role[a] == 0:
                self.node, self.comp, self.n, self.sig = (
                    np.concatenate(x) for x in ((self.node, node[own]), (self.comp, comp[own]), (self.n, n[own]), (self.sig, sig[own]))
                )
            yield new, int(role[a]), own, (node[own], comp[own], n[own], sig[own], int(band[a]))

    def like(self, i: int, node: np.ndarray, comp: np.ndarray, n: np.ndarray, sig: np.ndarray, band: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Of other rows, the positions of those in other components that may reach the threshold with node i, and their
        numbers of equal minima. With a band, only pairs that share no earlier one: each pair in one bucket."""
        fit = (comp != self.comp[i]) & (100 * np.minimum(n, self.n[i]) >= self.percent * np.maximum(n, self.n[i]))
        fit &= (node > self.node[i]) | ~np.isin(node, self.node)  # two of the block itself meet twice
        at = np.flatnonzero(fit)
        equal = sig[at] == self.sig[i]
        same = equal.sum(1)
        keep = same >= self.least
        if band and keep.any():
            keep[keep] = ~equal[keep, : band * self.rows].reshape(-1, band, self.rows).all(2).any(1)
        return at[keep], same[keep]


def _open_buckets(members: DataFrame, comps: DataFrame, signed: DataFrame) -> DataFrame:
    """The groups in which nodes outside the main component of a bucket (key, band, node) meet nodes of others: key, block,
    part, role (0: those of the block; 1: the others), band, node, comp, n, sig. A group's rows are together, role 0 first."""
    at = members.join(comps, "node", "left").select("key", "band", "node", "n", F.coalesce("component", "node").alias("comp"))
    sums = [F.sum(F.xxhash64("node", F.lit(i)).cast("decimal(38,0)")).alias(f"h{i}") for i in (0, 1)]
    by_comp = at.groupBy("key", "band", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("n"), *sums)
    buckets = by_comp.groupBy("key", "band").agg(
        F.max_by("comp", "c").alias("main"),
        F.max("c").alias("m"),
        F.sum("c").alias("all"),
        F.sum("n").alias("n"),
        *[F.sum(f"h{i}").alias(f"h{i}") for i in (0, 1)],
        F.count("*").alias("comps"),
    ).where("comps > 1")
    # of buckets with the same nodes the one of the first band is enough
    buckets = buckets.groupBy("all", "h0", "h1").agg(*[F.min_by(c, "band").alias(c) for c in ("key", "main", "m", "n")])
    share = (F.col("all") - F.col("m")) / F.col("all")
    blocks = F.ceil(F.greatest((F.col("all") - F.col("m")) / REST, F.col("n") * share / SHINGLES))
    buckets = buckets.select("key", "main", blocks.alias("blocks"), F.ceil(F.col("all") / OTHERS).alias("parts"))
    rows = at.join(buckets, "key").withColumn("block", F.pmod(F.xxhash64("node"), "blocks")).withColumn(
        "part",
        F.pmod(F.xxhash64("node", F.lit(2)), "parts"),
    )
    zero = F.lit(0).cast("long")
    others = F.when(F.col("comp") == F.col("main"), F.col("blocks") - 1).otherwise(F.col("block"))
    own = rows.where("comp <> main").select(
        "key",
        "block",
        F.explode(F.sequence(zero, F.col("parts") - 1)).alias("part"),
        F.lit(0).alias("role"),
        "band",
        "node",
        "comp",
        "n",
    )
    met = rows.select("key", F.explode(F.sequence(zero, others)).alias("block"), "part", F.lit(1).alias("role"), "band", "node", "comp", "n")
    return _together(own.union(met).join(signed, "node").select(*GROUP, "band", "node", "comp", "n", "sig"))


GROUP = ["key", "block", "part", "role"]


def _together(rows: DataFrame) -> DataFrame:
    return rows.repartition(*GROUP[:3]).sortWithinPartitions(*GROUP)


def _likeliest(groups: DataFrame, percent: int, bands: int, rows: int) -> DataFrame:
    """(u, v): each block node's TOP likeliest pairs in a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(percent, bands, rows)
        for batch in batches:
            us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, role, _, (node, comp, n, sig, _) in block.parts(batch):
                for i in range(len(block.node)) if role else ():
                    at, same = block.like(i, node, comp, n, sig, None)
                    best = node[at[np.lexsort((node[at], -same))[:TOP]]]
                    us.append(np.minimum(best, block.node[i]))
                    vs.append(np.maximum(best, block.node[i]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    return groups.mapInArrow(run, "u long, v long").distinct()


def _involved(groups: DataFrame, percent: int, bands: int, rows: int) -> DataFrame:
    """Of the groups' rows those that have a likely pair in their group, so that only their texts need travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, hit = Block(percent, bands, rows), [], np.zeros(0, bool)

        def own() -> Iterator[pa.RecordBatch]:
            at = 0
            for x in held:
                yield x.filter(pa.array(hit[at : at + x.num_rows]))
                at += x.num_rows

        for batch in batches:
            for new, role, at, (node, comp, n, sig, band) in block.parts(batch):
                if new:
                    yield from own()
                    held, hit = [], np.zeros(0, bool)
                if role == 0:
                    held.append(batch.slice(at.start, at.stop - at.start))
                    hit = np.concatenate([hit, np.zeros(at.stop - at.start, bool)])
                    continue
                other = np.zeros(len(node), bool)
                for i in range(len(block.node)):
                    found, _ = block.like(i, node, comp, n, sig, band)
                    hit[i] |= len(found) > 0
                    other[found] = True
                yield batch.slice(at.start, at.stop - at.start).filter(pa.array(other))
        yield from own()

    return groups.mapInArrow(run, groups.schema)


def _settled(groups: DataFrame, k: int, percent: int, bands: int, rows: int) -> DataFrame:
    """(u, v): of the groups' likely pairs, confirmed on full sets, those that join components; once two are joined here, no
    other pair of theirs is looked at. Rows end with the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, sets, joined = Block(percent, bands, rows), [], {}

        def root(c: int) -> int:
            while joined.get(c, c) != c:
                c = joined[c]
            return c

        for batch in batches:
            us, vs = [], []
            for new, role, at, (node, comp, n, sig, band) in block.parts(batch):
                if new:
                    sets, joined = [], {}
                its = list(_sets(batch.column(9).slice(at.start, at.stop - at.start), k))
                if role == 0:
                    sets += its
                    continue
                for i in range(len(block.node)):
                    for j in block.like(i, node, comp, n, sig, band)[0]:
                        p, q = root(int(block.comp[i])), root(int(comp[j]))
                        if p != q and _linked(sets[i], its[j], percent):
                            joined[max(p, q)] = min(p, q)
                            us.append(block.node[i])
                            vs.append(node[j])
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return groups.mapInArrow(run, "u long, v long")


def _contracted(comps: DataFrame, links: DataFrame, store: Store, name: str) -> DataFrame:
    """comps (node, component) after further links: a link between nodes is one between their components."""
    if not links.limit(1).count():
        return comps
    c = comps.select("node", "component")
    ends = links.join(c.toDF("u", "cu"), "u", "left").join(c.toDF("v", "cv"), "v", "left")
    merged = components(ends.select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v")), store, f"merge-{name}").toDF("old", "new")
    was = comps.join(merged, comps.component == merged.old, "left").select("node", F.coalesce("new", "component").alias("component"))
    # nodes that were alone before have no row in comps
    return store.keep(was.union(merged.join(comps, merged.old == comps.node, "left_anti").select("old", "new")), f"comps-{name}")


def grouped(docs: DataFrame, k: int, percent: int, bands: int, rows: int) -> DataFrame:
    """doc_id, at (row_key), n_shingles, component_id, node (of its set; null if empty), group (of its component; null if empty)."""
    store = Store(docs.sparkSession, "minhash")
    signed = store.keep(signatures(docs, k, bands, rows).withColumn("row", F.monotonically_increasing_id()), "signed")
    every = store.keep(signed.select("doc_id", "at", "n_shingles", "digest"), "rows")
    order = F.coalesce("doc_id", F.lit(2**63 - 1))
    classes = store.keep(
        signed.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("first"), F.min_by("row", order).alias("node")),
        "classes",
    )
    reps = signed.withColumnRenamed("row", "node").join(classes.select("node"), "node").select("node", "at", "n_shingles", "keys", "sig")
    reps = store.keep(reps, "reps")
    store.drop("signed")
    store.release()

    banded = reps.select("node", F.col("n_shingles").alias("n"), F.posexplode("keys").alias("band", "key"))
    hubs = banded.groupBy("key").agg(
        F.min("node").alias("hub"),
        F.min_by("n", "node").alias("hub_n"),
        F.max("node").alias("last"),
    ).where("hub <> last").drop("last")
    members = store.keep(banded.join(hubs, "key"), "members")
    store.release()
    near = (F.col("node") != F.col("hub")) & (100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n"))
    shared = members.where(near).groupBy("hub", "node").agg(F.count("*").alias("c"))
    pairs = store.keep(shared.groupBy("node").agg(F.max_by("hub", "c").alias("u")).select("u", F.col("node").alias("v")), "pairs")

    wanted = store.keep(members.select("node").distinct().join(reps.select("node", "at"), "node"), "wanted")
    source = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("at"), "text")
    texts = maybe_in(source, wanted, "at").where(MAYBE).drop(MAYBE).join(wanted, "at").groupBy("at", "node").agg(F.first("text").alias("text")).drop("at")
    texts = store.keep(texts, "texts")
    store.release()
    comps = components(store.keep(confirmed(pairs, texts, k, percent), "links-0"), store, "star")
    store.release()

    members, signed = members.select("key", "band", "node", "n"), reps.select("node", "sig")
    likeliest = store.keep(_likeliest(_open_buckets(members, comps, signed), percent, bands, rows), "likeliest")
    store.release()
    comps = _contracted(comps, store.keep(confirmed(likeliest, texts, k, percent), "links-1"), store, "1")
    store.release()
    involved = store.keep(_involved(_open_buckets(members, comps, signed), percent, bands, rows), "involved")
    store.release()
    links = store.keep(_settled(_together(involved.join(texts, "node").select(*involved.columns, "text")), k, percent, bands, rows), "links-2")
    comps = _contracted(comps, links, store, "2")
    store.drop("texts", "reps", "members", "wanted", "involved")
    store.release()

    of_node = classes.join(comps, "node", "left").select("digest", "first", "node", F.coalesce("component", "node").alias("group"))
    least = of_node.groupBy("group").agg(F.min("first").alias("component_id"))
    of_class = of_node.select("digest", "node", "group").join(least, "group")
    out = every.join(of_class, "digest", "left")
    return out.select(
        "doc_id",
        "at",
        "n_shingles",
        F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        "node",
        "group",
    )


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text, ...)."""
    return grouped(docs, k, percent, bands, rows).select(
        "doc_id",
        "n_shingles",
        "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs with one row of each group of near copies, that of the smallest doc_id (of several texts of it any one), and
    every row without words. Rows alike in doc_id and text are one. Columns stay as they are; only rows that may go are shuffled."""
    store = Store(docs.sparkSession, "keep")
    found = grouped(docs, k, percent, bands, rows).where("group is not null").select("doc_id", "at", "group")
    found = store.keep(found.groupBy("at").agg(F.first("doc_id").alias("doc_id"), F.first("group").alias("group"), F.count("*").alias("c")), "found")
    kept = found.groupBy("group").agg(F.min_by("at", F.coalesce("doc_id", F.lit(2**63 - 1))).alias("at")).select("at")
    gone = found.select("at").join(kept, "at", "left_anti").select(F.col("at").alias(ROW), F.lit(False).alias(ONCE))
    again = found.where("c > 1").select("at").join(kept, "at", "left_semi").select(F.col("at").alias(ROW), F.lit(True).alias(ONCE))
    some = store.keep(gone.union(again), "some")
    marked = maybe_in(docs.withColumn(ROW, row_key(F.col("doc_id"), F.col("text"))), some, ROW)
    looked_at = marked.where(MAYBE).join(some, ROW, "left")
    out = marked.where(~F.col(MAYBE)).select(*docs.columns).union(looked_at.where(F.col(ONCE).isNull()).select(*docs.columns))
    if some.where(ONCE).limit(1).count():
        out = out.union(looked_at.where(ONCE).dropDuplicates([ROW]).select(*docs.columns))
    return out
