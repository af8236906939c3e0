"""Approximate nearest neighbours by inner product: an NN-descent graph and greedy search on it.

Equal vectors are one node. The graph starts with random neighbours. In each round every node takes a sample of its new
neighbours, those not taken in a round before, with its old ones and one of those that list it for each of SAMPLE hash
slots, new and old (so a node that many list costs no more); their vectors meet at the node, and each learns of the
others that are nearer than its own farthest neighbour, of pairs with a new one only: the join of neighbours of
neighbours. A node without new neighbours meets nobody. Rounds go on until at most SETTLED of all neighbours are new. No
vectors are collected or broadcast; half-precision copies travel for this.

A query starts from its own node's neighbours and takes `width` unvisited best nodes of its list of `beam` at a time; all
their neighbours, listed and listing, join the list. It ends when the list has been visited, however many hops that
takes: every hop visits a node not visited before, so it does end.
Final scores are exact, in double precision on the original vectors.

Vectors that are null, empty, zero, or with null or non-finite parts take no part. Vectors of different lengths have no
inner product: each length is searched by itself. Equal vectors share a node and all come back; equal scores go by smaller
ids. Of rows with one id the vector that sorts first counts. Other columns are ignored. Empty tables give no rows; fewer
candidates than k give all.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilstream.llm.store import Store
from veilstream.llm.textnum import mix

NEIGHBOURS, SAMPLE, SETTLED = 32, 16, 0.001
BEAM, WIDTH = 192, 24


def _long(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    off = lists.offsets.to_numpy()
    return lists.flatten().to_numpy(zero_copy_only=False), off - off[0]


def usable(table: DataFrame) -> DataFrame:
    """vec_id, v (array of double) of rows that take part; of a repeated id, the vector that sorts first."""
    v = F.col("embedding").cast("array<double>")
    d = table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return d.where(fine).groupBy("vec_id").agg(F.min("v").alias("v"))


def _half(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, at = _long(batch.column(1))
        h = x.astype(np.float32)
        big = np.abs(h).max() if len(h) else 1.0
        h = (h / big * 1000 if big > 6e4 else h).astype(np.float16)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([h[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())],
            ["id", "h"],
        )


def _top(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best distinct ids, best first, ties to smaller ids."""
    order = np.lexsort((ids, -scores))
    ids, scores = ids[order], scores[order]
    _, first = np.unique(ids, return_index=True)
    keep = np.sort(first)[:k]
    return ids[keep], scores[keep]


LEARNED = "id long, n array<long>, s array<float>"
#: f: whether a neighbour is new still; new: those drawn to meet others next, new no longer; old: the others. turn is a column, as a
#: literal would make other code of every round's plan.
GRAPH = f"{LEARNED}, f array<boolean>, new array<long>, old array<long>, turn int"


def _matrix(hs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(hs), np.float16).reshape(len(hs), -1).astype(np.float32)


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For nodes with the ids, vectors, bounds and marks (new or not) of neighbours: what each of them learns from pairs of
    which one at least is new here."""
    for batch in batches:
        to, ns, ss = [], [], []
        ids, at = _long(batch.column("ids"))
        far, new = _long(batch.column("far"))[0], _long(batch.column("fresh"))[0]
        hs = batch.column("hs").flatten().to_pylist()
        for a, b in zip(at[:-1], at[1:], strict=True):
            order = np.lexsort((~new[a:b], ids[a:b]))
            own = ids[a:b][order]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if b > a else []
            if len(first) < 2:
                continue
            own, at_own = own[first], order[first]
            m, fresh = _matrix([hs[a + i] for i in at_own]), new[a:b][at_own]
            g = m @ m.T
            np.fill_diagonal(g, -np.inf)
            better = (g > far[a:b][at_own][:, None]) & (fresh[:, None] | fresh[None, :])
            for i in np.flatnonzero(better.any(1)):
                j = np.flatnonzero(better[i])
                to.append(own[i])
                ns.append(own[j])
                ss.append(g[i, j])
        yield pa.RecordBatch.from_arrays(
            [pa.array(to, pa.int64()), pa.array(ns, pa.list_(pa.int64())), pa.array(ss, pa.list_(pa.float32()))],
            ["id", "n", "s"],
        )


def _merged(k: int, sample: int, turn: int):  # noqa: ANN202
    """Lists with what was learned, marks of what is new, and which of the new neighbours are drawn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            (n, at), (s, _), (f, _) = (_long(batch.column(c)) for c in ("n", "s", "f"))
            (n2, at2), (s2, _) = _long(batch.column("n2")), _long(batch.column("s2"))
            ids = batch.column("id").to_numpy().view(np.uint64)
            for i in range(batch.num_rows):
                old, marks = n[at[i] : at[i + 1]], f[at[i] : at[i + 1]].astype(bool)
                a, b = _top(np.concatenate([old, n2[at2[i] : at2[i + 1]]]), np.concatenate([s[at[i] : at[i + 1]], s2[at2[i] : at2[i + 1]]]), k)
                fresh = ~np.isin(a, old[~marks])
                order = np.argsort(mix(a.view(np.uint64) + mix(ids[i : i + 1] + np.uint64(turn))), kind="stable")
                drawn = order[fresh[order]][:sample]
                left = fresh.copy()
                left[drawn] = False
                for o, x in zip(out, (a, b, left, a[drawn], a[~fresh]), strict=True):
                    o.append(x)
            kinds = (pa.int64(), pa.float32(), pa.bool_(), pa.int64(), pa.int64())
            lists = (pa.array(o, pa.list_(t)) for o, t in zip(out, kinds, strict=True))
            turns = pa.array(np.full(batch.num_rows, turn, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *lists, turns], ["id", "n", "s", "f", "new", "old", "turn"])

    return run


def _reverse(edges: DataFrame, slots: int) -> DataFrame:
    """Of edges (id, other, turn), (id, other) of one lister a slot; slots change with the turn."""
    slot = F.pmod(F.xxhash64("id", "other", "turn"), F.lit(slots))
    listers = edges.groupBy(F.col("other").alias("to"), slot.alias("slot")).agg(F.min("id").alias("from"))
    return listers.select(F.col("to").alias("id"), F.col("from").alias("other"))


def build(vectors: DataFrame, store: Store, k: int = NEIGHBOURS, sample: int = SAMPLE, rounds: int = 1, settled: float = SETTLED) -> DataFrame:
    """vectors (id, h) to the graph: id, n (neighbours, best first), s (their scores). Vectors of different lengths never meet."""
    count = vectors.count()
    # random start: in each of a few random orders, the neighbours by position; orders are hash ranges, not a total sort
    sizes = vectors.groupBy(F.length("h").alias("width")).agg(F.greatest(F.floor(F.count("*") / 64), F.lit(1)).alias("cells"))
    sized = vectors.withColumn("width", F.length("h")).join(sizes, "width")
    cell = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.pmod(F.xxhash64("id", F.lit(i)), "cells").alias("c")) for i in range(4)]))
    spread = sized.select("width", cell.alias("cell"), "id", "h", F.lit(float("-inf")).cast("float").alias("far"), F.lit(True).alias("fresh"))
    lists = [F.collect_list(c).alias(name) for c, name in (("id", "ids"), ("h", "hs"), ("far", "far"), ("fresh", "fresh"))]
    none = vectors.select("id", *[F.array().cast(f"array<{t}>").alias(c) for c, t in (("n", "long"), ("s", "float"), ("f", "boolean"))])

    def merge(graph: DataFrame, news: DataFrame, turn: int) -> DataFrame:
        g = news.groupBy("id").agg(F.flatten(F.collect_list("n")).alias("n2"), F.flatten(F.collect_list("s")).alias("s2"))
        j = graph.join(g, "id", "left").select(
            "id",
            "n",
            "s",
            "f",
            F.coalesce("n2", F.array().cast("array<long>")).alias("n2"),
            F.coalesce("s2", F.array().cast("array<float>")).alias("s2"),
        )
        return j.mapInArrow(_merged(k, sample, turn), GRAPH)

    graph = store.keep(merge(none, spread.groupBy("width", "cell").agg(*lists).mapInArrow(_learn, LEARNED), 0), "graph-0")
    for r in itertools.count(1):
        new, old = (graph.select("id", F.explode(c).alias("other"), "turn") for c in ("new", "old"))
        met = [new, _reverse(new, sample)], [old, _reverse(old, sample), graph.select("id", F.col("id").alias("other"))]
        parts = [d.select("id", "other", F.lit(i == 0).alias("fresh")) for i in (0, 1) for d in met[i]]
        near = functools.reduce(DataFrame.union, parts).groupBy("id").agg(F.collect_list(F.struct("other", "fresh")).alias("l"))
        near = near.where(F.exists("l", lambda x: x["fresh"])).select("id", F.explode("l").alias("x")).select("id", "x.other", "x.fresh")
        far = F.when(F.size("s") >= k, F.get("s", F.lit(k - 1))).otherwise(F.lit(float("-inf")).cast("float"))
        known = vectors.join(graph.select("id", far.alias("far")), "id").select(F.col("id").alias("other"), "h", "far")
        lists = [F.collect_list(c).alias(name) for c, name in (("other", "ids"), ("h", "hs"), ("far", "far"), ("fresh", "fresh"))]
        learned = near.join(known, "other").groupBy("id").agg(*lists).drop("id").mapInArrow(_learn, LEARNED)
        graph = store.keep(merge(graph.select("id", "n", "s", "f"), learned, r), f"graph-{r}")
        store.drop(f"graph-{r - 1}")
        store.release()
        # how many are new: those that came in this round and those not drawn yet
        fresh = F.size("new") + F.size(F.filter("f", lambda x: x))
        if r >= rounds and (graph.agg(F.sum(fresh)).first()[0] or 0) <= settled * k * count:
            return graph.select("id", "n", "s")


def _expand(beam: int, width: int):  # noqa: ANN202
    """Adds found nodes to each query's list and marks the next ones to visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            qs = batch.column("h").to_pylist()
            (n, at), (s, _), (seen, at_seen), (ids, at_ids) = _long(batch.column("n")), _long(batch.column("s")), _long(batch.column("seen")), _long(batch.column("ids"))
            hs = batch.column("hs").flatten().to_pylist()
            for i in range(batch.num_rows):
                own, first = np.unique(ids[at_ids[i] : at_ids[i + 1]], return_index=True)
                got = _matrix([hs[at_ids[i] + j] for j in first]) @ np.frombuffer(qs[i], np.float16).astype(np.float32) if len(own) else np.zeros(0, np.float32)
                a, b = _top(np.concatenate([n[at[i] : at[i + 1]], own]), np.concatenate([s[at[i] : at[i + 1]], got]), beam)
                old = seen[at_seen[i] : at_seen[i + 1]]
                go = a[~np.isin(a, old)][:width]
                for o, x in zip(out, (a, b, np.concatenate([old, go]), go), strict=True):
                    o.append(x)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("q"),
                    batch.column("h"),
                    *(pa.array(o, pa.list_(t)) for o, t in zip(out, (pa.int64(), pa.float32(), pa.int64(), pa.int64()), strict=True)),
                ],
                ["q", "h", "n", "s", "seen", "go"],
            )

    return run


def search(graph: DataFrame, vectors: DataFrame, queries: DataFrame, store: Store, beam: int = BEAM, width: int = WIDTH) -> DataFrame:
    """queries (q, h, start: array of node ids) to q, n: the nodes of its final list, best first."""
    edges = graph.select("id", F.explode("n").alias("other"), F.lit(-1).alias("turn"))
    both = edges.drop("turn").union(_reverse(edges, NEIGHBOURS)).groupBy("id").agg(F.collect_set("other").alias("links"))
    links = store.keep(both, "links")
    schema = "q long, h binary, n array<long>, s array<float>, seen array<long>, go array<long>"
    empty = lambda t: F.array().cast(f"array<{t}>")
    now = queries.select("q", "h", empty("long").alias("n"), empty("float").alias("s"), empty("long").alias("seen"), F.col("start").alias("go"))
    wanted = now.select("q", F.explode("go").alias("id"))
    for hop in itertools.count():
        known = F.col("q"), F.col("id")
        found = wanted.join(vectors, "id").groupBy("q").agg(F.collect_list("id").alias("ids"), F.collect_list("h").alias("hs"))
        j = now.join(found, "q", "left").select(
            "q",
            "h",
            "n",
            "s",
            "seen",
            F.coalesce("ids", empty("long")).alias("ids"),
            F.coalesce("hs", empty("binary")).alias("hs"),
        )
        now = store.keep(j.mapInArrow(_expand(beam, width), schema), f"hop-{hop}")
        if hop:
            store.drop(f"hop-{hop - 1}")
        store.release()
        if not now.where("size(go) > 0").limit(1).count():
            return now.select("q", "n")
        visited = now.select("q", F.explode("go").alias("id"))
        nexts = visited.join(links, "id").select("q", F.explode("links").alias("id")).distinct()
        wanted = nexts.join(now.select("q", F.explode("n").alias("id")), ["q", "id"], "left_anti").select(*known)


def nearest(table: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found of each vector whose id is divisible by `every`."""
    spark = table.sparkSession
    store = Store(spark, "ann")
    rows = store.keep(usable(table), "rows")
    # copies: the node is the smallest id; of a node's members only the k+1 smallest can be among k nearest
    nodes = rows.groupBy("v").agg(F.min("vec_id").alias("id"))
    member = rows.join(nodes, "v").select("id", "vec_id")
    # the limit on the row number is applied before the exchange too, so a vector with many copies sends k+1 a task
    first = member.withColumn("i", F.row_number().over(Window.partitionBy("id").orderBy("vec_id"))).where(F.col("i") <= k + 1)
    members = first.groupBy("id").agg(F.array_sort(F.collect_list("vec_id")).alias("m"))
    nodes = store.keep(nodes.join(members, "id"), "nodes")
    vectors = store.keep(nodes.select("id", "v").mapInArrow(_half, "id long, h binary"), "vectors")
    graph = build(vectors, store)
    of_node = store.keep(member, "member")
    asked = of_node.where(F.col("vec_id") % every == 0).select("id").distinct()
    start = graph.join(asked, "id").select("id", F.concat(F.array("id"), "n").alias("start"))
    queries = vectors.join(start, "id").select(F.col("id").alias("q"), "h", "start")
    found = search(graph, vectors, queries, store).select("q", F.explode("n").alias("id"))
    pairs = found.join(nodes.select("id", "v", "m"), "id").join(nodes.select(F.col("id").alias("q"), F.col("v").alias("qv")), "q")
    score = F.aggregate(F.zip_with("v", "qv", lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    scored = pairs.select("q", score.alias("score"), "m")
    lists = scored.groupBy("q").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("neg"), "score", "m"))).alias("l"))
    flat = F.flatten(
        F.transform("l", lambda x: F.transform(x["m"], lambda y: F.struct(x["neg"].alias("neg"), y.alias("vec_id"), x["score"].alias("score"))))
    )
    best = lists.select("q", F.slice(F.array_sort(flat), 1, k + 1).alias("best"))
    each = of_node.where(F.col("vec_id") % every == 0).select(F.col("id").alias("q"), F.col("vec_id").alias("query_id")).join(best, "q")
    mine = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return each.select("query_id", F.posexplode(mine).alias("i", "x")).select(
        "query_id",
        (F.col("i") + 1).cast("int").alias("rank"),
        "x.vec_id",
        "x.score",
    )
