"""Mixing sources to target weights by temperature.

A source's weight is its token share raised to an exponent in [0, 1], normalised: 1 keeps the shares, 0 makes sources
equal. The exponent is found by bisection: the largest one whose weights reach a target entropy (a part of the
log of the number of sources), or the smallest one for which no source is repeated more often than a limit. Where both
are given, the limit wins. Each bisection step is one aggregate over the table of sources, so any number of sources works.

Weights become token budgets of a total. A source is realised as block permutations: its documents are ordered by
the MD5 of seed and doc_id (of the text where there is none), whose leading digits name blocks and sub-blocks; a budget takes whole passes, then whole
blocks of the last pass in order, then whole sub-blocks of the next block, then documents until the budget is met.
Only sums per block meet in a window, and documents only within one sub-block, so a source with a third of all rows is
spread like any other.

Tokens are runs of characters outside space and 0x09-0x0D. A null source is a source of its own. Null and empty texts
have no tokens and go with the pass or block they are in. Repeated rows each count. Other columns are ignored. An empty table gives no rows.
Sources without tokens get no budget and appear in no pass.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilstream.llm.store import Store

STEPS = 40
WORD = r"[^\x20\x09-\x0D]+"


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _entropy(sources: DataFrame, a: float) -> float:
    p = F.pow(F.col("share"), F.lit(a))
    z, plog = sources.agg(F.sum(p), F.sum(p * F.log(p))).first()
    return math.log(z) - plog / z


def _repeats(sources: DataFrame, a: float, budget: float) -> float:
    p = F.pow(F.col("share"), F.lit(a))
    z, most = sources.agg(F.sum(p), F.max(p / F.col("tokens"))).first()
    return budget * most / z


def exponent(sources: DataFrame, entropy: float | None, repeats: float | None, total: int, budget: int) -> float:
    """sources: share and tokens, both above zero."""
    n = sources.count()
    lo, hi = 0.0, 1.0
    if entropy is not None and n > 1:
        for _ in range(STEPS):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if _entropy(sources, mid) >= entropy * math.log(n) else (lo, mid)
    found = lo if entropy is not None else 0.0
    if repeats is not None and n and _repeats(sources, found, budget) > repeats:
        lo, hi = found, 1.0
        for _ in range(STEPS):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if _repeats(sources, mid, budget) <= repeats else (mid, hi)
        found = hi
    return found


def mix(docs: DataFrame, entropy: float | None = 0.995, repeats: float | None = 3.0, budget: int | None = None, seed: str = "mix") -> DataFrame:
    """doc_id, source, n_tokens, weight (its source's), pass: one row for each time a document is taken (pass from 0).

    budget: tokens in all, as many as docs has by default.
    """
    store = Store(docs.sparkSession, "mixing")
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.md5(F.coalesce("text", F.lit("")))))))
    d = store.keep(docs.select("doc_id", "source", n_tokens(F.col("text")).alias("n_tokens"), key.alias("key")), "tokens")
    blocks = store.keep(
        d.groupBy("source", F.substring("key", 1, 3).alias("b1"), F.substring("key", 4, 3).alias("b2")).agg(F.sum("n_tokens").alias("tokens")),
        "blocks",
    )
    of_source = blocks.groupBy("source").agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
    total = of_source.agg(F.sum("tokens")).first()[0] or 0
    budget = total if budget is None else budget
    sources = store.keep(of_source.withColumn("share", F.col("tokens") / F.lit(float(max(total, 1)))), "sources")
    if sources.count() <= 10_000:
        sources = store.keep(sources.coalesce(1), "few")  # one small file for the many short jobs of the bisection
    a = exponent(sources, entropy, repeats, total, budget)
    p = F.pow("share", F.lit(a))
    z = sources.agg(F.sum(p)).first()[0] or 1.0
    plan = sources.select("source", "tokens", (p / F.lit(z)).alias("weight")).withColumn(
        "budget",
        F.floor(F.col("weight") * budget + 0.5).cast("long"),
    )
    plan = plan.select(
        "source",
        "weight",
        F.floor(F.col("budget") / F.col("tokens")).cast("int").alias("passes"),
        (F.col("budget") % F.col("tokens")).alias("rest"),
    )
    plan = F.broadcast(plan) if sources.count() <= 10_000 else plan  # a few dozen bytes a source

    def same(left: DataFrame, right: DataFrame, names: list[str]) -> list[Column]:
        return [left[n].eqNullSafe(right[n]) for n in names]

    # in the last pass: the block in which the rest ends, then the sub-block in it; sums before each
    before = F.sum("tokens").over(Window.partitionBy("source").orderBy("b1").rowsBetween(Window.unboundedPreceding, -1))
    one = blocks.groupBy("source", "b1").agg(F.sum("tokens").alias("tokens")).withColumn("before", F.coalesce(before, F.lit(0)))
    plan_ = plan.select(F.col("source").alias("_s"), "rest")
    one = one.join(plan_, one.source.eqNullSafe(F.col("_s"))).where(
        "before < rest and before + tokens >= rest"
    ).select("source", "b1", "rest", "before")
    edge = store.keep(one, "edge")
    edge_ = edge.select(F.col("source").alias("_s"), F.col("b1").alias("e1"), "rest", F.col("before").alias("first"))
    inner = blocks.join(
        edge_,
        blocks.source.eqNullSafe(F.col("_s")) & (F.col("b1") == F.col("e1")),
    ).select("source", "b1", "b2", "tokens", "rest", "first")
    before = F.sum("tokens").over(Window.partitionBy("source").orderBy("b2").rowsBetween(Window.unboundedPreceding, -1))
    inner = inner.withColumn("before", F.col("first") + F.coalesce(before, F.lit(0))).where("before < rest and before + tokens >= rest")
    edges = store.keep(inner.select(F.col("source").alias("_s"), F.concat("b1", "b2").alias("edge"), F.col("before").alias("edge_before")), "edges")
    ends = F.broadcast(edges) if edges.count() <= 10_000 else edges  # at most one a source

    full = d.join(plan.withColumnRenamed("source", "_p"), d.source.eqNullSafe(F.col("_p")))
    full = full.join(ends, full.source.eqNullSafe(F.col("_s")), "left").withColumn("block", F.substring("key", 1, 6))
    at_edge = full.where("block = edge")
    before = F.sum("n_tokens").over(Window.partitionBy("source").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    at_edge = at_edge.withColumn("last", (F.col("edge_before") + F.coalesce(before, F.lit(0)) < F.col("rest")).cast("int"))
    others = full.where("edge is null or block <> edge").withColumn("last", F.coalesce(F.col("block") < F.col("edge"), F.lit(False)).cast("int"))
    taken = at_edge.unionByName(others).withColumn("times", F.col("passes") + F.col("last")).where("times > 0")
    return taken.select("doc_id", "source", "n_tokens", "weight", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("pass"))


def sql(docs: str = "documents", entropy: float = 0.995, repeats: float = 3.0, seed: str = "mix") -> str:
    """The same rows in DuckDB, with the documents' own tokens as the budget."""
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens, md5('{seed}:' || coalesce(doc_id::VARCHAR, '-' || md5(coalesce(text, '')))) AS key FROM {docs}
), t AS (SELECT source, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY source HAVING sum(n_tokens) > 0
), s AS (SELECT source, tokens, tokens / sum(tokens) OVER ()::DOUBLE AS share, sum(tokens) OVER () AS total, count(*) OVER () AS n FROM t
), e AS (
  SELECT 0 AS k, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
  UNION ALL
  SELECT k + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END FROM (
    SELECT e.k, e.lo, e.hi, (e.lo + e.hi) / 2 AS mid, (SELECT ln(sum(pow(share, (e.lo + e.hi) / 2))) - sum(pow(share, (e.lo + e.hi) / 2) * ln(pow(share, (e.lo + e.hi) / 2))) / sum(pow(share, (e.lo + e.hi) / 2)) >= {entropy} * ln(max(n)) FROM s) AS ok
    FROM e WHERE e.k < {STEPS})
), a0 AS (SELECT CASE WHEN (SELECT max(n) FROM s) > 1 THEN lo ELSE 0 END AS a FROM e WHERE k = {STEPS}
), r AS (
  SELECT 0 AS k, a AS lo, 1.0::DOUBLE AS hi FROM a0
  UNION ALL
  SELECT k + 1, CASE WHEN ok THEN lo ELSE mid END, CASE WHEN ok THEN mid ELSE hi END FROM (
    SELECT r.k, r.lo, r.hi, (r.lo + r.hi) / 2 AS mid, (SELECT max(total) * max(pow(share, (r.lo + r.hi) / 2) / tokens) / sum(pow(share, (r.lo + r.hi) / 2)) <= {repeats} FROM s) AS ok
    FROM r WHERE r.k < {STEPS})
), a AS (
  SELECT CASE WHEN (SELECT max(total) * max(pow(share, a0.a) / tokens) / sum(pow(share, a0.a)) FROM s) > {repeats} THEN (SELECT hi FROM r WHERE k = {STEPS}) ELSE a0.a END AS a FROM a0
), p AS (
  SELECT source, tokens, pow(share, a.a) / (SELECT sum(pow(share, a.a)) FROM s) AS weight, total FROM s, a
), b AS (SELECT source, tokens, weight, floor(weight * total + 0.5)::BIGINT AS budget FROM p
), o AS (
  SELECT d.*, b.weight, b.budget // b.tokens AS passes, b.budget % b.tokens AS rest,
    coalesce(sum(n_tokens) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, source, n_tokens, weight, unnest(range(0, (passes + CASE WHEN before < rest THEN 1 ELSE 0 END)::BIGINT))::INTEGER AS pass FROM o
"""
