"""Folds over long arrays whose result is itself an array, as Catalyst expressions.

aggregate() with a growing array copies the array for each element. Here arrays are worked on in pieces of CHUNK
elements, so that only a piece and the list of finished pieces are copied.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 128


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once, also where use puts it into a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def chunks(items: Column) -> Column:
    """items (a column or variable, evaluated for each piece) as an array of arrays of at most CHUNK elements."""
    n = F.ceil(F.size(items) / F.lit(CHUNK)).cast("int")
    return F.transform(
        F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.slice(items, i * CHUNK + 1, F.lit(CHUNK)),
    )


def _sums(lengths: Column, first: Column) -> Column:
    """first, first + l0, first + l0 + l1, ..."""
    return F.aggregate(lengths, F.array(first), lambda acc, n: F.concat(acc, F.array(F.get(acc, F.size(acc) - 1) + n)))


def running(lengths: Column) -> Column:
    """For an array of ints, the sum of what stands before each element; array<int> of the same size."""

    def long_(all_: Column) -> Column:
        def pieces(parts: Column) -> Column:
            totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda acc, n: acc + n))
            firsts = F.slice(_sums(totals, F.lit(0)), F.lit(1), F.size(parts))
            return F.flatten(F.zip_with(parts, firsts, lambda p, first: F.slice(_sums(p, first), F.lit(1), F.size(p))))

        return F.when(F.size(all_) <= CHUNK, F.slice(_sums(all_, F.lit(0)), F.lit(1), F.size(all_))).otherwise(let(chunks(all_), pieces))

    return let(lengths.cast("array<int>"), long_)


def grow(items: Column, kind: str, step: Callable[[Column, Column], Column]) -> Column:
    """aggregate(items, [], step) as an array of `kind`, for a step (list, item) that looks at the last element of the list
    only, keeps or replaces it, and appends items or none."""
    none = F.array().cast(f"array<{kind}>")

    def outer(acc: Column, piece: Column) -> Column:
        def split(now: Column) -> Column:
            done = F.when(F.size(now) > 1, F.concat(acc["done"], F.array(F.slice(now, F.lit(1), F.size(now) - 1)))).otherwise(acc["done"])
            return F.struct(done.alias("done"), F.slice(now, F.greatest(F.size(now), F.lit(1)), F.lit(1)).alias("open"))

        return let(F.aggregate(piece, acc["open"], step), split)

    def whole(all_: Column) -> Column:
        start = F.struct(F.array().cast(f"array<array<{kind}>>").alias("done"), none.alias("open"))
        long_ = F.aggregate(chunks(all_), start, outer, lambda acc: F.concat(F.flatten(acc["done"]), acc["open"]))
        return F.when(F.size(all_) <= CHUNK, F.aggregate(all_, none, step)).otherwise(long_)

    return let(items, whole)


def apart(spans: Column, others: Column) -> Column:
    """Those of spans (structs with start and end) that overlap none of others. Many others are made disjoint and looked up by
    pieces, so that a long text with many of both does not compare all with all."""
    overlap = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    few = F.filter(spans, lambda s: ~F.exists(others, lambda o: overlap(s, o)))
    kind = "struct<start:int,end:int>"

    def join(acc: Column, x: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        both = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        shorter = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when((F.size(acc) > 0) & (x["start"] < last["end"]), F.concat(shorter, F.array(both))).otherwise(F.concat(acc, F.array(x)))

    def many(parts: Column) -> Column:
        def clear(ends: Column) -> Column:
            # of the first piece that ends after a span's start, one interval is the first to do so
            return F.filter(
                spans,
                lambda s: ~F.coalesce(
                    F.exists(F.get(parts, F.size(F.filter(ends, lambda e: e <= s["start"]))), lambda o: overlap(s, o)),
                    F.lit(False),
                ),
            )

        return let(F.transform(parts, lambda p: F.get(p, F.size(p) - 1)["end"]), clear)

    plain = F.array_sort(F.transform(others, lambda o: F.struct(o["start"].alias("start"), o["end"].alias("end"))).cast(f"array<{kind}>"))
    return F.when(F.size(others) <= CHUNK, few).otherwise(let(grow(plain, kind, join), lambda merged: let(chunks(merged), many)))


def outside(spans: Column, others: Column) -> Column:
    """Those of spans that lie within none of others, which go by start. Many others are looked up by pieces of those that lie
    in no other."""
    within = lambda s, o: (o["start"] <= s["start"]) & (s["end"] <= o["end"])
    few = F.filter(spans, lambda s: ~F.exists(others, lambda o: within(s, o)))
    kind = "struct<start:int,end:int>"

    def widest(acc: Column, x: Column) -> Column:
        return F.when((F.size(acc) == 0) | (x["end"] > F.get(acc, F.size(acc) - 1)["end"]), F.concat(acc, F.array(x))).otherwise(acc)

    def many(parts: Column) -> Column:
        def clear(starts: Column) -> Column:
            # both starts and ends rise, so the last that starts before a span reaches furthest
            return F.filter(
                spans,
                lambda s: ~F.coalesce(
                    F.exists(F.get(parts, F.size(F.filter(starts, lambda x: x <= s["start"])) - 1), lambda o: within(s, o)),
                    F.lit(False),
                ),
            )

        return let(F.transform(parts, lambda p: F.get(p, F.lit(0))["start"]), clear)

    plain = F.array_sort(F.transform(others, lambda o: F.struct(o["start"].alias("start"), (-o["end"]).alias("end"))).cast(f"array<{kind}>"))
    turned = F.transform(plain, lambda o: F.struct(o["start"].alias("start"), (-o["end"]).alias("end"))).cast(f"array<{kind}>")
    return F.when(F.size(others) <= CHUNK, few).otherwise(let(grow(turned, kind, widest), lambda w: let(chunks(w), many)))


def replaced(text: Column, cuts: Column, put: Callable[[Column], Column]) -> Column:
    """text with put(cut) in place of each of cuts (structs with start and end, disjoint, by start). Each substring() reads from
    the text's begin, so for many cuts the text is taken apart once."""

    def whole(all_: Column, between: Callable[[Column, Column], Column]) -> Column:
        end = lambda i: F.coalesce(F.get(all_, i)["end"], F.lit(0))
        pieces = F.transform(all_, lambda x, i: F.concat(between(F.when(i > 0, end(i - 1)).otherwise(0), x["start"]), put(x)))
        return F.concat(F.array_join(pieces, ""), between(end(F.size(all_) - 1), F.length(text)))

    few = lambda all_: whole(all_, lambda a, b: F.substring(text, a + 1, b - a))
    many = lambda all_: let(F.split(text, ""), lambda c: whole(all_, lambda a, b: F.array_join(F.slice(c, a + 1, F.greatest(b - a, F.lit(0))), "")))
    return let(cuts, lambda all_: F.when(F.size(all_) <= CHUNK, few(all_)).otherwise(many(all_)))
