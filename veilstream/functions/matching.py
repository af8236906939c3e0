"""All non-overlapping matches of a pattern with code-point offsets, as Catalyst expressions.

Spark has no find-all with offsets. The pieces between matches (split) and the matches themselves (regexp_extract_all)
alternate, so summing their lengths gives every offset; length() counts code points. The work grows with the text and, but for
a small part, with the number of matches.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilstream.functions.folds import let, running

MATCH = "struct<start:int,end:int,text:string,at:int,upto:int>"
MATCH_IN_CONTEXT = "struct<start:int,end:int,text:string,at:int,upto:int,before:string,after:string>"
#: Characters before a match that are its context.
BEFORE = 40


def matches(
    text: Column,
    pattern: str,
    groups: bool = True,
    needs: str | tuple[str, ...] = (),
    gate: str | None = None,
    context: bool = False,
) -> Column:
    """Array of (start, end, text, at, upto): the value's offsets and text, and the offsets of the whole match.

    With groups, the pattern has the form (prefix)(value)suffix with no other groups; else the value is the whole
    match. needs, gate: literals and a cheap pattern, without any of which nothing can match. context: with before, up to
    BEFORE characters, no further back than the match before, and after, the next character. Null text gives an empty array. The
    pattern must not match the empty string.
    """
    kind = MATCH_IN_CONTEXT if context else MATCH
    p = F.lit(pattern)
    whole, gaps = F.regexp_extract_all(text, p, F.lit(0)), F.split(text, pattern, -1)
    if groups:
        zipped = F.arrays_zip(
            whole.alias("m"),
            F.regexp_extract_all(text, p, F.lit(1)).alias("p"),
            F.regexp_extract_all(text, p, F.lit(2)).alias("v"),
            gaps.alias("g"),
        )
    else:
        zipped = F.arrays_zip(whole.alias("m"), gaps.alias("g"))

    def found(all_: Column) -> Column:
        # the last gap has no match after it
        return let(F.slice(all_, F.lit(1), F.size(all_) - 1), lambda pieces: placed(pieces, all_))

    def placed(pieces: Column, all_: Column) -> Column:
        starts = running(F.transform(pieces, lambda x: F.length(x["g"]) + F.length(x["m"])))

        def one(x: Column, before: Column) -> Column:
            at = before + F.length(x["g"])
            start = at + F.length(x["p"]) if groups else at
            value = x["v"] if groups else x["m"]
            fields = [
                start.alias("start"),
                (start + F.length(value)).alias("end"),
                value.alias("text"),
                at.alias("at"),
                (at + F.length(x["m"])).alias("upto"),
            ]
            return F.struct(*fields, x["before"].alias("before"), x["after"].alias("after")) if context else F.struct(*fields)

        return F.zip_with(beside(pieces, all_) if context else pieces, starts, one).cast(f"array<{kind}>")

    def beside(pieces: Column, all_: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            last, following = F.coalesce(F.get(all_, i - 1)["m"], F.lit("")), F.get(all_, i + 1)
            before = F.right(F.concat(last, x["g"]), F.lit(BEFORE))
            after = F.substring(F.concat(following["g"], F.coalesce(following["m"], F.lit(""))), 1, 1)
            return F.struct(*[x[c].alias(c) for c in (("m", "p", "v", "g") if groups else ("m", "g"))], before.alias("before"), after.alias("after"))

        return F.transform(pieces, one)

    all_ = let(zipped, found)
    literals = (needs,) if isinstance(needs, str) else needs
    tests = [text.contains(x) for x in literals] + ([text.rlike(gate)] if gate else [])
    able = functools.reduce(operator.or_, tests) if tests else text.isNotNull()
    return F.when(able & text.rlike(pattern), all_).otherwise(F.array().cast(f"array<{kind}>"))
