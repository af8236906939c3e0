"""Secret scan: three base patterns, and sliding-window Shannon entropy over candidate strings.

Base kinds, each leftmost and non-overlapping: `assign` (a keyword, a separator, a value of 8 or more characters),
`access` (AKIA...), `hex` (32 or more). A candidate string is a run of 20 or more of [A-Za-z0-9+/_=-]; its class is
hex, upper- or lower-case alphanumeric, or mixed, and without digits one letter case or letters. The entropy of every
window is kept by incremental counts: one character enters, one leaves, and the sum of c*log2(c) changes by those two
counts. A candidate takes time in proportion to its length. A candidate whose best window reaches its class's threshold becomes a span of kind `entropy`, unless the
allow-list suppresses it or it lies within a base span. One that holds or crosses a base span is kept whole.

All of it is Catalyst expressions. Null and empty texts have no spans; texts are scanned whole; each input row gives one
row, repeated ids included; an empty table gives none. Other columns stay as they are; spans of one start go by kind.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilstream.functions.folds import grow, let, outside, replaced
from veilstream.functions.matching import matches

KINDS = ["assign", "access", "hex", "entropy"]
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"  # a maximal run, as [0-9a-f]+ of 32 or more
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"

#: class -> (pattern of the class, window, least entropy in bits)
CLASSES = {
    "hex": (r"^[0-9a-fA-F]+$", 24, 3.0),
    "lower": (r"^[a-z0-9]+$", 20, 3.6),
    "upper": (r"^[A-Z0-9]+$", 20, 3.6),
    "mixed": (r"[A-Z].*[a-z]|[a-z].*[A-Z]", 20, 3.7),
}
#: The same for candidates without a digit; stricter, as words are among them.
LETTERS = {"case": (r"^(?:[a-z]++|[A-Z]++)$", 20, 3.7), "letters": (r"[A-Z].*[a-z]|[a-z].*[A-Z]", 20, 3.8)}
#: Pieces of words joined by separators or capitals (paths, identifiers); where they make up the whole, it is allowed.
PIECE = r"[+/_=-]++|(?<![A-Za-z])[a-z]++|(?<![A-Za-z])[A-Z]++(?![a-z])|[A-Z]{1,4}[a-z]{2,}+"
ALLOWED = [
    r"(?i)example|sample|dummy|placeholder|changeme|lorem|test",
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",  # UUID
    r"^[0-9+/_=-]+$",  # numbers and dates
    r"^(.)\1+$",
    r"^(?!.*[_/-][_/=-])[A-Za-z][A-Za-z_/-]*=?[0-9]{1,4}$",  # words joined, with a number
]

#: The codes of a candidate's characters ('+' to 'z'), and the character that stands for a count of none.
LOWEST, HIGHEST, NONE = 43, 122, 33

#: Names of the added columns, unlikely among a table's own.
BASE, SECRETS, CANDIDATES = "_veil_base", "_veil_secrets", "_veil_candidates"
SPANS = "array<struct<kind:int,start:int,end:int>>"


def _weight(c: int) -> int:
    """c*log2(c) in units of 2^-40: sums of integers don't drift."""
    return round(c * math.log2(c) * 2**40) if c else 0


def window_entropy(value: Column, width: int) -> Column:
    """The largest Shannon entropy (bits) of a window of `width` characters; of the whole value if it is shorter.

    value is of the alphabet of candidates. The counts are a string with one character for each of the alphabet's codes; a
    step replaces two of them, so a value takes time in proportion to its length."""
    gain = F.array(*[F.lit(_weight(c + 1) - _weight(c)) for c in range(width + 1)])  # what one more adds to c equal ones
    place = lambda c: F.ascii(c) - (LOWEST - 1)
    count = lambda counts, c: F.ascii(F.substring(counts, place(c), F.lit(1))) - NONE
    with_count = lambda counts, c, n: F.overlay(counts, F.char(n + NONE), place(c))

    def step(acc: Column, x: Column, w: Column) -> Column:
        def leave(n: Column) -> Column:
            return F.struct(
                with_count(acc["counts"], x["old"], n - 1).alias("counts"),
                (acc["total"] - F.get(gain, n - 1)).alias("total"),
                acc["size"].alias("size"),
            )

        def enter(left: Column) -> Column:
            def add(n: Column) -> Column:
                total = left["total"] + F.get(gain, n)
                least = F.when(left["size"] + 1 == w, F.least(acc["least"], total)).otherwise(acc["least"])
                return F.struct(
                    with_count(left["counts"], x["new"], n + 1).alias("counts"),
                    total.alias("total"),
                    (left["size"] + 1).alias("size"),
                    least.alias("least"),
                )

            return let(count(left["counts"], x["new"]), add)

        same = F.struct(acc["counts"].alias("counts"), acc["total"].alias("total"), acc["size"].alias("size"))
        gone = let(count(acc["counts"], x["old"]), leave)
        return let(
            F.when(x["old"].isNull(), same).otherwise(
                F.struct(gone["counts"].alias("counts"), gone["total"].alias("total"), (gone["size"] - 1).alias("size"))
            ),
            enter,
        )

    def fold(chars: Column, w: Column) -> Column:
        old = F.concat(F.array_repeat(F.lit(None).cast("string"), w), F.slice(chars, F.lit(1), F.greatest(F.size(chars) - w, F.lit(0))))
        start = F.struct(
            F.lit(chr(NONE) * (HIGHEST - LOWEST + 1)).alias("counts"),
            F.lit(0).cast("long").alias("total"),
            F.lit(0).alias("size"),
            F.lit(2**62).alias("least"),
        )
        return F.aggregate(
            F.arrays_zip(chars.alias("new"), old.alias("old")),
            start,
            lambda acc, x: step(acc, x, w),
            lambda acc: F.log2(w.cast("double")) - acc["least"] / F.lit(2.0**40) / w,
        )

    whole = let(F.least(F.length(value), F.lit(width)), lambda w: let(F.split(value, ""), lambda chars: fold(chars, w)))
    return F.when(F.length(value) > 0, whole).otherwise(0.0)


def _spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda x: F.struct(F.lit(KINDS.index(kind)).alias("kind"), x["at"].alias("start"), x["upto"].alias("end"))).cast(SPANS)


def _high(value: Column, classes: dict[str, tuple[str, int, float]]) -> Column:
    high = None
    for pattern, width, least in classes.values():
        test = value.rlike(pattern), (F.length(value) >= width) & (window_entropy(value, width) >= least)
        high = F.when(*test) if high is None else high.when(*test)
    return high.otherwise(False)


def is_random(value: Column) -> Column:
    """Whether a candidate's best window reaches the threshold of its class and no allow-list entry matches."""
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | value.rlike(pattern)
    joined_words = ~value.rlike(LETTERS["case"][0]) & (F.regexp_replace(value, PIECE, "") == "")
    letters = ~value.rlike(ALLOWED[0]) & ~joined_words & _high(value, LETTERS)
    return F.when(value.rlike("[0-9]"), ~allowed & _high(value, CLASSES)).otherwise(letters)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with BASE and SECRETS (base and entropy), arrays of (kind, start, end) by start, then kind."""
    t = F.coalesce(F.col(text), F.lit(""))
    assign = F.filter(matches(t, ASSIGN), lambda x: F.length(x["text"]) >= 8)
    access = F.filter(matches(t, ACCESS, groups=False, needs="AKIA"), lambda x: F.length(x["text"]) >= 16)
    found = F.concat(_spans(assign, "assign"), _spans(access, "access"), _spans(matches(t, HEX, groups=False), "hex"))
    by_start = lambda a: F.transform(
        F.array_sort(F.transform(a, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))),
        lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")),
    )
    out = docs.withColumn(BASE, by_start(found)).withColumn(CANDIDATES, matches(t, CANDIDATE, groups=False))
    extra = F.filter(outside(F.col(CANDIDATES), F.col(BASE)), lambda c: is_random(c["text"]))
    return out.withColumn(SECRETS, by_start(F.concat(BASE, _spans(extra, "entropy")))).drop(CANDIDATES)


def joined(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))),
        ",",
    )


def of_kind(spans: Column, kind: int) -> Column:
    """The number of spans of a kind."""
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def redact(text: Column, spans: Column, with_: str) -> Column:
    """text with each span replaced; overlapping spans by one replacement. spans are sorted by start."""
    kind = "struct<start:int,end:int>"

    def step(acc: Column, x: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        both = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        shorter = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when((F.size(acc) > 0) & (x["start"] < last["end"]), F.concat(shorter, F.array(both))).otherwise(F.concat(acc, F.array(x)))

    plain = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).cast(f"array<{kind}>")
    done = replaced(F.coalesce(text, F.lit("")), grow(plain, kind, step), lambda _: F.lit(with_))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def digest(docs: DataFrame) -> DataFrame:
    """The scan's columns of one document a row: counts, the base spans' SHA-256 and all spans."""
    s = scan(docs.select(F.col("doc_id"), "text"))
    counts = [of_kind(F.col(BASE), i).alias(f"n_{KINDS[i]}") for i in range(3)]
    return s.select(
        "doc_id",
        *counts,
        F.sha2(joined(F.col(BASE), KINDS).cast("binary"), 256).alias("base_sha256"),
        joined(F.col(SECRETS), KINDS).alias("spans"),
    )
