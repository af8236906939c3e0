"""Folds over long arrays against plain Python, on both sides of the size from which they work in pieces."""

import random

from pyspark.sql import functions as F

from veilstream.functions.folds import apart, grow, outside, running
from veilstream.functions.matching import matches
from veilstream.operators.merge import merge, redact


def test_running_and_grow(spark):
    rng = random.Random(1)
    lists = [[rng.randint(0, 9) for _ in range(n)] for n in (0, 1, 2, 127, 128, 129, 700)]
    d = spark.createDataFrame([(x,) for x in lists], "x array<int>").coalesce(1)
    last = lambda acc: F.get(acc, F.size(acc) - 1)
    step = lambda acc, x: F.when((F.size(acc) > 0) & (last(acc) <= x), acc).otherwise(F.concat(acc, F.array(x)))
    got = d.select("x", running(F.col("x")).alias("r"), grow(F.col("x"), "int", step).alias("g")).collect()
    for r in got:
        assert r.r == [sum(r.x[:i]) for i in range(len(r.x))]
        kept = []
        for x in r.x:
            if not kept or kept[-1] > x:
                kept.append(x)
        assert r.g == kept


def test_apart_and_outside(spark):
    rng = random.Random(2)
    some = lambda n, size: sorted((s, s + rng.randint(1, size)) for s in (rng.randint(0, 20 * n + 5) for _ in range(n)))
    rows = [(some(n, 12), some(m, 30)) for n, m in ((0, 5), (5, 0), (20, 20), (300, 128), (300, 129), (400, 900), (900, 300))]
    kind = "array<struct<start:int,end:int>>"
    for r in spark.createDataFrame(rows, f"a {kind}, b {kind}").coalesce(1).select(
        "a",
        "b",
        apart(F.col("a"), F.col("b")).alias("apart"),
        outside(F.col("a"), F.col("b")).alias("outside"),
    ).collect():
        assert r["apart"] == [x for x in r.a if not any(y.start < x.end and x.start < y.end for y in r.b)]
        assert r.outside == [x for x in r.a if not any(y.start <= x.start and x.end <= y.end for y in r.b)]


def test_context_of_matches(spark):
    texts = ["", "12", "ab12cd345é", "1" * 3 + "x" * 60 + "2 3", "no digits"]
    d = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(
        "t",
        matches(F.col("t"), "[0-9]+", groups=False, context=True).alias("m"),
    )
    got = {r.t: [(m.text, m.start, m.before, m.after) for m in r.m] for r in d.collect()}
    assert got["ab12cd345é"] == [("12", 2, "ab", "c"), ("345", 6, "12cd", "é")]
    assert got["12"] == [("12", 0, "", "")] and got[""] == got["no digits"] == []
    assert got[texts[3]] == [("111", 0, "", "x"), ("2", 63, "x" * 40, " "), ("3", 65, "2 ", "")]


def test_many_matches_take_little_time(spark):
    import time

    text = "a1 " * 100_000
    d = spark.createDataFrame([(text,)], "t string")
    find = lambda df: df.select(F.size(matches(F.col("t"), "([a])([0-9])")).alias("n")).first().n
    find(d.limit(1).select(F.substring("t", 1, 9).alias("t")))  # compiled before
    began = time.perf_counter()
    assert find(d) == 100_000
    assert time.perf_counter() - began < 15  # minutes, if it were quadratic


def test_merge_of_many_spans(spark):
    rng = random.Random(3)
    spans = [
        (
            s,
            s + rng.randint(1, 9),
            rng.choice(["secret", "pii"]),
            rng.choice(["regex", "parser_rule", "opf"]),
        ) for s in (rng.randint(0, 3000) for _ in range(600))
    ]
    kind = "start:int,end:int,label:string,kind:string,source:string,score:double,reason_codes:array<string>,text:string,placeholder:string"
    row = [(s, e, label, "k", source, 0.5, [], None, None) for s, e, label, source in spans]
    got = spark.createDataFrame([(row,)], f"s array<struct<{kind}>>").select(merge(F.col("s")).alias("m")).first().m

    def rank(x):
        s, e, label, source = x
        return ({"parser_rule": 3, "regex": 2}.get(source, 1), s - e) if label == "secret" else (0, e - s)

    kept = []
    for x in sorted(spans, key=lambda x: (x[0], x[1], -rank(x)[0], -rank(x)[1])):
        if not kept or x[0] >= kept[-1][1]:
            kept.append(x)
        elif rank(x) > rank(kept[-1]):
            kept[-1] = x
    assert [(m.start, m.end, m.label) for m in got] == [x[:3] for x in kept]


def test_redaction_of_many_spans(spark):
    rng = random.Random(4)
    kind = "start:int,end:int,label:string,kind:string,source:string,score:double,reason_codes:array<string>,text:string,placeholder:string"
    rows = []
    for n in (0, 1, 128, 129, 500):
        text = "".join(rng.choice("ab é😀") for _ in range(3000))
        spans = [(s, s + rng.randint(1, 9), rng.choice(["secret", "pii"])) for s in (rng.randint(0, 2980) for _ in range(n))]
        rows.append((text, [(s, e, label, "k", "regex", 0.5, [], None, None) for s, e, label in spans]))
    d = spark.createDataFrame(rows, f"t string, s array<struct<{kind}>>").coalesce(1)
    for r in d.select("t", "s", redact(F.col("t"), F.col("s")).alias("r")).collect():
        out, pos = "", 0
        for x in sorted(r.s, key=lambda x: x.start):
            if x.start >= pos:
                out, pos = out + r.t[pos : x.start] + ("<SECRET>" if x.label == "secret" else "<REDACTED>"), x.end
        assert r.r == out + r.t[pos:]
