"""Personal data by weak supervision.

Base spans (email, ip, card, phone) are fixed patterns and always stay. Wider candidates (other email, IPv6, 12 to 19
digit and national phone shapes) and the base spans are voted on by five labelers: strict pattern, validity check,
gazetteer, context words before the span, and the characters around it. Each votes yes, no or abstains, so a kind has
at most 243 vote patterns; their counts over all documents, an aggregate of at most 4 * 243 rows, are all that the
driver reads. Expectation-maximisation on these counts gives each labeler's reliability and each pattern's posterior;
a logistic classifier on the votes is fitted to the posteriors and applied as a Catalyst expression. Candidates that it
accepts and that overlap no base span are added.

Null and empty texts have no spans; whole texts are read; each input row gives one row, repeated ones too; other
columns are ignored; an empty table gives no rows. Spans go by kind, then start; of wider candidates that overlap each other all stay.
With no candidates at all nothing is fitted and nothing added.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilstream.functions.folds import apart
from veilstream.functions.matching import matches
from veilstream.llm.secretscan import joined, of_kind
from veilstream.llm.store import Store

KINDS = ["email", "ip", "card", "phone"]
# Possessive forms of the base patterns: the same matches, without backtracking or recursion on long runs.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: kind -> (pattern, what a text must hold for it to match)
WIDE = {
    "email": (r"(?<![^\s@<>()\[\],;:\"])[^\s@<>()\[\],;:\"]++(?:@|\x20?[\[(]at[\])]\x20?)[^\s@<>()\[\],;:\"]++", r"@|[\[(]at[\])]"),
    "ip": (r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])", ":"),
    "card": (r"(?<![0-9])[0-9](?:[\x20./-]?[0-9]){11,18}(?![0-9])", "[0-9]"),
    "phone": (r"(?<![0-9])(?:\(?[0-9]{3}\)?[\x20.-]){2}[0-9]{4}(?![0-9])|(?<![0-9])00[1-9](?:[\x20-]?[0-9]){7,12}(?![0-9])", "[0-9]"),
}
GAZETTEER = {
    "email": r"(?i)\.(?:com|org|net|edu|gov|info|io|eu|de|fr|es|uk)$",
    "ip": r"^(?:10|127|192\.168|fe80|2001|fd)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)",
    "phone": r"^(?:\+|00|\(?[2-9][0-9]{2}\)?)",
}
STRICT = {
    "email": r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$",
    "ip": r"^(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|[0-9A-Fa-f:]{15,39})$",
    "card": r"^[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}$",
    "phone": r"^(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}$",
}
CONTEXT = r"(?i)(?:e-?mail|contact|correo|courriel|tel|phone|call|fax|mobil|card|visa|karte|carte|tarjeta|\bip\b|host|server|address)[^\n]{0,20}$"
LABELERS = 5
STRUCT = "array<struct<kind:int,start:int,end:int,base:boolean,votes:array<int>>>"


def luhn(value: Column) -> Column:
    digits = F.reverse(F.regexp_replace(value, "[^0-9]", ""))
    total = F.aggregate(
        F.split(digits, ""),
        F.struct(F.lit(0).alias("i"), F.lit(0).alias("s")),
        lambda acc, c: F.struct(
            (acc["i"] + 1).alias("i"),
            (
                acc["s"] + F.when(acc["i"] % 2 == 0, c.cast("int")).otherwise(F.floor(c.cast("int") * 2 / 10).cast("int") + c.cast("int") * 2 % 10)
            ).alias("s"),
        ),
        lambda acc: acc["s"],
    )
    return (F.length(digits) > 0) & (total % 10 == 0)


def _n_digits(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", ""))


def _octets(value: Column) -> Column:
    return F.forall(
        F.split(value, r"\."),
        lambda p: (F.length(F.regexp_replace(p, "^0+(?=.)", "")) <= 3) & (F.substring(F.regexp_replace(p, "^0+(?=.)", ""), 1, 3).cast("int") <= 255),
    )


def base(t: Column) -> dict[str, Column]:
    digits = matches(t, CARD, groups=False, context=True)
    return {
        "email": matches(t, EMAIL, groups=False, context=True, needs="@"),
        "ip": F.filter(matches(t, IP, groups=False, context=True), lambda x: _octets(x["text"])),
        "card": F.filter(digits, lambda x: _n_digits(x["text"]).between(16, 19) & luhn(x["text"])),
        "phone": F.filter(matches(t, PHONE, groups=False, context=True, needs="+"), lambda x: _n_digits(x["text"]).between(8, 15)),
    }


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, 2).otherwise(0)


def _valid(kind: str, v: Column) -> Column:
    return {
        "email": _vote(v.rlike(r"\.[A-Za-z]{2,}$"), ~v.contains("@")),
        "ip": _vote(v.contains(":") | v.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), F.lit(False)),
        "card": _vote(luhn(v) & _n_digits(v).between(13, 19), ~luhn(v)),
        "phone": _vote(_n_digits(v).between(8, 15), ~_n_digits(v).between(7, 15)),
    }[kind]


def _voted(found: Column, kind: str, is_base: bool) -> Column:
    def one(x: Column) -> Column:
        v = x["text"]
        before, after = x["before"], x["after"]
        votes = F.array(
            _vote(v.rlike(STRICT[kind]), ~v.rlike(STRICT[kind])),
            _valid(kind, v),
            _vote(v.rlike(GAZETTEER[kind]), F.lit(False)),
            _vote(before.rlike(CONTEXT), F.lit(False)),
            _vote(F.lit(False), before.rlike(r"[\w@/=-]$") | after.rlike(r"^[\w@/=-]")),
        )
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"),
            x["start"].alias("start"),
            x["end"].alias("end"),
            F.lit(is_base).alias("base"),
            votes.alias("votes"),
        )

    return F.transform(found, one).cast(STRUCT)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, found: base spans and, where they overlap none of any kind, wider candidates, with their votes."""
    t = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", t.alias("text"))
    t = F.col("text")
    d = d.withColumn("base", F.concat(*[_voted(m, k, True) for k, m in base(t).items()]))
    none = F.array().cast(STRUCT)
    wide = F.concat(
        *[F.when(t.rlike(needs), _voted(matches(t, p, groups=False, context=True), k, False)).otherwise(none) for k, (p, needs) in WIDE.items()]
    )
    d = d.withColumn("wide", F.when(t.rlike("|".join(needs for _, needs in WIDE.values())), wide).otherwise(none))
    return d.select("doc_id", F.concat("base", apart(F.col("wide"), F.col("base"))).alias("found"))


def estimate(counts: list[tuple[int, list[int], int]], steps: int = 40) -> tuple[dict[tuple, float], list[dict[int, list[float]]]]:
    """EM over (kind, votes, count): each pattern's posterior, and each labeler's chance of each vote if wrong / right."""
    prior = {k: 0.6 for k, _, _ in counts}
    chance = [{0: [0.4, 0.4], 1: [0.15, 0.5], 2: [0.45, 0.1]} for _ in range(LABELERS)]
    post: dict[tuple, float] = {}
    for _ in range(steps):
        for k, votes, _ in counts:
            log = math.log(prior[k] / (1 - prior[k])) + sum(math.log(c[v][1] / c[v][0]) for c, v in zip(chance, votes, strict=True))
            post[k, tuple(votes)] = 1 / (1 + math.exp(-max(-30.0, min(30.0, log))))
        for k in prior:
            own = [(post[k, tuple(v)], n) for kk, v, n in counts if kk == k]
            prior[k] = min(0.95, max(0.05, (sum(p * n for p, n in own) + 1) / (sum(n for _, n in own) + 2)))
        for i, c in enumerate(chance):
            for right in (0, 1):
                mass = {
                    v: 2.0 * (0.2 if v == 0 else 0.5 if (v == 1) == bool(right) else 0.3) for v in (0, 1, 2)
                }  # a weak belief that labelers are better than chance
                for k, votes, n in counts:
                    p = post[k, tuple(votes)]
                    mass[votes[i]] += n * (p if right else 1 - p)
                total = sum(mass.values())
                for v in mass:
                    c[v][right] = mass[v] / total
    return post, chance


def fit(counts: list[tuple[int, list[int], int]], post: dict[tuple, float], steps: int = 300) -> list[float]:
    """Logistic weights over one-hot votes and kinds, fitted to the posteriors by gradient descent."""
    width = 3 * LABELERS + len(KINDS)
    rows = [([3 * i + v for i, v in enumerate(votes)] + [3 * LABELERS + k], post[k, tuple(votes)], math.log1p(n)) for k, votes, n in counts]
    w, total = [0.0] * width, sum(r[2] for r in rows) or 1.0
    for _ in range(steps):
        g = [1e-3 * x for x in w]
        for on, p, n in rows:
            e = (1 / (1 + math.exp(-sum(w[j] for j in on))) - p) * n / total
            for j in on:
                g[j] += e
        w = [x - 2.0 * y for x, y in zip(w, g, strict=True)]
    return w


def find(docs: DataFrame, least: float = 0.6) -> DataFrame:
    """doc_id, base and spans: arrays of (kind, start, end, ...) by kind, then start."""
    found = Store(docs.sparkSession, "pii").keep(candidates(docs), "found")
    counts = [
        (r.kind, r.votes, r.n) for r in found.select(F.explode("found").alias("x")).groupBy("x.kind", "x.votes").agg(F.count("*").alias("n")).collect()
    ]
    w = fit(sorted(counts), estimate(sorted(counts))[0]) if counts else [0.0] * (3 * LABELERS + len(KINDS))
    weights = F.array(*[F.lit(x) for x in w])

    def accepted(x: Column) -> Column:
        z = F.get(weights, x["kind"] + 3 * LABELERS)
        for i in range(LABELERS):
            z = z + F.get(weights, F.get(x["votes"], F.lit(i)) + 3 * i)
        return x["base"] | (1 / (1 + F.exp(-z)) >= least)

    order = lambda a: F.array_sort(
        F.transform(a, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    )
    return found.select("doc_id", order(F.filter("found", lambda x: x["base"])).alias("base"), order(F.filter("found", accepted)).alias("spans"))


def digest(docs: DataFrame) -> DataFrame:
    s = find(docs)
    counts = [of_kind(F.col("base"), i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return s.select(
        "doc_id",
        *counts,
        F.sha2(joined(F.col("base"), KINDS).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans"), KINDS).alias("spans"),
    )
