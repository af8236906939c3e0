"""Secret candidates from structured fragments.

The exact generator is not public; this is a contract inferred from observable results, kept in one file so that it can be
replaced. A fragment gives at most one span, by the first test that holds: PEM block, JWT, database URL (its password),
API-key shape, Bearer header, session cookie, secret key name with a random value, log sentence.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilstream.functions.spans import SPANS, span
from veilstream.functions.validity import entropy, valid_jwt
from veilstream.operators.rules import NOT_S, SECRET_RULES

KEYS = [
    "token",
    "api_key",
    "access_token",
    "refresh_token",
    "client_secret",
    "secret_key",
    "webhook_secret",
    "signing_secret",
    "app_secret",
    "auth_token",
]
SHAPES = "|".join(r.pattern.removeprefix("(?Ud)()") for r in SECRET_RULES if r.kind == "api_key")
DB = rf"(?iuUd)^([a-z]*?(?:postgres|postgresql|mysql|mongodb(?:\+srv)?)://[^:{NOT_S}]+:)([^@{NOT_S}]+)@[^/{NOT_S}]+/[^{NOT_S}]+$"


def candidates(fragments: Column, mode: str | Column = "balanced") -> Column:
    def one(f: Column) -> Column:
        value = F.coalesce(f["value"], f["candidate_value"])
        where = F.coalesce(f["value_span"], f["candidate_span"])
        name = F.lower(F.replace(F.coalesce(f["key"], f["cookie_name"], f["header_name"], F.lit("")), F.lit("-"), F.lit("_")))
        listed = name.rlike(f"(?:{'|'.join(KEYS)})$")

        def hit(kind: str, score: float, *reasons: str, start: Column | None = None, text: Column | None = None) -> Column:
            begin, what = where["start"] if start is None else start, value if text is None else text
            return span(begin, begin + F.length(what), what, "secret", kind, "parser_rule", score, ["structure_match", *reasons])

        password = F.regexp_extract(value, DB, 2)
        tests = [
            (
                value.rlike(r"(?d)^-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]+-----END [A-Z ]*PRIVATE KEY-----$"),
                hit("private_key", 0.95, "value_shape_match"),
            ),
            (
                value.rlike(r"(?d)^eyJ[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}$") & valid_jwt(value),
                hit("jwt", 0.9, "value_shape_match"),
            ),
            (
                value.rlike(DB),
                hit("db_connection", 0.9, "value_shape_match", start=where["start"] + F.length(F.regexp_extract(value, DB, 1)), text=password),
            ),
            (value.rlike(f"(?Ud)^(?:{SHAPES})$"), hit("api_key", 0.9, "value_shape_match")),
            ((F.lower(f["auth_scheme"]) == "bearer") & value.rlike(r"(?d)^[A-Za-z0-9._=-]{12,}$"), hit("bearer", 0.8, "key_name_match")),
            (
                F.lower(f["cookie_name"]).isin("sessionid", "session", "connect.sid", "sid") & (F.length(value) >= 8),
                hit("session", 0.8, "key_name_match"),
            ),
            (listed & value.rlike(rf"(?Ud)^[^{NOT_S}]{{12,}}$") & (entropy(value) >= 3.2), hit("token", 0.75, "key_name_match", "value_shape_match")),
            ((f["structure_kind"] == "log_sentence") & F.length(value).between(4, 10), hit("verification_code", 0.65, "context_match")),
        ]
        out = None
        for test, got in tests:
            out = F.when(test, got) if out is None else out.when(test, got)
        return out

    found = F.filter(F.transform(fragments, one), lambda s: s.isNotNull()).cast(SPANS)
    if isinstance(mode, str):
        return F.filter(found, lambda s: s["score"] >= 0.8) if mode == "high_precision" else found
    return F.filter(found, lambda s: (mode != "high_precision") | (s["score"] >= 0.8) | mode.isNull())
