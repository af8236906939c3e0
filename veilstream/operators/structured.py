"""Line-oriented structure: assignments, headers, cookies, JSON and YAML pairs, log sentences.

A line's parsers are tried in a fixed order and the first that recognises the line provides its fragments. Every parser
captures all gaps, so offsets are sums of group lengths.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilstream.functions.folds import let, running
from veilstream.functions.matching import matches
from veilstream.operators.rules import NOT_S, S

KEY = "[A-Za-z_][A-Za-z0-9_-]*"
# The shapes of recognised lines, every part a group.
ASSIGNMENT = rf"""(?Ud)^([+ -]?)(export{S}+)?([A-Za-z_][A-Za-z0-9_]*)({S}*={S}*)(['"]?)(.*?)\5$"""
BEARER = rf"(?iuUd)^(Authorization)(:{S}+)(Bearer)({S}+)(.+)$"
API_HEADER = rf"(?iuUd)^(X-API-Key|X-Auth-Token|X-Access-Token|X-Secret-Key|X-Client-Secret)(:{S}+)(.+)$"
SENTENCE = rf"(?iuUd)^(verification code is|OTP:|动态口令为：)({S}*)([A-Za-z0-9-]+)$"
COOKIE = rf"(?iuUd)^(Cookie|Set-Cookie)(:{S}+)"
COOKIE_PAIR = rf"(?Ud)({KEY}=)([^;{NOT_S}]+)"
JSON_PAIR = rf'(?Ud)("{KEY}":{S}*)("[^"]*"|[^{NOT_S},\}}]+)'
YAML_PAIR = rf"(?Ud)^({KEY})(:{S}+)(.+)$"

_P = "struct<start:int,end:int>"
FIELDS = {
    "structure_kind": "string", "raw_fragment": "string", "fragment_span": _P, "prefix": "string", "key": "string", "separator": "string", "value": "string", "quote_char": "string", "line_span": _P, "value_span": _P,
    "header_name": "string", "auth_scheme": "string", "cookie_name": "string", "container_kind": "string", "context_phrase": "string", "candidate_value": "string", "candidate_span": _P, "context_span": _P,
}
FRAGMENTS = f"array<struct<{','.join(f'{k}:{v}' for k, v in FIELDS.items())}>>"
LINES = "array<struct<start:int,line:string>>"


def lines(text: Column) -> Column:
    """(start, line) of each line. Universal separators split; of them only CR and LF are left out of the line."""
    sep = F.lit(r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")
    pieces = F.arrays_zip(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]", -1).alias("p"), F.regexp_extract_all(text, sep, F.lit(0)).alias("s"))

    def found(all_: Column) -> Column:
        starts = running(F.transform(all_, lambda x: F.length(x["p"]) + F.coalesce(F.length(x["s"]), F.lit(0))))
        tail = lambda x: F.when(x["s"].isNull() | x["s"].isin("\n", "\r", "\r\n"), "").otherwise(x["s"])
        each = F.zip_with(all_, starts, lambda x, at: F.struct(at.alias("start"), F.concat(x["p"], tail(x)).alias("line"))).cast(LINES)
        last = F.get(all_, F.size(all_) - 1)
        return F.when(last["p"] == "", F.slice(each, F.lit(1), F.size(each) - 1)).otherwise(each)

    found = let(pieces, found)
    return F.when(text.isNotNull(), found).otherwise(F.array().cast(LINES))


def _pair(start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))


def _fragment(kind: str, line: Column, at: Column, **fields: Column) -> Column:
    given = {"structure_kind": F.lit(kind), "raw_fragment": line, "fragment_span": _pair(at, at + F.length(line))} | fields
    return F.struct(*[given.get(k, F.lit(None)).cast(t).alias(k) for k, t in FIELDS.items()])


def _parts(line: Column, pattern: str, n: int) -> list[Column]:
    return [F.coalesce(F.regexp_extract(line, pattern, i + 1), F.lit("")) for i in range(n)]


def _after(at: Column, *parts: Column) -> Column:
    for p in parts:
        at = at + F.length(p)
    return at


def _assignment(line: Column, at: Column) -> Column:
    mark, export, key, sep, quote, value = _parts(line, ASSIGNMENT, 6)
    start = _after(at, mark, export, key, sep, quote)
    return F.array(
        _fragment(
            "assignment",
            line,
            at,
            prefix=export,
            key=key,
            separator=sep,
            value=value,
            quote_char=quote,
            line_span=_pair(at, at + F.length(line)),
            value_span=_pair(start, start + F.length(value)),
        )
    )


def _header(line: Column, at: Column) -> Column:
    name, sep, scheme, gap, value = _parts(line, BEARER, 5)
    start = _after(at, name, sep, scheme, gap)
    bearer = _fragment(
        "http_header",
        line,
        at,
        header_name=name,
        auth_scheme=scheme,
        separator=sep,
        value=value,
        value_span=_pair(start, start + F.length(value)),
    )
    name, sep, value = _parts(line, API_HEADER, 3)
    start = _after(at, name, sep)
    other = _fragment(
        "http_header",
        line,
        at,
        header_name=name,
        auth_scheme=F.lit(""),
        separator=sep,
        value=value,
        value_span=_pair(start, start + F.length(value)),
    )
    return F.array(F.when(line.rlike(BEARER), bearer).otherwise(other))


def _sentence(line: Column, at: Column) -> Column:
    phrase, gap, value = _parts(line, SENTENCE, 3)
    start = _after(at, phrase, gap)
    return F.array(
        _fragment(
            "log_sentence",
            line,
            at,
            context_phrase=phrase,
            candidate_value=value,
            candidate_span=_pair(start, start + F.length(value)),
            context_span=_pair(at, at + F.length(phrase)),
        )
    )


def _cookies(line: Column, at: Column) -> Column:
    name, gap = _parts(line, COOKIE, 2)
    head = F.length(name) + F.length(gap)
    rest = F.substring(line, head + 1, F.length(line))

    def one(m: Column) -> Column:
        key = F.substring(rest, m["at"] + 1, m["start"] - m["at"] - 1)
        start = at + head + m["start"]
        return _fragment(
            "cookie_pair",
            line,
            at,
            header_name=name,
            cookie_name=key,
            separator=F.lit("="),
            value=m["text"],
            value_span=_pair(start, start + F.length(m["text"])),
        )

    return F.transform(matches(rest, COOKIE_PAIR, needs="="), one)


def _scalar(raw: Column, start: Column) -> tuple[Column, Column, Column]:
    """(quote, value, span) of a raw value; one pair of equal quotes around it is taken off."""
    first = F.substring(raw, 1, 1)
    quoted = (F.length(raw) >= 2) & first.isin("'", '"') & (F.substring(raw, -1, 1) == first)
    inner = F.when(quoted, F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)
    begin = start + F.when(quoted, 1).otherwise(0)
    return F.when(quoted, first).otherwise(""), inner, _pair(begin, begin + F.length(inner))


def _json(line: Column, at: Column) -> Column:
    def one(m: Column) -> Column:
        head = F.substring(line, m["at"] + 1, m["start"] - m["at"])
        key = F.regexp_extract(head, r'^"([^"]*)"', 1)
        quote, value, where = _scalar(m["text"], at + m["start"])
        return _fragment(
            "json_yaml_pair",
            line,
            at,
            container_kind=F.lit("json"),
            key=key,
            separator=F.substring(head, F.length(key) + 3, F.length(head)),
            value=value,
            quote_char=quote,
            value_span=where,
        )

    return F.transform(matches(line, JSON_PAIR, needs='"'), one)


def _yaml(line: Column, at: Column) -> Column:
    key, sep, raw = _parts(line, YAML_PAIR, 3)
    quote, value, where = _scalar(raw, _after(at, key, sep))
    return F.array(
        _fragment("json_yaml_pair", line, at, container_kind=F.lit("yaml"), key=key, separator=sep, value=value, quote_char=quote, value_span=where)
    )


def parse_line(x: Column) -> Column:
    line, at = x["line"], x["start"]
    some_cookies = line.rlike(COOKIE) & F.rlike(F.regexp_replace(line, COOKIE, ""), F.lit(COOKIE_PAIR))
    tests = [
        (line.contains("=") & line.rlike(ASSIGNMENT), _assignment),
        (line.rlike(BEARER) | line.rlike(API_HEADER), _header),
        (line.rlike(SENTENCE), _sentence),
        (some_cookies, _cookies),
        (line.contains('"') & line.rlike(JSON_PAIR), _json),
        (line.contains(":") & line.rlike(YAML_PAIR), _yaml),
    ]
    out = None
    for test, parser in tests:
        got = parser(line, at).cast(FRAGMENTS)
        out = F.when(test, got) if out is None else out.when(test, got)
    return out.otherwise(F.array().cast(FRAGMENTS))


def fragments(text: Column) -> Column:
    """All fragments of a text, in line order. Lines without '=' or ':' or a quote can hold none and are passed over."""
    able = F.filter(lines(text), lambda x: x["line"].rlike("[=:\"：]") | x["line"].rlike(SENTENCE))
    return F.when(
        text.rlike("[=:\"：]") | text.rlike("(?i)verification code is"),
        F.flatten(F.transform(able, parse_line)),
    ).otherwise(F.array().cast(FRAGMENTS))
