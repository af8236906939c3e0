"""One query for each rule of the catalog, over lines of several shapes made from every order: matches, near misses, two in a
line, text beside them. The SQL finds the same spans with DuckDB's own regular expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilstream.functions.validity import MIN_ENTROPY
from veilstream.operators.detect import apply_rule
from veilstream.operators.rules import PII_RULES, SECRET_RULES, Rule

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Shorthands, valid in Spark's and DuckDB's SQL: {h} 32 hex digits of the key, {h20} the first 20 of them, {u} and {t} the same
# in upper case and without 0, 1, 8 and 9; {d} eight digits, {m} a month or 13 or 14, {y} the last two digits of a year.
SHORT = {
    "u": "upper(md5(cast(o_orderkey as string)))",
    "t": "translate(upper(md5(cast(o_orderkey as string))), '0189', 'WXYZ')",
    "d": "lpad(cast(o_orderkey * 7919 % 100000000 as string), 8, '0')",
    "m": "lpad(cast(1 + o_orderkey % 14 as string), 2, '0')",
    "y": "lpad(cast(o_orderkey % 100 as string), 2, '0')",
    "n": "chr(10)",
    "tab": "chr(9)",
}
JWT = "eyJhbGciOiJIUzI1NiJ9"  # {"alg":"HS256"}
NO_JWT = "eyJ0eXAiOiJKV1QifQ"  # {"typ":"JWT"}
LINES = {
    "R1": ["key sk-{h} end", "sk_{h11}", "ask-{h} sk-{h12}, sk-{h20}", "sk-aaaaaaaaaaaaaaaaaaaa", "SK-{h}"],
    "R2": ["x github_pat_{h} y", "github_pat_{h19}-", "GITHUB_PAT_{h}", "github_pat_{u} github_pat_{h20}"],
    "R3": ["ghp_{h}", "gho_{h12}", "ghx_{h}", "ghs_{h11}. ghr_{u}", "ghu_{h20}ghp_{h}"],
    "R4": ["id AKIA{t16} x", "ASIA{t16}", "AKIA{u16}", "xAKIA{t16}", "A3TQ{t16},ABIA{t16}", "ACCA{t17}"],
    "R5": ["HF_TOKEN = hf_{h}", "hf_{h15}", "hf_{u16}-", "hf_{h}{u}"],
    "R6": ["xoxb-{h}-{h17}", "xoxb-{h}-{h16}.", "xoxb-{u}{h}", "xoxb-{h}"],
    "R7": ["xoxp-{h}-{h}{h6}", "xoxp-{h}-{h}{h5}", "a xoxp-{u}{u}{u}"],
    "R8": ["xoxa-{h}-{h17}", "xoxa-{h}-{h16}", "xoxa-{u}{h} x"],
    "R9": ["webhook whsec_{h}", "whsec_{h19}", "whsec_{h20} whsec_{u}_"],
    "R10": ["SG.{h22}.{h}{h11}", "SG.{h15}.{h}", "SG.{h}.{h16}.", "SG.{u16}.{u15}"],
    "R11": ["pypi-AgEIcHlwaS5vcmc{h}{h18}", "pypi-AgEIcHlwaS5vcmc{h}{h17}", "pypi-{h}{h}"],
    "R12": ["npm_{h}{h4}", "npm_{h}{h3}", "x=npm_{u}{h};"],
    "R13": ["AIza{h}{h3}", "AIza{h}{h2}", "'AIza{u}_{h}'"],
    "R14": ["M{h23}.{h6}.{h27}", "N{h25}.{u7}.{u27}", "M{h22}.{h6}.{h27}", "M{h23}.{h5}.{h27}"],
    "R15": ["key-{h}", "key-{h31}", "monkey-{h}x", "key-{u}"],
    "R16": ["Authorization: Bearer {h}", "bearer{tab}{h20}", "Bearer {h11}", "BEARER  {u} Bearer {h}="],
    "R17": [f"jwt={JWT}.{{h}}.{{h}}", f"{NO_JWT}.{{h}}.{{h}}", f"{JWT}.{{h7}}.{{h}}", f"a {JWT}.{{u}}.{{h8}} b"],
    "R18": ["GET /cb?code={h}&x=1", "?code={h19}", "/a?b=1&CODE={u20}", "barcode={h}"],
    "R19": ["/f?X-Amz-Signature={h}{h}", "x-amz-signature={h}{h31}", "&X-Amz-Signature={u}{u}&"],
    "R20": ["/f?Signature={h}%2F{h5}", "&signature={h}+{h7}", "?Signature={h}{h7}", "XSignature={h}{h}"],
    "R21": [
        "https://hooks.slack.com/services/T{h8}/B{h9}/{h24}",
        "https://hooks.slack.com/services/T{h8}/B{h7}/{h24}",
        "HTTPS://HOOKS.SLACK.COM/services/T{u8}/B{u12}/{u24}.",
    ],
    "R22": ["Cookie: sid={h12}; theme=dark", "Set-Cookie: session={h7}; x", "connect.sid={u}", "SessionID={h}{n}sid={h9}"],
    "R23": ["postgres://app:{h}@db.internal:5432/app", "mysql://u:{h}@h", "x mongodb+srv://a:{u20}@c.net/p?x=1 y", "mypostgres://a:{h}@b/c"],
    "R24": [
        "x -----BEGIN RSA PRIVATE KEY-----{n}{h}{n}-----END RSA PRIVATE KEY----- y",
        "-----BEGIN PUBLIC KEY-----{h}-----END PUBLIC KEY-----",
        "-----BEGIN PRIVATE KEY-----{h}",
    ],
    "R25": ["client_secret = {h}", "SIGNING_SECRET:{u}", "my_app_secret={h}", "webhook_secret={h7}", "app_secret{tab}={tab}{h8}"],
    "R26": ["access-token: {h14} ok", "api_key={h9}", "TOKEN = {u}", "refreshtoken={h10}", "xtoken={h}"],
    "R27": ["your code is {h6}.", "OTP: {h4}", "MFA code {u10}x", "验证码为：{d}。", "passcode={h3}"],
    "R28": ["Your verification code is {h6}.", "OTP:{h4}", "动态口令：{d}", "your code is {h6}"],
    "P1": ["id 110101{y}{m}0512{d}", "11010119{y}{m}15123X", "11010120{y}{m}31{d}", "x511010119{y}{m}15123X"],
    "P2": ["pass E{d}.", "passport g{d}1", "P{d},s{d}", "xE{d}"],
    "P3": ["tel 138{d}.", "tel 128{d}", "1138{d}", "199{d}  170{d} x"],
    "P4": ["mail {h6}@{h3}.org", "a.b+c@x-y.co.uk, {u5}@z.c", "{h}@@{h}.com", "no mail {h}", "1@2.de 3@4.fr"],
    "P5": ["公积金账号：{d}{d}", "公积金帐户 是 {d}01", "公积金账户{d}", "公积金帐号 no {y} then {d}99"],
    "P6": ["姓名: 孙禄毅，{y}", "联系人 | 李四 | x", "户名：欧阳娜娜娜", "客户姓名：王五{n}收件人  赵六；", "姓名 wang"],
}
# RE2 has no look-around: the neighbours are part of the match, as lines never put two within one character.
ALTERED = {"P3": r"(^|[^\d])(1[3-9]\d{9})(?:$|[^\d])", "P6": None}
ENTROPY = (
    "round(-list_sum(list_transform(list_distinct(string_split({v}, '')), "
    "lambda c: (length({v}) - length(replace({v}, c, ''))) / length({v})::DOUBLE"
    " * log2((length({v}) - length(replace({v}, c, ''))) / length({v})::DOUBLE))), 9)"
)


def _filled(template: str) -> str:
    """The SQL expression of a line: quoted pieces and shorthands joined by ||."""
    parts = []
    for text, name, size in re.findall(r"([^{}]+)|\{([a-z]+)(\d*)\}", template):
        if text:
            parts.append("'" + text.replace("'", "''") + "'")
            continue
        whole = SHORT.get(name, "md5(cast(o_orderkey as string))")
        parts.append(f"substring({whole}, 1, {size})" if size else whole)
    return " || ".join(parts)


def line_sql(rule: str) -> str:
    """Each order has the line of a shape by its key."""
    shapes = LINES[rule]
    return f"CASE o_orderkey % {len(shapes)} " + " ".join(f"WHEN {i} THEN {_filled(s)}" for i, s in enumerate(shapes)) + " END"


def _pattern(rule: Rule) -> str:
    if ALTERED.get(rule.id):
        return ALTERED[rule.id]
    plain = re.sub(r"^\(\?[a-zA-Z]+\)", lambda m: "(?i)" if "i" in m[0] else "", rule.pattern)
    return plain.replace("(?=$|", "(?:$|")


def _check(rule: Rule) -> str:
    if not rule.checked:
        return "true"
    if rule.kind == "jwt":
        head = "translate(split_part(v, '.', 1), '-_', '+/')"
        return f"decode(from_base64(rpad({head}, (ceil(length({head}) / 4.0) * 4)::INTEGER, '='))) LIKE '{{%\"alg\":%'"
    least = MIN_ENTROPY[rule.kind]
    enough = f"{ENTROPY.format(v='v')} >= {least}" if least else "true"
    return f"CASE WHEN v LIKE 'AKIA%' THEN regexp_full_match(v, '.{{4}}[A-Z2-7]{{16}}') ELSE {enough} END" if rule.kind == "api_key" else enough


def spans_sql(rule: Rule) -> str:
    p = "'" + _pattern(rule).replace("'", "''") + "'"
    before = "coalesce(list_sum(list_transform({}, lambda x: length(x))), 0)"
    line = line_sql(rule.id).replace("as string", "as varchar")
    return f"""
WITH l AS (SELECT o_orderkey, {line} AS line FROM orders
), f AS (
  SELECT o_orderkey, regexp_extract_all(line, {p}) AS m, regexp_extract_all(line, {p}, 1) AS p, regexp_extract_all(line, {p}, 2) AS v, string_split_regex(line, {p}) AS g FROM l
), e AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM f
), s AS (
  SELECT o_orderkey, v[i] AS v, ({before.format("g[1:i]")} + {before.format("m[1:i - 1]")} + length(coalesce(p[i], '')))::INTEGER AS span_start FROM e
)
SELECT o_orderkey, span_start, (span_start + length(v))::INTEGER AS span_end, v AS value, {rule.score}::DOUBLE AS score FROM s WHERE {_check(rule)}
"""


def _query(rule: Rule) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.expr(line_sql(rule.id)).alias("line"))
        s = lines.select("o_orderkey", F.explode(apply_rule(F.col("line"), rule)).alias("s"))
        return s.select(
            "o_orderkey",
            F.col("s.start").alias("span_start"),
            F.col("s.end").alias("span_end"),
            F.col("s.text").alias("value"),
            "s.score",
        )

    return run


for _rule in [*SECRET_RULES, *PII_RULES]:
    _name = f"rule_{_rule.id.lower()}_{_rule.kind}"
    QUERIES[_name], SQL[_name] = _query(_rule), spans_sql(_rule)
