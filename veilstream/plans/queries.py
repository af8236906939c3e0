"""The registered queries of the sensitive-text operators, with SQL for those that SQL can express.

Documents hold few secrets, so most rules run on lines made from the order and customer tables: every row of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilstream.functions.validity import entropy, valid_aws_key, valid_jwt
from veilstream.operators import metrics as m
from veilstream.operators.candidates import candidates
from veilstream.operators.detect import apply_rule, pii_spans, secret_spans
from veilstream.operators.layout import layout_pages, merge_rects
from veilstream.operators.merge import decide, merge, summary
from veilstream.operators.model import cache_key, cache_stats
from veilstream.operators.rules import PII_RULES, SECRET_RULES
from veilstream.operators.structured import fragments
from veilstream.plans.requests import redact_requests

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- documents -------------------------------------------------------------------------------------------------------

EMAIL = PII_RULES[3]
_email_sql = r"""
WITH d AS (SELECT doc_id, lang, text, length(text) AS n, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') AS m,
  string_split_regex(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') AS g FROM documents WHERE text IS NOT NULL
), e AS (
  SELECT doc_id, lang, text, i, m[i] AS value, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::INTEGER AS s
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM d)
)
"""


@query
def email_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(apply_rule(F.col("text"), EMAIL)).alias("s"))
    return d.select("doc_id", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"), F.col("s.text").alias("value"))


SQL["email_spans"] = _email_sql + "SELECT doc_id, s AS span_start, (s + length(value))::INTEGER AS span_end, value FROM e"


@query
def pii_counts_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("lang", F.size(apply_rule(F.col("text"), EMAIL)).alias("n"))
    return d.groupBy("lang").agg(
        F.count("*").alias("docs"),
        F.sum("n").cast("long").alias("emails"),
        F.sum((F.col("n") > 0).cast("int")).cast("long").alias("docs_with_email"),
    )


SQL["pii_counts_by_lang"] = r"""
SELECT lang, count(*) AS docs, sum(n)::BIGINT AS emails, sum(CASE WHEN n > 0 THEN 1 ELSE 0 END)::BIGINT AS docs_with_email
FROM (SELECT lang, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS n FROM documents) GROUP BY lang
"""


def _as_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumns(
        {
            "target": F.when(F.col("doc_id") % 2 == 0, "ai_model").otherwise("local_review"),
            "mode": F.when(F.col("doc_id") % 3 == 0, "redact").when(F.col("doc_id") % 3 == 1, "warn").otherwise("block"),
        }
    )


@query
def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = redact_requests(_as_requests(spark, sf_dir))
    return r.select(
        "doc_id",
        "decision.*",
        "summary.*",
        F.md5("redacted_text").alias("redacted_md5"),
        F.length("redacted_text").alias("redacted_length"),
    )


@query
def summary_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(summary(apply_rule(F.col("text"), EMAIL)).alias("s"))
    return d.agg(*[F.sum(f"s.{c}").cast("long").alias(c) for c in ("span_count", "secret_count", "pii_count")])


SQL["summary_totals"] = r"""
SELECT sum(n)::BIGINT AS span_count, 0::BIGINT AS secret_count, sum(n)::BIGINT AS pii_count
FROM (SELECT len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS n FROM documents)
"""


@query
def length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(m.length_bucket(F.length("text")).alias("bucket")).agg(F.count("*").alias("docs"))


SQL["length_buckets"] = "SELECT CASE WHEN length(text) <= 255 THEN '0-255' WHEN length(text) <= 1023 THEN '256-1023' WHEN length(text) <= 4095 THEN '1024-4095' ELSE '4096+' END AS bucket, count(*) AS docs FROM documents GROUP BY 1"


@query
def dedup_cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(cache_key(F.col("text")).alias("cache_key")).agg(
        F.count("*").alias("docs"),
        F.min("doc_id").alias("first_doc"),
    )


SQL["dedup_cache_key"] = "SELECT length(text) || ':' || sha256(text) AS cache_key, count(*) AS docs, min(doc_id) AS first_doc FROM documents GROUP BY 1"


@query
def model_cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache_stats(table(spark, sf_dir, "documents")).select("requests", "hits", "misses", "entries")


SQL["model_cache_stats"] = "SELECT count(*) AS requests, count(*) - count(DISTINCT text) AS hits, count(DISTINCT text) AS misses, least(count(DISTINCT text), 32)::BIGINT AS entries FROM documents"


# --- rules on made lines ---------------------------------------------------------------------------------------------

H = "md5(cast(o_orderkey as string))"
# kind -> (Spark SQL of the line, DuckDB pattern of the value with its prefix, group, least entropy)
LINES = {
    "api_key": (f"concat('key sk-', {H}, ' end')", r"(sk[-_][A-Za-z0-9_-]{12,})", 3.5),
    "bearer": (f"concat('Authorization: Bearer ', {H})", r"(?i)Bearer\s+([A-Za-z0-9._=-]{12,})", 3.5),
    "oauth_code": (f"concat('GET /cb?code=', {H}, '&x=1')", r"(?i)[?&]code=([A-Za-z0-9_-]{20,200})", 3.0),
    "aws_signature": (f"concat('/f?X-Amz-Signature=', {H}, {H})", r"(?i)X-Amz-Signature=([a-f0-9]{64})", 3.5),
    "webhook_url": (
        f"concat('https://hooks.slack.com/services/T', substring({H},1,8), '/B', substring({H},1,9), '/', substring({H},1,24))",
        r"(?i)https://hooks\.slack\.com/services/T[a-zA-Z0-9_]{8}/B[a-zA-Z0-9_]{8,12}/([a-zA-Z0-9_]{24})",
        0.0,
    ),
    "session": (f"concat('Cookie: sid=', substring({H},1,12), '; theme=dark')", r"(?i)(?:sessionid|session|connect\.sid|sid)=([^;\s]{8,})", 3.0),
    "db_connection": (
        f"concat('postgres://app:', {H}, '@db.internal:5432/app')",
        r"(?i)\b(?:postgres|postgresql|mysql|mongodb(?:\+srv)?)://[^:\s]+:([^@\s]+)@[^/\s]+/[^\s]+",
        2.5,
    ),
    "private_key": (
        f"concat('x -----BEGIN RSA PRIVATE KEY-----', {H}, '-----END RSA PRIVATE KEY----- y')",
        r"(-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]+?-----END [A-Z ]*PRIVATE KEY-----)",
        0.0,
    ),
    "webhook_secret": (
        f"concat('client_secret = ', {H})",
        r"(?i)\b(?:webhook_secret|signing_secret|client_secret|app_secret)\s*[:=]\s*([A-Za-z0-9._-]{8,})",
        3.2,
    ),
    "token": (
        f"concat('access-token: ', substring({H},1,14), ' ok')",
        r"(?i)\b(?:token|api[_-]?key|access[_-]?token|refresh[_-]?token)\s*[:=]\s*([A-Za-z0-9._-]{10,})",
        3.2,
    ),
    "verification_code": (
        f"concat('Your verification code is ', substring({H},1,6), '.')",
        r"(?i)(?:OTP|MFA code|verification code|passcode)\s*(?:is|are|for|=)?\s*:?\s*([A-Za-z0-9-]{4,10})",
        0.0,
    ),
}
_entropy_sql = "round(-list_sum(list_transform(list_distinct(string_split(v, '')), lambda c: (length(v) - length(replace(v, c, ''))) / length(v)::DOUBLE * log2((length(v) - length(replace(v, c, ''))) / length(v)::DOUBLE))), 9)"


def _rule_query(kind: str, line: str) -> Callable[[SparkSession, str], DataFrame]:
    rules = [r for r in SECRET_RULES if r.kind == kind]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        o = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(line).alias("line"))
        s = o.select("o_orderkey", F.explode(secret_spans(F.col("line"), "balanced", rules)).alias("s"))
        return s.select(
            "o_orderkey",
            F.col("s.start").alias("span_start"),
            F.col("s.end").alias("span_end"),
            F.col("s.text").alias("value"),
            F.col("s.score").alias("score"),
        )

    return run


for _kind, (_line, _pattern, _least) in LINES.items():
    QUERIES[f"regex_{_kind}"] = _rule_query(_kind, _line)
    _score = next(r.score for r in SECRET_RULES if r.kind == _kind)
    _check = f"WHERE {_entropy_sql} >= {_least}" if _least else "WHERE v <> ''"
    SQL[f"regex_{_kind}"] = f"""
SELECT o_orderkey, s AS span_start, (s + length(v))::INTEGER AS span_end, v AS value, {_score}::DOUBLE AS score FROM (
  SELECT o_orderkey, v, (position(v IN line) - 1 + CASE WHEN {_kind == "webhook_url"} THEN length(line) - 24 - position(v IN line) + 1 ELSE 0 END)::INTEGER AS s FROM (
    SELECT o_orderkey, line, regexp_extract(line, '{_pattern}', 1) AS v FROM (SELECT o_orderkey, {_line.replace("as string", "as varchar")} AS line FROM orders)) WHERE v <> '') {_check}"""


@query
def mode_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = f"concat('code ', substring({H},1,5), ' token=', substring({H},1,16), ' hf_', {H})"
    o = table(spark, sf_dir, "orders").select(F.expr(line).alias("line"))
    o = o.select(
        F.array(
            *[
                F.struct(
                    F.lit(k).alias("mode"),
                    F.size(secret_spans(F.col("line"), k)).alias("n"),
                ) for k in ("high_recall", "balanced", "high_precision", "other")
            ]
        ).alias("x")
    )
    return o.select(F.explode("x").alias("x")).groupBy("x.mode").agg(F.sum("x.n").cast("long").alias("spans"))


SQL["mode_comparison"] = f"""
WITH v AS (SELECT md5(o_orderkey::VARCHAR) AS h FROM orders
), c AS (SELECT h, substring(h, 1, 16) AS v FROM v
), e AS (SELECT h, {_entropy_sql} >= 3.2 AS t FROM c
), k AS (SELECT t, {_entropy_sql} >= 3.5 AS a FROM (SELECT t, 'hf_' || h AS v FROM e)
), n AS (SELECT sum(t::INT) AS t, sum(a::INT) AS a, count(*) AS n FROM k)
SELECT 'high_recall' AS mode, (t + a + n)::BIGINT AS spans FROM n UNION ALL SELECT 'balanced', (t + a)::BIGINT FROM n
UNION ALL SELECT 'other', (t + a)::BIGINT FROM n UNION ALL SELECT 'high_precision', a::BIGINT FROM n
"""

PII_LINES = "concat('id 11010119', lpad(cast(70 + o_orderkey % 30 as string), 2, '0'), '0', cast(1 + o_orderkey % 9 as string), '15', lpad(cast(o_orderkey % 1000 as string), 3, '0'), 'X tel 138', lpad(cast(o_orderkey % 100000000 as string), 8, '0'), ' pass E', lpad(cast(o_orderkey % 100000000 as string), 8, '0'), ' 姓名: 孙禄毅')"


@query
def regex_pii_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.explode(pii_spans(F.expr(PII_LINES))).alias("s"))
    return o.groupBy("s.kind", "s.label").agg(F.count("*").alias("spans"), F.sum(F.col("s.end") - F.col("s.start")).cast("long").alias("chars"))


SQL["regex_pii_kinds"] = """
SELECT 'cn_id_number' AS kind, 'pii' AS label, count(*) AS spans, (18 * count(*))::BIGINT AS chars FROM orders UNION ALL SELECT 'cn_phone', 'pii', count(*), (11 * count(*))::BIGINT FROM orders
UNION ALL SELECT 'cn_passport', 'pii', count(*), (9 * count(*))::BIGINT FROM orders UNION ALL SELECT 'cn_person_field', 'private_person', count(*), (3 * count(*))::BIGINT FROM orders
"""


@query
def entropy_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(entropy(F.expr(H)), 6).alias("entropy"))


SQL["entropy_scores"] = f"SELECT o_orderkey, round({_entropy_sql}, 6) AS entropy FROM (SELECT o_orderkey, md5(o_orderkey::VARCHAR) AS v FROM orders)"


@query
def jwt_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.when(F.col("o_orderkey") % 2 == 0, '{"alg":"HS256"}').otherwise('{"typ":"JWT"}')
    token = F.concat_ws(".", F.regexp_replace(F.translate(F.base64(head.cast("binary")), "+/", "-_"), "=+$", ""), F.expr(H), F.expr(H))
    return table(spark, sf_dir, "orders").select("o_orderkey", valid_jwt(token).alias("valid"))


SQL["jwt_valid"] = "SELECT o_orderkey, o_orderkey % 2 = 0 AS valid FROM orders"


@query
def aws_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.lit("AKIA"), F.upper(F.substring(F.expr(H), 1, 16)))
    return table(spark, sf_dir, "orders").select("o_orderkey", valid_aws_key(key).alias("valid"))


SQL["aws_valid"] = "SELECT o_orderkey, regexp_matches(upper(substring(md5(o_orderkey::VARCHAR), 1, 16)), '^[A-Z2-7]{16}$') AS valid FROM orders"


# --- structure -------------------------------------------------------------------------------------------------------

TEXTS = {
    "assignment": (f"concat('first line\nexport API_KEY = \"', {H}, '\"')", "value", 29, 32),
    "http_header": (f"concat('Authorization: Bearer ', {H})", "value", 22, 32),
    "cookie_pair": (f"concat('Set-Cookie: sid=', {H}, '; Path')", "value", 16, 32),
    "json": (f"concat('{{\"a-key\":\"', {H}, '\"}}')", "value", 10, 32),
    "yaml": (f"concat('a\n', 'api-key: ', {H})", "value", 11, 32),
    "log_sentence": (f"concat('OTP: ', substring({H}, 1, 6))", "candidate_value", 5, 6),
}


def _structure_query(text: str, field: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        o = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(fragments(F.expr(text.replace("\n", "\\n")))).alias("f"))
        where = "value_span" if field == "value" else "candidate_span"
        return o.select(
            "o_orderkey",
            F.col("f.structure_kind").alias("kind"),
            F.col(f"f.{field}").alias("value"),
            F.col(f"f.{where}.start").alias("value_start"),
            F.col(f"f.{where}.end").alias("value_end"),
        )

    return run


for _kind, (_text, _field, _start, _size) in TEXTS.items():
    QUERIES[f"parse_{_kind}"] = _structure_query(_text, _field)
    _named = "json_yaml_pair" if _kind in ("json", "yaml") else _kind
    SQL[f"parse_{_kind}"] = f"SELECT o_orderkey, '{_named}' AS kind, substring(md5(o_orderkey::VARCHAR), 1, {_size}) AS value, {_start}::INTEGER AS value_start, {_start + _size}::INTEGER AS value_end FROM orders"


@query
def secret_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr(f"concat('token = ', {H}, '\\n', 'url: postgres://u:', {H}, '@h/db\\n', '\"k\": \"sk-', {H}, '\"')")
    o = table(spark, sf_dir, "orders").select(F.explode(candidates(fragments(text))).alias("s"))
    return o.groupBy("s.kind", "s.score").agg(F.count("*").alias("spans"))


SQL["secret_candidates"] = f"""
SELECT 'token' AS kind, 0.75::DOUBLE AS score, sum((e >= 3.2)::INT)::BIGINT AS spans FROM (SELECT {_entropy_sql} AS e FROM (SELECT md5(o_orderkey::VARCHAR) AS v FROM orders))
UNION ALL SELECT 'db_connection', 0.9, count(*) FROM orders UNION ALL SELECT 'api_key', 0.9, count(*) FROM orders
"""


# --- merge, policy, metrics ------------------------------------------------------------------------------------------


def _made_spans(key: Column) -> Column:
    """Two overlapping spans whose kinds and widths follow the key."""
    span = lambda s, e, label, source: F.struct(
        s.cast("int").alias("start"),
        e.cast("int").alias("end"),
        label.alias("label"),
        F.lit("k").alias("kind"),
        source.alias("source"),
        F.lit(0.5).alias("score"),
        F.array().cast("array<string>").alias("reason_codes"),
        F.lit("").alias("text"),
        F.lit(None).cast("string").alias("placeholder"),
    )
    label = lambda k: F.when(k % 2 == 0, "secret").otherwise("pii")
    return F.array(
        span(F.lit(0), 4 + key % 5, label(key), F.lit("regex")),
        span(F.lit(3), 8 + key % 7, label(F.floor(key / 2)), F.lit("parser_rule")),
    )


@query
def merge_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(merge(_made_spans(F.col("o_orderkey")))).alias("s"))
    return o.select("o_orderkey", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"), F.col("s.label").alias("label"))


SQL["merge_priority"] = """
WITH s AS (
  SELECT o_orderkey, 0 AS s1, (4 + o_orderkey % 5)::INT AS e1, CASE WHEN o_orderkey % 2 = 0 THEN 'secret' ELSE 'pii' END AS l1, 3 AS s2, (8 + o_orderkey % 7)::INT AS e2, CASE WHEN (o_orderkey // 2) % 2 = 0 THEN 'secret' ELSE 'pii' END AS l2 FROM orders
), w AS (
  SELECT *, s2 >= e1 AS apart, CASE WHEN l2 = 'secret' THEN true WHEN l1 = 'secret' THEN false ELSE e2 - s2 > e1 - s1 END AS second FROM s
)
SELECT o_orderkey, s1::INTEGER AS span_start, e1::INTEGER AS span_end, l1 AS label FROM w WHERE apart OR NOT second
UNION ALL SELECT o_orderkey, s2::INTEGER, e2::INTEGER, l2 FROM w WHERE apart OR second
"""


@query
def policy_by_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.array(*[F.lit(x) for x in ("secret", "private_email", "private_person", "pii")])
    k = F.col("o_orderkey")
    spans = F.array(F.struct(F.get(labels, (k % 4).cast("int")).alias("label")))
    target, mode = F.when(k % 3 == 0, "local_review").otherwise("ai_model"), F.when(k % 5 == 0, "block").when(k % 5 == 1, "warn").otherwise("redact")
    d = table(spark, sf_dir, "orders").select(target.alias("target"), decide(spans, target, mode).alias("d"))
    return d.groupBy("target", "d.decision", "d.risk_level", "d.reason").agg(F.count("*").alias("requests"))


SQL["policy_by_target"] = """
SELECT target, decision, risk_level, reason, count(*) AS requests FROM (
  SELECT target, CASE k WHEN 0 THEN 'warn' WHEN 1 THEN 'redact' WHEN 2 THEN CASE WHEN target = 'local_review' THEN 'warn' ELSE 'redact' END ELSE CASE WHEN mode IN ('warn', 'redact') THEN mode ELSE 'allow' END END AS decision,
    CASE k WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN CASE WHEN target = 'local_review' THEN 'low' ELSE 'medium' END ELSE 'low' END AS risk_level,
    CASE k WHEN 0 THEN 'secret detected' WHEN 1 THEN 'sensitive pii' WHEN 2 THEN CASE WHEN target = 'local_review' THEN 'review before sharing' ELSE 'external target' END ELSE 'no match' END AS reason
  FROM (SELECT o_orderkey % 4 AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'local_review' ELSE 'ai_model' END AS target, CASE o_orderkey % 5 WHEN 0 THEN 'block' WHEN 1 THEN 'warn' ELSE 'redact' END AS mode FROM orders)
) GROUP BY ALL
"""


def _timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    return m.record(
        e.select(
            k.alias("seq"),
            F.col("event_type").alias("endpoint"),
            (k * 37 % 6000).cast("int").alias("text_length"),
            *[((k * (i + 3)) % 1000 / 1024).alias(c) for i, c in enumerate(m.SECONDS)],
            (k % 5).cast("int").alias("span_count"),
            (k % 3).cast("int").alias("secret_count"),
            (k % 2).cast("int").alias("pii_count"),
        )
    )


_timing_sql = """
WITH r AS (SELECT event_id AS seq, event_type AS endpoint, event_id * 37 % 6000 AS n, round_even(((event_id * 3) % 1000) / 1024.0::DOUBLE, 6) AS opf, round_even(((event_id * 7) % 1000) / 1024.0::DOUBLE, 6) AS total, event_id % 3 AS s, event_id % 2 AS p FROM events
), b AS (SELECT *, CASE WHEN n <= 255 THEN '0-255' WHEN n <= 1023 THEN '256-1023' WHEN n <= 4095 THEN '1024-4095' ELSE '4096+' END AS lb, CASE WHEN s > 0 AND p > 0 THEN 'mixed' WHEN s > 0 THEN 'secret_only' WHEN p > 0 THEN 'pii_only' ELSE 'no_hit' END AS ht FROM r)
"""


@query
def metrics_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.by_bucket(_timings(spark, sf_dir)).withColumns({c: F.round(c, 4) for c in ("avg_total", "avg_opf")})


SQL["metrics_grouping"] = _timing_sql + """
SELECT endpoint, 'length_bucket' AS dimension, lb AS bucket, count(*) AS count, round(round_even(avg(total), 6), 4) AS avg_total, round(round_even(avg(opf), 6), 4) AS avg_opf FROM b GROUP BY endpoint, lb
UNION ALL SELECT endpoint, 'hit_type', ht, count(*), round(round_even(avg(total), 6), 4), round(round_even(avg(opf), 6), 4) FROM b GROUP BY endpoint, ht
"""


@query
def metrics_last20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.recent(_timings(spark, sf_dir)).select("seq", "endpoint", "length_bucket", "hit_type")


SQL["metrics_last20"] = _timing_sql + "SELECT seq, endpoint, lb AS length_bucket, ht AS hit_type FROM b ORDER BY seq DESC LIMIT 20"


@query
def hit_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _timings(spark, sf_dir).groupBy("hit_type").agg(F.count("*").alias("requests"))


SQL["hit_types"] = _timing_sql + "SELECT ht AS hit_type, count(*) AS requests FROM b GROUP BY ht"


# --- layout ----------------------------------------------------------------------------------------------------------


@query
def layout_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is a page of one line: its priority and, far to the right, its status."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("file_id"),
        F.explode(
            F.array(
                F.struct(F.lit("Order").alias("text"), F.lit(0.0).alias("x0"), F.lit(30.0).alias("x1")),
                F.struct(F.substring(F.expr(H), 1, 8).alias("text"), F.lit(33.0).alias("x0"), F.lit(80.0).alias("x1")),
                F.struct(F.col("o_orderstatus").alias("text"), F.lit(150.0).alias("x0"), F.lit(160.0).alias("x1")),
            )
        ).alias("w"),
    )
    words = o.select("file_id", F.lit(0).alias("page_index"), "w.text", "w.x0", F.lit(10.0).alias("y0"), "w.x1", F.lit(20.0).alias("y1"))
    return layout_pages(words).select("file_id", "text", F.size("char_boxes").alias("boxes"))


SQL["layout_lines"] = "SELECT o_orderkey::VARCHAR AS file_id, 'Order ' || substring(md5(o_orderkey::VARCHAR), 1, 8) || ' | ' || o_orderstatus AS text, (17 + length(o_orderstatus))::INTEGER AS boxes FROM orders"


@query
def rect_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three boxes in a row of which the third stands apart by the key."""
    box = lambda x, w: F.struct(
        F.lit(0).alias("page_index"),
        x.cast("double").alias("x0"),
        F.lit(0.0).alias("y0"),
        (x + w).cast("double").alias("x1"),
        F.lit(10.0).alias("y1"),
    )
    gap = (F.col("o_orderkey") % 10).cast("double")
    rects = merge_rects(F.array(box(F.lit(0.0), 5), box(F.lit(6.0), 5), box(11.0 + gap, 5)))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.size(rects).alias("rects"), F.get(rects, F.lit(0))["x1"].alias("first_x1"))


SQL["rect_merge"] = "SELECT o_orderkey, CASE WHEN o_orderkey % 10 <= 6 THEN 1 ELSE 2 END::INTEGER AS rects, CASE WHEN o_orderkey % 10 <= 6 THEN 16.0 + o_orderkey % 10 ELSE 11.0 END::DOUBLE AS first_x1 FROM orders"
