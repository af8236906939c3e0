"""Queries of merging, selection, the model, metrics, page layout and files over every order, document or event, and their SQL."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilstream.functions.spans import SPANS
from veilstream.operators import layout, merge, metrics
from veilstream.operators.candidates import candidates
from veilstream.operators.model import lru_replay, model_spans, normalize
from veilstream.operators.structured import fragments
from veilstream.plans import files as file_plan
from veilstream.plans.requests import as_json, each_span, redact_requests, scan
from veilstream.sources import docx, requests
from veilstream.sources.files import bbox_words, download, ocr_pages, ocr_text, with_suffix

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
H = "md5(cast(o_orderkey as string))"
L = f"translate({H}, '0123456789', 'ghijklmnop')"  # no digits, so no numbers are found in it


def query(sql: str) -> Callable[[Callable[[SparkSession, str], DataFrame]], Callable[[SparkSession, str], DataFrame]]:
    """Registers a query with its SQL; {H} there is the MD5 of the order's key, {L} the same in letters."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql.replace("{L}", "translate({H}, '0123456789', 'ghijklmnop')").replace("{H}", "md5(o_orderkey::VARCHAR)")
        return f

    return register


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")


def _key() -> Column:
    return F.col("o_orderkey")


def _case(options: list[str | None]) -> Column:
    """The option of the key's remainder."""
    return F.get(F.array(*[F.lit(x) for x in options]).cast("array<string>"), (_key() % len(options)).cast("int"))


def _span(start: Column | int, end: Column | int, label: Column | str, text: Column | str | None = None, source: Column | str = "regex") -> Column:
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    given = {
        "start": col(start).cast("int"),
        "end": col(end).cast("int"),
        "label": col(label),
        "kind": F.lit("k"),
        "source": col(source),
        "score": F.lit(0.5),
    }
    given |= {"reason_codes": F.array().cast("array<string>"), "text": col(text).cast("string"), "placeholder": F.lit(None).cast("string")}
    return F.struct(*[v.alias(k) for k, v in given.items()])


def _spans(*spans: Column) -> Column:
    return F.array(*spans).cast(SPANS)


# --- spans -----------------------------------------------------------------------------------------------------------


@query("""
WITH t AS (
  SELECT o_orderkey, 'pay ' || {H} || ' to ' || substring({H}, 1, 8) AS t, (4 + o_orderkey % 20)::INT AS e1, (10 + o_orderkey % 7)::INT AS s2,
    CASE o_orderkey % 3 WHEN 0 THEN '<SECRET>' WHEN 1 THEN '<PRIVATE_EMAIL>' ELSE '<REDACTED>' END AS p1 FROM orders
)
SELECT o_orderkey, substring(t, 1, 4) || p1
  || CASE WHEN s2 >= e1 THEN substring(t, e1 + 1, s2 - e1) || '<PRIVATE_URL>' || substring(t, 31, 10) ELSE substring(t, e1 + 1, 40 - e1) END
  || '<ACCOUNT_NUMBER>' AS redacted FROM t
""")
def redact_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three spans, of which the second may begin within the first."""
    text = F.expr(f"'pay ' || {H} || ' to ' || substring({H}, 1, 8)")
    spans = _spans(
        _span(40, 48, "account_number"),
        _span(4, 4 + _key() % 20, _case(["secret", "private_email", "pii"])),
        _span(10 + _key() % 7, 30, "private_url"),
    )
    return orders(spark, sf_dir).select("o_orderkey", merge.redact(text, spans).alias("redacted"))


def _chosen(*spans: tuple[int, int, str]) -> str:
    return json.dumps([dict(zip(("start", "end", "label"), s, strict=True)) for s in spans])


SECRET, EMAIL = (0, 5, "secret"), (6, 9, "private_email")
ACTIVE = [None, "[]", _chosen(SECRET), _chosen((0, 5, "pii")), "{bad", None, None, _chosen(EMAIL), "", _chosen(EMAIL, (12, 20, "secret")), None]
CATEGORIES = [None, None, None, None, None, '["secret"]', '["private_email", "zzz"]', '["secret"]', "bad", None, "[]"]


@query("""
WITH s AS (SELECT o_orderkey, o_orderkey % 11 AS k, unnest([{'s': 0, 'l': 'secret'}, {'s': 6, 'l': 'private_email'}, {'s': 12, 'l': 'secret'}]) AS x FROM orders
), kept AS (
  SELECT o_orderkey, x.s AS s FROM s WHERE CASE k WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN x.s = 0 WHEN 3 THEN x.s = 0 AND x.l = 'pii' WHEN 4 THEN true
    WHEN 5 THEN x.l = 'secret' WHEN 6 THEN x.l IN ('private_email', 'zzz') WHEN 7 THEN x.s = 6 WHEN 8 THEN true WHEN 9 THEN x.s IN (6, 12) ELSE false END
)
SELECT o.o_orderkey, coalesce(string_agg(s::VARCHAR, ',' ORDER BY s), '') AS starts FROM orders o LEFT JOIN kept USING (o_orderkey) GROUP BY o.o_orderkey
""")
def select_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans kept by exact place, by label, by both, by unreadable lists."""
    spans = _spans(_span(0, 5, "secret"), _span(6, 9, "private_email"), _span(12, 20, "secret"))
    kept = merge.select_active(spans, _case(ACTIVE), _case(CATEGORIES))
    return orders(spark, sf_dir).select("o_orderkey", F.array_join(F.transform(kept, lambda s: s["start"].cast("string")), ",").alias("starts"))


SENT = [None, "", "[]", "{bad", '[{"start": 3, "end": 9, "label": "pii"}]', '[{"start": 1}, {"start": 2}]', '"text"']


@query("""SELECT o_orderkey, CASE o_orderkey % 7 WHEN 4 THEN '3' WHEN 5 THEN '1,2' ELSE '0' END AS starts FROM orders""")
def sent_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that a caller sent, or the detected one where they can't be used."""
    spans = merge.precomputed(_case(SENT), _spans(_span(0, 5, "secret")))
    return orders(spark, sf_dir).select("o_orderkey", F.array_join(F.transform(spans, lambda s: s["start"].cast("string")), ",").alias("starts"))


@query("""
WITH t AS (SELECT o_orderkey, substring({H}, 1, 2) || '  ' || substring({H}, 1, 2) || {H} AS t, (o_orderkey % 5)::INT AS n FROM orders
), v AS (SELECT o_orderkey, unnest(list_distinct([substring(t, 1, 2), substring(t, 3, 2), substring(t, 5, 2), substring(t, 7, n), substring(t, 20, 9)])) AS v FROM t)
SELECT o_orderkey, string_agg(v, '|' ORDER BY length(v) DESC, v) AS redact_list FROM v WHERE trim(v) <> '' GROUP BY o_orderkey
""")
def values_to_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr(f"substring({H}, 1, 2) || '  ' || substring({H}, 1, 2) || {H}")
    spans = _spans(_span(0, 2, "a"), _span(2, 4, "a"), _span(4, 6, "a"), _span(6, 6 + _key() % 5, "a"), _span(19, 28, "a"))
    return orders(spark, sf_dir).select("o_orderkey", F.array_join(merge.redact_values(text, spans), "|").alias("redact_list"))


@query("""
SELECT o_orderkey, NOT (o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 AND regexp_matches(CASE o_orderkey % 5 WHEN 0 THEN 'HTTPS://x.org' WHEN 1 THEN 'http://y' WHEN 2 THEN 'see http://y' WHEN 3 THEN {H} ELSE '' END, '(?i)^https?://')) AS kept FROM orders
""")
def model_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(_key() % 5 == 0, "HTTPS://x.org").when(_key() % 5 == 1, "http://y").when(_key() % 5 == 2, "see http://y").when(_key() % 5 == 3, F.expr(H)).otherwise("")
    spans = _spans(_span(0, 9, _case(["secret", "private_url", "pii"]), text, _case(["opf", "regex"])))
    return orders(spark, sf_dir).select("o_orderkey", (F.size(merge.drop_url_secrets(spans)) > 0).alias("kept"))


@query("""
SELECT o_orderkey, 5 + (o_orderkey % 3 = 0 AND o_orderkey % 2 = 0)::INT AS span_start, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 THEN '=' ELSE '' END || substring({H}, 1, 4) AS value,
  CASE WHEN o_orderkey % 5 = 0 THEN 'regex' ELSE 'opf' END AS source FROM orders
""")
def normal_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.when(_key() % 2 == 0, "=").otherwise(""), F.substring(F.expr(H), 1, 4))
    spans = normalize(_spans(_span(5, 9, _case(["private_email", "secret", "pii"]), text, F.when(_key() % 5 == 0, "regex"))))
    return orders(spark, sf_dir).select("o_orderkey", F.explode(spans).alias("s")).select(
        "o_orderkey",
        F.col("s.start").alias("span_start"),
        F.col("s.text").alias("value"),
        "s.source",
    )


# --- requests --------------------------------------------------------------------------------------------------------

SHAPES = [
    "'token = sk-' || {h}",
    "'mail ' || substring({h}, 1, 5) || '@x.org, sk-' || {h}",
    "'DATABASE_URL=postgres://app:' || {h} || '@db.x/app'",
    "'nothing ' || {h}",
    "'X-API-Key: ' || {h}",
]


def _text() -> Column:
    return F.expr("CASE o_orderkey % 5 " + " ".join(f"WHEN {i} THEN {s.format(h=L)}" for i, s in enumerate(SHAPES)) + " END")


_bits = "round(-list_sum(list_transform(list_distinct(string_split({v}, '')), lambda c: (length({v}) - length(replace({v}, c, ''))) / length({v})::DOUBLE * log2((length({v}) - length(replace({v}, c, ''))) / length({v})::DOUBLE))), 9)"
_found = f"""
WITH l AS (SELECT o_orderkey, {{L}} AS h, 'sk-' || {{L}} AS k, o_orderkey % 5 AS shape FROM orders
), e AS (SELECT *, {_bits.format(v="h")} >= 3.2 AS random, {_bits.format(v="k")} >= 3.5 AS random_key FROM l
), s AS (
  SELECT o_orderkey, 8 AS s, 43 AS e, 'parser_rule' AS source, 'secret' AS label FROM e WHERE shape = 0
  UNION ALL SELECT o_orderkey, 5, 16, 'regex', 'pii' FROM e WHERE shape = 1
  UNION ALL SELECT o_orderkey, 18, 53, 'regex', 'secret' FROM e WHERE shape = 1 AND random_key
  UNION ALL SELECT o_orderkey, 28, 60, 'parser_rule', 'secret' FROM e WHERE shape = 2
  UNION ALL SELECT o_orderkey, 11, 43, 'parser_rule', 'secret' FROM e WHERE shape = 4 AND random
)"""


@query(_found + "SELECT o_orderkey, s::INTEGER AS span_start, e::INTEGER AS span_end, source, label FROM s")
def collect_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All detectors on five kinds of text; parsed secrets win over those found by pattern."""
    # the file may be one small row group, that is one task, but each row takes long
    o = orders(spark, sf_dir).repartition(2 * spark.sparkContext.defaultParallelism, "o_orderkey")
    s = each_span(scan(o.select("o_orderkey", _text().alias("text"))), ["start", "end", "source", "label"], "o_orderkey")
    return s.withColumnsRenamed({"start": "span_start", "end": "span_end"})


@query(_found + """
SELECT o.o_orderkey, CASE WHEN bool_or(s.label = 'secret') THEN '{"decision":"warn","risk_level":"high","reason":"secret detected"}'
  ELSE '{"decision":"' || CASE o.o_orderkey % 2 WHEN 0 THEN 'redact' ELSE 'allow' END || '","risk_level":"low","reason":"no match"}' END AS response FROM orders o LEFT JOIN s USING (o_orderkey) GROUP BY o.o_orderkey
""")
def decide_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = redact_requests(
        orders(spark, sf_dir).select("o_orderkey", _text().alias("text"), F.lit("ai_model").alias("target"), _case(["redact", "block"]).alias("mode"))
    )
    return as_json(r, "decide", "o_orderkey")


@query("""
SELECT mode, kind, count(*) AS spans FROM (
  SELECT unnest(['high_recall', 'balanced', 'high_precision', 'other']) AS mode, k AS kind, score FROM (
    SELECT 'token' AS k, 0.75 AS score FROM (SELECT """ + _bits.format(v="h") + """ AS e FROM (SELECT {H} AS h FROM orders)) WHERE e >= 3.2 UNION ALL SELECT 'api_key', 0.9 FROM orders)
) WHERE mode <> 'high_precision' OR score >= 0.8 GROUP BY ALL
""")
def candidates_by_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr(f"concat('token = ', {H}, chr(10), 'k: sk-', {H})")
    modes = F.array(*[F.lit(x) for x in ("high_recall", "balanced", "high_precision", "other")])
    o = orders(spark, sf_dir).select(text.alias("t"), F.explode(modes).alias("mode"))
    return o.select(
        "mode",
        F.explode(candidates(fragments(F.col("t")), F.col("mode"))).alias("s"),
    ).groupBy("mode", "s.kind").agg(F.count("*").alias("spans"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'linear_comment' WHEN 1 THEN 'symphony_prompt' ELSE 'other' END AS source, CASE o_orderkey % 3 WHEN 0 THEN 'linear' ELSE 'ai_model' END AS target,
  CASE o_orderkey % 3 WHEN 0 THEN 'redact' ELSE 'block' END AS mode FROM orders
""")
def request_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = orders(spark, sf_dir)
    parts = [requests.preset(o.where("o_orderkey % 3 = 0"), requests.LINEAR), requests.preset(o.where("o_orderkey % 3 = 1"), requests.SYMPHONY)]
    return parts[0].unionByName(parts[1]).unionByName(requests.preset(o.where("o_orderkey % 3 = 2"), requests.SYMPHONY, "other"))


# --- model -----------------------------------------------------------------------------------------------------------


def _finds_at(texts: list[str]) -> list:
    """Stands for a model: the first @ of a text; results are lists and dicts by turns."""
    found = [[{"start": t.index("@"), "end": t.index("@") + 1, "label": "private_email", "text": "@"}] if "@" in t else [] for t in texts]
    return [f if i % 2 else {"detected_spans": f} for i, f in enumerate(found)]


@query("""
SELECT doc_id, (position('@' IN text) - 1)::INTEGER AS span_start, CASE WHEN position('@' IN text) > 0 AND length(text) >= 500 THEN 1 ELSE 0 END::INTEGER AS spans FROM documents
WHERE length(text) >= 500 AND position('@' IN text) > 0 UNION ALL SELECT doc_id, NULL, 0 FROM documents WHERE text IS NULL OR length(text) < 500 OR position('@' IN text) = 0
""")
def model_on_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts are sent once, short ones not at all."""
    d = model_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), _finds_at)
    return d.select("doc_id", F.get("spans_model", F.lit(0))["start"].alias("span_start"), F.size("spans_model").alias("spans"))


def _fails(texts: list[str]) -> list:
    if any(t.startswith("bad") for t in texts):
        raise ValueError("bad text")
    return [[] if t.startswith("none") else [{"start": 0, "end": 1, "label": "secret", "text": t[:1]}] for t in texts]


@query(
    "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 2 THEN 1 ELSE 0 END::INTEGER AS spans, CASE o_orderkey % 3 WHEN 0 THEN 'ValueError: bad text' END AS error FROM orders"
)
def model_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text on which the model fails costs no other its spans."""
    o = orders(spark, sf_dir).where("true").withColumn("text", F.concat(_case(["bad", "none", "good"]), F.expr(H)))
    d = model_spans(o, _fails, force=True)
    return d.select("o_orderkey", F.size("spans_model").alias("spans"), F.col("spans_model_error").alias("error"))


@query("""
WITH r AS (SELECT event_type AS stream, event_id * 7919 % 61 AS k, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events
), p AS (SELECT *, lag(i) OVER (PARTITION BY stream, k ORDER BY i) AS before FROM r
), d AS (SELECT p.stream, p.i, p.before, count(DISTINCT q.k) AS others FROM p LEFT JOIN r q ON q.stream = p.stream AND q.i > p.before AND q.i < p.i GROUP BY ALL
), h AS (SELECT stream, sum((before IS NOT NULL AND others < 32)::INT)::BIGINT AS hits, count(*) AS n FROM d GROUP BY stream)
SELECT h.stream, hits, n - hits AS misses, least(32, (SELECT count(DISTINCT k) FROM r WHERE r.stream = h.stream))::BIGINT AS entries FROM h
""")
def cache_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("text", (F.col("event_id") * 7919 % 61).cast("string"))
    return lru_replay(e, "event_type", "event_id")


# --- metrics ---------------------------------------------------------------------------------------------------------


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    seconds = [((k * (i + 3)) % 1000 / 1024).alias(c) for i, c in enumerate(metrics.SECONDS)]
    counts = [(k % n).cast("int").alias(c) for n, c in ((5, "span_count"), (3, "secret_count"), (2, "pii_count"))]
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return metrics.record(
        e.select(
            k.alias("seq"),
            F.when(k % 7 > 0, F.col("event_type")).alias("endpoint"),
            (k * 37 % 6000).cast("int").alias("text_length"),
            *seconds,
            *counts,
        )
    )


_seconds = ", ".join(
    f"round(round_even(avg(round_even(((event_id * {i + 3}) % 1000) / 1024.0::DOUBLE, 6)), 6), 4) AS avg_{c}" for i, c in enumerate(metrics.SECONDS)
)


@query(f"SELECT {_seconds} FROM events")
def metric_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.averages(_records(spark, sf_dir)).select(*[F.round(f"avg_{c}", 4).alias(f"avg_{c}") for c in metrics.SECONDS])


@query(
    "SELECT event_id AS seq, CASE WHEN event_id % 7 > 0 THEN event_type ELSE 'collect_spans' END AS endpoint, (event_id * 37 % 6000)::INTEGER AS text_length FROM events ORDER BY event_id DESC LIMIT 1"
)
def metric_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.last(_records(spark, sf_dir)).select("seq", "endpoint", "text_length")


@query("""
WITH r AS (SELECT *, CASE WHEN event_id % 7 > 0 THEN event_type ELSE 'collect_spans' END AS endpoint FROM events ORDER BY event_id DESC LIMIT 20)
SELECT (SELECT count(*) FROM events) AS total_requests, endpoint, count(*) AS requests FROM r GROUP BY endpoint
""")
def metric_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot's nested map, flat again: requests of each endpoint among the last twenty."""
    s = metrics.snapshot(_records(spark, sf_dir)).select("total_requests", F.explode("by_endpoint").alias("endpoint", "buckets"))
    n = F.aggregate(
        F.map_entries("buckets"),
        F.lit(0).cast("long"),
        lambda acc, x: acc + F.when(x["key"].isin("mixed", "secret_only", "pii_only", "no_hit"), x["value"]["count"]).otherwise(0),
    )
    return s.select("total_requests", "endpoint", n.alias("requests"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'ready' WHEN o_orderkey % 2 = 0 THEN 'failed' ELSE 'warming' END AS status FROM orders")
def runtime_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).select("o_orderkey", metrics.status(_key() % 3 == 0, F.when(_key() % 2 == 0, "error")).alias("status"))


# --- pages -----------------------------------------------------------------------------------------------------------


@query("""
WITH p AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE 'text' END AS t, o_orderkey % 3 = 0 AS img, CASE WHEN o_orderkey % 5 = 0 THEN 2.5 ELSE 9.0 END AS font FROM orders)
SELECT o_orderkey, array_to_string(list_sort(list_filter([CASE WHEN trim(coalesce(t, '')) = '' THEN 'no_text_layer' END, CASE WHEN img THEN 'image_heavy' END, CASE WHEN trim(coalesce(t, '')) <> '' AND font <= 3 THEN 'low_text_density' END], lambda x: x IS NOT NULL)), ',') AS flags FROM p
""")
def page_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = layout.quality_flags(_case([" ", None, "text", "text"]), _key() % 3 == 0, F.when(_key() % 5 == 0, 2.5).otherwise(9.0))
    return orders(spark, sf_dir).select("o_orderkey", F.array_join(flags, ",").alias("flags"))


_grid = """
WITH w AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS i, (l_partkey % 1000)::VARCHAR || l_returnflag AS t FROM lineitem
), g AS (SELECT l_orderkey, i // 3 AS line, i % 3 AS pos, t, 100.0 * (i % 3) AS x0, 100.0 * (i % 3) + 20 + 10 * (i % 8) AS x1 FROM w
), s AS (SELECT *, lag(x1) OVER (PARTITION BY l_orderkey, line ORDER BY pos) AS left_x1 FROM g)
"""


def _grid_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as words, three in a line, with gaps of several widths."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    one = F.struct(
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_extendedprice",
        F.concat((F.col("l_partkey") % 1000).cast("string"), "l_returnflag").alias("t"),
    )
    w = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(one)).alias("ws")).select("l_orderkey", F.posexplode("ws").alias("i", "w"))
    x0 = 100.0 * (F.col("i") % 3)
    y0 = 20.0 * F.floor(F.col("i") / 3) + F.col("i") % 3  # not quite level, yet within the tolerance
    return w.select(
        F.col("l_orderkey").cast("string").alias("file_id"),
        F.lit(0).alias("page_index"),
        F.col("w.t").alias("text"),
        x0.alias("x0"),
        y0.alias("y0"),
        (x0 + 20 + 10 * (F.col("i") % 8)).alias("x1"),
        (y0 + 10).alias("y1"),
    )


@query(_grid + """
, l AS (SELECT l_orderkey, line, string_agg(CASE WHEN left_x1 IS NULL THEN '' WHEN x0 - left_x1 >= 60 THEN ' | ' WHEN x0 - left_x1 >= 1.5 THEN ' ' ELSE '' END || t, '' ORDER BY pos) AS text FROM s GROUP BY ALL)
SELECT l_orderkey::VARCHAR AS file_id, string_agg(text, chr(10) ORDER BY line) AS text, (sum(length(text)) + count(*) - 1)::INTEGER AS boxes FROM l GROUP BY l_orderkey
""")
def layout_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.layout_pages(_grid_words(spark, sf_dir)).select("file_id", "text", F.size("char_boxes").alias("boxes"))


@query("""
WITH w AS (SELECT l_orderkey, l_linenumber % 2 AS block, l_linenumber AS line, string_agg(l_returnflag || l_linestatus || (l_partkey % 100)::VARCHAR, '' ORDER BY l_partkey, l_suppkey, l_extendedprice) AS t FROM lineitem GROUP BY ALL)
SELECT l_orderkey::VARCHAR AS file_id, string_agg(t, chr(10) ORDER BY block, line) AS text, (sum(length(t)) + count(*) - 1)::INTEGER AS boxes FROM w GROUP BY l_orderkey
""")
def raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    word = F.concat("l_returnflag", "l_linestatus", (F.col("l_partkey") % 100).cast("string"))
    c = li.select("*", F.posexplode(F.split(word, "")).alias("k", "c"))
    seq = F.struct("l_partkey", "l_suppkey", "l_extendedprice", "k")
    box = [F.lit(float(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]
    chars = c.select(
        F.col("l_orderkey").cast("string").alias("file_id"),
        F.lit(0).alias("page_index"),
        (F.col("l_linenumber") % 2).alias("block"),
        F.col("l_linenumber").alias("line"),
        seq.alias("seq"),
        "c",
        *box,
    )
    return layout.raw_page(chars).select("file_id", "text", F.size("char_boxes").alias("boxes"))


def _payload() -> Column:
    """Two lines out of order and a blank one, at a height by the key; some payloads are strings, some no pages at all."""

    def line(chars: Column, y1: Column) -> Column:
        bbox = F.struct(F.lit(0.0).alias("x0"), (y1 - 0.1).alias("y0"), F.lit(1.0).alias("x1"), y1.alias("y1"))
        c = F.transform(
            chars,
            lambda x, i: F.struct(
                x.alias("text"),
                F.struct((i / 10).alias("x0"), (y1 - 0.1).alias("y0"), ((i + 1) / 10).alias("x1"), y1.alias("y1")).alias("bbox"),
            ),
        )
        return F.struct(F.concat(F.lit(" "), F.array_join(chars, ""), F.lit(" ")).alias("text"), bbox.alias("bbox"), c.alias("chars"))

    letters = lambda a, n: F.split(F.substring(F.expr(H), a, n), "")
    low = line(letters(1, 5), F.lit(0.3))
    top = line(F.concat(F.array(F.lit(" ")), letters(9, 3)), F.lit(0.9))
    blank = line(F.array(F.lit(" ")), F.when(_key() % 2 == 0, 0.1).otherwise(0.95))
    page = F.to_json(F.struct(F.lit(100.0).alias("page_width"), F.lit(200.0).alias("page_height"), F.array(low, top, blank).alias("lines")))
    return F.when(_key() % 5 == 0, F.concat(F.lit('" '), F.expr(H), F.lit(' "'))).when(_key() % 5 == 1, F.lit("[1]")).otherwise(page)


def _ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).select(_key().cast("string").alias("file_id"), F.lit(0).alias("page_index"), _payload().alias("payload"))


@query("""
SELECT o_orderkey::VARCHAR AS file_id, CASE o_orderkey % 5 WHEN 0 THEN {H} WHEN 1 THEN '' ELSE substring({H}, 9, 3) || chr(10) || substring({H}, 1, 5) || CASE WHEN o_orderkey % 2 = 0 THEN chr(10) ELSE '' END END AS text,
  CASE WHEN o_orderkey % 5 < 2 THEN 0 ELSE 9 + (o_orderkey % 2 = 0)::INT END::INTEGER AS boxes, CASE WHEN o_orderkey % 5 >= 2 THEN 10 END::INTEGER AS first_x0, CASE WHEN o_orderkey % 5 >= 2 THEN 20 END::INTEGER AS first_y0, o_orderkey % 5 = 1 AS failed FROM orders
""")
def ocr_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.get("char_boxes", F.lit(0))
    return ocr_pages(_ocr(spark, sf_dir)).select(
        "file_id",
        "text",
        F.size("char_boxes").alias("boxes"),
        F.round(first["x0"]).cast("int").alias("first_x0"),
        F.round(first["y0"]).cast("int").alias("first_y0"),
        F.col("error").isNotNull().alias("failed"),
    )


@query("""
SELECT o_orderkey::VARCHAR AS file_id, CASE o_orderkey % 5 WHEN 0 THEN {H} WHEN 1 THEN '' ELSE substring({H}, 1, 5) || chr(10) || substring({H}, 9, 3) END AS text FROM orders
""")
def ocr_plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr_text(_ocr(spark, sf_dir)).select("file_id", "text")


@query(
    "SELECT l_orderkey::VARCHAR AS file_id, count(*)::BIGINT AS words, sum(length((l_partkey % 1000)::VARCHAR || l_returnflag))::BIGINT AS chars FROM lineitem GROUP BY l_orderkey"
)
def bounding_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words written as bounding-box XHTML, with one that lacks a number on each page, and read again."""
    w = _grid_words(spark, sf_dir)
    attributes = F.concat_ws(
        " ",
        *[
            F.concat(F.lit(f'{a}="'), F.col(c).cast("string"), F.lit('"')) for a, c in (
                ("xMin", "x0"),
                ("yMin", "y0"),
                ("xMax", "x1"),
                ("yMax", "y1"),
            )
        ],
    )
    word = F.concat(F.lit("<word "), attributes, F.lit("> "), F.col("text"), F.lit("</word>"))
    body = w.groupBy("file_id").agg(F.array_join(F.collect_list(word), "").alias("b"))
    pages = body.select("file_id", F.concat(F.lit('<html><page><word xMin="1">lost</word>'), "b", F.lit("</page></html>")).alias("xhtml"))
    return bbox_words(pages).groupBy("file_id").agg(F.count("*").alias("words"), F.sum(F.length("text")).cast("long").alias("chars"))


def _pdf(spark: SparkSession, sf_dir: str) -> file_plan.PdfTables:
    """Each order has three pages: words that are also raw text, raw text or nothing by the key, and a blank one that has OCR."""
    o = orders(spark, sf_dir).select(_key().cast("string").alias("file_id"), "o_orderkey", F.expr(H).alias("h"))
    page = lambda i, text: F.struct(F.lit(i).alias("page_index"), text.alias("raw_text"))
    raw = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("raw "), F.substring("h", 1, 4)))
    each = F.explode(F.array(page(0, F.col("h")), page(1, raw), page(2, F.lit(" "))))
    pages = o.select("file_id", each.alias("p")).select("file_id", "p.*", F.lit(False).alias("has_images"), F.lit(9.0).alias("min_font"))
    words = o.select(
        "file_id",
        F.lit(0).alias("page_index"),
        F.col("h").alias("text"),
        *[F.lit(float(x)).alias(c) for c, x in (("x0", 0), ("y0", 0), ("x1", 64), ("y1", 8))],
    )
    ocr = o.where("o_orderkey % 3 > 0").select(
        "file_id",
        F.lit(2).alias("page_index"),
        F.when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit('"ocr '), F.substring("h", 5, 4), F.lit('"'))).otherwise(F.lit('" "')).alias("payload"),
    )
    return file_plan.PdfTables(pages, words, None, ocr)


@query("""
WITH f AS (SELECT o_orderkey, {H} AS h, CASE WHEN o_orderkey % 2 = 0 THEN 'raw ' || substring({H}, 1, 4) ELSE '' END AS raw, CASE WHEN o_orderkey % 3 = 1 THEN 'ocr ' || substring({H}, 5, 4) ELSE '' END AS ocr FROM orders)
SELECT o_orderkey::VARCHAR AS file_id, h || chr(10) || chr(12) || chr(10) || raw || chr(10) || chr(12) || chr(10) || ocr AS text, (32 + length(raw))::INTEGER AS layer, length(ocr)::INTEGER AS ocr, ocr <> '' AS used_ocr,
  'pdftotext,pymupdf,' || CASE WHEN ocr <> '' THEN 'vision_ocr' ELSE 'pymupdf' END AS providers, 'hybrid' AS provider, 'no_text_layer' AS flags FROM f
""")
def pdf_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = file_plan.pdf_texts(_pdf(spark, sf_dir))
    return t.select(
        "file_id",
        "text",
        F.col("text_layer_char_count").alias("layer"),
        F.col("ocr_char_count").alias("ocr"),
        "used_ocr",
        F.array_join("page_providers", ",").alias("providers"),
        F.col("pdf_provider").alias("provider"),
        F.array_join("quality_flags", ",").alias("flags"),
    )


@query("""
SELECT o_orderkey::VARCHAR AS file_id, 1::INTEGER AS rects, (2.0 * (o_orderkey % 7))::DOUBLE AS x0, (2.0 * (o_orderkey % 7 + 3))::DOUBLE AS x1, CASE WHEN o_orderkey % 2 = 0 THEN 'raw' ELSE '' END AS search FROM orders
""")
def pdf_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One span with boxes, and on every second file one in raw text without them."""
    t = file_plan.pdf_texts(_pdf(spark, sf_dir)).withColumn("k", F.col("file_id").cast("long"))
    boxed, plain = _span(F.col("k") % 7, F.col("k") % 7 + 3, "secret", "x"), _span(35, 38, "secret", "raw")
    r = layout.redaction_rects(
        t.select("file_id", "char_boxes", F.when(F.col("k") % 2 == 0, _spans(boxed, plain)).otherwise(_spans(boxed)).alias("spans"))
    )
    first = F.get("rects", F.lit(0))
    return r.select(
        "file_id",
        F.size("rects").alias("rects"),
        first["x0"].alias("x0"),
        first["x1"].alias("x1"),
        F.array_join("search", ",").alias("search"),
    )


# --- files -----------------------------------------------------------------------------------------------------------


def _as_docx(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts as DOCX files, a paragraph of two runs for each line; those of every seventh order are broken off."""
    space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    for pdf in batches:
        contents = []
        for key, text in zip(pdf["o_orderkey"], pdf["text"], strict=True):
            runs = lambda line: "".join(f'<w:r><w:t xml:space="preserve">{x}</w:t></w:r>' for x in (line[:4], line[4:]))
            body = "".join(f"<w:p>{runs(line)}</w:p>" for line in text.split("\n"))
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w") as z:
                z.writestr("word/document.xml", f'<w:document xmlns:w="{space}"><w:body>{body}</w:body></w:document>')
            contents.append(out.getvalue()[: 20 if key % 7 == 0 else None])
        yield pd.DataFrame({"o_orderkey": pdf["o_orderkey"], "content": contents})


def _docx_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr(f"' a ' || {L} || chr(10) || '  ' || chr(10) || 'mail ' || substring({L}, 1, 6) || '@x.org'")
    made = orders(spark, sf_dir).withColumn("text", text).mapInPandas(_as_docx, "o_orderkey long, content binary")
    return made.withColumns(
        {"path": _key().cast("string"), "filename": F.concat(F.lit("f."), _key().cast("string"), _case([".docx", ".DOCX", ".txt"]))}
    )


_docx_text = "'a ' || {L} || chr(10) || 'mail ' || substring({L}, 1, 6) || '@x.org'"


@query(f"SELECT o_orderkey::VARCHAR AS path, CASE WHEN o_orderkey % 7 <> 0 THEN {_docx_text} END AS text, o_orderkey % 7 = 0 AS failed FROM orders")
def docx_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docx.read_docx(_docx_files(spark, sf_dir)).select("path", "text", F.col("error").isNotNull().alias("failed"))


@query(f"""
SELECT o_orderkey::VARCHAR AS path, CASE WHEN o_orderkey % 7 <> 0 THEN replace(replace({_docx_text}, substring({{L}}, 1, 6) || '@x.org', '<SECRET>'), substring({{L}}, 3, 9), '<SECRET>') END AS text FROM orders
""")
def docx_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that lie across two runs or in one are replaced; the rewritten files are read again."""
    values = F.array(F.concat(F.substring(F.expr(L), 1, 6), F.lit("@x.org")), F.substring(F.expr(L), 3, 9))
    return docx.read_docx(docx.redact_docx(_docx_files(spark, sf_dir).withColumn("redact_values", values))).select("path", "text")


@query(f"""
WITH f AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 2 THEN 'Only .pdf and .docx files are supported' END AS kind, o_orderkey % 7 = 0 AS broken, {_docx_text} AS t, substring({{L}}, 1, 6) || '@x.org' AS m FROM orders)
SELECT o_orderkey::VARCHAR AS path, coalesce(kind, CASE WHEN broken THEN 'BadZipFile: File is not a zip file' END) AS error,
  CASE WHEN kind IS NULL AND NOT broken THEN 'redact' END AS decision, CASE WHEN kind IS NULL AND NOT broken THEN replace(t, m, '<REDACTED>') END AS redacted_text FROM f
""")
def file_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files through the whole plan: unsupported and broken ones get an error."""
    r = file_plan.redact_files(with_suffix(_docx_files(spark, sf_dir)).withColumn("mode", F.lit("redact")))
    return r.select("path", "error", "decision.decision", "redacted_text")


@query("""
SELECT 'f.' || o_orderkey::VARCHAR || '_redacted.docx' AS download_name, 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' AS media_type, 0::INTEGER AS secrets_found, 1::INTEGER AS spans_total
FROM orders WHERE o_orderkey % 3 < 2 AND o_orderkey % 7 <> 0
""")
def file_downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = download(file_plan.deliver(file_plan.redact_files(with_suffix(_docx_files(spark, sf_dir)))))
    return d.where("content is not null").select("download_name", "media_type", "secrets_found", "spans_total")
