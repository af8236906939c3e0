"""A training-corpus pipeline over `documents`: reject, deduplicate, decontaminate, redact, mix.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor kept; all but the last return the columns
of docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilstream.llm import decontam, mixing, quality, secretscan
from veilstream.llm.minhash import one_of_each
from veilstream.llm.store import Store

LEAST_QUALITY = 0.3


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches LEAST_QUALITY; without labels, all. Null and empty texts score as an empty document
    does, repeated rows alike. An empty table stays empty, as in every stage; extra columns stay in all but the last."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model, "_veil_quality").where(F.col("_veil_quality") >= LEAST_QUALITY).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): the one of the smallest doc_id.
    Rows of one doc_id with different texts are different documents, rows alike in both are one. Those without words stay."""
    return one_of_each(docs, k=5, percent=80)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark passage is found; null and empty texts hold none, and rows are dropped one by one, with
    or without doc_id. Without a benchmark, all."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by <SECRET> (overlapping ones by one), and n_chars, where there is one, of the new
    text. Rows without secrets, null texts among them, stay as they are."""
    found = secretscan.scan(docs)
    out = found.withColumn("text", secretscan.redact(F.col("text"), F.col(secretscan.SECRETS), "<SECRET>"))
    if "n_chars" in docs.columns:
        out = out.withColumn(
            "n_chars",
            F.when(F.size(secretscan.SECRETS) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType),
        )
    return out.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them: doc_id, source, n_tokens, weight, pass. A null source is one of its own;
    repeated rows each count; documents without words go with their block; sources without words have no weight."""
    return mixing.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_benchmark_copies),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]

ORACLE_SQL = None  # the classifier and the alignment have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
