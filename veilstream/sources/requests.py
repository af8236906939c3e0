"""Presets for upstream integrations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Payload fields of each integration.
LINEAR = {"source": "linear_comment", "target": "linear", "mode": "redact"}
SYMPHONY = {"source": "symphony_prompt", "target": "ai_model", "mode": "block"}


def preset(texts: DataFrame, fields: dict[str, str], source: str | None = None) -> DataFrame:
    return texts.withColumns({k: F.lit(source if source and k == "source" else v) for k, v in fields.items()})
