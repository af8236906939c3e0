"""The span type shared by all detectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,label:string,kind:string,source:string,score:double,reason_codes:array<string>,text:string,placeholder:string>"
SPANS = f"array<{SPAN}>"


def span(
    start: Column,
    end: Column,
    text: Column,
    label: str,
    kind: str | Column,
    source: str,
    score: float | Column,
    reasons: list[str] | Column,
) -> Column:
    column = lambda x: x if isinstance(x, Column) else F.lit(x)
    codes = reasons if isinstance(reasons, Column) else F.array(*[F.lit(r) for r in reasons])
    fields = {
        "start": start,
        "end": end,
        "label": F.lit(label),
        "kind": column(kind),
        "source": F.lit(source),
        "score": column(score).cast("double"),
        "reason_codes": codes,
        "text": text,
        "placeholder": F.lit(None).cast("string"),
    }
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def empty() -> Column:
    return F.array().cast(SPANS)
