"""The same plan on streams, and running metrics with bounded state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veilstream.operators.metrics import LAST
from veilstream.plans.requests import redact_requests


def redact_stream(requests: DataFrame, mode: str = "balanced") -> DataFrame:
    """Stateless, so a stream gives what a batch of the same rows gives."""
    return redact_requests(requests, mode)


def running_metrics(records: DataFrame, size: int = LAST) -> DataFrame:
    """records (endpoint, seq, total_seconds) to each endpoint's count so far and the mean of its last `size` records, in
    update mode. The state of an endpoint is its count and at most `size` numbers."""

    def run(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, seqs, seconds = state.get if state.exists else (0, [], [])
        held = list(zip(seqs, seconds, strict=True))
        for pdf in batches:
            count += len(pdf)
            held = sorted([*held, *zip(pdf["seq"].tolist(), pdf["total_seconds"].tolist(), strict=True)])[-size:]
        state.update((count, [int(s) for s, _ in held], [float(x) for _, x in held]))
        yield pd.DataFrame({"endpoint": [key[0]], "total_requests": [count], "avg_total": [round(sum(x for _, x in held) / len(held), 6)]})

    return records.groupBy("endpoint").applyInPandasWithState(
        run,
        "endpoint string, total_requests long, avg_total double",
        "count long, seqs array<long>, seconds array<double>",
        "update",
        GroupStateTimeout.NoTimeout,
    )
