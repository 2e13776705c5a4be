"""A stream of requests qualified against the evidence gathered so far."""

from __future__ import annotations

from pyspark.sql import DataFrame

from attestra.plans import qualification
from attestra.streaming.sinks import drain, write_batch


def qualify_stream(requests: DataFrame, gathered: DataFrame, rules: DataFrame, path: str, checkpoint: str | None = None) -> None:
    """Stream-static joins with the same gates as the batch form; one folder per batch."""
    results = qualification.qualify(requests, gathered, rules)
    drain(results, lambda batch, batch_id: write_batch(batch, path, batch_id), checkpoint=checkpoint)
