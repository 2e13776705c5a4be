"""Retrieval evaluation end to end: scores, expected ranks, metrics, decision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from attestra import fixed_values as fixed
from attestra.operators import retrieval


def evaluate(documents: DataFrame, cases: DataFrame, subject: Sequence[str]) -> DataFrame:
    """Is another mode materially better than token overlap on these cases?"""
    ranks = retrieval.expected_ranks(documents, cases, subject)
    return retrieval.decision(retrieval.metrics(ranks), fixed.MATERIAL_GAIN_MIN)
