"""Benchmark evaluation end to end: stored results against expectations, a second run and the facts they cite."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from attestra.operators import evaluation
from attestra.plans import qualification


def evaluate(cases: DataFrame, stored: DataFrame, recomputed: DataFrame, facts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Outcome rates of cases (request columns plus expectations).

    ``stored`` holds the results as they were kept, ``recomputed`` those of a run
    on the same requests now (both as `qualification.result_records` makes them).
    A stored statement counts as unsupported where its cited facts do not say it.
    """
    unsupported = qualification.unsupported_statements(stored, cases, facts)
    return evaluation.outcome_rates(evaluation.compare_outcomes(cases, stored, recomputed, unsupported), by)
