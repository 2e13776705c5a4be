"""Benchmark evaluation: outcome rates, denominators, latency, split checks, corpora."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from attestra.functions import hashing, quantiles, text
from attestra.functions.hashing import tree_digest
from attestra.functions.numeric import rate


def outcome_rates(outcomes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rates over case outcomes; nothing out of nothing is one.

    Columns: exact, replay_equal, unsupported, security_case, non_inference_ok,
    expected_refused, refused_clean (all boolean).
    """
    count = lambda condition: F.count_if(condition)
    return outcomes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("case_count"),
        rate(count(F.col("exact")), F.count(F.lit(1))).alias("exact_outcome_rate"),
        rate(count(F.col("expected_refused") & F.col("refused_clean")), count(F.col("expected_refused"))).alias(
            "forbidden_request_refusal_rate"
        ),
        rate(count(F.col("replay_equal")), F.count(F.lit(1))).alias("deterministic_replay_rate"),
        rate(count(F.col("unsupported")), F.count(F.lit(1))).alias("unsupported_assertion_rate"),
        rate(count(F.col("security_case") & F.col("exact") & F.col("non_inference_ok")), count(F.col("security_case"))).alias(
            "security_case_pass_rate"
        ),
    )


def unsupported(non_inference: Column, status: Column, reference_count: Column, statement: Column) -> Column:
    """A failed inference check, a verdict without references, or a refusal that still states something."""
    return (
        (non_inference != "PASS") | ((status == "QUALIFIED") & (reference_count == 0)) | ((status == "REFUSED") & statement.isNotNull())
    )


def compare_outcomes(cases: DataFrame, stored: DataFrame, recomputed: DataFrame, unsupported_ids: DataFrame) -> DataFrame:
    """Case outcomes from expectations, the stored result records and the records computed again.

    ``replay_equal``: all fields of both records have one hash. ``unsupported_ids``
    are the requests whose stored statement their citations do not carry. A case
    without a stored result is neither exact nor replayed, and asserts nothing.
    """
    fields = sorted(c for c in recomputed.columns if c != "result_sha256")
    first = hashing.with_record_sha256(stored, fields, "_hash").select(
        "request_id", F.struct("workflow_status", "qualification", "reason_codes").alias("first"), F.col("assurance_checks.non_inference").alias("_inference"),
        F.coalesce(F.size("evidence_refs"), F.lit(0)).alias("_refs"), F.col("bounded_statement").alias("_statement"), "_hash",
    )
    second = hashing.with_record_sha256(recomputed, fields, "_again").select("request_id", "_again")
    unfounded = unsupported_ids.select("request_id", F.lit(True).alias("_unfounded"))
    joined = cases.join(first, "request_id", "left").join(second, "request_id", "left").join(unfounded, "request_id", "left")
    expected = F.struct(
        F.col("expected_workflow_status").alias("workflow_status"), F.col("expected_qualification").alias("qualification"),
        F.col("expected_reason_codes").alias("reason_codes"),
    )
    status = F.col("first.workflow_status")
    never = lambda condition: F.coalesce(condition, F.lit(False))
    return joined.select(
        *cases.columns, expected.eqNullSafe(F.col("first")).alias("exact"), never(F.col("_hash") == F.col("_again")).alias("replay_equal"),
        (never(unsupported(F.col("_inference"), status, F.col("_refs"), F.col("_statement"))) | never(F.col("_unfounded"))).alias("unsupported"),
        never(F.col("_inference") == "PASS").alias("non_inference_ok"),
        (F.col("expected_workflow_status") == "REFUSED").alias("expected_refused"),
        never((status == "REFUSED") & (F.col("_refs") == 0)).alias("refused_clean"),
    )


def denominators(cases: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Case counts along several dimensions in one pass (grouping sets)."""
    sets = [[F.col(d)] for d in dimensions]
    named = F.lit(None).cast("string")
    value = F.lit(None).cast("string")
    grouped = cases.groupingSets(sets, *dimensions).agg(
        F.count(F.lit(1)).alias("case_count"), *[F.grouping(d).alias(f"_g_{d}") for d in dimensions]
    )
    for d in dimensions:
        named = F.when(F.col(f"_g_{d}") == 0, F.lit(d)).otherwise(named)
        value = F.when(F.col(f"_g_{d}") == 0, F.col(d).cast("string")).otherwise(value)
    return grouped.select(named.alias("dimension"), value.alias("value"), "case_count")


def threshold_checks(rates: DataFrame, thresholds: Mapping[str, tuple[str, float]], by: Sequence[str] = ()) -> DataFrame:
    """One boolean per threshold (``min`` or ``max``) and the overall PASS or FAIL."""
    checks = [
        (F.col(name) >= bound if side == "min" else F.col(name) <= bound).alias(f"check_{name}")
        for name, (side, bound) in thresholds.items()
    ]
    passed = F.lit(True)
    for name in thresholds:
        passed = passed & F.col(f"check_{name}")
    return rates.select(*by, *checks).withColumn("evaluation_status", F.when(passed, "PASS").otherwise("FAIL"))


def latency_summary(samples: DataFrame, keys: Sequence[str], value: str, digits: int = 3) -> DataFrame:
    """Count, median, nearest-rank 95th percentile, minimum and maximum, rounded."""
    keys = list(keys)
    joined = quantiles.grouped_quantiles(samples, keys, value, [0.5, 0.95], ["p50", "p95"], nearest_rank=[False, True])
    rounded = [F.round(c, digits).alias(n) for c, n in (("p50", "p50_ms"), ("p95", "p95_ms"), ("minimum", "min_ms"), ("maximum", "max_ms"))]
    return joined.select(*keys, F.col("n").alias("sample_count"), *rounded)


def partition_keys(cases: DataFrame, dimensions: Mapping[str, Column]) -> DataFrame:
    """Distinct (split, dimension, key); array-valued dimensions count every element."""
    def keyed(name: str, column: Column) -> Column:
        return F.transform(column, lambda v: F.struct(F.lit(name).alias("dimension"), v.cast("string").alias("key")))

    entries = [keyed(name, column) for name, column in dimensions.items()]
    return cases.select("split", F.inline(F.concat(*entries))).distinct()


def split_leakage(keys: DataFrame) -> DataFrame:
    """Keys that occur in more than one split."""
    return keys.groupBy("dimension", "key").agg(F.count_distinct("split").alias("split_count")).filter("split_count > 1")


def case_corpus(subjects: DataFrame, templates: Sequence[tuple[str, str]], held_out: Column, parameters: Mapping[str, Column]) -> DataFrame:
    """Every subject with every question template, split by the subject's group."""
    listed = F.array(*[
        F.struct(F.lit(i + 1).alias("template_no"), F.lit(name).alias("category"), F.lit(body).alias("template"))
        for i, (name, body) in enumerate(templates)
    ])
    rows = subjects.withColumn("split", F.when(held_out, "HELD_OUT").otherwise("DEVELOPMENT")).select("*", F.inline(listed))
    return rows.withColumn("question", text.fill_template(F.col("template"), dict(parameters))).drop("template")


def holdout_freeze(cases: DataFrame, identifier: str, content: Column, split: str = "HELD_OUT") -> DataFrame:
    """Count and digest of one split, per split value, of any size."""
    held = cases.filter(F.col("split") == split).withColumn("_content", F.sha2(content.cast("binary"), 256))
    return tree_digest(held, ["split"], identifier, "_content", "held_out_sha256")
