"""Decision expressions: the three-way classification and the quality checks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from attestra import fixed_values as fixed
from attestra.functions.numeric import exact_decimal


def classify(delta: Column, tau: Column) -> Column:
    """Above the band, below it, or inside it (both edges belong to the band)."""
    exact, band = exact_decimal(delta), exact_decimal(tau)
    inside = "EFFECT_WITHIN_OPERATIONAL_INDIFFERENCE_BAND"
    no_codes = F.array().cast("array<string>")
    verdict = lambda status, disposition, codes: F.struct(
        F.lit(status).alias("execution_status"),
        F.lit(disposition).alias("evidence_disposition"),
        codes.alias("reason_codes"),
    )
    return (
        F.when(exact.isNull() | band.isNull() | (band < 0), F.lit(None))
        .when(exact > band, verdict("COMPLETED", "CORROBORATING", no_codes))
        .when(exact < -band, verdict("COMPLETED", "CONTRADICTORY", no_codes))
        .otherwise(verdict("ABSTAINED", "INCONCLUSIVE", F.array(F.lit(inside))))
    )


def classifications(delta: Column) -> Column:
    """Primary and three sensitivity verdicts as an array, ready to explode."""
    entries = [(True, fixed.PRIMARY_TAU)] + [(False, tau) for tau in fixed.SENSITIVITY_TAUS]
    return F.array(*[
        F.struct(
            F.lit(primary).alias("is_primary"),
            F.lit(float(tau)).alias("tau"),
            classify(delta, F.lit(float(tau))).alias("verdict"),
        )
        for primary, tau in entries
    ])


def quality_checks(codes: Column, complete_system: Column) -> Column:
    """PASS / FAIL / NOT_RUN per check from the reason codes of one run."""
    low = F.arrays_overlap(codes, F.array(F.lit("VALID_OBSERVATION_COVERAGE_LOW"), F.lit("RADIOMETRY_METADATA_UNRESOLVED")))
    limited = F.arrays_overlap(codes, F.array(F.lit("RESOURCE_LIMIT_EXCEEDED"), F.lit("METADATA_INVENTORY_LIMIT_EXCEEDED")))
    coverage = F.when(limited, "NOT_RUN").when(low, "FAIL").otherwise("PASS")
    system = F.when(limited | ~complete_system, "FAIL").otherwise("PASS")
    computed = {"observation_coverage": coverage, "system_execution": system}
    return F.struct(*[computed.get(name, F.lit("PASS")).alias(name) for name in fixed.QUALITY_CHECKS])


def ordered_codes(codes: Column) -> Column:
    """Reason codes in registry order."""
    position = F.create_map(*[F.lit(v) for i, (code, _) in enumerate(fixed.REASON_CODES) for v in (code, i)])
    keyed = F.transform(codes, lambda c: F.struct(position[c].alias("ord"), c.alias("code")))
    return F.transform(F.array_sort(keyed), lambda s: s["code"])
