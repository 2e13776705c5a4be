"""From pixels to a bounded assessment: coverage, medians, verdicts, statement."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from attestra import fixed_values as fixed
from attestra.functions import decision, text
from attestra.functions.numeric import exact_decimal
from attestra.operators import pixels as px
from attestra.session import cut_lineage


def aggregate_cases(observations: DataFrame, aoi: DataFrame) -> DataFrame:
    """One row per case: coverage, medians, exact delta and the delta distribution.

    ``observations`` carries ``ndvi`` (see :func:`px.with_ndvi`). A case with
    too few acquisitions keeps its totals and loses its measurements.
    """
    inside = px.restrict_to_aoi(observations, aoi)
    aoi_pixels = cut_lineage(px.over_aoi(px.composites(px.mosaic(inside)), aoi))
    coverage = px.joint_coverage(aoi_pixels, px.acquisition_counts(observations))
    spread = px.measure_distributions(aoi_pixels)
    median_of = lambda m: F.max(F.when(F.col("measure") == m, F.col("median")))
    delta_of = lambda c: F.max(F.when(F.col("measure") == "DELTA", F.col(c)))
    wide = spread.groupBy("case_id").agg(
        median_of("PRE").alias("_pre"), median_of("POST").alias("_post"),
        *[delta_of(c).alias(f"_{c}") for c in ("n", *fixed.QUANTILE_NAMES, "iqr", "mad")],
    )
    kept = lambda c: F.when(F.col("enough_acquisitions"), F.col(c))
    joined = coverage.join(wide, "case_id", "left")
    return joined.select(
        *coverage.columns,
        kept("_pre").alias("pre_window_ndvi_median"),
        kept("_post").alias("post_window_ndvi_median"),
        kept("_n").alias("delta_count"),
        *[kept(f"_{c}").alias(f"delta_{c}") for c in (*fixed.QUANTILE_NAMES, "iqr", "mad")],
    ).withColumn(
        "delta_ndvi",
        (exact_decimal(F.col("post_window_ndvi_median")) - exact_decimal(F.col("pre_window_ndvi_median"))).cast("double"),
    )


def qualify(aggregated: DataFrame) -> DataFrame:
    """Add the primary verdict; low coverage overrides any classification."""
    low = F.struct(
        F.lit("ABSTAINED").alias("execution_status"),
        F.lit("INCONCLUSIVE").alias("evidence_disposition"),
        F.array(F.lit("VALID_OBSERVATION_COVERAGE_LOW")).alias("reason_codes"),
    )
    verdict = F.when(~F.col("coverage_passed"), low).otherwise(
        decision.classify(F.col("delta_ndvi"), F.lit(float(fixed.PRIMARY_TAU)))
    )
    return aggregated.withColumn("_v", verdict).select(*aggregated.columns, "_v.*")


def verdict_rows(aggregated: DataFrame) -> DataFrame:
    """Primary and sensitivity verdicts of every case whose coverage passed."""
    return (
        aggregated.filter("coverage_passed")
        .select("case_id", "delta_ndvi", F.explode(decision.classifications(F.col("delta_ndvi"))).alias("c"))
        .select("case_id", "delta_ndvi", "c.is_primary", "c.tau", "c.verdict.*")
    )


def assess(qualified: DataFrame, parameters: Mapping[str, Column]) -> DataFrame:
    """Assessment row: status, disposition, reasons, checks, observations, statement."""
    complete = F.col("coverage_passed") & F.col("delta_ndvi").isNotNull() & F.col("delta_median").isNotNull()
    completed = F.col("execution_status") == "COMPLETED"
    filled = {
        **parameters,
        "pre_value": F.col("pre_window_ndvi_median"),
        "post_value": F.col("post_window_ndvi_median"),
        "delta_value": F.col("delta_ndvi"),
        "primary_tau": F.lit(fixed.PRIMARY_TAU),
    }
    template = F.when(F.col("evidence_disposition") == "CORROBORATING", F.lit(fixed.STATEMENT_TEMPLATES["CORROBORATING"])).when(
        F.col("evidence_disposition") == "CONTRADICTORY", F.lit(fixed.STATEMENT_TEMPLATES["CONTRADICTORY"])
    )
    return qualified.select(
        "case_id", "execution_status", "evidence_disposition",
        decision.ordered_codes(F.col("reason_codes")).alias("reason_codes"),
        decision.quality_checks(F.col("reason_codes"), F.lit(True)).alias("quality_checks"),
        F.when(complete, "COMPLETE").otherwise("PARTIAL").alias("observation_status"),
        "aoi_total_pixels", "aoi_valid_pixels", "aoi_valid_fraction",
        "pre_window_ndvi_median", "post_window_ndvi_median", "delta_ndvi",
        F.when(complete, F.lit(float(fixed.PRIMARY_TAU))).alias("primary_tau"),
        F.when(completed, F.concat(F.lit("OBSERVATIONAL_COMPARISON_"), F.col("evidence_disposition"), F.lit("_V2"))).alias(
            "statement_template_id"
        ),
        F.when(completed, text.fill_template(template, filled)).alias("supported_statement"),
        (~completed).alias("human_review_required"),
    )


def terminal_assessment(runs: DataFrame) -> DataFrame:
    """Assessment of runs that stopped before any pixel was read (reasons only)."""
    return runs.select(
        "case_id",
        F.lit("ABSTAINED").alias("execution_status"),
        F.lit("INCONCLUSIVE").alias("evidence_disposition"),
        decision.ordered_codes(F.col("reason_codes")).alias("reason_codes"),
        decision.quality_checks(F.col("reason_codes"), F.lit(False)).alias("quality_checks"),
        F.lit(True).alias("human_review_required"),
    )


def invariant_violations(assessments: DataFrame) -> DataFrame:
    """(case, rule) rows for each broken arithmetic or classification rule of an assessment.

    Where the rows have ``reason_codes``, ``policy_id`` with ``frozen_policy_id``,
    or ``sensitivity_results`` (tau, status, disposition and codes in order of
    tau), complete rows are held to those too.
    """
    total, valid, frac = F.col("aoi_total_pixels"), F.col("aoi_valid_pixels"), F.col("aoi_valid_fraction")
    pre, post, delta = F.col("pre_window_ndvi_median"), F.col("post_window_ndvi_median"), F.col("delta_ndvi")
    primary = decision.classify(delta, F.lit(float(fixed.PRIMARY_TAU)))
    complete = F.col("observation_status") == "COMPLETE"
    rules = {
        "PIXELS_NEGATIVE": (total < 0) | (valid < 0),
        "VALID_EXCEEDS_TOTAL": valid > total,
        "FRACTION_OUT_OF_RANGE": ~frac.between(0, 1),
        "FRACTION_ARITHMETIC": (total > 0) & (F.abs(frac - valid / total) > 1e-12),
        "MEDIAN_OUT_OF_RANGE": ~pre.between(-1, 1) | ~post.between(-1, 1),
        "DELTA_OUT_OF_RANGE": ~delta.between(-2, 2),
        "DELTA_NOT_DIFFERENCE": complete & ((exact_decimal(post) - exact_decimal(pre)) != exact_decimal(delta)),
        "TAU_NOT_FROZEN": exact_decimal(F.col("primary_tau")) != exact_decimal(F.lit(float(fixed.PRIMARY_TAU))),
        "COMPLETED_WITHOUT_OBSERVATIONS": (F.col("execution_status") == "COMPLETED") & ~complete,
        "STATUS_MISMATCH": complete & (F.col("execution_status") != primary["execution_status"]),
        "DISPOSITION_MISMATCH": complete & (F.col("evidence_disposition") != primary["evidence_disposition"]),
    }
    if "reason_codes" in assessments.columns:
        rules["REASONS_MISMATCH"] = complete & ~F.col("reason_codes").eqNullSafe(primary["reason_codes"])
    if "policy_id" in assessments.columns:
        rules["POLICY_MISMATCH"] = complete & ~F.col("policy_id").eqNullSafe(F.col("frozen_policy_id"))
    if "sensitivity_results" in assessments.columns:
        rules["SENSITIVITY_MISMATCH"] = complete & ~F.col("sensitivity_results").eqNullSafe(sensitivities(delta))
    broken = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return assessments.select("case_id", F.explode(broken).alias("rule"))


def sensitivities(delta: Column) -> Column:
    """The verdicts of the secondary bands as a result stores them."""
    others = F.filter(decision.classifications(delta), lambda c: ~c["is_primary"])
    return F.transform(others, lambda c: F.struct(
        c["tau"].alias("tau"), c["verdict"]["execution_status"].alias("execution_status"),
        c["verdict"]["evidence_disposition"].alias("evidence_disposition"), c["verdict"]["reason_codes"].alias("reason_codes")))


SCOPE = ("project_id", "analysis_boundary_role", "pre_window", "post_window", "seasonal_rule_id", "aggregation", "eligible_population",
         "indifference_policy_id", "qualification_policy_version")


def completed_violations(assessments: DataFrame, forbidden: Sequence[str]) -> DataFrame:
    """(case, rule) rows for what a stored assessment must hold beyond its numbers.

    Every assessment names its manifest and lists all ``forbidden`` claims once,
    in order. A completed one also has the template of its disposition, the
    case's own scope among its parameters, and exactly the text the template
    gives, without forbidden words. Rows hold statement_parameters and
    case_scope (string maps), must_not_claim and provenance_manifest_ref.
    """
    completed = F.col("execution_status") == "COMPLETED"
    disposition, parameters = F.col("evidence_disposition"), F.col("statement_parameters")
    rendered = F.lit(None).cast("string")
    for name, template in fixed.STATEMENT_TEMPLATES.items():
        values = {p: F.element_at(parameters, F.lit(p)) for p in (*SCOPE, "pre_value", "post_value", "delta_value", "primary_tau")}
        rendered = F.when(disposition == name, text.fill_template(F.lit(template), values)).otherwise(rendered)
    same_scope = F.lit(True)
    for p in SCOPE:
        same_scope = same_scope & F.element_at(parameters, F.lit(p)).eqNullSafe(F.element_at("case_scope", F.lit(p)))
    statement = F.col("supported_statement")
    rules = {
        "MANIFEST_REF_MISSING": F.coalesce(F.length(F.trim("provenance_manifest_ref")), F.lit(0)) == 0,
        "MUST_NOT_CLAIM_INCOMPLETE": ~F.col("must_not_claim").eqNullSafe(F.array(*[F.lit(c) for c in forbidden])),
        "TEMPLATE_MISMATCH": completed & ~F.col("statement_template_id").eqNullSafe(F.concat(F.lit("OBSERVATIONAL_COMPARISON_"), disposition, F.lit("_V2"))),
        "SCOPE_MISMATCH": completed & ~same_scope,
        "STATEMENT_NOT_RENDERED": completed & ~statement.eqNullSafe(rendered),
        "FORBIDDEN_LANGUAGE": completed & F.coalesce(text.forbidden_language(statement), F.lit(False)),
    }
    broken = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return assessments.select("case_id", F.explode(broken).alias("rule"))
