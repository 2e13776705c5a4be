"""Data-quality rows: rule violations, scans, lineage references, linked records.

Bad records never stop a job by themselves: each rule yields (id, rule) rows
beside the good ones, and :func:`require_none` turns any of them into a failure.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from attestra import fixed_values as fixed
from attestra.functions import text, uri
from attestra.functions.decision import ordered_codes
from attestra.functions.numeric import finite


def violations(rows: DataFrame, identifier: Sequence[str], rules: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """(id, path, rule) for each rule whose condition is true; NULL counts as broken."""
    found = F.array_compact(F.array(*[
        F.when(F.coalesce(broken, F.lit(True)), F.struct(F.lit(path).alias("path"), F.lit(name).alias("rule")))
        for name, (path, broken) in rules.items()
    ]))
    return rows.select(*identifier, F.inline(found))


def first_violation(found: DataFrame, identifier: Sequence[str]) -> DataFrame:
    """The first violation of each record by path, then rule."""
    return found.groupBy(*identifier).agg(F.min(F.struct("path", "rule")).alias("_first"), F.count(F.lit(1)).alias("violation_count")).select(
        *identifier, "_first.path", "_first.rule", "violation_count"
    )


def require_none(found: DataFrame, what: str) -> None:
    """Strict mode: raise if any violation exists (reads at most one row back)."""
    first = found.head(1)
    if first:
        raise ValueError(f"{what}: {first[0].asDict()}")


def non_finite(rows: DataFrame, identifier: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Where a present number is NaN or infinite."""
    found = F.array_compact(F.array(*[
        F.when(F.col(c).isNotNull() & ~finite(F.col(c)), F.lit(c)) for c in columns
    ]))
    return rows.select(*identifier, F.explode(found).alias("path"))


def distribution_violations(rows: DataFrame, identifier: Sequence[str]) -> DataFrame:
    """Quantiles out of order, negative spread, or an empty population."""
    q = [F.col(n) for n in fixed.QUANTILE_NAMES]
    ordered = (q[0] <= q[1]) & (q[1] <= q[2]) & (q[2] <= q[3]) & (q[3] <= q[4])
    return violations(rows, identifier, {
        "COUNT_NOT_POSITIVE": ("n", F.col("n") < 1),
        "QUANTILES_UNORDERED": ("quantiles", ~ordered),
        "IQR_NEGATIVE": ("iqr", F.col("iqr") < 0),
        "MAD_NEGATIVE": ("mad", F.col("mad").isNotNull() & (F.col("mad") < 0)),
    })


def duplicates(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences")).filter("occurrences > 1")


def set_differences(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Distinct keys missing from, or extra in, the actual side."""
    left = expected.select(key).distinct().withColumn("_expected", F.lit(True))
    right = actual.select(key).distinct().withColumn("_actual", F.lit(True))
    kind = F.when(F.col("_actual").isNull(), "MISSING").when(F.col("_expected").isNull(), "EXTRA")
    return left.join(right, key, "full_outer").select(key, kind.alias("difference")).filter("difference IS NOT NULL")


# --- scans -------------------------------------------------------------------------


def secret_scan(rows: DataFrame, identifier: Sequence[str], content: str) -> DataFrame:
    """One finding per secret pattern that occurs in a text."""
    return rows.select(*identifier, F.explode(text.secret_findings(F.col(content))).alias("finding"))


def signed_urls(rows: DataFrame, identifier: Sequence[str], url: str) -> DataFrame:
    """URLs with a signing query parameter, and the names found."""
    names = F.array_sort(F.array_distinct(uri.signed_url_names(F.col(url))))
    return rows.select(*identifier, names.alias("names"), uri.host(F.col(url)).alias("host")).filter(F.size("names") > 0)


def redact_urls(rows: DataFrame) -> DataFrame:
    """Query and fragment removed from every http(s) value of ``*_uri``, ``*_url`` and ``*_identity`` columns."""
    plain = lambda c: F.when(c.rlike("^https?:"), uri.strip_query(c)).otherwise(c)
    out = []
    for field in rows.schema:
        column = F.col(field.name)
        kind = field.dataType.simpleString()
        if not field.name.endswith(("_uri", "_url", "_identity")):
            out.append(column)
        elif kind == "string":
            out.append(plain(column).alias(field.name))
        elif kind == "array<string>":
            out.append(F.transform(column, plain).alias(field.name))
        elif kind == "map<string,string>":
            out.append(F.transform_values(column, lambda _, v: plain(v)).alias(field.name))
        else:
            out.append(column)
    return rows.select(*out)


# --- references and registries -----------------------------------------------------------


def dangling_references(records: DataFrame, identifier: Sequence[str], references: str, artifacts: DataFrame, key: str) -> DataFrame:
    """References that resolve to no artifact."""
    refs = records.select(*identifier, F.explode(references).alias("reference"))
    known = artifacts.select(F.col(key).alias("reference")).distinct()
    return refs.join(known, "reference", "left_anti").select(*identifier, "reference")


def unregistered(records: DataFrame, column: str, registry: DataFrame, key: str) -> DataFrame:
    """Names used by records that the (small) registry lacks, with their use counts."""
    used = records.groupBy(F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("uses"))
    return used.join(registry.select(F.col(key).alias("name")), "name", "left_anti")


def linked_mismatches(assessments: DataFrame, manifests: DataFrame, key: str, compared: Mapping[str, tuple[str, str]]) -> DataFrame:
    """(key, mismatch) per differing field of records that should describe one run."""
    left = assessments.withColumn("_left", F.lit(True))
    both = left.join(manifests.withColumn("_right", F.lit(True)), key, "full_outer")
    paired = F.col("_left").isNotNull() & F.col("_right").isNotNull()
    checks = [
        F.when(F.col("_right").isNull(), F.lit("MANIFEST_MISSING")), F.when(F.col("_left").isNull(), F.lit("ASSESSMENT_MISSING")),
        *[F.when(paired & ~F.col(a).eqNullSafe(F.col(m)), F.lit(name)) for name, (a, m) in compared.items()],
    ]
    return both.select(key, F.explode(F.array_compact(F.array(*checks))).alias("mismatch"))


def source_bindings(records: DataFrame, bindings: DataFrame) -> DataFrame:
    """Project sources against their case's bindings: allowed, frozen, identical URI, once each."""
    joined = records.join(
        bindings.select("case_id", "source_id", "binding_status", F.col("canonical_uri").alias("_bound")), ["case_id", "source_id"], "full_outer"
    )
    kind = (
        F.when(F.col("binding_status").isNull(), "SOURCE_NOT_ALLOWED")
        .when((F.col("binding_status") != "FROZEN") | F.col("_bound").isNull(), "BINDING_NOT_FROZEN")
        .when(F.col("canonical_uri").isNull(), "SOURCE_RECORD_MISSING")
        .when(F.col("canonical_uri") != F.col("_bound"), "URI_DIFFERS_FROM_BINDING")
    )
    return joined.select("case_id", "source_id", kind.alias("violation")).filter("violation IS NOT NULL")


def binding_cardinality(allowed: DataFrame, bindings: DataFrame) -> DataFrame:
    """Exactly one binding per allowed source; pending ones need a discovery URI and no canonical one."""
    per_source = bindings.groupBy("case_id", "source_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.max((F.col("binding_status") == "PENDING_STEP_2") & F.col("canonical_uri").isNotNull()).alias("_fabricated"),
        F.max((F.col("binding_status") == "PENDING_STEP_2") & F.col("discovery_uri").isNull()).alias("_undiscovered"),
        F.max((F.col("binding_status") == "FROZEN") & F.col("canonical_uri").isNull()).alias("_unfrozen"),
    )
    joined = allowed.withColumn("_allowed", F.lit(True)).join(per_source, ["case_id", "source_id"], "full_outer")
    kind = (
        F.when(F.col("_allowed").isNull(), "BINDING_EXTRA").when(F.col("_n").isNull(), "BINDING_MISSING")
        .when(F.col("_n") > 1, "BINDING_DUPLICATE").when(F.col("_fabricated"), "PENDING_WITH_CANONICAL_URI")
        .when(F.col("_undiscovered"), "PENDING_WITHOUT_DISCOVERY_URI").when(F.col("_unfrozen"), "FROZEN_WITHOUT_CANONICAL_URI")
    )
    return joined.select("case_id", "source_id", kind.alias("violation")).filter("violation IS NOT NULL")


def record_cardinality(records: DataFrame, run: str, primary: Column, sensitivities: int) -> DataFrame:
    """Runs without exactly one primary and the given number of sensitivity records."""
    return records.groupBy(run).agg(
        F.count_if(primary).alias("primary_count"), F.count_if(~primary).alias("sensitivity_count")
    ).withColumn("complete", (F.col("primary_count") == 1) & (F.col("sensitivity_count") == sensitivities))


def exact_members(records: DataFrame, keys: Sequence[str], member: str, expected: Sequence[str]) -> DataFrame:
    """Does each key hold exactly the expected members?"""
    return records.groupBy(*keys).agg(
        (F.coalesce(F.bool_and(F.col(member).isin(*expected)), F.lit(False)) & (F.count_distinct(member) == len(expected))).alias("exact")
    )


# --- reason semantics -----------------------------------------------------------------------


def reason_violations(assessments: DataFrame) -> DataFrame:
    """(run, rule) rows: unknown, duplicate, unordered, incompatible or status-breaking reason codes.

    The registry is small and fixed, so its rules are literals of the plan.
    """
    codes, status, disposition = F.col("reason_codes"), F.col("execution_status"), F.col("evidence_disposition")
    names = [code for code, _ in fixed.REASON_CODES]
    has = lambda *wanted: F.arrays_overlap(codes, F.array(*[F.lit(w) for w in wanted]))
    of_category = lambda *cs: [code for code, c in fixed.REASON_CODES if c in cs]
    authority = of_category("AUTHORITY")
    waiting = [c for c in names if c not in authority and c != fixed.SYSTEM_CODE]
    rules = {
        "UNKNOWN_REASON": F.size(F.array_except(codes, F.array(*[F.lit(n) for n in names]))) > 0,
        "DUPLICATE_REASON": F.size(codes) != F.size(F.array_distinct(codes)),
        "UNORDERED_REASONS": codes != ordered_codes(codes),
        "INCOMPATIBLE_REASONS": has(fixed.BAND_CODE) & has(*fixed.BAND_INCOMPATIBLE) | has(fixed.SYSTEM_CODE) & has(*authority),
        "STATUS_NOT_ALLOWED": (has(*waiting) & (status != "ABSTAINED")) | (has(*authority) & (status != "REFUSED"))
        | (has(fixed.SYSTEM_CODE) & (status != "ERROR")),
        "DISPOSITION_NOT_ALLOWED": (has(*waiting) & ~disposition.eqNullSafe("INCONCLUSIVE"))
        | (has(*authority, fixed.SYSTEM_CODE) & disposition.isNotNull()),
        "HUMAN_REVIEW_MISSING": (F.size(codes) > 0) & ~F.col("human_review_required"),
        "ABSTAINED_WITHOUT_INSUFFICIENCY": (status == "ABSTAINED") & ~has(*of_category(*fixed.ABSTAIN_CATEGORIES)),
        "REFUSED_WITHOUT_AUTHORITY": (status == "REFUSED") & ~has(*authority),
        "ERROR_WITHOUT_SYSTEM": (status == "ERROR") & ~has(fixed.SYSTEM_CODE),
    }
    by_check: dict[tuple[str, tuple[str, ...]], list[str]] = {}
    for code, category in fixed.REASON_CODES:
        check, states = fixed.CATEGORY_CHECKS.get(category, (None, ()))
        check = fixed.CODE_CHECKS.get(code, check)
        if check:
            by_check.setdefault((check, states), []).append(code)
    broken = F.lit(False)
    for (check, states), members in by_check.items():
        broken = broken | (has(*members) & ~F.col(f"quality_checks.{check}").isin(*states))
    all_pass = F.lit(True)
    for check in fixed.QUALITY_CHECKS:
        all_pass = all_pass & (F.col(f"quality_checks.{check}") == "PASS")
    rules["CHECK_STATE_NOT_ALLOWED"] = broken | (has(fixed.BAND_CODE) & ~all_pass)
    found = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return assessments.select("run_id", F.explode(found).alias("rule"))
