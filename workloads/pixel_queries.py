"""Pixel family: scan, validity, index, mosaic, composites, coverage, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from attestra import fixed_values as fixed
from attestra.functions import decision, text
from attestra.operators import pixels as px
from attestra.plans import observation
from attestra.session import cut_lineage
from attestra.sources import pixels as pixel_source
from workloads import domain
from workloads.registry import Tables, query


def observed(t: Tables, scl=None) -> DataFrame:
    return px.with_ndvi(px.attach_calibration(domain.pixels(t, scl), domain.calibration(t), ["platform"]))


def aoi_pixels(t: Tables) -> DataFrame:
    inside = px.restrict_to_aoi(observed(t), domain.aoi(t))
    return px.over_aoi(px.composites(px.mosaic(inside)), domain.aoi(t))


def r9(name: str):
    return F.round(F.col(name), 9).alias(name)


@query("pixel_scan", """
SELECT win, acquisition, count(*) AS n_pixels, sum(red_dn) AS red_sum, round(sum(nir_dn), 4) AS nir_sum
FROM pixels WHERE win = 'PRE' AND scl IN (4, 5) GROUP BY ALL""", (domain.PIXELS_SQL,))
def pixel_scan(t: Tables) -> DataFrame:
    path = pixel_source.write_pixels(domain.pixels(t))
    scanned = pixel_source.read_pixels(t.spark, path, windows=["PRE"]).filter(F.col("scl").isin(*fixed.VALID_SCL_CLASSES))
    return scanned.groupBy("win", "acquisition").agg(
        F.count(F.lit(1)).alias("n_pixels"), F.sum("red_dn").alias("red_sum"), F.round(F.sum("nir_dn"), 4).alias("nir_sum")
    )


@query("pixel_valid", """
SELECT win, tile, count(*) AS n, CAST(sum(CASE WHEN valid THEN 1 ELSE 0 END) AS BIGINT) AS n_valid
FROM observed GROUP BY ALL""", domain.PIXEL_CTES)
def pixel_valid(t: Tables) -> DataFrame:
    return observed(t).groupBy("win", "tile").agg(F.count(F.lit(1)).alias("n"), F.count_if("valid").alias("n_valid"))


@query("pixel_ndvi", """
SELECT win, acquisition, pixel_id, component_order, round(red, 9) AS red, round(nir, 9) AS nir, round(ndvi, 9) AS ndvi
FROM observed WHERE valid""", domain.PIXEL_CTES)
def pixel_ndvi(t: Tables) -> DataFrame:
    return observed(t).filter("valid").select(
        "win", "acquisition", "pixel_id", "component_order",
        F.round(px.reflectance("red"), 9).alias("red"), F.round(px.reflectance("nir"), 9).alias("nir"), r9("ndvi"),
    )


@query("aoi_semi", """
SELECT win, count(*) AS n_rows, count(DISTINCT pixel_id) AS n_pixels FROM pixels
WHERE pixel_id IN (SELECT pixel_id FROM aoi) GROUP BY win""", domain.PIXEL_CTES)
def aoi_semi(t: Tables) -> DataFrame:
    return px.restrict_to_aoi(domain.pixels(t), domain.aoi(t)).groupBy("win").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("pixel_id").alias("n_pixels")
    )


@query("mosaic", """
SELECT win, acquisition, pixel_id, round(ndvi, 9) AS ndvi, component_count FROM mosaic""",
       domain.PIXEL_CTES + (domain.MOSAIC_SQL,))
def mosaic(t: Tables) -> DataFrame:
    return px.mosaic(px.restrict_to_aoi(observed(t), domain.aoi(t))).select(
        "win", "acquisition", "pixel_id", r9("ndvi"), "component_count"
    )


@query("mosaic_conflicts", """
SELECT win, acquisition, pixel_id, round(greatest(high - ndvi, ndvi - low), 9) AS departure FROM mosaic
WHERE greatest(high - ndvi, ndvi - low) > 1e-12""", domain.PIXEL_CTES + (domain.MOSAIC_SQL,))
def mosaic_conflicts(t: Tables) -> DataFrame:
    found = px.mosaic_conflicts(px.mosaic(px.restrict_to_aoi(observed(t), domain.aoi(t))))
    return found.select("win", "acquisition", "pixel_id", r9("departure"))


@query("pixel_counts", """
SELECT pixel_id, pre_count, post_count FROM aoi_pixels""", domain.COMPOSITE_CTES)
def pixel_counts(t: Tables) -> DataFrame:
    return aoi_pixels(t).select("pixel_id", "pre_count", "post_count")


@query("pixel_composite", """
SELECT pixel_id, round(pre_ndvi, 9) AS pre_ndvi, round(post_ndvi, 9) AS post_ndvi FROM composite""",
       domain.COMPOSITE_CTES)
def pixel_composite(t: Tables) -> DataFrame:
    inside = px.restrict_to_aoi(observed(t), domain.aoi(t))
    return px.composites(px.mosaic(inside)).select("pixel_id", r9("pre_ndvi"), r9("post_ndvi"))


@query("joint_pixels", """
SELECT pixel_id, round(delta, 9) AS delta FROM aoi_pixels WHERE joint""", domain.COMPOSITE_CTES)
def joint_pixels(t: Tables) -> DataFrame:
    return aoi_pixels(t).filter("joint").select("pixel_id", r9("delta"))


@query("window_medians", """
SELECT case_id, round(pre_m, 9) AS pre_window_ndvi_median, round(post_m, 9) AS post_window_ndvi_median,
       round(delta_ndvi, 9) AS delta_ndvi FROM medians""", domain.CASE_CTES)
def window_medians(t: Tables) -> DataFrame:
    return px.window_medians(cut_lineage(aoi_pixels(t))).select(
        "case_id", r9("pre_window_ndvi_median"), r9("post_window_ndvi_median"), r9("delta_ndvi")
    )


COVERAGE_COLUMNS = ("case_id", "aoi_total_pixels", "pre_acquisitions", "post_acquisitions", "pre_eligible_pixels",
                    "post_eligible_pixels", "aoi_valid_pixels")


@query("coverage", """
SELECT case_id, aoi_total_pixels, pre_acquisitions, post_acquisitions, pre_eligible_pixels, post_eligible_pixels,
       aoi_valid_pixels, round(aoi_valid_pixels / aoi_total_pixels, 9) AS aoi_valid_fraction,
       enough AND aoi_valid_pixels / aoi_total_pixels >= 8e-1 AS coverage_passed FROM coverage""", domain.CASE_CTES)
def coverage(t: Tables) -> DataFrame:
    return px.joint_coverage(aoi_pixels(t), px.acquisition_counts(observed(t))).select(
        *COVERAGE_COLUMNS, r9("aoi_valid_fraction"), "coverage_passed"
    )


@query("delta_distribution", """
, spread AS (SELECT case_id, median(abs(delta - m.delta_median)) AS mad FROM aoi_pixels p JOIN medians m USING (case_id) WHERE joint GROUP BY case_id)
SELECT case_id, count(*) AS n, round(quantile_cont(delta, 0.05), 9) AS q05, round(quantile_cont(delta, 0.25), 9) AS q25,
       round(median(delta), 9) AS median, round(quantile_cont(delta, 0.75), 9) AS q75,
       round(quantile_cont(delta, 0.95), 9) AS q95,
       round(quantile_cont(delta, 0.75) - quantile_cont(delta, 0.25), 9) AS iqr, round((SELECT mad FROM spread s WHERE s.case_id = aoi_pixels.case_id), 9) AS mad
FROM aoi_pixels WHERE joint GROUP BY case_id""", domain.CASE_CTES)
def delta_distribution(t: Tables) -> DataFrame:
    spread = px.measure_distributions(cut_lineage(aoi_pixels(t))).filter(F.col("measure") == "DELTA")
    return spread.select("case_id", "n", *[r9(c) for c in (*fixed.QUANTILE_NAMES, "iqr", "mad")])


@query("count_distribution", """
, long AS (SELECT case_id, 'PRE' AS win, pre_count AS v FROM aoi_pixels UNION ALL
           SELECT case_id, 'POST', post_count FROM aoi_pixels),
mid AS (SELECT case_id, win, median(v) AS m FROM long GROUP BY ALL)
SELECT case_id, win, count(*) AS n, round(quantile_cont(v, 0.05), 9) AS q05, round(quantile_cont(v, 0.25), 9) AS q25,
       round(median(v), 9) AS median, round(quantile_cont(v, 0.75), 9) AS q75, round(quantile_cont(v, 0.95), 9) AS q95,
       round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 9) AS iqr, round(median(abs(v - m)), 9) AS mad
FROM long JOIN mid USING (case_id, win) GROUP BY case_id, win""", domain.COMPOSITE_CTES)
def count_distribution(t: Tables) -> DataFrame:
    spread = px.valid_count_distribution(aoi_pixels(t))
    return spread.select("case_id", "win", "n", *[r9(c) for c in (*fixed.QUANTILE_NAMES, "iqr", "mad")])


@query("class_histogram", """
SELECT win, acquisition, tile, scl, count(*) AS pixel_count FROM pixels WHERE source_valid GROUP BY ALL""",
       (domain.PIXELS_SQL,))
def class_histogram(t: Tables) -> DataFrame:
    return px.class_histogram(domain.pixels(t), ["win", "acquisition", "tile"])


@query("scene_diagnostics", """
SELECT win, acquisition, tile, CAST(sum(CASE WHEN source_valid THEN 1 ELSE 0 END) AS BIGINT) AS covered_pixels,
       count(ndvi) AS valid_pixels,
       round(coalesce(count(ndvi) / nullif(sum(CASE WHEN source_valid THEN 1 ELSE 0 END), 0), 0), 9) AS valid_fraction
FROM observed GROUP BY ALL""", domain.PIXEL_CTES)
def scene_diagnostics(t: Tables) -> DataFrame:
    return px.scene_diagnostics(observed(t), ["win", "acquisition", "tile"]).select(
        "win", "acquisition", "tile", "covered_pixels", "valid_pixels", r9("valid_fraction")
    )


@query("coverage_gap", """
SELECT win, acquisition, pixel_id FROM pixels GROUP BY ALL HAVING max(CASE WHEN tile <= 4 THEN 1 ELSE 0 END) = 0""",
       (domain.PIXELS_SQL,))
def coverage_gap(t: Tables) -> DataFrame:
    return px.coverage_gap(domain.pixels(t), F.col("tile") <= 4).select("win", "acquisition", "pixel_id")


@query("footprint_union", "SELECT DISTINCT case_id, win, acquisition, pixel_id FROM pixels", (domain.PIXELS_SQL,))
def footprint_union(t: Tables) -> DataFrame:
    return px.footprint_union(domain.pixels(t))


@query("pixel_window_aggregation", """
SELECT c.case_id, aoi_total_pixels, aoi_valid_pixels, round(aoi_valid_pixels / aoi_total_pixels, 9) AS aoi_valid_fraction,
       round(pre_m, 9) AS pre_window_ndvi_median, round(post_m, 9) AS post_window_ndvi_median,
       round(delta_ndvi, 9) AS delta_ndvi, round(delta_median, 9) AS delta_median,
       enough AND aoi_valid_pixels / aoi_total_pixels >= 8e-1 AS coverage_passed
FROM coverage c JOIN medians m USING (case_id)""", domain.CASE_CTES)
def pixel_window_aggregation(t: Tables) -> DataFrame:
    return observation.aggregate_cases(observed(t), domain.aoi(t)).select(
        "case_id", "aoi_total_pixels", "aoi_valid_pixels", r9("aoi_valid_fraction"), r9("pre_window_ndvi_median"),
        r9("post_window_ndvi_median"), r9("delta_ndvi"), r9("delta_median"), "coverage_passed",
    )


CLASSIFY_SQL = """
CASE WHEN d > tau THEN 'CORROBORATING' WHEN d < -tau THEN 'CONTRADICTORY' ELSE 'INCONCLUSIVE' END"""


@query("classify_delta", f"""
, rows AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount - l_tax AS delta,
                  CAST(CAST(l_discount - l_tax AS VARCHAR) AS DECIMAL(38,20)) AS d, CAST('0.03' AS DECIMAL(38,20)) AS tau FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(delta, 9) AS delta, {CLASSIFY_SQL} AS disposition,
       CASE WHEN abs(d) > tau THEN 'COMPLETED' ELSE 'ABSTAINED' END AS status,
       CASE WHEN abs(d) > tau THEN '' ELSE 'EFFECT_WITHIN_OPERATIONAL_INDIFFERENCE_BAND' END AS reasons
FROM rows""", ("one AS (SELECT 1)",))
def classify_delta(t: Tables) -> DataFrame:
    delta = F.col("l_discount") - F.col("l_tax")
    verdict = decision.classify(delta, F.lit(float(fixed.PRIMARY_TAU)))
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(delta, 9).alias("delta"),
        verdict["evidence_disposition"].alias("disposition"), verdict["execution_status"].alias("status"),
        F.array_join(verdict["reason_codes"], ",").alias("reasons"),
    )


@query("sensitivities", f"""
, taus AS (SELECT * FROM (VALUES (TRUE, CAST('0.03' AS DECIMAL(38,20))), (FALSE, CAST('0.01' AS DECIMAL(38,20))),
                                 (FALSE, CAST('0.02' AS DECIMAL(38,20))), (FALSE, CAST('0.05' AS DECIMAL(38,20)))) v(is_primary, tau)),
rows AS (SELECT l_suppkey, CAST(CAST(l_discount - l_tax AS VARCHAR) AS DECIMAL(38,20)) AS d FROM lineitem)
SELECT l_suppkey, is_primary, CAST(tau AS DOUBLE) AS tau, {CLASSIFY_SQL} AS disposition, count(*) AS n
FROM rows, taus GROUP BY ALL""", ("one AS (SELECT 1)",))
def sensitivities(t: Tables) -> DataFrame:
    delta = F.col("l_discount") - F.col("l_tax")
    exploded = t.lineitem.select("l_suppkey", F.explode(decision.classifications(delta)).alias("c"))
    return exploded.groupBy(
        "l_suppkey", "c.is_primary", "c.tau", F.col("c.verdict.evidence_disposition").alias("disposition")
    ).agg(F.count(F.lit(1)).alias("n"))




def _scope() -> dict:
    values = {
        "analysis_boundary_role": "CEA",
        "aggregation": "AOI-level median per-pixel temporal median",
        "post_window": "1998-07-01/2001-12-31", "pre_window": "1995-01-01/1998-06-30",
        "eligible_population": "pixels with at least three valid observations in both windows",
        "indifference_policy_id": "BAND-0.03", "seasonal_rule_id": "SEASON-1", "qualification_policy_version": "0.5.0",
    }
    return {"project_id": F.col("case_id"), **{name: F.lit(value) for name, value in values.items()}}


ASSESS_SQL = """
, decided AS (
  SELECT c.case_id, aoi_total_pixels, aoi_valid_pixels, aoi_valid_pixels / aoi_total_pixels AS frac, pre_m, post_m, delta_ndvi,
         enough AND aoi_valid_pixels / aoi_total_pixels >= 8e-1 AS passed
  FROM coverage c JOIN medians m USING (case_id)),
verdicts AS (
  SELECT *, CASE WHEN NOT passed THEN 'INCONCLUSIVE' WHEN delta_ndvi > 3e-2 THEN 'CORROBORATING'
                 WHEN delta_ndvi < -3e-2 THEN 'CONTRADICTORY' ELSE 'INCONCLUSIVE' END AS disposition,
            CASE WHEN NOT passed THEN 'VALID_OBSERVATION_COVERAGE_LOW'
                 WHEN abs(delta_ndvi) <= 3e-2 THEN 'EFFECT_WITHIN_OPERATIONAL_INDIFFERENCE_BAND' ELSE '' END AS reasons
  FROM decided)
"""
ASSESS_SELECT = """
SELECT case_id, CASE WHEN disposition = 'INCONCLUSIVE' THEN 'ABSTAINED' ELSE 'COMPLETED' END AS execution_status,
       disposition AS evidence_disposition, reasons,
       CASE WHEN passed THEN 'PASS' ELSE 'FAIL' END AS check_coverage, 'PASS' AS check_system,
       CASE WHEN passed THEN 'COMPLETE' ELSE 'PARTIAL' END AS observation_status,
       aoi_total_pixels, aoi_valid_pixels, round(frac, 9) AS aoi_valid_fraction,
       round(pre_m, 9) AS pre_window_ndvi_median, round(post_m, 9) AS post_window_ndvi_median,
       round(delta_ndvi, 9) AS delta_ndvi, disposition = 'INCONCLUSIVE' AS human_review_required,
       CASE WHEN disposition <> 'INCONCLUSIVE' THEN concat('OBSERVATIONAL_COMPARISON_', disposition, '_V2') END AS statement_template_id
FROM verdicts"""


def _assessment(t: Tables, scl=None) -> DataFrame:
    aggregated = observation.aggregate_cases(observed(t, scl), domain.aoi(t))
    return observation.assess(observation.qualify(aggregated), _scope())


def _assessment_columns(assessed: DataFrame) -> DataFrame:
    return assessed.select(
        "case_id", "execution_status", "evidence_disposition", F.array_join("reason_codes", ",").alias("reasons"),
        F.col("quality_checks.observation_coverage").alias("check_coverage"),
        F.col("quality_checks.system_execution").alias("check_system"), "observation_status",
        "aoi_total_pixels", "aoi_valid_pixels", r9("aoi_valid_fraction"), r9("pre_window_ndvi_median"),
        r9("post_window_ndvi_median"), r9("delta_ndvi"), "human_review_required", "statement_template_id",
    )


@query("observation_assessment", ASSESS_SQL + ASSESS_SELECT, domain.CASE_CTES)
def observation_assessment(t: Tables) -> DataFrame:
    return _assessment_columns(_assessment(t))


@query("observation_assessment_low_coverage", ASSESS_SQL + ASSESS_SELECT,
       (domain.PIXELS_SQL.replace("3 + l_linenumber % 3 AS scl", "l_linenumber AS scl"),) + domain.CASE_CTES[1:])
def observation_assessment_low_coverage(t: Tables) -> DataFrame:
    return _assessment_columns(_assessment(t, F.col("l_linenumber")))


@query("render_statement", """
SELECT o_orderkey, 'Within the frozen CEA for P' || o_custkey || ', the summary (' || CAST(o_totalprice AS VARCHAR) ||
       ') under ' || o_orderpriority || '.' AS statement, o_orderkey % 5 <> 0 AS matches_stored FROM orders""")
def render_statement(t: Tables) -> DataFrame:
    template = F.lit("Within the frozen {role} for {project_id}, the summary ({value}) under {policy}.")
    filled = text.fill_template(template, {
        "role": F.lit("CEA"), "project_id": F.concat(F.lit("P"), "o_custkey"),
        "value": F.col("o_totalprice"), "policy": F.col("o_orderpriority"),
    })
    # what an earlier run wrote, one in five altered since
    stored = F.concat(F.lit("Within the frozen CEA for P"), "o_custkey", F.lit(", the summary ("), "o_totalprice",
                      F.lit(") under "), "o_orderpriority", F.when(F.col("o_orderkey") % 5 == 0, "!").otherwise("."))
    return t.orders.select(
        "o_orderkey", filled.alias("statement"), (filled == stored).alias("matches_stored")
    )


@query("observation_invariants", """
, cases AS (
  SELECT o_orderkey, o_totalprice AS total, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice * 2 ELSE o_totalprice / 2 END AS valid,
         CASE WHEN o_orderkey % 7 = 0 THEN 2e0 WHEN o_orderkey % 37 = 0 THEN 6e-1 ELSE 5e-1 END AS frac, o_orderkey % 2 = 0 AS complete,
         o_orderkey % 13 AS pre10, o_orderkey % 25 - 12 AS post10, o_orderkey % 5 = 0 AS off FROM orders),
judged AS (SELECT *, 10 * (post10 - pre10) + CASE WHEN off THEN 1 ELSE 0 END AS d100 FROM cases),
told AS (SELECT *, CASE WHEN d100 > 3 THEN 'CORROBORATING' WHEN d100 < -3 THEN 'CONTRADICTORY' ELSE 'INCONCLUSIVE' END AS verdict FROM judged)
SELECT o_orderkey, 'VALID_EXCEEDS_TOTAL' AS rule FROM told WHERE valid > total
UNION ALL SELECT o_orderkey, 'FRACTION_OUT_OF_RANGE' FROM told WHERE frac NOT BETWEEN 0 AND 1
UNION ALL SELECT o_orderkey, 'FRACTION_ARITHMETIC' FROM told WHERE total > 0 AND abs(frac - valid / total) > 1e-12
UNION ALL SELECT o_orderkey, 'MEDIAN_OUT_OF_RANGE' FROM told WHERE pre10 > 10 OR abs(post10) > 10
UNION ALL SELECT o_orderkey, 'DELTA_OUT_OF_RANGE' FROM told WHERE complete AND abs(d100) > 200
UNION ALL SELECT o_orderkey, 'DELTA_NOT_DIFFERENCE' FROM told WHERE complete AND off
UNION ALL SELECT o_orderkey, 'TAU_NOT_FROZEN' FROM told WHERE complete AND o_orderkey % 17 = 0
UNION ALL SELECT o_orderkey, 'COMPLETED_WITHOUT_OBSERVATIONS' FROM told WHERE NOT complete AND o_orderkey % 31 = 0
UNION ALL SELECT o_orderkey, 'STATUS_MISMATCH' FROM told WHERE complete AND o_orderkey % 19 = 0 AND verdict <> 'INCONCLUSIVE'
UNION ALL SELECT o_orderkey, 'DISPOSITION_MISMATCH' FROM told WHERE complete AND o_orderkey % 29 = 0 AND verdict <> 'CORROBORATING'
UNION ALL SELECT o_orderkey, 'REASONS_MISMATCH' FROM told WHERE complete AND o_orderkey % 23 = 0 AND verdict <> 'INCONCLUSIVE'
UNION ALL SELECT o_orderkey, 'POLICY_MISMATCH' FROM told WHERE complete AND o_orderkey % 41 = 0
UNION ALL SELECT o_orderkey, 'SENSITIVITY_MISMATCH' FROM told WHERE complete AND o_orderkey % 43 = 0""", ("one AS (SELECT 1)",))
def observation_invariants(t: Tables) -> DataFrame:
    """Assessments of the orders, sound and broken in every way."""
    key = F.col("o_orderkey")
    divides = lambda n: key % n == 0
    complete = divides(2)
    pre, post = key % 13, key % 25 - 12
    delta = F.when(divides(5), (10 * (post - pre) + 1) / 100).otherwise((post - pre) / 10)
    verdict = decision.classify(delta, F.lit(float(fixed.PRIMARY_TAU)))
    band = F.array(F.lit(fixed.BAND_CODE))
    right = observation.sensitivities(delta)
    made = t.orders.select(
        key.alias("case_id"), F.col("o_totalprice").alias("aoi_total_pixels"),
        F.when(divides(7), F.col("o_totalprice") * 2).otherwise(F.col("o_totalprice") / 2).alias("aoi_valid_pixels"),
        F.when(divides(7), 2.0).when(divides(37), 0.6).otherwise(0.5).alias("aoi_valid_fraction"),
        (pre / 10).alias("pre_window_ndvi_median"), (post / 10).alias("post_window_ndvi_median"), F.when(complete, delta).alias("delta_ndvi"),
        F.when(complete, F.when(divides(17), 0.05).otherwise(float(fixed.PRIMARY_TAU))).alias("primary_tau"),
        F.when(~complete, F.when(divides(31), "COMPLETED").otherwise("ABSTAINED")).when(divides(19), "ABSTAINED").otherwise(verdict["execution_status"]).alias("execution_status"),
        F.when(complete & divides(29), "CORROBORATING").otherwise(verdict["evidence_disposition"]).alias("evidence_disposition"),
        F.when(divides(23), band).otherwise(verdict["reason_codes"]).alias("reason_codes"),
        F.when(divides(41), "OTHER").otherwise("POLICY").alias("policy_id"), F.lit("POLICY").alias("frozen_policy_id"),
        F.when(divides(43), F.slice(right, 1, 1)).otherwise(right).alias("sensitivity_results"),
        F.when(complete, "COMPLETE").otherwise("PARTIAL").alias("observation_status"),
    )
    return observation.invariant_violations(made).select(F.col("case_id").alias("o_orderkey"), "rule")


@query("completed_assessments", """
SELECT o_orderkey, rule FROM (SELECT o_orderkey, unnest([
    CASE WHEN o_orderkey % 5 = 0 THEN 'MANIFEST_REF_MISSING' END, CASE WHEN o_orderkey % 7 = 0 THEN 'MUST_NOT_CLAIM_INCOMPLETE' END,
    CASE WHEN done AND o_orderkey % 11 = 0 THEN 'TEMPLATE_MISMATCH' END, CASE WHEN done AND o_orderkey % 13 = 0 THEN 'SCOPE_MISMATCH' END,
    CASE WHEN done AND (o_orderkey % 17 = 0 OR o_orderkey % 19 = 0) THEN 'STATEMENT_NOT_RENDERED' END,
    CASE WHEN done AND o_orderkey % 19 = 0 THEN 'FORBIDDEN_LANGUAGE' END]) AS rule
  FROM (SELECT o_orderkey, o_orderstatus <> 'O' AS done FROM orders)) WHERE rule IS NOT NULL""", ("one AS (SELECT 1)",))
def completed_assessments(t: Tables) -> DataFrame:
    """Stored assessments of the orders, sound and broken in every way that completion forbids."""
    key, done = F.col("o_orderkey"), F.col("o_orderstatus") != "O"
    forbidden = ["CAUSALITY", "CARBON_QUANTITY", "FINANCIAL_ADVICE"]
    disposition = F.when(key % 2 == 0, "CORROBORATING").otherwise("CONTRADICTORY")
    values = {**{p: F.concat(F.lit(p[:3]), "o_custkey") for p in observation.SCOPE}, "pre_value": F.lit("0.5"), "post_value": F.lit("0.7"),
              "delta_value": F.lit("0.2"), "primary_tau": F.lit("0.03")}
    named = lambda columns: F.create_map(*[x for n, v in columns.items() for x in (F.lit(n), v)])
    scope = {p: values[p] for p in observation.SCOPE}
    other = scope | {"project_id": F.when(key % 13 == 0, "another").otherwise(scope["project_id"])}
    rendered = F.when(key % 2 == 0, text.fill_template(F.lit(fixed.STATEMENT_TEMPLATES["CORROBORATING"]), values)).otherwise(
        text.fill_template(F.lit(fixed.STATEMENT_TEMPLATES["CONTRADICTORY"]), values))
    made = t.orders.select(
        key.alias("case_id"), F.when(done, "COMPLETED").otherwise("ABSTAINED").alias("execution_status"), disposition.alias("evidence_disposition"),
        F.when(key % 5 != 0, F.concat(F.lit("manifests/"), key)).alias("provenance_manifest_ref"),
        F.when(key % 7 == 0, F.array(F.lit("CAUSALITY"))).otherwise(F.array(*[F.lit(c) for c in forbidden])).alias("must_not_claim"),
        F.when(key % 11 == 0, "OLD_V1").otherwise(F.concat(F.lit("OBSERVATIONAL_COMPARISON_"), disposition, F.lit("_V2"))).alias("statement_template_id"),
        named(values).alias("statement_parameters"), named(other).alias("case_scope"),
        F.when(key % 19 == 0, F.concat(rendered, F.lit(" It is persistent."))).when(key % 17 == 0, F.concat(rendered, F.lit(" "))).otherwise(rendered).alias("supported_statement"),
    )
    return observation.completed_violations(made, forbidden).select(F.col("case_id").alias("o_orderkey"), "rule")
