"""How the given tables stand in for the evidence tables, in Spark and in SQL.

Each ``*_SQL`` text is a common table expression that states the same mapping
for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from attestra.sources import registries
from workloads.registry import Tables

SPLIT_DAY = "1998-07-01"
CASES = 4  # areas of interest; a pixel belongs to the case of its key


def case_of(pixel: str):
    return F.concat(F.lit("CASE-"), F.col(pixel) % CASES)

# --- pixels ----------------------------------------------------------------


def pixels(t: Tables, scl=None) -> DataFrame:
    li = t.lineitem
    return li.select(
        case_of("l_partkey").alias("case_id"),
        F.when(F.col("l_shipdate") < F.lit(SPLIT_DAY).cast("timestamp"), "PRE").otherwise("POST").alias("win"),
        (F.col("l_suppkey") % 12).alias("acquisition"),
        F.col("l_returnflag").alias("platform"),
        F.col("l_linenumber").alias("tile"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("item_id"),
        F.col("l_partkey").alias("pixel_id"),
        (F.col("l_linenumber") * F.lit(1000000000000000) + F.col("l_orderkey") * 100 + F.col("l_quantity").cast("long")).alias(
            "component_order"
        ),
        (1500 + 20 * F.col("l_quantity")).alias("red_dn"),
        (3000 + F.col("l_extendedprice") / 50).alias("nir_dn"),
        (F.lit(3) + F.col("l_linenumber") % 3 if scl is None else scl).alias("scl"),
        (F.col("l_linestatus").isNotNull()).alias("source_valid"),
    )


def calibration(t: Tables) -> DataFrame:
    """Fixed policy rows: three platforms by two bands."""
    rows = [(p, b, 1e-4, -0.1, 0.0) for p in ("A", "N", "R") for b in ("B04", "B08")]
    return registries.policy_rows(t.spark, rows, "platform string, band string, scale double, offset double, nodata double")


def aoi(t: Tables) -> DataFrame:
    return t.part.filter(F.col("p_size") <= 40).select(case_of("p_partkey").alias("case_id"), F.col("p_partkey").alias("pixel_id"))


PIXELS_SQL = """
pixels AS (
  SELECT concat('CASE-', l_partkey % 4) AS case_id,
         CASE WHEN l_shipdate < TIMESTAMP '1998-07-01' THEN 'PRE' ELSE 'POST' END AS win,
         l_suppkey % 12 AS acquisition, l_returnflag AS platform, l_linenumber AS tile,
         concat(l_orderkey, '-', l_linenumber) AS item_id, l_partkey AS pixel_id,
         l_linenumber * 1000000000000000 + l_orderkey * 100 + CAST(l_quantity AS BIGINT) AS component_order,
         1500 + 20 * l_quantity AS red_dn, 3000 + l_extendedprice / 50 AS nir_dn,
         3 + l_linenumber % 3 AS scl, TRUE AS source_valid
  FROM lineitem)"""
OBSERVED_SQL = """
reflected AS (
  SELECT *, red_dn * 1e-4 + (-1e-1) AS red, nir_dn * 1e-4 + (-1e-1) AS nir FROM pixels),
observed AS (
  SELECT *, (red_dn <> 0 AND nir_dn <> 0 AND scl IN (4, 5) AND source_valid AND abs(nir + red) > 1e-6) AS valid,
         CASE WHEN red_dn <> 0 AND nir_dn <> 0 AND scl IN (4, 5) AND source_valid AND abs(nir + red) > 1e-6
              THEN greatest(-1e0, least(1e0, (nir - red) / (nir + red))) END AS ndvi
  FROM reflected)"""
AOI_SQL = """
aoi AS (SELECT concat('CASE-', p_partkey % 4) AS case_id, p_partkey AS pixel_id FROM part WHERE p_size <= 40)"""
MOSAIC_SQL = """
mosaic AS (
  SELECT case_id, win, acquisition, pixel_id, arg_min(ndvi, component_order) AS ndvi,
         min(ndvi) AS low, max(ndvi) AS high, count(*) AS component_count
  FROM observed WHERE ndvi IS NOT NULL AND pixel_id IN (SELECT pixel_id FROM aoi)
  GROUP BY ALL)"""
COMPOSITE_SQL = """
composite AS (
  SELECT pixel_id, count(*) FILTER (win = 'PRE') AS pre_count, count(*) FILTER (win = 'POST') AS post_count,
         CASE WHEN count(*) FILTER (win = 'PRE') >= 3 THEN median(ndvi) FILTER (win = 'PRE') END AS pre_ndvi,
         CASE WHEN count(*) FILTER (win = 'POST') >= 3 THEN median(ndvi) FILTER (win = 'POST') END AS post_ndvi
  FROM mosaic GROUP BY pixel_id),
aoi_pixels AS (
  SELECT a.case_id, a.pixel_id, coalesce(pre_count, 0) AS pre_count, coalesce(post_count, 0) AS post_count,
         pre_ndvi, post_ndvi, (pre_ndvi IS NOT NULL AND post_ndvi IS NOT NULL) AS joint, post_ndvi - pre_ndvi AS delta
  FROM aoi a LEFT JOIN composite c USING (pixel_id))"""
COVERAGE_SQL = """
acquired AS (
  SELECT case_id, count(DISTINCT acquisition) FILTER (win = 'PRE') AS pre_acquisitions,
         count(DISTINCT acquisition) FILTER (win = 'POST') AS post_acquisitions FROM observed GROUP BY case_id),
coverage AS (
  SELECT p.case_id, count(*) AS aoi_total_pixels, min(a.pre_acquisitions) AS pre_acquisitions,
         min(a.post_acquisitions) AS post_acquisitions,
         bool_and(a.pre_acquisitions >= 3 AND a.post_acquisitions >= 3) AS enough,
         CAST(sum(CASE WHEN a.pre_acquisitions >= 3 AND a.post_acquisitions >= 3 AND joint THEN 1 ELSE 0 END) AS BIGINT) AS aoi_valid_pixels,
         CAST(sum(CASE WHEN a.pre_acquisitions >= 3 AND a.post_acquisitions >= 3 AND pre_ndvi IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS pre_eligible_pixels,
         CAST(sum(CASE WHEN a.pre_acquisitions >= 3 AND a.post_acquisitions >= 3 AND post_ndvi IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS post_eligible_pixels
  FROM aoi_pixels p JOIN acquired a USING (case_id) GROUP BY p.case_id)"""
MEDIANS_SQL = """
medians AS (
  SELECT case_id, median(pre_ndvi) AS pre_m, median(post_ndvi) AS post_m,
         CAST(CAST(CAST(median(post_ndvi) AS VARCHAR) AS DECIMAL(38,20)) - CAST(CAST(median(pre_ndvi) AS VARCHAR) AS DECIMAL(38,20)) AS DOUBLE) AS delta_ndvi,
         median(delta) AS delta_median
  FROM aoi_pixels WHERE joint GROUP BY case_id)"""
PIXEL_CTES = (PIXELS_SQL, OBSERVED_SQL, AOI_SQL)
COMPOSITE_CTES = PIXEL_CTES + (MOSAIC_SQL, COMPOSITE_SQL)
CASE_CTES = COMPOSITE_CTES + (COVERAGE_SQL, MEDIANS_SQL)

# --- scene items -------------------------------------------------------------


def scenes(t: Tables) -> DataFrame:
    q, p = F.col("l_quantity").cast("int"), F.col("l_partkey")
    part = p.cast("string")
    band = lambda offset: F.struct(
        F.lit(1e-4).alias("scale"), F.lit(offset).alias("offset"),
        F.when(p % 19 == 0, 0.0).otherwise(10000.0).alias("quantification_value"), F.lit(0.0).alias("nodata"),
        F.lit("PRODUCT_XML").alias("metadata_source"), F.when(p % 23 == 0, "FAIL").otherwise("PASS").alias("cross_check"),
    )
    raw_zenith = F.when(
        (F.col("l_linenumber") != 7) & ~((F.col("l_linenumber") == 6) & (q % 10 == 0)), F.col("l_quantity") * 2
    )
    return t.lineitem.select(
        F.when(F.col("l_shipdate") < F.lit(SPLIT_DAY).cast("timestamp"), "PRE").otherwise("POST").alias("win"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                    F.round(F.col("l_extendedprice") * 100).cast("long")).alias("id"),
        F.lit("sentinel-2-l2a").alias("collection"),
        F.col("l_returnflag").alias("platform"), F.col("l_suppkey").alias("datatake_id"),
        F.col("l_shipdate").alias("datetime"), F.col("l_linenumber").alias("mgrs_tile"),
        F.concat(F.lit("0"), q % 6, F.lit("."), q).alias("processing_baseline"),
        F.when(q % 5 != 0, F.col("l_shipdate")).alias("processing_datetime"),
        raw_zenith.alias("mean_solar_zenith_angle"),
        F.create_map(
            F.lit("B04"), part, F.lit("B08"), part, F.lit("SCL"), part, F.lit("product-metadata"), part,
            F.lit("granule-metadata"), F.when(p % 17 == 0, F.lit(" ")).otherwise(part),
        ).alias("assets"),
        F.when(p % 29 == 0, F.create_map(F.lit("B04"), band(-0.1)))
        .otherwise(F.create_map(F.lit("B04"), band(-0.1), F.lit("B08"), band(-0.1))).alias("radiometry"),
        F.when(F.col("l_linenumber") == 7, F.lit(None).cast("string"))
        .when((F.col("l_linenumber") == 6) & (q % 10 == 0), F.lit("n/a"))
        .otherwise((F.col("l_quantity") * 2).cast("string")).alias("zenith_token"),
        F.when(F.col("l_tax") == 0.08, "").otherwise("STAC").alias("zenith_source"),
        F.when(F.col("l_discount") == 0.1, "FAIL").otherwise("PASS").alias("zenith_check"),
        p.alias("asset_key"),
    )


SCENES_SQL = """
scenes AS (
  SELECT CASE WHEN l_shipdate < TIMESTAMP '1998-07-01' THEN 'PRE' ELSE 'POST' END AS win,
         concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS id,
         l_returnflag AS platform, l_suppkey AS datatake_id, l_shipdate AS datetime, l_linenumber AS mgrs_tile,
         CAST(l_quantity AS INT) AS q, concat('0', CAST(l_quantity AS INT) % 6, '.', CAST(l_quantity AS INT)) AS processing_baseline,
         CASE WHEN CAST(l_quantity AS INT) % 5 <> 0 THEN l_shipdate END AS processing_datetime,
         CASE WHEN l_linenumber = 7 OR (l_linenumber = 6 AND CAST(l_quantity AS INT) % 10 = 0) THEN NULL ELSE l_quantity * 2 END AS zenith,
         CASE WHEN l_linenumber = 7 THEN 'MISSING' WHEN l_linenumber = 6 AND CAST(l_quantity AS INT) % 10 = 0 THEN 'UNPARSEABLE'
              WHEN l_tax = 8e-2 OR l_discount = 1e-1 THEN 'FAIL' ELSE 'PASS' END AS zenith_status,
         l_tax, l_discount, l_partkey AS asset_key,
         l_partkey % 17 = 0 AS asset_bad, (l_partkey % 19 = 0 OR l_partkey % 23 = 0 OR l_partkey % 29 = 0) AS radiometry_bad
  FROM lineitem),
reasoned AS (
  SELECT *, concat_ws(',', CASE WHEN asset_bad THEN 'RADIOMETRY_METADATA_UNRESOLVED' END,
                     CASE WHEN zenith IS NULL THEN 'SOLAR_GEOMETRY_METADATA_UNRESOLVED' WHEN zenith > 70 THEN 'SOLAR_GEOMETRY_OUT_OF_RANGE' END,
                     CASE WHEN radiometry_bad AND NOT asset_bad THEN 'RADIOMETRY_METADATA_UNRESOLVED' END) AS reasons
  FROM scenes)"""
SOLAR_SQL = """
solar AS (
  SELECT *, CASE WHEN zenith_status <> 'PASS' THEN 'SOLAR_GEOMETRY_METADATA_UNRESOLVED'
                 WHEN zenith > 70 THEN 'SOLAR_GEOMETRY_OUT_OF_RANGE' END AS exclusion_reason FROM scenes)"""
CANONICAL_SQL = """
ordered AS (
  SELECT *, row_number() OVER w AS rn, rank() OVER v AS rk, count(*) OVER c AS candidate_count FROM reasoned
  WINDOW w AS (PARTITION BY win, platform, datatake_id, mgrs_tile ORDER BY q % 6 DESC, q DESC, processing_datetime DESC NULLS LAST, id),
         v AS (PARTITION BY win, platform, datatake_id, mgrs_tile ORDER BY q % 6 DESC, q DESC, processing_datetime DESC NULLS LAST),
         c AS (PARTITION BY win, platform, datatake_id, mgrs_tile)),
finalists AS (
  SELECT win, platform, datatake_id, mgrs_tile, count(*) AS finalist_count, count(DISTINCT asset_key) > 1 AS ambiguous,
         min(candidate_count) AS candidate_count FROM ordered WHERE rk = 1 GROUP BY ALL),
canonical AS (
  SELECT o.win, o.platform, o.datatake_id, o.mgrs_tile, o.id AS selected_item_id, o.datetime, o.reasons, f.finalist_count, f.ambiguous, f.candidate_count
  FROM ordered o JOIN finalists f USING (win, platform, datatake_id, mgrs_tile) WHERE o.rn = 1)"""
GROUPS_SQL = """
firsts AS (
  SELECT win, platform, datatake_id, r AS reason, min(mgrs_tile * 100 + pos) AS place
  FROM (SELECT win, platform, datatake_id, mgrs_tile, unnest(string_split(reasons, ',')) AS r,
               generate_subscripts(string_split(reasons, ','), 1) AS pos FROM canonical WHERE reasons <> '') GROUP BY ALL),
merged AS (SELECT win, platform, datatake_id, string_agg(reason, ',' ORDER BY place) AS reasons FROM firsts GROUP BY ALL),
acq AS (
  SELECT c.win, c.platform, c.datatake_id, string_agg(selected_item_id, ',' ORDER BY mgrs_tile) AS item_ids,
         string_agg(CAST(mgrs_tile AS VARCHAR), ',' ORDER BY mgrs_tile) AS tiles, count(*) AS components,
         arg_min(c.datetime, c.mgrs_tile) AS sensing_datetime, coalesce(min(m.reasons), '') AS reasons
  FROM canonical c LEFT JOIN merged m USING (win, platform, datatake_id) GROUP BY ALL)"""
SCENE_CTES = (SCENES_SQL,)
CANONICAL_CTES = (SCENES_SQL, CANONICAL_SQL)
GROUP_CTES = CANONICAL_CTES + (GROUPS_SQL,)

# --- requests and facts ---------------------------------------------------------

BINDINGS = {"INTEGRITY": {"commit": "c0"}, "OBSERVATION": {"run": "r0"}}


def _subject_type(key: str):
    k = F.col(key) % 4
    return F.when(k <= 1, "ACCU_PROJECT").when(k == 2, "SAFEGUARD_FACILITY").otherwise("UNIT_CONCEPTS")


# attributes that statements are filled from: name, first letter, column
ATTRIBUTES = [
    ("project_id", "P", "l_orderkey"), ("project_name", "N", "l_partkey"), ("method_type", "M", "l_suppkey"), ("reporting_period", "R", "l_suppkey"),
    ("facility_name", "F", "l_partkey"), ("baseline_emissions", "B", "l_suppkey"), ("covered_emissions", "C", "l_partkey"), ("smcs_issued", "S", "l_suppkey"),
    ("pre_median_ndvi", "a", "l_partkey"), ("post_median_ndvi", "b", "l_partkey"), ("primary_tau", "t", "l_suppkey"),
]


def facts(t: Tables, lines: DataFrame | None = None, *kept: str) -> DataFrame:
    """The facts of all lines, or of ``lines`` with the columns ``kept`` of them."""
    subject = _subject_type("l_orderkey")
    line = F.col("l_linenumber")
    families = ["REGISTRY_FACTS", "SAFEGUARD_FACILITY_FACTS", "OBSERVATIONAL_CONSISTENCY"]
    array = lambda names: F.array(*[F.lit(n) for n in names])
    own_scope = F.when(F.col("l_orderkey") % 4 <= 1, "PUBLIC_REGISTRY_FACTS").when(
        F.col("l_orderkey") % 4 == 2, "PUBLIC_SAFEGUARD_FACTS"
    ).otherwise("PUBLIC_UNIT_DEFINITION")
    return (t.lineitem if lines is None else lines).select(
        *kept,
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                    F.round(F.col("l_extendedprice") * 100).cast("long")).alias("fact_id"),
        F.col("l_orderkey").cast("string").alias("evidence_id"),
        subject.alias("subject_type"), F.col("l_orderkey").cast("string").alias("subject_id"),
        F.when(line % 2 == 0, array([*families, "ACCU_SMC_SEMANTIC_BOUNDARY", "POLICY_APPLICABILITY"])).otherwise(array(families)).alias(
            "claim_families"
        ),
        F.array(
            F.when(F.col("l_returnflag") == "A", "registry").when(F.col("l_returnflag") == "N", "safeguard").otherwise("applicable_policy"),
            F.when(F.col("l_linestatus") == "F", "project_identity").otherwise("facility_identity"),
            F.when(line <= 3, "frozen_observation").when(line <= 5, "smc_issuance").otherwise("accu_definition"),
        ).alias("tags"),
        F.when(F.col("l_tax") == 0.08, "PUBLIC_UNIT_DEFINITION").otherwise(own_scope).alias("authority_scope"),
        F.col("l_shipdate").cast("date").alias("accessed_on"),
        F.when(F.col("l_discount") >= 0.05, "method").alias("assertion_key"),
        F.concat(F.lit('"'), "l_returnflag", F.lit('"')).alias("assertion_value"),
        F.when(line == 1, "INTEGRITY").when(line == 2, "OBSERVATION").alias("role"),
        F.create_map(
            F.lit("commit"), F.concat(F.lit("c"), F.col("l_suppkey") % 2), F.lit("run"), F.concat(F.lit("r"), F.col("l_partkey") % 2),
            F.lit("reason_code"), F.when(F.col("l_partkey") % 3 == 0, "VALID_OBSERVATION_COVERAGE_LOW").otherwise("EFFECT_WITHIN_OPERATIONAL_INDIFFERENCE_BAND"),
            *[x for name, letter, key in ATTRIBUTES for x in (F.lit(name), F.concat(F.lit(letter), key))],
            F.lit("project_location"), F.when(line % 3 != 0, F.concat(F.lit("L"), line)),
            F.lit("delta_ndvi"), F.when(line == 2, F.concat(F.lit("d"), "l_suppkey")),
        ).alias("attributes"),
        F.concat_ws(" ", F.lit("part"), "l_partkey", F.lit("status"), "l_linestatus").alias("text"),
    )


def request_pairs(t: Tables, asked: DataFrame) -> DataFrame:
    """Each asked request with the facts of its subject and family; lines meet the requests and become facts, which are far wider, only then."""
    lines = t.lineitem.select("*", _subject_type("l_orderkey").alias("subject_type"), F.col("l_orderkey").cast("string").alias("subject_id"))
    kept = [c for c in asked.columns if c not in ("subject_type", "subject_id")]
    return facts(t, lines.join(asked, ["subject_type", "subject_id"]), *kept).filter(F.array_contains("claim_families", F.col("claim_family")))


def requests(t: Tables) -> DataFrame:
    level = F.substring("o_orderpriority", 1, 1)
    family = (
        F.when(level == "1", "REGISTRY_FACTS").when(level == "2", "SAFEGUARD_FACILITY_FACTS")
        .when(level == "3", "OBSERVATIONAL_CONSISTENCY")
        .when(level == "4", F.when(F.col("o_orderstatus") == "F", "CARBON_QUANTITY").otherwise("FINANCIAL_ACTION"))
        .otherwise("POLICY_APPLICABILITY")
    )
    return t.orders.select(
        F.col("o_orderkey").alias("request_id"), _subject_type("o_orderkey").alias("subject_type"),
        F.col("o_orderkey").cast("string").alias("subject_id"), family.alias("claim_family"),
        F.concat_ws(" ", F.lit("Restate the status of part"), "o_custkey").alias("question"),
        F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate").cast("date")).alias("minimum_source_date"),
    )


FACTS_SQL = """
facts AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS fact_id,
         CAST(l_orderkey AS VARCHAR) AS subject_id,
         CASE WHEN l_orderkey % 4 <= 1 THEN 'ACCU_PROJECT' WHEN l_orderkey % 4 = 2 THEN 'SAFEGUARD_FACILITY' ELSE 'UNIT_CONCEPTS' END AS subject_type,
         CASE WHEN l_linenumber % 2 = 0 THEN ['REGISTRY_FACTS', 'SAFEGUARD_FACILITY_FACTS', 'OBSERVATIONAL_CONSISTENCY', 'ACCU_SMC_SEMANTIC_BOUNDARY', 'POLICY_APPLICABILITY']
              ELSE ['REGISTRY_FACTS', 'SAFEGUARD_FACILITY_FACTS', 'OBSERVATIONAL_CONSISTENCY'] END AS claim_families,
         [CASE l_returnflag WHEN 'A' THEN 'registry' WHEN 'N' THEN 'safeguard' ELSE 'applicable_policy' END,
          CASE l_linestatus WHEN 'F' THEN 'project_identity' ELSE 'facility_identity' END,
          CASE WHEN l_linenumber <= 3 THEN 'frozen_observation' WHEN l_linenumber <= 5 THEN 'smc_issuance' ELSE 'accu_definition' END] AS tags,
         CASE WHEN l_tax = 8e-2 OR l_orderkey % 4 = 3 THEN 'PUBLIC_UNIT_DEFINITION' WHEN l_orderkey % 4 = 2 THEN 'PUBLIC_SAFEGUARD_FACTS'
              ELSE 'PUBLIC_REGISTRY_FACTS' END AS authority_scope,
         CAST(l_shipdate AS DATE) AS accessed_on, CASE WHEN l_discount >= 5e-2 THEN 'method' END AS assertion_key, l_returnflag AS assertion_value,
         CASE l_linenumber WHEN 1 THEN 'INTEGRITY' WHEN 2 THEN 'OBSERVATION' END AS role,
         l_partkey AS part, l_suppkey AS supp, l_linenumber AS line,
         concat('c', l_suppkey % 2) AS commit_value, concat('r', l_partkey % 2) AS run_value,
         CASE WHEN l_partkey % 3 = 0 THEN 'VALID_OBSERVATION_COVERAGE_LOW' ELSE 'EFFECT_WITHIN_OPERATIONAL_INDIFFERENCE_BAND' END AS reason_code,
         concat_ws(' ', 'part', l_partkey, 'status', l_linestatus) AS text
  FROM lineitem)"""
REQUESTS_SQL = """
requests AS (
  SELECT o_orderkey AS request_id, CAST(o_orderkey AS VARCHAR) AS subject_id,
         CASE WHEN o_orderkey % 4 <= 1 THEN 'ACCU_PROJECT' WHEN o_orderkey % 4 = 2 THEN 'SAFEGUARD_FACILITY' ELSE 'UNIT_CONCEPTS' END AS subject_type,
         CASE left(o_orderpriority, 1) WHEN '1' THEN 'REGISTRY_FACTS' WHEN '2' THEN 'SAFEGUARD_FACILITY_FACTS' WHEN '3' THEN 'OBSERVATIONAL_CONSISTENCY'
              WHEN '4' THEN CASE WHEN o_orderstatus = 'F' THEN 'CARBON_QUANTITY' ELSE 'FINANCIAL_ACTION' END ELSE 'POLICY_APPLICABILITY' END AS claim_family,
         concat_ws(' ', 'Restate the status of part', o_custkey) AS question,
         CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) END AS minimum_source_date
  FROM orders),
rules AS (
  SELECT * FROM (VALUES
    ('REGISTRY_FACTS', NULL, ['ACCU_PROJECT'], ['registry', 'project_identity'], ['PUBLIC_REGISTRY_FACTS']),
    ('SAFEGUARD_FACILITY_FACTS', NULL, ['SAFEGUARD_FACILITY'], ['safeguard', 'facility_identity', 'smc_issuance'], ['PUBLIC_SAFEGUARD_FACTS']),
    ('OBSERVATIONAL_CONSISTENCY', NULL, ['ACCU_PROJECT'], ['frozen_observation', 'registry'], ['PUBLIC_REGISTRY_FACTS', 'BOUNDED_OBSERVATION_ONLY']),
    ('POLICY_APPLICABILITY', NULL, ['ACCU_PROJECT', 'SAFEGUARD_FACILITY'], ['applicable_policy'], ['PUBLIC_REGISTRY_FACTS']),
    ('CARBON_QUANTITY', 'CARBON_QUANTITY_UNSUPPORTED', CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[])),
    ('FINANCIAL_ACTION', 'FINANCIAL_DECISION_UNSUPPORTED', CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]))
  ) v(claim_family, refused_code, subject_types, required_tags, allowed_scopes))"""
QUALIFY_CTES = (FACTS_SQL, REQUESTS_SQL)
