"""Scene family: inventory, metadata XML, gates, representation, groups, limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from attestra.functions import geo
from attestra.operators import scenes as sc
from attestra.plans import scene_selection
from attestra.session import derived_path, materialise
from attestra.sources import assessments, scenes as scene_source
from workloads import domain
from workloads.registry import Tables, query

LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def joined(name: str, alias: str | None = None):
    return F.array_join(name, ",").alias(alias or name)


def _feature_pages(t: Tables) -> str:
    """Item pages written by Spark, one line per order (a fixture of the scan below)."""
    href = lambda kind: F.struct(F.concat(F.lit("https://host/"), F.lit(kind), F.lit("/"), "l_partkey", F.lit("?sig=x")).alias("href"))
    item = F.struct(
        F.concat_ws("-", *LINE).alias("id"), F.lit("sentinel-2-l2a").alias("collection"),
        F.struct(
            F.col("l_returnflag").alias("platform"), F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("datetime"),
            F.col("l_suppkey").cast("string").alias("s2:datatake_id"), F.col("l_linenumber").cast("string").alias("s2:mgrs_tile"),
            F.lit(116).alias("sat:relative_orbit"), F.lit("05.11").alias("s2:processing_baseline"),
            (F.col("l_tax") * 100).alias("eo:cloud_cover"),
            F.when(F.col("l_linenumber") != 7, F.col("l_quantity") * 2).alias("s2:mean_solar_zenith"),
        ).alias("properties"),
        F.create_map(F.lit("B08"), href("nir"), F.lit("B04"), href("red"), F.lit("SCL"), href("scl")).alias("assets"),
    )
    path = derived_path(t.spark, "feature-pages")
    # lines are dealt as they are and become items, which are far wider, only where the pages are written
    dealt = t.lineitem.repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey")
    pages = dealt.groupBy("l_orderkey").agg(F.collect_list(item).alias("features")).select("features")
    # compressed files are not split when read, so each holds a bounded number of pages
    pages.write.option("compression", "gzip").option("maxRecordsPerFile", 50_000).json(path)
    return path


@query("scene_inventory", """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS item_id, l_returnflag AS platform,
       strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ') AS acquisition_datetime, CAST(l_suppkey AS VARCHAR) AS datatake_id,
       CASE WHEN l_linenumber <> 7 THEN l_quantity * 2 END AS zenith,
       CASE WHEN l_linenumber <> 7 THEN 'AVAILABLE_NOT_EVALUATED' ELSE 'MISSING_NOT_EVALUATED' END AS status,
       concat('https://host/red/', l_partkey, '?sig=x') AS b04_identity, CAST(NULL AS VARCHAR) AS granule_metadata_identity,
       'B04,B08,SCL' AS asset_keys FROM lineitem""")
def scene_inventory(t: Tables) -> DataFrame:
    rows = scene_source.inventory_rows(scene_source.read_feature_pages(t.spark, _feature_pages(t)), F.lit("pre"))
    return rows.select(
        "item_id", "platform", "acquisition_datetime", "datatake_id", F.col("mean_solar_zenith_angle").alias("zenith"),
        F.col("solar_geometry_status").alias("status"), "b04_identity", "granule_metadata_identity", joined("asset_keys"),
    )


@query("inventory_csv", """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS item_id, l_returnflag AS platform,
       '["B04","B08","SCL"]' AS asset_keys, '[]' AS exclusion_reasons FROM lineitem""")
def inventory_csv(t: Tables) -> DataFrame:
    rows = scene_source.inventory_rows(scene_source.read_feature_pages(t.spark, _feature_pages(t)), F.lit("pre"))
    path = derived_path(t.spark, "inventory-csv")
    kept = rows.select("item_id", "platform", "asset_keys", "exclusion_reasons")
    scene_source.write_csv(kept, path, compression="gzip", maxRecordsPerFile=1_000_000)
    declared = "item_id string, platform string, asset_keys string, exclusion_reasons string"
    return t.spark.read.schema(declared).option("header", True).option("escape", '"').csv(path)


GRANULE = (
    "<n1:G xmlns:n1='u'><n1:Geo><Mean_Sun_Angle><ZENITH_ANGLE unit='deg'> %s </ZENITH_ANGLE><AZIMUTH_ANGLE>1</AZIMUTH_ANGLE>"
    "</Mean_Sun_Angle>%s</n1:Geo></n1:G>"
)
PRODUCT = (
    "<n1:P xmlns:n1='u'><Q><BOA_QUANTIFICATION_VALUE unit='none'>10000</BOA_QUANTIFICATION_VALUE></Q><L>%s</L>"
    "<Special_Values><SPECIAL_VALUE_TEXT>NODATA</SPECIAL_VALUE_TEXT><SPECIAL_VALUE_INDEX>0</SPECIAL_VALUE_INDEX></Special_Values>"
    "<Special_Values><SPECIAL_VALUE_TEXT>SATURATED</SPECIAL_VALUE_TEXT><SPECIAL_VALUE_INDEX>65535</SPECIAL_VALUE_INDEX></Special_Values>"
    "</n1:P>"
)


def _xml_items(t: Tables) -> DataFrame:
    second = F.when(F.col("l_linenumber") == 6, "<Mean_Sun_Angle><ZENITH_ANGLE>1</ZENITH_ANGLE></Mean_Sun_Angle>").otherwise("")
    offsets = F.when(F.col("l_linenumber") == 1, F.lit("")).otherwise(
        F.format_string("<BOA_ADD_OFFSET band_id='3'>-%s</BOA_ADD_OFFSET><BOA_ADD_OFFSET band_id='7'>-%s</BOA_ADD_OFFSET>",
                        F.col("l_quantity").cast("int"), F.when(F.col("l_linenumber") == 2, F.lit("x")).otherwise(F.lit("1000")))
    )
    return t.lineitem.select(
        *LINE, "l_extendedprice",
        (F.col("l_quantity") + F.when(F.col("l_linenumber") == 5, 0.5).otherwise(0.0)).alias("item_zenith"),
        F.format_string(GRANULE, F.col("l_quantity"), second).alias("granule_xml"),
        F.format_string(PRODUCT, offsets).alias("product_xml"),
    )


@query("xml_zenith", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber <> 6 THEN l_quantity END AS xml_zenith,
       CASE WHEN l_linenumber NOT IN (5, 6) THEN l_quantity END AS agreed_zenith,
       CASE WHEN l_linenumber NOT IN (5, 6) THEN 'PASS' ELSE 'FAIL' END AS cross_check FROM lineitem""")
def xml_zenith(t: Tables) -> DataFrame:
    made = _xml_items(t)
    return scene_source.with_xml_metadata(made, "item_zenith", "granule_xml", "product_xml").select(
        *LINE, "xml_zenith",
        F.col("mean_solar_zenith_angle").alias("agreed_zenith"), F.col("solar_geometry_cross_check").alias("cross_check"),
    )


@query("xml_radiometry", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(1 / 1e4, 9) AS red_scale,
       CASE WHEN l_linenumber = 1 THEN 0 ELSE round(-CAST(l_quantity AS INT) / 1e4, 9) END AS red_offset,
       CASE WHEN l_linenumber = 2 THEN NULL WHEN l_linenumber = 1 THEN 0 ELSE round(-1000 / 1e4, 9) END AS nir_offset, 0e0 AS nodata,
       CASE WHEN l_linenumber = 1 THEN 'PRODUCT_XML:BOA_QUANTIFICATION_VALUE+SCHEMA_DEFAULT_ZERO_OFFSET'
            ELSE 'PRODUCT_XML:BOA_QUANTIFICATION_VALUE+BOA_ADD_OFFSET' END AS metadata_source FROM lineitem""")
def xml_radiometry(t: Tables) -> DataFrame:
    bands = scene_source.with_xml_metadata(_xml_items(t), "item_zenith", "granule_xml", "product_xml")
    red, nir = F.col("radiometry")["B04"], F.col("radiometry")["B08"]
    return bands.select(
        *LINE, F.round(red["scale"], 9).alias("red_scale"), F.round(red["offset"], 9).alias("red_offset"),
        F.round(nir["offset"], 9).alias("nir_offset"), red["nodata"].alias("nodata"), red["metadata_source"].alias("metadata_source"),
    )


def solar_records(t: Tables) -> DataFrame:
    items = domain.scenes(t)
    gate = sc.solar_geometry(F.col("zenith_token"), F.col("zenith_source"), F.col("zenith_check"))
    return items.select("win", "id", "platform", "datatake_id", "processing_baseline", F.inline(F.array(gate)))


@query("solar_gate", """
SELECT id, zenith AS mean_solar_zenith_angle, zenith_status AS cross_check, exclusion_reason IS NULL AS admissible, exclusion_reason
FROM solar""", domain.SCENE_CTES + (domain.SOLAR_SQL,))
def solar_gate(t: Tables) -> DataFrame:
    return solar_records(t).select("id", "mean_solar_zenith_angle", "cross_check", "admissible", "exclusion_reason")


@query("solar_summary", """
, populations AS (SELECT win, 'discovered' AS population, zenith, exclusion_reason FROM solar
                  UNION ALL SELECT win, 'admitted', zenith, exclusion_reason FROM solar WHERE exclusion_reason IS NULL)
SELECT win, population, count(*) AS item_count, round(min(zenith), 9) AS minimum, round(quantile_cont(zenith, 0.25), 9) AS q25,
       round(median(zenith), 9) AS median, round(quantile_cont(zenith, 0.75), 9) AS q75, round(max(zenith), 9) AS maximum,
       count(*) - count(zenith) AS missing_count,
       count(*) FILTER (exclusion_reason = 'SOLAR_GEOMETRY_OUT_OF_RANGE') AS excluded_above_threshold_count,
       count(*) FILTER (exclusion_reason = 'SOLAR_GEOMETRY_METADATA_UNRESOLVED') AS excluded_unresolved_count,
       win = 'PRE' AS matches_stored
FROM populations GROUP BY ALL""", domain.SCENE_CTES + (domain.SOLAR_SQL,))
def solar_summary(t: Tables) -> DataFrame:
    """Computed, stored with the POST rows altered, read back and compared with what is computed again."""
    path = derived_path(t.spark, "solar-summary")
    summary = sc.solar_summary(solar_records(t))
    altered = summary.withColumn("item_count", F.col("item_count") + (F.col("win") == "POST").cast("long"))
    assessments.write_results(altered, path, ["population"])
    stored = assessments.read_results(t.spark, path, summary.schema)
    again = materialise(sc.solar_summary(solar_records(t)), "solar-again")
    checked = again.join(assessments.stored_differences(again, stored, ["win", "population"]), ["win", "population"])
    return checked.select(
        "win", "population", "item_count", *[F.round(c, 9).alias(c) for c in ("minimum", "q25", "median", "q75", "maximum")],
        "missing_count", "excluded_above_threshold_count", "excluded_unresolved_count",
        "matches_stored",
    )


@query("radiometry_gate", """
SELECT id, NOT asset_bad AS assets_present, NOT radiometry_bad AS radiometry_admissible FROM scenes""", domain.SCENE_CTES)
def radiometry_gate(t: Tables) -> DataFrame:
    return domain.scenes(t).select(
        "id", sc.assets_present(F.col("assets")).alias("assets_present"),
        sc.radiometry_admissible(F.col("radiometry")).alias("radiometry_admissible"),
    )


@query("radiometry_crosscheck", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       CASE WHEN l_partkey % 11 = 0 THEN 'QUANTIFICATION_NOT_POSITIVE' WHEN l_partkey % 7 = 0 THEN 'SCALE_CONTRADICTS'
            WHEN l_linenumber = 2 THEN 'OFFSET_CONTRADICTS' WHEN l_linenumber = 3 THEN 'NODATA_CONTRADICTS' END AS contradiction
FROM lineitem""")
def radiometry_crosscheck(t: Tables) -> DataFrame:
    q = F.col("l_quantity") * 100
    quantification = F.when(F.col("l_partkey") % 11 == 0, F.lit(0.0)).otherwise(q)
    found = sc.radiometry_agreement(
        F.when(F.col("l_partkey") % 7 == 0, 2.0 / q).otherwise(1.0 / q),
        F.when(F.col("l_linenumber") == 2, F.lit(0.5)).otherwise(-F.col("l_partkey") / q),
        F.when(F.col("l_linenumber") == 3, F.lit(1.0)).otherwise(F.lit(0.0)),
        quantification, -F.col("l_partkey").cast("double"), F.lit(0.0),
    )
    return t.lineitem.select(*LINE, found.alias("contradiction"))


@query("metadata_reasons", "SELECT id, reasons FROM reasoned", domain.SCENE_CTES)
def metadata_reasons(t: Tables) -> DataFrame:
    reasons = sc.metadata_reasons(F.col("assets"), F.col("mean_solar_zenith_angle"), F.col("radiometry"))
    return domain.scenes(t).select("id", F.array_join(reasons, ",").alias("reasons"))


@query("window_assign", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       CASE WHEN l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1998-07-01' THEN 'PRE'
            WHEN l_shipdate >= DATE '1998-07-01' AND l_shipdate < DATE '2001-01-01' THEN 'POST' END AS win FROM lineitem""")
def window_assign(t: Tables) -> DataFrame:
    windows = {"PRE": ("1996-01-01", "1998-06-30"), "POST": ("1998-07-01", "2000-12-31")}
    return t.lineitem.select(*LINE, sc.window_of(F.col("l_shipdate"), windows).alias("win"))


@query("window_union", """
SELECT CASE WHEN l_shipdate < DATE '1998-07-01' THEN 'PRE' ELSE 'POST' END AS win, l_returnflag AS platform, count(*) AS n
FROM lineitem GROUP BY ALL""")
def window_union(t: Tables) -> DataFrame:
    items = t.lineitem.select(F.col("l_returnflag").alias("platform"), "l_shipdate")
    day = F.lit(domain.SPLIT_DAY).cast("timestamp")
    both = sc.union_windows(items.filter(F.col("l_shipdate") < day), items.filter(F.col("l_shipdate") >= day))
    return both.groupBy("win", "platform").agg(F.count(F.lit(1)).alias("n"))


def components(t: Tables) -> DataFrame:
    return sc.canonical_components(sc.selection_input(domain.scenes(t)))


@query("canonical_representation", """
SELECT o.id, CASE WHEN rn = 1 THEN 'SELECTED_CANONICAL_REPRESENTATION' ELSE 'EXCLUDED_PROCESSING_REPRESENTATION' END AS status,
       rn = 1 AND reasons = '' AS metadata_admissible,
       CASE WHEN rn = 1 THEN reasons ELSE 'SUPERSEDED_PROCESSING_REPRESENTATION' END AS reasons FROM ordered o""",
       domain.CANONICAL_CTES)
def canonical_representation(t: Tables) -> DataFrame:
    return sc.representation_status(domain.scenes(t), components(t)).select(
        "id", F.col("representation_status").alias("status"), "metadata_admissible", joined("exclusion_reasons", "reasons")
    )


@query("selection_projection", """
SELECT win, platform, datatake_id, mgrs_tile, selected_item_id, FALSE AS changed_by_cloud FROM canonical""", domain.CANONICAL_CTES)
def selection_projection(t: Tables) -> DataFrame:
    """Selection before and after changing every environmental value: nothing may differ."""
    items = domain.scenes(t).withColumn("cloud_cover", F.col("mean_solar_zenith_angle"))
    altered = items.withColumn("cloud_cover", F.lit(100.0) - F.col("cloud_cover"))
    pick = lambda frame: sc.canonical_components(sc.selection_input(frame)).select(*sc.COMPONENT, "selected_item_id")
    after = pick(altered).withColumnRenamed("selected_item_id", "after_id")
    return pick(items).join(after, sc.COMPONENT, "full_outer").select(
        *sc.COMPONENT, "selected_item_id", (~F.col("selected_item_id").eqNullSafe(F.col("after_id"))).alias("changed_by_cloud")
    )


@query("ambiguous_representation", """
SELECT win, platform, datatake_id, mgrs_tile, finalist_count FROM canonical WHERE ambiguous""", domain.CANONICAL_CTES)
def ambiguous_representation(t: Tables) -> DataFrame:
    return components(t).filter("ambiguous").select(*sc.COMPONENT, "finalist_count")


@query("representation_records", """
SELECT win, platform, datatake_id, mgrs_tile, candidate_count, CASE WHEN NOT ambiguous THEN selected_item_id END AS selected_item_id,
       CASE WHEN ambiguous THEN 'AMBIGUOUS' ELSE 'RESOLVED' END AS status,
       CASE WHEN ambiguous THEN 'ACQUISITION_REPRESENTATION_AMBIGUOUS' ELSE '' END AS reasons FROM canonical""", domain.CANONICAL_CTES)
def representation_records(t: Tables) -> DataFrame:
    return sc.representation_records(components(t)).select(
        *sc.COMPONENT, "candidate_count", "selected_item_id", "status", joined("reason_codes", "reasons")
    )


@query("acquisition_groups", """
SELECT win, platform, datatake_id, sensing_datetime, item_ids, tiles, reasons, reasons = '' AS metadata_admissible FROM acq""", domain.GROUP_CTES)
def acquisition_groups(t: Tables) -> DataFrame:
    return sc.acquisition_groups(components(t)).select(
        *sc.ACQUISITION, "sensing_datetime", joined("component_item_ids", "item_ids"), joined("mgrs_tiles", "tiles"),
        joined("exclusion_reasons", "reasons"), "metadata_admissible",
    )


# windows of two days: some clean, some with contradictory identities or equal candidates
SHORT_CTES = tuple(
    c.replace("CASE WHEN l_shipdate < TIMESTAMP '1998-07-01' THEN 'PRE' ELSE 'POST' END AS win",
              "'W' || (date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) // 2) AS win") for c in domain.GROUP_CTES)


def short_windows(t: Tables) -> DataFrame:
    days = F.datediff(F.col("datetime").cast("date"), F.lit("1992-01-01").cast("date"))
    return domain.scenes(t).withColumn("win", F.concat(F.lit("W"), F.floor(days / 2)))


EVALUATE_SQL = """
, grouped AS (SELECT win, CAST(sum(components) AS BIGINT) AS components, count(*) AS groups,
                     count(*) FILTER (reasons = '') AS admissible FROM acq GROUP BY win),
raw AS (SELECT win, count(*) AS raw_item_count FROM scenes GROUP BY win),
stops AS (
  SELECT win, 'ACQUISITION_IDENTITY_UNRESOLVED' AS code, 1 AS place FROM scenes GROUP BY win, platform, datatake_id HAVING count(DISTINCT datetime) > 1
  UNION SELECT win, 'ACQUISITION_IDENTITY_UNRESOLVED', 1 FROM scenes GROUP BY win, id HAVING count(DISTINCT (platform, datatake_id, mgrs_tile, datetime)) > 1
  UNION SELECT win, 'ACQUISITION_REPRESENTATION_AMBIGUOUS', 2 FROM canonical WHERE ambiguous),
codes AS (SELECT win, string_agg(code, ',' ORDER BY place) AS reasons FROM stops GROUP BY win)
SELECT win, raw_item_count, components AS canonical_representation_count, groups AS independent_acquisition_group_count,
       admissible AS metadata_admissible_acquisition_group_count,
       CASE WHEN reasons IS NULL THEN 'READY_FOR_RASTER_LIMITED_PROCESSING' ELSE 'ERROR' END AS status,
       coalesce(reasons, '') AS reasons, reasons IS NULL AS raster_access_permitted,
       concat_ws(',', CASE WHEN raw_item_count > 200 THEN 'METADATA_INVENTORY_LIMIT_EXCEEDED' END,
                 CASE WHEN raw_item_count > 200 OR admissible > 40 THEN 'RESOURCE_LIMIT_EXCEEDED' END) AS limits
FROM raw JOIN grouped USING (win) LEFT JOIN codes USING (win)"""


@query("scene_metadata_evaluation", EVALUATE_SQL, SHORT_CTES)
def scene_metadata_evaluation(t: Tables) -> DataFrame:
    return _evaluated(short_windows(t))


def _evaluated(items: DataFrame) -> DataFrame:
    evaluated = scene_selection.evaluate_windows(items)
    return evaluated.withColumn("reasons", F.array_join("reason_codes", ",")).withColumn("limits", F.array_join("limit_codes", ",")).drop(
        "reason_codes", "limit_codes")


@query("resource_gate", EVALUATE_SQL, domain.GROUP_CTES)
def resource_gate(t: Tables) -> DataFrame:
    """The same plan over the two long windows, beyond every limit: all counts stay."""
    return _evaluated(domain.scenes(t))


@query("acquisition_ids", """
SELECT DISTINCT win, CASE WHEN CAST(datatake_id AS VARCHAR) LIKE '%3' THEN ' ' ELSE CAST(datatake_id AS VARCHAR) END AS datatake_id,
       CASE WHEN CAST(datatake_id AS VARCHAR) LIKE '%3' THEN 'SOURCE_VERSION_UNRESOLVED' END AS violation FROM scenes""", domain.SCENE_CTES)
def acquisition_ids(t: Tables) -> DataFrame:
    """Of the acquisitions, those whose id ends in 3 come without it."""
    named = F.col("datatake_id").cast("string")
    return sc.independent_acquisitions(domain.scenes(t).withColumn("datatake_id", F.when(named.endswith("3"), " ").otherwise(named)))


@query("window_gate", """
, fractions AS (SELECT win, count(*) FILTER (exclusion_reason IS NULL) / count(*) AS f,
                       count(DISTINCT datatake_id) FILTER (exclusion_reason IS NULL) AS n FROM solar GROUP BY win)
SELECT win, round(f, 9) AS valid_fraction, n AS independent_acquisition_count,
       CASE WHEN n >= 3 AND f >= 8e-1 THEN 'COMPLETED' ELSE 'ABSTAINED' END AS execution_status,
       CASE WHEN NOT (n >= 3 AND f >= 8e-1) THEN 'INCONCLUSIVE' END AS evidence_disposition,
       CASE WHEN n >= 3 AND f >= 8e-1 THEN '' ELSE 'VALID_OBSERVATION_COVERAGE_LOW' END AS reasons
FROM fractions""", domain.SCENE_CTES + (domain.SOLAR_SQL,))
def window_gate(t: Tables) -> DataFrame:
    records = solar_records(t)
    fractions = records.groupBy("win").agg((F.count_if("admissible") / F.count(F.lit(1))).alias("valid_fraction"))
    return sc.window_gate(records.filter("admissible"), fractions).select(
        "win", F.round("valid_fraction", 9).alias("valid_fraction"), "independent_acquisition_count", "execution_status",
        "evidence_disposition", joined("reason_codes", "reasons"),
    )


@query("baseline_histogram", "SELECT win, processing_baseline AS baseline, count(*) AS item_count FROM scenes GROUP BY ALL",
       domain.SCENE_CTES)
def baseline_histogram(t: Tables) -> DataFrame:
    return sc.baseline_histogram(domain.scenes(t))


@query("identity_conflicts", """
SELECT win, 'ITEM' AS kind, id AS key, count(DISTINCT (platform, datatake_id, mgrs_tile, datetime)) AS variants
FROM scenes GROUP BY ALL HAVING variants > 1
UNION ALL
SELECT win, 'ACQUISITION', concat(platform, '/', datatake_id), count(DISTINCT datetime) AS variants FROM scenes
GROUP BY win, platform, datatake_id HAVING variants > 1""", domain.SCENE_CTES)
def identity_conflicts(t: Tables) -> DataFrame:
    return sc.identity_conflicts(domain.scenes(t))


@query("scene_records", """
SELECT id AS item_id, band, reasons = '' AS admissible, CASE WHEN band = 'B04' THEN -1e-1 ELSE -1e-1 END AS band_offset
FROM (SELECT o.*, unnest(CASE WHEN asset_key % 29 = 0 THEN ['B04'] ELSE ['B04', 'B08'] END) AS band FROM ordered o WHERE rn = 1)""",
       domain.CANONICAL_CTES)
def scene_records(t: Tables) -> DataFrame:
    """Calibration records of the selected items, one row per band."""
    items = domain.scenes(t)
    status = sc.representation_status(items, sc.canonical_components(sc.selection_input(items)))
    picked = status.filter(F.col("representation_status") == "SELECTED_CANONICAL_REPRESENTATION")
    return picked.select(
        F.col("id").alias("item_id"), F.col("metadata_admissible").alias("admissible"), F.explode("radiometry").alias("band", "record")
    ).select("item_id", "band", "admissible", F.col("record.offset").alias("band_offset"))


@query("grid_congruence", """
SELECT l_suppkey, l_partkey, (l_quantity % 10 = 0 AND l_linenumber <> 1) AS congruent,
       (l_quantity % 10 = 0 AND l_linenumber <> 1) AS north_up FROM lineitem""")
def grid_congruence(t: Tables) -> DataFrame:
    resolution = F.when(F.col("l_linenumber") == 1, F.lit(20.0)).otherwise(F.lit(10.0))
    x, y = 738700 + F.col("l_quantity"), F.lit(6000000.0)
    transform = F.array(resolution, F.lit(0.0), x, F.lit(0.0), -resolution, y)
    return t.lineitem.select(
        "l_suppkey", "l_partkey",
        geo.congruent(resolution, -resolution, x, y).alias("congruent"), geo.north_up_congruent(transform).alias("north_up"),
    )


@query("dedupe_payload", """
SELECT sha256(text) AS text_key, count(*) AS copies, count(DISTINCT source) > 1 AS conflict FROM documents GROUP BY text""")
def dedupe_payload(t: Tables) -> DataFrame:
    keyed = t.documents.select(F.sha2(F.col("text").cast("binary"), 256).alias("text_key"), "source")
    return sc.dedupe(keyed, ["text_key"], F.col("source")).select("text_key", "copies", "conflict")


@query("dedupe_counts", """
SELECT count(*) AS before_count, count(DISTINCT text) AS after_count, count(*) - count(DISTINCT text) AS duplicate_count
FROM documents""")
def dedupe_counts(t: Tables) -> DataFrame:
    keyed = t.documents.select(F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    return sc.dedupe_counts(keyed, ["digest"])
