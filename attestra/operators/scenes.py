"""Scene metadata: dedupe, gates, canonical representation, acquisition groups.

Items need ``win``, ``id``, ``platform``, ``datatake_id``, ``datetime``,
``mgrs_tile``, ``processing_baseline``, ``processing_datetime``, ``assets`` and
``radiometry``. Environmental values (cloud cover, index, classes) are never
read here: :data:`IDENTITY_COLUMNS` is all that selection sees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from attestra import fixed_values as fixed
from attestra.functions import quantiles
from attestra.functions.numeric import finite, json_number, version_key

COMPONENT = ["win", "platform", "datatake_id", "mgrs_tile"]
ACQUISITION = ["win", "platform", "datatake_id"]
IDENTITY_COLUMNS = [
    "win", "id", "platform", "datatake_id", "datetime", "mgrs_tile", "processing_baseline", "processing_datetime",
    "mean_solar_zenith_angle", "assets", "radiometry",
]


def selection_input(items: DataFrame) -> DataFrame:
    """Keep identity and calibration columns only."""
    return items.select(*IDENTITY_COLUMNS)


# --- duplicates and identity ---------------------------------------------------


def dedupe(items: DataFrame, keys: list[str], payload: Column) -> DataFrame:
    """One row per key with its copy count and whether the copies disagree."""
    return items.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("copies"),
        F.count_distinct(F.sha2(payload.cast("binary"), 256)).alias("payloads"),
    ).withColumn("conflict", F.col("payloads") > 1)


def dedupe_counts(items: DataFrame, keys: list[str]) -> DataFrame:
    """Rows before, distinct keys after, and the duplicates dropped."""
    per_key = items.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(
        F.sum("_n").alias("before_count"), F.count(F.lit(1)).alias("after_count"),
        (F.sum("_n") - F.count(F.lit(1))).alias("duplicate_count"),
    )


def identity_conflicts(items: DataFrame) -> DataFrame:
    """Item ids with several identities and acquisitions with several sensing times."""
    by_id = items.groupBy(F.col("win"), F.lit("ITEM").alias("kind"), F.col("id").alias("key")).agg(
        F.count_distinct("platform", "datatake_id", "mgrs_tile", "datetime").alias("variants")
    )
    by_acquisition = items.groupBy(
        F.col("win"), F.lit("ACQUISITION").alias("kind"), F.concat_ws("/", "platform", "datatake_id").alias("key")
    ).agg(F.count_distinct("datetime").alias("variants"))
    return by_id.unionByName(by_acquisition).filter("variants > 1")


def unclear_windows(items: DataFrame) -> DataFrame:
    """Windows with an item or an acquisition of :func:`identity_conflicts`, from the least and greatest identity of each: one shuffle, no counting."""
    whole = items.dropna(subset=["platform", "datatake_id", "mgrs_tile", "datetime"])
    identity = F.struct("platform", "datatake_id", "mgrs_tile", "datetime")
    by_id = whole.groupBy("win", "id").agg((F.min(identity) != F.max(identity)).alias("_differ"))
    by_acquisition = items.groupBy("win", F.concat_ws("/", "platform", "datatake_id").alias("key")).agg(
        F.coalesce(F.min("datetime") != F.max("datetime"), F.lit(False)).alias("_differ"))
    return by_id.select("win", "_differ").unionByName(by_acquisition.select("win", "_differ")).filter("_differ").select("win").distinct()


def identity_violation(collection: str | None = None) -> Column:
    """First unusable identity field of an item, as a reason code, or NULL."""
    blank = lambda c: F.coalesce(F.length(F.trim(F.col(c).cast("string"))), F.lit(0)) == 0
    checks = [F.when(blank("id"), F.lit("ACQUISITION_IDENTITY_UNRESOLVED"))]
    if collection:
        checks.append(F.when(~F.col("collection").eqNullSafe(collection), F.lit("CANONICAL_IDENTIFIER_UNRESOLVED")))
    for column in ("platform", "datatake_id", "datetime", "mgrs_tile"):
        checks.append(F.when(blank(column), F.lit("ACQUISITION_IDENTITY_UNRESOLVED")))
    checks.append(
        F.when(version_key(F.col("processing_baseline")).isNull(), F.lit("PROCESSING_BASELINE_UNRESOLVED"))
    )
    return F.coalesce(*checks)


def window_stops(items: DataFrame, components: DataFrame, collection: str | None = None) -> DataFrame:
    """``win, stop_codes``: why a window must stop, in the order of the checks; windows without a reason are absent.

    An unusable or contradictory identity comes first, then candidates of equal
    rank with different assets.
    """
    unusable = items.select("win", identity_violation(collection).alias("code"), F.lit(1).alias("place")).filter("code IS NOT NULL").distinct()
    unclear = unclear_windows(items).select("win", F.lit("ACQUISITION_IDENTITY_UNRESOLVED").alias("code"), F.lit(2).alias("place"))
    equal = components.filter("ambiguous").select("win", F.lit("ACQUISITION_REPRESENTATION_AMBIGUOUS").alias("code"), F.lit(3).alias("place")).distinct()
    found = unusable.unionByName(unclear).unionByName(equal).groupBy("win", "code").agg(F.min("place").alias("place"))
    return found.groupBy("win").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "code"))), lambda c: c["code"]).alias("stop_codes"))


# --- metadata gates ----------------------------------------------------------------


def solar_geometry(raw: Column, metadata_source: Column, cross_check: Column) -> Column:
    """Gate one raw zenith token: value, check, admissible, reason (70 degrees is admitted)."""
    value = json_number(raw)
    source = F.nullif(metadata_source, F.lit(""))
    trusted = source.isNotNull() & F.coalesce(cross_check == "PASS", F.lit(False))
    missing = raw.isNull() | (F.trim(raw) == "null")
    check = (
        F.when(missing, "MISSING").when(value.isNull(), "UNPARSEABLE").when(~trusted, "FAIL").otherwise("PASS")
    )
    reason = F.when(missing | value.isNull() | ~trusted, "SOLAR_GEOMETRY_METADATA_UNRESOLVED").when(
        value > fixed.SOLAR_ZENITH_MAX_DEGREES, "SOLAR_GEOMETRY_OUT_OF_RANGE"
    )
    return F.struct(
        value.alias("mean_solar_zenith_angle"), source.alias("metadata_source"), check.alias("cross_check"),
        reason.isNull().alias("admissible"), reason.alias("exclusion_reason"),
    )


def solar_agreement(item_value: Column, xml_value: Column) -> Column:
    """The XML zenith when the item's own value agrees with it, else NULL."""
    close = finite(item_value) & (F.abs(item_value - xml_value) <= fixed.SOLAR_CROSS_CHECK_TOLERANCE)
    return F.when(close, xml_value)


def assets_present(assets: Column) -> Column:
    """Every required asset key is present and not blank."""
    keys = F.array(*[F.lit(k) for k in fixed.REQUIRED_ASSET_KEYS])
    return F.coalesce(
        F.forall(keys, lambda k: F.coalesce(F.length(F.trim(F.element_at(assets, k))), F.lit(0)) > 0), F.lit(False)
    )


def radiometry_admissible(radiometry: Column) -> Column:
    """Both bands carry four finite numbers, a positive quantification, a source and a passed check."""
    good = F.lit(True)
    for band in fixed.RADIOMETRY_BANDS:
        record = F.element_at(radiometry, F.lit(band))
        numbers = F.lit(True)
        for name in ("scale", "offset", "quantification_value", "nodata"):
            numbers = numbers & finite(record[name])
        good = (
            good & numbers & (record["quantification_value"] > 0)
            & (F.length(F.trim(record["metadata_source"])) > 0) & (record["cross_check"] == "PASS")
        )
    return F.coalesce(good, F.lit(False))


def radiometry_agreement(
    scale: Column, offset: Column, nodata: Column, quantification: Column, offset_dn: Column, product_nodata: Column
) -> Column:
    """First contradiction between asset and product calibration, or NULL."""
    inputs = (scale, offset, nodata, quantification, offset_dn, product_nodata)
    incomplete = F.lit(False)
    for value in inputs:
        incomplete = incomplete | ~finite(value)
    far = lambda a, b: F.abs(a - b) > fixed.RADIOMETRY_TOLERANCE
    return (
        F.when(incomplete, "MISSING")
        .when(quantification <= 0, "QUANTIFICATION_NOT_POSITIVE")
        .when(far(scale, F.lit(1.0) / quantification), "SCALE_CONTRADICTS")
        .when(far(offset, offset_dn / quantification), "OFFSET_CONTRADICTS")
        .when(nodata != product_nodata, "NODATA_CONTRADICTS")
    )


def metadata_reasons(assets: Column, zenith: Column, radiometry: Column) -> Column:
    """Ordered distinct exclusion reasons of one item."""
    return F.array_distinct(
        F.array_compact(
            F.array(
                F.when(~assets_present(assets), F.lit("RADIOMETRY_METADATA_UNRESOLVED")),
                F.when(~finite(zenith), F.lit("SOLAR_GEOMETRY_METADATA_UNRESOLVED")).when(
                    zenith > fixed.SOLAR_ZENITH_MAX_DEGREES, F.lit("SOLAR_GEOMETRY_OUT_OF_RANGE")
                ),
                F.when(~radiometry_admissible(radiometry), F.lit("RADIOMETRY_METADATA_UNRESOLVED")),
            )
        )
    )


def window_of(moment: Column, windows: dict[str, tuple[str, str]]) -> Column:
    """Name of the closed date window a moment falls in, or NULL."""
    out = F.lit(None).cast("string")
    for name, (first, last) in windows.items():
        inside = (moment >= F.lit(first).cast("timestamp")) & (
            moment < F.date_add(F.lit(last).cast("date"), 1).cast("timestamp")
        )
        out = F.coalesce(out, F.when(inside, F.lit(name)))
    return out


def union_windows(pre: DataFrame, post: DataFrame) -> DataFrame:
    return pre.withColumn("win", F.lit(fixed.PRE)).unionByName(post.withColumn("win", F.lit(fixed.POST)))


# --- canonical representation --------------------------------------------------------


def asset_identity(assets: Column) -> Column:
    """The required assets' addresses side by side: no separator to confuse, and a missing one is a value of its own."""
    return F.struct(*[F.trim(F.element_at(assets, F.lit(k))).alias(f"a{i}") for i, k in enumerate(fixed.REQUIRED_ASSET_KEYS)])


def canonical_components(items: DataFrame) -> DataFrame:
    """Per component: the chosen item, its reasons, the candidate count and ambiguity.

    Highest baseline (numeric), then latest processing time (a missing one loses),
    then smallest id. Candidates first collapse to ties of equal baseline and
    time, map-side, so a component of any size is fine. Run after
    :func:`dedupe`: ids must be unique.
    """
    best = F.max_by(F.struct("_first", "_count", "_ambiguous"), F.struct("_baseline", "_time"))
    return _ties(items).groupBy(*COMPONENT).agg(best.alias("_best"), F.sum("_count").alias("candidate_count")).select(
        *COMPONENT,
        F.col("_best._first.id").alias("selected_item_id"),
        F.col("_best._first.datetime").alias("datetime"),
        F.col("_best._first.reasons").alias("exclusion_reasons"),
        F.col("_best._count").alias("finalist_count"),
        F.col("_best._ambiguous").alias("ambiguous"),
        "candidate_count",
    )


def component_gates(items: DataFrame) -> DataFrame:
    """Per component of :func:`canonical_components` only whether the chosen item is admissible and whether it is ambiguous."""
    gates = F.struct((F.size("_first.reasons") == 0).alias("admissible"), "_ambiguous")
    best = _ties(items).groupBy(*COMPONENT).agg(F.max_by(gates, F.struct("_baseline", "_time")).alias("_best"))
    return best.select(*COMPONENT, F.col("_best.admissible").alias("admissible"), F.col("_best._ambiguous").alias("ambiguous"))


def _ties(items: DataFrame) -> DataFrame:
    """Candidates of equal baseline and time: the one of least id, how many there are and whether their assets differ."""
    ties = items.groupBy(
        *COMPONENT, version_key(F.col("processing_baseline")).alias("_baseline"), F.col("processing_datetime").alias("_time")
    ).agg(
        F.min(F.struct(
            F.col("id"), F.col("datetime"),
            metadata_reasons(F.col("assets"), F.col("mean_solar_zenith_angle"), F.col("radiometry")).alias("reasons"),
        )).alias("_first"),
        F.count(F.lit(1)).alias("_count"),
        F.min(asset_identity(F.col("assets"))).alias("_low"), F.max(asset_identity(F.col("assets"))).alias("_high"),
    )
    return ties.withColumn("_ambiguous", ~F.col("_low").eqNullSafe(F.col("_high"))).drop("_low", "_high")


def representation_status(items: DataFrame, components: DataFrame) -> DataFrame:
    """Every item with its status, admissibility and reasons (joined on the unique item id)."""
    chosen = components.select(
        "win", F.col("selected_item_id").alias("id"), F.col("exclusion_reasons").alias("_reasons"), F.lit(True).alias("_chosen")
    )
    picked = F.coalesce(F.col("_chosen"), F.lit(False))
    superseded = F.array(F.lit("SUPERSEDED_PROCESSING_REPRESENTATION"))
    return (
        items.join(chosen, ["win", "id"], "left")
        .withColumn(
            "representation_status",
            F.when(picked, "SELECTED_CANONICAL_REPRESENTATION").otherwise("EXCLUDED_PROCESSING_REPRESENTATION"),
        )
        .withColumn("exclusion_reasons", F.when(picked, F.col("_reasons")).otherwise(superseded))
        .withColumn("metadata_admissible", picked & (F.size("exclusion_reasons") == 0))
        .drop("_reasons", "_chosen")
    )


def representation_records(components: DataFrame) -> DataFrame:
    """Candidate count and chosen item per component; an ambiguous one names no item."""
    return components.select(
        *COMPONENT, "candidate_count",
        F.when(~F.col("ambiguous"), F.col("selected_item_id")).alias("selected_item_id"),
        F.when(F.col("ambiguous"), "AMBIGUOUS").otherwise("RESOLVED").alias("status"),
        F.when(F.col("ambiguous"), F.array(F.lit("ACQUISITION_REPRESENTATION_AMBIGUOUS")))
        .otherwise(F.array().cast("array<string>")).alias("reason_codes"),
    )


def acquisition_groups(components: DataFrame) -> DataFrame:
    """Chosen items per acquisition in tile order, reasons united in that order.

    One chosen item per tile keeps each group as small as the tiles one pass
    can touch.
    """
    listed = components.groupBy(*ACQUISITION).agg(
        F.array_sort(F.collect_list(F.struct("mgrs_tile", "selected_item_id", "exclusion_reasons", "datetime"))).alias("_members")
    )
    reasons = F.array_distinct(F.flatten(F.transform("_members", lambda m: m["exclusion_reasons"])))
    return listed.select(
        *ACQUISITION, F.get(F.col("_members"), F.lit(0))["datetime"].alias("sensing_datetime"),
        F.transform("_members", lambda m: m["selected_item_id"]).alias("component_item_ids"),
        F.transform("_members", lambda m: m["mgrs_tile"]).alias("mgrs_tiles"),
        reasons.alias("exclusion_reasons"), (F.size(reasons) == 0).alias("metadata_admissible"),
    )


def independent_acquisitions(items: DataFrame) -> DataFrame:
    """Distinct (window, datatake); a missing datatake shows as an unresolved row."""
    blank = F.coalesce(F.length(F.trim(F.col("datatake_id").cast("string"))), F.lit(0)) == 0
    return items.select(
        "win", "datatake_id", F.when(blank, F.lit("SOURCE_VERSION_UNRESOLVED")).alias("violation")
    ).distinct()


def window_gate(admitted: DataFrame, valid_fraction: DataFrame) -> DataFrame:
    """At least three distinct datatakes and a sufficient valid fraction, per window.

    Counts the datatake alone, unlike the grouping, which adds the platform.
    """
    counted = admitted.groupBy("win").agg(F.count_distinct("datatake_id").alias("independent_acquisition_count"))
    passes = (F.coalesce("independent_acquisition_count", F.lit(0)) >= fixed.MINIMUM_OBSERVATIONS) & (
        F.col("valid_fraction") >= fixed.MINIMUM_JOINT_FRACTION
    )
    return valid_fraction.join(counted, "win", "left").select(
        "win", "valid_fraction",
        F.coalesce("independent_acquisition_count", F.lit(0)).alias("independent_acquisition_count"),
        F.when(passes, "COMPLETED").otherwise("ABSTAINED").alias("execution_status"),
        F.when(~passes, "INCONCLUSIVE").alias("evidence_disposition"),
        F.when(~passes, F.array(F.lit("VALID_OBSERVATION_COVERAGE_LOW"))).otherwise(F.array().cast("array<string>")).alias(
            "reason_codes"
        ),
    )


def over_limit(rows: DataFrame, keys: list[str], maximum: int) -> DataFrame:
    """Counts per key and whether the limit is passed. Nothing is ever cut."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).withColumn(
        "limit_exceeded", F.col("row_count") > maximum
    )


def baseline_histogram(items: DataFrame) -> DataFrame:
    return items.groupBy("win", F.coalesce("processing_baseline", F.lit("None")).alias("baseline")).agg(
        F.count(F.lit(1)).alias("item_count")
    )


# --- solar population ---------------------------------------------------------------------


def solar_summary(records: DataFrame) -> DataFrame:
    """Per window and population (discovered, admitted): spread of the zenith and exclusion counts."""
    populations = F.when(F.col("admissible"), F.array(F.lit("discovered"), F.lit("admitted"))).otherwise(
        F.array(F.lit("discovered"))
    )
    rows = records.withColumn("population", F.explode(populations))
    counted = lambda reason: F.count_if(F.col("exclusion_reason").eqNullSafe(reason))
    counts = rows.groupBy("win", "population").agg(
        F.count(F.lit(1)).alias("item_count"),
        F.count_if(F.col("mean_solar_zenith_angle").isNull()).alias("missing_count"),
        counted("SOLAR_GEOMETRY_OUT_OF_RANGE").alias("excluded_above_threshold_count"),
        counted("SOLAR_GEOMETRY_METADATA_UNRESOLVED").alias("excluded_unresolved_count"),
    )
    spread = quantiles.grouped_quantiles(
        rows, ["win", "population"], "mean_solar_zenith_angle", [0.25, 0.5, 0.75], ["q25", "median", "q75"]
    )
    return counts.join(spread.drop("n"), ["win", "population"], "left")


def solar_median_shift(summary: DataFrame) -> DataFrame:
    """POST minus PRE median of the admitted population."""
    of = lambda w: F.max(F.when((F.col("win") == w) & (F.col("population") == "admitted"), F.col("median")))
    return summary.agg((of(fixed.POST) - of(fixed.PRE)).alias("post_minus_pre_median_degrees"))
