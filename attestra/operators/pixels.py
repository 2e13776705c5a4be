"""Pixel time series: calibrate, mask, mosaic, composite, compare.

Tables are long: one row per (case, window, acquisition, component, pixel).
Missing is NULL. The first shuffle is keyed by (case, window, acquisition,
pixel) after map-side combining; the second, by (case, pixel), carries one row
per acquisition only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from attestra import fixed_values as fixed
from attestra.functions import quantiles
from attestra.functions.numeric import exact_difference, finite, fraction

CELL = ["case_id", "win", "acquisition", "pixel_id"]


def attach_calibration(pixels: DataFrame, calibration: DataFrame, keys: list[str]) -> DataFrame:
    """Join per-band calibration rows (key, band, scale, offset, nodata), one row per key."""
    pick = lambda band, field: F.max(F.when(F.col("band") == band, F.col(field)))
    wide = calibration.groupBy(*keys).agg(
        *[
            pick(band, field).alias(f"{name}_{field}")
            for name, band in (("red", "B04"), ("nir", "B08"))
            for field in ("scale", "offset", "nodata")
        ]
    )
    return pixels.join(wide, keys, "left")


def source_valid_dn(dn: Column, nodata: Column) -> Column:
    return finite(dn) & (dn != 0) & (dn != nodata)


def valid_pixel() -> Column:
    """All validity rules on one observation; NULL inputs count as invalid."""
    red, nir = reflectance("red"), reflectance("nir")
    rules = (
        source_valid_dn(F.col("red_dn"), F.col("red_nodata"))
        & source_valid_dn(F.col("nir_dn"), F.col("nir_nodata"))
        & F.col("scl").isin(*fixed.VALID_SCL_CLASSES)
        & F.col("source_valid")
        & finite(red) & finite(nir)
        & (F.abs(nir + red) > fixed.DENOMINATOR_EPSILON)
    )
    return F.coalesce(rules, F.lit(False))


def reflectance(band: str) -> Column:
    return F.col(f"{band}_dn") * F.col(f"{band}_scale") + F.col(f"{band}_offset")


def with_ndvi(pixels: DataFrame) -> DataFrame:
    """Add ``valid``, ``ndvi`` (NULL unless valid, clipped to [-1, 1]) and ``out_of_range``."""
    red, nir = reflectance("red"), reflectance("nir")
    raw = F.when(valid_pixel(), (nir - red) / (nir + red))
    limit = 1.0 + fixed.NDVI_TOLERANCE
    return (
        pixels.withColumn("valid", valid_pixel())
        .withColumn("_raw", raw)
        .withColumn("out_of_range", F.coalesce(F.abs("_raw") > limit, F.lit(False)))
        .withColumn("ndvi", F.when(F.col("_raw").isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_raw")))))
        .drop("_raw")
    )


def require_in_range(pixels: DataFrame) -> DataFrame:
    """Strict mode: the job fails on the first index outside [-1, 1]."""
    message = F.lit("calibrated index outside [-1, 1]")
    return pixels.withColumn("ndvi", F.when(F.col("out_of_range"), F.raise_error(message)).otherwise(F.col("ndvi")))


def restrict_to_aoi(pixels: DataFrame, aoi: DataFrame) -> DataFrame:
    return pixels.join(aoi.select("case_id", "pixel_id"), ["case_id", "pixel_id"], "left_semi")


def mosaic(observations: DataFrame) -> DataFrame:
    """First valid value per cell in component order, with the largest departure from it.

    ``component_order`` is the component's place within its acquisition.
    """
    valid = observations.filter(F.col("ndvi").isNotNull())
    return (
        valid.groupBy(*CELL)
        .agg(
            F.min_by("ndvi", "component_order").alias("ndvi"),
            F.min("ndvi").alias("_low"), F.max("ndvi").alias("_high"),
            F.count(F.lit(1)).alias("component_count"),
        )
        .select(
            *CELL, "ndvi", "component_count",
            F.greatest(F.col("_high") - F.col("ndvi"), F.col("ndvi") - F.col("_low")).alias("departure"),
        )
    )


def mosaic_conflicts(mosaicked: DataFrame, tolerance: float = fixed.MOSAIC_TOLERANCE) -> DataFrame:
    return mosaicked.filter(F.col("departure") > tolerance)


def acquisition_counts(observations: DataFrame) -> DataFrame:
    """Independent acquisitions per case and window (every acquisition, valid or not)."""
    return observations.groupBy("case_id", "win").agg(F.count_distinct("acquisition").alias("acquisitions"))


def composites(mosaicked: DataFrame, minimum: int = fixed.MINIMUM_OBSERVATIONS) -> DataFrame:
    """Per pixel: observation count and temporal median of both windows, in one shuffle.

    A pixel holds at most one value per acquisition here, so the exact median
    works on a bounded group.
    """
    in_window = lambda w: F.when(F.col("win") == w, F.col("ndvi"))
    counted = mosaicked.groupBy("case_id", "pixel_id").agg(
        F.count(in_window(fixed.PRE)).alias("pre_count"),
        F.count(in_window(fixed.POST)).alias("post_count"),
        F.median(in_window(fixed.PRE)).alias("_pre"),
        F.median(in_window(fixed.POST)).alias("_post"),
    )
    enough = lambda name: F.when(F.col(f"{name}_count") >= minimum, F.col(f"_{name}"))
    return counted.select(
        "case_id", "pixel_id", "pre_count", "post_count",
        enough("pre").alias("pre_ndvi"), enough("post").alias("post_ndvi"),
    )


def over_aoi(composite: DataFrame, aoi: DataFrame) -> DataFrame:
    """Every AOI pixel, with zero counts where nothing was observed, and the joint flag."""
    joined = aoi.select("case_id", "pixel_id").join(composite, ["case_id", "pixel_id"], "left")
    joint = F.col("pre_ndvi").isNotNull() & F.col("post_ndvi").isNotNull()
    return joined.select(
        "case_id", "pixel_id",
        F.coalesce("pre_count", F.lit(0)).alias("pre_count"),
        F.coalesce("post_count", F.lit(0)).alias("post_count"),
        "pre_ndvi", "post_ndvi",
        joint.alias("joint"),
        F.when(joint, F.col("post_ndvi") - F.col("pre_ndvi")).alias("delta"),
    )


def joint_coverage(
    aoi_pixels: DataFrame, acquisitions: DataFrame,
    minimum: int = fixed.MINIMUM_OBSERVATIONS, minimum_fraction: float = fixed.MINIMUM_JOINT_FRACTION,
) -> DataFrame:
    """One row per case: totals, eligible and joint pixels, fraction, pass flag.

    Fewer than the minimum of acquisitions in either window zeroes the result.
    """
    per_window = acquisitions.groupBy("case_id").agg(
        F.coalesce(F.max(F.when(F.col("win") == fixed.PRE, F.col("acquisitions"))), F.lit(0)).alias("pre_acquisitions"),
        F.coalesce(F.max(F.when(F.col("win") == fixed.POST, F.col("acquisitions"))), F.lit(0)).alias("post_acquisitions"),
    )
    totals = aoi_pixels.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("aoi_total_pixels"),
        F.count("pre_ndvi").alias("_pre"), F.count("post_ndvi").alias("_post"),
        F.count_if("joint").alias("_joint"),
    )
    both = totals.join(per_window, "case_id", "left").fillna(0, ["pre_acquisitions", "post_acquisitions"])
    enough = (F.col("pre_acquisitions") >= minimum) & (F.col("post_acquisitions") >= minimum)
    gated = lambda name: F.when(enough, F.col(name)).otherwise(F.lit(0))
    return (
        both.withColumn("enough_acquisitions", enough)
        .withColumn("pre_eligible_pixels", gated("_pre"))
        .withColumn("post_eligible_pixels", gated("_post"))
        .withColumn("aoi_valid_pixels", gated("_joint"))
        .withColumn("aoi_valid_fraction", fraction(F.col("aoi_valid_pixels"), F.col("aoi_total_pixels")))
        .withColumn("coverage_passed", enough & (F.col("aoi_valid_fraction") >= minimum_fraction))
        .drop("_pre", "_post", "_joint")
    )


def _measures(aoi_pixels: DataFrame) -> DataFrame:
    """Joint pixels as (case, measure, value): both composites and their difference."""
    names = (("PRE", "pre_ndvi"), ("POST", "post_ndvi"), ("DELTA", "delta"))
    rows = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(c).alias("value")) for m, c in names])
    return aoi_pixels.filter("joint").select("case_id", F.inline(rows))


def measure_distributions(aoi_pixels: DataFrame) -> DataFrame:
    """Exact distribution of PRE, POST and DELTA over the joint pixels of each case."""
    return quantiles.distribution(_measures(aoi_pixels), ["case_id", "measure"], "value")


def window_medians(aoi_pixels: DataFrame) -> DataFrame:
    """Median of each window over joint pixels and their exact decimal difference."""
    medians = quantiles.grouped_quantiles(
        _measures(aoi_pixels).filter("measure <> 'DELTA'"), ["case_id", "measure"], "value", [0.5], ["median"]
    )
    pick = lambda m: F.max(F.when(F.col("measure") == m, F.col("median")))
    wide = medians.groupBy("case_id").agg(
        pick("PRE").alias("pre_window_ndvi_median"), pick("POST").alias("post_window_ndvi_median")
    )
    return wide.withColumn(
        "delta_ndvi", exact_difference(F.col("post_window_ndvi_median"), F.col("pre_window_ndvi_median"))
    )


def valid_count_distribution(aoi_pixels: DataFrame) -> DataFrame:
    """Distribution of per-pixel valid counts over the AOI, per window."""
    rows = F.array(
        F.struct(F.lit(fixed.PRE).alias("win"), F.col("pre_count").alias("valid_count")),
        F.struct(F.lit(fixed.POST).alias("win"), F.col("post_count").alias("valid_count")),
    )
    return quantiles.count_distribution(aoi_pixels.select("case_id", F.inline(rows)), ["case_id", "win"], "valid_count")


def class_histogram(observations: DataFrame, keys: list[str]) -> DataFrame:
    """Scene-class counts of source-valid pixels, long form."""
    return observations.filter("source_valid").groupBy(*keys, "scl").agg(F.count(F.lit(1)).alias("pixel_count"))


def scene_diagnostics(observations: DataFrame, keys: list[str]) -> DataFrame:
    """Covered and valid pixels per scene and their ratio (zero when nothing is covered)."""
    return (
        observations.groupBy(*keys)
        .agg(F.count_if("source_valid").alias("covered_pixels"), F.count("ndvi").alias("valid_pixels"))
        .withColumn("valid_fraction", fraction(F.col("valid_pixels"), F.col("covered_pixels")))
    )


def coverage_gap(observations: DataFrame, target: Column) -> DataFrame:
    """Pixels of an acquisition covered by some member but by no target-lattice member."""
    return (
        observations.groupBy(*CELL)
        .agg(F.count_if(target).alias("_target"))
        .filter(F.col("_target") == 0)
        .select(*CELL)
    )


def footprint_union(observations: DataFrame) -> DataFrame:
    """Distinct pixels any member of an acquisition covers."""
    return observations.select(*CELL).distinct()
