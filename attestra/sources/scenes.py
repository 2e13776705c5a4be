"""Scene inventories: item pages, metadata XML, and the flat CSV form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from attestra.functions import xmlmeta
from attestra.operators.scenes import solar_agreement
from attestra.schemas import FEATURE_COLLECTION


def read_feature_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row per item of every feature-collection page below a path."""
    pages = spark.read.schema(FEATURE_COLLECTION).json(path)
    return pages.select(F.explode("features").alias("item"))


def inventory_rows(items: DataFrame, window: Column) -> DataFrame:
    """Flat inventory row of each raw item; nothing evaluated yet."""
    prop = lambda name: F.col("item.properties").getField(name)
    href = lambda key: F.element_at(F.col("item.assets"), F.lit(key))["href"]
    zenith = prop("s2:mean_solar_zenith")
    absent = lambda names, kind: [F.lit(None).cast(kind).alias(n) for n in names]
    calibration = [f"{band}_{field}" for band in ("b04", "b08") for field in ("scale", "offset", "quantification_value", "nodata")]
    return items.select(
        F.upper(window).alias("win"), F.col("item.id").alias("item_id"), F.col("item.collection").alias("collection"),
        prop("platform").alias("platform"), prop("datetime").alias("acquisition_datetime"),
        prop("s2:datatake_id").alias("datatake_id"), prop("s2:mgrs_tile").alias("mgrs_tile"),
        prop("sat:relative_orbit").alias("relative_orbit"), prop("s2:processing_baseline").alias("processing_baseline"),
        prop("eo:cloud_cover").alias("eo_cloud_cover"), zenith.alias("mean_solar_zenith_angle"),
        F.when(zenith.isNotNull(), "STAC_PROPERTY:s2:mean_solar_zenith").alias("solar_geometry_metadata_source"),
        F.when(zenith.isNotNull(), "AVAILABLE_NOT_EVALUATED").otherwise("MISSING_NOT_EVALUATED").alias("solar_geometry_status"),
        F.lit(None).cast("string").alias("radiometry_metadata_source"),
        F.lit("NOT_EVALUATED_RESOURCE_LIMIT_EXCEEDED").alias("radiometry_status"),
        *absent(calibration, "double"),
        href("B04").alias("b04_identity"), href("B08").alias("b08_identity"), href("SCL").alias("scl_identity"),
        href("granule-metadata").alias("granule_metadata_identity"),
        href("product-metadata").alias("product_metadata_identity"),
        F.array_sort(F.map_keys("item.assets")).alias("asset_keys"),
        *absent(["admissible"], "boolean"),
        F.lit("NOT_EVALUATED").alias("admissibility_status"),
        F.array().cast("array<string>").alias("exclusion_reasons"),
    )


def with_xml_metadata(items: DataFrame, item_zenith: str, granule_xml: str, product_xml: str) -> DataFrame:
    """Add the cross-checked zenith and both bands' calibration from the XML texts."""
    texts = items.withColumn("_zenith", xmlmeta.solar_zenith(F.col(granule_xml))).withColumn(
        "_texts", xmlmeta.calibration_texts(F.col(product_xml))
    )
    agreed = solar_agreement(F.col(item_zenith), F.col("_zenith"))
    return (
        texts.withColumn("mean_solar_zenith_angle", agreed)
        .withColumn("solar_geometry_cross_check", F.when(agreed.isNotNull(), "PASS").otherwise("FAIL"))
        .withColumn(
            "radiometry",
            F.create_map(
                F.lit("B04"), xmlmeta.radiometry(F.col("_texts"), "B04"),
                F.lit("B08"), xmlmeta.radiometry(F.col("_texts"), "B08"),
            ),
        )
        .withColumnRenamed("_zenith", "xml_zenith")
        .drop("_texts")
    )


def nested_as_json(frame: DataFrame) -> DataFrame:
    """Struct, array and map columns rendered as JSON text, ready for CSV."""
    flat = []
    for field in frame.schema:
        nested = field.dataType.typeName() in ("struct", "array", "map")
        flat.append(F.to_json(F.col(field.name)).alias(field.name) if nested else F.col(field.name))
    return frame.select(*flat)


def write_csv(frame: DataFrame, path: str, **options: str | int) -> None:
    nested_as_json(frame).write.option("header", True).option("escape", '"').options(**options).csv(path)
