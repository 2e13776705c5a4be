"""Scene metadata from raw items to the raster gate, window by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from attestra import fixed_values as fixed
from attestra.operators import scenes
from attestra.session import cut_lineage


def evaluate_windows(
    items: DataFrame,
    raw_limit: int = fixed.RAW_ITEM_LIMIT,
    group_limit: int = fixed.ACQUISITION_GROUP_LIMIT,
    collection: str | None = None,
) -> DataFrame:
    """One row per window: counts, status, reasons, whether pixels may be read, and the limits it exceeds.

    A window with an unusable or contradictory identity, or with candidates that
    cannot be told apart, is an ERROR with its codes and no raster access. The
    counts are always complete; ``limit_codes`` reports exceeded limits beside
    them and changes nothing else.
    """
    raw = items.groupBy("win").agg(F.count(F.lit(1)).alias("raw_item_count"))
    components = cut_lineage(scenes.component_gates(scenes.selection_input(items)))  # read by the groups and by the stops
    groups = components.groupBy(*scenes.ACQUISITION).agg(F.count(F.lit(1)).alias("_chosen"), F.bool_and("admissible").alias("metadata_admissible"))
    per_window = groups.groupBy("win").agg(
        F.sum("_chosen").alias("_components"),
        F.count(F.lit(1)).alias("_groups"),
        F.count_if("metadata_admissible").alias("_admissible"),
    )
    stops = scenes.window_stops(items, components, collection)
    none = F.array().cast("array<string>")
    count = lambda name: F.coalesce(F.col(name), F.lit(0))
    codes = F.coalesce("stop_codes", none)
    limits = F.array_compact(F.array(
        F.when(F.col("raw_item_count") > raw_limit, F.lit("METADATA_INVENTORY_LIMIT_EXCEEDED")),
        F.when((F.col("raw_item_count") > raw_limit) | (count("_admissible") > group_limit), F.lit("RESOURCE_LIMIT_EXCEEDED")),
    ))
    return raw.join(per_window, "win", "left").join(stops, "win", "left").select(
        "win", "raw_item_count",
        count("_components").alias("canonical_representation_count"),
        count("_groups").alias("independent_acquisition_group_count"),
        count("_admissible").alias("metadata_admissible_acquisition_group_count"),
        F.when(F.size(codes) > 0, "ERROR").otherwise("READY_FOR_RASTER_LIMITED_PROCESSING").alias("status"),
        codes.alias("reason_codes"), (F.size(codes) == 0).alias("raster_access_permitted"), limits.alias("limit_codes"),
    )
