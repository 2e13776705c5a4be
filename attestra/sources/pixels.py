"""Pixel components as Parquet, partitioned so that a group's scan prunes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from attestra.schemas import PIXELS
from attestra.session import derived_path


def write_pixels(pixels: DataFrame, path: str | None = None) -> str:
    """Write the pixel table partitioned by window and acquisition; returns the path."""
    target = path or derived_path(pixels.sparkSession, "pixels")
    pixels.write.mode("errorifexists").partitionBy("win", "acquisition").parquet(target)
    return target


def read_pixels(
    spark: SparkSession, path: str, *, windows: Sequence[str] | None = None, acquisitions: Sequence[int] | None = None
) -> DataFrame:
    """Read components of some windows and acquisitions; only their files are opened."""
    frame = spark.read.schema(PIXELS).parquet(path)
    if windows is not None:
        frame = frame.filter(F.col("win").isin(*windows))
    if acquisitions is not None:
        frame = frame.filter(F.col("acquisition").isin(*acquisitions))
    return frame
