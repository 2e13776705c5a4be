"""Sinks for assessment and result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_results(rows: DataFrame, path: str, partition_by: Sequence[str] = ("execution_status",)) -> None:
    """Write result rows as Parquet. Partition by few-valued columns; ids make too many files."""
    rows.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)


def stored_differences(now: DataFrame, stored: DataFrame, keys: Sequence[str], digits: int = 9) -> DataFrame:
    """``keys`` and ``matches_stored``: whether a stored row agrees with the row computed again, reals to ``digits`` digits.

    A row that only one side has does not match.
    """
    def whole(frame: DataFrame) -> DataFrame:
        values = [F.round(f.name, digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in now.schema if f.name not in keys]
        return frame.select(*keys, F.struct(*values).alias("_row"))

    other = whole(stored).withColumnRenamed("_row", "_stored")
    return whole(now).join(other, list(keys), "full_outer").select(*keys, F.col("_row").eqNullSafe(F.col("_stored")).alias("matches_stored"))


def read_results(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)
