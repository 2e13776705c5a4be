"""Artifact listings, checksum manifests and canonical JSON files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from attestra.functions.hashing import canonical_json


def media_type(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1))
    return (
        F.when(suffix == ".zip", "application/zip")
        .when(suffix == ".xml", "application/xml")
        .when(suffix.isin(".npy", ".npz"), "application/x-numpy")
        .when(suffix.isin(".md", ".txt", ".sha256", ".raw"), "text/plain")
        .otherwise("application/json")
    )


def artifact_type(path: Column) -> Column:
    return F.btrim(F.regexp_replace(F.upper(path), "[^A-Z0-9]+", "_"), F.lit("_"))


def artifact_records(paths: DataFrame, path: str, run: Column, *kept: str) -> DataFrame:
    """One record per path: its id, type and media type, beside the columns ``kept``."""
    name = F.col(path)
    return paths.select(
        *kept,
        F.concat(F.lit("urn:"), run, F.lit(":artifact:"), name).alias("artifact_id"),
        artifact_type(name).alias("artifact_type"), media_type(name).alias("media_type"),
    )


def file_checksums(spark: SparkSession, folder: str, exclude: str = "checksums.sha256") -> DataFrame:
    """SHA-256 and size of every file below a folder, by relative path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    relative = F.regexp_replace("path", r"^.*?" + _literal(folder.rstrip("/")) + "/", "")
    return files.select(relative.alias("relative_path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes")).filter(
        ~F.col("relative_path").endswith(exclude) & ~F.col("relative_path").rlike(r"(^|/)[._]")
    )


def _literal(text: str) -> str:
    return "\\Q" + text + "\\E"


def write_checksums(checksums: DataFrame, path: str) -> None:
    """Manifest lines ``sha256  relative_path`` in path order."""
    line = F.concat_ws("  ", "sha256", "relative_path")
    checksums.repartitionByRange("relative_path").sortWithinPartitions("relative_path").select(line).write.text(path)


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path)
    return lines.select(F.substring("value", 1, 64).alias("sha256"), F.expr("substring(value, 67)").alias("relative_path"))


def checksum_differences(recorded: DataFrame, actual: DataFrame) -> DataFrame:
    """Files missing, extra or changed against a recorded manifest."""
    both = recorded.select("relative_path", F.col("sha256").alias("recorded")).join(
        actual.select("relative_path", F.col("sha256").alias("actual")), "relative_path", "full_outer"
    )
    kind = (
        F.when(F.col("actual").isNull(), "MISSING").when(F.col("recorded").isNull(), "EXTRA")
        .when(F.col("actual") != F.col("recorded"), "CHANGED")
    )
    return both.select("relative_path", kind.alias("difference")).filter(F.col("difference").isNotNull())


def write_canonical_json(rows: DataFrame, path: str, form: str = "ascii") -> None:
    """One canonical JSON text per row."""
    document = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    rows.select(canonical_json(document, form).alias("value")).write.text(path)
