"""Policies and registries: small JSON dimensions with set checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from attestra import fixed_values as fixed
from attestra.schemas import CLAIM_RULE


def read_registry(spark: SparkSession, path: str, schema: str, *, multi_line: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def policy_rows(spark: SparkSession, rows: list, schema) -> DataFrame:
    """Policy rows fixed in code, marked for broadcast.

    Spark gives rows that come from Python no size, so a join with them would
    shuffle the other side by their few keys: one task per rule or platform.
    """
    return F.broadcast(spark.createDataFrame(rows, schema))


def claim_rules(spark: SparkSession) -> DataFrame:
    """The fixed claim-family rules as a dimension of twelve rows."""
    return policy_rows(spark, [list(row) for row in fixed.CLAIM_RULES], CLAIM_RULE)


def reason_registry(spark: SparkSession) -> DataFrame:
    """Reason codes with registry order, category and default status."""
    rows = [(i, code, category) for i, (code, category) in enumerate(fixed.REASON_CODES)]
    base = spark.createDataFrame(rows, "ord INT, code STRING, category STRING")
    status = F.when(F.col("category") == "AUTHORITY", "REFUSED").when(F.col("category") == "SYSTEM", "ERROR").otherwise("ABSTAINED")
    return base.withColumn("default_status", status)


def registry_violations(registry: DataFrame, key: str, expected: Sequence[str] | None = None) -> DataFrame:
    """Keys used twice and, given the exact set, keys missing or extra."""
    counts = registry.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("_n"))
    twice = counts.filter("_n > 1").select("key", F.lit("DUPLICATE").alias("violation"))
    if expected is None:
        return twice
    wanted = registry.sparkSession.createDataFrame([(k,) for k in expected], "key STRING")
    missing = wanted.join(counts, "key", "left_anti").select("key", F.lit("MISSING").alias("violation"))
    extra = counts.join(wanted, "key", "left_anti").select("key", F.lit("EXTRA").alias("violation"))
    return twice.unionByName(missing).unionByName(extra)
