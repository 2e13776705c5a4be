"""Provenance of runs: record tables united, counted and digested per run and kind."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from attestra.functions.hashing import tree_digest


def records(frame: DataFrame, kind: str, run: Column, identifier: Column, content: Column) -> DataFrame:
    """A record table in common form: run, kind, id, content digest."""
    return frame.select(
        run.alias("run_id"), F.lit(kind).alias("record_kind"), identifier.cast("string").alias("record_id"),
        F.sha2(content.cast("binary"), 256).alias("content_sha256"),
    )


def manifest_rollup(tables: list[DataFrame]) -> DataFrame:
    """Member count and digest per (run, kind). The records stay tables; nothing is nested whole."""
    united = reduce(DataFrame.unionByName, tables)
    return tree_digest(united, ["run_id", "record_kind"], "record_id", "content_sha256", "records_sha256")
