"""Shared pieces of the streaming jobs: sources, repeatable batch writes, draining."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from attestra.session import derived_path


def read_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


#: Parts that the keys of a stored table are dealt into, so that a batch reads only its own.
PARTS = 64


def write_batch(rows: DataFrame, path: str, batch_id: int, key: str | None = None) -> None:
    """One folder per batch, overwritten when a batch is run again after a failure; with ``key``, a folder per part of the keys in it."""
    if key is None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        return
    dealt = rows.withColumn("part", _part(key)).repartition(PARTS, "part")
    dealt.write.mode("overwrite").partitionBy("part").parquet(f"{path}/batch={batch_id}")


def _part(key: str):
    return F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")


def drain(stream: DataFrame, each: Callable[[DataFrame, int], None], *, mode: str = "append", checkpoint: str | None = None) -> StreamingQuery:
    """Process everything available now, batch by batch, and wait for the end."""
    spark = stream.sparkSession
    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint or derived_path(spark, "stream-checkpoint"))
        .foreachBatch(each).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def stored(spark: SparkSession, path: str, schema: str, before: int | None = None, like: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """Rows of the batches written so far (earlier ones only, when asked).

    With ``like`` and ``key``, of a table written by that key, only the parts
    that the keys of ``like`` fall in are listed and read.
    """
    full = f"{schema}, batch BIGINT" + (", part INT" if like is not None else "")
    try:
        rows = spark.read.schema(full).option("basePath", path).parquet(path)
    except Exception as error:  # nothing written yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], full)
    if like is not None:
        rows = rows.filter(rows.part.isin([r["part"] for r in like.select(_part(key).alias("part")).distinct().collect()]))
    return rows if before is None else rows.filter(rows.batch < before)
