"""Exact deduplication over a stream with keyed state that never expires."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from attestra.llm.common import free_name, materialise, whole_text
from attestra.session import derived_path

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "300",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # many small stores: without this each one reserves megabytes of disk for its logs
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # stores of an ended stream are unloaded by the next maintenance: their memory is soon there for what follows
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",
}
#: Documents of one text that meet one copy of its bytes in a task of the full check.
SALT_ROWS = 500


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def arrivals(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """What the stream sees of a document: doc_id, digest, and the locator ``n_bytes``, with the text left where it is."""
    text = whole_text(F.col("text"))
    return docs.select("doc_id", digest(text).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))


def keyed_state(stream: DataFrame, checkpoint: str) -> DataFrame:
    """Run the stream to its end and read its state: ``digest``, ``stable_id`` (the largest doc_id), ``n_rows``.

    The state is one row per digest on disk (RocksDB), saved to the shared
    folder after each batch and never removed; a restart with the same
    checkpoint goes on where the stream stopped. Copies in one batch are
    combined before they reach the state, so a hot text sends one row per task.
    """
    spark = stream.sparkSession
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        kept = stream.groupBy("digest").agg(F.max("doc_id").alias("stable_id"), F.count(F.lit(1)).alias("n_rows"))
        query = kept.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        state = spark.read.format("statestore").load(checkpoint)
        fields = state.schema["value"].dataType.fieldNames()
        return materialise(state.select(F.col("key.digest").alias("digest"), F.col("value")[fields[0]].alias("stable_id"),
                                        F.col("value")[fields[1]].alias("n_rows")), "state")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def decisions(docs: DataFrame, digest: Callable[[Column], Column] = sha256, bytes_per_batch: int = 64 << 20) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, digest, n_bytes.

    Equal texts are equal byte for byte; null counts as empty. The row with the
    largest doc_id stays, a null id being the smallest; of rows repeated with
    that same doc_id all are marked kept here (``keep_one`` leaves one). Every
    hit is checked on its full bytes against the document its state names: where
    a digest holds two texts, its documents are grouped by the text itself.
    """
    spark = docs.sparkSession
    path = derived_path(spark, "arrivals")
    arrivals(docs, digest).write.parquet(path)
    seen = spark.read.parquet(path)
    stream = spark.readStream.schema(seen.schema).option("maxBytesPerTrigger", bytes_per_batch).parquet(path)
    state = keyed_state(stream, derived_path(spark, "exact-state"))

    hits = state.filter("n_rows > 1").select(F.col("digest").alias("_d"), "stable_id", "n_rows")
    texts = docs.select("doc_id", whole_text(F.col("text")).alias("_text")).withColumn("_digest", digest(F.col("_text")))
    met = materialise(texts.join(hits, F.col("_digest") == F.col("_d")).select("doc_id", "_digest", "stable_id", "n_rows", "_text"), "hits")
    # the bytes the state points to, once per SALT_ROWS documents of a hot text
    lanes = F.ceil(F.col("n_rows") / SALT_ROWS).cast("int")
    named = met.filter(F.col("doc_id").eqNullSafe(F.col("stable_id"))).groupBy("_digest").agg(
        F.min("_text").alias("_held"), F.first("n_rows").alias("_rows"))
    held = named.select(F.col("_digest").alias("_d"), "_held", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_rows") / SALT_ROWS).cast("int") - 1)).alias("_lane"))
    salted = met.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), lanes).cast("int"))
    checked = salted.join(held, (F.col("_digest") == F.col("_d")) & (F.col("_salt") == F.col("_lane")))
    mixed = materialise(checked.filter("_text <> _held").select(F.col("_digest").alias("_m")).distinct(), "mixed")

    whole = seen.join(state.withColumnRenamed("digest", "_d"), F.col("digest") == F.col("_d")).join(mixed, F.col("digest") == F.col("_m"), "left_anti")
    plain = whole.select("doc_id", F.col("stable_id").alias("keep_id"), F.col("n_rows").alias("group_size"), "digest", "n_bytes")
    odd = met.join(mixed, F.col("_digest") == F.col("_m"), "left_semi")
    by_text = odd.groupBy("_digest", "_text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    split = odd.select("doc_id", "_digest", "_text").join(by_text, ["_digest", "_text"]).select(
        "doc_id", "keep_id", "group_size", F.col("_digest").alias("digest"), F.octet_length("_text").cast("long").alias("n_bytes"))
    return plain.unionByName(split).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def keep_one(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """The documents with one row of each text, all columns as they are; of rows repeated with the same doc_id any one stays."""
    keep_id, keep_digest, keep_text, nth = (free_name(docs, name) for name in ("__keep_id", "__keep_digest", "__keep_text", "__nth"))
    made = decisions(docs, digest).filter("kept").select(F.col("keep_id").alias(keep_id), F.col("digest").alias(keep_digest)).distinct()
    text = whole_text(docs["text"])
    met = docs.join(made, docs["doc_id"].eqNullSafe(made[keep_id]) & (digest(text) == made[keep_digest])).withColumn(keep_text, whole_text(docs["text"]))
    same = Window.partitionBy(keep_id, keep_digest).orderBy(keep_text)
    return met.withColumn(nth, F.row_number().over(same)).filter(F.col(nth) == 1).select(*[docs[c] for c in docs.columns])
