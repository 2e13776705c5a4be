"""Ledgers fed by streams: sequence append, attempt totals, one-time consumption."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from attestra.functions.text import safe_identifier
from attestra.streaming.sinks import drain, stored, write_batch

APPEND_SCHEMA = "workflow_id STRING, sequence BIGINT, state STRING"
REJECT_SCHEMA = APPEND_SCHEMA + ", reason STRING"
TOTAL_SCHEMA = "request_identity STRING, attempt_count BIGINT, first_event_id BIGINT, last_event_id BIGINT"
CONSUMED_SCHEMA = "request_id STRING, consumed_at TIMESTAMP, run_id STRING"


def append_sequences(stream: DataFrame, path: str, rejects: str, checkpoint: str | None = None) -> None:
    """Idempotent append of (workflow, sequence, state).

    The same state again is a no-op; another state for a stored sequence, an
    unsafe id or a sequence below one is written to ``rejects``. Rows without a
    usable place name nothing, so equal ones are rejected one by one. Gaps are
    reported on the stored table by :func:`attestra.operators.ledger.sequence_gaps`.
    """
    key = ["workflow_id", "sequence"]

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        usable = safe_identifier(F.col("workflow_id")) & (F.col("sequence") >= 1)
        delivered = batch.select(*key, "state", F.coalesce(usable, F.lit(False)).alias("_usable"))
        rows = delivered.filter("_usable").distinct()
        known = stored(spark, path, APPEND_SCHEMA, before=batch_id, like=rows, key="workflow_id").select(*key, F.col("state").alias("_stored"))
        firsts = rows.groupBy(*key).agg(F.min("state").alias("_first"))
        judged = rows.join(known, key, "left").join(firsts, key, "left")
        reason = (
            F.when(F.col("_stored").isNotNull() & (F.col("_stored") != F.col("state")), "COLLISION")
            .when(F.col("_stored").isNull() & (F.col("_first") != F.col("state")), "COLLISION")
        )
        judged = judged.withColumn("reason", reason)
        write_batch(judged.filter("reason IS NULL AND _stored IS NULL").select(*key, "state"), path, batch_id, "workflow_id")
        unplaced = delivered.filter("NOT _usable").select(*key, "state", F.lit("UNSAFE_KEY").alias("reason"))
        collided = judged.filter("reason IS NOT NULL").select(*key, "state", "reason")
        write_batch(collided.unionByName(unplaced), rejects, batch_id, "workflow_id")

    drain(stream, each, checkpoint=checkpoint)


def attempt_totals(stream: DataFrame, path: str, checkpoint: str | None = None) -> None:
    """Running count, first and last attempt per request; each batch writes the changed requests."""
    moment = F.struct("ts", "event_id")
    totals = stream.groupBy("request_identity").agg(
        F.count(F.lit(1)).alias("attempt_count"), F.min_by("event_id", moment).alias("first_event_id"),
        F.max_by("event_id", moment).alias("last_event_id"),
    )
    drain(totals, lambda batch, batch_id: write_batch(batch, path, batch_id), mode="update", checkpoint=checkpoint)


def latest_totals(totals: DataFrame) -> DataFrame:
    """The last written total of each request."""
    values = [c for c in totals.columns if c not in ("request_identity", "batch")]
    return totals.groupBy("request_identity").agg(F.max_by(F.struct(*values), "batch").alias("_v")).select("request_identity", "_v.*")


def consume_once(stream: DataFrame, path: str, rejects: str, checkpoint: str | None = None) -> None:
    """The first consumption of a request wins; every later one is rejected, also an equal row delivered again.

    Equal rows of a batch are counted first: one can win, the rest are rejected,
    so the totals do not depend on how rows fall into batches. State is the
    stored table itself, so it needs no expiry and survives any restart; each
    batch reads the parts of it that hold its own request ids.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        columns = ["request_id", "consumed_at", "run_id"]
        rows = batch.groupBy(*columns).agg(F.count(F.lit(1)).cast("int").alias("_copies"))
        known = stored(batch.sparkSession, path, CONSUMED_SCHEMA, before=batch_id, like=rows, key="request_id").select("request_id", F.lit(True).alias("_known"))
        first = batch.groupBy("request_id").agg(F.min(F.struct("consumed_at", "run_id")).alias("_first"))
        judged = rows.join(first, "request_id").join(known, "request_id", "left")
        wins = F.col("_known").isNull() & F.struct("consumed_at", "run_id").eqNullSafe(F.col("_first"))
        write_batch(judged.filter(wins).select(*columns), path, batch_id, "request_id")
        beaten = judged.withColumn("_late", F.col("_copies") - wins.cast("int")).filter("_late > 0")
        late = beaten.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_late")))).select(*columns, F.lit("APPROVAL_ALREADY_CONSUMED").alias("reason"))
        write_batch(late, rejects, batch_id, "request_id")

    drain(stream, each, checkpoint=checkpoint)
