"""Streaming family: each stream reads Parquet that Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from attestra.plans import qualification
from attestra.session import cut_lineage, derived_path
from attestra.sources import registries
from attestra.streaming import ledgers, qualification as stream_qualification, sinks
from workloads import domain
from workloads.evidence_queries import QUALIFY_SQL
from workloads.registry import Tables, query


def _staged(frame: DataFrame, name: str, files: int, by: str) -> str:
    path = derived_path(frame.sparkSession, name)
    frame.repartition(files, by).write.parquet(path)
    return path


@query("stream_append", """
SELECT CAST(conv_id AS VARCHAR) AS workflow_id, turn + 1 AS sequence,
       CASE WHEN conv_id % 7 = 0 THEN least(sha256(text), sha256(text || '!')) ELSE sha256(text) END AS state, 'STORED' AS outcome FROM conversations
UNION ALL SELECT CAST(conv_id AS VARCHAR), turn + 1, greatest(sha256(text), sha256(text || '!')), 'COLLISION' FROM conversations WHERE conv_id % 7 = 0
UNION ALL SELECT '-bad', turn + 1, sha256(text), 'UNSAFE_KEY' FROM conversations WHERE conv_id % 10 = 0""")
def stream_append(t: Tables) -> DataFrame:
    rows = t.conversations.select(
        F.col("conv_id").cast("string").alias("workflow_id"), (F.col("turn") + 1).alias("sequence"), F.sha2(F.col("text").cast("binary"), 256).alias("state")
    )
    unsafe = rows.filter(F.col("workflow_id").cast("long") % 10 == 0).withColumn("workflow_id", F.lit("-bad"))
    altered = t.conversations.filter("conv_id % 7 = 0").select(
        F.col("conv_id").cast("string").alias("workflow_id"), (F.col("turn") + 1).alias("sequence"),
        F.sha2(F.concat("text", F.lit("!")).cast("binary"), 256).alias("state"))
    # rivals for one place come in one batch; equal rows come in one batch and, for the rest, again in others
    rivals = rows.filter(F.col("workflow_id").cast("long") % 7 == 0).unionByName(altered)
    again = rows.filter(F.col("workflow_id").cast("long") % 7 != 0)
    source = _staged(rivals.unionByName(rivals).unionByName(again).unionByName(again).unionByName(unsafe), "checkpoints", 3, "workflow_id")
    again.write.mode("append").parquet(source)
    path, rejects = derived_path(t.spark, "appended"), derived_path(t.spark, "rejected")
    ledgers.append_sequences(sinks.read_stream(t.spark, source, ledgers.APPEND_SCHEMA, 1), path, rejects)
    kept = sinks.stored(t.spark, path, ledgers.APPEND_SCHEMA).withColumn("outcome", F.lit("STORED"))
    bad = sinks.stored(t.spark, rejects, ledgers.REJECT_SCHEMA).withColumnRenamed("reason", "outcome")
    return kept.unionByName(bad).select("workflow_id", "sequence", "state", "outcome")


@query("stream_ledger", """
SELECT CAST(user_id AS VARCHAR) AS request_identity, count(*) AS attempt_count, arg_min(event_id, (ts, event_id)) AS first_event_id,
       arg_max(event_id, (ts, event_id)) AS last_event_id FROM events GROUP BY user_id""")
def stream_ledger(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("user_id").cast("string").alias("request_identity"), "ts", "event_id")
    source = _staged(rows, "attempts", 3, "event_id")
    path = derived_path(t.spark, "totals")
    stream = sinks.read_stream(t.spark, source, "request_identity STRING, ts TIMESTAMP, event_id BIGINT", 1)
    ledgers.attempt_totals(stream, path)
    return ledgers.latest_totals(sinks.stored(t.spark, path, ledgers.TOTAL_SCHEMA))


@query("stream_consume_once", """
SELECT CAST(user_id AS VARCHAR) AS request_id, 1 AS accepted, count(*) + 2 * count(*) FILTER (event_id % 3 = 0) - 1 AS rejected FROM events GROUP BY user_id""")
def stream_consume_once(t: Tables) -> DataFrame:
    rows = t.events.select(
        F.col("user_id").cast("string").alias("request_id"), F.col("ts").alias("consumed_at"), F.col("event_id").cast("string").alias("run_id")
    )
    twice = rows.filter(F.col("run_id").cast("long") % 3 == 0)
    source = _staged(rows.unionByName(twice), "consumptions", 3, "run_id")  # an equal row in the same batch
    twice.write.mode("append").parquet(source)  # and again in another
    path, rejects = derived_path(t.spark, "consumed"), derived_path(t.spark, "late")
    ledgers.consume_once(sinks.read_stream(t.spark, source, ledgers.CONSUMED_SCHEMA, 1), path, rejects)
    accepted = sinks.stored(t.spark, path, ledgers.CONSUMED_SCHEMA).groupBy("request_id").agg(F.count(F.lit(1)).cast("int").alias("accepted"))
    late = sinks.stored(t.spark, rejects, ledgers.CONSUMED_SCHEMA + ", reason STRING").groupBy("request_id").agg(F.count(F.lit(1)).alias("rejected"))
    return accepted.join(late, "request_id", "left").select("request_id", "accepted", F.coalesce("rejected", F.lit(0)).alias("rejected"))


@query("stream_qualify", QUALIFY_SQL + """
SELECT request_id, CASE WHEN refused_code IS NOT NULL THEN 'REFUSED' WHEN failure <> '' OR claim_family = 'POLICY_APPLICABILITY' THEN 'ERROR'
            WHEN claim_family = 'OBSERVATIONAL_CONSISTENCY' THEN 'ABSTAINED' ELSE 'QUALIFIED' END AS workflow_status,
       CASE WHEN failure <> '' THEN failure WHEN claim_family = 'OBSERVATIONAL_CONSISTENCY' THEN observed
            WHEN claim_family = 'POLICY_APPLICABILITY' THEN 'DETERMINISTIC_PROCESSING_ERROR' ELSE '' END AS reasons FROM judged""", domain.QUALIFY_CTES)
def stream_qualify(t: Tables) -> DataFrame:
    rules = registries.claim_rules(t.spark)
    gathered = cut_lineage(qualification.gather(domain.facts(t), rules, domain.BINDINGS, role=F.col("role")))
    requests = domain.requests(t)
    source = _staged(requests, "requests", 3, "request_id")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in requests.schema)
    path = derived_path(t.spark, "results")
    stream_qualification.qualify_stream(sinks.read_stream(t.spark, source, schema, 1), gathered, rules, path)
    written = t.spark.read.schema("request_id BIGINT, workflow_status STRING, reason_codes ARRAY<STRING>").parquet(path)
    return written.select("request_id", "workflow_status", F.array_join("reason_codes", ",").alias("reasons"))
