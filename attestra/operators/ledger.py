"""Append-only ledgers: attempts, sequences, states, timelines, replay, approvals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from attestra import fixed_values as fixed


def transport_class(failure: Column) -> Column:
    """Transport category of a failure named by its class or text, most specific first."""
    out = F.lit(fixed.TRANSPORT_OTHER)
    for name, category in reversed(fixed.TRANSPORT_CLASSES):
        out = F.when(failure.contains(name), category).otherwise(out)
    return F.when(failure.isNotNull(), out)


def retryable(http_code: Column) -> Column:
    """No HTTP code, or one that may pass on a later attempt."""
    return http_code.isNull() | http_code.isin(*fixed.RETRYABLE_HTTP_CODES)


def attempt_stats(attempts: DataFrame, key: str, order: Sequence[str], outcome: str) -> DataFrame:
    """Attempts, first and terminal outcome, and the delays before the attempts, per request.

    ``delays`` lists the delay before every attempt, joined by commas; attempts
    beyond the schedule each wait its last delay. The list follows from the
    count alone, so no attempts are gathered for it. ``last_delay`` came before
    the last attempt and ``waited_seconds`` is the sum of all. ``over_limit``
    marks requests with more attempts than allowed.
    """
    schedule = list(fixed.RETRY_DELAYS_SECONDS)
    moment = F.struct(*order)
    made = attempts.groupBy(key).agg(
        F.count(F.lit(1)).alias("attempt_count"), F.min_by(outcome, moment).alias("first_outcome"),
        F.max_by(outcome, moment).alias("terminal_outcome"),
    )
    within = F.least(F.col("attempt_count"), F.lit(len(schedule))).cast("int")
    waited = F.slice(F.array(*[F.lit(d) for d in schedule]), F.lit(1), within)
    total = F.aggregate("scheduled_delays", F.lit(0).cast("long"), lambda x, d: x + d) + (F.col("attempt_count") - within) * schedule[-1]
    beyond = F.repeat(F.lit(f",{schedule[-1]}"), (F.col("attempt_count") - within).cast("int"))
    return made.withColumn("scheduled_delays", waited).select(
        "*", F.concat(F.array_join("scheduled_delays", ","), beyond).alias("delays"),
        F.element_at("scheduled_delays", -1).alias("last_delay"), total.alias("waited_seconds"),
        (F.col("attempt_count") > fixed.NETWORK_MAX_ATTEMPTS).alias("over_limit"),
    ).drop("scheduled_delays")


def first_last(events: DataFrame, key: str, order: Sequence[str], identifier: str) -> DataFrame:
    moment = F.struct(*order)
    return events.groupBy(key).agg(
        F.min_by(identifier, moment).alias("first_event_id"), F.max_by(identifier, moment).alias("last_event_id")
    )


def latest_state(checkpoints: DataFrame, key: str, sequence: str, state: str) -> DataFrame:
    return checkpoints.groupBy(key).agg(
        F.max(sequence).alias("latest_sequence"), F.max_by(state, sequence).alias("latest_state")
    )


def sequence_summary(rows: DataFrame, key: str, sequence: str) -> DataFrame:
    """Is each key's sequence exactly 1..n?"""
    return rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("row_count"), F.min(sequence).alias("first_sequence"), F.max(sequence).alias("last_sequence"),
        F.count_distinct(sequence).alias("distinct_sequences"),
    ).withColumn(
        "contiguous",
        (F.col("first_sequence") == 1) & (F.col("last_sequence") == F.col("row_count")) & (F.col("distinct_sequences") == F.col("row_count")),
    )


def sequence_gaps(rows: DataFrame, key: str, sequence: str) -> DataFrame:
    """Sequence numbers whose predecessor is missing (joined on key and number, so evenly spread)."""
    present = rows.select(key, F.col(sequence).alias("sequence")).distinct()
    before = present.select(key, (F.col("sequence") + 1).alias("sequence"))
    return present.filter("sequence > 1").join(before, [key, "sequence"], "left_anti")


def stage_timeline(runs: DataFrame, run: str, completed_through: str, reasons: str) -> DataFrame:
    """Twelve stage rows per run: completed, failed next, skipped after, last one always completed."""
    stages = F.array(*[
        F.struct(F.lit(i + 1).alias("sequence"), F.lit(stage).alias("transformation_id")) for i, stage in enumerate(fixed.STAGES)
    ])
    rows = runs.select(run, completed_through, reasons, F.inline(stages))
    done = (F.col("sequence") <= F.col(completed_through)) | (F.col("sequence") == fixed.LAST_STAGE)
    status = F.when(done, "COMPLETED").when(F.col("sequence") == F.col(completed_through) + 1, "FAILED").otherwise("SKIPPED")
    return rows.select(
        run, "sequence", "transformation_id", status.alias("status"),
        F.when(done, F.array().cast("array<string>")).otherwise(F.col(reasons)).alias("reason_codes"),
    )


def replay_differences(live: DataFrame, replayed: DataFrame, keys: Sequence[str], digest: str) -> DataFrame:
    """Every artifact of either side and whether both sides agree on its digest."""
    right = replayed.select(*keys, F.col(digest).alias("_replayed"))
    return live.select(*keys, F.col(digest).alias("_live")).join(right, list(keys), "full_outer").select(
        *keys, F.col("_live").eqNullSafe(F.col("_replayed")).alias("equal")
    )


def run_identity_violations(runs: DataFrame) -> DataFrame:
    """Per run row, the first identity rule broken: boundary, policy or input changed."""
    rule = (
        F.when(F.col("boundary_role") != "CEA", "BOUNDARY_NOT_FROZEN")
        .when(F.col("boundary_sha256") != F.col("approved_boundary_sha256"), "BOUNDARY_HASH_MISMATCH")
        .when((F.col("approved_policy_sha256") != F.col("start_policy_sha256")) | (F.col("start_policy_sha256") != F.col("final_policy_sha256")),
              "POLICY_MUTATED")
        .when(F.col("start_input_sha256") != F.col("final_input_sha256"), "INPUT_MUTATED")
    )
    return runs.withColumn("violation", rule)


def reused_run_ids(runs: DataFrame, run: str = "run_id", policy: str = "approved_policy_sha256") -> DataFrame:
    """Run ids used with more than one policy: a new policy needs a new run id."""
    return runs.groupBy(run).agg(F.count_distinct(policy).alias("policy_count")).filter("policy_count > 1")


def ledger_audit(requests: DataFrame, evidence: DataFrame, attempts: DataFrame, consumptions: DataFrame) -> DataFrame:
    """One row per approval request with the first broken rule, in audit order.

    Each side is combined per request before the joins, so no request's rows
    meet pair by pair.
    """
    seen = evidence.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("_evidence"), F.min("created_at").alias("_created"), F.max("created_at").alias("_last_created"),
        F.max(F.col("updated_at") != F.col("created_at")).alias("_edited"), F.min("binds_request").alias("_bound"),
        F.min("binds_run").alias("_run"),
    )
    tried = attempts.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("_attempts"), F.max(F.col("method") != "GET").alias("_wrote")
    )
    used = consumptions.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("consumption_count"), F.min("consumed_at").alias("_consumed"), F.max("consumed_at").alias("_last_consumed")
    )
    joined = requests.join(seen, "request_id", "left").join(tried, "request_id", "left").join(used, "request_id", "left")
    attempts_made = F.coalesce("_attempts", F.lit(0))
    rule = (
        F.when(F.col("_evidence").isNull(), "APPROVAL_EVIDENCE_UNAVAILABLE")
        .when((attempts_made == 0) | F.col("_wrote") | (attempts_made != F.coalesce(F.col("declared_attempts"), attempts_made)),
              "APPROVAL_EVIDENCE_NOT_INDEPENDENT")
        .when(~F.col("_bound") | F.col("_edited"), "APPROVAL_BINDING_INVALID")
        .when(~F.col("_run"), "APPROVAL_RUN_ID_MISMATCH")
        .when((F.col("_created") < F.col("created_at")) | (F.col("_last_created") > F.col("expires_at")), "APPROVAL_EXPIRED")
        .when(F.coalesce("consumption_count", F.lit(0)) > 1, "APPROVAL_ALREADY_CONSUMED")
        .when(F.col("_consumed") <= F.col("_last_created"), "APPROVAL_BINDING_INVALID")
        .when(F.col("_last_consumed") > F.col("expires_at"), "APPROVAL_EXPIRED")
    )
    return joined.select(
        "request_id", F.coalesce("consumption_count", F.lit(0)).alias("consumption_count"), rule.alias("violation")
    )
