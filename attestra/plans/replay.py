"""Replay: sealed runs are computed again from their stored inputs and policies, and compared with their stored results."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from attestra.functions.hashing import sha256_text, tree_digest
from attestra.session import cut_lineage
from attestra.sources.assessments import stored_differences


def seal(inputs: DataFrame, policies: DataFrame, keys: Sequence[str], identifier: str, content: Column, policy: Column) -> DataFrame:
    """One row per run: the digests of its inputs (a tree, whatever their number) and of its policy."""
    keys = list(keys)
    rows = inputs.withColumn("_content", sha256_text(content))
    digests = tree_digest(rows, keys, identifier, "_content", "input_sha256").select(*keys, "input_sha256")
    return digests.join(policies.select(*keys, sha256_text(policy).alias("policy_sha256")), keys, "full_outer")


def replay(
    sealed: DataFrame, inputs: DataFrame, policies: DataFrame, stored: DataFrame, keys: Sequence[str], identifier: str, content: Column, policy: Column,
    compute: Callable[[DataFrame, DataFrame], DataFrame],
) -> DataFrame:
    """Per run: ``inputs_equal``, ``policy_equal``, ``result_equal`` and ``replay_status``.

    ``compute(inputs, policies)`` is the plan that made the results; it runs on
    what is stored now. Reals agree to 9 digits. A run that a side lacks is not
    equal there. The status names the first side that differs: altered inputs
    and policies explain a result that differs, so they come first.
    """
    keys = list(keys)
    now = seal(inputs, policies, keys, identifier, content, policy).select(*keys, F.col("input_sha256").alias("_input"), F.col("policy_sha256").alias("_policy"))
    again = stored_differences(cut_lineage(compute(inputs, policies)), stored, keys)
    agree = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    met = sealed.join(now, keys, "full_outer").join(again, keys, "full_outer").select(
        *keys, agree("input_sha256", "_input").alias("inputs_equal"), agree("policy_sha256", "_policy").alias("policy_equal"),
        F.coalesce("matches_stored", F.lit(False)).alias("result_equal"))
    status = F.when(~F.col("inputs_equal"), "INPUT_ALTERED").when(~F.col("policy_equal"), "POLICY_ALTERED").when(~F.col("result_equal"), "RESULT_DIFFERS").otherwise("REPLAYED")
    return met.withColumn("replay_status", status)
