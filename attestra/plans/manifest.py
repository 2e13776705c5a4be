"""The structure of provenance manifests, as one check over the record tables of many runs.

Every kind of record is brought to one tagged form that carries the rules it
breaks by itself, what it refers to and what the rules of a whole run need. The
united table is written once; rules of one record, of records that repeat, of
references and of runs are aggregations and an equi-join over it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from attestra import fixed_values as fixed
from attestra.functions import uri
from attestra.session import cut_lineage

#: Kinds whose records must be told apart within a run.
DISTINCT_KINDS = ("source", "artifact", "solar")
#: Bits that mark the runs with missing names: 262,144 words at most, whatever the number of runs.
BITMAP = 1 << 24


def _names(rules: Mapping[str, Column]) -> Column:
    """The names of the rules that hold; where none does, as in most records, no array is gone through."""
    held = {name: F.coalesce(condition, F.lit(False)) for name, condition in rules.items()}
    none = F.array().cast("array<string>")
    return F.when(reduce(Column.__or__, held.values()), F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in held.items()]))).otherwise(none) if held else none


def _insecure(address: Column) -> Column:
    return address.isNotNull() & ~uri.secure_address(address)


def _tagged(frame: DataFrame, kind: str, record: Column, rules: Mapping[str, Column], **more: Column) -> DataFrame:
    broken = _names(rules)
    known = {"refs": F.array().cast("array<string>"), "status": F.lit(None).cast("string"), "sequence": F.lit(None).cast("int"),
             "in_order": F.lit(None).cast("boolean"), "is_primary": F.lit(None).cast("boolean")} | more
    return frame.select("run_id", F.lit(kind).alias("kind"), record.cast("string").alias("record_id"), broken.cast("array<string>").alias("broken"),
                        *[column.alias(name) for name, column in known.items()])


def identities(frame: DataFrame) -> DataFrame:
    """From run_id, approved_policy, start_policy, final_policy, start_input, final_input, runtime_mode, environment (array)."""
    same = F.col("approved_policy").eqNullSafe(F.col("start_policy")) & F.col("start_policy").eqNullSafe(F.col("final_policy"))
    fixture = F.exists("environment", lambda e: F.upper(e).contains("FIXTURE"))
    return _tagged(frame, "identity", F.col("run_id"), {
        "POLICY_HASHES_DIFFER": ~same,
        "INPUT_HASHES_DIFFER": ~F.col("start_input").eqNullSafe(F.col("final_input")),
        "FIXTURE_SOFTWARE": (F.col("runtime_mode") == "EXECUTION") & fixture,
    }, status=F.col("runtime_mode"))


def sources(frame: DataFrame, registered: Sequence[str]) -> DataFrame:
    """From run_id, source_id, canonical_uri, retrieval_uri."""
    canonical, secrets = F.col("canonical_uri"), F.size(uri.credential_names(F.col("canonical_uri")))
    return _tagged(frame, "source", F.col("source_id"), {
        "UNKNOWN_SOURCE": ~F.coalesce(F.col("source_id").isin(*registered), F.lit(False)),
        "SOURCE_URI_INSECURE": _insecure(canonical),
        "SOURCE_URI_CREDENTIALS": secrets > 0,
        "SOURCE_URI_QUERY": F.size(uri.query_names(canonical)) > secrets,
        "RETRIEVAL_URI_INSECURE": _insecure(F.col("retrieval_uri")),
    })


def radiometry(frame: DataFrame) -> DataFrame:
    """From run_id, item_id, asset_key, canonical_asset_identity, retrieval_uri, cross_check."""
    canonical = F.col("canonical_asset_identity")
    return _tagged(frame, "radiometry", F.concat_ws("|", "item_id", "asset_key"), {
        "ASSET_IDENTITY_UNSTABLE": _insecure(canonical) | (F.size(uri.query_names(canonical)) > 0),
        "RETRIEVAL_CREDENTIALS": F.size(uri.credential_names(F.col("retrieval_uri"))) > 0,
        "CROSS_CHECK_NOT_PASSED": ~F.col("cross_check").eqNullSafe("PASS"),
    })


def solar(frame: DataFrame) -> DataFrame:
    """From run_id, win, item_id, value, admissible, reason, cross_check."""
    value, admitted, reason = F.col("value"), F.coalesce("admissible", F.lit(False)), F.col("reason")
    beyond = value.isNull() | (value > fixed.SOLAR_ZENITH_MAX_DEGREES)
    return _tagged(frame, "solar", F.concat_ws("|", "win", "item_id"), {
        "ADMITTED_BEYOND_LIMIT": admitted & (beyond | reason.isNotNull() | ~F.col("cross_check").eqNullSafe("PASS")),
        "EXCLUDED_WITHOUT_REASON": ~admitted & ~F.coalesce(reason.isin("SOLAR_GEOMETRY_OUT_OF_RANGE", "SOLAR_GEOMETRY_METADATA_UNRESOLVED"), F.lit(False)),
        "OUT_OF_RANGE_WITHIN_LIMIT": (reason == "SOLAR_GEOMETRY_OUT_OF_RANGE") & (value.isNull() | (value <= fixed.SOLAR_ZENITH_MAX_DEGREES)),
    })


def qualifications(frame: DataFrame, policy_id: str) -> DataFrame:
    """From run_id, policy_id, tau (decimal text), is_primary."""
    frozen = F.col("policy_id").eqNullSafe(policy_id) & F.col("tau").try_cast("decimal(20,10)").eqNullSafe(F.lit(fixed.PRIMARY_TAU).cast("decimal(20,10)"))
    primary = F.coalesce("is_primary", F.lit(False))
    return _tagged(frame, "qualification", F.concat_ws("|", "policy_id", "tau"), {"PRIMARY_NOT_FROZEN": primary & ~frozen}, is_primary=primary)


def transformations(frame: DataFrame, stages: Sequence[str] = fixed.STAGES, reasons: Sequence[str] = tuple(code for code, *_ in fixed.REASON_CODES)) -> DataFrame:
    """From run_id, sequence, transformation_id, status, parameter_ref, parameter_sha256, inputs, outputs, reason_codes (arrays)."""
    done, codes = F.col("status") == "COMPLETED", F.coalesce("reason_codes", F.array().cast("array<string>"))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) == 0
    names = F.array(*[F.lit(s) for s in stages])
    return _tagged(frame, "transformation", F.concat_ws("|", "sequence", "transformation_id"), {
        "UNKNOWN_TRANSFORMATION": ~F.coalesce(F.col("transformation_id").isin(*stages), F.lit(False)),
        "UNKNOWN_REASON": F.when(F.size(codes) > 0, F.size(F.array_except(codes, F.array(*[F.lit(r) for r in reasons]))) > 0),
        "PARAMETER_REFERENCE_UNSTABLE": ~uri.stable_reference(F.col("parameter_ref")),
        "COMPLETED_WITHOUT_PARAMETERS": done & (blank("parameter_ref") | blank("parameter_sha256")),
        "COMPLETED_WITHOUT_LINEAGE": done & (none("inputs") | none("outputs")),
        "REASON_MISSING": ~done & (F.size(codes) == 0),
    }, refs=F.concat("inputs", "outputs"), status=F.col("status"), sequence=F.col("sequence").cast("int"),
        in_order=F.get(names, F.col("sequence").cast("int") - 1).eqNullSafe(F.col("transformation_id")))


def artifacts(frame: DataFrame) -> DataFrame:
    """From run_id, artifact_id."""
    return _tagged(frame, "artifact", F.col("artifact_id"), {})


def terminals(frame: DataFrame) -> DataFrame:
    """From run_id, execution_status, assessment_ref, reason_codes (array)."""
    reasons = F.coalesce(F.size("reason_codes"), F.lit(0)) > 0
    return _tagged(frame, "terminal", F.col("run_id"), {"COMPLETED_WITH_REASONS": (F.col("execution_status") == "COMPLETED") & reasons},
                   refs=F.array("assessment_ref"), status=F.col("execution_status"))


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), at)


def _named_artifacts(united: DataFrame) -> DataFrame:
    """``run_id, _ref, _made, _missing`` of names that several artifacts of a run have or that no artifact has though a record refers to it.

    References and artifacts are combined per run and name before they are
    dealt: the records of a run mostly name the same few artifacts.
    """
    made = F.col("kind") == "artifact"
    names = united.select("run_id", made.alias("_artifact"), F.explode(F.when(made, F.array("record_id")).otherwise(F.col("refs"))).alias("_ref"))
    # a null is equal to no other, though nulls are one group here
    known = F.col("_artifact") & F.col("run_id").isNotNull() & F.col("_ref").isNotNull()
    counted = names.groupBy("run_id", "_ref").agg(F.count_if("_artifact").alias("_made"), F.count_if(~F.col("_artifact")).alias("_used"), F.count_if(known).alias("_known"))
    return cut_lineage(counted.select("run_id", "_ref", "_made", ((F.col("_used") > 0) & (F.col("_known") == 0)).alias("_missing")).filter("_made > 1 OR _missing"))


def _unresolved(united: DataFrame, missing: DataFrame) -> DataFrame:
    """The records that refer to a name that is missing from their run.

    The runs of ``missing(run_id, _ref)`` are marked in a bitmap of bounded
    size, which is broadcast, so that records of other runs are mostly left out
    before the join; what the bitmap lets through is compared in full.
    """
    place = F.pmod(F.xxhash64("run_id"), F.lit(BITMAP))
    word, bit = F.shiftright(place, 6), _bit((place % 64).cast("int"))
    words = missing.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    records = united.filter(F.size("refs") > 0).withColumn("_at", word)
    marked = records.join(F.broadcast(words), F.col("_at") == F.col("_word")).filter(F.col("_bits").bitwiseAND(bit) != 0)
    used = marked.select("run_id", "kind", "record_id", F.explode("refs").alias("_ref"))
    wanted = missing.select(F.col("run_id").alias("_run"), F.col("_ref").alias("_name"))
    return used.join(wanted, F.col("run_id").eqNullSafe(F.col("_run")) & F.col("_ref").eqNullSafe(F.col("_name")), "left_semi").select("run_id", "kind", "record_id")


def _numbers(united: DataFrame) -> DataFrame:
    """The records and, of kind ``number``, each distinct sequence of a run that has no bit of its own."""
    far = united.filter((F.col("kind") == "transformation") & ~F.col("sequence").between(1, 64)).select("run_id", "sequence").distinct()
    needed = ["run_id", "kind", "status", "sequence", "in_order", "is_primary"]
    return united.select(*needed).unionByName(far.select("run_id", F.lit("number").alias("kind"), "sequence"), allowMissingColumns=True)


def violations(tables: Sequence[DataFrame], stages: int = len(fixed.STAGES)) -> DataFrame:
    """``run_id, kind, record_id, rule`` of every rule that a record, or a run as a whole (kind ``run``), breaks."""
    united = cut_lineage(reduce(DataFrame.unionByName, tables))
    rule = lambda name: F.lit(name).alias("rule")
    own = united.select("run_id", "kind", "record_id", F.explode("broken").alias("rule"))
    others = united.filter(F.col("kind").isin(*[k for k in DISTINCT_KINDS if k != "artifact"]))
    repeated = others.groupBy("run_id", "kind", "record_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("run_id", "kind", "record_id", rule("DUPLICATE_RECORD"))
    named = _named_artifacts(united)
    copied = named.filter("_made > 1").select("run_id", F.lit("artifact").alias("kind"), F.col("_ref").alias("record_id"), rule("DUPLICATE_RECORD"))
    unresolved = _unresolved(united, named.filter("_missing").select("run_id", "_ref")).select("run_id", "kind", "record_id", rule("UNRESOLVED_REFERENCE"))
    n = lambda kind, more=F.lit(True): F.count_if((F.col("kind") == kind) & more)
    step = F.when(F.col("kind") == "transformation", F.col("sequence"))
    near = F.when(step.between(1, 64), _bit(step - 1))
    runs = _numbers(united).groupBy("run_id").agg(
        n("source").alias("sources"), n("solar").alias("solar"), n("qualification").alias("judged"), n("qualification", F.col("is_primary")).alias("primaries"),
        n("transformation").alias("steps"), n("transformation", ~F.coalesce("in_order", F.lit(False))).alias("misplaced"),
        n("transformation", ~F.col("status").eqNullSafe("COMPLETED")).alias("unfinished"),
        (F.bit_count(F.coalesce(F.bit_or(near), F.lit(0).cast("long"))) + n("number")).alias("numbers"), F.min(step).alias("lowest"), F.max(step).alias("highest"),
        n("terminal", F.col("status") == "COMPLETED").alias("completed"), n("identity", F.col("status") == "EXECUTION").alias("executed"))
    c = F.col
    rules = {
        "QUALIFICATION_COUNT": (c("judged") > 0) & ((c("primaries") != 1) | (c("judged") != 4)),
        "SEQUENCE_NOT_CONTIGUOUS": (c("steps") > 0) & ((c("numbers") != c("steps")) | (c("lowest") != 1) | (c("highest") != c("steps"))),
        "ORDER_NOT_REGISTERED": (c("misplaced") > 0) | (c("steps") != stages),
        "COMPLETED_INCOMPLETE": (c("completed") > 0) & ((c("sources") == 0) | (c("unfinished") > 0)),
        "SOLAR_PROVENANCE_MISSING": (c("completed") > 0) & (c("executed") > 0) & (c("solar") == 0),
    }
    whole = runs.select("run_id", F.lit("run").alias("kind"), F.col("run_id").cast("string").alias("record_id"), F.explode(_names(rules)).alias("rule"))
    return reduce(DataFrame.unionByName, [own, repeated, copied, unresolved, whole]).distinct()
