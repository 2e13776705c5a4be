"""Evidence rows: source policy, fact selection, gates' inputs, packets."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from attestra import fixed_values as fixed
from attestra.functions import text
from attestra.functions.hashing import tree_digest

SUBJECT = ["subject_type", "subject_id"]


def source_violations(documents: DataFrame, policies: DataFrame) -> DataFrame:
    """Add ``violation``: the first source-policy rule a document or fact breaks.

    ``policies`` is a small dimension (source_id, canonical_uris, authority_scope).
    """
    policy = policies.select(
        "source_id", F.col("canonical_uris").alias("_uris"), F.col("authority_scope").alias("_scope"), F.lit(True).alias("_known")
    )
    rule = (
        F.when(F.col("_known").isNull(), "UNREGISTERED_SOURCE")
        .when(~F.coalesce(F.array_contains("_uris", F.col("canonical_uri")), F.lit(False)), "URI_MISMATCH")
        .when(~F.col("authority_scope").eqNullSafe(F.col("_scope")), "SOURCE_AUTHORITY_MISMATCH")
        .when(~F.col("fact_authority_scope").eqNullSafe(F.col("authority_scope")), "FACT_AUTHORITY_MISMATCH")
    )
    return documents.join(policy, "source_id", "left").withColumn("violation", rule).drop("_uris", "_scope", "_known")


def evidence_refs(facts: DataFrame, order: list[str]) -> Column:
    """Ordered reference structs of one request's facts (a request's facts are capped)."""
    listed = F.array_sort(F.collect_list(F.struct(*order, reference(facts).alias("ref"))))
    return F.transform(listed, lambda r: r["ref"])


def reference(facts: DataFrame) -> Column:
    """What a reference names of a fact."""
    fields = ("evidence_id", "fact_id", "source_id", "canonical_uri", "document_sha256", "authority_scope")
    return F.struct(*[F.col(name) for name in fields if name in facts.columns])


def frozen_flags(role: Column, attributes: Column, bindings: Mapping[str, Mapping[str, str]]) -> list[Column]:
    """Per bound fact, whether a row is that fact and carries every frozen value.

    A value is taken as an item, which Spark reads off a map made of columns
    without making the map.
    """
    flags = []
    for bound, values in bindings.items():
        matches = role == bound
        for name, value in values.items():
            matches = matches & attributes[name].eqNullSafe(value)
        flags.append(F.coalesce(matches, F.lit(False)).alias(f"frozen_{len(flags)}"))
    return flags


def required_tag_mask(tags: Column, required: Column) -> Column:
    """One bit per required tag that is present (required tags are distinct and few)."""
    bits = F.transform(
        required, lambda tag, i: F.when(F.array_contains(tags, tag), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    )
    return F.aggregate(bits, F.lit(0).cast("long"), lambda mask, bit: mask + bit)


def subject_evidence(facts: DataFrame, rules: DataFrame, frozen: list[Column], code: Column | None = None) -> DataFrame:
    """What the gates need to know per (subject, claim family), in three combinable levels.

    ``code`` is what a fact says about its outcome; the selected bound facts' least one is ``observed_code``.
    A fact is selected when it shares a required tag. Facts combine per asserted
    value, values per assertion key, keys per subject, each map-side before its
    shuffle and on fixed-width buffers, so neither a subject with a third of all
    facts nor its requests ever meet pair by pair.
    """
    allowed = rules.filter("refused_code IS NULL").select(
        "claim_family", "required_fact_tags", "allowed_scopes", F.size("required_fact_tags").alias("required_count")
    )
    names = [f"frozen_{i}" for i in range(len(frozen))]
    group = [*SUBJECT, "claim_family", "required_count"]
    # what a fact says is worked out once, before it is repeated per family
    said = facts.select(
        *SUBJECT, "claim_families", "tags", "authority_scope", "accessed_on", "assertion_key",
        F.coalesce("assertion_value", F.lit("null")).alias("assertion_value"), *frozen,
        (F.lit(None).cast("string") if code is None else code).alias("_code"),
    )
    rows = said.withColumn("claim_family", F.explode("claim_families")).drop("claim_families").join(allowed, "claim_family")
    rows = rows.withColumn("_mask", required_tag_mask(F.col("tags"), F.col("required_fact_tags")))
    chosen = F.col("_mask") != 0
    selected = lambda column: F.when(chosen, column)
    asserts = chosen & F.col("assertion_key").isNotNull()
    by_value = rows.groupBy(
        *group, F.when(asserts, F.col("assertion_key")).alias("_key"), F.when(asserts, F.col("assertion_value")).alias("_value")
    ).agg(
        F.count(F.lit(1)).alias("_candidates"), F.count_if(chosen).alias("_chosen"), F.bit_or("_mask").alias("_mask"),
        F.bool_and(selected(F.array_contains("allowed_scopes", F.col("authority_scope")))).alias("_authority"),
        F.min(selected(F.col("accessed_on"))).alias("_oldest"), F.min(selected(F.col("_code"))).alias("_code"), *[F.bool_or(chosen & F.col(n)).alias(n) for n in names],
    )
    merged = [
        F.sum("_candidates").alias("_candidates"), F.sum("_chosen").alias("_chosen"), F.bit_or("_mask").alias("_mask"),
        F.bool_and("_authority").alias("_authority"), F.min("_oldest").alias("_oldest"), F.min("_code").alias("_code"), *[F.bool_or(n).alias(n) for n in names],
    ]
    by_key = by_value.groupBy(*group, "_key").agg(*merged, (F.count("_value") <= 1).alias("_agreed"))
    by_subject = by_key.groupBy(*group).agg(*merged, F.bool_and("_agreed").alias("consistent"))
    return by_subject.select(
        *SUBJECT, "claim_family", F.col("_candidates").alias("candidate_fact_count"), F.col("_chosen").alias("selected_fact_count"),
        (F.bit_count("_mask") == F.col("required_count")).alias("complete"),
        F.coalesce("_authority", F.lit(False)).alias("authority_ok"), F.col("_oldest").alias("oldest_source"), F.col("_code").alias("observed_code"), "consistent", *names,
    )


def consistency(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Whether every assertion key of a group has a single value; NULL keys assert nothing."""
    per_key = facts.filter("assertion_key IS NOT NULL").groupBy(*keys, "assertion_key").agg(
        F.count_distinct(F.coalesce("assertion_value", F.lit("null"))).alias("_n")
    )
    return per_key.groupBy(*keys).agg(F.bool_and(F.col("_n") == 1).alias("consistent"))


def claim_gate(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """Refusal first, then the entity type; NULL code means the request goes on."""
    gated = requests.join(rules.select("claim_family", "refused_code", "permitted_subject_types"), "claim_family", "left")
    code = F.coalesce(
        F.when(F.col("permitted_subject_types").isNull(), F.lit("CLAIM_NOT_BOUNDED")),
        F.col("refused_code"),
        F.when(~F.array_contains("permitted_subject_types", F.col("subject_type")), F.lit("ENTITY_TYPE_MISMATCH")),
    )
    return gated.withColumn("gate_code", code).drop("refused_code", "permitted_subject_types")


def request_facts(requests: DataFrame, facts: DataFrame) -> DataFrame:
    """Each request with the facts of its subject and family; a request without any survives."""
    r, f = requests.alias("r"), facts.alias("f")
    same = (
        (F.col("r.subject_type") == F.col("f.subject_type")) & (F.col("r.subject_id") == F.col("f.subject_id"))
        & F.array_contains("f.claim_families", F.col("r.claim_family"))
    )
    kept = [F.col(f"f.{c}") for c in facts.columns if c not in (*SUBJECT, "claim_families")]
    return r.join(f, same, "left").select("r.*", *kept)


def asked_requests(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """Requests of families that are not refused, with their family's tags and scopes and the words of their question."""
    allowed = rules.filter("refused_code IS NULL").select("claim_family", "required_fact_tags", "allowed_scopes")
    return requests.join(allowed, "claim_family").withColumn("question_tokens", text.tokens(F.col("question")))


def fact_score(shared: Column, asked: Column | None = None) -> Column:
    """Weight of a fact for a request: tags that it shares with the rule count a hundred, words one.

    ``asked`` are the distinct words of the question, where they are known.
    """
    words = F.split(F.lower(F.concat_ws(" ", F.col("text"), F.array_join("tags", " "))), fixed.TOKEN_SEPARATOR)
    overlap = F.size(F.array_intersect(text.tokens(F.col("question")) if asked is None else asked, words))
    return (100 * shared + 20 + overlap).cast("long")


def scored_facts(pairs: DataFrame, rules: DataFrame) -> DataFrame:
    """Selected facts of each request with their weight."""
    required = rules.select("claim_family", "required_fact_tags")
    rows = pairs.filter("fact_id IS NOT NULL").join(required, "claim_family")
    shared = F.size(F.array_intersect("tags", "required_fact_tags"))
    return rows.filter(shared > 0).withColumn("score", fact_score(shared))


def ranked_facts(scored: DataFrame, request: str = "request_id", maximum: int = fixed.MAX_EVIDENCE_FACTS) -> DataFrame:
    """Rank within a request by weight, then id; ``over_limit`` marks requests of more than ``maximum`` facts.

    Every fact has its rank. Facts are numbered within their weight and the
    counts of greater weights are added, so a request's facts spread over its
    weights; numbering itself streams over sorted rows and holds none.
    """
    weights = scored.groupBy(request, "score").agg(F.count(F.lit(1)).alias("_n"))
    heavier = Window.partitionBy(request).orderBy(F.col("score").desc())
    placed = weights.select(
        F.col(request).alias("_request"), F.col("score").alias("_score"),
        (F.sum("_n").over(heavier) - F.col("_n")).alias("_before"),
        (F.sum("_n").over(Window.partitionBy(request)) > maximum).alias("over_limit"),
    )
    inside = Window.partitionBy(request, "score").orderBy("fact_id")
    numbered = scored.withColumn("_nth", F.row_number().over(inside))
    return numbered.join(placed, (F.col(request) == F.col("_request")) & (F.col("score") == F.col("_score"))).withColumn(
        "fact_rank", (F.col("_before") + F.col("_nth")).cast("int")).drop("_request", "_score", "_before", "_nth")


def tag_completeness(facts: DataFrame, keys: list[str], required: Column, allowed: Column) -> DataFrame:
    """Per group: are all required tags observed, and all selected facts' scopes allowed?"""
    hit = F.array_intersect("tags", required)
    chosen = F.size(hit) > 0
    grouped = facts.groupBy(*keys).agg(
        F.count_if(chosen).alias("selected_fact_count"),
        F.array_distinct(F.flatten(F.collect_set(F.when(chosen, hit)))).alias("_seen"),
        F.bool_and(F.when(chosen, F.array_contains(allowed, F.col("authority_scope")))).alias("_scopes"),
    )
    return grouped.select(
        *keys, "selected_fact_count", (F.size(F.array_except(required, F.col("_seen"))) == 0).alias("complete"),
        F.coalesce("_scopes", F.lit(False)).alias("authority_ok"),
    )


def freshness(facts: DataFrame, keys: list[str], minimum: str) -> DataFrame:
    """Every source date at or after the minimum; no minimum passes, no facts fail."""
    return facts.groupBy(*keys, minimum).agg(F.min("accessed_on").alias("oldest_source")).select(
        *keys, minimum, "oldest_source",
        (F.col(minimum).isNull() | F.coalesce(F.col("oldest_source") >= F.col(minimum), F.lit(False))).alias("fresh"),
    )


def packets(facts: DataFrame, keys: list[str], identifier: str, content: Column) -> DataFrame:
    """Digest of each subject's evidence packet, whatever its size."""
    hashed = facts.withColumn("_content", F.sha2(content.cast("binary"), 256))
    return tree_digest(hashed, keys, identifier, "_content", "packet_sha256")


def packet_match(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Do two arms hold the same packet for each key?"""
    renamed = right.select(*keys, F.col("packet_sha256").alias("_other"))
    return left.join(renamed, keys, "full_outer").select(
        *keys, "member_count", F.col("packet_sha256").eqNullSafe(F.col("_other")).alias("hash_match")
    )


def size_violations(rows: DataFrame, identifier: str, limits: Mapping[str, tuple[Column, int]]) -> DataFrame:
    """(id, cap, actual) for each exceeded size cap."""
    found = F.array_compact(F.array(*[
        F.when(size > maximum, F.struct(F.lit(name).alias("cap"), size.cast("long").alias("actual")))
        for name, (size, maximum) in limits.items()
    ]))
    return rows.select(identifier, F.inline(found))
