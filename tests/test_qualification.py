from __future__ import annotations

import hashlib
import json
from collections import Counter
from datetime import date

import pytest
from pyspark.sql import functions as F

from attestra import fixed_values as fixed
from attestra.functions import hashing
from attestra.operators import evidence as ev
from attestra.plans import qualification
from attestra.sources import evidence as source, registries

FACTS = (
    "fact_id string, subject_type string, subject_id string, claim_families array<string>, tags array<string>, authority_scope string, "
    "accessed_on date, assertion_key string, assertion_value string, attributes map<string,string>, text string"
)
REQUESTS = "request_id string, subject_type string, subject_id string, claim_family string, question string, minimum_source_date date"
DAY = date(2026, 9, 5)
BINDINGS = {"V4.INTEGRITY": {"executable_commit": "c1"}, "V4.OBSERVATION": {"run_id": "r1"}}


def fact(id, subject, family, tags, scope, type_="ACCU_PROJECT", key=None, value=None, attributes=None, day=DAY):
    return (id, type_, subject, [family], tags, scope, day, key, value, attributes or {}, "text " + id)


def registry(subject, **extra):
    named = {"project_id": subject, "project_name": "Hills", "method_type": "Vegetation", "project_location": "NSW"}
    return [
        fact(f"{subject}.ID", subject, "REGISTRY_FACTS", ["registry", "project_identity"], "PUBLIC_REGISTRY_FACTS", attributes=named, **extra),
        fact(f"{subject}.TIME", subject, "REGISTRY_FACTS", ["registry", "timing"], "PUBLIC_REGISTRY_FACTS", attributes={}, **extra),
    ]


def observation(commit="c1"):
    family, subject = "OBSERVATIONAL_CONSISTENCY", "EOP101132"
    return [
        fact("V4.INTEGRITY", subject, family, ["frozen_observation"], "BOUNDED_OBSERVATION_ONLY", attributes={"executable_commit": commit}),
        fact("V4.OBSERVATION", subject, family, ["frozen_observation"], "BOUNDED_OBSERVATION_ONLY",
             attributes={"run_id": "r1", "pre_median_ndvi": "0.66", "post_median_ndvi": "0.64", "delta_ndvi": "-0.02", "primary_tau": "0.03",
                         "reason_code": fixed.BAND_CODE}),
        fact("REG", subject, family, ["registry"], "PUBLIC_REGISTRY_FACTS"),
    ]


def run(spark, facts, requests):
    rules = registries.claim_rules(spark)
    frame = spark.createDataFrame(facts, FACTS)
    asked = spark.createDataFrame(requests, REQUESTS)
    results = qualification.qualify(asked, qualification.gather(frame, rules, BINDINGS), rules)
    ranked = ev.ranked_facts(ev.scored_facts(ev.request_facts(asked, frame), rules))
    statements = {r.request_id: r.bounded_statement for r in qualification.statements(results, ranked).collect()}
    return {r.request_id: r for r in results.collect()}, statements


def ask(id, subject, family, type_="ACCU_PROJECT", minimum=None):
    return (id, type_, subject, family, "Restate the record.", minimum)


def test_outcomes_in_gate_order(spark):
    facts = registry("P1") + observation() + [
        fact("S", "F1", "SAFEGUARD_FACILITY_FACTS", ["safeguard", "facility_identity", "smc_issuance"], "PUBLIC_SAFEGUARD_FACTS", "SAFEGUARD_FACILITY",
             attributes={"reporting_period": "2024-25", "facility_name": "Arcadia", "baseline_emissions": "10", "covered_emissions": "8", "smcs_issued": "2"}),
        fact("U", "ACCU_SMC", "ACCU_SMC_SEMANTIC_BOUNDARY", ["accu_definition", "smc_definition", "unit_distinction"], "PUBLIC_UNIT_DEFINITION", "UNIT_CONCEPTS"),
        fact("X1", "P2", "REGISTRY_FACTS", ["registry", "project_identity"], "PUBLIC_REGISTRY_FACTS", key="method_type", value='"Vegetation"'),
        fact("X2", "P2", "REGISTRY_FACTS", ["registry"], "PUBLIC_REGISTRY_FACTS", key="method_type", value='"Waste"'),
        fact("Y", "P3", "REGISTRY_FACTS", ["registry", "project_identity"], "SYNTHETIC_TEST_ONLY"),
        fact("Z", "P4", "REGISTRY_FACTS", ["registry"], "PUBLIC_REGISTRY_FACTS"),
    ]
    requests = [
        ask("ok", "P1", "REGISTRY_FACTS"), ask("safe", "F1", "SAFEGUARD_FACILITY_FACTS", "SAFEGUARD_FACILITY"),
        ask("unit", "ACCU_SMC", "ACCU_SMC_SEMANTIC_BOUNDARY", "UNIT_CONCEPTS"), ask("obs", "EOP101132", "OBSERVATIONAL_CONSISTENCY"),
        ask("absent", "P9", "REGISTRY_FACTS"), ask("stale", "P1", "REGISTRY_FACTS", minimum=date(2026, 9, 6)),
        ask("type", "F1", "REGISTRY_FACTS", "SAFEGUARD_FACILITY"), ask("policy", "P1", "POLICY_APPLICABILITY"),
        ask("refused", "P1", "CARBON_QUANTITY"), ask("conflict", "P2", "REGISTRY_FACTS"), ask("scope", "P3", "REGISTRY_FACTS"),
        ask("partial", "P4", "REGISTRY_FACTS"),
    ]
    got, statements = run(spark, facts, requests)
    summary = {k: (r.workflow_status, r.qualification, ",".join(r.reason_codes)) for k, r in got.items()}
    assert summary == {
        "ok": ("QUALIFIED", "SUPPORTED", ""), "safe": ("QUALIFIED", "SUPPORTED", ""), "unit": ("QUALIFIED", "SUPPORTED", ""),
        "obs": ("ABSTAINED", "INCONCLUSIVE", fixed.BAND_CODE), "absent": ("ERROR", None, "REQUIRED_EVIDENCE_MISSING"),
        "stale": ("ERROR", None, "EVIDENCE_TEMPORAL_MISMATCH"), "type": ("ERROR", None, "ENTITY_TYPE_MISMATCH"),
        "policy": ("ERROR", None, "REQUIRED_EVIDENCE_MISSING"), "refused": ("REFUSED", None, "CARBON_QUANTITY_UNSUPPORTED"),
        "conflict": ("ERROR", None, "EVIDENCE_CONFLICT_UNRESOLVED"), "scope": ("ERROR", None, "EVIDENCE_SOURCE_NOT_ALLOWED"),
        "partial": ("ERROR", None, "REQUIRED_EVIDENCE_MISSING"),
    }
    assert got["refused"].assurance_checks.semantic_authority == "FAIL" and got["refused"].assurance_checks.source_authority == "NOT_RUN"
    assert got["ok"].assurance_checks.frozen_result_integrity == "NOT_RUN" and got["obs"].assurance_checks.frozen_result_integrity == "PASS"
    assert set(statements) == {"ok", "safe", "unit", "obs"}
    assert statements["ok"].startswith("The CER public record identifies P1 as Hills, a Vegetation project in NSW, with model start date not listed.")
    assert "POST-minus-PRE delta -0.02" in statements["obs"] and "Arcadia with baseline emissions 10" in statements["safe"]


def test_changed_frozen_hash(spark):
    got, _ = run(spark, observation(commit="other"), [ask("obs", "EOP101132", "OBSERVATIONAL_CONSISTENCY")])
    assert got["obs"].reason_codes == ["PROVENANCE_HASH_MISMATCH"] and got["obs"].assurance_checks.frozen_result_integrity == "FAIL"


def test_selected_facts_rank_by_tags_words_then_id(spark):
    rows = [
        fact("b", "P", "REGISTRY_FACTS", ["registry", "project_identity"], "PUBLIC_REGISTRY_FACTS"),
        fact("a", "P", "REGISTRY_FACTS", ["registry"], "PUBLIC_REGISTRY_FACTS"),
        fact("c", "P", "REGISTRY_FACTS", ["registry"], "PUBLIC_REGISTRY_FACTS"),
        fact("z", "P", "REGISTRY_FACTS", ["timing"], "PUBLIC_REGISTRY_FACTS"),
    ]
    asked = spark.createDataFrame([("r", "ACCU_PROJECT", "P", "REGISTRY_FACTS", "what about c text", None)], REQUESTS)
    scored = ev.scored_facts(ev.request_facts(asked, spark.createDataFrame(rows, FACTS)), registries.claim_rules(spark))
    assert [r.fact_id for r in ev.ranked_facts(scored).orderBy("fact_rank").collect()] == ["b", "c", "a"]
    over = ev.ranked_facts(scored, maximum=2).collect()
    assert sorted(r.fact_rank for r in over) == [1, 2, 3] and all(r.over_limit for r in over)


def test_canonical_json_golden(spark):
    text = '{"z": [3, {"é": "雪"}], "a": {"b": 2, "a": 1}}'
    row = spark.createDataFrame([(text,)], "t string").select(hashing.canonical_json(F.col("t"), "utf8").alias("c")).first()
    assert row.c == '{"a":{"a":1,"b":2},"z":[3,{"é":"雪"}]}'
    assert hashlib.sha256(row.c.encode()).hexdigest() == "cbf7bc415d0584a204e08a5013fcadd055013d48875c1872ba17b652573682ab"


@pytest.mark.parametrize("text, ok", [('{"a":1}', True), ('{"a":1,"a":2}', False), ('{"a":NaN}', False), ('{"a":Infinity}', False), ("{", False)])
def test_strict_json(spark, text, ok):
    assert spark.createDataFrame([(text,)], "t string").select(source.strict_json(F.col("t")).alias("s")).first().s is ok


def test_memory_snapshot_over_limit_has_no_hash(spark):
    rows = spark.range(5).select(F.lit("m").alias("k"), F.col("id").cast("string").alias("evidence_id"), F.lit("h").alias("document_sha256"))
    row = hashing.snapshot_sha256(rows, ["k"], limit=4).first()
    assert row.over_limit and len(row.memory_snapshot_sha256) == 64 and row.document_count == 5


def test_tree_digest_ignores_order_but_not_content(spark):
    rows = spark.range(1000).select(F.lit("k").alias("k"), "id", F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("d"))
    one = hashing.tree_digest(rows, ["k"], "id", "d").first()
    assert one == hashing.tree_digest(rows.repartition(9, "d"), ["k"], "id", "d").first() and one.member_count == 1000
    changed = rows.withColumn("d", F.when(F.col("id") == 7, "x").otherwise(F.col("d")))
    assert hashing.tree_digest(changed, ["k"], "id", "d").first().tree_sha256 != one.tree_sha256


def test_tree_digest_by_size_alone(spark):
    """Trees of several levels equal a plain computation; a key's digest does not depend on the other keys beside it."""
    def plain(rows, leaf_rows):
        counts = Counter(rows)
        depth = sum(len(counts) > leaf_rows * 16 ** k for k in range(12))
        sha = lambda texts: hashlib.sha256(",".join(sorted(texts)).encode()).hexdigest()
        nodes = {}
        for row, n in counts.items():
            nodes.setdefault(hashlib.sha256(row.encode()).hexdigest()[:depth], []).append(row if n == 1 else f"{row}*{n}")
        nodes = {at: sha(found) for at, found in nodes.items()}
        for length in range((depth - 1) // 2 * 2, 0, -2):
            above = {}
            for at, h in nodes.items():
                above.setdefault(at[:length], []).append(f"{at}:{h}")
            nodes = {at: sha(found) for at, found in above.items()}
        return sha(f"{at}:{h}" for at, h in nodes.items())

    sizes = {"large": 3000, "middle": 90, "small": 1, None: 40}
    rows = [(k, i, f"d{i}") for k, n in sizes.items() for i in range(n)] + [("middle", 5, "d5")] * 7
    frame = spark.createDataFrame(rows, "k string, id long, d string")
    got = {r.k: (r.tree_sha256, r.member_count) for r in hashing.tree_digest(frame, ["k"], "id", "d", leaf_rows=2).collect()}
    assert got == {k: (plain([f"{i}:{d}" for x, i, d in rows if x == k], 2), sum(x == k for x, _, _ in rows)) for k in sizes}
    alone = hashing.tree_digest(frame.filter("k = 'middle'"), ["k"], "id", "d", leaf_rows=2).first()
    assert (alone.tree_sha256, alone.member_count) == got["middle"]


def test_leaves_stay_small_at_any_size(spark):
    sizes = [1, 4096, 4097, 10**6, 10**9, 10**12]
    depths = [r.d for r in spark.createDataFrame([(n,) for n in sizes], "n long").select(hashing.leaf_depth(F.col("n")).alias("d")).collect()]
    assert depths == [0, 0, 1, 2, 5, 7] and all(n / 16 ** d <= hashing.LEAF_ROWS for n, d in zip(sizes, depths))


def test_snapshot_is_one_hash_over_sorted_entries(spark):
    rows = [(k, f"e{i:04d}", f"h{i % 7}") for k, n in (("a", 500), (None, 3), ("b", 1)) for i in range(n)]
    frame = spark.createDataFrame(rows, "k string, evidence_id string, document_sha256 string").repartition(5, "document_sha256")
    got = {r.k: (r.document_count, r.memory_snapshot_sha256) for r in hashing.snapshot_sha256(frame, ["k"]).collect()}
    text = lambda k: json.dumps([{"document_sha256": h, "evidence_id": e} for x, e, h in rows if x == k], separators=(",", ":"))
    assert got == {k: (sum(x == k for x, _, _ in rows), hashlib.sha256(text(k).encode()).hexdigest()) for k in ("a", None, "b")}
    plan = hashing.snapshot_sha256(frame, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan


def test_statement_is_what_its_cited_facts_say(spark):
    from attestra import fixed_values as fixed
    from attestra.plans import qualification

    family = "REGISTRY_FACTS"
    parameters = fixed.FAMILY_STATEMENTS[family][1]
    tags = sorted({tag for tag, _, _ in parameters.values() if tag})
    values = lambda mark: {attribute: f"{mark}{i}" for i, (tag, attribute, _) in enumerate(parameters.values()) if tag}
    facts = spark.createDataFrame([("f1", tags, values("a")), ("f2", tags, values("b"))], "fact_id string, tags array<string>, attributes map<string,string>")
    requests = spark.createDataFrame([(i, family, "S") for i in range(7)], "request_id long, claim_family string, subject_id string")
    ranked = facts.filter("fact_id = 'f1'").selectExpr("0L AS request_id", "1 AS fact_rank", "tags", "attributes")
    passed = requests.selectExpr("*", "'QUALIFIED' AS workflow_status")
    said = qualification.statements(passed, ranked).first().bounded_statement
    assert said is not None
    stored = spark.createDataFrame([
        (0, said, [("f1",)]), (1, said, [("f1",), ("f2",)]), (2, said, [("f2",), ("f1",)]), (3, said, []), (4, said, None), (5, said + " More.", [("f1",)]), (6, None, [("f1",)]),
    ], "request_id long, bounded_statement string, evidence_refs array<struct<fact_id:string>>")
    assert {r.request_id for r in qualification.unsupported_statements(stored, requests, facts).collect()} == {2, 3, 4, 5}
    unknown = stored.selectExpr("request_id", "bounded_statement", "array(named_struct('fact_id', 'gone')) AS evidence_refs")
    assert qualification.unsupported_statements(unknown, requests, facts).count() == 6


def test_frozen_values_are_read_without_making_the_map(spark):
    made = F.create_map(F.lit("commit"), F.concat(F.lit("c"), "id"), F.lit("run"), F.concat(F.lit("r"), "id")).alias("attributes")
    facts = spark.range(3).select(F.lit("INTEGRITY").alias("role"), made)
    flags = facts.select(*ev.frozen_flags(F.col("role"), F.col("attributes"), {"INTEGRITY": {"commit": "c1"}}))
    assert [r.frozen_0 for r in flags.collect()] == [False, True, False]
    assert "map(" not in flags._jdf.queryExecution().optimizedPlan().toString()


def test_records_from_one_aggregation_equal_those_from_ranked_facts(spark):
    facts = spark.createDataFrame(
        registry("P1") + observation() + registry("P2", key="method_type", value='"Waste"')
        + [fact("X1", "P2", "REGISTRY_FACTS", ["registry"], "PUBLIC_REGISTRY_FACTS", key="method_type", value='"Vegetation"'),
           fact("N", "P4", "REGISTRY_FACTS", ["registry", "project_identity"], "PUBLIC_REGISTRY_FACTS"), fact("T", "P5", "REGISTRY_FACTS", ["else"], "PUBLIC_REGISTRY_FACTS")],
        FACTS).selectExpr("*", "concat('E', subject_id, right(fact_id, 1)) AS evidence_id", "sha2(subject_id, 256) AS document_sha256")
    asked = spark.createDataFrame(
        [ask(f"R{i}", subject, "REGISTRY_FACTS") for i, subject in enumerate(("P1", "P2", "P4", "P5", "P6", "P1"))]
        + [ask("O", "EOP101132", "OBSERVATIONAL_CONSISTENCY"), ask("C", "P1", "CARBON_QUANTITY"), ask("U", "P1", "NO_FAMILY"), ask("M", "P1", "REGISTRY_FACTS", minimum=date(2027, 1, 1))], REQUESTS)
    rules = registries.claim_rules(spark)
    results = qualification.qualify(asked, qualification.gather(facts, rules, BINDINGS), rules)
    ranked = ev.ranked_facts(ev.scored_facts(ev.request_facts(asked, facts), rules))
    expected = qualification.result_records(results, ranked, ["a"], ["b"])
    pairs = ev.request_facts(ev.asked_requests(asked, rules), facts).filter("fact_id IS NOT NULL")
    made = qualification.request_records(asked, qualification.request_evidence(pairs, BINDINGS), rules, ["a"], ["b"])
    by_id = lambda frame: {r.request_id: r.asDict(True) for r in frame.collect()}
    got = by_id(made)
    assert got == by_id(expected) and len(got) == 10
    assert {k: r["workflow_status"] for k, r in got.items() if r["bounded_statement"]} == {"R0": "QUALIFIED", "R5": "QUALIFIED", "O": "ABSTAINED"}
    assert got["R2"]["reason_codes"] == ["REQUIRED_FIELD_MISSING"] and got["R1"]["reason_codes"] == ["EVIDENCE_CONFLICT_UNRESOLVED"]
    memory = facts.filter("subject_id = 'P1'").select("subject_id", "evidence_id", "document_sha256")
    assert got["R0"]["memory_snapshot_sha256"] == hashing.snapshot_sha256(memory, ["subject_id"]).first().memory_snapshot_sha256


def test_facts_meet_their_requests_once(spark):
    from workloads.evidence_queries import records
    from workloads.registry import Tables

    plan = records(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_extendedprice") > 0 and sum("Relation" in line and "l_orderkey" in line for line in plan.splitlines()) == 1
    assert "Window" not in plan and "MapInArrow" not in plan


def test_record_hash_is_that_of_python_json(spark):
    """Plain records are hashed from Spark's own JSON, in order of their names at every depth; others as Python prints them."""
    schema = "id string, b struct<z:string,a:long,m:boolean>, list array<struct<y:string,x:array<string>>>, words array<string>"
    refs = [{"y": "1", "x": ["p", None]}, None]
    texts = ["plain", 'quote " slash / back \\', "tab\tline\n", "bell\x07 del\x7f", "é 雪 🙂", "\\u0041", "", None]
    rows = [(t, {"z": t, "a": i, "m": i % 2 == 0} if i % 3 else None, refs if i % 2 else None, [t, None]) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, schema).repartition(2)
    said = lambda value: json.dumps(value, sort_keys=True, separators=(",", ":"))
    expected = {said(dict(zip(("id", "b", "list", "words"), row))) for row in rows}
    hashes = {hashlib.sha256(text.encode()).hexdigest() for text in expected}
    assert {r.h for r in hashing.with_record_sha256(frame, ["words", "id", "list", "b"], "h").collect()} == hashes
    real = spark.createDataFrame([(1.10, {"k": 1})], "d double, m map<string,int>")
    assert hashing.with_record_sha256(real, ["m", "d"], "h").first().h == hashlib.sha256(b'{"d":1.1,"m":{"k":1}}').hexdigest()
    # of plain records none goes to Python: the function is given nulls
    plan = hashing.with_record_sha256(frame, ["id", "words"], "h")._jdf.queryExecution().optimizedPlan().toString()
    assert "_ascii_json(CASE WHEN" in plan
