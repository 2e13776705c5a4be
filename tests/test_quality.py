from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from attestra import fixed_values as fixed
from attestra.functions import geo, uri
from attestra.operators import geometry, ledger, quality
from attestra.session import derived_path
from attestra.streaming import ledgers, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("rule, value, stable, project, url, expected", [
    ("EXACT", "/data/set", "set", None, "https://h.org/data/set", None),
    ("EXACT", "/data/set", "set", None, "https://h.org/data/other", "PATH_NOT_EXACT"),
    ("PROJECT_PATH", "/p/", "p", "EOP1", "https://h.org/p/EOP1", None),
    ("PROJECT_TOKEN", "/docs/", "", "EOP1", "https://h.org/docs/x_EOP1-cea.zip", None),
    ("PROJECT_TOKEN", "/docs/", "", "EOP1", "https://h.org/docs/EOP11.zip", "PROJECT_TOKEN_MISSING"),
    ("EXACT", "/a", "a", None, "https://u@h.org/a", "USERINFO"), ("EXACT", "/a", "a", None, "https://h.org:1/a", "PORT"),
    ("EXACT", "/a", "a", None, "https://h.org/a?X-Amz-Signature=1", "CREDENTIAL_QUERY"), ("EXACT", "/a", "a", None, "https://x.org/a", "HOST"),
])
def test_identity_rules(spark, rule, value, stable, project, url, expected):
    got = uri.identity_violation(
        F.lit(url), required_scheme="https", hosts=("h.org",), allowed_query=(), path_rule=rule, path_value=value, stable_identifier=stable,
        project_id=F.lit(project) if project else None,
    )
    assert one(spark, got) == expected


@pytest.mark.parametrize("name", ["sig", "token", "se", "sp", "sv"])
def test_signed_names(spark, name):
    assert one(spark, uri.credential_names(F.lit(f"https://h/a?{name}=1&b=2"))) == [name]


def test_redaction(spark):
    row = quality.redact_urls(spark.createDataFrame([("https://h/a?x=1#f", "https://h/a?x=1", "urn:a?b")], "a_uri string, note string, b_identity string")).first()
    assert tuple(row) == ("https://h/a", "https://h/a?x=1", "urn:a?b")


def assessment(status, disposition, codes, **states):
    checks = {c: "PASS" for c in fixed.QUALITY_CHECKS} | states
    return ("r", codes, status, disposition, tuple(checks[c] for c in fixed.QUALITY_CHECKS), True)


@pytest.mark.parametrize("row, rules", [
    (assessment("COMPLETED", "CORROBORATING", []), []),
    (assessment("ABSTAINED", "INCONCLUSIVE", ["VALID_OBSERVATION_COVERAGE_LOW"], observation_coverage="FAIL"), []),
    (assessment("ABSTAINED", "INCONCLUSIVE", [fixed.BAND_CODE]), []),
    (assessment("REFUSED", None, ["CAUSALITY_UNSUPPORTED"], authority_scope="FAIL"), []),
    (assessment("ERROR", None, [fixed.SYSTEM_CODE], system_execution="FAIL"), []),
    (assessment("ABSTAINED", "INCONCLUSIVE", [fixed.BAND_CODE], provenance="FAIL"), ["CHECK_STATE_NOT_ALLOWED"]),
    (assessment("ABSTAINED", "INCONCLUSIVE", ["HUMAN_REVIEW_REQUIRED"]), ["ABSTAINED_WITHOUT_INSUFFICIENCY"]),
    (assessment("ERROR", None, ["CAUSALITY_UNSUPPORTED", fixed.SYSTEM_CODE], authority_scope="FAIL", system_execution="FAIL"),
     ["INCOMPATIBLE_REASONS", "STATUS_NOT_ALLOWED"]),
])
def test_reason_semantics(spark, row, rules):
    checks = ", ".join(f"{c}: string" for c in fixed.QUALITY_CHECKS)
    schema = ("run_id string, reason_codes array<string>, execution_status string, evidence_disposition string, "
              f"quality_checks struct<{checks}>, human_review_required boolean")
    assert sorted(r.rule for r in quality.reason_violations(spark.createDataFrame([row], schema)).collect()) == sorted(rules)


def test_strict_mode_raises(spark):
    found = quality.duplicates(spark.createDataFrame([("a",), ("a",)], "k string"), ["k"])
    with pytest.raises(ValueError, match="two of them"):
        quality.require_none(found, "two of them")


def test_dangling_and_gaps(spark):
    stages = spark.createDataFrame([("r", 1, ["a"]), ("r", 3, ["a", "b"])], "run string, sequence int, refs array<string>")
    artifacts = spark.createDataFrame([("a",)], "artifact_id string")
    assert [r.reference for r in quality.dangling_references(stages, ["run"], "refs", artifacts, "artifact_id").collect()] == ["b"]
    assert [r.sequence for r in ledger.sequence_gaps(stages, "run", "sequence").collect()] == [3]


def test_polygon_with_hole_area_and_containment(spark):
    outer = [(0, 0, 0.0, 0.0), (0, 1, 0.0, 10.0), (0, 2, 10.0, 10.0), (0, 3, 10.0, 0.0), (0, 4, 0.0, 0.0)]
    hole = [(1, 0, 4.0, 4.0), (1, 1, 6.0, 4.0), (1, 2, 6.0, 6.0), (1, 3, 4.0, 6.0), (1, 4, 4.0, 4.0)]
    rows = spark.createDataFrame([(0, *v) for v in outer + hole], "polygon_id int, ring_id int, seq int, x double, y double")
    assert geometry.polygon_areas(geometry.ring_areas(rows)).first().area == 96.0
    points = spark.createDataFrame([(0, 1.0, 1.0), (1, 5.0, 5.0), (2, 11.0, 5.0), (3, 9.0, 9.5)], "point_id long, x double, y double")
    inside = geometry.contained(points, geometry.edges(rows), "polygon_id", 3.0)
    assert sorted(r.point_id for r in inside.collect()) == [0, 3]
    cells = geometry.lattice_points(3, 2, {"left": 0.0, "top": 20.0, "resolution": 10.0}, spark)
    assert [(r.x, r.y) for r in cells.orderBy("point_id").collect()][:4] == [(5.0, 15.0), (15.0, 15.0), (25.0, 15.0), (5.0, 5.0)]


def test_containment_in_polygons_of_any_extent(spark):
    import random

    rng = random.Random(7)
    shapes = {}
    for polygon, size in enumerate([0.5, 3.0, 40.0, 1000.0, 65536.0]):
        x, y = rng.uniform(-50, 50), rng.uniform(-50, 50)
        shape = [(x, y), (x + size, y), (x + size, y + size), (x + size / 2, y + size / 3), (x, y + size)]
        shapes[polygon] = shape + shape[:1]
    corners = [(p, i, float(x), float(y)) for p, shape in shapes.items() for i, (x, y) in enumerate(shape)]
    lines = geometry.edges(spark.createDataFrame(corners, "polygon_id int, seq int, x double, y double"), ["polygon_id"])
    places = [(i, rng.uniform(-60, 120), rng.uniform(-60, 120)) for i in range(300)]
    places += [(300 + i, rng.uniform(0, 70000), rng.uniform(0, 70000)) for i in range(100)] + [(400, *shapes[2][0]), (401, *shapes[2][2])]

    def inside(x, y, shape):
        odd = False
        for (x1, y1), (x2, y2) in zip(shape, shape[1:]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
        return odd

    points = spark.createDataFrame(places, "point_id long, x double, y double")
    made = sorted((r.point_id, r.polygon_id) for r in geometry.contained(points, lines, "polygon_id", 50.0).collect())
    assert made == sorted((i, p) for i, x, y in places for p, shape in shapes.items() if inside(x, y, shape))
    cells = geometry.cover(lines, "polygon_id", 50.0).groupBy("polygon_id", "border").count().collect()
    assert all(r["count"] <= 17 * 17 for r in cells) and any(not r.border for r in cells if r.polygon_id == 4)


def test_boundary_at_the_central_meridian(spark):
    p = one(spark, geo.utm54(F.lit(141.0), F.lit(-36.0)))
    assert p.x == pytest.approx(500000.0) and 6_010_000 < p.y < 6_020_000




def test_stream_append_no_op_collision_and_restart(spark):
    source = derived_path(spark, "in")
    spark.createDataFrame([("w", 1, "a"), ("w", 1, "a")], ledgers.APPEND_SCHEMA).coalesce(1).write.parquet(source)
    out, rejects, checkpoint = (derived_path(spark, n) for n in ("out", "rej", "chk"))
    run = lambda: ledgers.append_sequences(sinks.read_stream(spark, source, ledgers.APPEND_SCHEMA), out, rejects, checkpoint)
    run()
    spark.createDataFrame([("w", 1, "b"), ("w", 2, "c"), ("w", 1, "a")], ledgers.APPEND_SCHEMA).coalesce(1).write.mode("append").parquet(source)
    run()
    run()
    assert sorted((r.sequence, r.state) for r in sinks.stored(spark, out, ledgers.APPEND_SCHEMA).collect()) == [(1, "a"), (2, "c")]
    assert [(r.state, r.reason) for r in sinks.stored(spark, rejects, ledgers.REJECT_SCHEMA).collect()] == [("b", "COLLISION")]


def test_every_manifest_rule_is_broken_by_some_and_kept_by_others(spark):
    """The registered case reaches every rule that the plan can report."""
    import inspect
    import re

    from attestra.plans import manifest
    from workloads import load

    found = load()["manifest_violations"].run(spark, "/root/testdata/sf0.01").groupBy("rule").agg(F.count_distinct("run_id").alias("n")).collect()
    rules = set(re.findall(r'"([A-Z]+(?:_[A-Z]+)+)"', inspect.getsource(manifest))) - {
        "SOLAR_GEOMETRY_OUT_OF_RANGE", "SOLAR_GEOMETRY_METADATA_UNRESOLVED"}
    assert {r.rule for r in found} == rules and len(rules) > 25
    assert all(0 < r.n < 15000 for r in found)


def test_manifest_without_violations(spark):
    from attestra import fixed_values as fixed
    from attestra.plans import manifest

    steps = [(1, i + 1, s, "COMPLETED", "urn:x:p", "f", ["a"], ["b"], []) for i, s in enumerate(fixed.STAGES)]
    tables = [
        manifest.identities(spark.createDataFrame([(1, "p", "p", "p", "i", "i", "EXECUTION", ["spark"])],
                            "run_id long, approved_policy string, start_policy string, final_policy string, start_input string, final_input string, runtime_mode string, environment array<string>")),
        manifest.sources(spark.createDataFrame([(1, "S", "https://h/a", None)], "run_id long, source_id string, canonical_uri string, retrieval_uri string"), ["S"]),
        manifest.solar(spark.createDataFrame([(1, "PRE", "i", 70.0, True, None, "PASS")],
                       "run_id long, win string, item_id string, value double, admissible boolean, reason string, cross_check string")),
        manifest.transformations(spark.createDataFrame(steps, "run_id long, sequence int, transformation_id string, status string, parameter_ref string, "
                                 "parameter_sha256 string, inputs array<string>, outputs array<string>, reason_codes array<string>")),
        manifest.artifacts(spark.createDataFrame([(1, "a"), (1, "b")], "run_id long, artifact_id string")),
        manifest.terminals(spark.createDataFrame([(1, "COMPLETED", "b", [])], "run_id long, execution_status string, assessment_ref string, reason_codes array<string>")),
    ]
    assert manifest.violations(tables).collect() == []
    dangling = tables[:-1] + [manifest.terminals(spark.createDataFrame([(1, "COMPLETED", None, ["R"])], "run_id long, execution_status string, assessment_ref string, reason_codes array<string>"))]
    assert {(r.kind, r.rule) for r in manifest.violations(dangling).collect()} == {("terminal", "COMPLETED_WITH_REASONS"), ("terminal", "UNRESOLVED_REFERENCE")}


def test_replay_finds_altered_inputs_policies_and_results(spark):
    from workloads import load

    found = {r.run_id: r for r in load()["replay_runs"].run(spark, "/root/testdata/sf0.01").collect()}
    assert {r.replay_status for r in found.values()} == {"REPLAYED", "INPUT_ALTERED", "POLICY_ALTERED", "RESULT_DIFFERS"}
    for run, r in found.items():
        assert r.inputs_equal == (run % 7 != 0) and r.policy_equal == (run % 11 != 0)
        assert r.result_equal or run % 7 == 0 or run % 11 == 0 or run % 13 == 0


def test_every_row_without_a_usable_place_is_rejected(spark, tmp_path):
    """Equal rows from different sources are as many rejections; a collision counts once."""
    path, rejects, source = str(tmp_path / "kept"), str(tmp_path / "rejected"), str(tmp_path / "in")
    rows = [("-bad", 1, "x"), ("-bad", 1, "x"), ("w", 0, "x"), ("w", 0, "x"), ("w", 1, "a"), ("w", 1, "b"), ("w", 1, "b"), ("w", 1, "a")]
    spark.createDataFrame(rows, ledgers.APPEND_SCHEMA).coalesce(1).write.parquet(source)
    ledgers.append_sequences(sinks.read_stream(spark, source, ledgers.APPEND_SCHEMA), path, rejects, str(tmp_path / "checkpoint"))
    bad = sorted((r.workflow_id, r.sequence, r.reason) for r in sinks.stored(spark, rejects, ledgers.REJECT_SCHEMA).collect())
    assert bad == [("-bad", 1, "UNSAFE_KEY")] * 2 + [("w", 0, "UNSAFE_KEY")] * 2 + [("w", 1, "COLLISION")]
    assert [r.state for r in sinks.stored(spark, path, ledgers.APPEND_SCHEMA).collect()] == ["a"]


def test_a_delay_before_every_attempt(spark):
    rows = spark.createDataFrame([(n, i, "x") for n in (1, 2, 3, 6) for i in range(n)], "k int, ts int, outcome string")
    made = {r.k: r.delays for r in ledger.attempt_stats(rows, "k", ["ts"], "outcome").collect()}
    assert made == {1: "0", 2: "0,2", 3: "0,2,5", 6: "0,2,5,5,5,5"}


def test_equal_places_and_equal_polygons_are_tested_once(spark, monkeypatch):
    square = lambda k, d: [(k, d, d, d + 4, d), (k, d + 4, d, d + 4, d + 4), (k, d + 4, d + 4, d, d + 4), (k, d, d + 4, d, d)]
    edges = spark.createDataFrame([tuple(map(float, e[1:])) + (e[0],) for k, d in ((1, 0), (2, 0), (3, 0), (4, 3)) for e in square(k, d)],
                                  "x1 double, y1 double, x2 double, y2 double, polygon_id long")
    points = spark.createDataFrame([(7, 1.0, 1.0), (8, 1.0, 1.0), (9, 3.5, 3.5), (10, 9.0, 9.0)], "point_id long, x double, y double")
    covered, cover = [], geometry.cover
    monkeypatch.setattr(geometry, "cover", lambda found, key, *rest: covered.append(found.select(key).distinct().count()) or cover(found, key, *rest))
    pairs = {(r.point_id, r.polygon_id) for r in geometry.contained(points, edges, "polygon_id", 2.0).collect()}
    assert pairs == {(p, k) for p in (7, 8, 9) for k in (1, 2, 3)} | {(9, 4)}
    assert covered == [2]


def manifest_tables(spark, seed: int, runs: list):
    """Records of many forms for the given runs: odd addresses, null ids and references, repeated and far sequences."""
    import random

    from attestra import fixed_values as fixed
    from attestra.plans import manifest

    rng = random.Random(seed)
    pick = lambda *values: rng.choice(values)
    reference = lambda: pick("urn:x:p", "URN:x", "https://h.x", "https://h/a/b", "https://u@h/a", "https://h:1/a", "https://h/a?b=1", "https://h/a#f", "https://h/a?", "http://h", "", "x y", "https:", "https://h/é", None)
    address = lambda: pick("https://h/a", "HTTPS://h", "http://h/a", "https://", "https://u@/a", "https://h?sig=1&x=2", "https://h?Token=3", "https://h?", "https://h?&", "ftp://x", "", None)
    names = lambda: pick([], ["a"], ["a", "b"], ["b", "nope"], ["a", None], None)
    steps, artifacts, ended, sources = [], [], [], []
    for run in runs:
        order = list(enumerate(fixed.STAGES, 1))
        far = pick(0, 0, 60, 10 ** 6)
        for n, stage in order[:pick(12, 12, 11)] + pick([], [], [(3, "RESOLVE"), (None, "X")], [(70 + i, "FAR") for i in range(4)] * 2):
            steps.append((run, n and n + far, stage, pick("COMPLETED", "COMPLETED", "FAILED", None), reference(), pick("f", "", None), names(), names(), pick([], ["RESOURCE_LIMIT_EXCEEDED"], ["OTHER"], [None], None)))
        artifacts += [(run, a) for a in pick(["a", "b"], ["a", "a", "b"], ["b", None, None], [])]
        ended.append((run, pick("COMPLETED", "STOPPED", None), pick("a", "b", "c", None), pick([], ["R"], None)))
        sources += [(run, pick("S", "T", None), address(), address()) for _ in range(pick(0, 1, 3))]
    array = "array<string>"
    tables = {
        "steps": spark.createDataFrame(steps, f"run_id long, sequence int, transformation_id string, status string, parameter_ref string, parameter_sha256 string, inputs {array}, outputs {array}, reason_codes {array}"),
        "artifacts": spark.createDataFrame(artifacts, "run_id long, artifact_id string"),
        "ended": spark.createDataFrame(ended, f"run_id long, execution_status string, assessment_ref string, reason_codes {array}"),
        "sources": spark.createDataFrame(sources, "run_id long, source_id string, canonical_uri string, retrieval_uri string"),
    }
    tagged = [manifest.transformations(tables["steps"]), manifest.artifacts(tables["artifacts"]), manifest.terminals(tables["ended"]), manifest.sources(tables["sources"], ["S"])]
    return tagged, steps, artifacts, ended


def test_manifest_references_and_sequences_of_odd_runs(spark):
    """Null ids equal nothing, every record with a missing name is listed, and sequences count whatever their size."""
    from attestra.plans import manifest

    tagged, steps, artifacts, ended = manifest_tables(spark, 5, [*range(60), None])
    found = {(r.run_id, r.kind, r.record_id, r.rule) for r in manifest.violations(tagged).collect()}
    held = {(run, a) for run, a in artifacts if run is not None and a is not None}
    wanted = set()
    for run, n, stage, status, _, _, inputs, outputs, _ in steps:
        if inputs is not None and outputs is not None and any((run, r) not in held for r in inputs + outputs):
            wanted.add((run, "transformation", "|".join(str(x) for x in (n, stage) if x is not None), "UNRESOLVED_REFERENCE"))
    wanted |= {(run, "terminal", None if run is None else str(run), "UNRESOLVED_REFERENCE") for run, _, ref, _ in ended if (run, ref) not in held}
    assert {f for f in found if f[3] == "UNRESOLVED_REFERENCE"} == wanted
    assert {f[:3] for f in found if f[3] == "DUPLICATE_RECORD" and f[1] == "artifact"} == {(r, "artifact", a) for r, a in artifacts if artifacts.count((r, a)) > 1}
    for run in {s[0] for s in steps}:
        mine = [s[1] for s in steps if s[0] == run]
        contiguous = None not in mine and sorted(mine) == list(range(1, len(mine) + 1))
        assert ((run, "run", None if run is None else str(run), "SEQUENCE_NOT_CONTIGUOUS") in found) != contiguous


def test_manifest_references_are_combined_before_they_are_dealt(spark):
    """A run's records that name the same artifacts meet them once; what is listed is not every record's every reference."""
    import re

    from attestra.plans import manifest

    tagged, *_ = manifest_tables(spark, 1, list(range(20)))
    plan = manifest.violations(tagged)._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" not in plan and "BroadcastHashJoin" in plan
    assert not re.search(r"partial_count\(distinct", plan)


def test_uri_shortcuts_agree_with_the_parts(spark):
    """The plain forms that one match decides are decided as their parts are."""
    import random

    from attestra.functions import uri

    rng = random.Random(2)
    parts = ["https:", "urn:", "HTTPS:", "//", "/", "h.x", "u@", ":80", "?", "#", "a=1", "&", "sig=2", " ", "\n", "é", " ", "x"]
    texts = [None, ""] + ["".join(rng.choices(parts, k=rng.randint(1, 7))) for _ in range(3000)] + ["".join(rng.choice([[a], [a, b]][rng.randint(0, 1)])) for a in parts for b in parts]
    c = F.col("u")
    bare = (uri.query(c) == "") & (uri.fragment(c) == "")
    secure = (uri.scheme(c) == "urn") | ((uri.scheme(c) == "https") & ~uri.has_userinfo(c) & ~uri.has_port(c))
    names = F.transform(F.filter(F.split(uri.query(c), "&"), lambda p: F.length(p) > 0), lambda p: F.substring_index(p, "=", 1))
    frame = spark.createDataFrame([(t,) for t in texts], "u string").select(
        "u", uri.stable_reference(c).alias("s"), F.coalesce(~c.rlike(r"\s") & (F.length(c) > 0) & bare & secure, F.lit(False)).alias("s0"),
        uri.secure_address(c).alias("a"), ((uri.scheme(c) == "https") & (uri.host(c) != "")).alias("a0"), uri.query_names(c).alias("n"), names.alias("n0"))
    for r in frame.collect():
        assert (r.s, r.a, r.n) == (r.s0, r.a0, r.n0), r


def test_pairs_of_points_and_polygons_come_shape_by_shape(spark):
    """So the same polygons follow each other in the same order, which takes little room when written."""
    square = lambda low, high: [(low, low), (high, low), (high, high), (low, high), (low, low)]
    corners = [(p, seq, x, y) for p in range(40) for seq, (x, y) in enumerate(square(0.0, 10.0) if p % 2 else square(1.0, 12.0))]
    edges = geometry.edges(spark.createDataFrame(corners, "polygon_id long, seq long, x double, y double"), ["polygon_id"])
    places = [(i, 2.0 + i % 20 * 0.4, 2.0 + i // 20 * 0.7) for i in range(200)]
    made = geometry.contained(spark.createDataFrame(places, "point_id long, x double, y double"), edges, "polygon_id", 5.0).collect()
    assert sorted((r.point_id, r.polygon_id) for r in made) == [(i, p) for i in range(200) for p in range(40)]
    shapes = [r.polygon_id % 2 for r in made]
    assert sum(a != b for a, b in zip(shapes, shapes[1:])) <= 2 * geometry.SALTS
