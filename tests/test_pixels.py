from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestra.functions import decision, geo, hashing, quantiles
from attestra.functions.numeric import exact_difference
from attestra.operators import pixels as px
from attestra.plans import observation

SCHEMA = (
    "case_id string, win string, acquisition string, pixel_id long, component_order long, red_dn double, nir_dn double, scl int, "
    "source_valid boolean, red_scale double, red_offset double, red_nodata double, nir_scale double, nir_offset double, nir_nodata double"
)


def pixel(win="PRE", acquisition="a", pixel_id=0, order=1, red=2000.0, nir=5000.0, scl=4, valid=True, offset=-0.1):
    return ("c", win, acquisition, pixel_id, order, red, nir, scl, valid, 1e-4, offset, 0.0, 1e-4, offset, 0.0)


def ndvi_rows(spark, values):
    return spark.createDataFrame(values, "case_id string, win string, acquisition string, pixel_id long, component_order long, ndvi double")


def test_calibrated_index(spark):
    rows = [pixel(), pixel(scl=9), pixel(red=0.0), pixel(red=float("nan")), pixel(red=1000.0, nir=4000.0, offset=0.0), pixel(valid=False)]
    got = [r.ndvi for r in px.with_ndvi(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert got[0] == pytest.approx(0.6) and got[4] == pytest.approx(0.6)
    assert got[1] is got[2] is got[3] is got[5] is None
    assert got[0] != pytest.approx(3 / 7)


def test_out_of_range_is_reported_and_strict_mode_fails(spark):
    rows = px.with_ndvi(spark.createDataFrame([pixel(red=500.0, nir=5000.0)], SCHEMA))
    assert rows.first().out_of_range and rows.first().ndvi == 1.0
    with pytest.raises(Exception, match="outside"):
        px.require_in_range(rows).collect()


@pytest.mark.parametrize("flip", [False, True])
def test_mosaic_takes_first_valid_in_order(spark, flip):
    values = [("c", "PRE", "a", 0, 1, 0.1), ("c", "PRE", "a", 1, 1, None), ("c", "PRE", "a", 0, 2, 0.1), ("c", "PRE", "a", 1, 2, 0.2)]
    made = px.mosaic(ndvi_rows(spark, values[::-1] if flip else values))
    assert {r.pixel_id: r.ndvi for r in made.collect()} == {0: 0.1, 1: 0.2}
    assert px.mosaic_conflicts(made).count() == 0


def test_mosaic_conflict_is_reported(spark):
    made = px.mosaic(ndvi_rows(spark, [("c", "PRE", "a", 0, 1, 0.1), ("c", "PRE", "a", 0, 2, 0.11)]))
    assert px.mosaic_conflicts(made).count() == 1 and made.first().ndvi == 0.1


def series(pixels, pre=(0.1, 0.2, 0.3), post=(0.2, 0.3, 0.4)):
    return [
        ("c", win, f"{win}{i}", p, 1, v) for win, values in (("PRE", pre), ("POST", post)) for i, v in enumerate(values) for p in pixels
    ]


def aoi(spark, n=4):
    return spark.range(n).select(F.lit("c").alias("case_id"), F.col("id").alias("pixel_id"))


def test_windows_corroborating(spark):
    row = observation.qualify(observation.aggregate_cases(ndvi_rows(spark, series(range(4))), aoi(spark))).first()
    assert (row.pre_window_ndvi_median, row.post_window_ndvi_median) == (0.2, 0.3)
    assert row.delta_ndvi == 0.1 and row.aoi_valid_fraction == 1.0 and row.delta_count == 4
    assert row.evidence_disposition == "CORROBORATING" and row.reason_codes == []


def test_low_coverage_keeps_measurements_and_clears_the_verdict(spark):
    row = observation.qualify(observation.aggregate_cases(ndvi_rows(spark, series([0])), aoi(spark))).first()
    assert row.aoi_valid_fraction == 0.25 and row.delta_ndvi == 0.1
    assert row.execution_status == "ABSTAINED" and row.reason_codes == ["VALID_OBSERVATION_COVERAGE_LOW"]


def test_too_few_acquisitions_zero_the_result(spark):
    row = observation.aggregate_cases(ndvi_rows(spark, series(range(4), pre=(0.1, 0.2))), aoi(spark)).first()
    assert row.aoi_valid_pixels == 0 and row.delta_ndvi is None and not row.coverage_passed


@pytest.mark.parametrize("delta, disposition", [
    (0.031, "CORROBORATING"), (-0.031, "CONTRADICTORY"), (0.0, "INCONCLUSIVE"), (0.03, "INCONCLUSIVE"), (-0.03, "INCONCLUSIVE"),
])
def test_band_edges(spark, delta, disposition):
    row = spark.range(1).select(decision.classify(F.lit(delta), F.lit(0.03)).alias("v")).first().v
    assert row.evidence_disposition == disposition
    assert (row.execution_status == "ABSTAINED") == (disposition == "INCONCLUSIVE")


def test_sensitivities_do_not_change_primary(spark):
    rows = spark.range(1).select(F.explode(decision.classifications(F.lit(0.02))).alias("c")).select("c.*").collect()
    by_tau = {r.tau: r.verdict.evidence_disposition for r in rows}
    assert by_tau == {0.03: "INCONCLUSIVE", 0.01: "CORROBORATING", 0.02: "INCONCLUSIVE", 0.05: "INCONCLUSIVE"}
    assert [r.tau for r in rows if r.is_primary] == [0.03]


def test_decimal_anchor(spark):
    got = spark.range(1).select(exact_difference(F.lit(0.6432938994009436), F.lit(0.6630660903670323)).alias("d")).first().d
    assert got == -0.0197721909660887


@pytest.mark.parametrize("cells", [5, 16_384])
def test_quantiles_match_numpy(spark, cells):
    rng = np.random.default_rng(7)
    values = {"hot": np.round(rng.normal(size=30_000), 3), "small": rng.normal(size=41), "same": np.full(500, 0.25)}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("hot", None)]
    frame = spark.createDataFrame(rows, "k string, v double")
    probabilities = [0.05, 0.25, 0.5, 0.75, 0.95]
    names = ["a", "b", "c", "d", "e"]
    got = {r.k: r for r in quantiles.grouped_quantiles(frame, ["k"], "v", probabilities, names, cells=cells).collect()}
    near = {r.k: r for r in quantiles.grouped_quantiles(
        frame, ["k"], "v", [0.95], ["p"], nearest_rank=True, cells=cells).collect()}
    for k, vs in values.items():
        assert got[k].n == len(vs)
        np.testing.assert_allclose([got[k][n] for n in names], np.quantile(vs, probabilities), atol=1e-12)
        assert near[k].p == np.sort(vs)[int(np.ceil(0.95 * len(vs))) - 1]


def test_snapped_grid_and_congruence(spark):
    g = spark.range(1).select(geo.snapped_grid(*[F.lit(v) for v in (123.1, 9999876.1, 149.9, 9999899.1)]).alias("g")).first().g
    assert (g.left, g.bottom, g.right, g.top, g.width, g.height) == (120.0, 9999870.0, 150.0, 9999900.0, 3, 3)
    assert g.transform == [10.0, 0.0, 120.0, 0.0, -10.0, 9999900.0]
    ok = lambda x: spark.range(1).select(geo.congruent(F.lit(10.0), F.lit(-10.0), F.lit(x), F.lit(0.0)).alias("c")).first().c
    assert ok(738700.0) and not ok(738705.0)


def test_array_hash_equals_direct_hash(spark):
    cells = spark.createDataFrame([("a", 0, 0, 0.5), ("a", 1, 2, -0.25), ("a", 0, 1, None)], "k string, row int, col int, v double")
    got = hashing.array_hashes(cells, ["k"], "v", width=3, height=2).first().array_sha256
    grid = np.full((2, 3), np.nan)
    grid[0, 0], grid[1, 2] = 0.5, -0.25
    assert got == hashing.array_sha256(grid, "double")


def test_order_and_partitioning_do_not_matter(spark):
    rows = series(range(4)) + [("c", "PRE", "PRE0", 2, 5, 0.9)]
    one = observation.aggregate_cases(ndvi_rows(spark, rows), aoi(spark)).first()
    two = observation.aggregate_cases(ndvi_rows(spark, rows[::-1]).repartition(7), aoi(spark)).first()
    assert one == two


def test_rounds_follow_the_number_of_values(spark, monkeypatch):
    from attestra.functions import quantiles

    written = []
    plain = quantiles.materialise
    monkeypatch.setattr(quantiles, "materialise", lambda frame, name: written.append(name) or plain(frame, name))
    frame = spark.range(3000).selectExpr("id % 2 AS k", "cast(id AS double) * id AS v")
    rounds = {}
    for cells in (16, 4096):
        written.clear()
        got = {r.k: r.m for r in quantiles.grouped_quantiles(frame, ["k"], "v", [0.5], ["m"], cells=cells).collect()}
        assert got == {k: float(np.median([i * i for i in range(k, 3000, 2)])) for k in (0, 1)}
        rounds[cells] = written.count("quantile-places")
    assert rounds[4096] == 0 and rounds[16] >= 2
    spread = {r.k: r.mad for r in quantiles.distribution(frame, ["k"], "v", cells=16).collect()}
    for k in (0, 1):
        values = np.array([float(i * i) for i in range(k, 3000, 2)])
        assert spread[k] == float(np.median(np.abs(values - np.median(values))))
