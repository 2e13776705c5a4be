from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row, functions as F

from attestra.operators import scenes as sc
from attestra.plans import scene_selection
from attestra.schemas import SCENE
from attestra.sources import scenes as source

BAND = dict(scale=1e-4, offset=-0.1, quantification_value=10000.0, nodata=0.0, metadata_source="XML", cross_check="PASS")
ASSETS = {k: f"asset-{k}" for k in ("B04", "B08", "SCL", "product-metadata", "granule-metadata")}
DAY = datetime(2017, 1, 1)


def item(id, datatake="D1", tile="54HYE", baseline="05.11", processed=None, zenith=40.0, when=DAY, assets=ASSETS, win="PRE"):
    return Row(win=win, id=id, collection="sentinel-2-l2a", platform="S2A", datatake_id=datatake, datetime=when, mgrs_tile=tile,
               processing_baseline=baseline, processing_datetime=processed, mean_solar_zenith_angle=zenith, assets=assets,
               radiometry={"B04": BAND, "B08": BAND})


def frame(spark, items):
    return spark.createDataFrame([tuple(i) for i in items], SCENE)


def evaluate(spark, items, **limits):
    return scene_selection.evaluate_windows(frame(spark, items), **limits).first()


def test_two_tiles_per_datatake(spark):
    row = evaluate(spark, [item(f"{d}-{t}", f"D{d}", t) for d in range(22) for t in ("54HYE", "55HBV")])
    assert row.independent_acquisition_group_count == 22 and row.raster_access_permitted
    groups = sc.acquisition_groups(sc.canonical_components(frame(spark, [item("a", tile="55HBV"), item("b", tile="54HYE")])))
    assert groups.first().mgrs_tiles == ["54HYE", "55HBV"]


@pytest.mark.parametrize("groups, status", [(40, "READY_FOR_RASTER_LIMITED_PROCESSING"), (41, "READY_FOR_RASTER_LIMITED_PROCESSING"), (44, "READY_FOR_RASTER_LIMITED_PROCESSING")])
def test_group_limit(spark, groups, status):
    row = evaluate(spark, [item(f"i{d}", f"D{d}") for d in range(groups)])
    assert row.status == status and row.metadata_admissible_acquisition_group_count == groups
    assert row.reason_codes == [] and row.limit_codes == ([] if groups == 40 else ["RESOURCE_LIMIT_EXCEEDED"])


def test_raw_limit_keeps_everything(spark):
    row = evaluate(spark, [item(f"i{d}", f"D{d % 30}", f"T{d}") for d in range(201)])
    assert row.raw_item_count == 201 and row.metadata_admissible_acquisition_group_count == 30
    assert row.limit_codes == ["METADATA_INVENTORY_LIMIT_EXCEEDED", "RESOURCE_LIMIT_EXCEEDED"]
    assert evaluate(spark, [item(f"i{d}", f"D{d % 30}", f"T{d}") for d in range(200)]).raster_access_permitted


def test_canonical_choice(spark):
    items = [item("old", baseline="02.12"), item("new", baseline="05.11"), item("nine", baseline="05.9")]
    for rows in (items, items[::-1]):
        made = sc.canonical_components(frame(spark, rows)).first()
        assert made.selected_item_id == "new" and made.candidate_count == 3
    status = {r.id: (r.representation_status, r.exclusion_reasons) for r in
              sc.representation_status(frame(spark, items), sc.canonical_components(frame(spark, items))).collect()}
    assert status["old"] == ("EXCLUDED_PROCESSING_REPRESENTATION", ["SUPERSEDED_PROCESSING_REPRESENTATION"])


def test_missing_processing_time_loses_and_id_breaks_ties(spark):
    items = [item("a"), item("c", processed=DAY), item("b", processed=DAY)]
    assert sc.canonical_components(frame(spark, items)).first().selected_item_id == "b"


def test_ambiguous_assets(spark):
    made = sc.canonical_components(frame(spark, [item("a"), item("b", assets={**ASSETS, "B04": "other"})]))
    record = sc.representation_records(made).first()
    assert record.status == "AMBIGUOUS" and record.reason_codes == ["ACQUISITION_REPRESENTATION_AMBIGUOUS"]


def test_identity_rules(spark):
    bad = frame(spark, [item("a", datatake=None), item("b", baseline="5.x")])
    got = {r.id: r.v for r in bad.select("id", sc.identity_violation("sentinel-2-l2a").alias("v")).collect()}
    assert got == {"a": "ACQUISITION_IDENTITY_UNRESOLVED", "b": "PROCESSING_BASELINE_UNRESOLVED"}
    times = frame(spark, [item("a"), item("b", tile="55HBV", when=DAY + timedelta(hours=1))])
    assert [r.kind for r in sc.identity_conflicts(times).collect()] == ["ACQUISITION"]


def test_one_bad_zenith(spark):
    items = [item("a"), item("b", datatake="D2", zenith=71.0)]
    assert evaluate(spark, items).metadata_admissible_acquisition_group_count == 1
    groups = sc.acquisition_groups(sc.canonical_components(frame(spark, items)))
    assert groups.filter("NOT metadata_admissible").first().exclusion_reasons == ["SOLAR_GEOMETRY_OUT_OF_RANGE"]


@pytest.mark.parametrize("token, check, reason", [
    ("69.999", "PASS", None), ("70.0", "PASS", None), ("70.001", "PASS", "SOLAR_GEOMETRY_OUT_OF_RANGE"),
    (None, "MISSING", "SOLAR_GEOMETRY_METADATA_UNRESOLVED"), ("NaN", "UNPARSEABLE", "SOLAR_GEOMETRY_METADATA_UNRESOLVED"),
    ("Infinity", "UNPARSEABLE", "SOLAR_GEOMETRY_METADATA_UNRESOLVED"), ('"69.0"', "UNPARSEABLE", "SOLAR_GEOMETRY_METADATA_UNRESOLVED"),
])
def test_solar_gate(spark, token, check, reason):
    row = spark.createDataFrame([(token,)], "t string").select(sc.solar_geometry(F.col("t"), F.lit("S"), F.lit("PASS")).alias("g")).first().g
    assert (row.cross_check, row.exclusion_reason, row.admissible) == (check, reason, reason is None)


def test_payload_dedupe(spark):
    rows = spark.createDataFrame([("c", "a", "x"), ("c", "a", "x"), ("c", "b", "x"), ("c", "b", "y")], "collection string, id string, payload string")
    got = {r.id: (r.copies, r.conflict) for r in sc.dedupe(rows, ["collection", "id"], F.col("payload")).collect()}
    assert got == {"a": (2, False), "b": (2, True)}


def test_xml_metadata(spark):
    granule = "<a xmlns='u'><Mean_Sun_Angle><ZENITH_ANGLE>42.5</ZENITH_ANGLE></Mean_Sun_Angle></a>"
    product = ("<p><BOA_QUANTIFICATION_VALUE>10000</BOA_QUANTIFICATION_VALUE><BOA_ADD_OFFSET band_id='3'>-1000</BOA_ADD_OFFSET>"
               "<Special_Values><SPECIAL_VALUE_TEXT>NODATA</SPECIAL_VALUE_TEXT><SPECIAL_VALUE_INDEX>0</SPECIAL_VALUE_INDEX></Special_Values></p>")
    rows = spark.createDataFrame(
        [(42.5, granule, product), (42.6, granule, "<broken"), (None, granule, product.replace("10000", "x"))], "z double, g string, p string")
    got = source.with_xml_metadata(rows, "z", "g", "p").collect()
    assert [r.mean_solar_zenith_angle for r in got] == [42.5, None, None]
    assert got[0].radiometry["B04"].offset == pytest.approx(-0.1) and got[0].radiometry["B08"].offset == 0.0
    assert got[1].radiometry["B04"] is None and got[2].radiometry["B08"] is None


def test_equal_metadata_documents_are_parsed_once():
    import pyarrow as pa

    from attestra.functions import xmlmeta

    seen = []
    one = lambda d: seen.append(d) or ([] if d is None else [d])
    got = list(xmlmeta._parsed_once(iter([pa.array(["a", None, "b", "a", "a", None]), pa.array([], pa.string())]), one, pa.list_(pa.string())))
    assert [g.to_pylist() for g in got] == [[["a"], [], ["b"], ["a"], ["a"], []], []]
    assert sorted(seen, key=str) == [None, "a", "b"]


def test_pages_are_written_compressed_from_narrow_lines(spark):
    import os

    from workloads.registry import Tables
    from workloads.scene_queries import _feature_pages, inventory_csv

    tables = Tables(spark, "/root/testdata/sf0.001")
    folder = _feature_pages(tables).removeprefix("file:")
    parts = [name for name in os.listdir(folder) if name.startswith("part-")]
    assert parts and all(name.endswith(".json.gz") for name in parts)
    assert all(name.endswith(".csv.gz") for name in inventory_csv(tables).inputFiles())


def test_window_counts_need_neither_ids_nor_lists(spark):
    from attestra.plans import scene_selection
    from workloads.registry import Tables
    from workloads.scene_queries import short_windows

    items = short_windows(Tables(spark, "/root/testdata/sf0.001"))
    gates = sc.component_gates(sc.selection_input(items))
    whole = sc.canonical_components(sc.selection_input(items)).select(*gates.columns[:4], (F.size("exclusion_reasons") == 0).alias("admissible"), "ambiguous")
    assert sorted(gates.collect()) == sorted(whole.collect())
    odd = items.limit(300).unionByName(items.limit(300).withColumn("platform", F.lit(None).cast("string")))
    for frame in (items, odd, items.withColumn("id", F.lit("same"))):
        assert {r.win for r in sc.unclear_windows(frame).collect()} == {r.win for r in sc.identity_conflicts(frame).collect()}
    plan = scene_selection.evaluate_windows(items)._jdf.queryExecution().optimizedPlan().toString()
    assert "selected_item_id" not in plan and "count(distinct" not in plan
