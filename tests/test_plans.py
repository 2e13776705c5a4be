"""Plan shape: no loop joins, pruned scans, top-k pruned before its shuffle."""

from __future__ import annotations

import contextlib
import io

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from attestra.session import derived_path, shared_folder
from attestra.sources import pixels as pixel_source
from workloads import domain
from workloads.registry import Tables

FOLDER = "/root/testdata/sf0.001"


def plan(frame):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        frame.explain("formatted")
    return text.getvalue()


@pytest.mark.parametrize("name", [
    "pixel_window_aggregation", "canonical_representation", "scene_metadata_evaluation", "qualify_requests", "fact_selection", "rank_topk",
    "point_in_polygon", "ledger_audit", "sensitivities", "case_corpus",
])
def test_no_loop_joins(spark, name):
    text = plan(entry.queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_topk_is_pruned_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(entry.queries()["rank_topk"](spark, FOLDER))


def test_pixel_scan_prunes_partitions_and_columns(spark):
    path = pixel_source.write_pixels(domain.pixels(Tables(spark, FOLDER)))
    text = plan(pixel_source.read_pixels(spark, path, windows=["PRE"], acquisitions=[3]).select("pixel_id").filter(F.col("pixel_id") > 5))
    assert "PartitionFilters" in text and "PushedFilters: [IsNotNull(pixel_id), GreaterThan(pixel_id,5)]" in text
    assert "ReadSchema: struct<pixel_id:bigint>" in text


def test_derived_tables_go_to_the_shared_folder(spark):
    assert derived_path(spark, "x").startswith(shared_folder(spark))


@pytest.mark.parametrize("name", ["mosaic", "qualify_requests", "source_allowlist"])
def test_fixed_policy_rows_are_broadcast(spark, name):
    """A shuffle by their few keys would bring a third of all rows to one task."""
    text = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().sparkPlan().toString()
    fixed = [line for line in text.splitlines() if "Join" in line and any(key in line for key in ("[platform#", "[claim_family#", "[source_id#"))]
    assert fixed and all("BroadcastHashJoin" in line for line in fixed), text
