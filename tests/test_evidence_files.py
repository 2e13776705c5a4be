"""How evidence documents lie on disk."""

from __future__ import annotations

import json
import os
from urllib.parse import unquote, urlparse

from attestra.sources import evidence as source
from workloads import evidence_queries
from workloads.registry import Tables


def test_documents_take_a_small_part_of_their_text_on_disk(spark):
    documents = evidence_queries._documents(Tables(spark, "/root/testdata/sf0.001"))
    rows = documents.select("path", "document_bytes").collect()
    files = {unquote(urlparse(r.path).path) for r in rows}
    assert len(rows) == 1500 and sum(os.path.getsize(f) for f in files) * 5 < sum(r.document_bytes for r in rows)


def test_scanned_documents_are_parsed_once_and_break_the_same_rules(spark, tmp_path):
    made = lambda i, facts: json.dumps({"evidence_id": i, "source": {"source_id": "S", "accessed_on": "2026-09-05"}, "facts": facts})
    lines = [made("a", [{"fact_id": "1"}, {"fact_id": "2"}]), made("b", []), made("b", []), made("c", None), '{"evidence_id": "d", "evidence_id": "e"}',
             '{"evidence_id": NaN}', "not json", made(None, []), made("long", [{"text": "x" * 500}])]
    (tmp_path / "documents.json").write_text("\n".join(lines))
    documents = source.read_documents(spark, str(tmp_path))
    once = source.scanned(documents)
    plan = lambda frame: frame._jdf.queryExecution().executedPlan().toString()
    assert "FileScan text" in plan(source.document_violations(documents))
    assert "FileScan text" not in plan(source.document_violations(once, 400)) and "FileScan text" not in plan(once)
    found = lambda frame: sorted(map(str, source.document_violations(frame, 400).collect()))
    assert found(once) == found(documents) and len(found(once)) == 6
    heads = {(r.document.evidence_id, r.document.fact_count, r.document.source.source_id) for r in once.filter("document.evidence_id IS NOT NULL").collect()}
    assert heads == {("a", 2, "S"), ("b", 0, "S"), ("c", None, "S"), ("long", 1, "S")}
    assert once.count() == len(lines) and once.filter("document IS NULL").count() == documents.filter("document IS NULL").count()
