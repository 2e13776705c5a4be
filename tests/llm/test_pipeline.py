from __future__ import annotations

import re

import corpus_pipeline
import pytest
from tests.llm.fixtures import ODD, documents
from tests.llm.test_near_jaccard import brute_kept
from tests.llm.test_op03 import checked
from tests.llm.test_op08 import wanted_targets


@pytest.mark.parametrize("source", ["given", "odd"])
def test_stages_against_brute_force(spark, tmp_path, source):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet") if source == "given" else documents(spark, ODD)
    rows = [r.asDict() for r in docs.collect()]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, "/root/testdata/sf0.001")
        made.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = [r.asDict() for r in docs.collect()]
        if name != "packing":
            assert docs.columns == columns
        if name == "language_id":
            wanted = [r for r in rows if any(c.isalpha() for c in r["text"] or "")]
            assert sorted(map(str, after)) == sorted(map(str, wanted))
        elif name == "exact_dedup":
            groups = {}
            for r in rows:
                groups.setdefault(r["text"], []).append(r["doc_id"])
            keep = {(max((i for i in ids if i is not None), default=None), t) for t, ids in groups.items()}
            assert len(after) == len(keep) and {(r["doc_id"], r["text"]) for r in after} == keep
        elif name == "near_dedup":
            assert sorted((r["doc_id"] for r in after), key=str) == brute_kept([(r["doc_id"], r["text"]) for r in rows])
        elif name == "mixing":
            size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
            sizes, taken, largest, copies = {}, {}, {}, {}
            for r in rows:
                sizes[r["source"]] = sizes.get(r["source"], 0) + size(r)
                largest[r["source"]] = max(largest.get(r["source"], 0), size(r))
            for r in after:
                taken[r["source"]] = taken.get(r["source"], 0) + size(r)
                copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
            assert max(copies.values()) <= 3 and {str(r) for r in after} <= {str(r) for r in rows}
            for s, target in wanted_targets(sizes).items():
                assert abs(taken.get(s, 0) - target) <= largest[s] + 1e-6
        else:
            used, least = checked([type("R", (dict,), {})(r) for r in after], [(r["doc_id"], r["text"]) for r in rows], 2048)
            assert used <= least + 1
        rows = after


def test_run_is_the_stages_in_turn(spark):
    made = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert made.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert made.count() > 100
