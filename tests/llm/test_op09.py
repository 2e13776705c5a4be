from __future__ import annotations

import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from attestra.llm import op09_exact_stream as op
from tests.llm.fixtures import ODD, documents


def wanted(rows):
    groups = defaultdict(list)
    for i, text, *_ in rows:
        groups[text or ""].append(i)
    out = []
    for i, text, *_ in rows:
        same = groups[text or ""]
        keep = max((x for x in same if x is not None), default=None)
        out.append((i, keep, len(same), i == keep))
    return sorted(out, key=str)


def made(frame):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in frame.collect()), key=str)


def test_awkward_rows(spark):
    docs = documents(spark, ODD)
    assert made(op.decisions(docs)) == wanted(ODD)
    kept = op.keep_one(docs)
    assert kept.columns == docs.columns
    assert len(kept.collect()) == len({t or "" for _, t, *_ in ODD})
    assert op.decisions(docs.limit(0)).count() == 0


def test_batches_do_not_change_the_answer(spark):
    rows = [(i, f"text {i % 40}", "en", "a") for i in range(400)]
    docs = documents(spark, rows).repartition(9)
    assert made(op.decisions(docs, bytes_per_batch=3000)) == wanted(rows)


def test_colliding_digests_are_told_apart_by_their_bytes(spark):
    rows = [(i, f"text {i % 40}", "en", "a") for i in range(400)] + [(i, "hot", "en", "a") for i in range(400, 2000)]
    weak = made(op.decisions(documents(spark, rows), digest=lambda t: F.substring(F.sha2(t.cast("binary"), 256), 1, 1)))
    assert weak == wanted(rows)


def test_digest_is_of_the_bytes(spark):
    got = {r["doc_id"]: r["digest"] for r in op.decisions(documents(spark, [(1, "é", "fr", "a"), (2, None, None, None)])).collect()}
    assert got == {1: hashlib.sha256("é".encode()).hexdigest(), 2: hashlib.sha256(b"").hexdigest()}
