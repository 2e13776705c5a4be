from __future__ import annotations

import zlib

import numpy as np

from attestra.llm import op06_language as op
from tests.llm.fixtures import ODD, documents

SAMPLES = {"en": "the and of with that from this", "de": "der und die mit von nicht ein", "fr": "le les des et dans pour qui", "es": "el los que con para una por", "ja": "かな 漢字 です"}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    made = {r["doc_id"]: r for r in op.identify(docs).withColumn("held_out", op.held_out(op.F.col("doc_id"))).collect()}
    assert made.keys() == truth.keys()
    for i, r in made.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1
    out = [r for r in made.values() if r["held_out"]]
    assert len(out) > 150
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in out]) >= 0.98


def test_awkward_rows(spark):
    rows = [(100 + k, " ".join(np.random.default_rng(k).permutation(w.split())), lang, "a") for k, (lang, w) in enumerate(list(SAMPLES.items()) * 20)]
    docs = documents(spark, rows + ODD)
    made = op.identify(docs).collect()
    assert len(made) == len(rows) + len(ODD)
    told = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in made}
    assert told[5] == told[6] == told[7] == told[14] == told[16] == ("und", 0.0)
    truth = {i: lang for i, _, lang, _ in rows}
    assert np.mean([told[i][0] == lang for i, lang in truth.items()]) > 0.95
    kept = op.keep_known(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(rows) + sum(any(c.isalpha() for c in t or "") for _, t, *_ in ODD)
    assert op.identify(docs.limit(0)).count() == op.keep_known(docs.limit(0)).count() == 0


def test_one_language_and_none(spark):
    one = documents(spark, [(i, "the words of one tongue", "en", "a") for i in range(20)])
    assert {(r["lang_pred"], r["score"]) for r in op.identify(one).collect()} == {("en", 1.0)}
    none = documents(spark, [(i, "the words of no tongue", None, "a") for i in range(20)])
    assert {(r["lang_pred"], r["score"]) for r in op.identify(none).collect()} == {("und", 0.0)}


def test_prediction_sees_only_its_text():
    machines = op.Machines([w for w in SAMPLES.values() for _ in range(3)], [k for k in SAMPLES for _ in range(3)])
    texts = ["the old and the new", "und die alte nicht", "x", "les vieux et"]
    alone = [machines.predict([t]) for t in texts]
    together = machines.predict(texts)
    assert [a[0][0] for a in alone] == together[0]
    assert np.allclose([a[1][0] for a in alone], together[1], rtol=0, atol=1e-12)
