from __future__ import annotations

import hashlib


from attestra.llm import op05_fingerprints as op
from tests.llm.fixtures import ODD, documents


def edited(rows):
    """Documents with unique ids, in order."""
    out = {}
    for (i, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        text, following = text or "", following or ""
        quarter = len(text) // 4
        out[i] = (len(text), hashlib.sha256((text[: len(text) - quarter] + following[:quarter]).encode()).hexdigest())
    return out


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    made = {r["doc_id"]: r for r in op.report(docs, every=10).collect()}
    assert {i: (r["n_chars"], r["edited_sha256"]) for i, r in made.items()} == edited(rows)
    by_text = {}
    for i, text in rows:
        assert by_text.setdefault(text, made[i]["fingerprint"]) == made[i]["fingerprint"]
    codes = {i: int(r["fingerprint"], 16) for i, r in made.items()}
    for k, (i, _) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][0]
        far = (codes[i] ^ codes[following]).bit_count()
        assert abs(made[i]["near_next"] - float(op_likeness(far))) < 1e-9
        near = (codes[i] ^ int(made[i]["edited_fingerprint"], 16)).bit_count()
        assert abs(made[i]["near_edited"] - float(op_likeness(near))) < 1e-9
        wanted = sum((codes[i] ^ c).bit_count() <= op.RADIUS for c in codes.values()) - 1 if i % 10 == 0 else None
        assert made[i]["near_rows"] == wanted
    long = [r for r in made.values() if r["n_chars"] > 400]
    assert sum(r["near_edited"] > r["near_next"] for r in long) >= 0.97 * len(long)


def op_likeness(bits):
    import math

    return 1.0 if bits == 0 else max(0.0, math.cos(bits * math.pi / op.BITS))


def test_awkward_rows(spark):
    docs = documents(spark, ODD)
    made = op.report(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_chars"]) for r in made) == sorted((str(i), len(t or "")) for i, t, *_ in ODD)
    unique = [r for r in ODD if r[0] is not None and r[0] != 2]
    rows = sorted((i, t) for i, t, *_ in unique)
    got = {r["doc_id"]: (r["n_chars"], r["edited_sha256"]) for r in op.report(documents(spark, unique)).collect()}
    assert got == edited(rows)
    assert op.report(docs.limit(0)).count() == 0
    one = op.report(documents(spark, [(4, "just one text here", "en", "a")])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"just one text just").hexdigest() and one["near_next"] == 1.0


def test_tables_find_every_code_within_the_radius(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    base = [(int(a), int(b)) for a, b in rng.integers(-(1 << 62), 1 << 62, (40, 2))]
    codes = set(base)
    for hi, lo in base:
        for flips in range(1, 12):
            bits = rng.choice(128, flips, replace=False)
            x = sum(1 << int(b) for b in bits)
            codes.add((op._signed((hi % (1 << 64)) ^ (x >> 64)), op._signed((lo % (1 << 64)) ^ (x % (1 << 64)))))
    frame = spark.createDataFrame([(h, low, 1) for h, low in codes], "hi LONG, lo LONG, rows LONG")
    asked = spark.createDataFrame(base, "hi LONG, lo LONG")
    got = sorted((r["q_hi"], r["q_lo"], r["hi"], r["lo"]) for r in op.within(frame, asked).collect())
    near = lambda a, b: ((a[0] ^ b[0]) % (1 << 64)).bit_count() + ((a[1] ^ b[1]) % (1 << 64)).bit_count() <= op.RADIUS
    assert got == sorted((*q, *c) for q in base for c in codes if near(q, c))


def test_only_fronts_that_are_asked_for_are_shuffled(spark):
    from pyspark.sql import functions as F

    there = spark.range(100_000).select((F.col("id") % 28).cast("int").alias("_table"), F.col("id").alias("_h"), F.xxhash64("id").alias("_l"), F.lit(1).alias("rows"))
    asked = there.filter("_h % 1000 = 0").select(F.col("_table").alias("q_table"), F.col("_h").alias("q_h"), F.col("_l").alias("q_l"))
    left = op.marked(there, ["_table", "_h", "_l"], asked, ["q_table", "q_h", "q_l"])
    assert left.columns == there.columns
    assert left.filter("_h % 1000 = 0").count() == 100 and left.count() <= 110
    plan = op.report(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_or" in plan


def test_no_python_in_the_plan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = op.report(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
