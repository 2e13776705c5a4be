from __future__ import annotations

import random
import re
from itertools import combinations

import corpus_pipeline
import numpy as np
import pytest

from attestra.llm import near_jaccard as op
from tests.llm.fixtures import ODD, documents


def gram_set(text: str | None) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i: i + 5]) for i in range(max(1, len(words) - 4)))


def brute_kept(rows: list[tuple]) -> list:
    """The least doc_id (null last) of each component of Jaccard >= 0.8 by comparing all pairs."""
    sets, parent = [gram_set(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
            parent[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return sorted((min((d for d in g if d is not None), default=None) for g in groups.values()), key=str)


def edited(seed: int, n: int = 40) -> list[tuple]:
    """Texts of 150 to 300 words, each with copies in which one to nine words are others: similarity from about 0.6 to 0.97."""
    rng, rows = random.Random(seed), []
    for _ in range(n):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(150, 300))]
        rows.append(words)
        for changes in rng.sample(range(1, 10), 3):
            copy = list(words)
            for at in rng.sample(range(len(copy)), changes):
                copy[at] = f"x{rng.randrange(10 ** 9)}"
            rows.append(copy)
    rng.shuffle(rows)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def kept(frame) -> list:
    return sorted((r["doc_id"] for r in frame.collect()), key=str)


def test_stage_keeps_one_of_near_copies_with_a_few_edited_words(spark):
    rows = edited(1)
    docs = documents(spark, [(i, t, "en", "a") for i, t in rows])
    made = corpus_pipeline.near_dedup(spark, docs, "")
    assert made.columns == docs.columns
    assert kept(made) == brute_kept(rows)


def test_stage_on_a_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert kept(corpus_pipeline.near_dedup(spark, docs, "")) == brute_kept([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_stage_on_awkward_rows(spark):
    docs = documents(spark, ODD)
    assert kept(corpus_pipeline.near_dedup(spark, docs, "")) == brute_kept([(i, t) for i, t, *_ in ODD])
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


@pytest.mark.parametrize("chunk", [3, 256])
def test_large_buckets_in_parts_lose_no_link(spark, chunk):
    """Chains: each text is near its neighbours only, all share most of their buckets with texts they are not near."""
    rng, rows = random.Random(7), []
    for _ in range(3):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        for step in range(40):
            rows.append((len(rows), " ".join(words)))
            for at in rng.sample(range(200), 1 + step % 5):
                words[at] = f"y{rng.randrange(10 ** 9)}"
    docs = documents(spark, [(i, t, "en", "a") for i, t in rows])
    assert kept(op.keep_one(docs, chunk=chunk)) == brute_kept(rows)


def test_buckets_find_pairs_at_the_least_similarity():
    rng = np.random.default_rng(3)
    missed = 0
    for _ in range(2000):
        h = rng.integers(0, 1 << 63, 180, dtype=np.uint64) * np.uint64(2)
        a, b = op.buckets([np.sort(h[:162]), np.sort(np.concatenate([h[:144], h[162:]]))])  # 144 of 180: 0.8
        missed += not (a == b).any()
    assert missed == 0


def test_simhash_alone_links_what_lies_within_its_radius(spark, monkeypatch):
    """Without any MinHash bucket the stage still links copies whose SimHash codes are near: op7's comparison is part of the method."""
    rng = random.Random(11)
    words = [f"w{rng.randrange(5000)}" for _ in range(900)]
    near = [*words[:450], "other", *words[451:]]
    rows = [(0, " ".join(words)), (1, " ".join(near)), (2, " ".join(f"z{rng.randrange(5000)}" for _ in range(900)))]
    monkeypatch.setattr(op, "_sketch", lone_buckets(op._sketch))
    docs = documents(spark, [(i, t, "en", "a") for i, t in rows])
    assert kept(op.keep_one(docs)) == brute_kept(rows) == [0, 2]


def lone_buckets(sketch):
    """The sketches with bucket numbers that no two rows share."""
    def made(*parameters):
        inner = sketch(*parameters)

        def run(batches):
            import pyarrow as pa

            for batch in inner(batches):
                alone = pa.array([[r] for r in batch.column(0).to_pylist()], batch.column(2).type)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), alone], names=batch.schema.names)

        return run

    return made


def test_simhash_pairs_of_equal_and_near_codes(spark):
    rng = random.Random(3)
    codes = [rng.getrandbits(64) for _ in range(20)]
    codes += [codes[0] ^ 0b1011, codes[1], codes[1], codes[2] ^ (1 << 63 | 1 << 20), codes[3] ^ 0b111111]
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    made = op.simhash_pairs(spark.createDataFrame(list(enumerate(signed)), "node long, code long")).collect()
    assert {(r.node, r.other) for r in made} == {(20, 0), (21, 1), (22, 1), (23, 2)}
