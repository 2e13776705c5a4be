from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from attestra.llm import op07_near_simhash as op
from attestra.llm.components import components
from tests.llm.fixtures import ODD, documents


def brute_code(text: str | None) -> int:
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    grams = [" ".join(words[i: i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(codes: list[int], ids: list, radius: int) -> list:
    parent = list(range(len(codes)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(codes)), 2):
        if (codes[i] ^ codes[j]).bit_count() <= radius:
            parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least.setdefault(find(i), []).append(d)
    return [min((d for d in least[find(i)] if d is not None), default=None) for i in range(len(codes))]


def test_groups_of_a_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = sorted(texts)
    codes = [brute_code(texts[i]) for i in ids]
    wanted = dict(zip(ids, zip(codes, brute_components(codes, ids, 4))))
    got = {r["doc_id"]: (r["code"] % (1 << 64), r["component_id"]) for r in op.near_groups(docs).collect()}
    assert got == wanted


def test_awkward_rows(spark):
    docs = documents(spark, ODD)
    ids, codes = [r[0] for r in ODD], [brute_code(r[1]) for r in ODD]
    wanted = sorted(zip(ids, codes, brute_components(codes, ids, 4)), key=str)
    got = sorted(((r["doc_id"], r["code"] % (1 << 64), r["component_id"]) for r in op.near_groups(docs).collect()), key=str)
    assert got == wanted
    kept = op.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, _, c in wanted})
    assert op.near_groups(docs.limit(0)).count() == op.keep_one(docs.limit(0)).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 7])
def test_bit_slices_equal_plain_distances(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    codes = np.concatenate([base, base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)), base ^ rng.integers(0, 1 << 12, 40).astype(np.uint64)])
    plane = op.planes(codes)
    for word in range(plane.shape[1]):
        found = op.lanes_within(plane, codes, np.full(len(codes), word), radius)
        for i, bits in enumerate(found.tolist()):
            for lane in range(64):
                if word * 64 + lane < len(codes):
                    assert bool(bits >> lane & 1) == (int(codes[i] ^ codes[word * 64 + lane]).bit_count() <= radius)


def test_hot_bucket_in_parts_loses_no_link(spark):
    rng = np.random.default_rng(5)
    chain = [0x123456789ABCDEF0]
    for step in range(600):  # a chain whose ends are far apart
        chain.append(chain[-1] ^ sum(1 << int(b) for b in rng.choice(64, 4, replace=False)))
    codes = sorted(set(chain) | {int(x) for x in rng.integers(0, 1 << 63, 300)} | {0xFFFFFFFF00000000 | int(x) for x in rng.integers(0, 4096, 800)})
    frame = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c,) for c in codes], "code LONG")
    roots = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in components(op.near_links(frame, 4, 6, chunk=50)).collect()}
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    wanted = brute_components(codes, signed, 4)
    assert [roots.get(c, c) for c in codes] == [w % (1 << 64) for w in wanted]


def test_components_of_chain_star_and_loop(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(200, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a LONG, b LONG")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{i: 100 for i in range(101, 160)}}
    assert components(spark.createDataFrame([], "a LONG, b LONG")).agg(F.count("*")).first()[0] == 0
