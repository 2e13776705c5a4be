from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from attestra.llm import op13_jaccard_join as op
from tests.llm.fixtures import ODD, documents


def brute_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i: i + 4]) for i in range(max(1, len(words) - 3))) if words else frozenset()


def brute(rows):
    """All pairs of documents compared."""
    sets = [brute_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
            parent[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            groups[find(i)] = min(d, groups.get(find(i), d))
    return sorted(((d, len(s), groups.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def rows(made):
    assert made.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted((tuple(r) for r in made.collect()), key=str)


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert rows(op.similar_groups(docs)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_awkward_rows(spark):
    docs = documents(spark, ODD)
    assert rows(op.similar_groups(docs)) == brute([r[:2] for r in ODD])
    assert op.similar_groups(docs.limit(0)).count() == 0


def drifting(seed, groups=12, copies=25):
    """Groups of copies that drift apart, so that similarities fall on both sides of the bound, and passages that many share."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    passage = list(rng.choice(vocabulary, 30))
    out = []
    for _ in range(groups):
        text = list(rng.choice(vocabulary, rng.integers(40, 160)))
        for _ in range(copies):
            text = list(text)
            for _ in range(rng.integers(0, 4)):
                text[rng.integers(0, len(text))] = str(rng.choice(vocabulary))
            out.append((len(out) * 7 % 1009, " ".join(text + passage * int(rng.integers(0, 2)))))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_drifting_copies_in_small_parts(spark, seed):
    held = drifting(seed)
    docs = documents(spark, [(i, t, "en", "a") for i, t in held])
    assert rows(op.similar_groups(docs, chunk=5, side=3)) == brute(held)


@pytest.mark.parametrize("seed", range(5))
def test_block_skips_leave_what_can_be_similar(seed):
    rng = np.random.default_rng(seed)
    n = 300
    run, size = rng.integers(0, 4, n), rng.integers(1, 60, n)
    position, root = (rng.random(n) * size).astype(np.int64), rng.integers(0, 50, n)
    order = np.lexsort((position, size, run))
    run, size, position, root = run[order], size[order], position[order], root[order]
    found = {(min(x, y), max(x, y)) for left, right in op.meetings(run, size, position, root, most=100) for x, y in zip(left.tolist(), right.tolist())}
    wanted = {(i, j) for i, j in combinations(range(n), 2) if run[i] == run[j] and root[i] != root[j]
              and min(size[i] - position[i], size[j] - position[j]) * 185 >= 85 * (size[i] + size[j])}
    assert found == wanted


def test_derived_answers_are_exact():
    rng = np.random.default_rng(3)
    draw = lambda base, k: np.unique(np.concatenate([rng.choice(base, len(base) - k, replace=False), rng.integers(10**6, 10**7, k).astype(np.uint64)]))
    leader = np.unique(rng.integers(0, 10**6, 200).astype(np.uint64))
    members = {k: draw(leader, int(rng.integers(0, 15))) for k in range(30)}
    partners = {100 + k: draw(leader, int(rng.integers(0, 40))) for k in range(30)}
    pairs = [(x, z) for x in members for z in partners]
    same = {(x, z) for x, z in pairs if 100 * len(np.intersect1d(members[x], partners[z])) >= 85 * len(np.union1d(members[x], partners[z]))}
    assert set(op.derived(leader, members, partners, pairs)) == same and 0 < len(same) < len(pairs)


@pytest.mark.parametrize("n", range(1, 60))
def test_prefixes_of_similar_sets_meet(n):
    """Even where all that differs stands first in both sets."""
    for m in range(1, n + 1):
        least = op.needed(n, m)
        assert 100 * least >= 85 * (n + m - least) and 100 * (least - 1) < 85 * (n + m - least + 1)
        if least <= m:
            assert op.prefix(n) > n - least and op.prefix(m) > m - least


def test_hashes_tell_words_and_texts_apart():
    """Sets from shared buffers, with spans cut anywhere, equal those of each text alone."""
    rng = np.random.default_rng(1)
    texts = ["", " ", "a", "A b", "b a", "a b c d", "ab c d e", "a bc d e", "é\u00a0ü x y z", "x" * 5000, *(" ".join(rng.choice(list("abc"), 40)) for _ in range(50))]
    column = pa.array(["skipped", *texts, "also"]).slice(1, len(texts))
    whole = op.shingle_sets(column)
    assert [len(s) for s in whole] == [len(brute_set(t)) for t in texts]
    for i, j in combinations(range(len(texts)), 2):
        assert len(np.intersect1d(whole[i], whole[j])) == len(brute_set(texts[i]) & brute_set(texts[j]))
    op.SPAN, before = 64, op.SPAN
    try:
        assert all((a == b).all() for a, b in zip(whole, op.shingle_sets(column)))
    finally:
        op.SPAN = before
