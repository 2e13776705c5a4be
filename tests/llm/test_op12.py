from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from attestra.llm import op12_vector_codes as op

SCHEMA = "vec_id LONG, embedding ARRAY<FLOAT>, label INT, whole STRING, code STRING, error LONG, _label STRING"


def brute(rows, parts=8, entries=16, rounds=6):
    """Plain Lloyd rounds over Python integers."""
    kept = [(i, [math.floor(4096 * x) for x in v], c) for i, v, c in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * size: (p + 1) * size]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            for k, some in groups.items():
                books[p][k] = [sum(x) // len(some) for x in zip(*some)]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    best = [(i, [near(cut(v, p), books[p]) for p in range(parts)], c) for i, v, c in kept]
    labels = {}
    for _, found, c in best:
        labels[c] = labels.get(c, 0) + sum(d for d, _ in found)
    return [(i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), labels[c], digest) for i, found, c in best]


def rows(made):
    return sorted((tuple(r) for r in made.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


def test_given_table(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    wanted = sorted(brute([(r["vec_id"], r["embedding"], r["label"]) for r in vectors.collect()]), key=str)
    assert rows(op.vector_codes(vectors)) == wanted
    assert rows(op.vector_codes(vectors.repartition(3), chunk=50, leaf=2)) == wanted


def test_awkward_rows(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(-3, 4, (30, 16)).astype(float).tolist()
    held = [(k, v, k % 3 or None) for k, v in enumerate(base)] + [(k, base[k], None) for k in (3, 3, 5)] + [(None, base[7], 1), (90, [float("nan")] * 16, 1), (91, None, 2)]
    held += [(92, [1.0] * 15 + [None], 0), (93, [1.0] * 15 + [float("inf")], 0), (94, [], 0), (-5, [0.0] * 16, 4), (95, [9.0] * 15 + [-9.0], 4), (96, [0.00012] * 16, 4)]
    for some in (held, held[:5], held[:1]):
        vectors = spark.createDataFrame([(*r, "x", "c", 1, "l") for r in some], SCHEMA)
        assert rows(op.vector_codes(vectors)) == sorted(brute(some), key=str)
        assert rows(op.vector_codes(vectors, chunk=4, leaf=1)) == sorted(brute(some), key=str)
    assert op.vector_codes(vectors.limit(0)).count() == 0
    far = spark.createDataFrame([(k, [1e30 if k % 2 else -1e30] * 8, 0, "", "", 0, "") for k in range(20)], SCHEMA)
    assert {r["error"] for r in op.vector_codes(far).collect()} == {0}
    with pytest.raises(ValueError):
        op.vector_codes(spark.createDataFrame([(1, [1.0] * 9, 0, "", "", 0, "")], SCHEMA))


@pytest.mark.parametrize("seed", range(6))
def test_subtrees_go_whole_and_exactly(seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-2000, 2000, (12, 8))
    points = np.concatenate([centres[rng.integers(0, 12, 3000)] + rng.integers(-40, 41, (3000, 8)), np.repeat(centres, 40, axis=0)])
    tree, order = op.cover_tree(points)
    assert (tree.points == points[order]).all() and sorted(order) == list(range(len(points)))
    for node in range(len(tree.start)):  # every node covers its points
        mine = tree.points[tree.start[node]: tree.end[node]]
        assert np.sqrt(((mine - mine[0]) ** 2).sum(axis=1)).max() <= tree.radius[node] + 1e-9
    entries = np.concatenate([centres[:9], centres[:3], centres[9:10] * 3])  # repeated entries tie
    plain = op.squares(tree.points, entries).argmin(axis=1)
    assert (op.nearest(tree, entries) == plain).all()
    count, total = op.totals(tree, entries)
    assert (count == np.bincount(plain, minlength=len(entries))).all()
    assert all((total[k] == tree.points[plain == k].sum(axis=0)).all() for k in range(len(entries)))
    assert op.assign(tree, entries[:9])[4] < len(points)  # whole subtrees were never compared point by point
