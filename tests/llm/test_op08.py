from __future__ import annotations

import re

import numpy as np

from attestra.llm import op08_mixing as op
from tests.llm.fixtures import ODD, documents


def wanted_targets(sizes: dict) -> dict:
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, target, left = sum(sizes.values()), {s: 0.0 for s in order}, set(order)
    rest = float(total)
    while left and total:
        level = rest / sum(weight[s] for s in left)
        over = {s for s in left if level * weight[s] >= 3 * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in left}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            rest -= target[s]
        left -= over
    return target


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(made, rows):
    sizes, largest, taken = {}, {}, {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + size(text)
        largest[source] = max(largest.get(source, 0), size(text))
    target = wanted_targets(sizes)
    assert sorted(((r["doc_id"], r["size"], r["source_size"]) for r in made), key=str) == sorted(((i, size(t), sizes[s]) for i, t, _, s in rows), key=str)
    for r in made:
        assert abs(r["target"] - target[r["source"]]) <= 1e-6 * max(1, target[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for source, words in taken.items():
        assert abs(words - target[source]) <= largest[source] + 1e-6, source


def test_awkward_rows_and_reruns(spark):
    docs = documents(spark, ODD)
    made = op.mix(docs).collect()
    check(made, ODD)
    again = op.mix(docs.repartition(7)).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], str(r["source"]), r["taken"])
    assert sorted(map(key, made)) == sorted(map(key, again))
    assert op.mix(docs.limit(0)).count() == 0


def test_hot_source_over_several_levels(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "w " * int(rng.integers(0, 60)), "en", "hot" if i % 3 == 0 else f"s{i % 11}") for i in range(3000)]
    check(op.mix(documents(spark, rows), group=8).collect(), rows)


def test_pairs_keep_expectation_and_mass():
    p, size = np.full(501, 0.37), np.random.default_rng(2).integers(1, 300, 501).astype(float)
    runs = np.array([op.pivot(p, size, np.random.default_rng(s)) for s in range(400)])
    assert (((runs > 0) & (runs < 1)).sum(axis=1) <= 1).all()
    assert np.allclose((runs * size).sum(axis=1), (p * size).sum())
    assert abs(runs.mean() - 0.37) < 0.01 and abs(runs.mean(axis=0) - 0.37).max() < 0.12
