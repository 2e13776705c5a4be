from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest

from attestra.llm import op11_ranked_search as op
from tests.llm.fixtures import ODD, documents

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id LONG, text STRING, doc_id LONG, score LONG, row LONG"


def brute_terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, limit=10):
    """Every document scored for every item."""
    bags = [(i, Counter(brute_terms(t))) for i, t in docs]
    filled, total = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    holders = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for doc, bag in bags:
            n = sum(bag.values())
            m = 25 + (75 * n * filled) // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * filled + 2) / (2 * holders[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * m))
                        for t in brute_terms(text) if bag[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, k, s[3], -s[0]) for k, s in enumerate(sorted(scored)[:limit], 1)]
    return sorted(out, key=str)


def rows(made):
    assert made.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in made.collect()), key=str)


def test_given_tables(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    wanted = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert rows(op.search(docs, items)) == wanted
    # small shards, short reads and several blocks of items change nothing
    assert rows(op.search(docs, items, shard_docs=7, shard_entries=400, first=2, block_terms=300)) == wanted


def test_awkward_rows(spark):
    asked = [(1, "The old MILL, the river", 0, 0, 0), (2, None, 0, 0, 0), (3, "", 0, 0, 0), (1, "The old MILL, the river", 0, 0, 0), (None, "one ¿qué? é", 0, 0, 0),
             (4, "unheard words", 0, 0, 0), (5, "again " * 400 + "\U0001f600", 0, 0, 0), (6, "mill mill mill wheel", 0, 0, 0)]
    docs, items = documents(spark, ODD), spark.createDataFrame(asked, ITEMS)
    assert rows(op.search(docs, items)) == brute([r[:2] for r in ODD], [r[:2] for r in asked])
    assert rows(op.search(docs, items, first=1, shard_docs=3)) == brute([r[:2] for r in ODD], [r[:2] for r in asked])
    assert op.search(docs.limit(0), items).count() == op.search(docs, items.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_intervals_end_at_the_exact_best(seed):
    """Reads stop early, yet membership, ties and scores are those of a full sum."""
    rng = np.random.default_rng(seed)
    n, limit = 400, 10
    lists, weights, total = [], rng.integers(1, 50, 6), np.zeros(n, dtype=np.int64)
    for w in weights:
        docs = rng.permutation(n)[: rng.integers(0, n)]
        impacts = np.sort(rng.integers(1, 12 if seed % 2 else 10**6, len(docs)))[::-1]
        total[docs] += w * impacts
        lists.append((docs, impacts))
    kth = max(1, np.sort(total)[-limit])
    for least in (1, int(kth)):
        found, scores = op.no_random_access(lists, weights, n, limit, least, first=3)
        assert dict(zip(found.tolist(), scores.tolist())) == {int(d): int(total[d]) for d in np.flatnonzero(total >= kth)}
