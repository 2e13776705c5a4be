from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from attestra.llm import op02_repeats as op
from tests.llm.fixtures import ODD, PROSE, documents


def brute(rows, length=50):
    first = {}
    data = [(op.NO_ID if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for k in range(len(b) - length + 1):
            w = b[k: k + length]
            first[w] = min(first.get(w, op.NO_ID), i)
    out = []
    for (raw, _), (i, b) in zip(rows, data):
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k: k + length]] < i:
                gone[k: k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((raw, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def made(frame):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in frame.collect()), key=str)


def mixed(seed: int, n: int = 60):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("ab cé\n") for _ in range(rng.randint(30, 400))) for _ in range(12)] + ["ab" * 200, "x" * 500, PROSE * 3]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(pool)
            a = rng.randint(0, len(p) // 2)
            parts.append(p[a: a + rng.randint(20, 300)])
            parts.append("".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 60))))
        rows.append((i, "".join(parts)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_brute_force(spark, seed):
    rows = mixed(seed)
    docs = documents(spark, [(i, t, "en", "a") for i, t in rows]).repartition(5)
    assert made(op.remove_repeats(docs, block_bytes=3000, range_bytes=4000)) == brute(rows)


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert made(op.remove_repeats(docs)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_awkward_rows(spark):
    docs = documents(spark, ODD)
    assert made(op.remove_repeats(docs)) == brute([(i, t) for i, t, *_ in ODD])
    kept = {r["doc_id"]: r["kept"] for r in op.remove_repeats(docs, with_text=True).collect()}
    assert kept[3] == b"again" and kept[5] == b""
    assert op.remove_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_merged_order_is_the_sorted_order(seed):
    rng = random.Random(seed)
    texts = [bytes(rng.choice(b"ab\0c") for _ in range(rng.randint(1, 60))) for _ in range(40)]
    shards = [op.Shard(b"".join(t), np.array([len(x) for x in t]), 8) for t in (texts[:7], texts[7:8], texts[8:30], texts[30:])]
    for shard in shards:  # the transform gives the segments back
        inverse = {int(a): int(b) for a, b in enumerate(shard.step)}
        assert sorted(inverse) == sorted(inverse.values())
    depth = 12
    merged, new = op.merge(shards, depth)
    base = np.cumsum([0] + [len(s.order) for s in shards])
    position = np.concatenate([s.order + b for s, b in zip(shards, base)])[merged]
    prefix = [tuple(t[k: k + depth]) if k + depth <= len(t) else None for t in texts for k in range(len(t) + 1)]
    classes = np.cumsum(new)
    found = [(prefix[p], c) for p, c in zip(position, classes) if prefix[p] is not None]
    assert [p for p, _ in found] == sorted(p for p in prefix if p is not None)
    for (p, a), (q, b) in zip(found, found[1:]):
        assert (p == q) == (a == b)
    for shard, part in zip(shards, (texts[:7], texts[7:8], texts[8:30], texts[30:])):
        suffixes = [bytes(c + 1 for c in t[k:]) + b"\0" for t in part for k in range(len(t) + 1)]
        assert [suffixes[k] for k in shard.order] == sorted(suffixes)


def edges(n: int = 300, seed: int = 9) -> list[tuple]:
    """One passage in every document, between neighbours of its own or of a few documents."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(60))
    few = [word() for _ in range(n // 5)]
    return [(i, (word() if i % 3 else rng.choice(few)) + PROSE + (word() if i % 4 else rng.choice(few))) for i in range(n)]


@pytest.mark.parametrize("hot_segments", [0, 20, op.HOT_SEGMENTS])
def test_hot_minimizers_by_whole_windows_equal_brute_force(spark, hot_segments):
    rows = edges()
    docs = documents(spark, [(i, t, "en", "a") for i, t in rows]).repartition(3)
    assert made(op.remove_repeats(docs, block_bytes=6000, range_bytes=4000, hot_segments=hot_segments)) == brute(rows)


def test_segments_of_a_hot_minimizer_do_not_meet_in_one_range(spark, monkeypatch, tmp_path):
    """The most distinct segments that any range gets: without the split, all neighbours of the passage."""
    plain, log = op._judged, str(tmp_path)

    def counted(length, ranges):
        inner = plain(length, ranges)

        def run(batches):
            import os

            def seen():
                for batch in batches:
                    for row in batch.to_pylist():
                        with open(os.path.join(log, str(row["range"])), "a") as f:
                            f.write(f"{len(row['least']) // 10}\n")
                    yield batch

            return inner(seen())

        return run

    monkeypatch.setattr(op, "_judged", counted)
    rows = edges()
    docs = documents(spark, [(i, t, "en", "a") for i, t in rows]).repartition(3)
    assert made(op.remove_repeats(docs, block_bytes=6000, range_bytes=200, hot_segments=20)) == brute(rows)
    sizes = {p.name: sum(map(int, p.read_text().split())) for p in tmp_path.iterdir()}
    regular = [n for r, n in sizes.items() if int(r) < max(map(int, sizes)) // 2]
    assert max(regular, default=0) < 200 and max(sizes.values()) < 300, sorted(sizes.values())[-5:]


def test_segments_that_are_alone_with_their_minimizer_are_not_merged(monkeypatch):
    blocks = [[t.encode() for _, t in mixed(seed, 25) if len(t) > 50] for seed in (3, 3, 4)]
    shards, all_windows, first_id = [], {}, 0
    for texts in blocks:
        data, ends = b"".join(texts), np.cumsum([len(t) for t in texts])
        first, count, key, doc = op.segments(np.frombuffer(data, np.uint8), ends)
        known, number = op._numbered(data, first, count, 50)
        least, lanes = np.full(len(known), op.NO_ID), np.zeros(len(known), np.uint8)
        np.minimum.at(least, number, doc + first_id)
        lanes[number] = op._lane_of(key)
        shards.append((np.array([len(t) for t in known]), lanes, least, b"".join(known)))
        for text, i in zip(known, least.tolist()):
            for k in range(len(text) - 49):
                all_windows[text[k: k + 50]] = min(all_windows.get(text[k: k + 50], op.NO_ID), i)
        first_id += len(texts)
    merged, earliest = [], op._earliest
    monkeypatch.setattr(op, "_earliest", lambda texts, *a: merged.extend(texts) or earliest(texts, *a))
    answers = op.verdicts(shards, merge_symbols=4000, shard_symbols=1000)
    everything = set()
    for (sizes, _, least, data), answer in zip(shards, answers):
        ends = np.cumsum(sizes).tolist()
        for a, b, i, bits in zip([0, *ends], ends, least.tolist(), answer.tolist()):
            everything.add(data[a:b])
            assert bits == sum(1 << w for w in range(b - a - 49) if all_windows[data[a + w: a + w + 50]] < i)
    least_gram = lambda t: op.grams(np.frombuffer(t[:50], np.uint8)).min()
    of = {t: least_gram(t) for t in everything}
    shared = [m for m in of.values()]
    assert sorted(merged) == sorted(t for t, m in of.items() if shared.count(m) > 1) and 0 < len(merged) < len(everything)
