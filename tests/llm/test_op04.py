from __future__ import annotations

import numpy as np

from attestra.llm import op04_fuzzy_lines as op
from tests.llm.fixtures import ODD, documents


def brute(rows, least=op.SIMILARITY):
    """Exact connected components over all pairs of distinct lines."""
    places = [(i, k, t.replace("\t", " ").replace("\r", " ").strip(" ").lower()) for i, text in rows for k, t in enumerate((text or "").split("\n"))]
    names = sorted({t for _, _, t in places if t})
    parent = {t: t for t in names}

    def find(t):
        while parent[t] != t:
            t = parent[t]
        return t

    sets = {t: op.shingles(t) for t in names}
    for x, a in enumerate(names):
        for b in names[:x]:
            if len(a) >= op.SHINGLE and len(b) >= op.SHINGLE and op.similar(sets[a], sets[b], least):
                parent[find(a)] = find(b)
    first, dropped = {}, {i: [] for i, _ in rows}
    for i, k, t in sorted(places):
        if t:
            if first.setdefault(find(t), (i, k)) != (i, k):
                dropped[i].append(k)
    return dropped


def varied(seed: int, n: int):
    rng = np.random.default_rng(seed)
    words = np.array("the mill stood by river corn ground flood wheel away since nobody old again water stone grain house road hill".split())
    base = [" ".join(rng.choice(words, rng.integers(6, 30))) for _ in range(40)]
    rows = []
    for i in range(n):
        lines = []
        for _ in range(rng.integers(1, 6)):
            line = base[rng.integers(0, 40)].split()
            for _ in range(rng.integers(0, 3)):
                line[rng.integers(0, len(line))] = str(rng.choice(words))
            lines.append(" ".join(line))
        rows.append((i, "\n".join(lines)))
    return rows


def joined(edges, nodes, roots):
    """Which nodes are together by the edges and their roots."""
    group = {n: {n} | {m for m, r in zip(nodes, roots) if r == q} for n, q in zip(nodes, roots)}
    for a, b in edges:
        both = group[a] | group[b]
        for n in both:
            group[n] = both
    return {frozenset(g) for g in group.values()}


def test_latin_lines_are_compared_as_numbers():
    texts = sorted({line for _, t in varied(5, 60) for line in t.split("\n") if len(line) >= op.SHINGLE} | {"é" * 9, "\x00" * 8, "\x00" * 9, "ÿ" * 30, "abcdefgh"})
    sets, numbers = [op.shingles(t) for t in texts], [op.latin_shingles(t) for t in texts]
    assert [len(x) for x in numbers] == [len(x) for x in sets]
    assert op.latin_shingles("short") is None and op.latin_shingles("longer than eight — yes") is None
    for a, x in zip(sets, numbers):
        for b, y in zip(sets, numbers):
            assert op.similar(a, b, 0.8) == op.alike(x, y, 0.8)
    nodes = list(range(100, 100 + len(texts)))
    for roots in (nodes, [n - n % 7 for n in nodes]):
        edges = op.latin_forest(nodes, numbers, roots, 0.8)
        wanted = op.forest(nodes, sets, roots, 0.8)
        assert joined(edges, nodes, roots) == joined(wanted, nodes, roots) and len(edges) == len(wanted)


def test_shingles_beyond_one_block_are_all_compared(monkeypatch):
    monkeypatch.setattr(op, "COLUMNS", 3)
    texts = ["the old mill stood by the river", "the old mill stood by the rivers", "nobody had ground corn there", "nobody had ground corn there!"]
    assert op.latin_forest([1, 2, 3, 4], [op.latin_shingles(t) for t in texts], [1, 2, 3, 4], 0.8) == [(1, 2), (3, 4)]


def test_lines_beyond_latin(spark):
    rows = [(1, "the old mill — stood by the river there\nthe old mill stood by the river there"), (2, "the old mill — stood by the river there!\nthe old mill stood by the river there!"),
            (3, "старая мельница стояла у реки с тех пор\nстарая мельница стояла у реки с тех пор!")]
    made = {r["doc_id"]: r["dropped"] for r in op.line_decisions(documents(spark, [(i, t, "en", "a") for i, t in rows])).collect()}
    assert made == brute(rows)


def test_components_equal_brute_force(spark):
    rows = varied(3, 150)
    docs = documents(spark, [(i, t, "en", "a") for i, t in rows])
    made = {r["doc_id"]: r["dropped"] for r in op.line_decisions(docs, bands=20, chunk=5).collect()}
    assert made == brute(rows)


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    made = {r["doc_id"]: r["dropped"] for r in op.line_decisions(docs).collect()}
    wanted = brute(rows)
    assert made.keys() == wanted.keys()
    assert sum(made[i] == wanted[i] for i in made) >= 0.99 * len(made)
    assert all(set(made[i]) <= set(wanted[i]) for i in made)


def test_awkward_rows(spark):
    rows = ODD + [(30, "same line here\n\nSAME line here\nshort\nshort\r\n", "en", "a")]
    docs = documents(spark, rows)
    made = op.line_decisions(docs).collect()
    assert len(made) == len(rows)
    got = {}
    for r in made:
        got.setdefault(r["doc_id"], []).append((r["n_lines"], r["dropped"]))
    assert got[30] == [(6, [2, 4])] and got[5] == [(1, [])] and got[1] == [(1, [])] and got[3] == [(1, [0])]
    assert got[2] == [(1, [0]), (1, [0])] and got[9] == [(1, [0])]
    kept = op.drop_lines(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    assert [r["text"] for r in kept.filter("doc_id = 30").collect()] == ["same line here\n\nshort\n"]
    assert op.line_decisions(docs.limit(0)).count() == op.drop_lines(docs.limit(0)).count() == 0
