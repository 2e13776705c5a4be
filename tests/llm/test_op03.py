from __future__ import annotations

import random
import zlib

import public_tokenizers
import pytest

from attestra.llm import op03_packing as op
from attestra.llm.pretokens import tokenizer, word_pretokens, word_runs
from tests.llm.fixtures import ODD, documents

PATH = public_tokenizers.path("word_bpe_49k.json")


def wanted(rows, capacity):
    out = []
    for doc_id, text in rows:
        ids = tokenizer(PATH).encode(text or "", add_special_tokens=False).ids + [0]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            cut = ids[at: at + capacity]
            out.append((doc_id, piece, at, len(cut), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in cut))))
    return sorted(out, key=str)


def checked(made, rows, capacity):
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in made), key=str) == wanted(rows, capacity)
    sequences = {}
    for r in made:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), -(-sum(r["length"] for r in made) // capacity)


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    used, least = checked(op.pack(docs, PATH).collect(), rows, 2048)
    assert used <= least + 1


def test_awkward_rows(spark):
    rows = ODD + [(20, "<|endoftext|> x <|startoftext|>", "en", "a"), (21, "'s 'S don't ½²3 İstanbul ǅ ß", "en", "a")]
    docs = documents(spark, rows)
    used, least = checked(op.pack(docs, PATH, 64).collect(), [(i, t) for i, t, *_ in rows], 64)
    assert used <= 1.1 * least + 1
    assert op.pack(docs.limit(0), PATH).count() == 0


def test_latin_split_is_the_librarys():
    encoder, rng = tokenizer(PATH), random.Random(3)
    alphabet = [chr(c) for c in range(0x180)] + ["'s", "'re", " ", "\n", "  "]
    for _ in range(1500):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 40)))
        split = word_pretokens(text, PATH)
        if split is not None:
            assert [i for p in split for i in encoder.encode(p, add_special_tokens=False).ids] == encoder.encode(text, add_special_tokens=False).ids, text


def test_words_have_the_librarys_ids(monkeypatch):
    """New words are encoded in one text per batch, not one by one, and a worker that forgets gives the same ids."""
    encoder, rng, known = tokenizer(PATH), random.Random(4), op._Encoded(PATH)
    alphabet = [chr(c) for c in range(0x180) if chr(c) != "İ"] + ["'s", "'re", " ", "\n", "  ", "the", "don't", "</w>"]
    given, whole = [], known.whole
    monkeypatch.setattr(known, "whole", lambda texts: given.append(len(texts)) or whole(texts))
    for most in (1_000_000, 500):
        monkeypatch.setattr(op, "REMEMBERED", most)
        given.clear()
        for _ in range(20):
            texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(60)]
            split = [word_runs(t, PATH) for t in texts]
            assert [i.tolist() for i in known.ids(split)] == [encoder.encode(t, add_special_tokens=False).ids for t in texts]
        assert set(given) == {1}
        assert len(known) == len(known.first) == len(known.count)
    known["left by a failed task"], known.new = len(known), ["left by a failed task"]
    assert [i.tolist() for i in known.ids([["the"], [], ["the"]])] == [encoder.encode(t, add_special_tokens=False).ids for t in ("the", "", "the")]
    assert known.ids([]) == []


@pytest.mark.parametrize("seed", range(6))
def test_sweeps_fill_sequences(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 100): rng.randint(1, 50) for _ in range(rng.randint(1, 90))}
    runs = op.sweeps(counts, 100)
    filled, ranks = {}, {}
    for length, rank, n, sequence, offset in runs:
        for k in range(n):
            ranks.setdefault(length, []).append(rank + k)
            filled.setdefault(sequence + k, []).append((offset, length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
    for parts in filled.values():
        ends = [0] + [o + n for o, n in sorted(parts)]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 100


def decreasing(counts, capacity):
    """Best fit decreasing, piece by piece: how many sequences."""
    gaps = []
    for length in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):
        fits = [g for g in gaps if g >= length]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - length)
        else:
            gaps.append(capacity - length)
    return len(gaps)


@pytest.mark.parametrize("low, high, capacity", [(1, 100, 100), (30, 55, 100), (600, 1100, 2048), (1, 12, 100), (90, 100, 100)])
@pytest.mark.parametrize("seed", range(4))
def test_as_few_sequences_as_best_fit_decreasing(low, high, capacity, seed):
    rng = random.Random(seed)
    counts = {}
    for _ in range(rng.randint(1, 600)):
        length = rng.randint(low, high)
        counts[length] = counts.get(length, 0) + 1
    used = {sequence + k for _, _, n, sequence, _ in op.sweeps(counts, capacity) for k in range(n)}
    assert used == set(range(decreasing(counts, capacity)))


def test_sweeps_stay_small_on_many_pieces():
    runs = op.sweeps({length: 1_000_003 * length for length in range(1, 2049)})
    assert len(runs) < 200_000
