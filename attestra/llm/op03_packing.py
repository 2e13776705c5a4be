"""Bulk-synchronous best-fit packing of token sequences."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from attestra.llm.common import materialise, whole_text
from attestra.llm.pretokens import WORD_PATTERN, tokenizer, word_runs

CAPACITY, CLOSING_ID = 2048, 0
#: Words and pre-tokens whose ids a worker process remembers, some 200 bytes each; with more it starts anew at the next batch.
REMEMBERED = 1_000_000
#: Pieces of one length that are numbered in one task.
LANE_ROWS = 50_000
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


class _Encoded(dict):
    """The place of every word and pre-token this worker process has met; the ids of place p are ``count[p]`` ones of ``flat`` from ``first[p]``.

    What is asked for the first time takes the next place and waits in ``new`` for its ids.
    """

    def __init__(self, path: str):
        self.encoder = tokenizer(path)
        vocabulary = self.encoder.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # the ids that end a pre-token
        self.closes[[i for token, i in vocabulary.items() if token.endswith(self.encoder.model.end_of_word_suffix)]] = True
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.first, self.count, self.flat = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype="<u4")

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = place = len(self)
        return place

    def places(self, words: Iterable[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.encoder.encode_batch_fast(texts, add_special_tokens=False)]

    def encoded(self, pretokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct pre-tokens and how many each has: all in one text, cut behind the ids that end one."""
        if not pretokens:
            return np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64)
        ids = self.whole([" ".join(pretokens)])[0]
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(pretokens) or ends[-1] != len(ids):
            each = self.whole(pretokens)
            return np.concatenate(each), np.array([len(e) for e in each])
        return ids, np.diff(ends, prepend=0)

    def gathered(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these places, one after the other, and where each ends; the first end is 0."""
        n = self.count[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        return self.flat[np.arange(ends[-1]) + np.repeat(self.first[at] - ends[:-1], n)], ends

    def hold(self, at: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        self.first[at], self.count[at] = len(self.flat) + np.cumsum(count) - count, count
        self.flat = np.concatenate([self.flat, ids])

    def learn(self) -> None:
        """Give ids to what is new: pre-tokens are encoded, words of several are put together from them."""
        if not self.new:
            return
        before, parts = len(self.first), [WORD_PATTERN.findall(w) for w in self.new]
        several = np.array([k for k, (w, p) in enumerate(zip(self.new, parts)) if p != [w]], dtype=np.int64)
        split = [parts[k] for k in several]
        inside = self.places(chain.from_iterable(split))  # may add pre-tokens to what is new
        one = np.setdiff1d(np.arange(len(self.new)), several, assume_unique=True)
        more = np.zeros(len(self.new), dtype=np.int64)
        self.first, self.count = np.concatenate([self.first, more]), np.concatenate([self.count, more])
        self.hold(before + one, *self.encoded([self.new[k] for k in one]))
        ids, ends = self.gathered(inside)
        self.hold(before + several, ids, np.diff(ends[np.cumsum([0, *map(len, split)])]))
        self.new = []

    def ids(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The ids of each list of words."""
        if self.new or len(self) > REMEMBERED:  # what is new here was left by a task that failed
            self.forget()
        at = self.places(chain.from_iterable(texts))
        self.learn()
        found, ends = self.gathered(at)
        return np.split(found, ends[np.cumsum([len(t) for t in texts])][:-1]) if texts else []


#: By tokenizer file; tasks that follow each other in a worker process go on with what it has encoded.
_KNOWN: dict[str, _Encoded] = {}


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path not in _KNOWN:
            _KNOWN[path] = _Encoded(path)
        known = _KNOWN[path]

        def ids(texts: list[str]) -> list[bytes]:
            split = [word_runs(t, path) for t in texts]
            looked_up = iter(known.ids([s for s in split if s is not None]))
            whole = iter(known.whole([t for t, s in zip(texts, split) if s is None]))
            return [next(whole if s is None else looked_up).tobytes() for s in split]

        close, step = np.array([CLOSING_ID], dtype="<u4").tobytes(), 4 * capacity
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                out: list[list] = [[], [], [], [], []]
                for doc_id, data in zip(part.column(0).to_pylist(), ids(part.column(1).to_pylist())):
                    data += close
                    for piece, at in enumerate(range(0, len(data), step)):
                        cut = data[at: at + step]
                        for column, value in zip(out, (doc_id, piece, at // 4, len(cut) // 4, zlib.crc32(cut))):
                            column.append(value)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """The documents' ids, each closed by one id, cut where longer than ``capacity``: doc_id, piece, start, length, ids_crc32."""
    return docs.select(F.col("doc_id").cast("long"), whole_text(F.col("text"))).mapInArrow(_pieces(path, capacity), PIECE)


def sweeps(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best fit decreasing over length classes: runs ``(length, first_rank, rows, first_sequence, offset)``.

    Pieces of one length are alike, so a corpus of any size is at most
    ``capacity`` classes, and sequences with equal gaps form runs; a step adds
    at most three runs. Lengths are swept in descending order. All pieces of a
    length look for their successor at once: the smallest gap that holds them.
    Where they want the same gaps, rank decides: the first ranks take the first
    sequences, each as many pieces as its gap holds, for what is left of it
    would be the smallest fitting gap again. Then the gaps are updated and the
    rest of the length repeats with the next gap. Only when no gap holds the
    length are sequences opened, as few as its pieces need.
    """
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> runs of (first sequence, how many)
    in_use: list[int] = []  # the gaps that have runs, ascending
    opened, placed = 0, []

    def give(gap: int, first: int, n: int) -> None:
        if gap and n:
            if not gaps[gap]:
                insort(in_use, gap)
            gaps[gap].append((first, n))

    for length in sorted((length for length, n in counts.items() if n), reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(in_use, length)
            if at == len(in_use):
                new = -(-left // (capacity // length))
                give(capacity, opened, new)
                opened += new
                continue
            gap = in_use[at]
            first, there = gaps[gap].pop()
            if not gaps[gap]:
                del in_use[at]
            holds, filled = gap // length, capacity - gap
            full = min(there, left // holds)
            last = min(left - full * holds, holds - 1) if there > full else 0  # the rest of the length, in one more sequence
            for sequence, n, pieces_each in ((first, full, holds), (first + full, 1, last)):
                if n:
                    placed += [(length, rank + k * n, n, sequence, filled + k * length) for k in range(pieces_each)]
                    rank, left = rank + n * pieces_each, left - n * pieces_each
            give(gap - holds * length, first, full)
            used = full + (last > 0)
            if last:
                give(gap - last * length, first + full, 1)
            give(gap, first + used, there - used)
    return placed


def _placed(runs: np.ndarray):
    """Look up the run that holds each (length, rank)."""
    keys = runs[:, 0] * (1 << 44) + runs[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = np.asarray(batch.column(3)), np.asarray(batch.column(5))
            at = np.searchsorted(keys, length * (1 << 44) + rank, side="right") - 1
            sequence, offset = runs[at, 3] + rank - runs[at, 1], runs[at, 4]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: PIECE, sequence_id, offset. Every sequence is gapless from 0 and at most ``capacity`` long.

    Pieces are ranked within their length by lanes: a lane is some tens of
    thousands of pieces of one length, so a length that a third of all pieces
    have is many lanes. The counts per length, at most ``capacity`` numbers, are
    all that the sweeps need; their runs are bounded by the capacity too, not by
    the corpus, and every piece finds its sequence by its rank. A null or empty
    text is the closing id alone; repeated rows are packed each; no documents
    give no rows.
    """
    made = materialise(pieces(docs, path, capacity), "pieces")
    counts = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    lanes = max(1, -(-sum(counts.values()) // LANE_ROWS))
    dealt = made.withColumn("_lane", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(lanes)))
    sizes = dealt.groupBy("length", "_lane").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("length").orderBy("_lane").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(F.col("length").alias("_l"), F.col("_lane").alias("_b"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_lane").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = dealt.withColumn("_nth", F.row_number().over(inside) - 1).join(before, (F.col("length") == F.col("_l")) & (F.col("_lane") == F.col("_b")))
    runs = np.array(sorted(sweeps(counts, capacity)), dtype=np.int64).reshape(-1, 5)
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("_nth")).cast("long")).mapInArrow(
        _placed(runs), PIECE + ", sequence_id long, offset long")
