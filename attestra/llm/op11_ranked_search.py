"""Ranked lexical search by sequential reads of impact-sorted lists (NRA).

Documents are gathered in shards as they are read. A shard holds, for each term
asked for, the list of its documents by falling impact. A first read of every
list's head gives each item a score that its results must reach, over all
shards; then each shard reads on. Lists are read in turn and in order, never by
document: a document's score lies between what was read of it and that plus
what the lists not yet seen to hold it can still give.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from attestra.llm.common import materialise, whole_text

LIMIT = 10
#: A shard is closed at so many documents, or so many entries in its lists.
SHARD_DOCS, SHARD_ENTRIES = 8192, 1 << 20
#: Entries read of each list at first; every further read is twice as long.
FIRST = 64
#: (item, term) pairs that travel to the tasks at once; more items are answered in several blocks.
BLOCK_TERMS = 200_000
#: Bytes of UTF-8: ASCII letters in lower case, digits and everything beyond ASCII stay, all else separates terms.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SHARD = "filled long, terms long, ids array<long>, lengths binary, starts binary, docs binary, often binary"
LISTS = "ids array<long>, starts binary, docs binary, impacts binary, heads array<struct<item:int,score:long>>"


def terms(text: str) -> list[bytes]:
    """The terms of a text in their order, as UTF-8."""
    return text.encode().translate(FOLD).split()


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, item, text in zip(*[c.to_pylist() for c in batch.columns]):
            found, times = np.unique(np.array(terms(text), dtype=object), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([row] * len(found), pa.int64()), pa.array([item] * len(found), pa.int64()), pa.array(list(found), pa.binary()),
                                              pa.array(times, pa.int64())], names=["row", "item_id", "term", "times"])


def _shards(known: dict[bytes, int], most_docs: int, most_entries: int):
    """Shards of (doc_id, text): the lists of the known terms, each in order of its documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, keys, often, entries = [], [], [], [], 0

        def shard() -> pa.RecordBatch:
            key, times = np.concatenate([np.zeros(0, np.int64), *keys]), np.concatenate([np.zeros(0, np.int64), *often])
            doc = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
            order = np.argsort(key, kind="stable")
            starts = np.searchsorted(key[order], np.arange(len(known) + 1))
            n = np.array(lengths, dtype=np.int64)
            columns = [pa.array([int((n > 0).sum())]), pa.array([int(n.sum())]), pa.array([ids], pa.list_(pa.int64())), pa.array([n.tobytes()], pa.binary()),
                       pa.array([starts.astype("<i4").tobytes()], pa.binary()), pa.array([doc[order].astype("<u4").tobytes()], pa.binary()),
                       pa.array([times[order].tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["filled", "terms", "ids", "lengths", "starts", "docs", "often"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                found = terms(text.as_py())
                here = np.fromiter((k for k in map(known.get, found) if k is not None), np.int64)
                here, times = np.unique(here, return_counts=True)
                ids.append(doc_id.as_py())
                lengths.append(len(found))
                keys.append(here)
                often.append(times.astype(np.int64))
                entries += len(here)
                if len(ids) >= most_docs or entries >= most_entries:
                    yield shard()
                    ids, lengths, keys, often, entries = [], [], [], [], 0
        if ids:
            yield shard()

    return run


def _holders(n: int):
    """How many documents of a task's shards hold each term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, dtype=np.int64)
        for batch in batches:
            for starts in batch.column(0):
                total += np.diff(np.frombuffer(starts.as_py(), "<i4"))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "holders"])

    return run


Item = tuple[np.ndarray, np.ndarray]


def _lists(items: list[Item], n_docs: int, n_terms: int, limit: int, first: int):
    """Lists sorted by falling impact, and the best lower bounds that each item gets from the heads of its lists."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, lengths, starts, docs, often in zip(*batch.columns):
                lengths, often = np.frombuffer(lengths.as_py(), np.int64), np.frombuffer(often.as_py(), np.int64)
                starts, docs = np.frombuffer(starts.as_py(), "<i4").astype(np.int64), np.frombuffer(docs.as_py(), "<u4").astype(np.int64)
                damp = 25 + (75 * lengths * n_docs) // max(n_terms, 1)
                impacts = (1_000_000_000 * often) // (1000 * often + 8 * damp[docs])
                order = np.lexsort((-impacts, np.repeat(np.arange(len(starts) - 1), np.diff(starts))))
                docs, impacts = docs[order], impacts[order]
                heads = []
                for item, (which, weight) in enumerate(items):
                    lower = np.zeros(len(lengths), dtype=np.int64)
                    for a, b, w in zip(starts[which], np.minimum(starts[which + 1], starts[which] + first), weight):
                        lower[docs[a:b]] += w * impacts[a:b]
                    best = lower if len(lower) <= limit else np.partition(lower, -limit)[-limit:]
                    heads += [{"item": item, "score": s} for s in best[best > 0].tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids.as_py()], pa.list_(pa.int64())), pa.array([starts.astype("<i4").tobytes()], pa.binary()), pa.array([docs.astype("<u4").tobytes()], pa.binary()),
                     pa.array([impacts.astype("<i4").tobytes()], pa.binary()), pa.array([heads], pa.list_(pa.struct([("item", pa.int32()), ("score", pa.int64())])))],
                    names=["ids", "starts", "docs", "impacts", "heads"])

    return run


def no_random_access(lists: list[Item], weights: np.ndarray, n: int, limit: int, least: int, first: int = FIRST) -> Item:
    """Documents and their exact scores: all that can be among the ``limit`` best of ``n``, with a score of at least ``least``.

    ``lists`` hold (documents, impacts) by falling impact; an entry adds its
    impact times the list's weight. All lists are read to the same depth, in
    reads of doubling length. What a list can still give is its last impact
    read. The score to reach is the greatest of ``least`` and the limit-th best
    lower bound. Reading goes on until no document unseen so far can reach it,
    and every document that can has a lower bound equal to its upper one.
    """
    lower, seen = np.zeros(n, dtype=np.int64), np.zeros((len(lists), n), dtype=bool)
    rest = np.zeros(len(lists), dtype=np.int64)
    start, depth, left = 0, first, None
    while True:
        for j, (docs, impacts) in enumerate(lists):
            some, here = docs[start: start + depth], impacts[start: start + depth]
            lower[some] += weights[j] * here
            seen[j, some] = True
            rest[j] = weights[j] * here[-1] if start + depth < len(docs) else 0
        start, depth = start + depth, 2 * depth
        if n >= limit:
            least = max(least, int(np.partition(lower, -limit)[-limit]))
        if left is None and rest.sum() < least:  # an unseen document cannot reach the score any more
            left = np.flatnonzero(lower)
        if left is not None:
            upper = lower[left] + rest @ ~seen[:, left]
            able = upper >= least
            left, upper = left[able], upper[able]
            if (upper == lower[left]).all():
                return left, lower[left]


def _best(items: list[Item], least: dict[int, int], limit: int, first: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, starts, docs, impacts in zip(*batch.columns):
                names = ids.values.to_numpy(zero_copy_only=False)
                missing = np.asarray(ids.values.is_null())
                starts, docs = np.frombuffer(starts.as_py(), "<i4").astype(np.int64), np.frombuffer(docs.as_py(), "<u4").astype(np.int64)
                impacts = np.frombuffer(impacts.as_py(), "<i4").astype(np.int64)
                found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for item, (which, weight) in enumerate(items):
                    held = [(docs[a:b], impacts[a:b]) for a, b in zip(starts[which], starts[which + 1])]
                    some, score = no_random_access(held, weight, len(names), limit, max(least.get(item, 1), 1), first)
                    order = np.lexsort((names[some], missing[some], -score))[:limit]
                    found.append((np.full(len(order), item), some[order], score[order]))
                item, some, score = (np.concatenate([f[k] for f in found]) for k in range(3)) if found else (np.zeros(0, np.int64),) * 3
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), ids.values.take(pa.array(some)), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    return run


def _answer(docs: DataFrame, rows: list, limit: int, shard_docs: int, shard_entries: int, first: int) -> DataFrame:
    """``row, doc_id, score`` for the (row, term, times) of one block of items, with some rows over the limit."""
    spark = docs.sparkSession
    names = sorted({bytes(r["term"]) for r in rows})
    known = {t: i for i, t in enumerate(names)}
    shards = materialise(docs.mapInArrow(_shards(known, shard_docs, shard_entries), SHARD), "search-shards")
    filled, all_terms = shards.agg(F.coalesce(F.sum("filled"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    held = shards.select("starts").mapInArrow(_holders(len(names)), "term long, holders long").groupBy("term").agg(F.sum("holders").alias("holders"))
    # a row per term of the block
    holders = {r["term"]: r["holders"] for r in held.collect()}
    weights = {t: math.floor(1000 * math.log((2 * filled + 2) / (2 * holders[k] + 1))) for t, k in known.items() if k in holders}
    parts: dict[int, list[tuple[int, int]]] = {}
    for r in rows:
        if weights.get(bytes(r["term"]), 0) > 0:
            parts.setdefault(r["row"], []).append((known[bytes(r["term"])], weights[bytes(r["term"])] * r["times"]))
    order = sorted(parts)
    items = [(np.array([t for t, _ in parts[r]], dtype=np.int64), np.array([w for _, w in parts[r]], dtype=np.int64)) for r in order]
    lists = materialise(shards.select("ids", "lengths", "starts", "docs", "often").mapInArrow(_lists(items, filled, all_terms, limit, first), LISTS), "search-lists")
    best = Window.partitionBy("item").orderBy(F.col("score").desc())
    heads = lists.select(F.inline("heads")).withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= limit)
    # a row per item of the block
    least = {r["item"]: r["least"] for r in heads.groupBy("item").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == limit).collect()}
    made = lists.select("ids", "starts", "docs", "impacts").mapInArrow(_best(items, least, limit, first), "item int, doc_id long, score long")
    numbers = spark.createDataFrame(list(enumerate(order)), "_item int, row long")
    return made.join(F.broadcast(numbers), F.col("item") == F.col("_item")).select("row", "doc_id", "score")


def search(
    docs: DataFrame, items: DataFrame, limit: int = LIMIT, shard_docs: int = SHARD_DOCS, shard_entries: int = SHARD_ENTRIES,
    first: int = FIRST, block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's best documents with a score above 0, equal scores by doc_id, null last.

    Terms, weights and scores are those of whole texts and all documents; the
    arithmetic is in 64-bit integers. A null or empty text has no terms: such
    documents do not count, such items have no rows. Every row of ``docs`` is a
    document and every row of ``items`` an item of its own, repeated ones too
    (their rows come out once for each); null ids are kept. Other columns are
    not read. No items or no documents give no rows. Items go in blocks of some
    ``block_terms`` terms, so that what travels to the tasks is bounded.
    """
    texts = docs.select(F.col("doc_id").cast("long"), whole_text(F.col("text")))
    numbered = items.select(F.monotonically_increasing_id().alias("row"), F.col("item_id").cast("long"), whole_text(F.col("text")))
    asked = materialise(numbered.mapInArrow(_asked, "row long, item_id long, term binary, times long"), "search-items")
    blocks = max(1, -(-asked.count() // block_terms))
    answer: Callable[[int], DataFrame] = lambda b: _answer(
        texts, asked.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).select("row", "term", "times").collect(), limit, shard_docs, shard_entries, first)
    found = reduce(DataFrame.unionByName, [answer(b) for b in range(blocks)])
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    names = asked.select(F.col("row").alias("_row"), "item_id").distinct()
    return ranked.join(names, F.col("row") == F.col("_row")).select("item_id", "rank", "doc_id", "score")
