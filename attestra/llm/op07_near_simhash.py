"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are compared within blocks that share some of their bits. A block
is stored as bit planes: plane b holds bit b of 64 fingerprints in each 64-bit
word. One comparison of a fingerprint with a word of a plane is one XOR; the
distances of all 64 lanes are counted at once by carry-save adders, and a word
is abandoned as soon as all its lanes exceed the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from attestra.llm.common import free_name, materialise, partitions, whole_text, words
from attestra.llm.components import components
from attestra.llm.simhash import fingerprints

RADIUS, BLOCKS, CHUNK = 4, 6, 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def tokens(text: Column) -> Column:
    return words(F.translate(whole_text(text), UPPER, LOWER))


def tables(radius: int, blocks: int) -> list[int]:
    """Masks of ``blocks - radius`` of ``blocks`` equal parts of 64 bits: two codes within the radius agree under one of them."""
    if not radius < blocks <= 64:
        raise ValueError("more blocks than the radius are needed")
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [reduce(int.__or__, chosen) for chosen in combinations(parts, blocks - radius)]


def planes(codes: np.ndarray) -> np.ndarray:
    """64 bit planes over the codes, 64 lanes to a word; missing lanes are zero."""
    padded = np.zeros(-(-max(len(codes), 1) // 64) * 64, dtype="<u8")
    padded[: len(codes)] = codes
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def lanes_within(plane: np.ndarray, codes: np.ndarray, at: np.ndarray, radius: int) -> np.ndarray:
    """For each code, the lanes of plane word ``at`` whose distance is at most ``radius``, as bits of a word.

    Counts in carry-save form: bit-sliced counters, one word per binary digit,
    for 64 lanes at once. The digit beyond the counters is sticky. Rows whose
    lanes have all gone beyond the radius are dropped every eight planes.
    """
    digits = max(1, int(radius).bit_length())
    alive = np.arange(len(codes))
    out = np.zeros(len(codes), dtype=np.uint64)
    count = [np.zeros(len(codes), dtype=np.uint64) for _ in range(digits)]
    over = np.zeros(len(codes), dtype=np.uint64)
    for first in range(0, 64, 8):
        mine, where = codes[alive], at[alive]
        for b in range(first, first + 8):
            carry = plane[b, where] ^ (np.uint64(0) - ((mine >> np.uint64(b)) & np.uint64(1)))
            for d in range(digits):
                count[d], carry = count[d] ^ carry, count[d] & carry
            over |= carry
        beyond = over | _above(count, radius)
        left = beyond != ONES
        if not left.all():
            alive, over, count = alive[left], over[left], [c[left] for c in count]
            beyond = beyond[left]
        if not len(alive):
            return out
    out[alive] = ~beyond
    return out


def _above(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose bit-sliced count is greater than the radius."""
    greater, equal = np.zeros_like(count[0]), np.full_like(count[0], ONES)
    for d in reversed(range(len(count))):
        if radius >> d & 1:
            equal = equal & count[d]
        else:
            greater, equal = greater | (equal & count[d]), equal & ~count[d]
    return greater


def links(codes: np.ndarray, last: np.ndarray, radius: int) -> np.ndarray:
    """``label`` per code: the least position linked to it through codes of its own run.

    ``last`` is the position of the last code of each code's run; a code is
    compared with the words from its own to that one. Lanes of other runs in
    those words may link too, which is right: every link is checked in full.
    """
    plane, position = planes(codes), np.arange(len(codes))
    label = position.copy()
    first, final = position // 64, last // 64
    for step in range(int((final - first).max(initial=0)) + 1):
        asking = np.flatnonzero(first + step <= final)
        for part in np.array_split(asking, -(-len(asking) // 65536)):
            word = first[part] + step
            found = lanes_within(plane, codes[part], word, radius)
            hit = np.flatnonzero(found)
            if not len(hit):
                continue
            lanes = np.unpackbits(found[hit].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, lane = np.nonzero(lanes)
            i, j = part[hit[row]], word[hit[row]] * 64 + lane
            ahead = (j > i) & (j < len(codes))
            label = _join(label, i[ahead], j[ahead])
    return label


def _join(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Union of linked positions: hang the larger root on the smaller and shorten paths until nothing changes."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            break
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            shorter = label[label]
            if (shorter == label).all():
                break
            label = shorter
    return label


def _compare(radius: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def linked(rows: np.ndarray) -> pa.RecordBatch:
            codes = rows[:, -1].view(np.uint64)
            new = np.r_[True, (rows[1:, :-1] != rows[:-1, :-1]).any(axis=1)]
            run_of = np.cumsum(new) - 1
            last = np.r_[np.flatnonzero(new)[1:] - 1, len(rows) - 1][run_of]
            label = links(codes, last, radius)
            moved = np.flatnonzero(label != np.arange(len(label)))
            pairs = np.unique(np.stack([codes[moved].view(np.int64), codes[label[moved]].view(np.int64)], axis=1), axis=0)
            pairs = pairs[pairs[:, 0] != pairs[:, 1]]
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            rows = np.stack([np.asarray(c, dtype=np.int64) for c in batch.columns], axis=1)
            held.append(rows)
            if sum(map(len, held)) >= 16 * chunk:
                rows = np.concatenate(held)
                start = np.flatnonzero((rows[1:, :-1] != rows[:-1, :-1]).any(axis=1))
                cut = start[-1] + 1 if len(start) else 0
                if cut:
                    yield linked(rows[:cut])
                held = [rows[cut:]]
        if held and sum(map(len, held)):
            yield linked(np.concatenate(held))

    return run


def near_links(codes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """Edges ``(a, b)`` that connect all distinct fingerprints ``code`` within the radius, directly or through others.

    Every block table is dealt by its masked value. A bucket beyond ``chunk``
    codes is dealt into parts, and each pair of parts is compared on its own, so
    no bucket meets in one task and no comparison is left out. Of each run only
    a forest of its links leaves the task, never all pairs.
    """
    masks = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in tables(radius, blocks)])
    dealt = codes.select("code", F.posexplode(masks).alias("table", "_mask")).select(
        F.col("table").cast("long").alias("table"), F.col("code").bitwiseAND(F.col("_mask")).alias("key"), "code")
    sizes = dealt.groupBy("table", "key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(
        F.col("table").alias("_t"), F.col("key").alias("_k"), F.ceil(F.col("_n") / chunk).cast("long").alias("_parts"))
    met = dealt.join(sizes, (F.col("table") == F.col("_t")) & (F.col("key") == F.col("_k")))
    own = F.pmod(F.xxhash64("code"), F.col("_parts"))
    parts = met.select("table", "key", "code", own.alias("_own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_other"))
    runs = parts.select("table", "key", F.least("_own", "_other").alias("low"), F.greatest("_own", "_other").alias("high"), "code")
    where = ["table", "key", "low", "high"]
    return runs.repartition(partitions(codes.sparkSession), *where).sortWithinPartitions(*where).mapInArrow(_compare(radius, chunk), "a long, b long")


def near_groups(docs: DataFrame, width: int = 4, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """One row per document: doc_id, ``code`` (its fingerprint as a long), ``component_id`` and ``root``.

    ``component_id`` is the least doc_id of the component of fingerprints linked
    within the radius, ``root`` the component's least fingerprint. A null or
    empty text has fingerprint zero and links like any other; equal fingerprints
    always link. Repeated rows give repeated rows; null ids are passed over, and
    a component with no other has a null id. No documents give no rows.
    ``content`` is a hash that tells the texts of one doc_id apart.
    """
    text = whole_text(F.col("text"))
    rows = docs.select("doc_id", text.alias("_text"), F.xxhash64(text, F.length(text)).alias("content")).withColumn("_row", F.monotonically_increasing_id())
    coded = fingerprints(rows, tokens(F.col("_text")), width, ["_row", "doc_id", "content"]).withColumnRenamed("fingerprint", "code")
    coded = materialise(coded.drop("_row"), "codes")
    codes = coded.groupBy("code").agg(F.min("doc_id").alias("least"))
    rooted = components(near_links(codes.select("code"), radius, blocks))
    named = codes.join(rooted, codes["code"] == rooted["node"], "left").select("code", "least", F.coalesce("root", "code").alias("root"))
    first = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = materialise(named.join(first, "root").select(F.col("code").alias("_code"), "component_id", "root"), "classes")
    return coded.join(classes, F.col("code") == F.col("_code")).select("doc_id", "content", "code", "component_id", "root")


def keep_one(docs: DataFrame, width: int = 4, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """The documents with one row of each component: the least doc_id, null last; ties by content; any of repeated rows.

    All columns stay, whatever their names.
    """
    grouped = near_groups(docs, width, radius, blocks)
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("content").alias("c"))
    keep_id, keep_content, nth = (free_name(docs, name) for name in ("__keep_id", "__keep_content", "__nth"))
    chosen = grouped.groupBy("root").agg(F.min(order).alias("k")).select(F.col("k.i").alias(keep_id), F.col("k.c").alias(keep_content))
    text = whole_text(docs["text"])
    content = F.xxhash64(text, F.length(text))
    met = docs.join(chosen, docs["doc_id"].eqNullSafe(chosen[keep_id]) & (content == chosen[keep_content]))
    same = Window.partitionBy(keep_id, keep_content).orderBy(F.lit(0))
    return met.withColumn(nth, F.row_number().over(same)).filter(F.col(nth) == 1).select(*[docs[c] for c in docs.columns])
