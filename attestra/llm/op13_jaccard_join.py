"""Jaccard join of word shingles over index lists that are skipped by position, with answers derived from similar sets.

Every set lists its rarest shingles, so two similar sets meet in a list. A list
is cut into blocks of sets of one size, in order of position: the first entry of
a block that comes too late to leave enough in common ends the block. A set that
is highly similar to another, its leader, is not compared anew with what the
leader was compared with: the leader's overlap bounds its own, and where that is
not enough only the few shingles in which it differs from the leader are looked up.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from attestra.llm.common import discard, materialise, partitions, whole_text
from attestra.llm.components import components

WIDTH = 4
#: Similarity as a fraction, in integers.
OVER, UNDER = 85, 100
#: Sets of a list, members or partners of a leader, that one task meets at once; more are dealt into parts.
CHUNK, SIDE = 2048, 256
#: Shingles for each counter of the table that tells rare from frequent; the table has at most LARGEST_TABLE counters.
PER_COUNTER, LARGEST_TABLE, COUNTER_BLOCK = 128, 1 << 24, 1 << 16
FOLD = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint8)
MIX = np.uint64(0xBF58476D1CE4E5B9)


#: Two polynomials over bytes, modulo 2**64, name a word; mixed, they name a shingle.
_RNG = np.random.default_rng(20250303)
BYTES = _RNG.integers(1, 1 << 63, (2, 256), dtype=np.uint64)
BASES = [int(b) * 2 + 1 for b in _RNG.integers(1 << 61, 1 << 62, 2)]
TURNS = _RNG.integers(1 << 61, 1 << 62, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes whose sums are kept at once; a longer word is summed whole.
SPAN = 1 << 20
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, base, dtype=np.uint64))])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word ``data[start:end]``, from sums over spans of some words."""
    out, first = np.empty(len(starts), dtype=np.uint64), 0
    while first < len(starts):
        last = max(int(np.searchsorted(ends, starts[first] + SPAN, side="right")), first + 1)
        low, high = int(starts[first]), int(ends[last - 1])
        size = 1 << max(SPAN - 1, high - low).bit_length()
        both = []
        for table, base in zip(BYTES, BASES):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[data[low:high]] * _powers(base, size)[: high - low])])
            back = _powers(pow(base, -1, 1 << 64), size)
            both.append((sums[ends[first:last] - low] - sums[starts[first:last] - low]) * back[starts[first:last] - low])
        out[first:last] = _mixed(both[0] ^ _mixed(both[1]))
        first = last
    return out


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; fewer words are one shingle, none gives none."""
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset: texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0]: bounds[-1]]
    bounds = bounds - bounds[0]
    data = FOLD[raw]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[bounds] = True
    blank = np.concatenate([[True], SPACE[data], [True]])
    starts = np.flatnonzero(~blank[1:-1] & (blank[:-2] | edge[:-1]))
    ends = np.flatnonzero(~blank[1:-1] & (blank[2:] | edge[1:])) + 1
    h = word_hashes(data, starts, ends)
    cuts = np.searchsorted(starts, bounds)
    grams = np.full(max(len(h) - width + 1, 0), width, dtype=np.uint64)
    for k in range(width):
        grams += h[k: k + len(grams)] * TURNS[k % 8]
    grams, out = _mixed(grams), []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if 0 < b - a < width:
            out.append(_mixed(np.array([(b - a + sum(int(h[a + k]) * int(TURNS[k % 8]) for k in range(b - a))) & ((1 << 64) - 1)], dtype=np.uint64)))
            continue
        found = np.sort(grams[a: max(b - width + 1, a)])
        out.append(found[np.concatenate([[True], found[1:] != found[:-1]])] if len(found) else found)
    return out


def needed(n, m):
    """The least overlap of similar sets of n and m shingles."""
    return -((-OVER * (n + m)) // (OVER + UNDER))


def prefix(n: int) -> int:
    """How many of a set's n shingles, in any one order for all sets, include one of every similar set's own such shingles."""
    return n - -((-OVER * n) // UNDER) + 1


def _sketch(width: int, counters: int):
    """Size and digest of every set; at the end of a task its counts of shingles by counter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(counters, dtype=np.uint32)
        names = ["row", "size", "digest", "block", "counts"]
        for batch in batches:
            sets = shingle_sets(batch.column(1), width)
            np.add.at(counts, (np.concatenate([np.zeros(0, np.uint64), *sets]) & np.uint64(counters - 1)).astype(np.int64), np.uint32(1))
            n = batch.num_rows
            digests = pa.array([blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int32()), digests, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        for block, part in enumerate(np.split(counts, range(COUNTER_BLOCK, counters, COUNTER_BLOCK))):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.array([block], pa.int32()),
                                                  pa.array([part.astype("<u4").tobytes()], pa.binary())], names=names)

    return run


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (block, counts) in order of blocks: each counter's sum as a level, four to an octave."""
    at, total = None, None

    def emit() -> pa.RecordBatch:
        level = np.floor(4 * np.log2(np.maximum(total, 1))).astype(np.uint8)
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["block", "levels"])

    for batch in batches:
        for block, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
            if block != at:
                if at is not None:
                    yield emit()
                at, total = block, 0
            total = total + np.frombuffer(counts.as_py(), "<u4").astype(np.int64)
    if at is not None:
        yield emit()


def _prefixes(width: int, levels: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.uint64(len(levels) - 1)
        for batch in batches:
            first, sizes = [], []
            for h in shingle_sets(batch.column(1), width):
                sizes.append(len(h))
                first.append(h[np.argsort(levels[(h & mask).astype(np.int64)], kind="stable")][: prefix(len(h))])
            ends = np.cumsum([0] + [len(f) for f in first], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *first]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), lists], names=["node", "size", "tokens"])

    return run


def _similar_pairs(width: int):
    """The ``a, b`` of (a, b, text of a, text of b) whose sets are similar."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met = zip(shingle_sets(batch.column(2), width), shingle_sets(batch.column(3), width))
            near = pa.array([common(x, y) >= needed(len(x), len(y)) for x, y in met], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near)], names=["a", "b"])

    return run


def meetings(run: np.ndarray, size: np.ndarray, position: np.ndarray, root: np.ndarray, most: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (x, y) of entries of one run and different roots that may be similar, from entries in order of run, size and position.

    A block holds the entries of one run and size. An entry looks at the blocks
    of sizes that similar sets can have, its own last; in each, the entries up
    to the position that still leaves the needed overlap.
    """
    new = np.concatenate([[True], (run[1:] != run[:-1]) | (size[1:] != size[:-1])])
    block, start = np.cumsum(new) - 1, np.flatnonzero(new)
    width = np.int64(1) << 32
    where = run[start] * width + size[start]
    place = block * width + position
    low = np.searchsorted(where, run * width + -((-OVER * size) // UNDER))
    looks = block - low + 1
    for first, last in _slices(looks, most):
        x = np.repeat(np.arange(first, last), looks[first:last])
        b = np.repeat(low[first:last] - np.concatenate([[0], np.cumsum(looks[first:last])[:-1]]), looks[first:last]) + np.arange(len(x))
        other = size[start[b]]
        least = needed(size[x], other)
        fits = (size[x] - position[x] >= least) & (other >= least)
        x, b, other, least = x[fits], b[fits], other[fits], least[fits]
        end = np.searchsorted(place, b * width + (other - least), side="right")  # the rest of the block is skipped
        count = np.maximum(np.where(b == block[x], np.minimum(end, x), end) - start[b], 0)
        for i, j in _slices(count, most):
            left = np.repeat(x[i:j], count[i:j])
            right = np.repeat(start[b[i:j]] - np.concatenate([[0], np.cumsum(count[i:j])[:-1]]), count[i:j]) + np.arange(len(left))
            apart = root[left] != root[right]
            yield left[apart], right[apart]


def _slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of items whose sizes add up to some ``most`` (a larger item is a range of its own)."""
    if len(sizes):
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1
        yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct pairs of nodes of whole runs, from rows in order of token, low, high, size and position."""
    def paired(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        token, low, high, part, node, size, position, root = rows.T
        run = np.cumsum(np.concatenate([[True], (rows[1:, :3] != rows[:-1, :3]).any(axis=1)])) - 1
        for x, y in meetings(run, size, position, root):
            across = (low[x] == high[x]) | (part[x] != part[y])  # parts meet themselves in their own run
            x, y = node[x[across]], node[y[across]]
            pairs = np.unique(np.stack([np.maximum(x, y), np.minimum(x, y)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["x", "z"])

    held, n = [], 0
    for batch in batches:
        held.append(np.stack([np.asarray(c, dtype=np.int64) for c in batch.columns], axis=1))
        n += batch.num_rows
        if n >= 1 << 18:
            rows = np.concatenate(held)
            cut = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1))
            if len(cut):
                yield from paired(rows[: cut[-1] + 1])
                rows = rows[cut[-1] + 1:]
            held, n = [rows], len(rows)
    if n:
        yield from paired(np.concatenate(held))


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small):
        return 0
    at = np.searchsorted(large, small)
    return int((large[np.minimum(at, len(large) - 1)] == small).sum())


def derived(leader: np.ndarray, members: dict[int, np.ndarray], partners: dict[int, np.ndarray], pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The similar ones of (member, partner) pairs, from the leader's overlap with each partner and the members' differences from the leader."""
    overlap: dict[int, int] = {}
    differ = {x: (np.setdiff1d(s, leader, assume_unique=True), np.setdiff1d(leader, s, assume_unique=True)) for x, s in members.items()}
    out = []
    for x, z in pairs:
        least = needed(len(members[x]), len(partners[z]))
        if z not in overlap:
            overlap[z] = common(leader, partners[z])
        more, fewer = differ[x]
        if overlap[z] + len(more) < least:
            continue
        if overlap[z] - len(fewer) >= least or overlap[z] + common(more, partners[z]) - common(fewer, partners[z]) >= least:
            out.append((x, z))
    return out


def _derived(width: int):
    """Links of whole groups, from rows in order of lead, i, j and kind: 0 the leader, 1 its members, 2 their partners, 3 the pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, ([], {}, {}, [])

        def emit() -> pa.RecordBatch:
            out = derived(held[0][0], held[1], held[2], held[3])
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([z for _, z in out], pa.int64())], names=["a", "b"])

        for batch in batches:
            *columns, text = batch.columns
            for lead, i, j, kind, node, other, values in zip(*[c.to_pylist() for c in columns], shingle_sets(text, width)):
                if (lead, i, j) != at:
                    if at is not None:
                        yield emit()
                    at, held = (lead, i, j), ([], {}, {}, [])
                if kind == 3:
                    held[3].append((node, other))
                elif kind == 0:
                    held[0].append(values)
                else:
                    held[kind][node] = values
        if at is not None:
            yield emit()

    return run


def _written(frame: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """The frame written and read back; the shuffle files of its making go once it is complete."""
    conf, key = frame.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return materialise(frame, name, compression)
    finally:
        conf.set(key, before)


def _rooted(frame: DataFrame, links: DataFrame) -> DataFrame:
    """The rows with ``root``, their node's component of the links."""
    known = components(links).select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    return frame.join(known, F.col("node") == F.col("_n"), "left").withColumn("root", F.coalesce("_r", "node")).drop("_n", "_r")


def _open(lists: DataFrame, links: DataFrame) -> DataFrame:
    """The lists that hold several components of the links, with ``root``."""
    rooted = _rooted(lists, links)
    several = rooted.groupBy(F.col("token").alias("_t")).agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).filter("_lo < _hi")
    return _written(rooted.join(several, F.col("token") == F.col("_t"), "left_semi"), "join-open")


def _fits(n: Column, i: Column, m: Column, j: Column) -> Column:
    """Can sets of n and m shingles that meet at positions i and j be similar?"""
    return (OVER + UNDER) * F.least(n - i, m - j) >= OVER * (n + m)


def _stars(lists: DataFrame, texts: DataFrame, pivot: Column, width: int) -> DataFrame:
    """Verified links ``a, b`` of every node to one node that it meets: of the lists' pivots of another root, the least."""
    entry = F.struct("node", "size", "pos", "root")
    pivots = lists.groupBy(F.col("token").alias("_t")).agg(F.min(F.struct(pivot.alias("k"), entry.alias("e"))).alias("p"))
    met = lists.join(pivots, F.col("token") == F.col("_t")).filter(F.col("p.e.root") != F.col("root"))
    met = met.filter(_fits(F.col("size"), F.col("pos"), F.col("p.e.size"), F.col("p.e.pos")))
    pairs = met.groupBy("node").agg(F.min("p").alias("_p")).select("node", F.col("_p.e.node").alias("other"))
    other = texts.select(F.col("_node").alias("_other"), F.col("text").alias("_text"))
    both = pairs.join(texts, F.col("node") == F.col("_node")).join(other, F.col("other") == F.col("_other"))
    return _written(both.select("node", "other", "text", "_text").mapInArrow(_similar_pairs(width), "a long, b long"), "join-stars")


def _pairs(lists: DataFrame, chunk: int) -> DataFrame:
    """Distinct pairs ``x, z`` of different components that the lists leave; a list of over ``chunk`` entries is dealt into parts."""
    sizes = lists.groupBy(F.col("token").alias("_t")).agg(F.ceil(F.count(F.lit(1)) / chunk).cast("long").alias("_parts"))
    parted = lists.join(sizes, F.col("token") == F.col("_t")).withColumn("part", F.pmod(F.xxhash64("node"), F.col("_parts")))
    runs = parted.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).select(
        "token", F.least("part", "_o").alias("low"), F.greatest("part", "_o").alias("high"), "part", "node", "size", "pos", "root")
    dealt = runs.repartition(partitions(lists.sparkSession), "token", "low", "high").sortWithinPartitions("token", "low", "high", "size", "pos")
    return dealt.mapInArrow(_candidates, "x long, z long").distinct()


def _derive(pairs: DataFrame, stars: DataFrame, texts: DataFrame, width: int, side: int) -> DataFrame:
    """The verified links among the pairs, by way of leaders."""
    leads = stars.groupBy(F.col("a").alias("_a")).agg(F.min("b").alias("_lead"))
    led = _written(pairs.join(leads, F.col("x") == F.col("_a"), "left").select(F.coalesce("_lead", "x").alias("lead"), "x", "z"), "join-pairs")
    counts = led.groupBy(F.col("lead").alias("_l")).agg(F.approx_count_distinct("x").alias("_x"), F.approx_count_distinct("z").alias("_z"))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.ceil(F.col(n) / side).cast("long"))
    dealt = led.join(counts, F.col("lead") == F.col("_l")).select("lead", deal("x", "_x").alias("i"), deal("z", "_z").alias("j"), "x", "z")
    dealt = _written(dealt, "join-dealt")
    need = lambda kind, c: dealt.select("lead", "i", "j", F.lit(kind).alias("kind"), F.col(c).alias("node")).distinct()
    wanted = need(0, "lead").unionByName(need(1, "x")).unionByName(need(2, "z")).join(texts, F.col("node") == F.col("_node"))
    rows = wanted.select("lead", "i", "j", "kind", "node", F.lit(None).cast("long").alias("other"), "text").unionByName(
        dealt.select("lead", "i", "j", F.lit(3).alias("kind"), F.col("x").alias("node"), F.col("z").alias("other"), F.lit("").alias("text")))
    where = ["lead", "i", "j"]
    met = rows.repartition(partitions(pairs.sparkSession), *where).sortWithinPartitions(*where, "kind")
    return _written(met.mapInArrow(_derived(width), "a long, b long"), "join-derived")


def similar_links(rows: DataFrame, width: int = WIDTH, chunk: int = CHUNK, side: int = SIDE, rounds: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From ``row, text``: ``row, size, digest``; ``digest, node`` of every distinct set that is not empty; and links ``(a, b)`` that connect all similar nodes.

    Lists of one set, and lists whose sets the links so far connect, are left
    out; from the others every pair of different components that size and
    position allow is decided exactly.
    """
    spark = rows.sparkSession
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    counters = min(LARGEST_TABLE, 1 << max(12, (total // (6 * PER_COUNTER)).bit_length()))
    sketched = _written(rows.mapInArrow(_sketch(width, counters), "row long, size int, digest binary, block int, counts binary"), "join-sketches", compression="zstd")
    counted = sketched.filter("block IS NOT NULL").select("block", "counts").repartition(max(1, counters // COUNTER_BLOCK), "block").sortWithinPartitions("block")
    levels = np.zeros(counters, dtype=np.uint8)
    for r in counted.mapInArrow(_levels, "block int, levels binary").collect():  # a byte per counter, at most LARGEST_TABLE
        levels[r["block"] * COUNTER_BLOCK:][: len(r["levels"])] = np.frombuffer(r["levels"], np.uint8)
    sized = sketched.filter("block IS NULL").select("row", "size", "digest")
    nodes = _written(sized.filter("size > 0").groupBy("digest").agg(F.min("row").alias("node")), "join-nodes")

    made = rows.mapInArrow(_prefixes(width, levels), "node long, size int, tokens array<long>")
    prefixes = _written(made.join(nodes.select(F.col("node").alias("_w")), F.col("node") == F.col("_w"), "left_semi"), "join-prefixes")
    every = prefixes.select("node", "size", F.posexplode("tokens").alias("pos", "token"))
    several = every.groupBy(F.col("token").alias("_t")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    lists = _written(every.join(several, F.col("token") == F.col("_t"), "left_semi").withColumn("root", F.col("node")), "join-lists")
    discard(prefixes)
    wanted = lists.select(F.col("node").alias("_w")).distinct()
    texts = _written(rows.join(wanted, F.col("row") == F.col("_w"), "left_semi").select(F.col("row").alias("_node"), "text"), "join-texts", compression="zstd")

    stars = _stars(lists, texts, F.col("node"), width)
    links, open_ = stars, _open(lists.drop("root"), stars)
    for k in range(1, rounds):  # other pivots
        more = _stars(open_, texts, F.xxhash64("node", F.lit(k)), width)
        links = links.unionByName(more)
        open_ = _open(lists.drop("root"), links)
    found = _derive(_pairs(open_, chunk), stars, texts, width, side)
    for done in (lists, texts, open_):
        discard(done)
    return sized, nodes, links.unionByName(found)


def similar_groups(docs: DataFrame, width: int = WIDTH, chunk: int = CHUNK, side: int = SIDE) -> DataFrame:
    """``doc_id, n_shingles, component_id``: one row per document, with the least doc_id that links reach, its own included.

    Two documents link when their sets of word shingles (hashed to 64 bits, A-Z
    in lower case) have a Jaccard similarity of at least 0.85. A text of fewer
    words is one shingle; a null text, or one without words, has none and links
    with nothing: its component is its own id. Repeated rows give repeated rows;
    null ids are passed over, and a component with no other has a null id. No
    documents give no rows; other columns are not read.
    """
    texts = docs.select(F.col("doc_id").cast("long"), whole_text(F.col("text")).alias("text"))
    numbered = _written(texts.withColumn("row", F.monotonically_increasing_id()), "join-documents", compression="zstd")
    sized, nodes, links = similar_links(numbered.select("row", "text"), width, chunk, side)
    classes = _written(_rooted(nodes, links).select(F.col("digest").alias("_digest"), "root"), "join-classes")
    placed = sized.join(classes, F.col("digest") == F.col("_digest"), "left").select(F.col("row").alias("_row"), "size", "root")
    met = _written(numbered.select("row", "doc_id").join(placed, F.col("row") == F.col("_row")).select("doc_id", "size", "root"), "join-placed")
    least = _written(met.filter("root IS NOT NULL").groupBy(F.col("root").alias("_root")).agg(F.min("doc_id").alias("_least")), "join-least")
    return met.join(least, F.col("root") == F.col("_root"), "left").select(
        "doc_id", F.col("size").cast("long").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("_least")).alias("component_id"))
