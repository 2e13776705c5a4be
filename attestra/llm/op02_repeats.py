"""Repeated substrings by merging Burrows-Wheeler transforms.

A 50-byte string is looked for in earlier documents. Every such window has a
minimizer, the 20-byte gram of least hash in it, which depends on the window's
bytes alone; so equal windows meet where their minimizers meet. Neighbouring
windows with one minimizer form a segment of some 70 bytes. Minimizers that one
document alone has are left out; the segments of the others are dealt by
minimizer, block by block. Within each range of minimizers the segments of
some blocks are a shard: its suffixes are sorted, its transform is taken, and
the transforms are merged by interleave refinement. Equal prefixes of 50 bytes
come out as intervals, and each interval knows its least document.

A minimizer with very many different segments, as at the edge of a passage that
many documents share, is hot: its windows are dealt one by one, by a hash of
their 50 bytes over all ranges, and compared whole. Equal windows have one
minimizer, so they are hot everywhere or nowhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from attestra.llm.common import discard, materialise, partitions, whole_text

LENGTH, GRAM, MOST_WINDOWS = 50, 20, 64
BLOCK_BYTES, RANGE_BYTES = 8 << 20, 4 << 20
#: Symbols merged at a time, and of one shard: the arrays of a merge stay in a core's cache.
MERGE_SYMBOLS, SHARD_SYMBOLS = 1 << 17, 1 << 15
NO_ID = (1 << 63) - 1
BLOCK = "block long, ids array<long>, ends binary, data binary"
PART = 1 << 17
#: A minimizer with more distinct segments (summed over the blocks that have FEW or more) is hot.
HOT_SEGMENTS, FEW = 1 << 13, 8


def grams(x: np.ndarray, width: int = GRAM) -> np.ndarray:
    """A 64-bit hash of every ``width`` bytes, from hashes of powers of two."""
    def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        r = a * np.uint64(0x9E3779B97F4A7C15) + b
        r ^= r >> np.uint64(31)
        return r

    h, have, spare, size = x.astype(np.uint64) + np.uint64(1), 1, None, 0
    rest = width
    while True:
        if rest & 1:
            spare, size = (h, have) if spare is None else (mix(spare[: len(spare) - have], h[size:]), size + have)
        rest >>= 1
        if not rest:
            break
        h, have = mix(h[:-have], h[have:]), 2 * have
    spare = spare * np.uint64(0xD6E8FEB86659FD93)
    return spare ^ (spare >> np.uint64(32))


def least_of(h: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    have = 1
    while 2 * have <= width:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    return np.minimum(h[: len(h) - (width - have)], h[width - have:]) if width > have else h


def segments(x: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring windows with one minimizer: first byte, how many windows, the minimizer's hash, the document.

    Windows lie within one document. A run is cut after MOST_WINDOWS.
    """
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    first, count, key = [], [], []
    usable = np.flatnonzero(ends - starts >= length)
    at = 0
    while at < len(usable):  # some documents at a time, or a part of a long one: arrays that stay in the cache
        lo = starts[usable[at]]
        to = at
        while to + 1 < len(usable) and ends[usable[to + 1]] - lo <= PART:
            to += 1
        for a in range(lo, ends[usable[to]] - length + 1, PART):
            b = min(a + PART, ends[usable[to]] - length + 1)
            m = least_of(grams(x[a: b + length - 1], gram), length - gram + 1)
            edge = np.empty(b - a, dtype=bool)
            edge[0] = True
            np.not_equal(m[1:], m[:-1], out=edge[1:])
            inside = starts[usable[at: to + 1]]
            final = ends[usable[at: to + 1]] - length  # the last window of each document
            marks = np.concatenate([inside, final + 1]) - a
            edge[marks[(marks >= 0) & (marks < b - a)]] = True
            s = np.flatnonzero(edge)
            first.append(s + a)
            count.append(np.diff(np.append(s, b - a)))
            key.append(m[s])
        at = to + 1
    if not first:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none.astype(np.uint64), none
    first, count, key = np.concatenate(first), np.concatenate(count), np.concatenate(key)
    key *= np.uint64(0xBF58476D1CE4E5B9)  # least hashes are small numbers: spread them again
    key ^= key >> np.uint64(32)
    doc = np.searchsorted(ends, first, side="right")
    valid = first <= ends[doc] - length
    first, count, key, doc = first[valid], count[valid], key[valid], doc[valid]
    pieces = -(-count // MOST_WINDOWS)
    if pieces.max(initial=1) > 1:
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        whole = np.repeat(count, pieces)
        first, key, doc = np.repeat(first, pieces) + nth * MOST_WINDOWS, np.repeat(key, pieces), np.repeat(doc, pieces)
        count = np.minimum(whole - nth * MOST_WINDOWS, MOST_WINDOWS)
    return first, count, key, doc


def _lane_of(keys: np.ndarray) -> np.ndarray:
    """One of 256 lanes of a range, by bits that the range does not use; equal windows are in one lane."""
    return (keys & np.uint64(0xFF)).astype(np.uint8)


def _range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


# ---- blocks of documents

def _blocks(block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, pack = TaskContext.get().partitionId() << 32, zstandard.ZstdCompressor(level=1)
        ids, texts, held = [], [], 0

        def block() -> pa.RecordBatch:
            ends = np.cumsum([len(t) for t in texts], dtype=np.int64).tobytes()
            columns = [pa.array([number]), pa.array([ids], pa.list_(pa.int64())), pa.array([ends], pa.binary()), pa.array([pack.compress(b"".join(texts))], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["block", "ids", "ends", "data"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                data = text.as_py().encode()
                if ids and held + len(data) > block_bytes:
                    yield block()
                    number, ids, texts, held = number + 1, [], [], 0
                ids.append(doc_id.as_py())
                texts.append(data)
                held += len(data)
        if ids:
            yield block()

    return run


def _opened(row: dict) -> tuple[np.ndarray, bytes, np.ndarray]:
    ends = np.frombuffer(row["ends"], dtype=np.int64)
    data = zstandard.ZstdDecompressor().decompress(row["data"], max_output_size=max(int(ends[-1]), 1)) if len(ends) and ends[-1] else b""
    ids = np.array([NO_ID if i is None else i for i in row["ids"]], dtype=np.int64)
    return ids, data, ends


# ---- minimizers of more than one document

def _many(data: bytes, first: np.ndarray, count: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The minimizers with FEW or more distinct segments in the block, and how many."""
    often = np.flatnonzero(np.bincount(at)[at] >= FEW) if len(at) else np.zeros(0, int)
    a, b = first[often].tolist(), (first[often] + count[often] + length - 1).tolist()
    distinct = {data[i:j]: k for i, j, k in zip(a, b, at[often].tolist())}  # equal segments have one minimizer
    which, n = np.unique(np.fromiter(distinct.values(), np.int64, len(distinct)), return_counts=True)
    return which[n >= FEW], n[n >= FEW]


def _reported(length: int, ranges: int):
    """Each block's distinct minimizers by range: the low half of the hash, whether two of its documents have it, and the counts of ``_many``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, data, ends = _opened(row)
                first, count, key, doc = segments(np.frombuffer(data, np.uint8), ends, length)
                unique, at = np.unique(key, return_inverse=True)
                low, high = np.full(len(unique), NO_ID), np.full(len(unique), -NO_ID)
                np.minimum.at(low, at, ids[doc])
                np.maximum.at(high, at, ids[doc])
                place = _range_of(unique, ranges)
                cuts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, int)
                which, n = _many(data, first, count, at, length)
                counts = []
                for lo, hi in zip(cuts, np.append(cuts[1:], len(place))):
                    a, b = np.searchsorted(which, [lo, hi])
                    counts.append(np.stack([which[a:b] - lo, n[a:b]]).astype(np.int64).tobytes())
                halves, several = np.split((unique & np.uint64(0xFFFFFFFF)).astype(np.uint32), cuts[1:]), np.split(low < high, cuts[1:])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(place[cuts]), pa.array([row["block"]] * len(cuts), pa.int64()), pa.array([h.tobytes() for h in halves[: len(cuts)]], pa.binary()),
                     pa.array([np.packbits(s).tobytes() for s in several[: len(cuts)]], pa.binary()), pa.array(counts, pa.binary())],
                    names=["range", "block", "halves", "several", "many"])

    return run


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[-1]["range"] != row["range"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _shared(hot_segments: int):
    """For each block of a range, which of its minimizers another document has, and the places of those that are hot."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_range(batches):
            halves = [np.frombuffer(r["halves"], dtype=np.uint32) for r in rows]
            flags = [np.unpackbits(np.frombuffer(r["several"], np.uint8), count=len(h)).astype(bool) for r, h in zip(rows, halves)]
            values = np.sort(np.concatenate([*halves, *[h[f] for h, f in zip(halves, flags)]]))
            twice = np.unique(values[1:][values[1:] == values[:-1]])
            many = [np.frombuffer(r["many"], np.int64).reshape(2, -1) for r in rows]
            counted, of = np.unique(np.concatenate([h[m[0]] for h, m in zip(halves, many)]), return_inverse=True)
            hot = counted[np.bincount(of, np.concatenate([m[1] for m in many]), len(counted)) > hot_segments]
            bits, places = [], []
            for h in halves:
                where = np.minimum(np.searchsorted(twice, h), max(len(twice) - 1, 0))
                bits.append(np.packbits(twice[where] == h if len(twice) else np.zeros(len(h), bool)).tobytes())
                places.append(np.flatnonzero(np.isin(h, hot)).tobytes() if len(hot) else b"")
            yield pa.RecordBatch.from_arrays([pa.array([r["block"] for r in rows], pa.int64()), pa.array([r["range"] for r in rows], pa.int64()), pa.array(bits, pa.binary()),
                                              pa.array(places, pa.binary())], names=["block", "range", "bits", "hot"])

    return run


def _window_keys(x: np.ndarray, first: np.ndarray, length: int) -> np.ndarray:
    """A hash of all ``length`` bytes from each place."""
    h = np.zeros(len(first), dtype=np.uint64)
    for k in range(length):
        h = (h ^ (x[first + k] + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _chosen(row: dict, length: int, ranges: int):
    """The block's segments whose minimizer is shared, in order of their ranges; windows of hot minimizers are in ranges of their own, from ``ranges`` on."""
    ids, data, ends = _opened(row)
    first, count, key, doc = segments(np.frombuffer(data, np.uint8), ends, length)
    unique, at = np.unique(key, return_inverse=True)
    flags, hot, place = np.zeros(len(unique), dtype=bool), np.zeros(len(unique), dtype=bool), _range_of(unique, ranges)
    for r in row["shared"] or []:
        lo, hi = np.searchsorted(place, r["range"]), np.searchsorted(place, r["range"], side="right")
        flags[lo:hi] = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=hi - lo).astype(bool)
        hot[lo + np.frombuffer(r["hot"], np.int64)] = True
    kept = np.flatnonzero((flags & ~hot)[at])
    kept = kept[np.argsort(place[at[kept]], kind="stable")]
    first_, count_, doc_, place_, lane_ = first[kept], count[kept], doc[kept], place[at[kept]], _lane_of(key[kept])
    single = np.flatnonzero((flags & hot)[at])
    if len(single):
        n = count[single]
        window = np.repeat(first[single] - np.cumsum(n) + n, n) + np.arange(n.sum())
        keys, owner = _window_keys(np.frombuffer(data, np.uint8), window, length), np.repeat(doc[single], n)
        order = np.argsort(_range_of(keys, ranges), kind="stable")
        window, keys, owner = window[order], keys[order], owner[order]
        first_, count_, doc_ = np.append(first_, window), np.append(count_, np.ones(len(window), count_.dtype)), np.append(doc_, owner)
        place_, lane_ = np.append(place_, ranges + _range_of(keys, ranges)), np.append(lane_, _lane_of(keys))
    return ids, data, ends, first_, count_, doc_, place_, lane_


def _numbered(data: bytes, first: np.ndarray, count: np.ndarray, length: int) -> tuple[dict[bytes, int], np.ndarray]:
    """Distinct segments in order of appearance, and the number of each."""
    known: dict[bytes, int] = {}
    return known, np.fromiter((known.setdefault(data[a:b], len(known)) for a, b in zip(first.tolist(), (first + count + length - 1).tolist())), np.int64, len(first))


def _sent(length: int, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for row in batch.to_pylist():
                ids, data, _, first, count, doc, place, lane = _chosen(row, length, ranges)
                cuts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, int)
                out = [[], [], [], []]
                for a, b in zip(cuts, np.append(cuts[1:], len(place))):
                    known, number = _numbered(data, first[a:b], count[a:b], length)
                    least = np.full(len(known), NO_ID)
                    np.minimum.at(least, number, ids[doc[a:b]])
                    sizes = np.fromiter(map(len, known), np.uint8, len(known))
                    lanes = np.empty(len(known), np.uint8)
                    lanes[number] = lane[a:b]
                    for column, value in zip(out, (int(place[a]), row["block"], sizes.tobytes() + lanes.tobytes() + least.tobytes(), pack.compress(b"".join(known)))):
                        column.append(value)
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["range", "block", "least", "data"])

    return run


# ---- merging transforms

class Shard:
    """Segments, each ended by symbol 0, their suffixes in order, and the Burrows-Wheeler transform.

    A byte is the symbol one above it; UTF-8 has no byte 255. Suffixes are in
    order of their first ``8 * words`` symbols up to the end of the segment.
    """

    def __init__(self, data: bytes, sizes: np.ndarray, words: int = 7):
        ends = np.cumsum(sizes + 1) - 1
        n = int(sizes.sum()) + len(sizes)
        body = np.ones(n, dtype=bool)
        body[ends] = False
        padded = np.zeros(n + 8 * words + 8, dtype=np.uint8)
        padded[:n][body] = np.frombuffer(data, np.uint8) + np.uint8(1)
        self.symbols = padded[:n]
        # eight symbols from each place on, the first the most significant
        word = np.zeros(n + 8 * words, dtype=np.uint64)
        for k in range(8):
            word = (word << np.uint64(8)) | padded[k: k + len(word)]
        left = np.repeat(ends, sizes + 1) - np.arange(n)  # symbols up to the segment's end
        keys = []
        for w in range(words):
            inside = np.clip(left - 8 * w, 0, 8)
            shift = ((8 - inside) * 8).astype(np.uint64)
            key = word[8 * w: 8 * w + n]
            keys.append(np.where(inside == 0, np.uint64(0), (key >> shift) << shift))
        order = np.lexsort(keys[1::-1])
        equal = np.ones(max(n - 1, 0), dtype=bool)
        for key in keys[:2]:
            equal &= key[order[1:]] == key[order[:-1]]
        tied = np.flatnonzero(np.concatenate([equal, [False]]) | np.concatenate([[False], equal])) if n else np.zeros(0, int)
        if len(tied) and len(keys) > 2:  # the deeper words only where the first two leave suffixes alike
            members = order[tied]
            group = np.cumsum(np.concatenate([[True], ~equal]))[tied]
            order[tied] = members[np.lexsort([*[key[members] for key in keys[:1:-1]], group])]
        self.order = order.astype(np.int32)
        self.first = keys[0][order]
        starts = np.concatenate([[0], ends[:-1] + 1])
        before = np.roll(self.symbols, 1)
        before[starts] = 0
        self.transform = before[self.order]
        place = np.empty(n, dtype=np.int32)
        place[self.order] = np.arange(n, dtype=np.int32)
        # where the suffix one symbol longer stands; at a segment's start, its end symbol, as in a ring
        sources = np.arange(-1, n - 1)
        sources[starts] = ends
        self.step = place[sources][self.order]


def merge(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave the shards' suffixes in order of their first ``depth`` symbols; the second array tells where a new prefix begins.

    The interleave starts from the suffixes' first eight symbols, merged word by
    word, and is refined: when it is right for k symbols, reading each shard's transform through it and
    dealing the suffixes by the symbol read, in order, makes it right for k + 1.
    Beyond the first word no suffix is compared with another. Where two
    neighbours first differ is kept as the boundary of a common prefix. ``depth``
    is at least eight.
    """
    base = np.cumsum([0] + [len(s.order) for s in shards])
    transform = np.concatenate([s.transform for s in shards])
    step = np.concatenate([s.step + b for s, b in zip(shards, base)]).astype(np.intp)
    n = len(step)
    # every suffix stays under its letter in each round, so letters change at the same places
    letters = np.cumsum(np.bincount(transform, minlength=256))
    letters = letters[letters < n]
    word = np.concatenate([s.first for s in shards])
    merged, new = np.argsort(word, kind="stable"), np.ones(n, dtype=bool)
    word = word.take(merged)
    np.not_equal(word[1:], word[:-1], out=new[1:])
    interval = np.cumsum(new, dtype=np.int32)
    for _ in range(8, depth):
        dealt = np.argsort(transform.take(merged, mode="clip"), kind="stable")
        merged = step.take(merged.take(dealt, mode="clip"), mode="clip")
        group = interval.take(dealt, mode="clip")
        np.not_equal(group[1:], group[:-1], out=new[1:])
        new[letters] = True
        interval = np.cumsum(new, dtype=np.int32)
    return merged, new


def _earliest(texts: list[bytes], sizes: np.ndarray, least: np.ndarray, length: int, shard_symbols: int) -> np.ndarray:
    """For every window of the segments, the least document of all equal windows among them."""
    total = np.cumsum(sizes + 1)
    bounds = np.unique(np.concatenate([[0], np.searchsorted(total, np.arange(shard_symbols, total[-1] + shard_symbols, shard_symbols)), [len(texts)]]))
    built = [Shard(b"".join(texts[a:b]), sizes[a:b], -(-length // 8)) for a, b in zip(bounds, bounds[1:]) if b > a]
    merged, new = merge(built, length)
    base = np.cumsum([0] + [len(s.order) for s in built])
    position = np.concatenate([s.order + b for s, b in zip(built, base)])[merged]  # of each suffix, in the segments one after the other
    segment = np.repeat(np.arange(len(texts)), sizes + 1)[position]
    offset = position - (total[segment] - sizes[segment] - 1)
    window = offset <= sizes[segment] - length
    cls, segment, offset = (np.cumsum(new) - 1)[window], segment[window], offset[window]
    opens = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]]))
    first = np.minimum.reduceat(least[segment], opens)
    out = np.full((len(texts), MOST_WINDOWS), NO_ID)
    out[segment, offset] = np.repeat(first, np.diff(np.append(opens, len(cls))))
    return out


def _alone(texts: list[bytes], length: int) -> np.ndarray:
    """Whether no other text has the minimizer of a segment, so that no other can have one of its windows."""
    least = []
    for a in range(0, len(texts), PART // length):  # arrays that stay in the cache
        firsts = np.frombuffer(b"".join([t[:length] for t in texts[a: a + PART // length]]), np.uint8)
        least.append(least_of(grams(firsts), length - GRAM + 1)[::length])  # a segment's windows have one minimizer
    _, of, n = np.unique(np.concatenate(least), return_inverse=True, return_counts=True)
    return n[of] == 1


def verdicts(shards: list[tuple[np.ndarray, np.ndarray, np.ndarray, bytes]], length: int = LENGTH, merge_symbols: int = MERGE_SYMBOLS,
             shard_symbols: int = SHARD_SYMBOLS) -> list[np.ndarray]:
    """For each block's segments a word of bits: bit w is set if window w also starts in a document before the segment's first.

    ``shards`` are (sizes, lanes, least document, bytes) of the distinct segments
    of each block. Segments that several blocks have become one, with the least
    of their documents; one that then is its minimizer's only one meets no other.
    Lanes share no window, so the others are merged some at a time.
    """
    known: dict[bytes, int] = {}
    numbers = []
    for sizes, _, _, data in shards:
        ends = np.cumsum(sizes, dtype=np.int64).tolist()
        numbers.append(np.fromiter((known.setdefault(data[a:b], len(known)) for a, b in zip([0] + ends[:-1], ends)), np.int64, len(sizes)))
    texts = list(known)
    least, lane = np.full(len(texts), NO_ID), np.zeros(len(texts), np.uint8)
    for number, (_, lanes, first, _) in zip(numbers, shards):
        np.minimum.at(least, number, first)
        lane[number] = lanes
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    alone = _alone(texts, length) if texts else np.zeros(0, bool)
    windows = np.uint64(0xFFFFFFFFFFFFFFFF) >> (MOST_WINDOWS - (sizes - length + 1)).astype(np.uint64)
    order = np.argsort(lane, kind="stable")
    order = order[~alone[order]]
    total, opens = np.cumsum(sizes[order] + 1), np.flatnonzero(np.diff(lane[order].astype(np.int64), prepend=-1))
    a = 0
    answers = [np.where(alone[n] & (least[n] < mine), windows[n], np.uint64(0)) for n, (_, _, mine, _) in zip(numbers, shards)]
    where = [np.argsort(n, kind="stable") for n in numbers]
    weight = np.uint64(1) << np.arange(MOST_WINDOWS, dtype=np.uint64)
    while a < len(order):
        later = opens[opens > a]
        fits = later[total[later - 1] - (total[a - 1] if a else 0) <= merge_symbols]
        b = int(fits[-1]) if len(fits) else int(later[0]) if len(later) else len(order)
        if len(later) == len(fits) and total[-1] - (total[a - 1] if a else 0) <= merge_symbols:
            b = len(order)
        part = np.sort(order[a:b])
        earliest = _earliest([texts[i] for i in part], sizes[part], least[part], length, shard_symbols)
        for answer, number, sort, (_, _, mine, _) in zip(answers, numbers, where, shards):
            at = np.searchsorted(number, part, sorter=sort)
            at = np.minimum(at, max(len(number) - 1, 0))
            has = number[sort[at]] == part if len(number) else np.zeros(len(part), bool)
            rows = sort[at[has]]
            answer[rows] = ((earliest[has] < mine[rows][:, None]) * weight).sum(axis=1, dtype=np.uint64)
        a = b
    return answers


def whole_verdicts(shards: list[tuple[np.ndarray, np.ndarray, np.ndarray, bytes]], length: int = LENGTH) -> list[np.ndarray]:
    """``verdicts`` where every segment is a single window: equal windows are equal segments."""
    least: dict[bytes, int] = {}
    windows = [[data[a: a + length] for a in range(0, len(data), length)] for _, _, _, data in shards]
    for mine, (_, _, first, _) in zip(windows, shards):
        for w, i in zip(mine, first.tolist()):
            if i < least.get(w, NO_ID + 1):
                least[w] = i
    return [(np.fromiter(map(least.__getitem__, mine), np.int64, len(mine)) < first).astype(np.uint64) for mine, (_, _, first, _) in zip(windows, shards)]


def _judged(length: int, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_range(batches):
            shards = []
            for r in rows:
                n = len(r["least"]) // 10
                sizes, lanes = np.frombuffer(r["least"][:n], np.uint8).astype(np.int64), np.frombuffer(r["least"][n: 2 * n], np.uint8)
                shards.append((sizes, lanes, np.frombuffer(r["least"][2 * n:], np.int64), zstandard.ZstdDecompressor().decompress(r["data"], max_output_size=int(sizes.sum()))))
            bits = verdicts(shards, length) if rows[0]["range"] < ranges else whole_verdicts(shards, length)
            yield pa.RecordBatch.from_arrays([pa.array([r["block"] for r in rows], pa.int64()), pa.array([r["range"] for r in rows], pa.int64()),
                                              pa.array([b.tobytes() for b in bits], pa.binary())], names=["block", "range", "bits"])

    return run


# ---- back in the documents

def _removed(length: int, ranges: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, data, ends, first, count, doc, place, _ = _chosen(row, length, ranges)
                cover = np.zeros(len(data) + 1, dtype=np.int32)
                for r in row["verdicts"] or []:
                    a, b = np.searchsorted(place, r["range"]), np.searchsorted(place, r["range"], side="right")
                    known, number = _numbered(data, first[a:b], count[a:b], length)
                    least = np.full(len(known), NO_ID)
                    np.minimum.at(least, number, ids[doc[a:b]])
                    bits = np.frombuffer(r["bits"], np.uint64)[number]
                    bits = np.where(ids[doc[a:b]] > least[number], np.uint64(0xFFFFFFFFFFFFFFFF), bits)
                    hit = np.flatnonzero(bits)
                    table = (bits[hit, None] >> np.arange(MOST_WINDOWS, dtype=np.uint64)) & np.uint64(1)
                    table &= np.arange(MOST_WINDOWS)[None, :] < count[a:b][hit, None]
                    which, w = np.nonzero(table)
                    starts = first[a:b][hit[which]] + w
                    np.add.at(cover, starts, 1)
                    np.add.at(cover, starts + length, -1)
                gone = np.cumsum(cover[:-1]) > 0
                out = [[], [], [], [], [], []]
                x = np.frombuffer(data, np.uint8)
                for i, lo, hi in zip(row["ids"], [0, *ends[:-1].tolist()], ends.tolist()):
                    mine = gone[lo:hi]
                    spans = int(np.count_nonzero(mine[1:] & ~mine[:-1]) + mine[0]) if len(mine) else 0
                    kept = x[lo:hi][~mine].tobytes() if spans else data[lo:hi]
                    for column, value in zip(out, (i, hi - lo, hi - lo - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None)):
                        column.append(value)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                arrays = [pa.array(c, k) for c, k in zip(out, kinds)]
                yield pa.RecordBatch.from_arrays(arrays if with_text else arrays[:5], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 6 if with_text else 5])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = False, block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES,
                   hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``with_text`` the bytes ``kept``.

    A byte goes if a string of ``length`` bytes that covers it also starts in a
    document with a smaller doc_id; null ids come last, and documents of one id
    do not remove each other's bytes. Texts are UTF-8 bytes, null is empty, and
    strings are judged on the input. What is kept may cut a character in two.
    """
    if not GRAM < length <= 255 - MOST_WINDOWS:
        raise ValueError(f"the length is above {GRAM} and at most {255 - MOST_WINDOWS}")
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), whole_text(F.col("text")))
    blocks = materialise(texts.mapInArrow(_blocks(block_bytes), BLOCK), "repeat-blocks", compression="uncompressed")
    total = docs.agg(F.sum(F.octet_length(whole_text(F.col("text"))))).first()[0] or 0
    ranges = max(partitions(spark), -(-total // range_bytes))

    def by_range(frame: DataFrame) -> DataFrame:
        return frame.repartition(ranges, "range").sortWithinPartitions("range")

    def gathered(frame: DataFrame, name: str) -> DataFrame:
        return frame.groupBy(F.col("block").alias("_b")).agg(F.collect_list(F.struct(*[c for c in frame.columns if c != "block"])).alias(name))

    reported = blocks.mapInArrow(_reported(length, ranges), "range long, block long, halves binary, several binary, many binary")
    bits = materialise(by_range(reported).mapInArrow(_shared(hot_segments), "block long, range long, bits binary, hot binary"), "repeat-shared")
    shared = gathered(bits, "shared")
    held = materialise(blocks.join(shared, F.col("block") == F.col("_b"), "left").drop("_b"), "repeat-held", compression="uncompressed")
    discard(blocks)
    sent = held.mapInArrow(_sent(length, ranges), "range long, block long, least binary, data binary")
    judged = materialise(by_range(sent).mapInArrow(_judged(length, ranges), "block long, range long, bits binary"), "repeat-verdicts")
    met = held.join(gathered(judged, "verdicts"), F.col("block") == F.col("_b"), "left").drop("_b")
    columns = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    return met.mapInArrow(_removed(length, ranges, with_text), columns)
