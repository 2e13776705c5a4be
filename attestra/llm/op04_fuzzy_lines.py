"""Fuzzy line deduplication by MinHash over character shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from attestra.llm.common import discard, free_name, marked, materialise, partitions, whole_text
from attestra.llm.components import components
from attestra.llm.near_jaccard import mixed_buckets, open_runs

SHINGLE, SIMILARITY = 8, 0.8
#: 8 bands of 3 minima find a pair of similarity 0.8 with a chance of 0.997, one of 0.9 with 0.99999.
BANDS, ROWS = 8, 3
#: Lines of one bucket that are verified together; a larger bucket is dealt into parts, and every pair of parts is compared.
CHUNK = 256
#: Bytes of (bucket, line) pairs that one task sorts.
RANGE_BYTES = 32 << 20
CHARS = 1 << 17
#: Shingles of a bucket that are compared at once, a column each.
COLUMNS = 1 << 13


def lines(docs: DataFrame, row: str | None = None) -> DataFrame:
    """``doc_id, _row, n_lines, at, line``: every line of every text, trimmed and in lower case; lines end at \\n.

    ``n_lines`` is how many lines the text has, ``_row`` is the column ``row`` of the documents if one is named, else a number of the row's place.
    """
    place = F.col(row) if row else F.monotonically_increasing_id()
    rows = docs.select("doc_id", place.alias("_row"), F.split(whole_text(F.col("text")), "\n").alias("_lines"))
    return rows.select("doc_id", "_row", F.size("_lines").alias("n_lines"), F.posexplode("_lines").alias("at", "_line")).select(
        "doc_id", "_row", "n_lines", "at", F.lower(F.trim(F.replace(F.replace("_line", F.lit("\r"), F.lit(" ")), F.lit("\t"), F.lit(" ")))).alias("line"))


def short_key(line: Column) -> Column:
    return F.xxhash64(line)


def identity(line: Column) -> Column:
    return F.md5(line.cast("binary"))


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20250101)
    return rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def signatures(texts: list[str], bands: int, rows: int, width: int = SHINGLE) -> np.ndarray:
    """``bands`` bucket numbers per text; texts are at least ``width`` characters long."""
    size = np.array([len(t) for t in texts])
    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
    x = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    h = x
    step = 1
    while step < width:  # doubling: the hash of twice as many characters from two neighbours
        left = np.zeros_like(x)
        left[:-step] = h[step:]
        h = (h * np.uint32(0x9E3779B1)) ^ (left * np.uint32(0x85EBCA77) + np.uint32(step))
        h ^= h >> np.uint32(15)
        step *= 2
    h *= np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(16)
    outside = np.zeros(len(x), dtype=np.uint32)
    for back in range(1, width):
        outside[starts + size - back] = 0xFFFFFFFF
    a, b = _multipliers(bands * rows)
    least = np.empty((bands * rows, len(texts)), dtype=np.uint32)
    for i in range(bands * rows):
        least[i] = np.minimum.reduceat((h * a[i] + b[i]) | outside, starts)
    out = np.empty((len(texts), bands), dtype=np.uint64)
    for band in range(bands):
        key = np.full(len(texts), band + 1, dtype=np.uint64)
        for r in range(rows):
            key = (key ^ least[band * rows + r]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        out[:, band] = key
    return out


def _grouped(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (bucket, line) pairs in order, and which of them stand in a bucket with another line."""
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    pairs = pairs[np.concatenate([[True], (pairs[1:] != pairs[:-1]).any(axis=1)])] if len(pairs) else pairs
    same = np.concatenate([[False], pairs[1:, 0] == pairs[:-1, 0], [False]]) if len(pairs) else np.zeros(1, bool)
    return pairs, same[1:] | same[:-1]


SKETCH = pa.schema([("range", pa.int64()), ("pairs", pa.binary()), ("bucket", pa.int64()), ("key", pa.int64())])


def _rows(**given: pa.Array) -> pa.RecordBatch:
    n = len(next(iter(given.values())))
    return pa.RecordBatch.from_arrays([given.get(f.name, pa.nulls(n, f.type)) for f in SKETCH], schema=SKETCH)


def _sketch(bands: int, rows: int, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            keys, texts = np.fromiter(known, dtype=np.int64, count=len(known)), list(known.values())
            found, first = [], 0
            while first < len(texts):
                last, chars = first, 0
                while last < len(texts) and (last == first or chars + len(texts[last]) <= CHARS):
                    chars += len(texts[last])
                    last += 1
                bucket = signatures(texts[first:last], bands, rows)
                found.append(np.stack([bucket.ravel(), np.repeat(keys[first:last].view(np.uint64), bands)], axis=1))
                first = last
            pairs, shared = _grouped(np.concatenate(found) if found else np.empty((0, 2), np.uint64))
            # a bucket with two lines here is known to be shared: its lines go on at once, and one stands for them
            again = np.concatenate([[False], pairs[1:, 0] == pairs[:-1, 0]]) if len(pairs) else np.zeros(0, bool)
            sent = pairs[~again]
            place = (sent[:, 0] >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
            cuts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, int)
            parts = [place[cuts].astype(np.int64), [p.tobytes() for p in np.split(sent, cuts[1:])] if len(cuts) else []]
            yield _rows(range=pa.array(parts[0], pa.int64()), pairs=pa.array(parts[1], pa.binary()))
            direct = pairs[shared].view(np.int64)
            yield _rows(bucket=pa.array(direct[:, 0]), key=pa.array(direct[:, 1]))

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def emit(parts: list[bytes]) -> pa.RecordBatch:
        pairs, shared = _grouped(np.frombuffer(b"".join(parts), dtype=np.uint64).reshape(-1, 2))
        rows = pairs[shared].view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], names=["bucket", "key"])

    held, at = [], None
    for batch in batches:
        for where, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if where != at and held:
                yield emit(held)
                held = []
            at = where
            held.append(data)
    if held:
        yield emit(held)


def shingles(line: str, width: int = SHINGLE) -> frozenset[str]:
    """The distinct character shingles; a shorter line is its only one."""
    return frozenset(line[i: i + width] for i in range(max(1, len(line) - width + 1)))


def _enough(both, one, other, least: float):
    """Whether sets of these sizes and so much in common are similar; numbers or arrays."""
    return both >= least * (one + other - both) - 1e-9


def similar(a: frozenset, b: frozenset, least: float) -> bool:
    small, large = sorted((len(a), len(b)))
    return small >= least * large and _enough(len(a & b), small, large, least)


def latin_shingles(line: str) -> np.ndarray | None:
    """The distinct shingles of a line of Latin-1 characters, ascending: eight characters are one 64-bit number. None for any other line."""
    try:
        data = line.encode("latin-1")
    except UnicodeEncodeError:
        return None
    if len(data) < SHINGLE:
        return None
    every = np.ndarray((len(data) - SHINGLE + 1,), "<u8", data, strides=(1,)).copy()
    every.sort()
    first = np.ones(len(every), dtype=bool)
    np.not_equal(every[1:], every[:-1], out=first[1:])
    return every[first]


def alike(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """``similar`` for sets of ``latin_shingles``."""
    small, large = sorted((len(a), len(b)))
    if small < least * large:
        return False
    merged = np.concatenate((a, b))
    merged.sort()
    return bool(_enough(np.count_nonzero(merged[1:] == merged[:-1]), small, large, least))


def latin_forest(nodes: list[int], sets: list[np.ndarray], roots: list[int], least: float) -> list[tuple[int, int]]:
    """``forest`` for sets of ``latin_shingles``: all sizes in common come from products of 0/1 matrices."""
    sizes = np.array([len(x) for x in sets])
    row, every = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    row, every = row[order], every[order]
    column = np.cumsum(np.concatenate([[False], every[1:] != every[:-1]]))
    common = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for first in range(0, int(column[-1]) + 1, COLUMNS):
        a, b = np.searchsorted(column, [first, first + COLUMNS])
        held = np.zeros((len(sets), int(column[b - 1]) - first + 1), dtype=np.float32)
        held[row[a:b], column[a:b] - first] = 1
        common += held @ held.T
    group, edges = {r: r for r in roots}, []

    def find(r: int) -> int:
        while group[r] != r:
            group[r] = r = group[group[r]]
        return r

    _, root = np.unique(roots, return_inverse=True)
    linked = _enough(common.astype(np.float64), sizes[:, None], sizes[None, :], least) & (root[:, None] != root[None, :])
    for i, j in np.argwhere(np.triu(linked)).tolist():
        x, y = find(roots[i]), find(roots[j])
        if x != y:
            group[x] = y
            edges.append((nodes[i], nodes[j]))
    return edges


def forest(nodes: list[int], sets: list[frozenset], roots: list[int], least: float) -> list[tuple[int, int]]:
    """Verified links that connect what is similar, directly or through others; what is connected already is not compared."""
    start: dict[int, list[int]] = {}
    for i, root in enumerate(roots):
        start.setdefault(root, []).append(i)
    groups, edges = [], []
    for mine in start.values():
        rest = []
        for members in groups:
            met = next(((i, j) for i in mine for j in members if similar(sets[i], sets[j], least)), None)
            if met is None:
                rest.append(members)
            else:
                edges.append((nodes[met[0]], nodes[met[1]]))
                mine = members + mine
        groups = rest + [mine]
    return edges


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[0] for e in found], pa.int64()), pa.array([e[1] for e in found], pa.int64())], names=["a", "b"])


def _centred(least: float):
    """Of ``a, b, line, other``, the pairs whose lines are similar; a run of one ``b`` makes its shingles once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, around = None, None
        for batch in batches:
            found = []
            for a, b, line, other in zip(*[c.to_pylist() for c in batch.columns]):
                if b != centre:
                    centre, around = b, latin_shingles(other)
                mine = None if around is None else latin_shingles(line)
                if similar(shingles(line), shingles(other), least) if mine is None else alike(mine, around, least):
                    found.append((a, b))
            yield _edges(found)

    return run


def _verified(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit() -> pa.RecordBatch:
            nodes, roots, texts = list(held), [r for r, _ in held.values()], [line for _, line in held.values()]
            latin = [latin_shingles(line) for line in texts]
            if all(x is not None for x in latin):
                return _edges(latin_forest(nodes, latin, roots, least))
            return _edges(forest(nodes, [shingles(line) for line in texts], roots, least))

        at, held = None, {}
        for batch in batches:
            for *where, node, root, line in zip(*[c.to_pylist() for c in batch.columns]):
                if where != at:
                    if len(held) > 1:
                        yield emit()
                    at, held = where, {}
                held[node] = (root, line)
        if len(held) > 1:
            yield emit()

    return run


def line_links(
    docs: DataFrame, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, chunk: int = CHUNK,
) -> tuple[DataFrame, DataFrame]:
    """``node, key, line``, the distinct lines that share a bucket, and edges ``(a, b)`` between nodes of lines whose shingle sets have
    a Jaccard similarity of at least ``least``.

    Each task reports every bucket of its lines to the bucket's range once, and
    hands on at once the lines of buckets it fills with two or more, so a bucket
    that holds a share of the corpus sends a few pairs per batch. Lines of
    shared buckets meet their text again. Each is verified against the least line of its part of every
    bucket, each such pair once; this decides buckets of two. Greater buckets
    that then hold several components are compared in full, in parts, but for
    what is one component already.
    """
    spark = docs.sparkSession
    every = lines(docs).select("line")
    total = docs.agg(F.sum(F.octet_length(whole_text(F.col("text"))))).first()[0] or 0
    # a pair is 16 bytes; a line that counts has 8 characters or more
    ranges = max(partitions(spark), -(-total * bands * 16 // (40 * RANGE_BYTES)))
    long = every.filter(F.length("line") >= SHINGLE).select(short_key(F.col("line")), "line")
    sketched = materialise(long.mapInArrow(_sketch(bands, rows, ranges), "range long, pairs binary, bucket long, key long"), "line-buckets")
    dealt = sketched.filter("range IS NOT NULL").select("range", "pairs").repartition(ranges, "range").sortWithinPartitions("range")
    shared = dealt.mapInArrow(_shared, "bucket long, key long").unionByName(sketched.filter("bucket IS NOT NULL").select("bucket", "key")).distinct()
    kept = materialise(shared, "shared-buckets")

    discard(sketched)
    wanted = kept.select(F.col("key").alias("_key")).distinct()
    keyed = marked(long.withColumnRenamed(long.columns[0], "key"), ["key"], wanted, ["_key"])
    # written before equal lines are combined, so that the join may split a line that occurs often
    several = materialise(keyed.join(wanted, F.col("key") == F.col("_key"), "left_semi"), "shared-lines")
    texts = materialise(several.distinct().withColumn("node", F.monotonically_increasing_id()), "line-texts")
    discard(several)

    named = kept.join(texts.select("node", F.col("key").alias("_key")), F.col("key") == F.col("_key")).select("bucket", "node")
    sizes = named.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n"), F.min("node").alias("_least")).withColumnRenamed("bucket", "_bucket")
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("_n") / chunk).cast("long"))
    met = materialise(named.join(sizes, F.col("bucket") == F.col("_bucket")).select("bucket", "node", part.alias("part"), "_least", "_n"), "line-members")
    discard(kept)
    centres = met.groupBy("bucket", "part").agg(F.min("node").alias("_centre"), F.min("_least").alias("_least"))
    inner = met.filter(F.col("_n") > chunk).drop("_least").join(centres, ["bucket", "part"]).select(F.col("node").alias("a"), F.col("_centre").alias("b"))
    outer = centres.select(F.col("_centre").alias("a"), F.col("_least").alias("b"))
    whole = met.filter(F.col("_n") <= chunk).select(F.col("node").alias("a"), F.col("_least").alias("b"))
    pairs = whole.unionByName(inner).unionByName(outer).filter("a > b").distinct()
    line_of = lambda node, line: texts.select(F.col("node").alias(node), F.col("line").alias(line))
    both = pairs.join(line_of("_a", "_line"), F.col("a") == F.col("_a")).join(line_of("_b", "_other"), F.col("b") == F.col("_b"))
    centred = both.select("a", "b", "_line", "_other").mapInArrow(_centred(least), "a long, b long")
    stars = materialise(centred, "line-stars")

    open_ = mixed_buckets(met.filter("_n > 2").select("bucket", "node"), stars, "line-open")
    held = open_runs(open_, chunk).join(line_of("_node", "line"), F.col("node") == F.col("_node")).select("bucket", "i", "j", "node", "root", "line")
    where = ["bucket", "i", "j"]
    checked = held.repartition(partitions(spark), *where).sortWithinPartitions(*where).mapInArrow(_verified(least), "a long, b long")
    return texts, stars.unionByName(materialise(checked, "line-checked"))


def line_decisions(
    docs: DataFrame, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, chunk: int = CHUNK, row: str | None = None,
) -> DataFrame:
    """One row per document: doc_id, ``_row``, n_lines, n_dropped and ``dropped``, the positions of the lines that go.

    Lines are compared trimmed and in lower case. Of a component of similar
    lines, the first stays: least doc_id (null last), then position. Equal lines
    are similar whatever their length; blank lines always stay. A null or empty
    text is one blank line. Repeated rows are documents of their own: the lines
    of one of them stay.
    """
    texts, links = line_links(docs, least, bands, rows, chunk)
    rooted = components(links)
    every = rooted.select("node", "root").unionByName(rooted.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "_n")
    # names of lines are hexadecimal, those of components are not
    linked = texts.join(every, F.col("node") == F.col("_n")).select(
        identity(F.col("line")).alias("_node"), F.concat(F.lit("c"), F.col("root").cast("string"), F.lit(".")).alias("_root"))
    at = lines(docs, row).select("doc_id", "_row", "n_lines", "at", F.when(F.col("line") != "", identity(F.col("line"))).alias("name"))
    occurrences = materialise(at, "line-places")
    named = occurrences.filter("name IS NOT NULL").join(materialise(linked, "line-roots"), F.col("name") == F.col("_node"), "left")
    placed = named.select("doc_id", "_row", "at", F.coalesce("_root", "name").alias("root"))
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("_row").alias("r"), F.col("at").alias("a"))
    first = placed.groupBy("root").agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(
        F.col("root").alias("_r"), F.col("_first.r").alias("_first_row"), F.col("_first.a").alias("_first_at"))
    gone = placed.join(materialise(first, "line-firsts"), F.col("root") == F.col("_r")).filter((F.col("_row") != F.col("_first_row")) | (F.col("at") != F.col("_first_at")))
    lost = gone.groupBy("_row").agg(F.sort_array(F.collect_list("at")).alias("dropped"))
    counted = occurrences.filter("at = 0").select("_row", "doc_id", F.col("n_lines").cast("long").alias("n_lines"))
    none = F.array().cast("array<int>")
    return counted.join(lost.withColumnRenamed("_row", "_lost"), F.col("_row") == F.col("_lost"), "left").select(
        "doc_id", "_row", "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).alias("n_dropped"), F.coalesce("dropped", none).alias("dropped"))


def drop_lines(docs: DataFrame, **parameters) -> DataFrame:
    """The documents with their similar lines gone, all columns as they are but ``text``; a text may become empty, a null stays null."""
    place, row, dropped = (free_name(docs, name) for name in ("__line_row", "__row", "__dropped"))
    numbered = materialise(docs.withColumn(place, F.monotonically_increasing_id()), "numbered-documents")
    made = materialise(line_decisions(numbered, **parameters, row=place).select(F.col("_row").alias(row), F.col("dropped").alias(dropped)), "line-decisions")
    met = numbered.join(made, F.col(place) == F.col(row))
    parts = F.split(numbered["text"], "\n")
    left = F.filter(F.arrays_zip(parts.alias("line"), F.sequence(F.lit(0), F.size(parts) - 1).alias("at")), lambda x: ~F.array_contains(F.col(dropped), x["at"]))
    text = F.when(numbered["text"].isNotNull(), F.array_join(F.transform(left, lambda x: x["line"]), "\n"))
    return met.select(*[text.alias(c) if c == "text" else numbered[c] for c in docs.columns])
