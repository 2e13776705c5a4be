"""Near copies by SimHash and by the Jaccard similarity of their word shingles.

Candidates are the texts whose SimHash codes op7's bit-sliced comparison links,
and those that meet in MinHash buckets; every link is verified on the whole
shingle sets. A SimHash of 64 bits differs in about 10 bits at similarity 0.8;
tables that find all codes that far apart hold nearly every pair. MinHash bands
find the pairs beyond the SimHash radius selectively, with a chance that is known.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from attestra.llm.common import free_name, materialise, partitions
from attestra.llm.components import components
from attestra.llm import op07_near_simhash
from attestra.llm.op07_near_simhash import tokens
from attestra.llm.simhash import fingerprints

WIDTH = 5
#: Similarity as a fraction, so that a pair at exactly 0.8 is in.
OVER, UNDER = 4, 5
#: 20 bands of 3 minima miss a pair of similarity 0.8 with a chance of 6e-7, one of 0.85 with 5e-9.
BANDS, ROWS = 20, 3
#: Sets of one bucket that are verified together; a larger bucket is dealt into parts.
CHUNK = 256
MIX = np.uint64(0xBF58476D1CE4E5B9)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(words: np.ndarray, ends: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its ``width``-word shingles, from the hashes of its words.

    A text of fewer words is one shingle, one of none too: such texts are equal.
    """
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    grams = np.zeros(max(len(words) - width + 1, 0), dtype=np.uint64)
    for k in range(width):
        grams = _mixed((grams + np.uint64(0x9E3779B97F4A7C15)) ^ words[k: k + len(grams)])
    out = []
    for a, b in zip(starts.tolist(), ends.tolist()):
        if b - a >= width:
            out.append(np.unique(grams[a: b - width + 1]))
        else:
            h = np.full(1, b - a, dtype=np.uint64)
            for k in range(a, b):
                h = _mixed((h + np.uint64(0x9E3779B97F4A7C15)) ^ words[k: k + 1])
            out.append(h)
    return out


def buckets(sets: list[np.ndarray], bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """``bands`` bucket numbers per set."""
    rng = np.random.default_rng(20250102)
    salt = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    factor = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    h, starts = np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), bands), dtype=np.uint64)
    for band in range(bands):
        key = np.full(len(sets), band + 1, dtype=np.uint64)
        for i in range(band * rows, (band + 1) * rows):
            x = (h ^ salt[i]) * factor[i]
            x ^= x >> np.uint64(32)
            x *= MIX
            key = _mixed(key ^ np.minimum.reduceat(x, starts))
        out[:, band] = key
    return out


def _texts(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    for batch in batches:
        if batch.num_rows:
            words = batch.column(1)
            ends = np.asarray(words.offsets, dtype=np.int64)
            flat = np.asarray(words.values, dtype=np.int64)[ends[0]: ends[-1]].view(np.uint64)
            yield batch.column(0), shingle_sets(flat, ends[1:] - ends[0], width)


def _sketch(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, sets in _texts(batches, width):
            digests = [blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            found = buckets(sets, bands, rows).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, bands, dtype=np.int32)), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([row, pa.array(digests, pa.binary()), lists], names=["row", "digest", "buckets"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, sets in _texts(batches, width):
            ends = np.cumsum([0] + [len(s) for s in sets], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([row, lists], names=["_node", "shingles"])

    return run


def similar(both: int | Column, sizes: int | Column) -> bool | Column:
    """Jaccard of at least OVER / UNDER, from the size of the intersection and the sum of both sizes."""
    return both * (OVER + UNDER) >= sizes * OVER


def forest(nodes: list[int], sets: list[frozenset], roots: list[int]) -> list[tuple[int, int]]:
    """Verified links that connect what is similar, directly or through others; what is connected already is not compared."""
    start: dict[int, list[int]] = {}
    for i, r in enumerate(roots):
        start.setdefault(r, []).append(i)
    groups, edges = [], []
    for mine in start.values():
        rest = []
        for members in groups:
            met = next(((i, j) for i in mine for j in members
                        if OVER * max(len(sets[i]), len(sets[j])) <= UNDER * min(len(sets[i]), len(sets[j]))
                        and similar(len(sets[i] & sets[j]), len(sets[i]) + len(sets[j]))), None)
            if met is None:
                rest.append(members)
            else:
                edges.append((nodes[met[0]], nodes[met[1]]))
                mine = members + mine
        groups = rest + [mine]
    return edges


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def emit(held: dict[int, tuple[int, frozenset]]) -> pa.RecordBatch:
        out = forest(list(held), [s for _, s in held.values()], [r for r, _ in held.values()])
        return pa.RecordBatch.from_arrays([pa.array([e[0] for e in out], pa.int64()), pa.array([e[1] for e in out], pa.int64())], names=["a", "b"])

    at, held = None, {}
    for batch in batches:
        *where, nodes, roots, sets = batch.columns
        for i, run in enumerate(zip(*[c.to_pylist() for c in where])):
            if run != at:
                if len(held) > 1:
                    yield emit(held)
                at, held = run, {}
            held[nodes[i].as_py()] = (roots[i].as_py(), frozenset(sets[i].values.to_numpy().tolist()))
    if len(held) > 1:
        yield emit(held)


def mixed_buckets(shared: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """``bucket, node, root`` of the buckets that hold more than one component of the links."""
    rooted = components(links).select(F.col("node").alias("_n"), F.col("root").alias("_root"))
    known = shared.join(rooted, F.col("node") == F.col("_n"), "left").select("bucket", "node", F.coalesce("_root", "node").alias("root"))
    several = known.groupBy("bucket").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).filter("_lo < _hi").select(F.col("bucket").alias("_bucket"))
    return materialise(known.join(several, F.col("bucket") == F.col("_bucket"), "left_semi"), name)


def open_runs(open_: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``bucket, i, j, node, root``: the runs in which the members of ``open_(bucket, node, root)`` are compared.

    The members of a bucket's largest component meet the others, and the others
    one another, in parts of about ``chunk``.
    """
    counts = open_.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("_n"))
    dealt = counts.groupBy(F.col("bucket").alias("_b")).agg(F.max(F.struct("_n", "root")).alias("_most"), F.sum("_n").alias("_all"))
    parts = lambda n: F.ceil(n / chunk).cast("long")
    dealt = dealt.select("_b", F.col("_most.root").alias("_main"), parts(F.col("_most._n")).alias("_q"), parts(F.col("_all") - F.col("_most._n")).alias("_r"))
    placed = open_.join(dealt, F.col("bucket") == F.col("_b"))
    main, hashed = F.col("root") == F.col("_main"), F.xxhash64("node")
    own = F.pmod(hashed, F.when(main, F.col("_q")).otherwise(F.col("_r")))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    run = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    # run (i, j): part i of the others with part j of the main component; from _q on, with another part of the others
    of_main = F.transform(upto("_r"), lambda i: run(i, F.col("_own")))
    of_rest = F.concat(F.transform(upto("_q"), lambda j: run(F.col("_own"), j)),
                       F.transform(F.filter(upto("_r"), lambda o: o != F.col("_own")), lambda o: run(F.least(o, F.col("_own")), F.col("_q") + F.greatest(o, F.col("_own")))))
    runs = placed.withColumn("_own", own).select("bucket", "node", "root", F.explode(F.when(main, of_main).otherwise(of_rest)).alias("_run"))
    return runs.select("bucket", "_run.i", "_run.j", "node", "root")


def simhash_pairs(coded: DataFrame) -> DataFrame:
    """From ``node, code``: pairs ``(node, other)``, ``other`` less, of nodes whose codes are equal or linked within op7's radius.

    A code's nodes meet its least one, and of linked codes the least nodes meet:
    no more pairs than nodes and links of codes.
    """
    least = materialise(coded.groupBy("code").agg(F.min("node").alias("least")), "near-codes")
    same = coded.join(least.select(F.col("code").alias("_c"), F.col("least").alias("other")), F.col("code") == F.col("_c")).select("node", "other")
    links = op07_near_simhash.near_links(least.select("code")).distinct()
    of = lambda code, name: least.select(F.col("code").alias(code), F.col("least").alias(name))
    met = links.join(of("_a", "_of_a"), F.col("a") == F.col("_a")).join(of("_b", "_of_b"), F.col("b") == F.col("_b"))
    linked = met.select(F.greatest("_of_a", "_of_b").alias("node"), F.least("_of_a", "_of_b").alias("other"))
    return same.unionByName(linked).filter("other < node").distinct()


def near_links(
    rows: DataFrame, codes: DataFrame, width: int = WIDTH, bands: int = BANDS, per_band: int = ROWS, chunk: int = CHUNK,
) -> tuple[DataFrame, DataFrame]:
    """From ``row, words`` (hashes) and ``row, code`` (SimHash): every row's ``node``, one row of each distinct shingle set, and the verified edges
    ``(a, b)`` of nodes.

    First the pairs that SimHash finds are verified, and every node against one
    other node of its buckets, the least. Components of these links are known when the buckets that still hold
    several components are compared in full: the members of a bucket's largest
    component with the others, and the others among themselves, in parts. What
    is one component already, as a great group of near copies, is not compared
    again, and no pair of a bucket's different components is left out.
    """
    spark = rows.sparkSession
    sketched = materialise(rows.mapInArrow(_sketch(width, bands, per_band), "row long, digest binary, buckets array<long>"), "near-sketches")
    first = sketched.groupBy("digest").agg(F.min("row").alias("node"))
    classes = materialise(sketched.select("row", F.col("digest").alias("_d")).join(first, F.col("_d") == F.col("digest")).select("row", "node"), "near-classes")
    nodes = classes.filter("row = node").select("node")
    every = sketched.join(nodes, F.col("row") == F.col("node"), "left_semi").select(F.col("row").alias("node"), F.explode("buckets").alias("bucket"))
    sizes = every.groupBy("bucket").agg(F.min("node").alias("_least"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").withColumnRenamed("bucket", "_bucket")
    met = materialise(every.join(sizes, F.col("bucket") == F.col("_bucket")).select("bucket", "node", F.col("_least").alias("least")), "near-buckets")
    coded = codes.join(nodes.withColumnRenamed("node", "_node"), F.col("row") == F.col("_node"), "left_semi").select(F.col("row").alias("node"), "code")
    linked = materialise(simhash_pairs(materialise(coded, "near-coded")), "near-linked")
    wanted = met.select("node").unionByName(linked.select("node")).unionByName(linked.select(F.col("other").alias("node"))).distinct().withColumnRenamed("node", "_wanted")
    sets = materialise(rows.join(wanted, F.col("row") == F.col("_wanted"), "left_semi").mapInArrow(_sets(width), "_node long, shingles array<long>"), "near-sets")

    pairs = met.groupBy("node").agg(F.min("least").alias("other")).filter("other < node").unionByName(linked).distinct()
    other = sets.select(F.col("_node").alias("_other"), F.col("shingles").alias("others"))
    both = pairs.join(sets, F.col("node") == F.col("_node")).join(other, F.col("other") == F.col("_other"))
    near = similar(F.size(F.array_intersect("shingles", "others")), F.size("shingles") + F.size("others"))
    stars = materialise(both.filter(near).select(F.col("node").alias("a"), F.col("other").alias("b")), "near-stars")

    open_ = mixed_buckets(met.select("bucket", "node"), stars, "near-open")
    held = open_runs(open_, chunk).join(sets, F.col("node") == F.col("_node")).select("bucket", "i", "j", "node", "root", "shingles")
    where = ["bucket", "i", "j"]
    checked = held.repartition(partitions(spark), *where).sortWithinPartitions(*where).mapInArrow(_verified, "a long, b long")
    return classes, stars.unionByName(materialise(checked, "near-checked"))


def keep_one(docs: DataFrame, width: int = WIDTH, bands: int = BANDS, per_band: int = ROWS, chunk: int = CHUNK) -> DataFrame:
    """The documents with one row of each component of near copies: the least doc_id, null last; of repeated ids any.

    Two documents are near copies if the sets of their ``width``-word shingles,
    in lower case (ASCII), have a Jaccard similarity of at least 0.8. All
    columns stay, whatever their names.
    """
    place, kept = free_name(docs, "__near_row"), free_name(docs, "__kept")
    numbered = materialise(docs.withColumn(place, F.monotonically_increasing_id()), "near-documents")
    rows = numbered.select(F.col(place).alias("row"), F.transform(tokens(F.col("text")), lambda w: F.xxhash64(w)).alias("words"))
    codes = fingerprints(numbered, tokens(F.col("text")), width, [place]).select(F.col(place).alias("row"), F.col("fingerprint").alias("code"))
    classes, links = near_links(rows, codes, width, bands, per_band, chunk)
    rooted = components(links).select(F.col("node").alias("_n"), F.col("root").alias("_root"))
    ids = numbered.select(F.col(place).alias("_row"), "doc_id")
    placed = classes.join(rooted, F.col("node") == F.col("_n"), "left").select("row", F.coalesce("_root", "node").alias("root")).join(ids, F.col("row") == F.col("_row"))
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("row").alias("r"))
    chosen = placed.groupBy("root").agg(F.min(order).alias("k")).select(F.col("k.r").alias(kept))
    return numbered.join(chosen, F.col(place) == F.col(kept), "left_semi").select(*docs.columns)
