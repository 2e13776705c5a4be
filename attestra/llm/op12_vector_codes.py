"""Codes of vectors by parts, their codebooks found by Lloyd rounds over cover trees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from attestra.llm.common import materialise
from attestra.session import small_side

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors of one tree, and of a leaf whose points are compared one by one.
CHUNK, LEAF = 8192, 24
#: Integers beyond this are taken as this, so that every sum of squares of a vector stays in 64 bits.
LARGEST = 1 << 27
TREE = "part int, points binary, radius binary, start binary, end binary, first binary, children binary"
TREES = f"vec_id array<long>, label array<string>, dim int, trees array<struct<{TREE.replace(' ', ':').replace(',:', ',')},order:binary>>"


class Tree:
    """A cover tree over integer points, as arrays.

    Points are in the tree's order, so a node's descendants are ``start`` to
    ``end``, and its centre is the one at ``start``. Children of a node are
    ``first`` to ``first + children`` and lie within half its cover distance;
    a leaf has none. ``sums`` are cumulative, so a node's sum is a difference.
    """

    def __init__(self, points, radius, start, end, first, children):
        self.points, self.radius, self.start, self.end, self.first, self.children = points, radius, start, end, first, children
        self.sums = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points, axis=0)])


def squares(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of every point to every entry, in integers."""
    apart = points[:, None, :] - entries[None]
    return np.einsum("ijk,ijk->ij", apart, apart)


def cover_tree(points: np.ndarray, leaf: int = LEAF) -> tuple[Tree, np.ndarray]:
    """The tree of some points and the order it puts them in.

    A node's points are covered by centres at more than half its distance from
    one another: the node's own centre first, then of the points left the first.
    Each centre takes what lies within half the distance, and its points again
    form a node, until a node has few points or only equal ones.
    """
    order = np.arange(len(points))
    radius, start, end, first, children = [0.0], [0], [len(points)], [0], [0]
    level, at = [0], 0
    while at < len(level):
        node = level[at]
        at += 1
        a, b = start[node], end[node]
        mine = order[a:b]
        apart = np.sqrt(((points[mine] - points[mine[0]]) ** 2).sum(axis=1).astype(np.float64)) if b > a else np.zeros(0)
        radius[node] = float(apart.max(initial=0.0))
        if b - a <= leaf or radius[node] == 0:
            continue
        half, groups, left = radius[node] / 2, [], mine
        while len(left):
            near = apart <= half
            groups.append(left[near])
            left = left[~near]
            if len(left):
                apart = np.sqrt(((points[left] - points[left[0]]) ** 2).sum(axis=1).astype(np.float64))
        order[a:b] = np.concatenate(groups)
        first[node], children[node] = len(start), len(groups)
        for group in groups:
            level.append(len(start))
            start.append(a)
            a += len(group)
            end.append(a)
            radius.append(0.0)
            first.append(0)
            children.append(0)
    whole = [np.array(x, dtype=np.int64) for x in (start, end, first, children)]
    return Tree(points[order], np.array(radius), *whole), order


def assign(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest entries of all points, ties to the lower index: (starts, ends, entry) of whole subtrees, entry per point, points compared.

    For a node with centre p and radius r, an entry c cannot be nearest to any
    of its points when d(p, c) - r > d(p, best) + r. A node left with one entry
    goes to it whole; a node of equal points goes to its centre's. Other nodes
    give their children the entries they are left with; leaves are compared
    point by point, in integers.
    """
    entry = np.full(len(tree.points), -1, dtype=np.int64)
    nodes, able = np.zeros(1, np.int64), np.ones((1, len(entries)), bool)
    starts, ends, chosen, compared = [], [], [], 0
    while len(nodes):
        d2 = squares(tree.points[np.minimum(tree.start[nodes], len(tree.points) - 1)], entries)
        d2 = np.where(able, d2, np.iinfo(np.int64).max)
        best, d = d2.argmin(axis=1), np.sqrt(d2.astype(np.float64))
        r = tree.radius[nodes]
        # the margin is far above what square roots are off by, so that ties are never cut
        able = able & (d <= (d.min(axis=1) + 2 * r + 1e-6 * (1 + d.min(axis=1)))[:, None])
        whole = (able.sum(axis=1) == 1) | (r == 0)
        starts.append(tree.start[nodes[whole]])
        ends.append(tree.end[nodes[whole]])
        chosen.append(best[whole])
        nodes, able = nodes[~whole], able[~whole]
        leaf = tree.children[nodes] == 0
        if leaf.any():
            sizes = tree.end[nodes[leaf]] - tree.start[nodes[leaf]]
            places = np.repeat(tree.start[nodes[leaf]] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            exact = np.where(np.repeat(able[leaf], sizes, axis=0), squares(tree.points[places], entries), np.iinfo(np.int64).max)
            entry[places] = exact.argmin(axis=1)
            compared += len(places)
        inner, counts = nodes[~leaf], tree.children[nodes[~leaf]]
        nodes = np.repeat(tree.first[inner] - np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64), counts) + np.arange(counts.sum())
        able = np.repeat(able[~leaf], counts, axis=0)
    starts, ends, chosen = (np.concatenate(x) for x in (starts, ends, chosen))
    return starts, ends, chosen, entry, compared


def totals(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Count and sum of the points of each entry: whole subtrees from the cumulative sums, the others point by point."""
    starts, ends, chosen, entry, _ = assign(tree, entries)
    count, total = np.zeros(len(entries), np.int64), np.zeros_like(entries)
    np.add.at(count, chosen, ends - starts)
    np.add.at(total, chosen, tree.sums[ends] - tree.sums[starts])
    single = np.flatnonzero(entry >= 0)
    np.add.at(count, entry[single], 1)
    np.add.at(total, entry[single], tree.points[single])
    return count, total


def nearest(tree: Tree, entries: np.ndarray) -> np.ndarray:
    """Entry of every point, in the tree's order."""
    starts, ends, chosen, entry, _ = assign(tree, entries)
    for a, b, c in zip(starts.tolist(), ends.tolist(), chosen.tolist()):
        entry[a:b] = c
    return entry


def _plant(parts: int, leaf: int, chunk: int):
    """Trees of every ``chunk`` vectors of a task, one per part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def planted(table: pa.Table) -> pa.RecordBatch:
            flat = table.column("whole").combine_chunks()
            width = len(flat.values) // max(len(flat), 1)
            vectors = flat.flatten().to_numpy().reshape(len(flat), width)
            trees = []
            for part, points in enumerate(np.split(vectors, parts, axis=1)):
                tree, order = cover_tree(points, leaf)
                trees.append({"part": part, "points": tree.points.tobytes(), "radius": tree.radius.tobytes(), "start": tree.start.tobytes(), "end": tree.end.tobytes(),
                              "first": tree.first.tobytes(), "children": tree.children.tobytes(), "order": order.tobytes()})
            kind = pa.struct([("part", pa.int32())] + [(n, pa.binary()) for n in ("points", "radius", "start", "end", "first", "children", "order")])
            ids, labels = table.column("vec_id").combine_chunks(), table.column("label").combine_chunks()
            one = pa.array([0, len(ids)], pa.int32())
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(one, ids), pa.ListArray.from_arrays(one, labels), pa.array([width], pa.int32()), pa.array([trees], pa.list_(kind))],
                                              names=["vec_id", "label", "dim", "trees"])

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= chunk:
                table = pa.Table.from_batches(held)
                yield planted(table.slice(0, chunk))
                held, n = table.slice(chunk).to_batches(), n - chunk
        if n:
            yield planted(pa.Table.from_batches(held))

    return run


def _tree(row: dict, width: int) -> Tree:
    whole = [np.frombuffer(row[k], np.int64) for k in ("start", "end", "first", "children")]
    return Tree(np.frombuffer(row["points"], np.int64).reshape(-1, width), np.frombuffer(row["radius"], np.float64), *whole)


def _round(books: np.ndarray):
    """A task's count and sum of every entry of every part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(books.shape[:2], np.int64), np.zeros_like(books)
        for batch in batches:
            for row in batch.column(0):
                for tree in row.as_py():
                    n, s = totals(_tree(tree, books.shape[2]), books[tree["part"]])
                    count[tree["part"]] += n
                    total[tree["part"]] += s
        part, entry = np.nonzero(count)
        for p, e in zip(part.tolist(), entry.tolist()):
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([e], pa.int32()), pa.array([count[p, e]]), pa.array([total[p, e]], pa.list_(pa.int64()))],
                                             names=["part", "entry", "n", "sums"])

    return run


def _codes(books: np.ndarray):
    """Codes and errors of every vector of a task's trees."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, trees in zip(*batch.columns):
                code, error = np.zeros((len(ids.values), len(books)), np.int64), np.zeros(len(ids.values), np.int64)
                for row in trees.as_py():
                    tree, book, order = _tree(row, books.shape[2]), books[row["part"]], np.frombuffer(row["order"], np.int64)
                    entry = nearest(tree, book)
                    code[order, row["part"]] = entry
                    error[order] += ((tree.points - book[entry]) ** 2).sum(axis=1)
                texts = ["".join(f"{c:02x}" for c in row) for row in code.tolist()]
                yield pa.RecordBatch.from_arrays([ids.values, labels.values, pa.array(texts), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def integers(vector: Column) -> Column:
    """Every component as floor(4096 * x), no further than LARGEST from zero."""
    scaled = lambda x: F.floor(F.greatest(F.lit(float(-LARGEST)), F.least(F.lit(float(LARGEST)), x.cast("double") * SCALE)))
    return F.transform(vector, scaled)


def kept_vectors(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """``vec_id, label, whole`` of the rows whose vector is neither null nor empty and holds finite components only."""
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    some = vectors.filter(F.col(vector).isNotNull() & (F.size(vector) > 0)).filter(usable)
    return some.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), integers(F.col(vector)).alias("whole"))


def codebooks(trees: DataFrame, first: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, position) after the rounds; an entry with no points stays as it is. A round is one job, which gives a row per entry."""
    books = first
    for _ in range(rounds):
        found = trees.select("trees").mapInArrow(_round(books), "part int, entry int, n long, sums array<long>")
        sums = [F.sum(F.get("sums", F.lit(k))).alias(f"s{k}") for k in range(books.shape[2])]
        books = books.copy()
        for row in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums).collect():
            books[row["part"], row["entry"]] = [row[f"s{k}"] // row["n"] for k in range(books.shape[2])]
    return books


def vector_codes(
    vectors: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, chunk: int = CHUNK, leaf: int = LEAF,
) -> DataFrame:
    """``vec_id, label, code, error, label_error, codebooks_sha256`` of every usable vector.

    Rows whose vector is null, empty, or holds a null or non-finite component
    go. Components become floor(4096 * x), vectors are cut into equal parts, and
    each part's codebook starts from the vectors with the least ids (null last,
    then by components) and goes through the rounds. Each task plants cover
    trees over its vectors once; every round visits the trees, gives whole
    subtrees to an entry by the triangle inequality, and only a few numbers per
    entry leave the task. All arithmetic that decides is in integers.
    ``label_error`` is the error summed over equal labels, nulls together.
    Repeated rows count each; fewer vectors than entries give smaller codebooks;
    no vectors give no rows. Vectors must be of one length that the parts divide,
    else this is a ValueError. Other columns are not read.
    """
    whole = materialise(kept_vectors(vectors, vector), "whole-vectors")
    dims = whole.agg(F.min(F.size("whole")), F.max(F.size("whole"))).first()
    if dims[0] != dims[1] or (dims[0] or 0) % parts:
        raise ValueError(f"vectors have {dims[0]} to {dims[1]} components; one length is needed, a multiple of {parts}")
    start = whole.orderBy(F.col("vec_id").asc_nulls_last(), "whole").limit(entries).select("whole").collect()
    trees = materialise(whole.mapInArrow(_plant(parts, leaf, chunk), TREES), "cover-trees")
    first = np.array([r["whole"] for r in start], dtype=np.int64).reshape(len(start), parts, (dims[0] or 0) // parts).transpose(1, 0, 2)
    books = codebooks(trees, first, rounds) if len(start) else first
    coded = materialise(trees.select("vec_id", "label", "trees").mapInArrow(_codes(books), "vec_id long, label string, code string, error long"), "vector-codes")
    summed = small_side(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    met = coded.join(summed, F.col("label").eqNullSafe(F.col("_label")))
    return met.select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
