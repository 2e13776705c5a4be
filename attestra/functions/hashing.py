"""Content hashes: row digests, canonical JSON, tree digests, array hashes."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from attestra import fixed_values as fixed
from attestra.session import cut_lineage, small_side


def sha256_text(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def event_id(prefix: str, seed: Column) -> Column:
    """Prefix and the first 32 hex digits of the seed's hash."""
    return F.concat(F.lit(prefix), F.substring(sha256_text(seed), 1, 32))


def _dumped(documents: Iterator[pd.Series], ascii_only: bool) -> Iterator[pd.Series]:
    for batch in documents:
        yield batch.map(lambda d: None if d is None else _dump(d, ascii_only)) if batch.notna().any() else batch


@F.pandas_udf(T.StringType())
def _ascii_json(documents: Iterator[pd.Series]) -> Iterator[pd.Series]:
    yield from _dumped(documents, True)


@F.pandas_udf(T.StringType())
def _utf8_json(documents: Iterator[pd.Series]) -> Iterator[pd.Series]:
    yield from _dumped(documents, False)


def _dump(document: str, ascii_only: bool) -> str:
    value = json.loads(document)
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=ascii_only, allow_nan=False)


def canonical_json(document: Column, form: str = "ascii") -> Column:
    """Byte-exact canonical JSON: keys sorted, no blanks.

    ``ascii`` escapes other characters, ``utf8`` keeps them, ``line`` is utf8
    plus a newline. Spark's own JSON writer orders keys and prints floats
    differently, so the text is made by an Arrow-batched function.
    """
    if form == "ascii":
        return _ascii_json(document)
    if form == "utf8":
        return _utf8_json(document)
    return F.concat(_utf8_json(document), F.lit("\n"))


def sorted_json(document: Column) -> Column:
    """Key-sorted JSON made inside the JVM, for comparing values within the engine."""
    return F.to_json(F.try_parse_json(document))


def _by_name(value: Column, kind: T.DataType) -> Column | None:
    """The value with the fields of all its structs in order of their names; None where Spark may print a value otherwise than Python."""
    if isinstance(kind, (T.StringType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return value
    if isinstance(kind, T.ArrayType):
        if not isinstance(kind.elementType, (T.ArrayType, T.StructType)):
            return None if _by_name(value, kind.elementType) is None else value
        if _by_name(F.lit(None), kind.elementType) is None:
            return None
        return F.transform(value, lambda entry: _by_name(entry, kind.elementType))
    if not isinstance(kind, T.StructType) or len(set(kind.names)) < len(kind.names):
        return None
    fields = [(f.name, _by_name(value.getField(f.name), f.dataType)) for f in sorted(kind, key=lambda f: f.name)]
    if any(column is None for _, column in fields):
        return None
    return F.when(value.isNotNull(), F.struct(*[column.alias(name) for name, column in fields]))


def with_record_sha256(frame: DataFrame, fields: Sequence[str], name: str) -> DataFrame:
    """Add the hash of the named fields of a row as canonical JSON, null fields included.

    Where the fields hold text, integers and truth values, Spark's own JSON of
    fields in order of their names is the canonical one, unless it has
    characters that either side escapes; only those rows go through Python.
    """
    columns = {f: _by_name(F.col(f), frame.schema[f].dataType) for f in sorted(fields)}
    direct = all(c is not None for c in columns.values())
    document = F.to_json(F.struct(*[c.alias(f) if direct else F.col(f) for f, c in columns.items()]), {"ignoreNullFields": "false"})
    made, text = frame.withColumn(f"{name}_json", document), F.col(f"{name}_json")
    plain = F.lit(direct) & (F.octet_length(text) == F.length(text)) & ~text.contains("\\u") & ~text.contains("\x7f")
    canonical = F.coalesce(F.when(plain, text), canonical_json(F.when(~plain, text)))
    return made.withColumn(name, sha256_text(canonical)).drop(f"{name}_json")


#: Distinct rows that a leaf of a digest tree holds on average at most.
LEAF_ROWS = 4096


def leaf_depth(rows: Column, leaf_rows: int = LEAF_ROWS) -> Column:
    """Hex digits of a leaf's name, so that a set of so many rows has leaves of at most ``leaf_rows`` on average."""
    return reduce(lambda total, more: total + more, [(rows > leaf_rows * 16 ** k).cast("int") for k in range(12)])


def tree_digest(
    frame: DataFrame, keys: list[str], identifier: str, digest: str, name: str = "tree_sha256", leaf_rows: int = LEAF_ROWS
) -> DataFrame:
    """Order-free digest of (identifier, digest) rows per key, in bounded groups.

    Equal rows are counted first. Rows fall into leaves by their hash; how many
    follows from the key's own number of rows, so a leaf stays small at any
    size, and a key with a third of all rows is fine. Leaves combine to nodes of
    two hex digits less at a time (at most 256 in one), the last ones to the
    root. The digest depends on the key's rows alone.
    """
    row = F.concat_ws(":", F.col(identifier).cast("string"), F.col(digest))
    counted = cut_lineage(frame.select(*keys, row.alias("_row")).groupBy(*keys, "_row").agg(F.count(F.lit(1)).alias("_n")))
    sizes = counted.groupBy(*keys).agg(leaf_depth(F.count(F.lit(1)), leaf_rows).alias("_depth"))
    sizes = small_side(sizes.select(*[F.col(k).alias(f"_of_{k}") for k in keys], "_depth"))
    deepest = sizes.agg(F.max("_depth")).first()[0] or 0
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    entry = F.when(F.col("_n") > 1, F.concat_ws("*", "_row", "_n")).otherwise(F.col("_row"))
    placed = counted.join(sizes, same).select(*keys, F.substr(sha256_text(F.col("_row")), F.lit(1), F.col("_depth")).alias("_at"), entry.alias("_row"), "_n")
    nodes = placed.groupBy(*keys, "_at").agg(_digest_of("_row").alias("_hash"), F.sum("_n").alias("_n"))
    for length in range((deepest - 1) // 2 * 2, 0, -2):
        # a key whose nodes are named so briefly already has one node here, which passes unchanged
        above = nodes.select(*keys, F.substring("_at", 1, length).alias("_up"), "_at", "_hash", F.concat_ws(":", "_at", "_hash").alias("_row"), "_n")
        made = F.when(F.max(F.length("_at")) > length, _digest_of("_row")).otherwise(F.first("_hash"))
        nodes = above.groupBy(*keys, "_up").agg(made.alias("_hash"), F.sum("_n").alias("_n")).withColumnRenamed("_up", "_at")
    return nodes.withColumn("_row", F.concat_ws(":", "_at", "_hash")).groupBy(*keys).agg(_digest_of("_row").alias(name), F.sum("_n").alias("member_count"))


def _digest_of(column: str) -> Column:
    return sha256_text(F.array_join(F.array_sort(F.collect_list(column)), ","))


def _snapshots(keys: int):
    """One running hash per key, fed entry by entry from rows in order of their keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, count, state, types = None, 0, None, None

        def emit() -> pa.RecordBatch:
            state.update(b"]")
            made = [pa.array([k], t) for k, t in zip(at, types)] + [pa.array([count], pa.int64()), pa.array([state.hexdigest()])]
            return pa.RecordBatch.from_arrays(made, names=[f"c{i}" for i in range(len(made))])

        for batch in batches:
            types = types or [c.type for c in batch.columns[:keys]]
            entries = batch.column(keys).to_pylist()
            for where, entry in zip(zip(*[c.to_pylist() for c in batch.columns[:keys]]), entries):
                if where != at:
                    if at is not None:
                        yield emit()
                    at, count, state = where, 0, hashlib.sha256(b"[")
                state.update((b"," if count else b"") + entry.encode())
                count += 1
        if at is not None:
            yield emit()

    return run


def _snapshot_entry(document_sha256: Column, evidence_id: Column) -> Column:
    return F.concat(F.lit('{"document_sha256":"'), document_sha256, F.lit('","evidence_id":"'), evidence_id, F.lit('"}'))


def listed_snapshot_sha256(refs: Column) -> Column:
    """The flat snapshot hash of the distinct documents that one row's references name; NULL where there is none."""
    entries = F.transform(refs, lambda r: F.struct(r["evidence_id"].alias("id"), _snapshot_entry(r["document_sha256"], r["evidence_id"]).alias("entry")))
    held = F.array_sort(F.array_distinct(F.filter(entries, lambda e: e["entry"].isNotNull())))
    listed = F.array_join(F.transform(held, lambda e: e["entry"]), ",")
    return F.when(F.size(held) > 0, sha256_text(F.concat(F.lit("["), listed, F.lit("]"))))


def snapshot_sha256(documents: DataFrame, keys: list[str], limit: int = fixed.MAX_EVIDENCE_DOCUMENTS) -> DataFrame:
    """Flat snapshot hash of one evidence memory: canonical JSON of its sorted documents.

    Every memory has its hash; ``over_limit`` marks one of more than ``limit``
    documents. The flat form is one hash over all of a memory in order, so a
    memory is read by one task; its rows are sorted by Spark, which spills, and
    pass through the hash one after the other, never held together.
    """
    entry = _snapshot_entry(F.col("document_sha256"), F.col("evidence_id"))
    ordered = documents.select(*keys, entry.alias("_entry"), F.col("evidence_id").alias("_id")).filter(F.col("_entry").isNotNull())
    ordered = ordered.repartition(*keys).sortWithinPartitions(*keys, "_id", "_entry").drop("_id")
    schema = T.StructType([f for f in ordered.schema if f.name in keys]).add("document_count", "long").add("memory_snapshot_sha256", "string")
    return ordered.mapInArrow(_snapshots(len(keys)), schema).withColumn("over_limit", F.col("document_count") > limit)


# the declared kinds: how cells are stored, and the name the header gives that
STORED = {"double": ("<f8", "<f8"), "long": ("<i8", "<i8"), "boolean": ("u1", "|u1")}


def array_sha256(grid: np.ndarray, kind: str) -> str:
    """Hash of one raster of a declared kind: a canonical JSON header line, then the cells row by row.

    Reals and integers are eight bytes, least first; a truth value is one byte;
    every NaN has the same bits.
    """
    stored, named = STORED[kind]
    cells = np.ascontiguousarray(grid, dtype=stored)
    if kind == "double":
        cells = np.where(np.isnan(cells), np.nan, cells)
    header = _dump(json.dumps({"array_hash_id": fixed.ARRAY_HASH_ID, "dtype": named, "shape": grid.shape}), True)
    digest = hashlib.sha256(f"{header}\n".encode())
    digest.update(cells.tobytes())
    return digest.hexdigest()


def array_hashes(cells: DataFrame, keys: list[str], value: str, width: int, height: int, kind: str = "double") -> DataFrame:
    """Array hash per key from cells (row, col, value); absent cells are NaN, 0 or False.

    One group is one raster of ``width`` x ``height``: callers keep to the grid
    limits, so a group's size is bounded by the grid, never by the data.
    """
    fill = np.nan if kind == "double" else 0
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.select(*keys).schema) + ", array_sha256 string"

    def one_raster(key, block: pd.DataFrame) -> pd.DataFrame:
        grid = np.full((height, width), fill, dtype=STORED[kind][0])
        present = block[block[value].notna()]
        grid[present["row"].to_numpy(), present["col"].to_numpy()] = present[value].to_numpy()
        return pd.DataFrame([[*key, array_sha256(grid, kind)]], columns=[*keys, "array_sha256"])

    return cells.select(*keys, "row", "col", value).groupBy(*keys).applyInPandas(one_raster, schema)
