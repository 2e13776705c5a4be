"""Token counts from counts of distinct pre-tokens."""

from __future__ import annotations

import os
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from attestra.llm.common import materialise, partitions, whole_text
from attestra.llm.pretokens import byte_pretokens, tokenizer

#: Bytes of text after which a block of documents is closed; a longer text is a block of its own.
BLOCK_BYTES = 8 << 20
#: Bytes of text for each range of pre-tokens; a range's distinct pre-tokens are counted in one task.
RANGE_BYTES = 8 << 20
BLOCK_SCHEMA = "block long, distinct int, words array<struct<range int, data binary>>, ids array<long>, n_bytes array<long>, ends binary, which binary, often binary"
WORDS = pa.list_(pa.struct([("range", pa.int32()), ("data", pa.binary())]))


def _packed(values: np.ndarray) -> bytes:
    """Numbers as planes of their bytes, which pack well where they are small."""
    planes = np.ascontiguousarray(values.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=max(4 * n, 1)), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _listed(words: list[str]) -> bytes:
    """Pre-tokens one after the other, each behind its length in bytes."""
    data = [w.encode() for w in words]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(len(d).to_bytes(4, "little") + d for d in data))


def _unlisted(data: bytes) -> list[str]:
    raw, at, out = zstandard.ZstdDecompressor().decompressobj().decompress(data), 0, []
    while at < len(raw):
        n = int.from_bytes(raw[at: at + 4], "little")
        out.append(raw[at + 4: at + 4 + n].decode())
        at += 4 + n
    return out


def _blocks(path: str, block_bytes: int, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        local: dict[str, int] = {}
        ids, sizes, ends, which, often, held = [], [], [], [], [], 0

        def block() -> pa.RecordBatch:
            # the block's pre-tokens in order of their ranges; documents hold their places in that order
            found = list(local)
            place = np.fromiter((zlib.crc32(w.encode()) % ranges for w in found), np.int64, len(found))
            order = np.argsort(place, kind="stable")
            moved = np.empty(len(found), dtype=np.uint32)
            moved[order] = np.arange(len(found))
            cuts = np.flatnonzero(np.concatenate([[True], np.diff(place[order]) > 0])) if len(found) else np.zeros(0, int)
            words = [{"range": int(place[order[a]]), "data": _listed([found[k] for k in order[a:b]])} for a, b in zip(cuts, np.append(cuts[1:], len(found)))]
            columns = [pa.array([number]), pa.array([len(found)], pa.int32()), pa.array([words], WORDS), pa.array([ids], pa.list_(pa.int64())),
                       pa.array([sizes], pa.list_(pa.int64())), pa.array([np.cumsum(ends, dtype=np.int64).tobytes()], pa.binary()),
                       pa.array([_packed(moved[np.concatenate(which)])], pa.binary()), pa.array([_packed(np.concatenate(often))], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["block", "distinct", "words", "ids", "n_bytes", "ends", "which", "often"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py()
                found = Counter(byte_pretokens(text, path))
                for pretoken in found:
                    if pretoken not in local:
                        local[pretoken] = len(local)
                ids.append(doc_id.as_py())
                sizes.append(len(text.encode()))
                ends.append(len(found))
                which.append(np.fromiter(map(local.__getitem__, found), dtype=np.uint32, count=len(found)))
                often.append(np.fromiter(found.values(), dtype=np.uint32, count=len(found)))
                held += sizes[-1]
                if held >= block_bytes:
                    yield block()
                    number += 1
                    local, ids, sizes, ends, which, often, held = {}, [], [], [], [], [], 0
        if ids:
            yield block()

    return run


def _pieces(path: str):
    """Count every distinct pre-token of a range once, and answer each block's list with its counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, at, known = tokenizer(path), None, {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["range"] != at:
                    at, known = row["range"], {}
                words = _unlisted(row["data"])
                new = [w for w in words if w not in known]
                known.update(zip(new, (len(e.ids) for e in encoder.encode_batch(new, add_special_tokens=False)) if new else ()))
                counts = np.fromiter(map(known.__getitem__, words), np.uint32, len(words))
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]]), pa.array([at], pa.int32()), pa.array([len(words)], pa.int32()), pa.array([_packed(counts)], pa.binary())],
                                                 names=["block", "range", "n", "pieces"])

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            answers = sorted(row["answers"] or [], key=lambda a: a["range"])
            pieces = np.concatenate([np.zeros(0, np.int64), *[_unpacked(a["pieces"], a["n"]).astype(np.int64) for a in answers]])
            ends = np.frombuffer(row["ends"], dtype=np.int64)
            n = int(ends[-1])
            total = np.concatenate([[0], np.cumsum(_unpacked(row["often"], n).astype(np.int64) * pieces[_unpacked(row["which"], n)])])
            tokens = total[ends] - total[np.concatenate([[0], ends[:-1]])]
            yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(row["n_bytes"], pa.int64()), pa.array(tokens)], names=["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, path: str, block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens under the tokenizer file ``path``.

    Documents are gathered in blocks of some megabytes as they are read. A block
    holds its distinct pre-tokens once, by range of their hash, and each
    document's frequencies as places among them. A range meets the lists of all
    blocks, counts every distinct pre-token in pieces once, and answers each
    list in its order; joined back to its block, the answer gives each document
    the sum of frequency times count. A frequent pre-token is in each block's
    list once, however often it stands in the texts. No ids are kept. A null or
    empty text has no tokens; repeated rows are counted each.
    """
    total = docs.agg(F.sum(F.octet_length(whole_text(F.col("text"))))).first()[0] or 0
    ranges = max(partitions(docs.sparkSession), -(-total // range_bytes))
    texts = docs.select(F.col("doc_id").cast("long"), whole_text(F.col("text")))
    blocks = materialise(texts.mapInArrow(_blocks(path, block_bytes, ranges), BLOCK_SCHEMA), "pretoken-blocks", compression="uncompressed")
    lists = blocks.select("block", F.inline("words")).repartition(ranges, "range").sortWithinPartitions("range")
    answered = lists.mapInArrow(_pieces(path), "block long, range int, n int, pieces binary")
    answers = answered.groupBy(F.col("block").alias("_b")).agg(F.collect_list(F.struct("range", "n", "pieces")).alias("answers"))
    joined = blocks.drop("words").join(answers, F.col("block") == F.col("_b"), "left")
    return joined.select("ids", "n_bytes", "ends", "which", "often", "answers").mapInArrow(_sums, "doc_id long, n_bytes long, n_tokens long")
