"""Language identification in two steps: the family first, then pairs of close languages."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from attestra.llm.common import free_name

BUCKETS = 1 << 13
#: Labelled documents per language that the machines are fitted on, at most.
TRAINING_ROWS = 400
#: Documents of these bytes in total are scored at a time, to bound memory.
SLICE_BYTES = 2 << 20
UNDETERMINED = "und"

# Families of languages by ISO 639-1 code. Others are a family of their own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi", "romance": "fr es it pt ro ca gl oc la", "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "uralic": "fi et hu", "turkic": "tr az kk uz ky tk", "indic": "hi bn ur pa gu mr ne si", "semitic": "ar he mt am", "baltic": "lt lv",
    "celtic": "ga cy gd br", "malay": "id ms jv tl",
}
FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes.split()}


def family(lang: str) -> str:
    return FAMILY_OF.get(lang, f"only {lang}")


def held_out(doc_id) -> F.Column:
    """Whether the id's CRC-32 is divisible by five; a null id is not held out, and teaches nothing."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of the lower-cased texts, one after the other, and where each text's begin.

    A text stands between two spaces on either side, so no trigram sees two texts.
    """
    data = [b"  " + t.lower().encode() + b"  " for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(d) for d in data])[:-1]])
    x = np.frombuffer(b"".join(data) + b"  ", dtype=np.uint8).astype(np.uint32)
    code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    code *= np.uint32(2654435769)
    return (code >> np.uint32(19)).astype(np.int32), starts


def vectors(texts: list[str]) -> np.ndarray:
    """Shares of the trigrams per text, a row of BUCKETS each."""
    out = np.zeros((len(texts), BUCKETS), dtype=np.float32)
    for row, text in enumerate(texts):
        found, _ = buckets([text])
        out[row] = np.bincount(found, minlength=BUCKETS) / len(found)
    return out


def linear_svm(x: np.ndarray, rows: np.ndarray, y: np.ndarray, cost: float = 4.0, passes: int = 12, seed: int = 7) -> np.ndarray:
    """A linear support vector machine on the given rows, by dual coordinate descent; the last weight is the constant's.

    Classes weigh alike, however many rows they have. The rows are read in
    place: the vectors are held once, however many machines are fitted.
    """
    square = np.einsum("ij,ij->i", x, x)[rows].astype(float)
    scale = 1.0 / max(float(np.sqrt(square).mean()), 1e-12)  # as if every row were about one long, beside a constant of one
    square = square * scale * scale + 1
    w, constant, alpha = np.zeros(x.shape[1], dtype=np.float32), 0.0, np.zeros(len(rows))
    limit = np.where(y > 0, cost * len(y) / (2 * max((y > 0).sum(), 1)), cost * len(y) / (2 * max((y < 0).sum(), 1)))
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        for i in rng.permutation(len(rows)):
            gradient = y[i] * (scale * float(x[rows[i]] @ w) + constant) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), limit[i])
            if new != alpha[i]:
                w += np.float32((new - alpha[i]) * y[i] * scale) * x[rows[i]]
                constant += (new - alpha[i]) * y[i]
                alpha[i] = new
    return np.append(w * np.float32(scale), np.float32(constant))


class Machines:
    """One machine per family against the rest, and one per pair of languages within a family."""

    def __init__(self, texts: list[str], langs: list[str]):
        self.langs = sorted(set(langs))
        self.families = sorted({family(c) for c in self.langs})
        label, x = np.array(langs, dtype=object), vectors(texts)
        kin = np.array([family(c) for c in langs], dtype=object)
        columns = []
        if len(self.families) > 1:
            columns += [linear_svm(x, np.arange(len(x)), np.where(kin == f, 1, -1)) for f in self.families]
        self.pairs = [(a, b) for a, b in combinations(self.langs, 2) if family(a) == family(b)]
        for a, b in self.pairs:
            mine = np.flatnonzero((label == a) | (label == b))
            columns.append(linear_svm(x, mine, np.where(label[mine] == a, 1, -1)))
        weights = np.stack(columns, axis=1) if columns else np.zeros((BUCKETS + 1, 0), dtype=np.float32)
        self.weights, self.constant = np.ascontiguousarray(weights[:-1]), weights[-1]

    def margins(self, texts: list[str]) -> np.ndarray:
        found, starts = buckets(texts)
        if not self.weights.shape[1]:
            return np.zeros((len(texts), 0))
        ends = np.concatenate([starts[1:], [len(found)]])
        out = np.empty((len(texts), self.weights.shape[1]))
        for column in range(self.weights.shape[1]):  # one flat column at a time stays in the cache
            out[:, column] = np.add.reduceat(self.weights[:, column][found], starts, dtype=np.float64)
        return out / (ends - starts)[:, None] + self.constant

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The language of each text and a score: the chance that its family is right times that of its language within."""
        margin = self.margins(texts)
        chance = 1 / (1 + np.exp(-3 * np.clip(margin, -20, 20)))
        n_families = len(self.families) if len(self.families) > 1 else 0
        best = margin[:, :n_families].argmax(axis=1) if n_families else np.zeros(len(texts), dtype=int)
        score = chance[np.arange(len(texts)), best] if n_families else np.ones(len(texts))
        lang = np.empty(len(texts), dtype=object)
        for number, name in enumerate(self.families):
            rows = np.flatnonzero(best == number)
            members = [c for c in self.langs if family(c) == name]
            votes, won = np.zeros((len(rows), len(members))), np.zeros((len(rows), len(members)))
            for at, (a, b) in enumerate(self.pairs):
                if a in members:
                    i, j, c = members.index(a), members.index(b), chance[rows, n_families + at]
                    votes[:, i] += c >= 0.5
                    votes[:, j] += c < 0.5
                    won[:, i] += c
                    won[:, j] += 1 - c
            first = (votes * 1e6 + won).argmax(axis=1)
            lang[rows] = np.array(members, dtype=object)[first]
            if len(members) > 1:
                score[rows] *= won[np.arange(len(rows)), first] / (len(members) - 1)
        return lang.tolist(), np.clip(score, 0, 1)


def train(docs: DataFrame, most: int = TRAINING_ROWS) -> Machines | None:
    """Fit on at most ``most`` documents of each language that are not held out and have letters, drawn by the hash of their id.

    Whole texts. The bound keeps the driver's share fixed: languages times
    ``most`` rows. None without labelled documents.
    """
    labelled = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter(
        F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    # a share of each language by hash first, about four times what is wanted, so that no language meets in one task
    counts = labelled.groupBy(F.col("lang").alias("_lang")).agg(F.count(F.lit(1)).alias("_rows"))
    # a row per labelled language, some thousands if every language there is were labelled
    near = labelled.join(F.broadcast(counts), F.col("lang") == F.col("_lang")).filter(F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.col("_rows")) < 4 * most)
    usable = near.filter(F.col("text").rlike(r"\p{L}"))
    drawn = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    rows = usable.withColumn("_n", F.row_number().over(drawn)).filter(F.col("_n") <= most).orderBy("lang", "_n").select("text", "lang").collect()
    return Machines([r["text"] for r in rows], [r["lang"] for r in rows]) if rows else None


def _slices(texts: list[str]) -> Iterator[slice]:
    """Neighbouring texts of SLICE_BYTES together; a longer one is alone."""
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) <= SLICE_BYTES):
            size += len(texts[last])
            last += 1
        yield slice(first, last)
        first = last


def _judge(machines: Machines, texts: list[str | None], lettered: list[bool]) -> tuple[list[str], np.ndarray]:
    """Language and score of every text; without letters it is undetermined."""
    lang, score = np.full(len(texts), UNDETERMINED, dtype=object), np.zeros(len(texts))
    rows = np.flatnonzero(lettered)
    chosen = [texts[i] for i in rows]
    for part in _slices(chosen):
        lang[rows[part]], score[rows[part]] = machines.predict(chosen[part])
    return lang.tolist(), score


def _predicted(machines: Machines):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = _judge(machines, batch.column(1).to_pylist(), batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return run


def _known(machines: Machines, text_at: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = _judge(machines, batch.column(text_at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist())
            keep = (np.array(lang, dtype=object) != UNDETERMINED) & (score >= least)
            yield batch.select(range(batch.num_columns - 1)).filter(pa.array(keep))

    return run


def identify(docs: DataFrame, machines: Machines | None = None) -> DataFrame:
    """One row per document: doc_id, lang_pred, score, from the whole text alone.

    A text that is null or has no letter is ``und`` with score 0, and so is
    every text where nothing could be learned. Repeated rows give repeated rows.
    """
    machines = machines or train(docs)
    text = F.col("text").cast("string")
    lettered = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), lettered.alias("lettered"))
    if machines is None:
        return rows.select("doc_id", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    return rows.mapInArrow(_predicted(machines), "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, least: float = 0.0, machines: Machines | None = None) -> DataFrame:
    """The documents whose language is told with a score of at least ``least``, all columns as they are.

    Rejected are texts that are ``und`` and those below the score. The default
    asks for a language only: a clean document is not lost to a doubtful score.
    Where nothing is labelled, nothing can be told: the texts with a letter stay.
    """
    machines = machines or train(docs)
    lettered = F.coalesce(docs["text"].cast("string").rlike(r"\p{L}"), F.lit(False))
    if machines is None:
        return docs.filter(lettered)
    marked = docs.select("*", lettered.alias(free_name(docs, "__lettered")))
    return marked.mapInArrow(_known(machines, docs.columns.index("text"), least), docs.schema)
