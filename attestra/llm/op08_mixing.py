"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from attestra.llm.common import WORD, free_name, materialise, ordered, whole_text

MOST_COPIES, GROUP, SEED = 3, 4096, 20240229


def sizes(docs: DataFrame, row: str | None = None) -> DataFrame:
    """``_row``, doc_id, source, ``size`` in words, and ``_tie``, a hash of id and text that fixes the order of the draw.

    ``_row`` is the column ``row`` of the documents if one is named, else a number of the row's place.
    """
    text = whole_text(F.col("text"))
    place = F.col(row) if row else F.monotonically_increasing_id()
    return docs.select(place.alias("_row"), "doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
                       F.xxhash64(F.lit(SEED), F.coalesce("doc_id", F.lit(0)), text).alias("_tie"))


def targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_COPIES) -> DataFrame:
    """``source, source_size, n_docs, target``: each source's share of all words.

    Sources in code-point order, null last, take the weights in turn. A target
    stops at ``most`` times its source; what is left goes to the others by
    weight, again and again until none is above. Each pass is one aggregate over
    the sources; the driver sees only its three sums.
    """
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    placed, before = ordered(per_source, ["source"], "sources")
    turn = ((F.col("_before") + F.col("_place")) % len(weights) + 1).cast("int")
    weighed = materialise(placed.join(before, "_part").select(
        "source", "source_size", "n_docs", F.element_at(F.array(*map(F.lit, weights)), turn).cast("long").alias("weight")), "weights")
    level, capped = None, -1
    while True:
        full = F.lit(False) if level is None else most * F.col("source_size") <= F.lit(level) * F.col("weight")
        total, held, open_weight, now = weighed.agg(
            F.sum("source_size"), F.sum(F.when(full, most * F.col("source_size"))), F.sum(F.when(~full, F.col("weight"))), F.count(F.when(full, 1))).first()
        if not total or not open_weight or now == capped:
            break
        level, capped = (total - (held or 0)) / open_weight, now
    target = F.least((most * F.col("source_size")).cast("double"), F.lit(float(level or 0)) * F.col("weight"))
    return weighed.select("source", "source_size", "n_docs", target.alias("target"))


def pivot(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Round probabilities in pairs until at most one is not 0 or 1.

    Of a pair, mass moves one way or the other, at random and so that each
    expectation stays; ``size * p`` summed over the pair does not change. At
    least one of the two becomes integral, and the other meets the next.
    """
    p = p.copy()
    left = np.flatnonzero((p > 0) & (p < 1))
    while len(left) > 1:
        i, j = left[0: len(left) - 1: 2], left[1::2]
        share = size[j] / size[i]  # what one unit of p[j] is worth in p[i]
        up, down = np.minimum(1 - p[i], p[j] * share), np.minimum(p[i], (1 - p[j]) * share)
        rise = rng.random(len(i)) * (up + down) < down
        full_i, empty_j = 1 - p[i] <= p[j] * share, p[j] * share <= 1 - p[i]
        empty_i, full_j = p[i] <= (1 - p[j]) * share, (1 - p[j]) * share <= p[i]
        new_i, new_j = np.where(rise, p[i] + up, p[i] - down), np.where(rise, p[j] - up / share, p[j] + down / share)
        p[i] = np.where(rise & full_i, 1.0, np.where(~rise & empty_i, 0.0, np.clip(new_i, 0, 1)))
        p[j] = np.where(rise & empty_j, 0.0, np.where(~rise & full_j, 1.0, np.clip(new_j, 0, 1)))
        left = left[(p[left] > 0) & (p[left] < 1)]
    return p


def _round_group(level: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_tie", "_row"], kind="stable")
        rng = np.random.default_rng([SEED, level, int(group["_group"].iloc[0]), *group["_tie"].iloc[:1].astype(np.uint64).tolist()])
        group["p"] = pivot(group["p"].to_numpy(float), group["size"].to_numpy(float), rng)
        return group[group["p"] > 0]

    return run


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_COPIES, group: int = GROUP, row: str | None = None) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, copies, taken, ``_row``, ``_tie``.

    Every document of a source owes the same number of copies, target over size.
    The whole part is certain; the fractions are rounded by pairs within groups
    of about ``group`` documents, so a source of any size is many groups. Each
    group hands its one unfinished document up a reduction tree, until one per
    source is left, which is drawn. A source's words miss its target by less
    than one document. Documents without words are never taken. Null sources are
    one source; repeated rows are documents of their own; reruns agree.
    """
    sized = materialise(sizes(docs, row), "sizes")
    wanted = materialise(targets(sized, weights, most), "targets")
    per = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = sized.withColumnRenamed("source", "_s").join(F.broadcast(wanted) if wanted.count() <= 1000 else wanted, F.col("_s").eqNullSafe(F.col("source")))
    owed = rows.withColumn("_whole", F.when(F.col("size") > 0, F.floor(per)).otherwise(0).cast("long")).withColumn(
        "p", F.when(F.col("size") > 0, per - F.floor(per)).otherwise(F.lit(0.0)))

    state = "_row long, _tie long, size long, source string, p double, _group long, _groups long"
    groups = F.ceil(F.col("n_docs") / group).cast("long")
    level, done = 0, []
    left = owed.filter("p > 0").select("_row", "_tie", "size", "source", "p", F.pmod(F.xxhash64("_tie"), groups).alias("_group"), groups.alias("_groups"))
    while True:
        rounded = materialise(left.groupBy("source", "_group").applyInPandas(_round_group(level), state), "rounded")
        done.append(rounded.filter("p = 1").select("_row"))
        rest = rounded.filter("p < 1")
        most_groups = rest.agg(F.max("_groups")).first()[0]
        if most_groups is None or most_groups <= 1:
            break
        fewer = F.ceil(F.col("_groups") / group).cast("long")
        left = rest.select("_row", "_tie", "size", "source", "p", F.pmod(F.col("_group"), fewer).alias("_group"), fewer.alias("_groups"))
        level += 1
    drawn = F.pmod(F.xxhash64(F.lit("last"), F.col("_tie")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    done.append(rest.filter(drawn < F.col("p")).select("_row"))
    chosen = done[0]
    for more in done[1:]:
        chosen = chosen.unionByName(more)
    met = owed.join(chosen.select(F.col("_row").alias("_chosen")), F.col("_row") == F.col("_chosen"), "left")
    copies = F.col("_whole") + F.col("_chosen").isNotNull().cast("long")
    return met.select("doc_id", "size", "source", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "_row", "_tie")


def take(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_COPIES, group: int = GROUP) -> DataFrame:
    """The mix itself: every document as many times as it is taken, all columns as they are."""
    place, taken, copies, copy = (free_name(docs, name) for name in ("__mix_row", "__taken", "__copies", "__copy"))
    numbered = materialise(docs.withColumn(place, F.monotonically_increasing_id()), "numbered-documents", compression="zstd")
    mixed = mix(numbered, weights, most, group, place).filter("copies > 0").select(F.col("_row").alias(taken), F.col("copies").cast("int").alias(copies))
    met = numbered.join(mixed, F.col(place) == F.col(taken)).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return met.select(*[numbered[c] for c in docs.columns])
