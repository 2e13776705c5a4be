"""SimHash votes counted in Spark SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

PAIR = 0x0000000100000001  # two 32-bit counters in one long


def ballot(hashed: Column, weight: Column | None = None) -> list[Column]:
    """32 sums; sum i counts the votes of bits i and i + 32 of ``hashed`` in its two halves.

    A half holds the total weight of one text, which must stay below 2**31.
    """
    ones = [F.shiftrightunsigned(hashed, i).bitwiseAND(F.lit(PAIR)) for i in range(32)]
    return [F.coalesce(F.sum(one if weight is None else one * weight), F.lit(0)) for one in ones]


def verdict(sums: list[Column], total: Column) -> Column:
    """The 64-bit fingerprint: a bit is 1 if its votes are over half of ``total``."""
    bits = []
    for i, both in enumerate(sums):
        low, high = both.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(both, 32)
        bits.append(F.when(low * 2 > total, F.lit(1 << i)).otherwise(F.lit(0)))
        top = (1 << (i + 32)) - (1 << 64 if i == 31 else 0)
        bits.append(F.when(high * 2 > total, F.lit(top)).otherwise(F.lit(0)))
    return reduce(lambda a, b: a.bitwiseOR(b), [b.cast("long") for b in bits])


def shingles(tokens: Column, width: int) -> Column:
    """Structs of ``width`` neighbouring words, repeats included; a shorter sequence gives none."""
    n = F.greatest(F.size(tokens) - (width - 1), F.lit(0))
    return F.arrays_zip(*[F.slice(tokens, i + 1, n).alias(f"w{i}") for i in range(width)])


def fingerprints(docs: DataFrame, tokens: Column, width: int, keys: list[str]) -> DataFrame:
    """``keys`` and ``fingerprint``, the SimHash of the word shingles of each row, joined by spaces.

    Each occurrence votes once. A sequence shorter than ``width`` votes as a
    whole; no word gives zero. ``keys`` must tell rows apart. The votes are
    summed where the text is read: one row per text goes through the shuffle.
    """
    named = docs.select(*keys, tokens.alias("_w"))
    short = F.array(F.struct(*[F.get(F.col("_w"), F.lit(i)).alias(f"w{i}") for i in range(width)]))
    every = F.when(F.size("_w") >= width, shingles(F.col("_w"), width)).when(F.size("_w") > 0, short)
    each = named.select(*keys, F.explode_outer(every).alias("_s"))
    joined = F.when(F.col("_s").isNotNull(), F.xxhash64(F.concat_ws(" ", *[F.col(f"_s.w{i}") for i in range(width)])))
    hashed = each.select(*keys, joined.alias("_h"))
    sums = [s.alias(f"_v{i}") for i, s in enumerate(ballot(F.col("_h")))]
    counted = hashed.groupBy(*keys).agg(F.count("_h").alias("_n"), *sums)
    return counted.select(*keys, verdict([F.col(f"_v{i}") for i in range(32)], F.col("_n")).alias("fingerprint"))
