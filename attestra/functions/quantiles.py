"""Exact quantiles of groups of any size by refining counts.

Equal values are counted first, map-side. Each wanted rank starts with the whole
range of its group. A range with at most CELLS different values is decided by
running counts over them. A larger one is cut into CELLS cells, the cell that
holds the rank is found by running counts, and the rank goes on with the values
in it. Counting combines map-side, a window never spans more than CELLS rows, and
nothing depends on how large a group is. A few rounds do: different values in a
range shrink by about CELLS in each, and the last round is part of the plan, not
a job of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from attestra import fixed_values as fixed
from attestra.session import materialise

CELLS = 16_384


def grouped_quantiles(
    frame: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Sequence[float],
    names: Sequence[str],
    *,
    nearest_rank: bool | Sequence[bool] = False,
    cells: int = CELLS,
) -> DataFrame:
    """One row per key: ``n``, ``minimum``, ``maximum`` and one column per probability.

    NULL and NaN are ignored. Linear interpolation a(1-w)+bw by default; where
    ``nearest_rank`` holds, the ceil(p*n)-th value instead. All probabilities
    share the rounds. The frame is read once.
    """
    keys = list(keys)
    nearest = [nearest_rank] * len(probabilities) if isinstance(nearest_rank, bool) else list(nearest_rank)
    return _quantiles(_value_counts(frame, keys, value), keys, probabilities, names, nearest, cells)


def _value_counts(frame: DataFrame, keys: list[str], value: str) -> DataFrame:
    """How often each value ``_v`` occurs: ``_c``, written once and read by every round."""
    data = frame.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    return materialise(data.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c")), "value-counts")


def _quantiles(
    counted: DataFrame, keys: list[str], probabilities: Sequence[float], names: Sequence[str], nearest: Sequence[bool], cells: int,
) -> DataFrame:
    sizes = materialise(counted.groupBy(*keys).agg(
        F.sum("_c").alias("n"), F.count(F.lit(1)).alias("_values"), F.min("_v").alias("minimum"), F.max("_v").alias("maximum")), "group-sizes")
    slots, picked = [], []
    for i, (probability, rule) in enumerate(zip(probabilities, nearest)):
        low, high, weight = _ranks(probability, rule)
        slots += [F.struct(F.lit(2 * i).alias("_slot"), low.cast("long").alias("_rank")), F.struct(F.lit(2 * i + 1).alias("_slot"), high.cast("long").alias("_rank"))]
        at = [F.max(F.when(F.col("_slot") == 2 * i + k, F.col("_low"))) for k in (0, 1)]
        picked.append((at, weight, names[i]))
    large = F.col("_values") > cells
    places = sizes.select(*keys, F.col("minimum").alias("_low"), F.col("maximum").alias("_high"), "_values", F.inline(F.array(*slots)))
    more = not sizes.filter(large).isEmpty()
    while more:
        places = materialise(_refined(counted, places, keys, cells), "quantile-places")
        more = not places.filter(large).isEmpty()
    places = _refined(counted, places, keys, cells)  # no range has more than ``cells`` values now
    found = places.groupBy(*keys).agg(*[a.alias(f"_{side}{i}") for i, (at, _, _) in enumerate(picked) for side, a in zip("lh", at)])
    out = []
    for i, (_, weight, name) in enumerate(picked):
        low, high = F.col(f"_l{i}"), F.col(f"_h{i}")
        out.append(F.when(weight == 0.0, low).otherwise(low * (1.0 - weight) + high * weight).alias(name))
    return sizes.join(found, keys).select(*keys, "n", "minimum", "maximum", *out)


def _refined(counted: DataFrame, places: DataFrame, keys: list[str], cells: int) -> DataFrame:
    """One round: every range (keys, _low, _high) in use becomes the value, or the span of values in a cell, that holds the rank."""
    span = [*keys, "_low", "_high"]
    same = [counted[k].eqNullSafe(F.col(f"_{k}")) for k in keys]
    ranges = places.select(*span, "_values").distinct().select(*[F.col(k).alias(f"_{k}") for k in keys], "_low", "_high", "_values")
    inside = counted.join(ranges, [*same, F.col("_v") >= F.col("_low"), F.col("_v") <= F.col("_high")])
    # halves keep the width finite; the share grows with the value, so cells are in order, and the ends fall in different cells
    share = (F.col("_v") / 2 - F.col("_low") / 2) / (F.col("_high") / 2 - F.col("_low") / 2)
    few = F.col("_values") <= cells
    cell = F.when(few, 0).otherwise(F.least(F.floor(share * cells), F.lit(cells - 1)))
    filled = inside.select(*keys, "_low", "_high", cell.cast("int").alias("_cell"), F.when(few, F.col("_v")).alias("_own"), "_v", "_c").groupBy(
        *span, "_cell", "_own").agg(F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_in"), F.min("_v").alias("_from"), F.max("_v").alias("_to"))
    upto = F.sum("_n").over(Window.partitionBy(*span).orderBy("_cell", "_own").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    summed = filled.withColumn("_upto", upto).select(*[F.col(k).alias(f"_{k}") for k in span], "_n", "_in", "_from", "_to", "_upto")
    met = places.join(summed, [places[k].eqNullSafe(F.col(f"_{k}")) for k in span])
    return met.filter((F.col("_rank") <= F.col("_upto")) & (F.col("_rank") > F.col("_upto") - F.col("_n"))).select(
        *keys, F.col("_from").alias("_low"), F.col("_to").alias("_high"), F.col("_in").alias("_values"), "_slot",
        (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_rank"))


def _ranks(probability: float, nearest_rank: bool) -> tuple[Column, Column, Column]:
    """1-based lower and upper rank and the weight of the upper one."""
    n = F.col("n")
    if nearest_rank:
        rank = F.greatest(F.lit(1), F.ceil(F.lit(probability) * n))
        return rank, rank, F.lit(0.0)
    position = F.lit(probability) * (n - 1)
    return F.floor(position) + 1, F.ceil(position) + 1, position - F.floor(position)


def distribution(frame: DataFrame, keys: Sequence[str], value: str, cells: int = CELLS) -> DataFrame:
    """Count, five quantiles, IQR and median absolute deviation per key."""
    keys = list(keys)
    counted = _value_counts(frame, keys, value)
    linear = [False] * len(fixed.QUANTILE_PROBABILITIES)
    middles = materialise(_quantiles(counted, keys, fixed.QUANTILE_PROBABILITIES, fixed.QUANTILE_NAMES, linear, cells), "quantiles")
    # the deviations of equal values are equal: they come from the counts, not from the rows
    away = F.abs(F.col("_v") - F.col("median"))
    deviations = counted.join(middles.select(*keys, "median"), keys).groupBy(*keys, away.alias("_d")).agg(F.sum("_c").alias("_c"))
    counts = materialise(deviations.withColumnRenamed("_d", "_v"), "value-counts")
    spread = _quantiles(counts, keys, [0.5], ["mad"], [False], cells).select(*keys, "mad")
    return middles.join(spread, keys).withColumn("iqr", F.col("q75") - F.col("q25"))


def count_distribution(counts: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The same for small whole numbers: group to (value, frequency), then use the built-in."""
    keys = list(keys)
    frequency = counts.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_f"))
    probabilities = F.array(*[F.lit(p) for p in fixed.QUANTILE_PROBABILITIES])
    basic = frequency.groupBy(*keys).agg(
        F.sum("_f").alias("n"), F.percentile(F.col(value).cast("double"), probabilities, F.col("_f")).alias("_q")
    )
    spread = frequency.join(basic.select(*keys, F.col("_q")[2].alias("_m")), keys).groupBy(*keys).agg(
        F.percentile(F.abs(F.col(value) - F.col("_m")), F.lit(0.5), F.col("_f")).alias("mad")
    )
    named = [F.col("_q")[i].alias(name) for i, name in enumerate(fixed.QUANTILE_NAMES)]
    return basic.select(*keys, "n", *named).join(spread, keys).withColumn("iqr", F.col("q75") - F.col("q25"))
