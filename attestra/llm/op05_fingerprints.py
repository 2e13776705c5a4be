"""Document fingerprints: SimHash of weighted terms, and block tables that find all fingerprints within a radius.

Everything here is Spark SQL: no Python runs on the executors.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from attestra.llm.common import SPACES, marked, materialise, partitions, whole_text
from attestra.llm.simhash import ballot, verdict

BITS, RADIUS, BLOCKS = 128, 6, 8
#: Longest term weight, in characters.
HEAVIEST = 24


def terms(text: Column) -> Column:
    """Pairs of neighbouring words, lower case; a lone word stands with an empty one."""
    found = F.array_remove(F.split(F.lower(text), SPACES), "")
    n = F.greatest(F.size(found) - 1, F.lit(1))
    return F.when(F.size(found) > 0, F.arrays_zip(F.slice(found, 1, n).alias("a"), F.slice(found, 2, n).alias("b")))


def fingerprints(rows: DataFrame, keys: list[str], texts: dict[str, str]) -> DataFrame:
    """``keys`` and, for each text column of ``texts``, the two longs ``<name>_hi`` and ``<name>_lo`` of its SimHash.

    A term's weight is its length, up to HEAVIEST, for every time it occurs:
    long terms tell more. Each of 128 hash bits gets the weight as a vote for or
    against; the sign of the sum is the bit. A text without words gives zero.
    """
    label = F.explode(F.array(*[F.struct(F.lit(name).alias("which"), terms(F.col(c)).alias("terms")) for name, c in texts.items()]))
    each = rows.select(*keys, label.alias("_t")).select(*keys, F.col("_t.which").alias("_which"), F.explode_outer("_t.terms").alias("_p"))
    a, b = F.col("_p.a"), F.coalesce(F.col("_p.b"), F.lit(""))
    real = F.col("_p").isNotNull()
    weight = F.when(real, F.least(F.length(a) + F.length(b), F.lit(HEAVIEST)).cast("long"))
    hashed = each.select(*keys, "_which", weight.alias("_w"), F.when(real, F.xxhash64(a, b)).alias("_h"),
                         F.when(real, F.xxhash64(F.lit(BITS), b, a)).alias("_g"))
    sums = [s.alias(f"_{side}{i}") for side in "hg" for i, s in enumerate(ballot(F.col(f"_{side}"), F.col("_w")))]
    total = F.coalesce(F.sum("_w"), F.lit(0)).alias("_n")
    counted = hashed.groupBy(*keys, "_which").agg(total, *sums)
    two = counted.select(*keys, "_which", *[verdict([F.col(f"_{side}{i}") for i in range(32)], F.col("_n")).alias(side) for side in "hg"])
    wide = [F.max(F.when(F.col("_which") == name, F.col(side))).alias(f"{name}_{part}") for name in texts for side, part in (("h", "hi"), ("g", "lo"))]
    return two.groupBy(*keys).agg(*wide)


def distance(hi: Column, lo: Column, other_hi: Column, other_lo: Column) -> Column:
    return F.bit_count(hi.bitwiseXOR(other_hi)) + F.bit_count(lo.bitwiseXOR(other_lo))


def likeness(bits: Column) -> Column:
    """The cosine that a distance of so many of 128 bits estimates, at least 0: 1 for equal, about 0 for unrelated texts."""
    return F.when(bits == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.cos(bits * F.lit(math.pi / BITS))))


def written(hi: Column, lo: Column) -> Column:
    return F.concat(F.lpad(F.lower(F.hex(hi)), 16, "0"), F.lpad(F.lower(F.hex(lo)), 16, "0"))


def _cuts(docs: DataFrame, parts: int) -> list[int]:
    """Ids that cut the documents into ``parts`` about equal ranges: as many numbers as partitions, whatever the corpus."""
    shares = [i / parts for i in range(1, parts)]
    found = docs.agg(F.percentile_approx("doc_id", shares, 20 * parts)).first()[0] if shares else []
    return sorted(set(found or []))


def _range(doc_id: Column, cuts: list[int]) -> Column:
    """How many cuts are at most ``doc_id``, by binary search; null ids come after all."""
    levels = max(1, len(cuts)).bit_length()
    table = F.array(*[F.lit(c).cast("long") for c in cuts + [(1 << 63) - 1] * ((1 << levels) - len(cuts))])
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(levels))])
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.element_at(table, at + step) <= doc_id, at + step).otherwise(at))
    return F.when(doc_id.isNull(), F.lit(len(cuts) + 1)).otherwise(found)


def edited(docs: DataFrame) -> DataFrame:
    """Each document with its text and its edited text: ``_range``, ``_nth``, doc_id, ``_text``, ``_edited``, ``_next``.

    The last quarter of the text (its length in code points divided by four,
    rounded down) gives way to as many first code points of the next document,
    in order of doc_id, null last; ties follow the text's hash, then any order.
    After the last document comes the first. Ids are dealt into ranges, each
    range is ordered on its own, and only its last row looks at the first row of
    the next range: the text moves once.
    """
    text = whole_text(F.col("text"))
    cuts = _cuts(docs, partitions(docs.sparkSession))
    placed = docs.select("doc_id", text.alias("_text"), F.xxhash64(text).alias("_tie"), _range(F.col("doc_id"), cuts).alias("_range"))
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("_tie").alias("t"))
    # the first document of each range: a row per range, at most one more than partitions
    firsts = placed.groupBy("_range").agg(F.min(order).alias("_f")).select(
        F.col("_range").alias("_first"), F.col("_f.i").alias("_fi"), F.col("_f.t").alias("_ft"))
    around = Window.orderBy("_first")
    before = firsts.withColumn("_for", F.coalesce(F.lag("_first").over(around), F.max("_first").over(Window.partitionBy(F.lit(1)))))
    opening = placed.join(F.broadcast(before), (F.col("_range") == F.col("_first")) & F.col("doc_id").eqNullSafe(F.col("_fi")) & (F.col("_tie") == F.col("_ft")))
    opening = opening.groupBy(F.col("_for")).agg(F.min("_text").alias("_opening"))
    inside = Window.partitionBy("_range").orderBy(F.col("doc_id").asc_nulls_last(), "_tie")
    followed = placed.select("*", F.lead("_text").over(inside).alias("_lead"), F.row_number().over(inside).alias("_nth"))
    met = followed.join(opening, F.col("_range") == F.col("_for"), "left")
    following = F.coalesce("_lead", "_opening")
    quarter = F.floor(F.length("_text") / 4).cast("int")
    new = F.concat(F.substring(F.col("_text"), F.lit(1), F.length("_text") - quarter), F.substring(following, F.lit(1), quarter))
    return met.select("_range", "_nth", "doc_id", "_text", new.alias("_edited"), following.alias("_next"))


def within(codes: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """``(q_hi, q_lo, hi, lo, rows)``: for each distinct query code, every distinct code of ``codes(hi, lo, rows)`` within the radius.

    128 bits are cut into ``blocks`` blocks; each table permutes some
    ``blocks - radius`` of them to the front and finds equal fronts. Codes
    within the radius agree in that many blocks of some table. Only codes with a
    front that a query has too are shuffled. A pair is tested in full and
    reported by the first table that has it.
    """
    if not radius < blocks or 64 % (blocks // 2):
        raise ValueError("an even number of blocks that divides the bits, more than the radius")
    width = BITS // blocks
    chosen = list(combinations(range(blocks), blocks - radius))
    half = blocks // 2

    def masks(of: range) -> Column:
        return F.array(*[F.lit(_signed(sum(((1 << width) - 1) << (width * (b - of.start)) for b in table if b in of))) for table in chosen])

    high, low = masks(range(half)), masks(range(half, blocks))

    def dealt(frame: DataFrame, *more: str) -> DataFrame:
        tabled = frame.select("hi", "lo", *more, F.posexplode(F.arrays_zip(high.alias("h"), low.alias("l"))).alias("_table", "_m"))
        return tabled.select("hi", "lo", *more, "_table", F.col("hi").bitwiseAND(F.col("_m.h")).alias("_h"), F.col("lo").bitwiseAND(F.col("_m.l")).alias("_l"))

    asked = dealt(queries.select("hi", "lo").distinct()).select(*[F.col(c).alias("q" + c) for c in ("hi", "lo", "_table", "_h", "_l")])
    there = marked(dealt(codes, "rows"), ["_table", "_h", "_l"], asked, ["q_table", "q_h", "q_l"])
    x, y = F.col("hi").bitwiseXOR(F.col("qhi")), F.col("lo").bitwiseXOR(F.col("qlo"))
    agree = F.transform(F.arrays_zip(high.alias("h"), low.alias("l")), lambda m: (x.bitwiseAND(m["h"]) == 0) & (y.bitwiseAND(m["l"]) == 0))
    met = there.join(asked, (F.col("_table") == F.col("q_table")) & (F.col("_h") == F.col("q_h")) & (F.col("_l") == F.col("q_l"))
                     & (F.bit_count(x) + F.bit_count(y) <= radius) & (F.array_position(agree, True) == F.col("_table") + 1))
    return met.select(F.col("qhi").alias("q_hi"), F.col("qlo").alias("q_lo"), "hi", "lo", "rows")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def report(docs: DataFrame, radius: int = RADIUS, every: int = 100) -> DataFrame:
    """One row per document: its fingerprint, its edited text's, their likeness, and that to the next document.

    Queries are the documents whose id is divisible by ``every``: ``near_rows``
    has the number of other documents within ``radius`` of them, null for the
    rest. A null text counts as empty and has fingerprint zero.
    """
    rows = edited(docs).withColumn("n_chars", F.length("_text").cast("long")).withColumn("edited_sha256", F.sha2(F.col("_edited").cast("binary"), 256))
    keys = ["_range", "_nth", "doc_id", "n_chars", "edited_sha256"]
    coded = materialise(fingerprints(rows, keys, {"own": "_text", "new": "_edited"}), "fingerprints")
    inside = Window.partitionBy("_range").orderBy("_nth")
    first = coded.filter("_nth = 1").select(F.col("_range").alias("_first"), F.col("own_hi").alias("f_hi"), F.col("own_lo").alias("f_lo"))
    turn = Window.orderBy("_first")
    first = first.withColumn("_for", F.coalesce(F.lag("_first").over(turn), F.max("_first").over(Window.partitionBy(F.lit(1)))))
    led = coded.withColumn("n_hi", F.lead("own_hi").over(inside)).withColumn("n_lo", F.lead("own_lo").over(inside))
    met = led.join(F.broadcast(first), F.col("_range") == F.col("_for"), "left")
    near_next = distance(F.col("own_hi"), F.col("own_lo"), F.coalesce("n_hi", "f_hi"), F.coalesce("n_lo", "f_lo"))
    near_edited = distance(F.col("own_hi"), F.col("own_lo"), F.col("new_hi"), F.col("new_lo"))

    codes = coded.groupBy(F.col("own_hi").alias("hi"), F.col("own_lo").alias("lo")).agg(F.count(F.lit(1)).alias("rows"))
    asked = coded.filter(F.col("doc_id") % every == 0).select(F.col("own_hi").alias("hi"), F.col("own_lo").alias("lo"))
    found = within(codes, asked, radius).groupBy("q_hi", "q_lo").agg(F.sum("rows").alias("_found"))
    full = met.withColumn("_asks", F.when(F.col("doc_id") % every == 0, F.lit(True)))
    joined = full.join(found, (F.col("own_hi") == F.col("q_hi")) & (F.col("own_lo") == F.col("q_lo")) & F.col("_asks"), "left")
    return joined.select(
        "doc_id", "n_chars", "edited_sha256", written(F.col("own_hi"), F.col("own_lo")).alias("fingerprint"),
        written(F.col("new_hi"), F.col("new_lo")).alias("edited_fingerprint"), likeness(near_edited).alias("near_edited"),
        likeness(near_next).alias("near_next"), F.when(F.col("_asks"), F.col("_found") - 1).alias("near_rows"))
