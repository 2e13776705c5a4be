"""What several operators share: tables in the shared folder, words, and positions in a global order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from attestra.session import derived_path

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Bits that mark the keys another table has: 262,144 words at most, whatever its size.
BITMAP = 1 << 24


def materialise(frame: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """The frame written as Parquet to the shared folder and read back: lineage ends there, and any executor can read it."""
    path = derived_path(frame.sparkSession, name)
    frame.write.option("compression", compression).parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def free_name(frame: DataFrame, wanted: str) -> str:
    """``wanted``, lengthened by underscores until no column of the frame has that name (case aside)."""
    taken = {c.lower() for c in frame.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def discard(frame: DataFrame) -> None:
    """Remove the files of a materialised table that nothing will read again."""
    spark = frame.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in frame.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def whole_text(text: Column) -> Column:
    """A null text counts as empty."""
    return F.coalesce(text.cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """The maximal runs of characters other than ASCII white space."""
    return F.array_remove(F.split(text, SPACES), "")


def marked(rows: DataFrame, keys: list[str], asked: DataFrame, theirs: list[str]) -> DataFrame:
    """The rows whose ``keys`` may be ``theirs`` of a row of ``asked``: all that are, and few others while those are few.

    The keys asked for are marked in a bitmap of bounded size, which is
    broadcast, so that other rows are left out where they are read; what it lets
    through is for a join to decide. Keys are of the same types on both sides.
    """
    def place(names: list[str]) -> tuple[Column, Column]:
        at = F.pmod(F.xxhash64(*names), F.lit(BITMAP))
        return F.shiftright(at, 6), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))

    word, bit = place(theirs)
    words = asked.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    at, mine = place(keys)
    return rows.join(F.broadcast(words), at == F.col("_word")).filter(F.col("_bits").bitwiseAND(mine) != 0).select(*rows.columns)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ordered(frame: DataFrame, keys: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """The rows with ``_part`` and ``_place``: their global order, without a window over all rows.

    Range partitioning deals the rows by key; each range is then numbered on its
    own. The second frame has a row per range: its ``_part``, ``_rows`` and the
    ``_before`` rows of earlier ranges. Rows are written once, so the ranges stay
    what they are when a task runs again. A row's global position is
    ``_before + _place``. Ties in the keys may take either order.
    """
    spark = frame.sparkSession
    ranged = frame.repartitionByRange(partitions(spark), *[F.col(k).asc_nulls_last() for k in keys]).withColumn("_part", F.spark_partition_id())
    kept = materialise(ranged, name)
    within = Window.partitionBy("_part").orderBy(*[F.col(k).asc_nulls_last() for k in keys])
    placed = kept.withColumn("_place", F.row_number().over(within).cast("long") - 1)
    # one row per range, as many as partitions: the only global window
    sizes = kept.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return placed, sizes.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
