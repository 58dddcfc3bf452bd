"""Running sums in hashed order within groups of any size, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftstone.plans.dims import sized
from siftstone.plans.scratch import materialise

#: Hash ranges per group at most, and rows of the largest group for which one more is made.
MOST_RANGES, RANGE_ROWS = 4096, 20_000


def range_count(largest: int) -> int:
    """How many hash ranges (a power of two) to make for groups of up to ``largest`` rows."""
    return min(MOST_RANGES, 1 << max(1, (largest // RANGE_ROWS).bit_length()))


def range_of(hashed: str, ranges: int) -> Column:
    """The hash range of a 64-bit hash column."""
    return F.expr(f"cast(shiftrightunsigned({hashed}, {65 - ranges.bit_length()}) as int)")


def hashed_prefix(df: DataFrame, group: str, order: tuple[str, ...], value: Column, out: str, largest: int, seed: int = 42) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the rows of the same ``group`` that come before in hashed order.

    The order is that of a hash of the ``order`` columns, ties by the columns themselves; rows equal in all of
    them come in any order, but each has its own place. Sums per hash range are taken first (at most ``MOST_RANGES`` numbers a
    group) and joined, by broadcast only where they are few; only rows of one range are sorted together. ``largest`` is
    the number of rows of the largest group, or a guess at it.
    """
    hashed = df.withColumn("__h", F.xxhash64(F.lit(seed), *order)).withColumn("__v", value.cast("bigint"))
    hashed = hashed.withColumn("__b", range_of("__h", range_count(largest)))
    w = Window.partitionBy(group).orderBy("__b")
    starts = hashed.groupBy(group, "__b").agg(F.sum("__v").alias("__s")).withColumn("__start", F.sum("__s").over(w) - F.col("__s")).drop("__s")
    inner = Window.partitionBy(group, "__b").orderBy("__h", *order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        hashed.join(sized(materialise(starts, "starts")), [group, "__b"])
        .withColumn(out, F.col("__start") + F.coalesce(F.sum("__v").over(inner), F.lit(0)))
        .drop("__h", "__b", "__v", "__start")
    )
