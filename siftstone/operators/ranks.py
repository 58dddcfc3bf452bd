"""Exact ranks in hashed order without a task that holds a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Leading hex digits of the hash that form a range; 16 to that power ranges per group.
DIGITS = 3


def draw_key(seed: str, *ids: Column) -> Column:
    """A reproducible random key of a row: the md5 of the seed and its identifiers, joined by colons."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[c.cast("string") for c in ids]))


def draw_number(key: Column) -> Column:
    """The first eight hex digits of a draw key as a number below 2^32."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint")


def hashed_rank(df: DataFrame, groups: Sequence[str], key: Column, ties: Sequence[str], out: str = "rank") -> DataFrame:
    """``df`` with the rank (from 1) of each row in its group by ``key``, ties by the ``ties`` columns.

    Rows per group and key range are counted first (at most 4096 numbers a group, joined back by size); only
    rows of one range are sorted together. Null group values form a group of their own. Groups should be few; rows equal
    in key and ties are ranked in any order.
    """
    groups = list(groups)
    keyed = df.withColumn("__k", key).withColumn("__r", F.substring(F.col("__k"), 1, DIGITS))
    held = keyed.groupBy(*groups, "__r").agg(F.count("*").alias("__c"))
    start = held.withColumn("__s", F.sum("__c").over(Window.partitionBy(*groups).orderBy("__r")) - F.col("__c"))
    right = start.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], F.col("__r").alias("__r2"), "__s")
    on = F.col("__r") == F.col("__r2")
    for i, g in enumerate(groups):
        on = on & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    ranked = keyed.join(right, on).withColumn(
        out, F.col("__s") + F.row_number().over(Window.partitionBy(*groups, "__r").orderBy("__k", *ties))
    )
    return ranked.drop("__k", "__r", "__r2", "__s", *[f"__g{i}" for i in range(len(groups))])
