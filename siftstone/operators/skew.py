"""Per-key results when a few keys hold most rows: fragment-replicate by estimated load.

Rows are combined per batch first, so many copies of one value leave a map task as few rows. ``fragment_plan`` then measures
the load of each key. Keys above the load of one task are cut into shards in proportion to their load; all other keys fall into
virtual bins by hash, whose loads are known too. Shards and bins are packed onto tasks, largest first. Rows move once, to their
task by its number (no second hash that could put two heavy shards together), a matching side is replicated to the shards of the
large keys and moved likewise, and everything up to the result of a shard happens where the rows lie.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from siftstone.plans.scratch import materialise

#: Virtual bins for the keys that are not large, per task.
BINS_PER_TASK = 8


@dataclass(frozen=True)
class FragmentPlan:
    """Where rows go: ``shards`` per large key, and the task of each (key, shard) and of each bin."""

    keys: tuple[str, ...]
    tasks: int
    shards: dict[tuple, int] = field(default_factory=dict)
    placed: dict[tuple, int] = field(default_factory=dict)
    bins: list[int] = field(default_factory=list)
    loads: list[int] = field(default_factory=list)


def _bin(keys: tuple[str, ...], bins: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(bins)).cast("int")


def fragment_plan(df: DataFrame, keys: tuple[str, ...], tasks: int | None = None) -> FragmentPlan:
    """Plan the tasks for ``df`` by its load per key.

    What reaches the driver is bounded by the number of tasks alone: the keys above half a task's
    load (fewer than twice the tasks) and the loads of the virtual bins. An empty ``df`` yields one task.
    """
    tasks = tasks or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bins = tasks * BINS_PER_TASK
    counts = df.groupBy(*keys).count().withColumn("__bin", _bin(keys, bins)).persist()
    try:
        total = counts.agg(F.sum("count")).first()[0] or 0
        limit = max(1, total // (2 * tasks))
        large = counts.where(F.col("count") > limit).select(*keys, "count").collect()
        small = counts.where(F.col("count") <= limit).groupBy("__bin").agg(F.sum("count").alias("count")).collect()
    finally:
        counts.unpersist()
    target = max(1, -(-total // tasks))
    pieces: list[tuple[int, tuple]] = []
    shards: dict[tuple, int] = {}
    for row in large:
        key, n = tuple(row[k] for k in keys), row["count"]
        shards[key] = -(-n // max(1, target // 2))
        pieces += [(-(-n // shards[key]), (key, s)) for s in range(shards[key])]
    pieces += [(row["count"], (None, row["__bin"])) for row in small]
    heap = [(0, t) for t in range(tasks)]
    placed: dict[tuple, int] = {}
    by_bin = [b % tasks for b in range(bins)]
    for load, (key, at) in sorted(pieces, key=lambda p: (-p[0], str(p[1]))):
        used, t = heapq.heappop(heap)
        heapq.heappush(heap, (used + load, t))
        if key is None:
            by_bin[at] = t
        else:
            placed[key, at] = t
    return FragmentPlan(keys, tasks, shards, placed, by_bin, [used for used, _ in sorted(heap, key=lambda x: x[1])])


def _sharded(df: DataFrame, plan: FragmentPlan, shard: Column) -> DataFrame:
    """``df`` moved to the plan's tasks, with ``__shard`` as given by the number of its key's shards (``__shards``) and ``__task``.

    The plan's tables are broadcast: a row for each large key, each of their shards and each bin, all of them bounded by the tasks.
    """
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in plan.keys)
    spark, keys = df.sparkSession, list(plan.keys)
    large = spark.createDataFrame([(*k, n) for k, n in plan.shards.items()], f"{kinds}, __large int")
    tasks = spark.createDataFrame([(*k, s, t) for (k, s), t in plan.placed.items()], f"{kinds}, __shard int, __at int")
    bins = spark.createDataFrame(list(enumerate(plan.bins)), "__bin int, __of_bin int")
    counted = df.join(F.broadcast(large), keys, "left").withColumn("__shards", F.coalesce("__large", F.lit(1)))
    return (
        counted.withColumn("__shard", shard).withColumn("__bin", _bin(plan.keys, len(plan.bins)))
        .join(F.broadcast(tasks), [*keys, "__shard"], "left")
        .join(F.broadcast(bins), "__bin")
        .withColumn("__task", F.coalesce("__at", "__of_bin"))
        .select(*df.columns, "__shard", "__task")
        .repartitionById(plan.tasks, F.col("__task"))
    )


def fragment(df: DataFrame, plan: FragmentPlan, spread: Column) -> DataFrame:
    """``df`` with ``__shard`` and ``__task``, moved to the plan's tasks; rows of one key and equal ``spread`` stay together."""
    return _sharded(df, plan, F.pmod(F.xxhash64(spread), F.col("__shards")).cast("int"))


def replicate(matching: DataFrame, plan: FragmentPlan) -> DataFrame:
    """``matching`` once per shard of its key, moved to the shard's task: more than once only for the large keys."""
    return _sharded(matching, plan, F.explode(F.sequence(F.lit(0), F.col("__shards") - 1)))


def combined(df: DataFrame, keys: tuple[str, ...], distinct: str, mean: str, latest: str) -> DataFrame:
    """``keys``, ``distinct``, ``__n``, ``__s``, ``__c``, ``__l``: rows, sum and count of ``mean`` and latest per key and value, batch by batch."""
    group = [*keys, distinct]
    plain = df.select(*group, F.lit(1).cast("bigint").alias("__n"), F.col(mean).alias("__s"), F.col(mean).alias("__c"), F.col(latest).alias("__l"))
    summed = df.select(F.sum(mean).alias("s")).schema["s"].dataType
    out = [plain.schema[k] for k in group]
    types = [*(to_arrow_type(f.dataType) for f in out), pa.int64(), to_arrow_type(summed), pa.int64(), None]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch]).group_by(group).aggregate([("__n", "sum"), ("__s", "sum"), ("__c", "count"), ("__l", "max")])
            columns = [*group, "__n_sum", "__s_sum", "__c_count", "__l_max"]
            arrays = [t.column(c).combine_chunks() if kind is None else t.column(c).combine_chunks().cast(kind) for c, kind in zip(columns, types)]
            yield pa.RecordBatch.from_arrays(arrays, [*group, "__n", "__s", "__c", "__l"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out)
    return plain.mapInArrow(fold, f"{kinds}, __n bigint, __s {summed.simpleString()}, __c bigint, __l {plain.schema['__l'].dataType.simpleString()}")


def balanced_key_stats(
    df: DataFrame,
    keys: tuple[str, ...],
    distinct: str,
    mean: str,
    latest: str,
    matching: DataFrame | None = None,
    tasks: int | None = None,
    how: str = "inner",
) -> DataFrame:
    """Rows, distinct values, mean and latest value per key, without a task that holds a hot key.

    Result: ``keys``, ``n_rows`` bigint, ``n_<distinct>`` bigint (nulls are no value), ``mean_<mean>`` double (null
    where all are null), ``latest_<latest>``, and the columns of ``matching`` where it is given (joined on ``keys``, ``how`` is inner or
    left; it should hold a key once). Rows with a null key belong to no key. Repeated rows count each time. An empty table gives an
    empty result. Further columns of ``df`` are dropped before anything moves; names of ``matching`` that clash with result
    columns are the caller's to rename.

    Rows with equal ``distinct`` value share a shard, so the shards' distinct counts add up; as batches are combined first, a hot value
    is a few rows. Between the move and the result of a shard there is no further exchange.
    """
    used = df.select(*keys, distinct, mean, latest).dropna(subset=list(keys))
    rows = materialise(combined(used, keys, distinct, mean, latest), "combined")
    plan = fragment_plan(rows, keys, tasks)
    spread = F.when(F.col(distinct).isNull(), F.xxhash64("__n", "__s", "__l")).otherwise(F.xxhash64(distinct))
    placed = fragment(rows, plan, spread)
    place, extra = [*keys, "__shard", "__task"], []
    if matching is not None:
        extra = [c for c in matching.columns if c not in keys]
        placed = placed.join(replicate(matching, plan).hint("shuffle_hash"), place, how)
    values = placed.groupBy(*place, distinct).agg(
        F.sum("__n").alias("__n"), F.sum("__s").alias("__s"), F.sum("__c").alias("__c"), F.max("__l").alias("__l"), *[F.first(c).alias(c) for c in extra]
    )
    shards = values.groupBy(*place).agg(
        F.sum("__n").alias("__n"), F.count(distinct).alias("__d"), F.sum("__s").alias("__s"), F.sum("__c").alias("__c"), F.max("__l").alias("__l"), *[F.first(c).alias(c) for c in extra]
    )
    return shards.groupBy(*keys).agg(
        F.sum("__n").alias("n_rows"),
        F.sum("__d").alias(f"n_{distinct}"),
        (F.sum("__s").cast("double") / F.sum("__c")).alias(f"mean_{mean}"),
        F.max("__l").alias(f"latest_{latest}"),
        *[F.first(c).alias(c) for c in extra],
    )
