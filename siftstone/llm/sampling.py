"""Problem 1: a sample whose strata follow target shares.

The categories form a tree (root, first column, second column, ...). Quotas are handed down from the
root: at each node the quota is split over the children in proportion to their targets, never above what
a child holds and never below its guaranteed minimum. What a leaf cannot supply therefore goes to its
siblings first and leaves the branch, to the cousins, only when the whole branch is exhausted. Each leaf is told what it owes
on the way down; what it cannot honour is its unmet quota, which the report gives. At the leaves rows are drawn by the
rank of a permuted (hashed) identifier.

Up to ``MAX_STRATA`` strata the tree is walked on the driver. Beyond, the driver splits the root's quota only and each branch is
walked in a task of its own, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from siftstone.functions.readings import weakness_label, with_language
from siftstone.llm.prefix import range_count, range_of
from siftstone.plans.dims import sized
from siftstone.plans.scratch import materialise
from siftstone.sources.tables import table

#: Strata up to which the whole allocation is solved on the driver.
MAX_STRATA = 100_000
#: Labels with strata of their own; all else, no label included, is Other. Fixed values.
TARGET_LABELS = ("Safe", "CWE-79", "CWE-89", "CWE-78", "CWE-22", "CWE-434", "CWE-352")


def _split(quota: int, children: list[tuple[int, int, int]]) -> list[int]:
    """Split ``quota`` over children of (weight, floor, cap): clamped proportional shares, exact integers."""
    floors = [min(f, c) for _, f, c in children]
    if sum(floors) >= quota:
        weights, floors = floors, [0] * len(children)
        caps = weights[:]
    else:
        weights, caps = [w for w, _, _ in children], [c for _, _, c in children]
    room = sum(c if w or f else 0 for w, f, c in zip(weights, floors, caps))
    quota = min(quota, room)
    given = floors[:]
    free = {i for i, w in enumerate(weights) if w > 0 and caps[i] > floors[i]}
    pinned: dict[int, int] = {i: floors[i] for i in range(len(children)) if i not in free}
    while free:
        left, total = quota - sum(pinned.values()), sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] > caps[i] * total}
        under = {i for i in free if left * weights[i] < floors[i] * total}
        excess = sum(left * weights[i] - caps[i] * total for i in over)
        lack = sum(floors[i] * total - left * weights[i] for i in under)
        fix = over if excess >= lack and over else under
        if not fix:
            shares = {i: left * weights[i] // total for i in free}
            short = left - sum(shares.values())
            for i in sorted(free, key=lambda i: (-(left * weights[i] % total), i)):
                if short and shares[i] < caps[i]:
                    shares[i] += 1
                    short -= 1
            pinned.update(shares)
            break
        pinned.update({i: caps[i] if fix is over else floors[i] for i in fix})
        free -= fix
    for i, n in pinned.items():
        given[i] = n
    spare = quota - sum(given)
    for i in sorted(range(len(children)), key=lambda i: -weights[i]):
        more = max(0, min(spare, caps[i] - given[i])) if weights[i] else 0
        given[i] += more
        spare -= more
    return given


class Leaf(NamedTuple):
    """A stratum: its weight, guaranteed minimum, rows in stock, and rows it owes."""

    weight: int
    floor: int
    stock: int
    owed: int = 0

    @property
    def sums(self) -> tuple[int, int, int]:
        """Weight, minimum that can be kept, and stock that may be drawn."""
        return self.weight, min(self.floor, self.stock), self.stock if self.weight or self.floor else 0


class Share(NamedTuple):
    """Rows drawn from a stratum, and the quota it could not meet."""

    drawn: int
    unmet: int


def allocate(leaves: dict[tuple, Leaf], size: int) -> dict[tuple, Share]:
    """What each leaf gives, ``leaves`` mapping a path to its stratum."""

    def descend(depth: int, paths: list[tuple], quota: int) -> dict[tuple, Share]:
        if len(paths) == 1 and len(paths[0]) == depth:
            leaf = leaves[paths[0]]
            return {paths[0]: Share(min(quota, leaf.stock), max(0, leaf.owed - leaf.stock))}
        groups: dict[tuple, list[tuple]] = {}
        for p in paths:
            groups.setdefault(p[: depth + 1], []).append(p)
        names = sorted(groups, key=str)
        sums = [tuple(map(sum, zip(*(leaves[p].sums for p in groups[g])))) for g in names]
        out: dict[tuple, Share] = {}
        for g, q in zip(names, _split(quota, sums)):
            out |= descend(depth + 1, groups[g], q)
        return out

    return descend(0, list(leaves), size) if leaves else {}


def stratum_report(rows: DataFrame, targets: DataFrame, strata: Sequence[str], share: str, minimum: str, size: int, on_driver: int = MAX_STRATA) -> DataFrame:
    """One row per target stratum: required, available and allocated rows, and the missing ones, its unmet quota.

    ``rows`` holds the strata columns only. ``required`` is max(ceil(share * size / 10000), minimum) in exact integers.
    A stratum of ``targets`` given twice counts once, with its larger share and minimum; a null name is a stratum without rows;
    null share or minimum is 0. An empty ``rows`` leaves every stratum at 0 available. Above ``on_driver`` strata the branches of the
    tree are walked in tasks, one branch in one.
    """
    spark, keys = rows.sparkSession, list(strata)
    numbers = [F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(a) for c, a in ((share, "__w"), (minimum, "__m"))]
    wanted = targets.select(*keys, *numbers).groupBy(*keys).agg(F.max("__w").alias("__w"), F.max("__m").alias("__m"))
    held = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    joined = materialise(wanted.join(held, keys, "left").select(*keys, "__w", "__m", F.coalesce("__n", F.lit(0)).alias("__n")), "stocks")
    kinds = ", ".join(f"{k} {targets.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{kinds}, target_bp bigint, min_rows bigint, required bigint, available bigint, allocated bigint, missing bigint"

    def solved(found: Iterable, quota: int, under: int = 0) -> list[tuple]:
        """Report rows of the strata below the first ``under`` names, which all rows of ``found`` share."""
        rows = [tuple(r) for r in found]
        leaves = {r[under:-3]: Leaf(*r[-3:], max(-(-r[-3] * size // 10000), r[-2])) for r in rows}
        return [(*rows[0][:under], *p, *leaves[p][:2], leaves[p].owed, leaves[p].stock, *got) for p, got in allocate(leaves, quota).items()]

    few = joined.limit(on_driver + 1).collect()
    if len(few) <= on_driver:
        return spark.createDataFrame(solved(few, size), schema)
    top, kind = keys[0], targets.schema[keys[0]].dataType.simpleString()
    room = F.when((F.col("__w") > 0) | (F.col("__m") > 0), F.col("__n")).otherwise(0)
    branches = joined.groupBy(top).agg(F.sum("__w").alias("w"), F.sum(F.least("__m", "__n")).alias("f"), F.sum(room).alias("c"))
    branches = sorted(branches.collect(), key=lambda r: str((r[0],)))  # one row a value of the first column
    quotas = spark.createDataFrame([(r[0], q) for r, q in zip(branches, _split(size, [(r["w"], r["f"], r["c"]) for r in branches]))], f"__top {kind}, __q bigint")
    whole = joined.join(sized(quotas), joined[top].eqNullSafe(F.col("__top"))).select(*keys, "__w", "__m", "__n", "__q")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = (tuple(r.values()) for b in batches for r in b.to_pylist())
        for (_, quota), branch in groupby(every, key=lambda r: (r[0], r[-1])):
            rows = solved([r[:-1] for r in branch], quota, 1)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    types = [to_arrow_type(f.dataType) for f in targets.select(*keys).schema] + [pa.int64()] * 6
    names = [*keys, "target_bp", "min_rows", "required", "available", "allocated", "missing"]
    return materialise(whole.repartition(F.col(top)).sortWithinPartitions(top).mapInArrow(walk, schema), "report")


def draw(rows: DataFrame, report: DataFrame, strata: Sequence[str], id_column: str, seed: int = 42) -> DataFrame:
    """The allocated number of rows of each stratum, with ``draw_rank`` from 1, by permuted rank.

    Ranks are taken within hash ranges whose sizes are counted first, so no task ever holds a whole
    stratum. Repeated rows are drawn as separate rows; null identifiers are ranked like any value. Other columns
    of ``rows`` pass through.
    """
    keys = list(strata)
    quota = report.select(*keys, F.col("allocated").alias("__q"))
    hashed = rows.withColumn("__h", F.xxhash64(F.lit(seed), F.col(id_column)))
    largest = report.agg(F.max("available")).first()[0] or 0
    hashed = hashed.withColumn("__b", range_of("__h", range_count(largest)))
    w = Window.partitionBy(*keys).orderBy("__b")
    starts = (
        hashed.groupBy(*keys, "__b").agg(F.count("*").alias("__c"))
        .withColumn("__start", F.sum("__c").over(w) - F.col("__c"))
        .join(sized(quota), keys)
        .where(F.col("__start") < F.col("__q"))
        .drop("__c")
    )
    starts = materialise(starts, "starts")  # up to MOST_RANGES rows a stratum: joined by shuffle where they are many
    ranked = hashed.join(sized(starts), [*keys, "__b"]).withColumn(
        "draw_rank", F.col("__start") + F.row_number().over(Window.partitionBy(*keys, "__b").orderBy("__h", id_column))
    )
    return ranked.where(F.col("draw_rank") <= F.col("__q")).drop("__h", "__b", "__start", "__q")


def _strata(spark, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    rows = with_language(table(spark, sf_dir, "dataset_ml_ready", "sample_id", "cwe_id", "programming_language"), table(spark, sf_dir, "lang_alias"))
    label = weakness_label(F.col("cwe_id"))
    read = rows.select("sample_id", F.when(label.isin(*TARGET_LABELS), label).otherwise(F.lit("Other")).alias("cwe_label"), F.col("language").alias("programming_language"))
    read = materialise(read, "strata")
    return read, table(spark, sf_dir, "sampling_target"), read.count() // 5


KEYS = ("cwe_label", "programming_language")


def p1_allocation(spark, sf_dir: str) -> DataFrame:
    """Targets, available, allocated and missing rows per stratum."""
    read, targets, size = _strata(spark, sf_dir)
    return stratum_report(read.select(*KEYS), targets, KEYS, "target_bp", "min_rows", size)


def p1_report(spark, sf_dir: str) -> DataFrame:
    """Targets, required, available and missing rows per stratum: where the targets could not be met."""
    return p1_allocation(spark, sf_dir).drop("allocated")


def p1_found(spark, sf_dir: str) -> DataFrame:
    """Strata of which too few rows exist."""
    return p1_allocation(spark, sf_dir).where("missing > 0").select(*KEYS)


def p1_sample(spark, sf_dir: str) -> DataFrame:
    """The rows of the sample."""
    read, targets, size = _strata(spark, sf_dir)
    return draw(read, stratum_report(read.select(*KEYS), targets, KEYS, "target_bp", "min_rows", size), KEYS, "sample_id")


QUERIES = {"p1_found": p1_found, "p1_report": p1_report, "p1_allocation": p1_allocation, "p1_sample": p1_sample}
