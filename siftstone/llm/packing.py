"""Problem 7: items of varying length into containers of fixed capacity.

The lengths' histogram (one number per length up to the capacity) is gathered; dynamic programming over it chooses the
bucket bounds with the least padding. Batches form bucket by bucket, from the longest: as many items as fit the token
budget. Buckets alone would leave most of a container empty that holds one item of a little over half its capacity, so
the room a batch leaves is given to the longest shorter bucket that fits, and so on. The plan counts items per
bucket only; its size depends on the buckets, not on the data. Items take their places by their rank in the bucket.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm.prefix import hashed_prefix
from siftstone.llm.tokens import token_counts
from siftstone.plans.scratch import materialise
from siftstone.sources.tables import table

CAPACITY = 2048
#: Buckets the lengths are grouped into.
BUCKETS = 192


def bucket_bounds(counts: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets of lengths with the least padding in total, ascending."""
    lengths = np.array(sorted(k for k, c in counts.items() if c), np.int64)
    m = len(lengths)
    if m <= buckets:
        return lengths.tolist()
    c = np.array([counts[int(k)] for k in lengths], np.float64)
    items, size = np.concatenate([[0], np.cumsum(c)]), np.concatenate([[0], np.cumsum(c * lengths)])
    best = np.full(m + 1, np.inf)
    best[0] = 0
    back = np.zeros((buckets, m + 1), np.int32)
    # padding of a bucket over lengths i..j-1, bounded by lengths[j-1]
    pad = np.full((m + 1, m + 1), np.inf)
    for j in range(1, m + 1):
        pad[:j, j] = lengths[j - 1] * (items[j] - items[:j]) - (size[j] - size[:j])
    for k in range(buckets):
        total = best[:, None] + pad
        back[k] = total.argmin(axis=0)
        best = total[back[k], np.arange(m + 1)]
        best[0] = 0
    bounds, j = [], m
    for k in range(buckets - 1, -1, -1):
        bounds.append(int(lengths[j - 1]))
        j = int(back[k][j])
        if j == 0:
            break
    return bounds[::-1]


def plan_batches(bounds: list[int], held: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(bucket, first rank, items per container, first container, containers): where the items of each bucket go.

    Each pattern of buckets is repeated until one of them runs out, so there are few more patterns than buckets.
    """
    left, taken, container, plan = list(held), [0] * len(held), 0, []
    top = len(bounds) - 1
    while top >= 0:
        if not left[top]:
            top -= 1
            continue
        room, pattern = capacity, []
        for b in range(top, -1, -1):
            q = min(left[b], room // bounds[b]) if bounds[b] <= room else 0
            if q:
                pattern.append((b, q))
                room -= q * bounds[b]
        times = min(left[b] // q for b, q in pattern)
        for b, q in pattern:
            plan.append((b, taken[b], q, container, times))
            taken[b] += q * times
            left[b] -= q * times
        container += times
    return plan


def pack(sized: DataFrame, id_column: str, size_column: str, capacity: int = CAPACITY, buckets: int = BUCKETS) -> DataFrame:
    """(container, id_column, piece_no, first_token, n_tokens): every item in exactly one container.

    An item above ``capacity`` is cut into full pieces and a rest, any other is whole. Items of null or no size are in no
    container. Repeated rows are items of their own. An empty table gives an empty result.
    """
    spark = sized.sparkSession
    pieces = (
        sized.where(F.col(size_column) > 0)
        .select(id_column, F.col(size_column).alias("__n"), F.explode(F.sequence(F.lit(0), F.expr(f"cast(({size_column} - 1) div {capacity} as int)"))).alias("piece_no"))
        .select(id_column, "piece_no", (F.col("piece_no").cast("bigint") * capacity).alias("first_token"), F.least(F.lit(capacity).cast("bigint"), F.col("__n") - F.col("piece_no").cast("bigint") * capacity).alias("n_tokens"))
    )
    pieces = materialise(pieces, "pieces")
    counts = {r["n_tokens"]: r["count"] for r in pieces.groupBy("n_tokens").count().collect()}  # at most ``capacity`` rows
    bounds = bucket_bounds(counts, buckets)
    held, k = [0] * len(bounds), 0
    for n in sorted(counts):
        while bounds[k] < n:
            k += 1
        held[k] += counts[n]
    of_length, k = [], 0
    for n in range(1, capacity + 1):
        while k < len(bounds) and bounds[k] < n:
            k += 1
        of_length.append(k)
    plan = spark.createDataFrame(plan_batches(bounds, held, capacity), "bucket int, __first bigint, __each int, __at bigint, __times bigint")
    lookup = spark.createDataFrame(list(zip(range(1, capacity + 1), of_length)), "n_tokens bigint, bucket int")
    bucketed = pieces.join(F.broadcast(lookup), "n_tokens")
    ranked = hashed_prefix(bucketed, "bucket", (id_column, "piece_no"), F.lit(1), "__rank", max(held, default=0))
    placed = ranked.join(F.broadcast(plan), (ranked["bucket"] == plan["bucket"]) & (F.col("__rank") >= F.col("__first")) & (F.col("__rank") < F.col("__first") + F.col("__each") * F.col("__times")))
    container = F.col("__at") + F.expr("(__rank - __first) div __each")
    return placed.select(container.alias("container"), id_column, "piece_no", "first_token", "n_tokens")


def _packed(spark, sf_dir: str) -> DataFrame:
    return pack(token_counts(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text"), "doc_id", "n_tokens")


def p7_packed(spark, sf_dir: str) -> DataFrame:
    """Each text, or piece of a text above 2 048 tokens, with its container."""
    return _packed(spark, sf_dir)


def p7_containers(spark, sf_dir: str) -> DataFrame:
    """Each container with its items, tokens and unused room."""
    used = F.sum("n_tokens")
    return _packed(spark, sf_dir).groupBy("container").agg(F.count("*").alias("n_items"), used.alias("n_tokens"), (F.lit(CAPACITY) - used).alias("unused"))


QUERIES = {"p7_packed": p7_packed, "p7_containers": p7_containers}
