"""Problem 3: near-duplicates by a range-join on segment counts within cells of rare runs, and an exact check.

The cells of a grid on segment counts alone are met by chance too often (see the README); here a cell is a run hash, and the
counts are compared within it.

* Cells: a likeness of ``t`` lets a code of ``n`` runs miss at most ``n - ceil(t n)`` of its own runs in any partner, so it
  is posted under one run hash more than that, those that a sketch of the collection calls rarest, and every partner is met in
  at least one;
* range-join: each posting carries its code's popcounts in 16 equal segments of the hash range. The Manhattan distance of two
  such vectors never exceeds the number of runs in which the codes differ, and the likeness leaves room for at most
  (1-t)/(1+t) * (n_a + n_b) of those. The join compares, cell by cell, this bound, and sizes and positions (what is left after a
  shared cell must still hold the needed overlap);
* check: the same bound on 64 segments, then the exact likeness.

No step has a cap, so no pair is lost. Equal run sets are one class throughout and are expanded only where rows are asked
for; a class is known by a 64-bit key of its set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.llm.components import components
from siftstone.llm.rarity import bits_for, rarity_sketch, slots
from siftstone.llm.shingles import flat_list, likeness_terms, set_table, shared
from siftstone.plans.scratch import materialise
from siftstone.sources.tables import table

#: Run hashes per counter of the sketch that orders cells by how common they are (within the bounds of ``rarity``).
PER_COUNTER = 16
#: Segments of the counts that postings carry, four bits each (15 stands for more: the bound only weakens), and of the check.
COARSE, SEGMENTS = 16, 64
#: The filter that tells which sets take part in the check has 16 bits or more a pair, up to 2^30 (128 MB), 2^20 at least.
LEAST_FILTER_BITS, MOST_FILTER_BITS = 20, 30
#: Postings per partition of the join, and keys a task remembers so as not to post a set twice, before it starts anew.
PART_ROWS, _SEEN = 200_000, 1_000_000
WIDTH = 3
THRESHOLD = 0.7


def run_sets(df: DataFrame, id_column: str, text_column: str, width: int = WIDTH) -> DataFrame:
    """(id, set_key, n, runs) for each row with at least one word, written to scratch.

    ``runs`` are the sorted hashes of its distinct runs of ``width`` words. Null, blank and wordless texts have
    no row; very long texts are taken whole.
    """
    kind = df.schema[id_column].dataType.simpleString()
    picked = df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).where("text is not null")
    schema = f"id {kind}, set_key bigint, n int, runs array<bigint>"
    return materialise(picked.mapInArrow(lambda it: set_table(it, width), schema), "runs")


def _fresh(keys: np.ndarray, seen: set) -> list[int]:
    """The places of keys not seen before; ``seen`` is emptied when it has grown too large, at the cost of repetitions only."""
    if len(seen) > _SEEN:
        seen.clear()
    return [k for k, key in enumerate(keys.tolist()) if not (key in seen or seen.add(key))]


def coarse_counts(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Popcounts of each set in 16 equal segments, packed four bits each."""
    n = len(offsets) - 1
    at = np.repeat(np.arange(n), np.diff(offsets)) * COARSE + (h >> np.uint64(60)).astype(np.int64)
    counts = np.minimum(np.bincount(at, minlength=n * COARSE).reshape(n, COARSE), 15).astype(np.uint64)
    return np.bitwise_or.reduce(counts << (np.arange(COARSE, dtype=np.uint64) * np.uint64(4)), axis=1)


def coarse_distance(a: str, b: str) -> Column:
    """The Manhattan distance of two packed count vectors."""
    return F.expr(" + ".join(f"abs((shiftrightunsigned({a}, {4 * k}) & 15L) - (shiftrightunsigned({b}, {4 * k}) & 15L))" for k in range(COARSE)))


def posted_cells(runs: DataFrame, sketch: np.ndarray, threshold: float) -> DataFrame:
    """(cell, set_key, place, counts): each distinct set of a task under its rarest cells; ``place`` is n * 2^32 + position from 0."""
    top, bottom = likeness_terms(threshold)
    shipped = runs.sparkSession.sparkContext.broadcast(sketch)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, seen = shipped.value, set()
        for batch in batches:
            keys = batch.column(0).to_numpy()
            fresh = _fresh(keys, seen)
            h, offsets = flat_list(batch.column(1).take(pa.array(fresh, pa.int64())))
            n = np.diff(offsets)
            text = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((h, slots(h, level), text))
            pos = np.arange(len(h)) - offsets[:-1][text]
            kept = pos < (n + (-top * n // bottom) + 1)[text]  # n - ceil(t n) + 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(h[order][kept].view(np.int64)),
                    pa.array(keys[fresh][text][kept]),
                    pa.array((n[text][kept] << 32) + pos[kept]),
                    pa.array(coarse_counts(h, offsets)[text][kept].view(np.int64)),
                ],
                ["cell", "set_key", "place", "counts"],
            )

    return runs.select("set_key", "runs").mapInArrow(post, "cell bigint, set_key bigint, place bigint, counts bigint")


def candidates(cells: DataFrame, threshold: float, parts: int | None = None) -> DataFrame:
    """(a, b), a < b: sets that meet in a cell where counts, sizes and positions still allow the threshold.

    Both sides are the same exchange on ``cell`` into ``parts`` partitions, which Spark reuses.
    """
    top, bottom = likeness_terms(threshold)
    if parts:
        cells = cells.repartition(parts, "cell")
    a = cells.select("cell", F.col("set_key").alias("a"), F.col("place").alias("at"), F.col("counts").alias("ca"))
    b = cells.select("cell", F.col("set_key").alias("b"), F.col("place").alias("bt"), F.col("counts").alias("cb"))
    na, nb = F.shiftright("at", 32), F.shiftright("bt", 32)
    low = F.lit((1 << 32) - 1)
    left = F.least(na - F.col("at").bitwiseAND(low), nb - F.col("bt").bitwiseAND(low))
    return (
        a.join(b, "cell")
        .where((F.col("a") < F.col("b")) & (left * (top + bottom) >= (na + nb) * top) & (coarse_distance("ca", "cb") * (top + bottom) <= (na + nb) * (bottom - top)))
        .select("a", "b").distinct()
    )


def _taking_part(found: DataFrame, runs: DataFrame) -> DataFrame:
    """One row (set_key, runs) per set in ``found``, and perhaps a few others: a bit filter sized by ``found`` spares the rest the shuffle."""
    size = min(MOST_FILTER_BITS, max(LEAST_FILTER_BITS, (16 * found.count()).bit_length()))
    keys = found.select(F.explode(F.array("a", "b")).alias("k")).select((F.pmod("k", F.lit(1 << size)) + 1).alias("p"))  # bit positions count from 1
    bits = keys.groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    whole = bytearray(1 << (size - 3))
    for r in bits.toLocalIterator():
        at = (r["bucket"] - 1) * 4096
        whole[at : at + 4096] = r["bits"]
    shipped = runs.sparkSession.sparkContext.broadcast(bytes(whole))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, seen = np.frombuffer(shipped.value, np.uint8), set()
        for batch in batches:
            keys = batch.column(0).to_numpy()
            at = keys % (1 << size)
            hit = np.flatnonzero((field[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
            yield batch.take(pa.array(hit[_fresh(keys[hit], seen)], pa.int64()))

    return runs.select("set_key", "runs").mapInArrow(keep, "set_key bigint, runs array<bigint>").dropDuplicates(["set_key"])


def verified(found: DataFrame, runs: DataFrame, threshold: float) -> DataFrame:
    """The pairs of ``found`` whose sets reach the threshold, with ``likeness``.

    First the Manhattan distance of the coarse segment counts as a lower bound, then the exact overlap.
    """
    top, bottom = likeness_terms(threshold)
    sets = _taking_part(found, runs)
    pairs = (
        found.join(sets.select(F.col("set_key").alias("a"), F.col("runs").alias("ra")), "a")
        .join(sets.select(F.col("set_key").alias("b"), F.col("runs").alias("rb")), "b")
        .select("a", "b", "ra", "rb")
    )

    def segments(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        at = np.repeat(np.arange(n), np.diff(offsets)) * SEGMENTS + (h >> np.uint64(58)).astype(np.int64)
        return np.bincount(at, minlength=n * SEGMENTS).reshape(n, SEGMENTS)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                (a, ao), (b, bo) = flat_list(batch.column(2)), flat_list(batch.column(3))
                total = np.diff(ao) + np.diff(bo)
                apart = np.abs(segments(a, ao) - segments(b, bo)).sum(axis=1)
                close = np.flatnonzero(apart * (top + bottom) <= total * (bottom - top))
                rows = pa.array(close, pa.int64())
                a, ao = flat_list(batch.column(2).take(rows))
                b, bo = flat_list(batch.column(3).take(rows))
                both, total = shared(a, ao, b, bo), total[close]
                good = both * (top + bottom) >= total * top
                kept = batch.take(rows).filter(pa.array(good))
                yield pa.RecordBatch.from_arrays(
                    [kept.column(0), kept.column(1), pa.array((both / np.maximum(1, total - both))[good])], ["a", "b", "likeness"]
                )

    return pairs.mapInArrow(check, "a bigint, b bigint, likeness double")


def class_pairs(runs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, likeness), a < b: all pairs of different run sets with at least the given likeness.

    The sketch, the filter and the partitions of the join are sized by the data.
    """
    top, bottom = likeness_terms(threshold)
    held = runs.agg(F.sum("n").alias("runs"), F.sum(F.expr(f"n - (n * {top} + {bottom - 1}) div {bottom} + 1")).alias("posted")).first()
    sketch = rarity_sketch(runs.select("runs"), bits_for((held["runs"] or 0) / PER_COUNTER))
    parts = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), (held["posted"] or 0) // PART_ROWS)
    cells = posted_cells(runs, sketch, threshold)
    return verified(materialise(candidates(cells, threshold, parts), "candidates"), runs, threshold)


def row_pairs(runs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: the class pairs, and the pairs within a class, as pairs of rows."""
    rows = runs.select("set_key", "id")
    left, right = rows.select(F.col("set_key").alias("a"), F.col("id").alias("ia")), rows.select(F.col("set_key").alias("b"), F.col("id").alias("ib"))
    across = pairs.join(left, "a").join(right, "b").select("ia", "ib")
    within = left.join(right, left["a"] == right["b"]).where("ia < ib").select("ia", "ib")
    return across.unionByName(within).select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"))


def groups(runs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row (id, class_id, group_id, n_links) per text: its class, its group and how many classes its class is linked to.

    ``class_id`` and ``group_id`` are the smallest identifiers of the class and of the connected group.
    """
    pairs = materialise(class_pairs(runs, threshold), "links")
    both = pairs.select(F.col("a").alias("set_key")).unionByName(pairs.select(F.col("b").alias("set_key")))
    links = both.groupBy("set_key").agg(F.count("*").alias("n_links"))
    classes = runs.groupBy("set_key").agg(F.min("id").alias("class_id"))
    named = materialise(classes, "classes")
    edges = (
        pairs.join(named.select(F.col("set_key").alias("a"), F.col("class_id").alias("u")), "a")
        .join(named.select(F.col("set_key").alias("b"), F.col("class_id").alias("v")), "b")
        .select("u", "v")
    )
    roots = components(edges)
    return (
        runs.select("id", "set_key").join(named, "set_key").join(links, "set_key", "left")
        .join(roots.select(F.col("node").alias("class_id"), "root"), "class_id", "left")
        .select("id", "class_id", F.coalesce("root", "class_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )


def _runs(spark, sf_dir: str) -> DataFrame:
    return run_sets(table(spark, sf_dir, "dataset_ml_ready", "sample_id", "code"), "sample_id", "code")


def p3_found(spark, sf_dir: str) -> DataFrame:
    """All pairs of rows whose code has a likeness of at least 0.7."""
    runs = _runs(spark, sf_dir)
    return row_pairs(runs, class_pairs(runs)).select(F.col("id_a").alias("sample_a"), F.col("id_b").alias("sample_b"))


def p3_groups(spark, sf_dir: str) -> DataFrame:
    """Each row with its class, its group and its class's number of links. A row without words is a class of its own."""
    runs = _runs(spark, sf_dir)
    ids = table(spark, sf_dir, "dataset_ml_ready", "sample_id")
    wordless = ids.join(runs.select("id"), F.col("sample_id").eqNullSafe(F.col("id")), "left_anti")
    alone = wordless.select("sample_id", F.col("sample_id").alias("class_id"), F.col("sample_id").alias("group_id"), F.lit(0).cast("bigint").alias("n_links"))
    return groups(runs).withColumnRenamed("id", "sample_id").unionByName(alone)


QUERIES = {"p3_found": p3_found, "p3_groups": p3_groups}
