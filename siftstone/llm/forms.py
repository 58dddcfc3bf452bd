"""Problem 2: records that differ only in formatting become one, with the number of copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.functions.readings import form_key
from siftstone.plans.scratch import materialise
from siftstone.sources.tables import table

#: Hash ranges whose counts show where hot keys can be, at least.
RANGES = 4096
#: A hot key's rows are spread over this many partial groups per task.
SALTS_PER_TASK = 2


def hot_keys(keyed: DataFrame, tasks: int | None = None) -> DataFrame:
    """The keys that hold more rows than half a task's even share: fewer than twice the tasks, found exactly.

    Counts per hash range (map-side combined, ``RANGES`` rows a task) show which ranges can hold a hot key; only
    rows in these are then counted per key.
    """
    tasks = tasks or max(1, int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranges = max(RANGES, 16 * tasks)
    ranged = keyed.withColumn("__r", F.pmod(F.xxhash64("key"), F.lit(ranges)).cast("int"))
    sizes = ranged.groupBy("__r").count()
    total = keyed.count()
    limit = max(1, total // (2 * tasks))
    full = [r["__r"] for r in sizes.where(F.col("count") > limit).collect()]  # fewer than twice the tasks
    if not full:
        return keyed.select("key").limit(0)
    return ranged.where(F.col("__r").isin(full)).groupBy("key").count().where(F.col("count") > limit).select("key")


def keyed_table(df: DataFrame, id_column: str, key: Column) -> DataFrame:
    """(id, key) of the rows of ``df`` that have a key, written to scratch: the text is read once."""
    return materialise(df.select(F.col(id_column).alias("id"), key.alias("key")).where("key is not null"), "keyed")


def collapse(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hot, rest): one row (key, kept_id, n_copies) per key, the hot keys apart.

    Hot keys are counted in two levels over salts, all others in one. ``kept_id`` is the smallest identifier; null
    identifiers count as copies and represent only a key without other identifiers. Repeated rows count
    each time. An empty table gives empty results.
    """
    tasks = max(1, int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hot = materialise(hot_keys(keyed, tasks), "hot")
    marked = F.broadcast(hot)
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS_PER_TASK * tasks)).cast("int")
    two = (
        keyed.join(marked, "key", "left_semi")
        .groupBy("key", salt.alias("__salt")).agg(F.min("id").alias("kept_id"), F.count("*").alias("n_copies"))
        .groupBy("key").agg(F.min("kept_id").alias("kept_id"), F.sum("n_copies").alias("n_copies"))
    )
    one = keyed.join(marked, "key", "left_anti").groupBy("key").agg(F.min("id").alias("kept_id"), F.count("*").alias("n_copies"))
    return two, one


def copies(keyed: DataFrame) -> DataFrame:
    """(kept_id, id) of every row that is not its key's representative.

    Rows of hot keys meet their few representatives by broadcast (fewer than twice the tasks), all others by a
    shuffle in which no key is hot.
    """
    two, one = collapse(keyed)
    two = materialise(two, "hot_records")
    hot = keyed.join(F.broadcast(two.select("key", "kept_id")), "key")
    rest = keyed.join(F.broadcast(two.select("key")), "key", "left_anti").join(one.where("n_copies > 1").select("key", "kept_id"), "key")
    return hot.unionByName(rest).where(~F.col("id").eqNullSafe(F.col("kept_id"))).select("kept_id", "id")


def _forms(spark, sf_dir: str) -> DataFrame:
    return keyed_table(table(spark, sf_dir, "dataset_ml_ready", "sample_id", "code"), "sample_id", form_key(F.col("code")))


def p2_found(spark, sf_dir: str) -> DataFrame:
    """Every row whose form a row with a smaller identifier has too."""
    return copies(_forms(spark, sf_dir)).select("kept_id", F.col("id").alias("sample_id"))


def p2_records(spark, sf_dir: str) -> DataFrame:
    """One row per form: the kept identifier and the number of copies. A row without a form is a record of its own."""
    rows = table(spark, sf_dir, "dataset_ml_ready", "sample_id", "code")
    read = materialise(rows.select(F.col("sample_id").alias("id"), form_key(F.col("code")).alias("key")), "keyed")
    two, one = collapse(read.where("key is not null"))
    formless = read.where("key is null").select(F.col("id").alias("kept_id"), F.lit(1).cast("bigint").alias("n_copies"))
    return two.unionByName(one).select("kept_id", "n_copies").unionByName(formless)


QUERIES = {"p2_found": p2_found, "p2_records": p2_records}
