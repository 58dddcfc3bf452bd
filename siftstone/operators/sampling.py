"""Samples, splits, class weights, chunks and batches, all reproducible from row identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftstone.functions.derive import label_name
from siftstone.functions.dictionaries import LABEL_NAMES
from siftstone.operators.ranks import draw_key, draw_number, hashed_rank
from siftstone.plans.dims import sized


def reduce_by_chunk(df: DataFrame, id_column: str, fraction: float = 0.3, chunk_rows: int = 10_000, seed: str = "42") -> DataFrame:
    """The given fraction of each chunk of ``chunk_rows`` consecutive identifiers, half rounded to even."""
    chunked = df.withColumn("__chunk", F.expr(f"{id_column} div {chunk_rows}"))
    sizes = chunked.groupBy("__chunk").agg(F.bround(F.lit(fraction) * F.count("*"), 0).cast("bigint").alias("__take"))
    ranked = hashed_rank(chunked, ["__chunk"], draw_key(seed, F.col(id_column)), [id_column], "__rank")
    return ranked.join(sizes, "__chunk").where("__rank <= __take").drop("__chunk", "__take", "__rank")


def stratified_split(df: DataFrame, label: str, id_column: str, fraction: float = 0.1, seed: str = "42", group: Column | None = None) -> DataFrame:
    """``df`` with ``part``: ``val`` for the first ceil(fraction * n) rows of each label in hashed order, else ``train``.

    With ``group`` (say, the key of the code), rows that are equal in it share their hash, so only the group at the border can
    fall into both parts.
    """
    sizes = df.groupBy(F.col(label).alias("__label")).agg(F.ceil(F.lit(fraction) * F.count("*")).alias("__take"))
    ranked = hashed_rank(df, [label], draw_key(seed, F.col(id_column) if group is None else group), [id_column], "__rank")
    joined = ranked.join(sizes, F.col(label).eqNullSafe(F.col("__label")))
    return joined.withColumn("part", F.when(F.col("__rank") <= F.col("__take"), "val").otherwise("train")).drop("__label", "__take", "__rank")


def class_weights(df: DataFrame, label: str = "label_id", classes: int = len(LABEL_NAMES)) -> DataFrame:
    """(label_id, n_rows, weight): n / (classes * count), absent classes counted as 1, divided by the mean weight."""
    counts = df.groupBy(F.col(label).cast("bigint").alias("label_id")).agg(F.count("*").alias("n_rows"))
    domain = df.sparkSession.range(classes).select(F.col("id").alias("label_id"))
    held = domain.join(counts, "label_id", "left").select("label_id", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))
    raw = held.agg(F.collect_list(F.struct("label_id", "n_rows")).alias("all"), F.sum("n_rows").alias("n"))  # ``classes`` entries
    each = raw.select(F.explode("all").alias("e"), "n", "all")
    inverse = lambda c, n: n / (F.lit(classes) * F.greatest(c, F.lit(1)))
    total = F.aggregate(F.col("all"), F.lit(0.0), lambda acc, x: acc + inverse(x["n_rows"], F.col("n")))
    return each.select("e.label_id", "e.n_rows", F.round(inverse(F.col("e.n_rows"), F.col("n")) / (total / classes), 9).alias("weight"))


def sampler_weights(df: DataFrame, label: str) -> DataFrame:
    """``df`` with ``weight``: one over the rows of its label; the label counts are few and joined by size."""
    counts = df.groupBy(F.col(label).alias("__label")).agg(F.count("*").alias("__n"))
    return df.join(sized(counts), F.col(label).eqNullSafe(F.col("__label"))).withColumn("weight", F.lit(1.0) / F.col("__n")).drop("__label", "__n")


def weighted_resample(df: DataFrame, label: str, id_column: str, seed: str = "42") -> DataFrame:
    """(draw_no, label, id): as many draws with replacement as rows, each label equally likely, each row of it too."""
    ranked = hashed_rank(df.select(label, id_column), [label], draw_key(seed, F.col(id_column)), [id_column], "__rank")
    counts = df.groupBy(F.col(label).alias("__l")).agg(F.count("*").alias("__n"))
    order = Window.orderBy(F.coalesce(F.col("__l").cast("string"), F.lit("None")))  # over one row a label
    labels = counts.select((F.row_number().over(order) - 1).alias("__i"), "__l", "__n")
    total = counts.agg(F.sum("__n").alias("rows"), F.count("*").alias("labels")).first()
    if not total["labels"]:
        return df.select(F.lit(0).cast("bigint").alias("draw_no"), label, id_column).limit(0)
    draws = df.sparkSession.range(total["rows"]).select(
        F.col("id").alias("draw_no"), (draw_number(draw_key("label", F.col("id"))) % total["labels"]).cast("int").alias("__i"), draw_number(draw_key("row", F.col("id"))).alias("__d")
    )
    picked = draws.join(sized(labels), "__i").select("draw_no", "__l", (F.col("__d") % F.col("__n") + 1).alias("__at"))
    on = (F.col("__rank") == F.col("__at")) & F.col(label).eqNullSafe(F.col("__l"))
    return picked.join(ranked, on).select("draw_no", label, id_column)


def numbered(df: DataFrame, id_column: str, seed: str = "42") -> DataFrame:
    """``df`` with ``place``: its place (from 0) in one shuffled order of all rows."""
    ranked = hashed_rank(df.withColumn("__all", F.lit(1)), ["__all"], draw_key(seed, F.col(id_column)), [id_column], "__rank")
    return ranked.withColumn("place", F.col("__rank") - 1).drop("__all", "__rank")


def chunk_of(place: Column, total: Column, chunks: int) -> Column:
    """The chunk (from 0) of a place when ``total`` rows are cut into nearly equal chunks, the first ones one longer."""
    small, more = F.floor(total / chunks), total % chunks
    edge = more * (small + 1)
    return F.when(place < edge, F.floor(place / (small + 1))).otherwise(more + F.floor((place - edge) / F.greatest(small, F.lit(1)))).cast("bigint")


def decoded(df: DataFrame, label: str = "label_id") -> DataFrame:
    """``df`` with the label's name."""
    return df.withColumn("label_name", label_name(F.col(label)))
