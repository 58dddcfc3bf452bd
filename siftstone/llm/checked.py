"""What must hold of results that SQL cannot state in full: one row per item, stratum or source, with the rules it keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm import mixing, packing, sampling, splitting
from siftstone.plans.scratch import materialise
from siftstone.sources.tables import table


def p1_checked(spark, sf_dir: str) -> DataFrame:
    """Per target stratum: whether the sample keeps its minimum (or all rows there are), and the size of the whole sample.

    Where all minimums together exceed the sample none is promised, and a stratum then may not exceed its minimum.
    """
    drawn = materialise(sampling.p1_sample(spark, sf_dir).groupBy(*sampling.KEYS).agg(F.count("*").alias("n"), F.max("draw_rank").alias("last")), "drawn")
    report = sampling.p1_allocation(spark, sf_dir).join(drawn, list(sampling.KEYS), "left")
    least, n = F.least("min_rows", "available"), F.coalesce("n", F.lit(0))
    size = drawn.agg(F.sum("n")).first()[0] or 0
    fits = (report.agg(F.sum(least)).first()[0] or 0) <= size
    kept = (n <= F.col("available")) & (n == F.coalesce("last", F.lit(0))) & ((n >= least) if fits else (n <= least))
    return report.select(*sampling.KEYS, "available", kept.alias("keeps_minimum"), F.lit(size).cast("bigint").alias("sample_rows"))


def p4_checked(spark, sf_dir: str) -> DataFrame:
    """Per item above the limit: its tokens, put together again from its pieces, and whether sizes, overlaps and texts are right."""
    pieces = splitting.p4_pieces(spark, sf_dir)
    own = F.col("n_tokens") - F.when(F.col("piece_no") > 1, splitting.OVERLAP).otherwise(0)
    ends = F.array_sort(F.collect_list(F.struct("piece_no", "start_char", "end_char")))
    joined = pieces.groupBy("table_name", "item_id").agg(
        F.sum(own).alias("n_tokens"), F.max("n_tokens").alias("most"), F.count("*").alias("n"), F.max("n_pieces").alias("said"), ends.alias("e"),
        F.bool_and(F.length("piece") == F.col("end_char") - F.col("start_char")).alias("texts"),
    )
    meets = F.forall(F.sequence(F.lit(1), F.size("e") - 1), lambda i: (F.get("e", i)["start_char"] < F.get("e", i - 1)["end_char"]) & (F.get("e", i)["end_char"] > F.get("e", i - 1)["end_char"]))
    right = (F.col("most") <= splitting.LIMIT) & (F.col("n") == F.col("said")) & (F.get("e", F.lit(0))["start_char"] == 0) & meets & F.col("texts")
    return joined.select("table_name", "item_id", "n_tokens", right.alias("right"))


def p7_checked(spark, sf_dir: str) -> DataFrame:
    """Per text with tokens: whether it is packed once, in order, cut only above the capacity, and in no overfull container."""
    packed = materialise(packing.p7_packed(spark, sf_dir), "packed")
    full = packed.groupBy("container").agg(F.sum("n_tokens").alias("held"))
    texts = packed.join(full, "container").groupBy("doc_id").agg(
        F.count("*").alias("n"), F.count_distinct("piece_no").alias("d"), F.max("piece_no").alias("last"), F.sum("n_tokens").alias("size"), F.max("held").alias("held")
    )
    whole = F.expr(f"(size - 1) div {packing.CAPACITY}")
    right = (F.col("n") == F.col("d")) & (F.col("last") == whole) & (F.col("n") == whole + 1) & (F.col("held") <= packing.CAPACITY)
    return texts.select("doc_id", right.alias("right"))


def p8_checked(spark, sf_dir: str) -> DataFrame:
    """Per source: its limits, whether its demand is met (the last text may exceed it) and no text is drawn too often."""
    mixed, plan = mixing.mixed_documents(spark, sf_dir)
    drawn = mixed.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.max("n_tokens").alias("longest"), F.max("copy_no").alias("most"))
    held = plan.join(drawn, "source", "left").fillna(0, ["n", "longest", "most"])
    met = (F.col("n") >= F.col("demand")) & ((F.col("n") < F.col("demand") + F.col("longest")) | (F.col("n") == 0)) & (F.col("unmet") == 0)
    return held.select("source", "target_share", "max_repeats", met.alias("share_met"), (F.col("most") <= F.col("max_repeats")).alias("repeats_kept"))


QUERIES = {"p1_checked": p1_checked, "p4_checked": p4_checked, "p7_checked": p7_checked, "p8_checked": p8_checked}
