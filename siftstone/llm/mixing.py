"""Problem 8: texts of several sources mixed to target shares of all tokens along a curriculum.

Each source has a weight schedule over training progress x from 0 to 1: straight lines between given points, scaled so that the
integral is the source's target share. A source's texts follow each other in hashed order, again from the start when it must
repeat; the tokens that came before a text are its demand, and the inverse of the integrated schedule says at which x that
demand is reached. Ordering all texts by x is the mix.

Where no schedule is given, a source's weight is its share times 1 + a (2 x - 1), the tilts ``a`` averaging to zero so that the
weights sum to 1 at any time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftstone.functions.text import strip
from siftstone.llm.prefix import hashed_prefix
from siftstone.llm.tokens import token_counts
from siftstone.plans.dims import sized
from siftstone.plans.scratch import materialise
from siftstone.sources.tables import table

#: Strongest tilt of a schedule: sources of short texts come earlier, those of long ones later.
TILT = 0.5
_POINT = "struct<x: double, w: double>"


def source_name(c: Column) -> Column:
    """A source's name: outer space, letter case and the separators between its words don't matter."""
    return F.regexp_replace(F.lower(strip(c)), r"[^\p{L}\p{N}]+", "_")


def _drawable(sized: DataFrame, id_column: str, source_column: str, size_column: str) -> DataFrame:
    return sized.where(F.col(size_column) > 0).select(id_column, source_name(F.col(source_column)).alias("source"), F.col(size_column).cast("bigint").alias("n_tokens"))


def plan_mix(texts: DataFrame, weights: DataFrame, budget: int | None = None, tilt: float = TILT, schedules: DataFrame | None = None) -> DataFrame:
    """One row per source of ``weights``: target_share, max_repeats, n_texts, supply, wanted, demand, unmet, points.

    ``texts`` has source and n_tokens, ``weights`` source, target_share and max_repeats; a source given twice counts with its largest
    figures. ``wanted`` are the tokens of its share, ``demand`` those it can give within its repeats, ``unmet`` the rest. Without ``budget``
    the total is the largest at which every source with tokens reaches its share; a source without tokens, share or repeats
    cannot take part. ``schedules`` has source, x and weight: x outside 0 to 1, null and negative weights are ignored, before
    the first and after the last point the weight stays, and a source without positive weight has the default schedule.
    The plan is made of aggregates and windows over one row a source; only two numbers reach the driver.
    """
    listed = weights.groupBy(source_name(F.col("source")).alias("source")).agg(
        F.coalesce(F.max("target_share"), F.lit(0.0)).alias("target_share"), F.coalesce(F.max("max_repeats"), F.lit(0)).alias("max_repeats")
    )
    held = texts.groupBy("source").agg(F.count("*").alias("n_texts"), F.sum("n_tokens").alias("supply"))
    known = listed.join(held, "source", "left").fillna(0, ["n_texts", "supply"])
    known = materialise(known.withColumn("able", (F.col("target_share") > 0) & (F.col("max_repeats") > 0) & (F.col("supply") > 0)), "sources")
    most = F.col("supply") * F.col("max_repeats")
    whole = known.where("able").agg(F.sum("target_share")).first()[0] or 1.0
    able = known.where("able").agg(F.min(F.floor(most * F.lit(whole) / F.col("target_share")))).first()[0] or 0
    wanted = F.floor(F.lit(budget or able) * F.col("target_share") / F.lit(whole)).cast("bigint")
    every, order = Window.partitionBy(), Window.orderBy(F.col("supply") / F.col("n_texts"), "source")  # over one row a source
    spread = (
        known.where("able").withColumn("rank", F.row_number().over(order) - 1).withColumn("last", F.max("rank").over(every))
        .withColumn("place", F.when(F.col("last") > 0, 2 * F.col("rank") / F.col("last") - 1).otherwise(0.0))
        .withColumn("off", F.col("place") - F.sum(F.col("target_share") / F.lit(whole) * F.col("place")).over(every))
        .withColumn("tilt", F.coalesce(F.try_divide(F.lit(tilt) * F.col("off"), F.max(F.abs("off")).over(every)), F.lit(0.0)))
        .select("source", "tilt")
    )
    planned = known.join(spread, "source", "left").withColumn("wanted", wanted).withColumn("demand", F.when(F.col("able"), F.least("wanted", most)).otherwise(0))
    line = F.array(F.struct(F.lit(0.0).alias("x"), (1 - F.col("tilt")).alias("w")), F.struct(F.lit(1.0).alias("x"), (1 + F.col("tilt")).alias("w")))
    if schedules is None:
        shaped = planned.withColumn("points", line)
    else:
        fine = schedules.where((F.col("x") >= 0) & (F.col("x") <= 1) & (F.col("weight") >= 0))
        given = fine.groupBy(source_name(F.col("source")).alias("source"), F.col("x").cast("double").alias("x")).agg(F.max("weight").cast("double").alias("w"))
        lines = given.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("x", "w"))).alias("p"), F.max("w").alias("top")).where("top > 0")
        ends = F.concat(
            F.array(F.struct(F.lit(0.0).alias("x"), F.col("p")[0]["w"].alias("w"))), F.col("p"), F.array(F.struct(F.lit(1.0).alias("x"), F.element_at("p", -1)["w"].alias("w")))
        ).cast(f"array<{_POINT}>")
        shaped = planned.join(lines.select("source", ends.alias("__given")), "source", "left").withColumn("points", F.coalesce("__given", line))
    return shaped.select("source", "target_share", "max_repeats", "n_texts", "supply", "wanted", "demand", (F.col("wanted") - F.col("demand")).alias("unmet"), "points")


def segments(points: Column) -> Column:
    """The pieces of a schedule that hand out anything: x0, x1, w0, w1, and the part of the integral up to each end, f0 and f1."""
    empty = F.array().cast("array<struct<x0: double, x1: double, w0: double, w1: double, f0: double, f1: double>>")

    def joined(done: Column, i: Column) -> Column:
        a, b = F.get(points, i), F.get(points, i + 1)
        before = F.coalesce(F.get(done, F.size(done) - 1)["f1"], F.lit(0.0))
        area = (b["x"] - a["x"]) * (a["w"] + b["w"]) / 2
        piece = F.struct(a["x"].alias("x0"), b["x"].alias("x1"), a["w"].alias("w0"), b["w"].alias("w1"), before.alias("f0"), (before + area).alias("f1"))
        return F.when(area > 0, F.concat(done, F.array(piece))).otherwise(done)

    summed = F.aggregate(F.sequence(F.lit(0), F.size(points) - 2), empty, joined)
    whole = lambda s: F.element_at(s, -1)["f1"]
    scaled = lambda p: p.withField("f0", p["f0"] / whole(summed)).withField("f1", p["f1"] / whole(summed))
    return F.transform(summed, scaled)


def progress_at(pieces: Column, part: Column) -> Column:
    """Where a schedule has handed out the given part (0 to 1) of its integral."""
    s = F.coalesce(F.get(F.filter(pieces, lambda p: p["f1"] > part), F.lit(0)), F.element_at(pieces, -1))
    g = (part - s["f0"]) / (s["f1"] - s["f0"])
    rise = s["w1"] - s["w0"]
    # w0 t + rise t^2 / 2 = g (w0 + w1) / 2
    root = (F.sqrt(s["w0"] * s["w0"] + rise * g * (s["w0"] + s["w1"])) - s["w0"]) / rise
    t = F.when(F.abs(rise) < 1e-9 * (s["w0"] + s["w1"]), g).otherwise(root)
    return F.least(F.lit(1.0), s["x0"] + t * (s["x1"] - s["x0"]))


def mix(sized_texts: DataFrame, weights: DataFrame, id_column: str, source_column: str, size_column: str, budget: int | None = None, tilt: float = TILT, seed: int = 42, schedules: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(the mix: id_column, source, copy_no, n_tokens, progress, range-sorted by ``progress``; its plan, see ``plan_mix``).

    Texts of other or no source, and of null or no size, are not drawn. A text is drawn at most ``max_repeats`` times; the last text of
    a source may exceed its demand. Rows with the same identifier are texts of their own.
    """
    drawable = _drawable(sized_texts, id_column, source_column, size_column)
    plan = materialise(plan_mix(drawable, weights, budget, tilt, schedules), "plan")
    used = plan.where("demand > 0").select(
        "source", F.col("demand").alias("__demand"), F.col("wanted").alias("__wanted"), F.col("supply").alias("__supply"), F.col("max_repeats").alias("__repeats"), segments(F.col("points")).alias("__pieces")
    )
    texts = drawable.join(sized(used.select("source")), "source")
    largest = plan.agg(F.max("n_texts")).first()[0] or 0
    placed = hashed_prefix(texts, "source", (id_column,), F.col("n_tokens"), "__before", largest, seed).join(sized(used), "source")
    passes = F.expr("cast(greatest(0, (__demand - __before - 1 + __supply) div __supply) as int)")  # passes that reach this text
    copies = (
        placed.withColumn("__passes", F.least(passes, "__repeats"))
        .where(F.col("__passes") > 0)
        .withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("__passes"))))
        .withColumn("__part", (F.col("__before") + (F.col("copy_no") - 1).cast("bigint") * F.col("__supply")) / F.col("__wanted"))
    )
    out = copies.select(id_column, "source", "copy_no", "n_tokens", progress_at(F.col("__pieces"), F.col("__part")).alias("progress"))
    return out.repartitionByRange("progress").sortWithinPartitions("progress", "source", id_column, "copy_no"), plan


def shares(mixed: DataFrame, plan: DataFrame) -> DataFrame:
    """Per source of the plan: target and actual share of all tokens, wanted and unmet tokens, draws and most repeats; 0 for undrawn sources."""
    drawn = mixed.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_draws"), F.max("copy_no").alias("most_repeats"))
    joined = plan.drop("points", "demand", "n_texts", "supply").join(drawn, "source", "left").fillna({"n_tokens": 0, "n_draws": 0, "most_repeats": 0})
    total = F.sum("n_tokens").over(Window.partitionBy())  # one row a source
    return joined.withColumn("actual_share", F.try_divide(F.col("n_tokens").cast("double"), total))


def mixed_documents(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The mix of the documents, and its plan."""
    texts = token_counts(table(spark, sf_dir, "documents", "doc_id", "source", "text"), "doc_id", "text", ("source",))
    return mix(texts, table(spark, sf_dir, "source_weight"), "doc_id", "source", "n_tokens")


def p8_mix(spark, sf_dir: str) -> DataFrame:
    """The texts drawn, with their place in training."""
    return mixed_documents(spark, sf_dir)[0]


def p8_shares(spark, sf_dir: str) -> DataFrame:
    """Target and actual shares of the sources, and what could not be met."""
    mixed, plan = mixed_documents(spark, sf_dir)
    return shares(materialise(mixed, "mixed"), plan)


QUERIES = {"p8_mix": p8_mix, "p8_shares": p8_shares}
