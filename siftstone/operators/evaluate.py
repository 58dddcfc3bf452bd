"""Evaluation of predictions: accuracy, per-class report, losses along training, early stopping."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """(truth, guess, n): the confusion counts, all that later steps need."""
    return df.groupBy(F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count("*").alias("n"))


def class_report(counts: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) for each label in truth or guess; 0 where a quotient has no denominator."""
    sides = counts.select(F.explode(F.array(
        F.struct(F.col("truth").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("guessed"), F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("guess").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("guessed"), F.lit(0).cast("bigint").alias("hit")),
    )).alias("s")).select("s.*")
    held = sides.groupBy("label").agg(F.sum("support").alias("support"), F.sum("guessed").alias("guessed"), F.sum("hit").alias("hit"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    rated = held.withColumn("precision", ratio(F.col("hit"), F.col("guessed"))).withColumn("recall", ratio(F.col("hit"), F.col("support")))
    return rated.withColumn("f1", ratio(2 * F.col("hit").cast("double"), F.col("guessed") + F.col("support"))).select("label", "precision", "recall", "f1", "support")


def overall(counts: DataFrame) -> DataFrame:
    """(accuracy, macro_f1) as one row."""
    right = F.sum(F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0)) / F.sum("n")
    return counts.agg(right.alias("accuracy")).withColumn("macro_f1", class_report(counts).agg(F.avg("f1")).scalar())


def full_report(counts: DataFrame) -> DataFrame:
    """The class report with a macro and a weighted row."""
    rows = class_report(counts)
    by = F.col("support")
    mean = [F.avg(c).alias(c) for c in ("precision", "recall", "f1")]
    weighted = [(F.sum(F.col(c) * by) / F.sum(by)).alias(c) for c in ("precision", "recall", "f1")]
    macro = rows.agg(*mean, F.sum(by).alias("support")).withColumn("label", F.lit("macro"))
    heavy = rows.agg(*weighted, F.sum(by).alias("support")).withColumn("label", F.lit("weighted"))
    return rows.withColumn("label", F.col("label").cast("string")).unionByName(macro).unionByName(heavy)


def trailing_mean(df: DataFrame, step: str, value: str, width: int = 50, every: int = 50, block: int = 10_000) -> DataFrame:
    """(step, mean): the mean of the last ``width`` values at every ``every``-th step, steps counting from 0 without gaps.

    Steps are cut into blocks, each with the last rows of the block before, so no task holds the whole series.
    """
    at, tail = F.expr(f"{step} div {block}"), F.col(step) % block >= block - width + 1
    spread = df.select(step, value, F.explode(F.when(tail, F.array(at, at + 1)).otherwise(F.array(at))).alias("__block"))
    w = Window.partitionBy("__block").orderBy(step).rowsBetween(-(width - 1), 0)
    means = spread.withColumn("mean", F.avg(value).over(w)).where((at == F.col("__block")) & ((F.col(step) + 1) % every == 0))
    return means.select(step, "mean")


def early_stopping(df: DataFrame, run: str, epoch: str, score: str, delta: float = 0.0001, patience: int = 3) -> DataFrame:
    """(run, best, best_epoch, stopped_at): the fold over a run's epochs; ``stopped_at`` is null if patience never ran out.

    The best moves only when beaten by more than ``delta``, which no window frame can state. Runs are sorted within their
    partition and folded as they stream by, so memory doesn't grow with a run; each step needs the one before, so a run is one
    task's stream, row by row. Null scores are skipped; equal epochs are
    folded by rising score.
    """
    kind = df.schema[run].dataType.simpleString()
    picked = df.where(F.col(score).isNotNull() & F.col(run).isNotNull()).select(F.col(run).alias("run"), F.col(epoch).cast("bigint").alias("e"), F.col(score).cast("double").alias("v"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: list | None = None  # run, best, its epoch, epochs without a better one, stop
        done = []
        for batch in batches:
            for r, e, v in zip(batch["run"], batch["e"].tolist(), batch["v"].tolist()):
                if now is None or now[0] != r:
                    done += [now] if now else []
                    now = [r, v, e, 0, None]
                elif now[4] is None:
                    if v > now[1] + delta:
                        now[1:4] = v, e, 0
                    else:
                        now[3] += 1
                        now[4] = e if now[3] >= patience else None
            if len(done) > 10_000:
                yield frame(done)
                done = []
        yield frame(done + ([now] if now else []))

    def frame(rows: list) -> pd.DataFrame:
        return pd.DataFrame([(r, b, e, s) for r, b, e, _, s in rows], columns=["run", "best", "best_epoch", "stopped_at"]).astype({"stopped_at": "Int64"})

    folded = picked.repartition("run").sortWithinPartitions("run", "e", "v").mapInPandas(fold, f"run {kind}, best double, best_epoch bigint, stopped_at bigint")
    return folded.withColumnRenamed("run", run)
