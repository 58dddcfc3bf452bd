"""Vectors of windows pooled into one per sample, and the small maths of a classifier's head."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.functions.dictionaries import LABEL_NAMES


def dot(a: Column, b: Column) -> Column:
    """Scalar product of two arrays of numbers."""
    return F.aggregate(F.zip_with(a.cast("array<double>"), b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def linear(x: Column, weights: Sequence[Sequence[float]], bias: Sequence[float]) -> Column:
    """A linear layer: one number per row of ``weights``."""
    return F.array(*[dot(x, F.array(*[F.lit(float(v)) for v in row])) + F.lit(float(b)) for row, b in zip(weights, bias)])


def pooled(df: DataFrame, sample: str, vector: str, how: str = "max") -> DataFrame:
    """(sample, dim, value): element-wise maximum or mean of a sample's vectors, combined map-side per dimension."""
    if how not in ("max", "mean"):
        raise ValueError(f"unknown pooling {how!r}")
    values = df.where(F.col(vector).isNotNull()).select(sample, F.posexplode(vector).alias("dim", "x"))
    return values.groupBy(sample, "dim").agg((F.max if how == "max" else F.avg)(F.col("x").cast("double")).alias("value"))


def attention_pooled(df: DataFrame, sample: str, vector: str, hidden: Sequence[Sequence[float]], bias: Sequence[float], out: Sequence[float]) -> DataFrame:
    """(sample, dim, value): vectors weighted by the softmax of out . tanh(hidden x + bias) over the sample.

    The greatest score of a sample is taken out before the exponential. Numerator and denominator are sums, so a sample
    of any number of windows is combined map-side; nothing of it is collected.
    """
    score = dot(F.transform(linear(F.col(vector), hidden, bias), F.tanh), F.array(*[F.lit(float(v)) for v in out]))
    scored = df.where(F.col(vector).isNotNull()).select(sample, vector, score.alias("__score"))
    top = scored.groupBy(F.col(sample).alias("__sample")).agg(F.max("__score").alias("__top"))
    weighed = scored.join(top, F.col(sample).eqNullSafe(F.col("__sample"))).withColumn("__w", F.exp(F.col("__score") - F.col("__top")))
    values = weighed.select(sample, "__w", F.posexplode(vector).alias("dim", "x"))
    return values.groupBy(sample, "dim").agg((F.sum(F.col("__w") * F.col("x")) / F.sum("__w")).alias("value"))


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits."""
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda s, x: s + x)
    return F.transform(powers, lambda x: x / total)


def argmax(values: Column) -> Column:
    """The position (from 0) of the first greatest entry."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("bigint")


def prediction(probabilities: Column, names: Sequence[str] = LABEL_NAMES) -> Column:
    """struct(label, confidence, probabilities by name)."""
    known = F.array(*[F.lit(n) for n in names])
    return F.struct(
        F.element_at(known, (argmax(probabilities) + 1).cast("int")).alias("label"),
        F.array_max(probabilities).alias("confidence"),
        F.map_from_arrays(known, probabilities).alias("probabilities"),
    )


def top_entries(probabilities: Column, k: int, names: Sequence[str] = LABEL_NAMES) -> Column:
    """The ``k`` most likely (name, probability), ties in label order."""
    entries = F.transform(probabilities, lambda p, i: F.struct((-p).alias("neg"), i.alias("i"), F.element_at(F.array(*[F.lit(n) for n in names]), i + 1).alias("name")))
    return F.transform(F.slice(F.array_sort(entries), 1, k), lambda e: F.struct(e["name"].alias("label"), (-e["neg"]).alias("probability")))


def focal_loss(logits: Column, label: Column, gamma: float = 2.0, weights: Sequence[float] | None = None) -> Column:
    """Focal loss of one row: (1 - pt)^gamma * ce with ce the weighted cross entropy and pt = exp(-ce)."""
    at = (label + 1).cast("int")
    top = F.array_max(logits)
    log_total = F.log(F.aggregate(F.transform(logits, lambda x: F.exp(x - top)), F.lit(0.0), lambda s, x: s + x)) + top
    ce = log_total - F.element_at(logits, at)
    if weights is not None:
        ce = ce * F.element_at(F.array(*[F.lit(float(w)) for w in weights]), at)
    return F.pow(1 - F.exp(-ce), F.lit(float(gamma))) * ce


def cosine_rate(step: Column, steps: int, peak: float, warm: float = 0.1) -> Column:
    """Learning rate at ``step``: linear over the warm-up share of the steps, then half a cosine down to 0."""
    first = int(steps * warm)
    progress = (step - first) / F.lit(float(max(1, steps - first)))
    falling = F.greatest(F.lit(0.0), F.lit(0.5) * (1 + F.cos(F.lit(3.141592653589793) * progress)))
    return F.lit(peak) * F.when(step < first, step / F.lit(float(max(1, first)))).otherwise(falling)
