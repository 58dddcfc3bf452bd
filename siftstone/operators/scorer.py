"""Scorers of code: the bundled bag-of-tokens classifier, and the interface others plug into."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.functions.dictionaries import LABEL_NAMES
from siftstone.operators.vectors import prediction

#: A scorer maps a DataFrame with ``code`` to it plus ``probabilities`` (one per label).
Scorer = Callable[[DataFrame], DataFrame]


def fit_scorer(df: DataFrame, code: str = "code", label: str = "label_id", weight: str | None = None, features: int = 1 << 12, rounds: int = 10) -> PipelineModel:
    """Fit the bundled scorer: hashed token frequencies, inverse document frequency, multinomial regression."""
    stages = [
        RegexTokenizer(inputCol=code, outputCol="__tokens", pattern=r"[^\p{L}\p{N}_]+", minTokenLength=2),
        HashingTF(inputCol="__tokens", outputCol="__tf", numFeatures=features),
        IDF(inputCol="__tf", outputCol="__x"),
        LogisticRegression(featuresCol="__x", labelCol=label, probabilityCol="__p", rawPredictionCol="__raw", predictionCol="__guess", maxIter=rounds, regParam=0.01, **({"weightCol": weight} if weight else {})),
    ]
    return Pipeline(stages=stages).fit(df.where(F.col(code).isNotNull()).withColumn(label, F.col(label).cast("double")))


def model_scorer(model: PipelineModel, code: str = "code") -> Scorer:
    """The scorer of a fitted pipeline; null and empty code have null probabilities."""

    def score(df: DataFrame) -> DataFrame:
        known = df.withColumn("__code", F.col(code)).withColumn(code, F.coalesce(code, F.lit("")))
        p = vector_to_array("__p")  # as long as the highest label seen in fitting
        padded = F.concat(p, F.array_repeat(F.lit(0.0), F.greatest(F.lit(len(LABEL_NAMES)) - F.size(p), F.lit(0))))
        out = model.transform(known).withColumn("probabilities", F.when(F.length("__code") > 0, padded))
        return out.withColumn(code, F.col("__code")).select(*df.columns, "probabilities")

    return score


def prediction_json(prediction_column: str = "prediction") -> Column:
    """A prediction as the JSON text of a response: label, confidence and probabilities by name; null for none."""
    return F.to_json(F.col(prediction_column), {"ignoreNullFields": "false"})


def save_if_better(model: PipelineModel, score: float, best: float | None, path: str) -> float:
    """Save ``model`` at ``path``, replacing the one there, if its score beats ``best``; gives the better of both."""
    if best is None or score > best:
        model.write().overwrite().save(path)
        return score
    return best


def write_history(spark: SparkSession, epochs: Sequence[dict], path: str) -> None:
    """The training history, one JSON line an epoch in one file; values missing in some epochs are null there."""
    names = list(dict.fromkeys(k for e in epochs for k in e))
    kinds = {k: "bigint" if all(isinstance(e.get(k, 0), int) for e in epochs) else "double" for k in names}
    rows = [tuple(None if e.get(k) is None else (int if kinds[k] == "bigint" else float)(e[k]) for k in names) for e in epochs]
    spark.createDataFrame(rows, ", ".join(f"`{k}` {kinds[k]}" for k in names)).coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def predicted(df: DataFrame, scorer: Scorer) -> DataFrame:
    """``df`` with ``prediction``: label, confidence and probabilities; null where the scorer gave none."""
    scored = scorer(df)
    return scored.withColumn("prediction", F.when(F.col("probabilities").isNotNull(), prediction(F.col("probabilities")))).drop("probabilities")
