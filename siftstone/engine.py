"""The service: health, audit of files, prediction of snippets, and replacing the model."""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.operators.report import audited, batch_response, per_file, reports, risky, summary
from siftstone.operators.scorer import Scorer, model_scorer, predicted


#: A notifier gets the chat, the message, the document and its name.
Notifier = Callable[[str, str, str, str], None]


def setting(spark: SparkSession, name: str) -> str | None:
    """A setting of the service: ``spark.siftstone.<name>`` of the session, else SIFTSTONE_<NAME> of the environment, else None."""
    return spark.conf.get(f"spark.siftstone.{name}", os.environ.get(f"SIFTSTONE_{name.upper().replace('.', '_')}"))


def notify_all(found: DataFrame, chat: str, send: Notifier) -> int:
    """Hand each request's message and report (rows of ``reports`` with the column ``chat``) to ``send``, one at a time; gives how many got through.

    Requests without a chat are named and skipped; errors are printed, never raised.
    """
    sent = 0
    for r in found.toLocalIterator():
        if not r[chat]:
            print("no chat to notify")
            continue
        try:
            send(r[chat], r["message"], r["report"], r["report_name"])
            sent += 1
        except Exception as e:
            print(f"notification failed: {e}")
    return sent


class Engine:
    """Audits and predictions over one session; the model is loaded when first needed."""

    def __init__(self, spark: SparkSession, model_path: str | None = None, scorer: Scorer | None = None):
        self.spark, self.model_path, self._scorer = spark, model_path or setting(spark, "model"), scorer

    @property
    def scorer(self) -> Scorer | None:
        """The scorer, loaded from ``model_path`` on first use; None without a model."""
        if self._scorer is None and self.model_path:
            self._scorer = model_scorer(PipelineModel.load(self.model_path))
        return self._scorer

    def status(self) -> dict:
        """Whether the engine runs and has a model loaded."""
        return {"status": "online", "mode": "spark", "model_loaded": self._scorer is not None}

    def reload_model(self, path: str | None = None) -> dict:
        """Load the model anew, from another path if given."""
        self.model_path = path or self.model_path
        self._scorer = None
        return self.status() | {"model_loaded": self.scorer is not None}

    def audit_functions(self, files: DataFrame, id_column: str = "file_id", use_model: bool = True) -> DataFrame:
        """One row per function, with ``prediction`` (null without a model)."""
        rows = audited(files, id_column)
        if use_model and self.scorer:
            return predicted(rows, self.scorer)
        return rows.withColumn("prediction", F.lit(None).cast("struct<label:string,confidence:double,probabilities:map<string,double>>"))

    def audit(self, files: DataFrame, id_column: str = "file_id", use_model: bool = True, notify: Callable[[DataFrame], None] | None = None) -> DataFrame:
        """One row per file with its functions. ``notify`` gets the summary afterwards; its errors are reported, never raised."""
        rows = self.audit_functions(files, id_column, use_model)
        out = per_file(rows.drop("code"), id_column, "risk_score", "tags", "features", "findings", "prediction")
        if notify:
            try:
                notify(summary(rows, [], id_column, risky(F.col("risk_score"), F.col("prediction.label"))))
            except Exception as e:
                print(f"notification failed: {e}")
        return out

    def answer(self, files: DataFrame, groups: Sequence[str], id_column: str = "file_id", use_model: bool = True, notify: Notifier | None = None, chat: str = "chat_id") -> DataFrame:
        """The response to each request (``groups``); afterwards ``notify`` gets the message and report of each that has a chat.

        ``files`` has ``groups``, the identifier, ``filename``, ``title``, ``at`` (the time that reports bear), ``chat``, ``programming_language``
        and ``code``.
        """
        rows = self.audit_functions(files, id_column, use_model)
        out = batch_response(files, rows, groups, id_column)
        if notify:
            known = files.where("code is not null").select(*groups, chat, id_column, "filename", "title", "at")
            notify_all(reports(known, rows, [*groups, chat], id_column, F.col("prediction.label")), chat, notify)
        return out

    def predict(self, snippets: DataFrame) -> DataFrame:
        """``snippets`` (with ``code``) with ``prediction``; an error if there is no model."""
        if not self.scorer:
            raise RuntimeError("no model is loaded")
        return predicted(snippets, self.scorer)
