"""The audit as a stream of request files: an extension, the same transformation as in batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftstone.functions.derive import language_key
from siftstone.operators.audit import scored
from siftstone.sources.requests import REQUEST, request_files


def request_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """The files of the requests that arrive in a folder as JSON lines."""
    return request_files(spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", files_per_trigger).json(path).withColumn("use_model", F.coalesce("use_model", F.lit(True))))


def scored_stream(files: DataFrame) -> DataFrame:
    """Each file as one block with tags, findings and risk; stateless."""
    return scored(files.withColumn("lang", language_key(F.col("programming_language"))))


def risk_by_window(events: DataFrame, time: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Files and mean risk per language and time window; rows later than ``late`` behind the latest are dropped by the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), "lang").agg(F.count("*").alias("n_files"), F.avg("risk_score").alias("mean_risk"))


def run(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Feed the stream to ``sink`` batch by batch until all that is there has been read."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
