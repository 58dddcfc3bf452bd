"""Audit requests as JSON, CSV exports with the reference formats' quirks, and the cache of windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUEST = "pr_title string, chat_id string, use_model boolean, files array<struct<filename: string, programming_language: string, code: string>>"
CORPUS = "code string, parameters string, programming_language string, nloc int, complexity double, token_count int, top_nesting_level int, cwe_id string"
#: Texts a CSV export has in place of nulls. Fixed values.
NULL_TEXTS = ("", "None", "null", "NULL", "NA", "N/A", "n/a", "nan", "NaN", "#N/A", "<NA>")


def requests(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Requests of a JSON file or folder; missing ``use_model`` reads true."""
    return spark.read.schema(REQUEST).option("multiLine", multi_line).json(path).withColumn("use_model", F.coalesce("use_model", F.lit(True)))


def request_files(df: DataFrame) -> DataFrame:
    """One row per file of each request."""
    return df.select("pr_title", "use_model", F.posexplode("files").alias("file_no", "f")).select("pr_title", "use_model", "file_no", "f.*")


def corpus_csv(spark: SparkSession, path: str, schema: str = CORPUS) -> DataFrame:
    """A CSV export whose code holds line ends and quotes; the texts that stand for nulls become null."""
    df = spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    return df.select(*[F.when(~F.col(c).isin(*NULL_TEXTS), F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def write_corpus_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write such an export; ``append`` adds to it."""
    df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').csv(path)


def jdbc_table(spark: SparkSession, url: str, name: str, column: str | None = None, parts: int = 8, lower: int = 0, upper: int = 1) -> DataFrame:
    """A table of a relational database, read in ``parts`` ranges of ``column`` if given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name)
    if column:
        reader = reader.option("partitionColumn", column).option("numPartitions", parts).option("lowerBound", lower).option("upperBound", upper)
    return reader.load()


def write_cache(df: DataFrame, path: str, parts: int = 40) -> None:
    """Write a cache of windows as ``parts`` files, replacing an old one."""
    df.repartition(parts).write.mode("overwrite").parquet(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """A cache folder or a single file of one."""
    return spark.read.parquet(path)
