"""Corpus curation: joining and labelling mined functions, exact duplicates, contradictory labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CURATED = ("code", "parameters", "programming_language", "nloc", "complexity", "token_count", "top_nesting_level", "cwe_id")


def join_and_label(method_change: DataFrame, file_change: DataFrame, fixes: DataFrame, cwe_classification: DataFrame) -> DataFrame:
    """The distinct curated rows: a method joined over its file and fix to the weakness, ``Safe`` after the fix.

    Repeated rows of the three small-keyed sides are dropped before the joins, so they do not multiply; a fix without
    classification keeps a null label. Null keys join nothing.
    """
    files = file_change.select("file_change_id", "programming_language", "hash").distinct()
    labels = fixes.select("hash", "cve_id").distinct().join(cwe_classification.select("cve_id", "cwe_id").distinct(), "cve_id", "left")
    per_file = files.join(labels, "hash").select("file_change_id", "programming_language", "cwe_id").distinct()
    label = F.when(F.col("before_change") == "False", F.lit("Safe")).otherwise(F.col("cwe_id"))
    return method_change.join(per_file, "file_change_id").withColumn("cwe_id", label).select(*CURATED).distinct()


def code_key(code: Column) -> Column:
    """128 bits that stand for a code in shuffles; null for null."""
    return F.unhex(F.md5(code))


def contradictory(df: DataFrame, code: str = "code", label: str = "cwe_id") -> DataFrame:
    """The keys of codes with more than one label, null labels not counted.

    Smallest and largest label differ exactly then, so one map-side combined aggregation does.
    """
    found = df.where(F.col(code).isNotNull()).groupBy(code_key(F.col(code)).alias("__key")).agg(F.min(label).alias("__a"), F.max(label).alias("__b"))
    return found.where("__a <> __b").select("__key")


def without_conflicts(df: DataFrame, code: str = "code", label: str = "cwe_id") -> DataFrame:
    """``df`` without the rows of contradictory codes; rows with null code stay."""
    return df.withColumn("__key", code_key(F.col(code))).join(contradictory(df, code, label), "__key", "left_anti").drop("__key")
