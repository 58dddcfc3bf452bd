"""Problem 5: rows, distinct forms, mean nloc and latest arrival per weakness label and per language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.functions.readings import form_key, weakness_label, with_language
from siftstone.operators.skew import balanced_key_stats
from siftstone.plans.sqlparts import FORM
from siftstone.sources.tables import table

#: A key is found to be hot from this share of all rows, in percent.
HOT_PERCENT = 5


def _field(name: str, value: str) -> Column:
    return F.struct(F.lit(name).alias("field_name"), F.col(value).alias("key_value"))


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field_name, key_value, form, nloc, ingested_at): each row under its label and under its language."""
    rows = table(spark, sf_dir, "dataset_ml_ready", "code", "programming_language", "cwe_id", "nloc", "ingested_at")
    read = with_language(rows, table(spark, sf_dir, "lang_alias")).select(
        weakness_label(F.col("cwe_id")).alias("label"), "language", form_key(F.col("code")).alias("form"), F.col("nloc").cast("bigint").alias("nloc"), "ingested_at"
    )
    long = read.select(F.explode(F.array(_field("cwe_id", "label"), _field("programming_language", "language"))).alias("k"), "form", "nloc", "ingested_at")
    return long.select("k.field_name", "k.key_value", "form", "nloc", "ingested_at")


def _wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field_name, key_value, target_bp): the sampling targets summed by label and by language."""
    targets = table(spark, sf_dir, "sampling_target", "cwe_label", "programming_language", "target_bp")
    keys = F.explode(F.array(_field("cwe_id", "cwe_label"), _field("programming_language", "programming_language"))).alias("k")
    return targets.select(keys, "target_bp").groupBy("k.field_name", "k.key_value").agg(F.sum("target_bp").alias("target_bp"))


def key_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each label and each language, with its sampling target (null without one) and the number of all rows."""
    total = table(spark, sf_dir, "dataset_ml_ready").count()
    stats = balanced_key_stats(_keyed(spark, sf_dir), ("field_name", "key_value"), "form", "nloc", "ingested_at", _wanted(spark, sf_dir), how="left")
    return stats.select(
        "field_name",
        "key_value",
        "n_rows",
        F.col("n_form").alias("n_forms"),
        F.round("mean_nloc", 6).alias("mean_nloc"),
        "latest_ingested_at",
        "target_bp",
        F.lit(total).cast("bigint").alias("total_rows"),
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels and languages that hold at least 5 percent of all rows."""
    return key_stats(spark, sf_dir).where(F.col("n_rows") * 100 >= F.col("total_rows") * HOT_PERCENT).select("field_name", "key_value")


def p5_key_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All keys with their results."""
    return key_stats(spark, sf_dir).drop("total_rows")


_WS = r"\t-\r\x{1C}-\x{20}\x{85}\p{Z}"
_TRIM = rf"regexp_replace(%s, '^[{_WS}]+|[{_WS}]+$', '', 'g')"
LABEL_SQL = (
    "case when {t} = '' then null when lower({t}) = 'safe' then 'Safe' when regexp_matches({t}, '[0-9]$') "
    "then 'CWE-' || regexp_replace(regexp_extract({t}, '([0-9]+)$', 1), '^0+([0-9])', '\\1') else upper({t}) end"
).format(t=_TRIM % "cwe_id")
READ_SQL = f"""read as (
  select d.*, {LABEL_SQL} as label, a.programming_language as language
  from dataset_ml_ready d left join lang_alias a on lower({_TRIM % 'd.programming_language'}) = a.alias_name)"""
LONG_SQL = f"""with {READ_SQL}, long as (
  select 'cwe_id' as field_name, label as key_value, nloc, ingested_at from read where label is not null
  union all
  select 'programming_language', language, nloc, ingested_at from read where language is not null)"""

QUERIES = {"p5_found": p5_found, "p5_key_stats": p5_key_stats}
ORACLE = {
    "p5_found": f"""{LONG_SQL}
select field_name, key_value from long group by 1, 2
having count(*) * 100 >= {HOT_PERCENT} * (select count(*) from dataset_ml_ready)""",
    "p5_key_stats": f"""with {READ_SQL}, formed as (select *, nullif({FORM}, '') as form from read), long as (
  select 'cwe_id' as field_name, label as key_value, form, nloc, ingested_at from formed where label is not null
  union all
  select 'programming_language', language, form, nloc, ingested_at from formed where language is not null),
wanted as (
  select 'cwe_id' as field_name, cwe_label as key_value, sum(target_bp)::bigint as target_bp from sampling_target group by 2
  union all
  select 'programming_language', programming_language, sum(target_bp)::bigint from sampling_target group by 2)
select field_name, key_value, count(*) as n_rows, count(distinct form) as n_forms, round(avg(nloc), 6) as mean_nloc,
  max(ingested_at) as latest_ingested_at, any_value(target_bp) as target_bp
from long left join wanted using (field_name, key_value) group by 1, 2""",
}
