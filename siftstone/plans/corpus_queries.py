"""Queries of curation and profiling, over the mined tables and the curated corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftstone.functions.derive import binary_class
from siftstone.operators import curate, profile
from siftstone.sources.tables import table

_COLUMNS = ", ".join(curate.CURATED)


def _mined(spark, d):
    return [table(spark, d, t) for t in ("method_change", "file_change", "fixes", "cwe_classification")]


def _corpus(spark, d, *columns):
    return table(spark, d, "dataset_ml_ready", *columns)


def curate_join_label(spark, d):
    """Mined functions with their label, distinct."""
    return curate.join_and_label(*_mined(spark, d))


def curate_dedup(spark, d):
    """The corpus without rows that repeat in all curated columns."""
    return _corpus(spark, d, *curate.CURATED).dropDuplicates()


def curate_conflicts(spark, d):
    """The corpus without codes that have contradictory labels."""
    return curate.without_conflicts(_corpus(spark, d, "sample_id", "code", "cwe_id")).select("sample_id", "cwe_id")


def curate_pipeline(spark, d):
    """Join, label, drop duplicates and contradictions: the curated corpus."""
    return curate.without_conflicts(curate.join_and_label(*_mined(spark, d)))


def eda_overview(spark, d):
    """Rows, labels and languages of the corpus."""
    return _corpus(spark, d, "cwe_id", "programming_language").agg(
        F.count("*").alias("n_rows"), F.count_distinct("cwe_id").alias("n_cwes"), F.count_distinct("programming_language").alias("n_languages")
    )


def eda_class_balance(spark, d):
    """Rows per binary class, with their share of all."""
    counts = profile.value_counts(_corpus(spark, d, "cwe_id").select(binary_class(F.col("cwe_id")).alias("target_class")), "target_class")
    held = profile.with_domain(counts, "target_class", ["Safe", "Vulnerable"])
    total = _corpus(spark, d, "cwe_id").agg(F.count("*")).scalar()
    return held.select("target_class", "n_rows", F.round(100 * F.col("n_rows") / total, 6).alias("pct"))


def eda_cwe_counts(spark, d):
    """Rows per label."""
    return profile.value_counts(_corpus(spark, d, "cwe_id"), "cwe_id")


def eda_language_counts(spark, d):
    """Rows per language name."""
    return profile.value_counts(_corpus(spark, d, "programming_language"), "programming_language")


def eda_top_cwe(spark, d):
    """The ten most frequent labels but Safe, with their share of all labelled rows but Safe."""
    return profile.top_values(_corpus(spark, d, "cwe_id").where("cwe_id <> 'Safe'"), "cwe_id", 10)


def eda_top_language(spark, d):
    """The ten most frequent language names, with their share of all rows."""
    rows = _corpus(spark, d, "programming_language")
    return profile.top_values(rows, "programming_language", 10, rows.agg(F.count("*")).scalar())


def eda_numeric_summary(spark, d):
    """Sums, extremes and means of the metrics."""
    return profile.numeric_summary(_corpus(spark, d, *profile.METRICS))


def _long(spark, d):
    rows = _corpus(spark, d, "sample_id", "cwe_id", *profile.METRICS).withColumn("target_class", binary_class(F.col("cwe_id")))
    return profile.long_form(rows, ["sample_id", "target_class"])


def eda_unpivot(spark, d):
    """One row per function and metric."""
    return _long(spark, d)


def eda_boxplot(spark, d):
    """Box-plot statistics per class and metric."""
    return profile.box_statistics(_long(spark, d), "target_class")


def eda_corr(spark, d):
    """Correlations of the metrics."""
    return profile.correlations(_corpus(spark, d, *profile.METRICS))


QUERIES = {
    f.__name__: f
    for f in (
        curate_join_label, curate_dedup, curate_conflicts, curate_pipeline, eda_overview, eda_class_balance, eda_cwe_counts, eda_language_counts, eda_top_cwe,
        eda_top_language, eda_numeric_summary, eda_unpivot, eda_boxplot, eda_corr,
    )
}

_JOINED = f"""joined as (
  select distinct m.code, m.parameters, f.programming_language, m.nloc, m.complexity, m.token_count, m.top_nesting_level,
    case when m.before_change = 'False' then 'Safe' else c.cwe_id end as cwe_id
  from method_change m join file_change f on f.file_change_id = m.file_change_id join fixes x on x.hash = f.hash
  left join cwe_classification c on c.cve_id = x.cve_id)"""
_BINARY = "case when cwe_id = 'Safe' then 'Safe' else 'Vulnerable' end"
_LONG = "long as (" + " union all ".join(f"select sample_id, {_BINARY} as target_class, '{m}' as metric, {m}::double as value from dataset_ml_ready" for m in profile.METRICS) + ")"
ORACLE = {
    "curate_join_label": f"with {_JOINED} select * from joined",
    "curate_dedup": f"select distinct {_COLUMNS} from dataset_ml_ready",
    "curate_conflicts": """select sample_id, cwe_id from dataset_ml_ready where code is null or code not in (
  select code from dataset_ml_ready where code is not null group by 1 having count(distinct cwe_id) > 1)""",
    "curate_pipeline": f"with {_JOINED} select * from joined where code is null or code not in (select code from joined where code is not null group by 1 having count(distinct cwe_id) > 1)",
    "eda_overview": "select count(*) as n_rows, count(distinct cwe_id) as n_cwes, count(distinct programming_language) as n_languages from dataset_ml_ready",
    "eda_class_balance": f"""select target_class, count(c) as n_rows, round(100 * count(c)::double / (select count(*) from dataset_ml_ready), 6) as pct
from (values ('Safe'), ('Vulnerable')) k(target_class) left join (select {_BINARY} as c from dataset_ml_ready) on c = target_class group by 1""",
    "eda_cwe_counts": "select cwe_id, count(*) as n_rows from dataset_ml_ready where cwe_id is not null group by 1",
    "eda_language_counts": "select programming_language, count(*) as n_rows from dataset_ml_ready where programming_language is not null group by 1",
    "eda_top_cwe": """with c as (select cwe_id, count(*) as n_rows from dataset_ml_ready where cwe_id <> 'Safe' group by 1)
select cwe_id, n_rows, round(100 * n_rows::double / (select sum(n_rows) from c), 6) as pct from c order by n_rows desc, cwe_id limit 10""",
    "eda_top_language": """with c as (select programming_language, count(*) as n_rows from dataset_ml_ready where programming_language is not null group by 1)
select programming_language, n_rows, round(100 * n_rows::double / (select count(*) from dataset_ml_ready), 6) as pct from c order by n_rows desc, programming_language limit 10""",
    "eda_numeric_summary": " union all ".join(
        f"""select '{m}' as metric, sum({m})::bigint as total, sum({m}::bigint * {m})::bigint as total_sq, min({m})::bigint as least, max({m})::bigint as most,
  round(sum({m})::double / count(*), 6) as mean_all, round(avg({m}), 6) as mean_known from dataset_ml_ready"""
        for m in profile.METRICS
    ),
    "eda_unpivot": f"with {_LONG} select * from long",
    "eda_boxplot": f"""with {_LONG}, q as (
  select target_class, metric, count(value) as n_values, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as median, quantile_cont(value, 0.75) as q3
  from long where value is not null group by 1, 2)
select q.*, min(value) as whisker_low, max(value) as whisker_high from long join q using (target_class, metric)
where value between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) group by all""",
    "eda_corr": " union all ".join(
        f"select '{a}' as metric_a, '{b}' as metric_b, round(corr({a}, {b}), 6) as r from dataset_ml_ready" for a, b in profile.combinations(profile.METRICS, 2)
    ),
}
