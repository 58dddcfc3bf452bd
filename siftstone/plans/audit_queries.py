"""Queries of the audit core and of row-wise derivations, over the files of audit requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.functions.derive import (
    default_filename, label_id, language_id, language_key, metric_language, parameter_count, php_wrapped, rough_metrics, rule_language,
)
from siftstone.functions.text import split_lines
from siftstone.operators import audit, report, segment
from siftstone.operators.augment import preserved
from siftstone.operators.sampling import decoded
from siftstone.operators.windows import code_tokens
from siftstone.plans import sqlparts as S
from siftstone.sources.tables import table


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files as blocks: payload_id, pr_id, filename, lang, code; null code has none."""
    df = table(spark, sf_dir, "code_payload", "payload_id", "pr_id", "filename", "programming_language", "code")
    return df.where("code is not null").select("payload_id", "pr_id", "filename", language_key(F.col("programming_language")).alias("lang"), "code")


ID = ["payload_id"]


def static_rules(spark, d):
    """Rule findings per line."""
    return audit.static_rules(blocks(spark, d), ID)


def indicator_scan(spark, d):
    """Indicator words per line."""
    return audit.indicator_scan(blocks(spark, d), ID)


def risk_score(spark, d):
    """Tags, findings and risk of each file as one block."""
    return audit.scored(blocks(spark, d)).select("payload_id", "lang", F.array_join("tags", " ").alias("tags"), "n_tags", "n_findings", "risk_score")


def findings_by_severity(spark, d):
    """Findings per severity."""
    return static_rules(spark, d).groupBy("severity").agg(F.count("*").alias("n_findings"))


def fallback_metrics(spark, d):
    """Rough metrics of each file."""
    rough = rough_metrics(php_wrapped(F.col("code"), F.col("lang")))
    return blocks(spark, d).select("payload_id", rough.alias("m")).select("payload_id", "m.*")


def file_metrics(spark, d):
    """Mean complexity, parameters and deepest nesting of the mined functions of a file; of parsed files: ``file_metrics_parsed``."""
    rows = table(spark, d, "method_change", "file_change_id", "complexity", "parameters", "top_nesting_level")
    return rows.groupBy("file_change_id").agg(
        F.count("*").alias("n_functions"),
        F.round(F.coalesce(F.avg("complexity"), F.lit(1.0)), 6).alias("complexity"),
        F.sum(parameter_count(F.col("parameters"))).alias("parameters_count"),
        F.greatest(F.lit(0), F.coalesce(F.max("top_nesting_level"), F.lit(0))).cast("bigint").alias("top_nesting_level"),
    )


def file_metrics_parsed(spark, d):
    """Metrics of each file by parsing it, rough ones where that fails."""
    return segment.file_metrics(table(spark, d, "code_payload", "payload_id", "programming_language", "code"), "payload_id")


def line_slicing(spark, d):
    """Lines 2 to 6 of each file, and how many lines it has."""
    lines = split_lines(F.col("code"))
    return blocks(spark, d).select("payload_id", F.size(lines).cast("bigint").alias("n_lines"), F.array_join(F.slice(lines, 2, 5), "\n").alias("piece"))


def audit_functions(spark, d):
    """Functions of each file with features, tags, findings and risk."""
    files = table(spark, d, "code_payload", "payload_id", "programming_language", "code")
    return report.audited(files, "payload_id").drop("code")


def audit_blocks(spark, d):
    """Per request: its files as blocks, their tags and findings and the highest risk."""
    rows = audit.scored(blocks(spark, d))
    return rows.groupBy("pr_id").agg(
        F.count("*").alias("n_files"), F.sum("n_tags").alias("n_tags"), F.sum("n_findings").alias("n_findings"), F.max("risk_score").alias("top_risk")
    )


def audit_files(spark, d):
    """Per file: number and list of its functions."""
    files = table(spark, d, "code_payload", "payload_id", "code").where("code is not null")
    return report.per_file(audit_functions(spark, d), "payload_id", files=files)


def audit_batch_json(spark, d):
    """Per request: the number of its files, and the response as JSON text."""
    files = table(spark, d, "code_payload", "payload_id", "pr_id", "filename", "code")
    return report.batch_response(files, audit_functions(spark, d), ["pr_id"], "payload_id")


def report_summary(spark, d):
    """Per request: files, and files above the risk limit (scaled to 100), each as one block; by function: ``report_text``."""
    rows = audit.scored(blocks(spark, d))
    return report.summary(rows, ["pr_id"], "payload_id", report.risky(F.col("risk_score"), F.lit(None).cast("string"), scale=100.0))


def report_detail(spark, d):
    """A line of each risky file as one block; by function: ``report_functions``."""
    rows = audit.scored(blocks(spark, d)).where(report.risky(F.col("risk_score"), F.lit(None).cast("string"), scale=100.0))
    line = report.detail_line(F.coalesce("filename", F.lit("main_script")), F.lit(1), F.size(F.split("code", "\n", -1)), F.col("risk_score"), F.lit(None).cast("string"), scale=100.0)
    return rows.select("pr_id", "payload_id", line.alias("line"))


def report_functions(spark, d):
    """The report's lines of each risky function."""
    rows = audit_functions(spark, d).where(report.risky(F.col("risk_score"), F.lit(None).cast("string"), scale=100.0))
    lines = report.function_lines(*[F.col(c) for c in ("function_name", "start_line", "end_line", "risk_score")], F.lit(None).cast("string"), F.col("findings"), scale=100.0)
    files = table(spark, d, "code_payload", "payload_id", "pr_id")
    return files.join(rows.select("payload_id", "function_name", "start_line", "end_line", lines.alias("lines")), "payload_id")


def report_text(spark, d):
    """Per request: files, functions, risky functions (scaled to 100), the chat message and the Markdown report, dated by its last file."""
    files = table(spark, d, "code_payload", "payload_id", "pr_id", "pr_title", "filename", "code", "received_at").where("code is not null").drop("code")
    named = files.withColumnsRenamed({"pr_title": "title", "received_at": "at"})
    return report.reports(named, audit_functions(spark, d), ["pr_id"], "payload_id", scale=100.0)


def lang_normalise(spark, d):
    """Language keys, the language whose rules hold and the metrics' name."""
    rows = table(spark, d, "dataset_ml_ready", "programming_language").groupBy("programming_language").agg(F.count("*").alias("n_rows"))
    keyed = rows.withColumn("lang", language_key(F.col("programming_language")))
    return keyed.select("programming_language", "lang", rule_language(F.col("lang")).alias("rule_lang"), metric_language(F.col("lang")).alias("metric_lang"), "n_rows")


def lang_id(spark, d):
    """Language ids."""
    return table(spark, d, "dataset_ml_ready", "sample_id", "programming_language").select("sample_id", language_id(F.col("programming_language")).cast("bigint").alias("lang_id"))


def filename_default(spark, d):
    """File names with an extension."""
    return blocks(spark, d).select("payload_id", default_filename(F.col("filename"), F.col("lang")).alias("filename"))


def php_wrap(spark, d):
    """PHP code between tags, as length and digest."""
    code = php_wrapped(F.col("code"), F.col("lang"))
    return blocks(spark, d).select("payload_id", F.length(code).cast("bigint").alias("n_chars"), F.md5(code).alias("digest"))


def parameters_count(spark, d):
    """Parameters of each function."""
    return table(spark, d, "dataset_ml_ready", "sample_id", "parameters").select("sample_id", parameter_count(F.col("parameters")).alias("parameters_count"))


def label_encode(spark, d):
    """Label ids of rows with code."""
    rows = table(spark, d, "dataset_ml_ready", "sample_id", "code", "cwe_id").where("code is not null")
    return rows.select("sample_id", "cwe_id", label_id(F.col("cwe_id")).cast("bigint").alias("label_id"))


def label_decode(spark, d):
    """Names of the label ids."""
    return decoded(label_encode(spark, d)).groupBy("label_id", "label_name").agg(F.count("*").alias("n_rows"))


def code_token_counts(spark, d, source=blocks):
    """Surrogate tokens of each file."""
    tokens = code_tokens(F.col("code"))
    return source(spark, d).select("payload_id", F.size(tokens).cast("bigint").alias("n_tokens"), F.md5(F.array_join(tokens, " ")).alias("digest"))


def preserved_tokens(spark, d, source=blocks):
    """How often each word that augmentation keeps occurs."""
    tokens = source(spark, d).select(F.explode(code_tokens(F.col("code"))).alias("token"))
    return tokens.where(preserved(F.col("token"))).groupBy(F.lower("token").alias("token")).agg(F.count("*").alias("n_uses"))


def scan_projection(spark, d):
    """Two columns of the corpus: only these are read."""
    return table(spark, d, "dataset_ml_ready", "sample_id", "cwe_id")


QUERIES = {
    f.__name__: f
    for f in (
        static_rules, indicator_scan, risk_score, findings_by_severity, fallback_metrics, file_metrics, file_metrics_parsed, line_slicing, audit_functions, audit_blocks, audit_files,
        audit_batch_json, report_summary, report_detail, report_functions, report_text, lang_normalise, lang_id, filename_default, php_wrap, parameters_count, label_encode, label_decode,
        preserved_tokens, scan_projection,
    )
} | {"code_tokens": code_token_counts}

_PHP = "case when contains(lang, 'php') and not contains(code, '<?') then '<?php' || chr(10) || code || chr(10) || '?>' else code end"
_TOKENS = rf"regexp_extract_all(code, '[a-zA-Z_][a-zA-Z0-9_]*|[^{S.WS}]')"
_PARAMETERS = """case when parameters is null then 0 else len(regexp_extract_all(parameters, '''[^'']*''|"[^"]*"')) end"""
_LS = S.SPLIT_LINES.format("code")
ORACLE = {
    "static_rules": f"with {S.RULES}, {S.BLOCKS}, {S.LINES}, {S.FINDINGS} select * from findings",
    "findings_by_severity": f"with {S.RULES}, {S.BLOCKS}, {S.LINES}, {S.FINDINGS} select severity, count(*) as n_findings from findings group by 1",
    "indicator_scan": f"""with {S.BLOCKS}, {S.LINES}
select payload_id, line_no, token, {S.strip('line')} as content from (
  select payload_id, line_no, line, unnest(list_filter(list_distinct({S.words('line')}), lambda t: list_contains({S.INDICATORS}, t))) as token from lines)""",
    "risk_score": f"{S.AUDIT} select payload_id, lang, array_to_string(tags, ' ') as tags, n_tags, n_findings, risk_score from risks",
    "fallback_metrics": f"""with {S.BLOCKS}, wrapped as (select payload_id, {_PHP} as code from blocks)
select payload_id, len(list_filter({_LS}, lambda x: regexp_matches(x, '[^{S.WS}]'))) as nloc,
  len(regexp_extract_all(code, '[{S.WORD}]+|[^{S.WORD}{S.WS}]')) as token_count,
  len(list_filter(regexp_extract_all(code, '[{S.WORD}]+'), lambda w: w in ('if', 'for', 'while', 'case', 'catch', 'elif')))
    + len(regexp_extract_all(code, '\\?|&&|\\|\\|')) + 1 as complexity from wrapped""",
    "file_metrics": f"""select file_change_id, count(*) as n_functions, round(coalesce(avg(complexity), 1.0), 6) as complexity,
  sum({_PARAMETERS})::bigint as parameters_count, greatest(0, coalesce(max(top_nesting_level), 0))::bigint as top_nesting_level from method_change group by 1""",
    "line_slicing": f"""with {S.BLOCKS}, cut as (select payload_id, {_LS} as ls from blocks),
whole as (select payload_id, case when ls[-1] = '' then ls[1:len(ls) - 1] else ls end as ls from cut)
select payload_id, len(ls) as n_lines, array_to_string(ls[2:6], chr(10)) as piece from whole""",
    "audit_blocks": f"""{S.AUDIT} select pr_id, count(*) as n_files, sum(n_tags)::bigint as n_tags, sum(n_findings)::bigint as n_findings,
  max(risk_score) as top_risk from risks group by 1""",
    "report_summary": f"""{S.AUDIT} select pr_id, count(distinct payload_id) as n_files, count(*) as n_functions,
  count(*) filter (where risk_score * 100 > 60) as n_risky from risks group by 1""",
    "report_detail": f"""{S.AUDIT} select pr_id, payload_id, format('- {{}} **{{}}** (1-{{}}) score {{:.2f}}, Safe',
  case when risk_score * 100 > 80 then '🔴' else '🟠' end, coalesce(filename, 'main_script'), len(string_split(code, chr(10))), risk_score) as line
from risks where risk_score * 100 > 60""",
    "lang_normalise": f"""with held as (select programming_language, {S.LANG_KEY} as lang, count(*) as n_rows from dataset_ml_ready group by 1, 2)
select programming_language, lang, {S.RULE_LANG.format('lang')} as rule_lang, {S.METRIC_LANG} as metric_lang, n_rows from held""",
    "lang_id": f"select sample_id, ({S.LANG_ID})::bigint as lang_id from dataset_ml_ready",
    "filename_default": f"""with {S.BLOCKS} select payload_id, case when filename is null or filename = 'unknown' or not contains(filename, '.')
  then 'virtual_file' || {S.EXTENSION} else filename end as filename from blocks""",
    "php_wrap": f"with {S.BLOCKS}, wrapped as (select payload_id, {_PHP} as code from blocks) select payload_id, length(code) as n_chars, md5(code) as digest from wrapped",
    "parameters_count": f"select sample_id, ({_PARAMETERS})::bigint as parameters_count from dataset_ml_ready",
    "label_encode": f"select sample_id, cwe_id, ({S.LABEL_ID})::bigint as label_id from dataset_ml_ready where code is not null",
    "label_decode": f"""with l as (select ({S.LABEL_ID})::bigint as label_id from dataset_ml_ready where code is not null)
select label_id, (['Safe', 'CWE-79', 'CWE-89', 'CWE-78', 'CWE-22', 'CWE-434', 'CWE-352', 'Other'])[label_id + 1] as label_name, count(*) as n_rows from l group by 1, 2""",
    "code_tokens": f"with {S.BLOCKS} select payload_id, len({_TOKENS}) as n_tokens, md5(array_to_string({_TOKENS}, ' ')) as digest from blocks",
    "preserved_tokens": f"""with {S.BLOCKS}, t as (select unnest({_TOKENS}) as token from blocks)
select lower(token) as token, count(*) as n_uses from t where list_contains({S.PRESERVED}, lower(token)) group by 1""",
    "scan_projection": "select sample_id, cwe_id from dataset_ml_ready",
}
