"""From scored blocks to nested audit results, summaries and Markdown."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.functions.derive import php_wrapped, rough_metrics
from siftstone.operators.audit import block_findings, scored
from siftstone.operators.segment import functions


def audited(files: DataFrame, id_column: str) -> DataFrame:
    """One row per function of each file with features, tags, findings and risk.

    Metrics are the segmenter's, and the rough ones where a file has no function. Everything after the segmentation is
    computed within the row: no shuffle, and the files are parsed once.
    """
    rows = functions(files, id_column).where("error is null")
    rough = rough_metrics(php_wrapped(F.col("code"), F.col("lang")))
    found = scored(rows.withColumn("findings", block_findings(F.col("code"), F.col("lang"), F.col("start_line"))), findings="findings")
    measured = found.withColumn("__r", F.when(~F.col("parsed"), rough))
    features = F.struct(
        F.coalesce("nloc", "__r.nloc").alias("nloc"), F.coalesce("complexity", F.col("__r.complexity").cast("double")).alias("complexity"),
        F.coalesce("token_count", "__r.token_count").alias("token_count"), F.coalesce("parameters_count", F.lit(0)).alias("parameters_count"),
        F.coalesce("top_nesting_level", F.lit(0)).alias("top_nesting_level"), F.col("n_tags").alias("suspicious_tags_count"),
    )
    return measured.select(id_column, "function_name", "start_line", "end_line", "lang", "code", "risk_score", "tags", features.alias("features"), "findings")


def per_file(blocks: DataFrame, id_column: str, *columns: str, files: DataFrame | None = None) -> DataFrame:
    """(id, total_functions, functions): a file's functions in order of their first line; none for those of ``files`` without blocks."""
    keep = columns or ("function_name", "start_line", "end_line", "risk_score", "tags", "features", "findings")
    order = ["start_line", "end_line", "function_name"]
    entry = F.struct(*order, *[c for c in keep if c not in order])
    place = lambda e: F.struct(*[e[c].alias(c) for c in order])  # noqa: E731 predictions hold maps, which have no order
    first = lambda a, b: F.when(place(a) < place(b), -1).when(place(a) > place(b), 1).otherwise(0)
    found = blocks.groupBy(id_column).agg(F.count("*").alias("total_functions"), F.array_sort(F.collect_list(entry), first).alias("functions"))
    if files is None:
        return found
    none = F.array().cast(found.schema["functions"].dataType)
    joined = files.select(id_column).join(found, id_column, "left")
    return joined.select(id_column, F.coalesce("total_functions", F.lit(0)).alias("total_functions"), F.coalesce("functions", none).alias("functions"))


def batch_response(files: DataFrame, blocks: DataFrame, groups: Sequence[str], id_column: str) -> DataFrame:
    """(groups, total_files_processed, response): the answer to each request as JSON text.

    ``files`` has ``groups``, the identifier, ``filename`` and ``code``; ``blocks`` are rows of ``audited``, perhaps with ``prediction``. All
    files are counted; those with null code, which cannot be processed, are not among the results, and one that cannot be
    parsed is there without functions. Results stand in order of the identifier.
    """
    guess = F.col("prediction") if "prediction" in blocks.columns else F.lit(None).cast("struct<label:string,confidence:double,probabilities:map<string,double>>")
    shaped = blocks.select(
        id_column, "function_name", "start_line", "end_line", "risk_score", guess.alias("codebert_prediction"), "features",
        F.transform("findings", lambda f: F.struct(f["line_no"].alias("line"), f["content"].alias("content"), f["message"].alias("message"), f["severity"].alias("severity"))).alias("findings"),
        "tags",
    )
    per = per_file(shaped, id_column, "function_name", "risk_score", "codebert_prediction", "features", "findings", "tags", files=files.where("code is not null"))
    place = "__file"
    result = F.struct(F.col(id_column).alias(place), "filename", "total_functions", "functions")
    joined = files.select(*groups, id_column, "filename").join(per, id_column, "left")
    by_place = lambda a, b: F.when(a[place] < b[place], -1).when(a[place] > b[place], 1).otherwise(0)  # noqa: E731 predictions hold maps, which have no order
    answers = joined.groupBy(*groups).agg(
        F.count("*").alias("total_files_processed"), F.array_sort(F.collect_list(F.when(F.col("functions").isNotNull(), result)), by_place).alias("__r")
    )
    results = F.transform("__r", lambda r: F.struct(r["filename"].alias("filename"), r["total_functions"].alias("total_functions"), r["functions"].alias("functions")))
    text = F.to_json(F.struct("total_files_processed", results.alias("results")), {"ignoreNullFields": "false"})
    return answers.select(*groups, "total_files_processed", text.alias("response"))


def risky(score: Column, label: Column, limit: float = 60.0, scale: float = 1.0) -> Column:
    """Whether a block is listed: its scaled risk is above the limit or its predicted label is neither Safe nor N/A."""
    return (score * scale > limit) | ~F.coalesce(label, F.lit("Safe")).isin("Safe", "N/A")


def summary(blocks: DataFrame, groups: Sequence[str], file_column: str, is_risky: Column) -> DataFrame:
    """(groups, n_files, n_functions, n_risky): totals of a report, combined map-side."""
    return blocks.groupBy(*groups).agg(F.count_distinct(file_column).alias("n_files"), F.count("*").alias("n_functions"), F.count_if(is_risky).alias("n_risky"))


def detail_line(name: Column, start: Column, end: Column, score: Column, label: Column, high: float = 80.0, scale: float = 1.0) -> Column:
    """A block's line of the Markdown report."""
    icon = F.when(score * scale > high, F.lit("🔴")).otherwise(F.lit("🟠"))
    return F.format_string("- %s **%s** (%d-%d) score %.2f, %s", icon, name, start, end, score, F.coalesce(label, F.lit("Safe")))


def function_lines(name: Column, start: Column, end: Column, score: Column, label: Column, findings: Column, high: float = 80.0, scale: float = 1.0) -> Column:
    """A risky function's lines of the report: head, score and label, and one line per finding (whose rules have no name of their own)."""
    icon = F.when(score * scale > high, F.lit("🔴")).otherwise(F.lit("🟠"))
    head = F.format_string("- %s **%s** (Líneas %d-%d)\n  - **Score:** %.2f | **IA:** %s\n", icon, name, start, end, score, F.coalesce(label, F.lit("Safe")))
    return F.concat(head, F.repeat(F.lit("  - 🔍 *Regla:* General\n"), F.coalesce(F.size(findings), F.lit(0))))


def reports(files: DataFrame, blocks: DataFrame, groups: Sequence[str], id_column: str, label: Column | None = None, scale: float = 1.0) -> DataFrame:
    """(groups, n_files, n_functions, n_risky, message, report, report_name): a chat message and the whole Markdown report of each request.

    ``files`` has ``groups``, the identifier, ``filename``, ``title`` and ``at`` (the report's time); ``blocks`` are the rows of ``audited``.
    A file without functions counts as a file. Only lines of risky functions are gathered, per file and then per request.
    """
    label = F.lit(None).cast("string") if label is None else label
    lines = function_lines(F.col("function_name"), F.col("start_line"), F.col("end_line"), F.col("risk_score"), label, F.col("findings"), scale=scale)
    listed = F.when(risky(F.col("risk_score"), label, scale=scale), F.struct("start_line", "end_line", "function_name", lines.alias("text")))
    found = blocks.select(id_column, listed.alias("__l")).groupBy(id_column).agg(
        F.count("*").alias("__n"), F.count("__l").alias("__r"), F.array_join(F.transform(F.array_sort(F.collect_list("__l")), lambda x: x["text"]), "").alias("__t")
    )
    section = F.when(F.col("__r") > 0, F.concat(F.lit("## 📂 Archivo: "), F.coalesce("filename", F.lit("unknown")), F.lit("\n"), "__t", F.lit("\n")))
    part = F.when(section.isNotNull(), F.struct(F.col(id_column).alias("id"), section.alias("text")))
    totals = (
        files.join(found, id_column, "left").groupBy(*groups).agg(
            F.count("*").alias("n_files"), F.coalesce(F.sum("__n"), F.lit(0)).alias("n_functions"), F.coalesce(F.sum("__r"), F.lit(0)).alias("n_risky"),
            F.coalesce(F.min("title"), F.lit("")).alias("__title"), F.coalesce(F.date_format(F.max("at"), "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("__at"),
            F.concat(F.lit("security_report_"), F.coalesce(F.date_format(F.max("at"), "HHmmss"), F.lit("000000")), F.lit(".md")).alias("report_name"),
            F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["text"]), "").alias("__details"),
        )
    )
    n, none = F.col("n_risky"), F.col("n_risky") == 0
    message = F.concat(
        F.format_string("🛡️ *Security Audit: %s*\n━━━━━━━━━━━━━━━━━━\n", "__title"),
        F.format_string("Estado: *%s*\n", F.when(none, F.lit("✅ APROBADO")).otherwise(F.lit("⚠️ REVISIÓN REQUERIDA"))),
        F.format_string("• Archivos: `%d`\n• Vulnerabilidades: `%d`\n", "n_files", n),
        F.when(none, F.lit("")).otherwise(F.lit("\n👇 _Ver archivo adjunto para detalles._")),
    )
    report = F.concat(
        F.format_string("# Reporte de Seguridad - %s\n**Fecha:** %s\n\n## Resumen\n", "__title", "__at"),
        F.format_string("- Total Archivos: %d\n- Total Funciones: %d\n- Hallazgos Críticos: %d\n\n--- \n", "n_files", "n_functions", n),
        F.lit("## Detalle de Vulnerabilidades\n\n"), F.when(none, F.lit("🎉 Sin vulnerabilidades detectadas.")).otherwise(F.col("__details")),
    )
    return totals.select(*groups, "n_files", "n_functions", "n_risky", message.alias("message"), report.alias("report"), "report_name")
