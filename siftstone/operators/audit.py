"""Static audit of code blocks: rule findings and indicator words per line, and the risk they make up.

A block is a row with an identifier, a language key and code. Only identifier and line travel through the
explosion of lines; all matching is literal patterns and array intersections in generated code.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.functions.derive import rule_language
from siftstone.functions.dictionaries import STATIC_RULES, indicators
from siftstone.functions.text import raw_lines, strip, words

TAG_WEIGHT, FINDING_WEIGHT = 0.15, 0.4


def _lines(blocks: DataFrame, ids: Sequence[str], first_line: Column, *keep: Column) -> DataFrame:
    return blocks.where("code is not null").select(*ids, first_line.alias("__first"), *keep, F.posexplode(raw_lines(F.col("code"))).alias("__at", "line")).withColumn(
        "line_no", (F.col("__first") + F.col("__at")).cast("bigint")
    )


def static_rules(blocks: DataFrame, ids: Sequence[str] = ("id",), first_line: Column | None = None) -> DataFrame:
    """(ids, line_no, content, message, severity): one row per line and rule of the block's language that matches it.

    ``blocks`` has ``ids``, ``lang`` (a language key) and ``code``; lines count from ``first_line`` (1). Null code and
    languages without rules have no findings.
    """
    rows = _lines(blocks, ids, F.lit(1) if first_line is None else first_line, rule_language(F.col("lang")).alias("lang"))
    hits = [
        F.when((F.col("lang") == lang) & F.col("line").rlike(pattern), F.struct(F.lit(message).alias("message"), F.lit(severity).alias("severity")))
        for lang, pattern, message, severity in STATIC_RULES
    ]
    known = rows.where(F.col("lang").isin(sorted({r[0] for r in STATIC_RULES})))
    found = known.select(*ids, "line_no", F.substring(strip(F.col("line")), 1, 80).alias("content"), F.explode(F.array_compact(F.array(*hits))).alias("hit"))
    return found.select(*ids, "line_no", "content", "hit.message", "hit.severity")


def indicator_scan(blocks: DataFrame, ids: Sequence[str] = ("id",), first_line: Column | None = None, vocabulary: Sequence[str] | None = None) -> DataFrame:
    """(ids, line_no, token, content): one row per line and indicator word in it. Null code has none."""
    known = F.array(*[F.lit(w) for w in (indicators() if vocabulary is None else vocabulary)])
    rows = _lines(blocks, ids, F.lit(1) if first_line is None else first_line)
    return rows.select(*ids, "line_no", strip(F.col("line")).alias("content"), F.explode(F.array_intersect(words(F.col("line")), known)).alias("token")).select(
        *ids, "line_no", "token", "content"
    )


def risk(n_tags: Column, n_findings: Column) -> Column:
    """Risk between 0 and 1 from the number of different indicator words and of findings."""
    return F.least(n_tags * F.lit(TAG_WEIGHT) + n_findings * F.lit(FINDING_WEIGHT), F.lit(1.0))


def block_tags(code: Column, vocabulary: Sequence[str] | None = None) -> Column:
    """The different indicator words of a block, sorted. Words never cross lines, so the block is scanned as one."""
    known = F.array(*[F.lit(w) for w in (indicators() if vocabulary is None else vocabulary)])
    return F.array_sort(F.array_intersect(words(code), known))


def finding_count(code: Column, lang: Column) -> Column:
    """How many (line, rule) pairs match, without a row per line."""
    key = rule_language(lang)
    lines = raw_lines(code)
    total = F.lit(0)
    for name, pattern, _, _ in STATIC_RULES:
        total = total + F.when(key == name, _matching(lines, pattern)).otherwise(0)
    return F.coalesce(total, F.lit(0)).cast("bigint")


def _matching(lines: Column, pattern: str) -> Column:
    return F.size(F.filter(lines, lambda x: x.rlike(pattern)))


def block_findings(code: Column, lang: Column, first_line: Column) -> Column:
    """The findings of a block as a sorted array of struct(line_no, severity, message, content); empty for null code."""
    key = rule_language(lang)
    lines = raw_lines(code)
    none = F.array().cast("array<struct<line_no:bigint,severity:string,message:string,content:string>>")

    def of(pattern: str, message: str, severity: str) -> Column:
        numbered = F.transform(lines, lambda x, i: F.struct((first_line + i).cast("bigint").alias("n"), x.alias("x")))
        hits = F.filter(numbered, lambda s: s["x"].rlike(pattern))
        return F.transform(
            hits, lambda s: F.struct(s["n"].alias("line_no"), F.lit(severity).alias("severity"), F.lit(message).alias("message"), F.substring(strip(s["x"]), 1, 80).alias("content"))
        )

    parts = [F.when((key == name) & code.rlike(pattern), of(pattern, message, severity)).otherwise(none) for name, pattern, message, severity in STATIC_RULES]
    return F.array_sort(F.flatten(F.array(*parts)))


def scored(blocks: DataFrame, vocabulary: Sequence[str] | None = None, findings: str | None = None) -> DataFrame:
    """``blocks`` with ``tags``, ``n_tags``, ``n_findings`` and ``risk_score``; no shuffle. Null code scores 0.

    With ``findings``, the column that holds each block's, the rules are not searched again.
    """
    count = finding_count(F.col("code"), F.col("lang")) if findings is None else F.size(findings).cast("bigint")
    tags = F.coalesce(block_tags(F.col("code"), vocabulary), F.array().cast("array<string>"))
    return (
        blocks.withColumn("tags", tags)
        .withColumn("n_tags", F.size("tags").cast("bigint"))
        .withColumn("n_findings", count)
        .withColumn("risk_score", risk(F.col("n_tags"), F.col("n_findings")))
    )
