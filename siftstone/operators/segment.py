"""Functions of source files: where they begin and end, and their metrics.

A segmenter of our own for Python (indentation) and the brace languages (a signature before an opening brace). Its
figures approximate those of a full parser. It is the only Python stage of the audit: it yields one row per function, and
all that follows is column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.functions.derive import language_key, php_wrapped, rough_metrics

_LINE_END = re.compile("\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]")
_PY_DEF = re.compile(r"^([ \t]*)(?:async[ \t]+)?def[ \t]+(\w+)[ \t]*\(")
_RUBY_DEF = re.compile(r"^([ \t]*)def[ \t]+(?:self\.)?(\w+[?!=]?)")
_TOKEN = re.compile(r"\w+|[^\w\s]")
_BRANCH = re.compile(r"\b(?:if|elif|for|while|case|catch|except|and|or|foreach|elsif|unless|when)\b|&&|\|\||\?")
_NAMED = re.compile(r"([A-Za-z_$~][\w$:~]*)\s*$")
_ARROW = re.compile(r"(?:(?:const|let|var)\s+)?([A-Za-z_$][\w$]*)\s*[=:]\s*(?:async\s*)?(?:function\s*\w*\s*)?$")
_NOT_NAMES = frozenset("if for while switch catch return else do foreach elseif with function synchronized using lock sizeof new match".split())
_SKIP = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
_PY_SKIP = re.compile(r"\"\"\".*?\"\"\"|'''.*?'''|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|#[^\n]*", re.S)


@dataclass(frozen=True)
class Function:
    """A function of a file; lines count from 1."""

    name: str
    start_line: int
    end_line: int
    parameters: int
    complexity: int
    nloc: int
    tokens: int
    nesting: int


def _blanked(code: str, skip: re.Pattern) -> str:
    """``code`` with strings and comments overwritten by blanks, line ends kept."""
    return skip.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), code)


def _parameters(text: str) -> int:
    depth, parts, any_text = 0, 1, False
    for c in text:
        depth += (c in "([{<") - (c in ")]}>")
        any_text |= not c.isspace()
        parts += c == "," and depth == 0
    return parts if any_text and text.strip() != "void" else 0


def _closing(text: str, at: int, pair: str) -> int:
    depth = 0
    for m in re.compile(f"[{re.escape(pair)}]").finditer(text, at):
        depth += 1 if m.group() == pair[0] else -1
        if depth == 0:
            return m.start()
    return -1


def _measured(name: str, first: int, last: int, parameters: int, lines: list[str], clean: list[str], nesting: int) -> Function:
    own, bare = lines[first - 1 : last], clean[first - 1 : last]
    text = "\n".join(bare)
    return Function(name, first, last, parameters, 1 + len(_BRANCH.findall(text)), sum(1 for x in bare if x.strip()), len(_TOKEN.findall("\n".join(own))), nesting)


def _indented(code: str, head: re.Pattern) -> list[Function]:
    lines, clean = code.split("\n"), _blanked(code, _PY_SKIP).split("\n")
    found, offset = [], 0
    joined = "\n".join(clean)
    for k, line in enumerate(clean):
        m = head.match(line)
        if m:
            indent = len(m.group(1).expandtabs())
            opened = joined.find("(", offset + m.end(2))
            close = _closing(joined, opened, "()") if 0 <= opened and head is _PY_DEF else -1
            body = k + (joined.count("\n", offset, close) if close > 0 else 0)
            last, depths = body, []
            for j in range(body + 1, len(clean)):
                if not clean[j].strip():
                    continue
                depth = len(clean[j].expandtabs()) - len(clean[j].expandtabs().lstrip())
                if depth <= indent and not (head is _RUBY_DEF and clean[j].strip() == "end" and depth == indent):
                    break
                last = j
                depths.append(depth)
                if head is _RUBY_DEF and depth == indent:
                    break
            number = _parameters(joined[opened + 1 : close]) if close > 0 else 0
            found.append(_measured(m.group(2), k + 1, last + 1, number, lines, clean, max(0, len(set(depths)) - 1)))
        offset += len(line) + 1
    return found


def _braced(code: str) -> list[Function]:
    clean = _blanked(code, _SKIP)
    lines, bare = code.split("\n"), clean.split("\n")
    found, at, inside = [], 0, -1
    while (brace := clean.find("{", at)) >= 0:
        at = brace + 1
        if brace < inside:
            continue
        head_from = max(clean.rfind(c, 0, brace) for c in ";{}") + 1
        head = clean[head_from:brace]
        arrow = head.rstrip().endswith("=>")
        close = head.rfind(")")
        opened, depth = -1, 0
        for k in range(close, -1, -1):
            depth += (head[k] == ")") - (head[k] == "(")
            if depth == 0:
                opened = k
                break
        if close < 0 or opened < 0:
            continue
        before = head[:opened]
        m = (_ARROW.search(before) if arrow or before.rstrip().endswith("function") else None) or _NAMED.search(before)
        if not m or m.group(1) in _NOT_NAMES or re.search(r"\bnew\s+$", before[: m.start()]):
            continue
        end = _closing(clean, brace, "{}")
        if end < 0:
            continue
        start = head_from + len(head) - len(head.lstrip())
        depth = most = 0
        for c in clean[brace:end]:
            depth += (c == "{") - (c == "}")
            most = max(most, depth)
        first, last = clean.count("\n", 0, start) + 1, clean.count("\n", 0, end) + 1
        found.append(_measured(m.group(1), first, last, _parameters(head[opened + 1 : close]), lines, bare, max(0, most - 1)))
        inside = end
    return found


def functions_of(code: str, language: str) -> list[Function]:
    """The functions of a file in the order they begin; none for languages without a segmenter."""
    text = _LINE_END.sub("\n", code)
    if language in ("python", "py"):
        return _indented(text, _PY_DEF)
    if language in ("ruby", "rb"):
        return _indented(text, _RUBY_DEF)
    if language in ("shell", "sh", "bash", "sql", "html", "css", "tex", "markdown"):
        return []
    return _braced(text)


_SCHEMA = (
    "function_name string, start_line int, end_line int, parsed boolean, nloc bigint, complexity double, token_count bigint, parameters_count bigint, "
    "top_nesting_level bigint, code string, error string"
)


def functions(files: DataFrame, id_column: str, language: str = "programming_language", code: str = "code") -> DataFrame:
    """One row per function of each file, the whole file as ``main_script`` where it has none.

    Null code has no row. A file whose segmentation fails has one row with ``error`` set and null code, so one bad file never
    ends a job. ``lang`` is the language key.
    """
    kind = files.schema[id_column].dataType.simpleString()
    picked = files.where(F.col(code).isNotNull()).select(F.col(id_column).alias("id"), language_key(F.col(language)).alias("lang"), F.col(code).alias("code"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, lang, text in zip(batch["id"], batch["lang"], batch["code"]):
                try:
                    lines = _LINE_END.split(text)
                    found = functions_of(text, lang)
                    if not found:
                        count = len(lines) - (lines[-1] == "")
                        rows.append((key, lang, "main_script", 1, count, False, None, None, None, None, None, text, None))
                    for f in found:
                        piece = "\n".join(lines[f.start_line - 1 : f.end_line])
                        rows.append((key, lang, f.name, f.start_line, f.end_line, True, f.nloc, float(f.complexity), f.tokens, f.parameters, f.nesting, piece, None))
                except Exception as e:  # one file's failure must not be the job's
                    rows.append((key, lang, None, None, None, False, None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(rows, columns=names).astype(dtypes)

    names = ["id", "lang", *[c.split()[0] for c in _SCHEMA.split(", ")]]
    dtypes = {c: "Int64" for c in ("start_line", "end_line", "nloc", "token_count", "parameters_count", "top_nesting_level")}
    return picked.mapInPandas(run, f"id {kind}, lang string, {_SCHEMA}").withColumnRenamed("id", id_column)


def measures_of(code: str, language: str) -> tuple[int, float, int, int, int]:
    """(nloc, mean complexity, tokens, parameters, deepest nesting) of a file; complexity 1 where it has no function."""
    text, found = _LINE_END.sub("\n", code), functions_of(code, language)
    clean = _blanked(text, _PY_SKIP if language in ("python", "py", "ruby", "rb") else _SKIP)
    complexity = sum(f.complexity for f in found) / len(found) if found else 1.0
    nloc = sum(1 for x in clean.split("\n") if x.strip())
    return nloc, complexity, len(_TOKEN.findall(text)), sum(f.parameters for f in found), max((f.nesting for f in found), default=0)


def file_metrics(files: DataFrame, id_column: str, measure: Callable[[str, str], tuple] = measures_of) -> DataFrame:
    """(id, nloc, complexity, token_count, parameters_count, top_nesting_level, method): each file parsed, PHP between tags.

    Rough metrics, without parameters and nesting, where ``measure`` fails or finds more than 10 lines and complexity 0. Null code has no row.
    """
    kind, lang = files.schema[id_column].dataType.simpleString(), language_key(F.col("programming_language"))
    picked = files.where("code is not null").select(F.col(id_column).alias("id"), lang.alias("lang"), php_wrapped(F.col("code"), lang).alias("code"))
    measured = "nloc bigint, complexity double, token_count bigint, parameters_count bigint, top_nesting_level bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, language, text in zip(batch["id"], batch["lang"], batch["code"]):
                try:
                    got = measure(text, language)
                    if got[0] > 10 and got[1] == 0:
                        raise ValueError("no complexity")
                    rows.append((key, *got, None))
                except Exception:  # one file's failure must not be the job's
                    rows.append((key, None, None, None, None, None, text))
            yield pd.DataFrame(rows, columns=names).astype(dtypes)

    names = ["id", *[c.split()[0] for c in measured.split(", ")], "code"]
    dtypes = {c: "Int64" for c in ("nloc", "token_count", "parameters_count", "top_nesting_level")}
    rows = picked.mapInPandas(run, f"id {kind}, {measured}, code string").withColumn("r", F.when(F.col("code").isNotNull(), rough_metrics(F.col("code"))))
    return rows.select(
        F.col("id").alias(id_column), F.coalesce("nloc", "r.nloc").alias("nloc"), F.coalesce("complexity", F.col("r.complexity").cast("double")).alias("complexity"),
        F.coalesce("token_count", "r.token_count").alias("token_count"), F.coalesce("parameters_count", F.lit(0)).alias("parameters_count"),
        F.coalesce("top_nesting_level", F.lit(0)).alias("top_nesting_level"), F.when(F.col("code").isNull(), "parser").otherwise("rough").alias("method"),
    )
