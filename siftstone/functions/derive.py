"""Row-wise derivations: labels, languages, file names, parameters and heuristic metrics."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftstone.functions.dictionaries import EXTENSIONS, LABEL_NAMES, LANGUAGE_NAMES, METRIC_LANGUAGES, TOP_CWES
from siftstone.functions.text import WORD, WS, nonblank, split_lines, strip


def literal_map(entries: dict) -> Column:
    """A constant map column."""
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(entries.items())])


def label_id(cwe: Column) -> Column:
    """0 for Safe, 1 to 6 for the top weaknesses, 7 for all else and for null."""
    ids = {"Safe": 0} | {c: i + 1 for i, c in enumerate(TOP_CWES)}
    return F.coalesce(F.try_element_at(literal_map(ids), cwe), F.lit(len(ids)))


def label_name(label: Column) -> Column:
    """The name of a label id, null if there is none."""
    return F.try_element_at(F.array(*[F.lit(x) for x in LABEL_NAMES]), (label + 1).cast("int"))


def binary_class(cwe: Column) -> Column:
    """Safe, or Vulnerable for everything else, null included."""
    return F.when(cwe.eqNullSafe(F.lit("Safe")), F.lit("Safe")).otherwise(F.lit("Vulnerable"))


def language_key(language: Column) -> Column:
    """A language name in lower case without outer white space; null reads ``none``."""
    return strip(F.lower(F.coalesce(language, F.lit("None"))))


def rule_language(key: Column) -> Column:
    """The language whose rules hold for ``key``."""
    return F.when(key.isin("js", "ts", "typescript"), "javascript").when(key.isin("c++", "cpp"), "c").otherwise(key)


def metric_language(key: Column) -> Column:
    """The metrics' name of a language key, null if unknown."""
    return F.try_element_at(literal_map(METRIC_LANGUAGES), key)


def language_id(language: Column) -> Column:
    """The position of an exact language name, the number of names for any other and null."""
    ids = {name: i for i, name in enumerate(LANGUAGE_NAMES)}
    return F.coalesce(F.try_element_at(literal_map(ids), language), F.lit(len(ids)))


def default_filename(filename: Column, key: Column) -> Column:
    """``filename``, or a made-up one with the language's extension where it has none; null has none."""
    made = F.concat(F.lit("virtual_file"), F.coalesce(F.try_element_at(literal_map(EXTENSIONS), key), F.lit(".txt")))
    return F.when(filename.isNull() | (filename == "unknown") | ~filename.contains("."), made).otherwise(filename)


def php_wrapped(code: Column, key: Column) -> Column:
    """PHP code without an opening tag, put between tags; other code as it is."""
    bare = key.contains("php") & ~code.contains("<?")
    return F.when(bare, F.concat(F.lit("<?php\n"), code, F.lit("\n?>"))).otherwise(code)


_QUOTED = r"""'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*\""""


def _entries(text: Column) -> Column:
    """Entries at the top level of a bracketed literal without quoted text; null where the brackets do not match.

    One pass over the characters: the depth, the commas at depth 1, and whether anything but blanks has come since the last one.
    """
    chars = F.split(strip(text), "")

    def step(at: Column, c: Column) -> Column:
        depth = at["depth"] + F.when(c.isin("(", "[", "{"), 1).when(c.isin(")", "]", "}"), -1).otherwise(0)
        comma = (c == ",") & (at["depth"] == 1)
        blank = c.rlike(f"^[{WS}]*$") | ((at["depth"] == 0) & (depth == 1)) | (depth == 0)
        return F.struct(
            depth.alias("depth"), F.when(comma, at["done"] + 1).otherwise(at["done"]).cast("bigint").alias("done"),
            F.when(comma, False).otherwise(at["open"] | ~blank).alias("open"), (at["ended"] | ((at["depth"] > 0) & (depth == 0))).alias("ended"),
            (at["bad"] | (depth < 0) | (at["ended"] & (c != ""))).alias("bad"),
        )

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("done"), F.lit(False).alias("open"), F.lit(False).alias("ended"), F.lit(False).alias("bad"))
    last = F.aggregate(chars, start, step)
    fine = strip(text).rlike(r"^[\[\(\{]") & (last["depth"] == 0) & ~last["bad"]
    return F.when(fine, last["done"] + F.when(last["open"], 1).otherwise(0))


def parameter_count(parameters: Column) -> Column:
    """Entries of a list, tuple, set or dictionary written as text, however deeply its entries nest; 0 for null and for other text."""
    plain = F.size(F.from_json(parameters, "array<string>"))
    nested = _entries(F.regexp_replace(parameters, _QUOTED, "x"))
    return F.coalesce(F.when(plain >= 0, plain).otherwise(nested), F.lit(0)).cast("bigint")


def rough_metrics(code: Column) -> Column:
    """struct(nloc, token_count, complexity) by counting lines, words and branch points; zeros and 1 for empty text."""
    branch = rf"(?:^|(?<=[^{WORD}]))(?:if|for|while|case|catch|elif)(?=[^{WORD}]|$)|\?|&&|\|\|"
    return F.struct(
        nonblank(split_lines(code)).alias("nloc"),
        F.regexp_count(code, F.lit(rf"[{WORD}]+|[^{WORD}{WS}]")).cast("bigint").alias("token_count"),
        (F.regexp_count(code, F.lit(branch)) + 1).cast("bigint").alias("complexity"),
    )
