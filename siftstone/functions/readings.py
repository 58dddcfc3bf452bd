"""Common readings of the corpus: language names, weakness labels and the form of a code."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from siftstone.functions.text import strip
from siftstone.plans.dims import sized

_PAIR = re.compile(r"\{[^{}]*\}")
_NOT_LETTERS = re.compile(r"[\W_]+")
_NOT_ALNUM = bytes(i for i in range(128) if not chr(i).isalnum())
#: A key and its ``:`` or ``=`` at the start of an entry between curly braces.
_ENTRY_KEY = re.compile(r"""\s*\.?\s*["'`]?\s*\w+\s*["'`]?\s*[:=]""")


def weakness_label(c: Column) -> Column:
    """The weakness label ``c`` stands for; null for null and for blank text.

    ``safe`` in any case is ``Safe``; text that ends in a number is ``CWE-<number>`` without leading
    zeros; other text is its own label in capitals.
    """
    text = strip(c)
    number = F.regexp_replace(F.regexp_extract(text, r"([0-9]+)$", 1), "^0+(?=.)", "")
    return (
        F.when(text == "", F.lit(None).cast("string"))
        .when(F.lower(text) == "safe", F.lit("Safe"))
        .when(text.rlike("[0-9]$"), F.concat(F.lit("CWE-"), number))
        .otherwise(F.upper(text))
    )


def with_language(df: DataFrame, aliases: DataFrame, column: str = "programming_language", out: str = "language") -> DataFrame:
    """``df`` with ``out``: the language ``column`` names after ``aliases``, null if it names none.

    Should an alias stand twice, the alphabetically first language holds.
    """
    dim = aliases.groupBy(F.col("alias_name").alias("__alias")).agg(F.min("programming_language").alias("__language"))
    joined = df.withColumn("__name", F.lower(strip(F.col(column)))).join(sized(dim), F.col("__name") == F.col("__alias"), "left")
    return joined.withColumn(out, F.col("__language")).drop("__name", "__alias", "__language")


def code_form(code: str | None) -> str | None:
    """The form of a code, None where it has no letter or digit.

    Lower-cased, only letters and digits, in order; the entries of an innermost pair of curly braces that all
    begin with a key are put into sorted order, empty entries being ignored.
    """
    if not code:
        return None
    low = code.lower()
    if "{" in low:
        low = _PAIR.sub(_in_order, low)
    return _letters(low) or None


def _letters(text: str) -> str:
    return text.encode().translate(None, _NOT_ALNUM).decode() if text.isascii() else _NOT_LETTERS.sub("", text)


def _in_order(pair: re.Match) -> str:
    text = pair.group()
    if "," not in text or not ("=" in text or ":" in text):
        return text
    entries = [e for e in text[1:-1].split(",") if e and not e.isspace()]
    if not all(map(_ENTRY_KEY.match, entries)):
        return text
    return " ".join(sorted(map(_letters, entries)))


@F.arrow_udf(BinaryType())
def form_key(code: pa.Array) -> pa.Array:
    """128-bit key of the form of a code, null where it has none.

    Arrow batches through Python: ten times less CPU than the same rule in Java regular expressions, since
    ASCII text is filtered byte-wise and the braces are visited once.
    """
    forms = map(code_form, code.to_pylist())
    return pa.array([f and hashlib.md5(f.encode("utf-8", "surrogatepass")).digest() for f in forms], pa.binary())
