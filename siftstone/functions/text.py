"""Text primitives as column expressions; Unicode-aware where Java's defaults are not."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's ``str.strip`` sees it, as the inside of a character class.
WS = r"\t-\r\x{1C}-\x{20}\x{85}\p{Z}"
#: Letters, digits of any script and the underscore, as the inside of a character class.
WORD = r"\p{L}\p{N}_"
#: Line ends that ``str.splitlines`` honours.
LINE_END = r"\r\n|[\n\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"


def strip(c: Column) -> Column:
    """``c`` without white space at either end."""
    return F.regexp_replace(c, f"^[{WS}]+|[{WS}]+$", "")


def words(c: Column) -> Column:
    """The runs of letters, digits and underscores of ``c``, in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"([{WORD}]+)"), F.lit(1))


def raw_lines(c: Column) -> Column:
    """``c`` cut at each line feed; a final line feed leaves an empty last line."""
    return F.split(c, "\n", -1)


def split_lines(c: Column) -> Column:
    """``c`` cut at every kind of line end, without an empty last line."""
    parts = F.split(c, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def nonblank(lines: Column) -> Column:
    """How many entries of ``lines`` hold anything but white space (bigint)."""
    return F.size(F.filter(lines, lambda x: x.rlike(f"[^{WS}]"))).cast("bigint")
