"""Fixed-width token windows: sliding and sampled, padding, ragged batches.

Window positions have a closed form, so only the at most ``CAP`` windows of a text are ever generated; tokens are sliced,
never exploded one by one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WIDTH, STRIDE, CAP = 510, 256, 8
RAW_LIMIT, RAW_CHARS = 50_000, 3_000
CLS, SEP, PAD = 0, 2, 1
VOCABULARY = 50_000
#: An identifier or any other single character that is not white space.
CODE_TOKEN = r"[a-zA-Z_][a-zA-Z0-9_]*|[^\t-\r\x{1C}-\x{20}\x{85}\p{Z}]"


def code_tokens(code: Column) -> Column:
    """The surrogate tokens of a code: a sub-word vocabulary can be put in their place."""
    return F.regexp_extract_all(code, F.lit(f"({CODE_TOKEN})"), F.lit(1))


def window_count(n: Column, width: int = WIDTH, stride: int = STRIDE, cap: int = CAP) -> Column:
    """How many sliding windows ``n`` tokens have: none is begun with less than a quarter of the width left."""
    return F.when(n <= width, F.lit(1)).otherwise(F.least(F.lit(cap), F.floor((n - width // 4) / stride) + 1)).cast("int")


def _even(n: Column, length: int, count: int) -> Column:
    span = F.greatest(n - length, F.lit(0)).cast("bigint")
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.floor(i * span / (count - 1)).cast("bigint"))


def window_starts(n: Column, policy: str = "training") -> Column:
    """First tokens of the windows of a text of ``n`` tokens.

    ``inference`` slides only; ``training`` takes evenly spread windows where sliding ones could not reach the end.
    """
    sliding = F.transform(F.sequence(F.lit(0), window_count(n) - 1), lambda i: (i * STRIDE).cast("bigint"))
    if policy == "inference":
        return sliding
    if policy != "training":
        raise ValueError(f"unknown policy {policy!r}")
    return F.when(n > WIDTH * CAP, _even(n, WIDTH, CAP)).otherwise(sliding)


def token_windows(df: DataFrame, ids: Sequence[str], tokens: str = "tokens", policy: str = "training") -> DataFrame:
    """(ids, window_no, start, n_tokens, window): one row per window; null tokens have none, an empty text one empty window."""
    n = F.size(tokens).cast("bigint")
    rows = df.where(F.col(tokens).isNotNull()).select(*ids, tokens, F.posexplode(window_starts(n, policy)).alias("window_no", "start"))
    window = F.slice(F.col(tokens), (F.col("start") + 1).cast("int"), WIDTH)
    return rows.withColumn("window", window).select(*ids, "window_no", "start", F.size("window").cast("bigint").alias("n_tokens"), "window")


def raw_windows(df: DataFrame, ids: Sequence[str], code: str = "code") -> DataFrame:
    """(ids, window_no, start, chunk): evenly spread pieces of the texts above 50 000 characters, so these needn't be tokenised."""
    n = F.length(code).cast("bigint")
    rows = df.where(n > RAW_LIMIT).select(*ids, code, F.posexplode(_even(n, RAW_CHARS, CAP)).alias("window_no", "start"))
    return rows.select(*ids, "window_no", "start", F.substr(F.col(code), (F.col("start") + 1).cast("int"), F.lit(RAW_CHARS)).alias("chunk"))


def token_id(token: Column) -> Column:
    """A surrogate id of a token from its hash, clear of the special ids."""
    return (F.conv(F.substring(F.md5(token), 1, 6), 16, 10).cast("bigint") % VOCABULARY + 4).cast("int")


def built(ids: Column, length: int = WIDTH + 2) -> Column:
    """struct(input_ids, attention_mask) of ``length``: special ids at both ends, cut if too long, padded if too short."""
    kept = F.slice(ids, 1, length - 2)
    real = F.concat(F.array(F.lit(CLS)), kept, F.array(F.lit(SEP)))
    rest = F.greatest(F.lit(length) - F.size(real), F.lit(0))
    return F.struct(
        F.concat(real, F.array_repeat(F.lit(PAD), rest)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), F.size(real)), F.array_repeat(F.lit(0), rest)).alias("attention_mask"),
    )


def ragged_offsets(df: DataFrame, id_column: str, batch: str, count: str) -> DataFrame:
    """``df`` with ``offset``: where a sample's windows begin among those of its batch, samples in order of their identifier."""
    w = Window.partitionBy(batch).orderBy(id_column).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("offset", F.coalesce(F.sum(count).over(w), F.lit(0)).cast("bigint"))
