"""Augmentation of code: renaming frequent identifiers and masking tokens, indicators and reserved words kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftstone.functions.dictionaries import RESERVED_WORDS, indicators
from siftstone.operators.ranks import draw_key, draw_number
from siftstone.operators.windows import code_tokens

MASK = "<mask>"
CANDIDATES = 10


def preserved(token: Column) -> Column:
    """Whether augmentation must keep a token: an indicator or a reserved word, in any letter case."""
    return F.lower(token).isin(sorted({*indicators(), *RESERVED_WORDS}))


def chance(seed: str, *ids: Column) -> Column:
    """A reproducible number in [0, 1)."""
    return draw_number(draw_key(seed, *ids)) / F.lit(float(1 << 32))


def rename_candidates(df: DataFrame, id_column: str, code: str = "code") -> DataFrame:
    """(id, token, n_uses, place): the ten most used identifiers of three characters or more, ties by first use.

    Counting is per text, so only (text, token) pairs are shuffled, already combined.
    """
    tokens = df.where(F.col(code).isNotNull()).select(id_column, F.posexplode(code_tokens(F.col(code))).alias("at", "token"))
    able = tokens.where((F.length("token") >= 3) & F.replace("token", F.lit("_"), F.lit("")).rlike(r"^[\p{L}\p{N}]+$") & ~preserved(F.col("token")))
    used = able.groupBy(id_column, "token").agg(F.count("*").alias("n_uses"), F.min("at").alias("__first"))
    ranked = used.withColumn("place", F.row_number().over(Window.partitionBy(id_column).orderBy(F.desc("n_uses"), "__first")) - 1)
    return ranked.where(F.col("place") < CANDIDATES).select(id_column, "token", "n_uses", "place")


def rename_map(df: DataFrame, id_column: str, code: str = "code", share: float = 0.5) -> DataFrame:
    """(id, token, new_name): the candidates that the draw keeps, named after their place."""
    found = rename_candidates(df, id_column, code)
    kept = found.where(chance("rename", F.col(id_column), F.col("place")) < share)
    return kept.select(id_column, "token", F.concat(F.lit("var_"), F.col("place").cast("string")).alias("new_name"))


def augmented(df: DataFrame, id_column: str, code: str = "code", text_share: float = 0.3, rename_share: float = 0.3, mask_share: float = 0.1) -> DataFrame:
    """(id, code, changed): a draw picks the texts to change; of these some are renamed, and tokens masked.

    Kept as they are: indicators, reserved words and single characters that are neither letter nor digit. Changed texts come out as
    tokens joined by blanks, the others untouched. Null code stays null.
    """
    picked = chance("augment", F.col(id_column)) < text_share
    renamed = picked & (chance("renaming", F.col(id_column)) < rename_share)
    names = (
        rename_map(df.where(renamed), id_column, code)
        .groupBy(id_column)
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("token", "new_name")))).alias("__names"))
    )  # at most ten entries a text
    joined = df.select(id_column, code, picked.alias("changed")).join(names, id_column, "left")
    words = F.filter(F.transform(code_tokens(F.col(code)), lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda x: x["t"].isNotNull())

    def one(x: Column) -> Column:
        single = (F.length(x["t"]) == 1) & ~x["t"].rlike(r"[\p{L}\p{N}]")
        new = F.try_element_at("__names", x["t"])
        masked = chance("mask", F.col(id_column), x["i"]) < mask_share
        return F.when(preserved(x["t"]) | single, x["t"]).when(new.isNotNull(), new).when(masked, MASK).otherwise(x["t"])

    text = F.when(F.col("changed"), F.array_join(F.transform(words, one), " ")).otherwise(F.col(code))
    return joined.select(id_column, text.alias("code"), "changed")
