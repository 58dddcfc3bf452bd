"""Sizes of texts in tokens of a public byte-level vocabulary."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.plans.scratch import materialise

#: Vocabulary file (ranks of byte strings); it must be readable on every executor.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary cuts text before merging. Fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def load(path: str):
    """The tokenizer of the vocabulary at ``path``; it knows no special tokens."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, id_column: str, text_column: str, keep: tuple[str, ...] = (), vocabulary: str = VOCABULARY) -> DataFrame:
    """(id_column, keep..., n_tokens) for every row, written to scratch: the text is read and tokenised once.

    Null text has null tokens, empty text none. Texts are tokenised whole.
    """
    picked = df.select(id_column, *keep, F.col(text_column).alias("__text"))
    schema = picked.drop("__text").withColumn("n_tokens", F.lit(None).cast("bigint")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = load(vocabulary).encode_ordinary
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            n = pa.array([None if t is None else len(count(t)) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], [*batch.schema.names[:-1], "n_tokens"])

    return materialise(picked.mapInArrow(run, schema), "tokens")
