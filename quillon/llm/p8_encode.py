"""Problem 8: encode every text with a public byte-level BPE vocabulary.

The encoding of a piece of text is found by dynamic programming over its prefixes (``bpe``): each
prefix keeps its one valid last token. Rows are independent, so this is a map without a shuffle.

Defined results: a null text and an empty text have the empty list of ids; a blank text has the ids
of its blanks; strings of special tokens are ordinary text; rows with equal or null ids are kept as
they are; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.bpe import DEFAULT_VOCABULARY, Encoder


def encode(df: DataFrame, key: str, text: str, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """key and ids (array<int>) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(path)
        for b in batches:
            ids = pa.array((enc.encode(t) for t in b.column(1).to_pylist()), type=pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=[key, "ids"])

    src = df.select(F.col(key).alias(key), F.col(text).cast("string").alias("text"))
    return src.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, ids array<int>")


def count_tokens(df: DataFrame, key: str, text: str, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """key and n_tokens (long) of every row; 0 for null and empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(path)
        for b in batches:
            n = pa.array((enc.count(t) for t in b.column(1).to_pylist()), type=pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), n], names=[key, "n_tokens"])

    src = df.select(F.col(key).alias(key), F.col(text).cast("string").alias("text"))
    return src.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, n_tokens bigint")
