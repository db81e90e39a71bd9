"""Token counts: batch encoding in an Arrow function that returns lengths only.

Batches are balanced by bytes (about ``BATCH`` each, whatever the number of rows), and
long texts are cut at safe boundaries before anything is done with them, see
:mod:`byte_bpe`; only their lengths are added up. The tokenizer file's path is
a parameter; every worker opens it itself, so it must exist on all machines.

A null or empty text has no tokens. Rows are counted one by one, so repeated rows and
ids keep their rows; of the input only the id and the text are read. An empty table
gives no rows. No shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .byte_bpe import encoder
from .shared import small_batches, texts

BATCH = 2 << 20


def n_tokens(text: Column, tokenizer: str) -> Column:
    """Number of tokens of each text, as a column."""

    @F.arrow_udf("bigint")
    def count(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoder(tokenizer)
        for a in it:
            parts = [enc.encode(p.column(0), ids=False)[0] for p in K.blocks(iter([pa.RecordBatch.from_arrays([a], ["t"])]), "t", BATCH)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64))

    return count(F.coalesce(text, F.lit("")))


def token_counts(df: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` per row."""
    small_batches(df.sparkSession)
    rows = texts(df, id_col, text_col).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), n_tokens(F.col("text"), tokenizer).alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
