"""Problem 7: encoding of a whole corpus with a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pagewright.llm.tokenizer import Tokenizer, encoder


def encode_corpus(documents: DataFrame, tokenizer: Tokenizer = Tokenizer(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row (id, ids) per row of ``documents``, in one pass without a shuffle.

    NULL and empty texts give an empty list; blank texts give the ids of their blanks.
    Repeated rows stay. Other columns, clashing names included, are ignored; an empty
    table gives an empty result. Texts of any length are encoded whole.
    """
    source = documents.select(F.col(id_column).alias("key"), F.col(text_column).cast("string").alias("value"))
    kind = source.schema["key"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), encoder(tokenizer).encode(batch.column(1))], [id_column, "ids"])

    return source.mapInArrow(run, f"`{id_column}` {kind.simpleString()}, ids array<int>")


def with_token_count(rows: DataFrame, text_column: str, tokenizer: Tokenizer = Tokenizer(), drop_text: bool = True) -> DataFrame:
    """``rows`` with ``n_tokens`` (0 for NULL and empty text) in place of, or beside, the text."""
    kept = [c for c in rows.columns if not (drop_text and c == text_column)]
    at = rows.columns.index(text_column)
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept) + ", n_tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = pa.array(encoder(tokenizer).count(batch.column(at)))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [n], [*kept, "n_tokens"])

    return rows.mapInArrow(run, schema)


def content_key(text: Column, tokenizer_hash: str) -> Column:
    """Key of a text under a tokenizer; equal for equal texts only, up to a collision of 128 bits."""
    return F.md5(F.concat(F.lit(tokenizer_hash), F.coalesce(text, F.lit(""))))
