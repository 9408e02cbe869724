"""Exact vector index: unit vectors in a table, searched in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from pagewright.functions.text import vector_unit
from pagewright.plans.lineage import written_blocks

#: Query vectors that are multiplied at a time, and vectors of the index that a task holds against them.
QUERY_BLOCK, INDEX_BLOCK = 2048, 32_768


def upsert(index: DataFrame, new: DataFrame, key: str = "chunk_id", vector: str = "vector") -> DataFrame:
    """Rows of ``new``, normalised, in place of rows with the same key. Repeated keys inside ``new`` are all kept."""
    unit = new.withColumn(vector, F.transform(vector_unit(F.col(vector)), lambda x: x.cast("float")))
    return index.join(new.select(key).distinct(), key, "left_anti").unionByName(unit)


def delete(index: DataFrame, keys: DataFrame, key: str = "chunk_id") -> DataFrame:
    return index.join(keys.select(key).distinct(), key, "left_anti")


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together to tables of about ``INDEX_BLOCK`` rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= INDEX_BLOCK:
            yield pa.Table.from_batches(held)
            held = []
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def top_k(queries: DataFrame, index: DataFrame, k: int, query_id: str = "query_id", key: str = "chunk_id", vector: str = "vector") -> DataFrame:
    """(query_id, key, score, rank) of the k nearest by inner product of unit vectors, exact; ties by key.

    The query vectors are written in blocks. The index is read once: every task holds some
    thousand of its vectors and multiplies them with one block of queries after the other,
    keeping the k best per query; what remains is ranked once per query. NULL vectors are
    left out; an empty index gives no rows.
    """
    unit = queries.where(F.col(vector).isNotNull()).select(F.col(query_id).alias("q"), vector_unit(F.col(vector)).alias("v"))
    rows = index.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), vector_unit(F.col(vector)).alias("v"))
    kinds = (unit.schema["q"].dataType.simpleString(), rows.schema["key"].dataType.simpleString())
    blocks = written_blocks(unit, "q", QUERY_BLOCK, "query-vectors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _held(batches):
            vectors, keys = _matrix(held["v"]), held["key"].combine_chunks()
            for block in blocks.read():
                if not block.num_rows:
                    continue
                scores = _matrix(block["v"]) @ vectors.T
                # Scores that tie with the k-th are kept too, so that ties are broken by key later.
                least = np.partition(scores, -k, axis=1)[:, -k, None] if scores.shape[1] > k else np.full((len(scores), 1), -np.inf)
                q, r = np.nonzero(scores >= least - 1e-9)
                yield pa.RecordBatch.from_arrays([block["q"].combine_chunks().take(pa.array(q)), keys.take(pa.array(r)), pa.array(scores[q, r])], ["q", "key", "score"])

    parts = rows.mapInArrow(run, f"q {kinds[0]}, key {kinds[1]}, score double")
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.round("score", 6).desc(), "key"))
    return parts.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("q").alias(query_id), F.col("key").alias(key), "score", "rank")
