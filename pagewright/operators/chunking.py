"""Cutting page text into chunks, naming and linking them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pagewright.functions.sql import blanks_split

SUFFIX = {"text": "t", "table": "tbl"}
_PARAGRAPH, _SENTENCE = re.compile(r"\n\s*\n"), re.compile(r"(?<=[.!?])\s+")


def estimate(text: str) -> int:
    return int(len(text.split()) * 1.3)


def windows(words: Column, size: int, overlap: int) -> Column:
    """Arrays of ``size`` words, each beginning ``size - overlap`` after the one before; the last may be short."""
    step = size - overlap
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - overlap, F.lit(1)), F.lit(step))
    return F.when(F.size(words) > 0, F.transform(starts, lambda s: F.slice(words, s, size))).otherwise(F.array().cast("array<array<string>>"))


def word_windows(text: Column, size_tokens: int = 400, overlap_tokens: int = 50) -> Column:
    """Windows over a long text by words: the budget is the size without overlap and 5 % of it."""
    budget = size_tokens - overlap_tokens - int(0.05 * size_tokens)
    return F.transform(windows(blanks_split(text), int(budget / 1.3), int(overlap_tokens / 1.3)), lambda w: F.array_join(w, " "))


def overlap_text(paragraph: Column, overlap_tokens: int = 50) -> Column:
    """The last words of a paragraph, or all of it if it is shorter."""
    w, n = blanks_split(paragraph), int(overlap_tokens / 1.3)
    return F.array_join(F.slice(w, F.greatest(F.size(w) - (n - 1), F.lit(1)), n), " ")


def _tail(text: str, n: int) -> str:
    words = text.split()
    return " ".join(words[-n:]) if len(words) > n else text


def _packed(units: list[str], most: int, budget: int, joiner: str, carry: Callable[[str], str], cut: Callable[[str], Iterator[str]]) -> Iterator[str]:
    """Units packed in order while their estimates, each rounded down, add up to the budget.

    A new piece begins with what ``carry`` keeps of the last unit before it, and counts that
    and its first unit as one text. A unit over ``most`` ends the piece and goes through ``cut``;
    nothing is carried over it.
    """
    held: list[str] = []
    total = 0
    for unit in filter(None, map(str.strip, units)):
        n = estimate(unit)
        if n > most or (held and total + n > budget):
            if held:
                yield joiner.join(held)
            held = [x for x in (carry(held[-1]),) if x] if held and n <= most else []
            if n > most:
                yield from cut(unit)
                total = 0
                continue
            held.append(unit)
            total = estimate(joiner.join(held))
        else:
            held.append(unit)
            total += n
    if held:
        yield joiner.join(held)


def _word_pieces(text: str, budget: int, overlap: int) -> Iterator[str]:
    words, size = text.split(), max(1, int(budget / 1.3))
    step = max(1, size - int(overlap / 1.3))
    for at in range(0, max(1, len(words) - size + step), step):
        yield " ".join(words[at : at + size])


def _sentence_pieces(text: str, size: int, budget: int, overlap: int) -> Iterator[str]:
    """An oversized paragraph by sentences (by lines where it is one sentence); the last sentence is repeated in the next piece."""
    parts = _SENTENCE.split(text)
    if len(parts) == 1 and estimate(text) > size:
        parts = text.split("\n")
    return _packed(parts, budget, budget, " ", (lambda last: last) if overlap else (lambda last: ""), lambda s: _word_pieces(s, budget, overlap))


def fold_text(text: str, size: int = 400, overlap: int = 50) -> list[str]:
    """Chunks of one text: paragraphs are packed while they fit, oversized ones are cut by sentences.

    A text without a blank line that is over the size is taken by lines, which are joined by
    one line end again. A new chunk begins with the last words of the one before, except after
    an oversized paragraph; an overlap of 0 repeats nothing.
    """
    budget = size - overlap - int(0.05 * size)
    units, joiner = _PARAGRAPH.split(text), "\n\n"
    if len(units) == 1 and estimate(text) > size:
        units, joiner = text.split("\n"), "\n"
    keep = int(overlap / 1.3)
    return list(_packed(units, size, budget, joiner, lambda last: _tail(last, keep) if keep else "", lambda p: _sentence_pieces(p, size, budget, overlap)))


def chunk_texts(elements: DataFrame, size: int = 400, overlap: int = 50) -> DataFrame:
    """(doc_id, page, elem_idx, piece_idx, content) of the text elements.

    The fold has state within one text only, so it runs over Arrow batches without a
    shuffle. NULL and blank content gives no piece.
    """
    rows = elements.where(F.col("content").rlike(r"(?U)\S")).select("doc_id", "page", "elem_idx", "content")
    kind = {c: rows.schema[c].dataType.simpleString() for c in ("doc_id", "page", "elem_idx")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = [fold_text(t, size, overlap) for t in batch.column(3).to_pylist()]
            at = pa.array([i for i, ps in enumerate(pieces) for _ in ps], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(i).take(at) for i in range(3)] + [pa.array([k for ps in pieces for k in range(len(ps))], pa.int32()), pa.array([p for ps in pieces for p in ps], pa.string())], ["doc_id", "page", "elem_idx", "piece_idx", "content"])

    return rows.mapInArrow(run, f"doc_id {kind['doc_id']}, page {kind['page']}, elem_idx {kind['elem_idx']}, piece_idx int, content string")


def name_pieces(pieces: DataFrame, kind: str = "text") -> DataFrame:
    """Adds ``chunk_id``: document, page and a number per page and type in element order."""
    n = F.row_number().over(W.partitionBy("doc_id", "page").orderBy("elem_idx", "piece_idx")) - 1
    return pieces.withColumn("type", F.lit(kind)).withColumn("chunk_id", F.concat(F.col("doc_id").cast("string"), F.lit("_p"), F.col("page").cast("string"), F.lit(f"_{SUFFIX[kind]}"), n.cast("string")))


def link_chunks(chunks: DataFrame, order: list[str]) -> DataFrame:
    """Adds prev_chunk_id and next_chunk_id within each document, over text and table chunks; others get NULL.

    ``order`` is the order within a page; pages come one after the other. Neighbours are
    found within each page, and only the first and last chunk of each page meet those of the
    next, so no task sorts a document.
    """
    keys = ["doc_id", "_linked", "page"]
    rows = chunks.withColumn("_linked", F.coalesce(F.col("type").isin("text", "table"), F.lit(False)))
    place = F.struct(*order)
    edges = rows.where("_linked").groupBy(*keys).agg(F.min_by("chunk_id", place).alias("_first"), F.max_by("chunk_id", place).alias("_last"))
    pages = W.partitionBy("doc_id").orderBy("page")
    edges = edges.select(*(F.col(c).alias(f"_e{c}") for c in keys), F.lag("_last").over(pages).alias("_before"), F.lead("_first").over(pages).alias("_after"))
    w = W.partitionBy(*keys).orderBy(*order)
    near = rows.withColumn("_prev", F.lag("chunk_id").over(w)).withColumn("_next", F.lead("chunk_id").over(w))
    joined = near.join(edges, (near["doc_id"].eqNullSafe(F.col("_edoc_id")) & near["page"].eqNullSafe(F.col("_epage")) & (near["_linked"] == F.col("_e_linked"))), "left")
    link = lambda inner, outer: F.when(F.col("_linked"), F.coalesce(inner, outer))
    return joined.select(*(near[c] for c in chunks.columns), link("_prev", "_before").alias("prev_chunk_id"), link("_next", "_after").alias("next_chunk_id"))
