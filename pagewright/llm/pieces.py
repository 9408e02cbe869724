"""Problem 6: splitting oversized items at natural boundaries."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from pagewright.functions.sql import token_estimate

#: Fixed values of the project: limit and overlap in estimated tokens.
LIMIT, OVERLAP = 400, 50
#: Separators from the widest unit to the narrowest, the same for Java and Python.
LINE_BREAK = r"(?:\r\n|[\n\x0B\x0C\r\x85  ])"
BLANK_LINES = rf"{LINE_BREAK}(?:[^\S\r\n\x0B\x0C\x85  ]*{LINE_BREAK})+"
SENTENCE_GAP = r"(?<=[.!?])\s+"
SECTION = r"(?m)^(?=\#{1,6}\s|\d+(?:\.\d+)*\.?\s{1,3}\p{Lu}[^\n.]{2,78}$)"


def words_within(tokens: int) -> int:
    """The most words whose estimate stays within ``tokens``."""
    n = int((tokens + 1) / 1.3)
    return n if int(n * 1.3) <= tokens else n - 1


_LEVELS = [regex.compile(p) for p in (SECTION, BLANK_LINES, LINE_BREAK, SENTENCE_GAP)]
#: What the cuts of each level are called; sections end where paragraphs or lines do.
BOUNDARIES = ["paragraph", "paragraph", "line", "sentence", "word"]
_WORD = regex.compile(r"\S+")


def _n_words(text: str, begin: int, end: int) -> int:
    return sum(1 for _ in _WORD.finditer(text, begin, end))


def _spans(text: str, begin: int, end: int, level: int, most_words: int, most_chars: int) -> Iterator[tuple[int, int, int, int]]:
    """(begin, end, words, level) of units within the limits: a span over one is cut by the next separator of the hierarchy, from section to character."""
    n = _n_words(text, begin, end)
    if n <= most_words and end - begin <= most_chars:
        if n:
            yield begin, end, n, level
    elif level < len(_LEVELS):
        at = begin
        for gap in _LEVELS[level].finditer(text, begin, end):
            if gap.start() > at:
                yield from _spans(text, at, gap.start(), level + 1, most_words, most_chars)
            at = gap.end()
        yield from _spans(text, at, end, level + 1, most_words, most_chars)
    else:
        for w in _WORD.finditer(text, begin, end):
            for a in range(w.start(), w.end(), most_chars):  # characters only where a single word is over the limit
                yield a, min(a + most_chars, w.end()), 1, level + 1


def _tail(text: str, begin: int, end: int, most: int) -> int:
    """Where the last ``most`` words of the span begin."""
    starts = [w.start() for w in _WORD.finditer(text, begin, end)]
    return end if not most else starts[-most] if len(starts) >= most else begin


def boundary_of(text: str, most_words: int) -> str:
    """The first of paragraph, line, sentence and word that leaves every unit within the limit, by the splitter's own descent; characters do not count."""
    deepest = max((level for _, _, _, level in _spans(text, 0, len(text), 0, most_words, len(text))), default=1)
    boundary = BOUNDARIES[deepest - 1]
    if boundary == "paragraph":
        # A section may begin inside a paragraph: then the cut was one between lines.
        at = 0
        for gap in (*_LEVELS[1].finditer(text), None):
            if _n_words(text, at, gap.start() if gap else len(text)) > most_words:
                return "line"
            at = gap.end() if gap else at
    return boundary


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP, most_chars: int = 16_000) -> list[tuple[int, int, int]]:
    """(begin, core, end) of the pieces: text[core:end] is new, text[begin:core] repeats the piece before.

    Units within the limit stay whole and are packed greedily. A piece begins with the last
    words of the one before, as many as the overlap asks for and its first unit leaves room for.
    """
    most, repeat = words_within(limit), words_within(overlap)
    pieces: list[list[int]] = []
    size = 0
    for begin, end, n, _ in _spans(text, 0, len(text), 0, most, most_chars):
        if pieces and size + n <= most and end - pieces[-1][0] <= most_chars:
            pieces[-1][2], size = end, size + n
            continue
        again = min(repeat, most - n) if pieces else 0
        start = _tail(text, pieces[-1][1], pieces[-1][2], again) if again else begin
        if end - start > most_chars:
            start, again = begin, 0
        pieces.append([start, begin, end])
        size = n + (again and _n_words(text, start, begin))
    return [tuple(p) for p in pieces]


def _over(chunks: DataFrame, limit: int) -> DataFrame:
    """Chunks above the limit; only they reach Python."""
    return chunks.where(F.length("content") > limit).where(token_estimate(F.col("content")) > limit).select("chunk_id", "content")


def oversized(chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(chunk_id, boundary) of distinct chunks above the limit, by the descent of the splitter. NULL, blank and short content is no case."""
    most = words_within(limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([boundary_of(t, most) for t in batch.column(1).to_pylist()], pa.string())], ["chunk_id", "boundary"])

    return _over(chunks, limit).mapInArrow(run, "chunk_id string, boundary string").distinct()


def split_oversized(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of every distinct chunk above the limit.

    (chunk_id, piece_id, piece_no, content, overlap_chars, boundary): piece_id is
    ``{chunk_id}_s{piece_no}`` counted from 0; content without its first overlap_chars
    characters, joined over the pieces, is the text but for whitespace at the cuts. Several
    contents under one chunk_id are told apart by a further ``_v{n}``. Chunks within the
    limit, NULL and blank content give no piece. A word beyond 16,000 characters is cut
    between characters. Only oversized rows reach Python.
    """
    most = words_within(limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for chunk_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                boundary, version = boundary_of(text, most), hash_of(text)
                rows += [(chunk_id, no, text[begin:end], core - begin, boundary, version) for no, (begin, core, end) in enumerate(split_text(text, limit, overlap))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int64()))], names)

    names = ["chunk_id", "piece_no", "content", "overlap_chars", "boundary", "version"]
    pieces = _over(chunks, limit).distinct().mapInArrow(run, "chunk_id string, piece_no int, content string, overlap_chars int, boundary string, version bigint")
    version = F.dense_rank().over(W.partitionBy("chunk_id").orderBy("version")) - 1
    mark = F.when(F.col("v") > 0, F.concat(F.lit("_v"), F.col("v").cast("string"))).otherwise("")
    return pieces.withColumn("v", version).select("chunk_id", F.concat("chunk_id", mark, F.lit("_s"), F.col("piece_no").cast("string")).alias("piece_id"), "piece_no", "content", "overlap_chars", "boundary")


def hash_of(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)
