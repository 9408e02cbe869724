"""Hybrid retrieval of large batches: tasks hold some questions and read the index block by block.

The chunks are put in order of their ids and cut into blocks; each block is one file with its
vectors, ids, types and the postings of the words that are asked for. A task takes some
thousand questions through one block after the other and keeps the best of each, so no list of
hits is shuffled or written, and a task's memory depends on the sizes of its blocks alone.
The results are those of ``retrieval.search`` over the hits of both indexes.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, Window as W, functions as F

from pagewright.functions.predicates import IMAGE_TYPES
from pagewright.operators.lexical import B, K1, LexicalIndex, _tokens, query_tokens
from pagewright.operators.retrieval import anchor_candidates, intent
from pagewright.plans.lineage import Blocks, materialize, written_blocks

#: Chunks in a block of the index, questions that a task holds at most, and texts to a row of a block.
CHUNK_BLOCK, QUESTION_BLOCK, ROW = 131_072, 8_192, 4_096
#: Vectors of questions and of the index that are multiplied at a time.
LEFT, RIGHT = 1_024, 8_192
#: Single-precision scores may be off by less than this; words in more than one of so many chunks are frequent.
MARGIN, FREQUENT = 2e-5, 12
INDEX = "term string, at binary, times binary, ids array<string>, types array<string>"
HITS = "array<struct<n: int, chunk_id: string, type: string, score: double>>"


def written_index(rows: DataFrame, vocabulary: DataFrame, n: int, block: int) -> tuple[str, ...]:
    """The files of the index over ``n`` rows (chunk_id, type, text, vector), by chunk_id; postings of the terms of ``vocabulary``.

    A row without term has ids and types of some chunks, their vectors (NaN where missing) and
    the lengths of their texts (-1 for NULL); a row with a term has the places of its chunks and
    how often each has it.
    """
    spark = rows.sparkSession
    words = written_blocks(vocabulary.select("term"), "term", 1_000_000, "vocabulary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = [t for part in words.read() for t in part["term"].to_pylist()]
        place = {t: i for i, t in enumerate(terms)}
        seen, kept = 0, []
        for batch in batches:
            for begin in range(0, batch.num_rows, ROW):
                ids, types, texts, vectors = batch.slice(begin, ROW).columns
                tokens = _tokens(pc.fill_null(texts, ""))
                at = np.array([place.get(w, -1) for w in tokens.named] or [-1])[tokens.index]
                text = np.repeat(np.arange(len(ids)), np.diff(tokens.bounds))[at >= 0]
                pairs, times = np.unique(at[at >= 0].astype(np.int64) * ROW + text, return_counts=True)
                kept.append((pairs // ROW, (pairs % ROW + seen).astype(np.int32), times.astype(np.int32)))
                seen += len(ids)
                lengths = np.where(texts.is_null().to_numpy(zero_copy_only=False), -1, tokens.lengths).astype(np.int32)
                there = vectors.is_valid().to_numpy(zero_copy_only=False)
                flat = vectors.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.float32)
                held = np.full((len(ids), len(flat) // there.sum()), np.nan, np.float32) if there.any() else None
                if held is not None:
                    held[there] = flat.reshape(int(there.sum()), -1)
                yield _row([None], [held.tobytes() if held is not None else None], [lengths.tobytes()], [ids.to_pylist()], [types.to_pylist()])
        if not kept:
            return
        term, at, times = (np.concatenate(x) for x in zip(*kept))
        order = np.argsort(term, kind="stable")
        term, at, times = term[order], at[order], times[order]
        begin = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, int)
        end = np.append(begin[1:], len(term))
        for some in range(0, len(begin), 64):
            ends = list(zip(begin[some : some + 64], end[some : some + 64]))
            none = [None] * len(ends)
            yield _row([terms[term[a]] for a, _ in ends], [at[a:b].tobytes() for a, b in ends], [times[a:b].tobytes() for a, b in ends], none, none)

    ordered = rows.select("chunk_id", "type", "text", "vector").repartitionByRange(max(1, -(-n // block)), "chunk_id").sortWithinPartitions("chunk_id")
    return tuple(sorted(materialize(ordered.mapInArrow(run, INDEX), "index").inputFiles()))


def _row(*columns: list) -> pa.RecordBatch:
    kinds = [pa.string(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.string())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["term", "at", "times", "ids", "types"])


def _read(file: str, columns: list[str]) -> pa.Table:
    system, path = pyarrow.fs.FileSystem.from_uri(file)
    return pyarrow.parquet.ParquetFile(system.open_input_file(path)).read(columns=columns)


@dataclass
class Block:
    """One block of the index; ``postings`` has places and saturated counts of the terms asked for."""

    vectors: np.ndarray
    there: np.ndarray
    norms: np.ndarray
    postings: dict[int, tuple[np.ndarray, np.ndarray]]
    n: int


def _block(file: str, place: dict[str, int], mean_length: float) -> Block:
    table = _read(file, ["term", "at", "times"])
    terms, at, times = (table[c].combine_chunks() for c in ("term", "at", "times"))
    heads = np.flatnonzero(terms.is_null().to_numpy(zero_copy_only=False))
    lengths = [np.frombuffer(times[int(i)].as_buffer(), np.int32) for i in heads]
    n = sum(map(len, lengths))
    parts = [np.frombuffer(at[int(i)].as_buffer(), np.float32).reshape(len(x), -1) if at[int(i)].is_valid else None for i, x in zip(heads, lengths)]
    width = next((p.shape[1] for p in parts if p is not None), 1)
    vectors = np.concatenate([p if p is not None else np.full((len(x), width), np.nan, np.float32) for p, x in zip(parts, lengths)] or [np.zeros((0, 1), np.float32)])
    there = ~np.isnan(vectors).any(axis=1)
    vectors[~there] = 0
    norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors, dtype=np.float64))
    norms[norms == 0] = 1
    base = K1 * (1 - B + B * np.concatenate(lengths or [np.zeros(0)]) / mean_length)
    postings = {}
    for i, term in enumerate(terms.to_pylist()):
        if term is not None and term in place:
            docs, count = np.frombuffer(at[i].as_buffer(), np.int32).astype(np.int64), np.frombuffer(times[i].as_buffer(), np.int32)
            postings[place[term]] = docs, count * (K1 + 1) / (count + base[docs])
    return Block(vectors, there, norms, postings, n)


@dataclass
class Near:
    """The nearest so far of some questions: place, exact score and question of each; ``least`` is what another one needs."""

    rows: np.ndarray  # of these questions in the task's list
    vectors: np.ndarray
    k: int
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.single, self.least = self.vectors.astype(np.float32), np.full(len(self.rows), -np.inf, np.float32)

    def add(self, block: Block, begin: int, right: np.ndarray, offset: int) -> None:
        there, least = block.there[begin : begin + len(right)], self.least
        scores = self.single @ right.T
        if not there.all():
            scores[:, ~there] = -9
        if not self.found and scores.shape[1] > self.k:
            least = np.partition(scores, -self.k, axis=1)[:, -self.k] - np.float32(MARGIN)
        at = np.flatnonzero(scores >= np.maximum(least, np.float32(-2))[:, None])
        q, doc = np.divmod(at, scores.shape[1])
        if not len(q):
            return
        exact = np.empty(len(q))
        for some in range(0, len(q), 32_768):
            i, j = q[some : some + 32_768], doc[some : some + 32_768] + begin
            exact[some : some + 32_768] = np.einsum("ij,ij->i", self.vectors[i], block.vectors[j].astype(np.float64)) / block.norms[j]
        self.found.append((q, doc + (offset + begin), exact))
        if sum(len(x[0]) for x in self.found) > 2 * self.k * len(self.rows) or len(self.found) == 1:
            self.cut()

    def cut(self) -> None:
        """Only the k best of each question stay, ties by place."""
        if not self.found:
            return
        q, doc, score = (np.concatenate(x) for x in zip(*self.found))
        order = np.lexsort((doc, -np.round(score, 6), q))
        q, doc, score = q[order], doc[order], score[order]
        begin = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, int)
        size = np.diff(np.append(begin, len(q)))
        keep = np.arange(len(q)) - np.repeat(begin, size) < self.k
        full = size >= self.k
        self.least[q[begin[full]]] = score[begin[full] + self.k - 1] - MARGIN
        self.found = [(q[keep], doc[keep], score[keep])]

    def lists(self) -> Iterator[tuple[int, list[int], list[float]]]:
        self.cut()
        for q, doc, score in self.found:
            bounds = np.searchsorted(q, np.arange(len(self.rows) + 1))
            for i, row in enumerate(self.rows.tolist()):
                yield row, doc[bounds[i] : bounds[i + 1]].tolist(), score[bounds[i] : bounds[i + 1]].tolist()


@dataclass
class Worded:
    """The lexically best so far of the task's questions: places and raw scores of each."""

    terms: list[list[tuple[int, float]]]
    k: list[int]

    def __post_init__(self) -> None:
        self.docs, self.scores = [np.zeros(0, np.int64)] * len(self.k), [np.zeros(0)] * len(self.k)
        self.least = [1e-300] * len(self.k)

    def add(self, block: Block, offset: int) -> None:
        """Questions with the same frequent words share the sum of these.

        The other words only add to it: besides the chunks that have one of them, only the
        best of the shared sum can be among the best.
        """
        held, most = block.postings, max(self.k, default=1)
        groups: dict[tuple, list[tuple[int, list]]] = defaultdict(list)
        for i, terms in enumerate(self.terms):
            terms = [x for x in terms if x[0] in held]
            shared = tuple(x for x in terms if x[1] < 0 or len(held[x[0]][0]) * FREQUENT > block.n)
            groups[shared].append((i, [x for x in terms if x not in shared]))
        sums = np.zeros(block.n)
        for shared, members in groups.items():
            base = np.zeros(block.n)
            for term, weight in shared:
                base[held[term][0]] += weight * held[term][1]
            top = np.flatnonzero(base >= min(self.least[i] for i, _ in members)) if shared else np.zeros(0, np.int64)
            if len(top) > most:
                top = top[base[top] >= np.partition(base[top], -most)[-most] - 1e-5]
            top = top[np.lexsort((top, -np.round(base[top], 6)))[:most]]
            best = base[top]
            for i, rest in members:
                k, least = self.k[i], self.least[i]
                if not rest:
                    docs, score = top, best
                    if not len(top) or best[0] < least - 1e-6:
                        continue
                else:
                    if len(best) >= k:
                        least = max(least, best[k - 1] - 4e-6)
                    for term, weight in rest:
                        sums[held[term][0]] += weight * held[term][1]
                    touched = np.concatenate([held[term][0] for term, _ in rest]) if len(rest) > 1 else held[rest[0][0]][0]
                    score, n = sums[touched] + base[touched], len(held[rest[0][0]][0])
                    if n > 4 * k:  # a word has a chunk once, so at least k chunks are as good as this
                        least = max(least, np.partition(score[:n], -k)[-k] - 4e-6)
                    docs = touched[score >= least]
                    if len(top) and best[0] >= least - 1e-6:
                        docs = np.concatenate([docs, top])
                    docs = np.unique(docs)
                    score = sums[docs] + base[docs]
                    sums[touched] = 0
                if len(docs):
                    self._merge(i, docs + offset, score)

    def _merge(self, i: int, docs: np.ndarray, score: np.ndarray) -> None:
        docs, score = np.concatenate([self.docs[i], docs[score > 0]]), np.concatenate([self.scores[i], score[score > 0]])
        order = np.lexsort((docs, -np.round(score, 6)))[: self.k[i]]
        self.docs[i], self.scores[i] = docs[order], score[order]
        if len(order) == self.k[i]:
            self.least[i] = max(float(score[order[-1]]) - 2e-6, 1e-300)


def finished(dense: list[tuple[int, float]], lexical: list[tuple[int, float]], anchors: list[int], kinds: dict[int, str], is_table: bool, is_image: bool, k: int) -> list[tuple[int, float]]:
    """(place, score) of the k best of one question, as ``retrieval.search`` gives them.

    ``dense`` and ``lexical`` are in order, the longer lists for top-ups; ``anchors`` are the
    first k chunks with the question's anchor.
    """
    if len(anchors) >= k:
        return [(x, 1.0 - 0.01 * i) for i, x in enumerate(anchors[:k])]
    hits: dict[int, tuple[float, int]] = {x: (score, r) for r, (x, score) in enumerate(dense[: 2 * k], 1)}
    for r, (x, score) in enumerate(lexical[:k], 1):
        hits[x] = ((hits[x][0] + score) / 2, hits[x][1]) if x in hits else (score * 0.5, r + 1_000_000)
    top = max((s for s, _ in hits.values()), default=1.0)
    first = next((i for i, x in enumerate(anchors) if x not in hits or hits[x][0] < top), len(anchors))
    for n, x in enumerate(anchors[first:][: min(2, k)], 1):
        hits[x] = top + 0.02 * n, hits[x][1] if x in hits else n + 2_000_000
    wanted = [["table"]] * is_table + [IMAGE_TYPES] * is_image
    for types in wanted:
        lack = min(2, k) - sum(kinds[x] in types for x in hits)
        if lack > 0:
            top = max((s for s, _ in hits.values()), default=1.0)
            fresh = dict.fromkeys(x for x, _ in [*lexical, *dense] if kinds[x] in types and x not in hits)
            for n, x in enumerate(list(fresh)[:lack], 1):
                hits[x] = top + 0.01 * n, n + 3_000_000
    ranked = sorted(hits, key=lambda x: (-round(hits[x][0], 9), hits[x][1], x))
    best = ranked[:k]
    for types in wanted:
        if best and not any(kinds[x] in types for x in best):
            best[-1:] = next(([x] for x in ranked if kinds[x] in types), best[-1:])
    return [(x, hits[x][0]) for x in best]


def search(questions: DataFrame, rows: DataFrame, lexical: LexicalIndex, chunks: DataFrame, k: int, dense_pool: int, lexical_pool: int, chunk_block: int = CHUNK_BLOCK, question_block: int = QUESTION_BLOCK) -> DataFrame:
    """(query_id, n, chunk_id, type, score): the hybrid search of distinct questions.

    ``questions`` is (question, query_ids, vector), ``rows`` (chunk_id, type, text, vector), ``chunks``
    what anchors are searched in. The pools, longer lists for top-ups, are kept only for
    questions that ask for a table or an image, as no other has top-ups.
    """
    spark = questions.sparkSession
    known = intent(questions).withColumn("tokens", query_tokens(F.col("question"))).withColumn("query_id", F.col("question"))
    if known.where(F.length("anchor") >= 4).isEmpty():
        known = known.withColumn("anchors", F.array().cast("array<string>"))
    else:
        n = F.row_number().over(W.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "chunk_id"))
        first = anchor_candidates(known.select("query_id", "anchor", "preferred"), chunks).withColumn("n", n).where(F.col("n") <= k)
        first = first.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "chunk_id"))), lambda x: x["chunk_id"]).alias("anchors"))
        known = known.join(first, "query_id", "left").withColumn("anchors", F.coalesce("anchors", F.array().cast("array<string>")))
    vocabulary = materialize(lexical.terms.join(known.select(F.explode("tokens").alias("term")).distinct(), "term", "left_semi"), "asked-terms")
    files = written_index(rows, vocabulary, chunks.count(), chunk_block)
    weights = written_blocks(vocabulary, "term", 1_000_000, "weights")
    # Questions that begin alike share their frequent words, so a task holds neighbours.
    known, many = known.select("question", "query_ids", "tokens", "vector", "is_table", "is_image", "anchors"), questions.count()
    parts = max(1, -(-many // question_block), min(3 * spark.sparkContext.defaultParallelism, -(-many // 256)))
    asked = tuple(sorted(materialize(known.repartitionByRange(parts, "question"), "asked-blocks").inputFiles()))
    mean_length = lexical.mean_length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                yield from _answered(asked[i], files, weights, mean_length, k, dense_pool, lexical_pool)

    kind = questions.schema["query_ids"].dataType.simpleString()
    found = spark.range(0, len(asked), 1, len(asked)).mapInArrow(run, f"query_ids {kind}, hits {HITS}")
    return found.select(F.explode("query_ids").alias("query_id"), "hits").select("query_id", F.inline("hits"))


def _answered(file: str, files: tuple[str, ...], weights: Blocks, mean_length: float, k: int, dense_pool: int, lexical_pool: int) -> Iterator[pa.RecordBatch]:
    table = _read(file, ["query_ids", "tokens", "vector", "is_table", "is_image", "anchors"])
    asked, q = table["query_ids"].combine_chunks(), table.drop_columns("query_ids").to_pydict()
    if not len(asked):
        return
    used = {t for tokens in q["tokens"] for t in tokens}
    idf = {t: w for part in weights.read() for t, w in zip(part["term"].to_pylist(), part["idf"].to_pylist()) if t in used}
    place = {t: i for i, t in enumerate(idf)}
    terms = [[(place[t], n * idf[t]) for t, n in Counter(tokens).items() if t in place] for tokens in q["tokens"]]
    typed = np.array([bool(a or b) for a, b in zip(q["is_table"], q["is_image"])])
    words = Worded(terms, np.where(typed, max(lexical_pool, k), k).tolist())
    near = []
    valid = np.array([v is not None for v in q["vector"]])
    for some, most in ((typed & valid, max(dense_pool, 2 * k)), (~typed & valid, 2 * k)):
        rows = np.flatnonzero(some)
        for begin in range(0, len(rows), LEFT):
            own = rows[begin : begin + LEFT]
            v = np.array([q["vector"][i] for i in own], np.float64)
            norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
            near.append(Near(own, v / np.where(norm > 0, norm, 1), most))
    q["vector"] = q["tokens"] = None
    wanted = pa.array(sorted({x for anchors in q["anchors"] for x in anchors}), pa.string())
    where: dict[str, int] = {}
    starts = [0]
    for name in files:
        block, offset = _block(name, place, mean_length), starts[-1]
        for begin in range(0, block.n, RIGHT):
            right = (block.vectors[begin : begin + RIGHT] / block.norms[begin : begin + RIGHT, None]).astype(np.float32)
            for some in near:
                some.add(block, begin, right, offset)
        words.add(block, offset)
        starts.append(offset + block.n)
        del block
        if len(wanted):
            ids = _read(name, ["ids"])["ids"].combine_chunks().flatten()
            at = np.flatnonzero(pc.is_in(ids, wanted).to_numpy(zero_copy_only=False))
            where.update(zip(ids.take(pa.array(at)).to_pylist(), (at + offset).tolist()))
    dense: list = [[]] * len(asked)
    for some in near:
        for row, docs, scores in some.lists():
            dense[row] = list(zip(docs, scores))
    near.clear()
    anchors = [[where[x] for x in a if x in where] for a in q["anchors"]]
    seen = np.unique(np.concatenate([np.fromiter((x for hits in dense for x, _ in hits), np.int64), *words.docs, np.fromiter((x for a in anchors for x in a), np.int64)]))
    kinds: dict[int, str] = {}
    for name, a, b in zip(files, starts, starts[1:]):
        mine = seen[(seen >= a) & (seen < b)]
        kinds.update(zip(mine.tolist(), _read(name, ["types"])["types"].combine_chunks().flatten().take(pa.array(mine - a)).to_pylist()))
    found = []
    for i in range(len(asked)):
        lexical = [(x, min(s / 10, 1.0)) for x, s in zip(words.docs[i].tolist(), words.scores[i].tolist())]
        found.append(finished(dense[i], lexical, anchors[i], kinds, bool(q["is_table"][i]), bool(q["is_image"][i]), k))
        dense[i] = words.docs[i] = words.scores[i] = None
    chosen = np.unique(np.fromiter((x for hits in found for x, _ in hits), np.int64))
    names = []
    for name, a, b in zip(files, starts, starts[1:]):
        names += _read(name, ["ids"])["ids"].combine_chunks().flatten().take(pa.array(chosen[(chosen >= a) & (chosen < b)] - a)).to_pylist()
    named = dict(zip(chosen.tolist(), names))
    kind = pa.list_(pa.struct([("n", pa.int32()), ("chunk_id", pa.string()), ("type", pa.string()), ("score", pa.float64())]))
    for begin in range(0, len(asked), 1_024):
        hits = [[{"n": n, "chunk_id": named[x], "type": kinds[x], "score": s} for n, (x, s) in enumerate(own, 1)] for own in found[begin : begin + 1_024]]
        yield pa.RecordBatch.from_arrays([asked.slice(begin, len(hits)), pa.array(hits, kind)], ["query_ids", "hits"])
