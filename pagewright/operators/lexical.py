"""BM25 over an inverted index held in tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pagewright.functions.predicates import IMAGE_TYPES, image_question, table_question
from pagewright.functions.sql import blanks_split
from pagewright.functions.text import flattened_table
from pagewright.plans.lineage import materialize, written_blocks

#: Fixed values of the public scoring formula.
K1, B, EPSILON = 1.5, 0.75, 0.25


def search_text(content: Column, kind: Column, image_type: Column) -> Column:
    """Text that is indexed: lower case; tables flattened; images with their type in front."""
    return F.when(kind == "table", flattened_table(content)).when(kind.isin(IMAGE_TYPES) & image_type.isNotNull(), F.concat(F.lower(image_type), F.lit(" "), F.lower(content))).otherwise(F.lower(content))


def query_tokens(question: Column) -> Column:
    """Lower-cased words, ``image`` and ``table`` in front where the question asks for them."""
    extra = F.concat(F.when(image_question(question), F.array(F.lit("image"))).otherwise(F.array().cast("array<string>")), F.when(table_question(question), F.array(F.lit("table"))).otherwise(F.array().cast("array<string>")))
    return F.concat(extra, blanks_split(F.lower(question)))


@dataclass
class LexicalIndex:
    terms: DataFrame  # term, idf
    mean_length: float
    texts: DataFrame  # id, text


def build_index(texts: DataFrame, key: str = "chunk_id", text: str = "text") -> LexicalIndex:
    """The index over (key, text): the idf of every term, written to the shared folder, and the mean length.

    Terms in over half of the texts get a quarter of the mean idf instead of a negative one.
    Each text gives a term once, so that counts are added up before they are shuffled.
    """
    words = texts.select(blanks_split(F.col(text)).alias("w")).where("w is not null")
    # The empty word stands for the text itself, so that one pass counts texts, words and terms.
    each = words.select(F.size("w").alias("length"), F.explode(F.concat(F.array_distinct("w"), F.array(F.lit("")))).alias("term"))
    counts = materialize(each.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("term") == "", F.col("length"))).alias("total")), "terms")
    whole = counts.where("term = ''").first()
    n, mean_length = (whole.df, whole.total / whole.df) if whole else (0, 1.0)
    idf = counts.where("term <> ''").select("term", (F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = idf.agg(F.avg("raw")).first()[0] or 0.0
    terms = idf.select("term", F.when(F.col("raw") < 0, EPSILON * mean).otherwise(F.col("raw")).alias("idf"))
    return LexicalIndex(terms, float(mean_length or 1.0), texts.select(F.col(key).alias("id"), F.col(text).alias("text")).where("text is not null"))


#: Questions that are scored at a time, and texts that are multiplied with them at a time.
QUESTION_BLOCK, TEXT_BLOCK = 512, 512
#: Unicode whitespace for an engine whose own class is ASCII.
BLANKS = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


@dataclass
class Tokens:
    """The words of a batch of texts: distinct words, the place of each word of each text, and where texts begin."""

    named: list[str]
    index: np.ndarray
    bounds: np.ndarray
    lengths: np.ndarray


def _tokens(texts: pa.Array) -> Tokens:
    lists = pc.split_pattern_regex(texts.cast(pa.large_string()), BLANKS)
    coded, bounds = lists.flatten().dictionary_encode(), lists.offsets.to_numpy().astype(np.int64)
    named, index = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    filled = np.array([w != "" for w in named] or [False])[index] if len(index) else np.zeros(0, bool)
    return Tokens(named, index, bounds - bounds[0], np.diff(np.concatenate([[0], np.cumsum(filled)])[bounds - bounds[0]]))


@dataclass
class Questions:
    """A block of questions: the place of each term, and weights (terms x questions)."""

    ids: pa.Array
    place: dict[str, int]
    weights: np.ndarray


def _questions(rows: pa.Table) -> Questions:
    ids, terms = rows["query_id"].combine_chunks().dictionary_encode(), rows["term"].combine_chunks().dictionary_encode()
    weights = np.zeros((len(terms.dictionary), len(ids.dictionary)))
    np.add.at(weights, (terms.indices.to_numpy(), ids.indices.to_numpy()), rows["weight"].to_numpy())
    return Questions(ids.dictionary, {t: i for i, t in enumerate(terms.dictionary.to_pylist())}, weights)


def _best(tokens: Tokens, q: Questions, mean_length: float, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, question, score) of what may be among the k best of each question, by blocks of texts."""
    wanted = np.array([q.place.get(w, -1) for w in tokens.named] or [-1])
    for begin in range(0, len(tokens.lengths), TEXT_BLOCK):
        end = min(begin + TEXT_BLOCK, len(tokens.lengths))
        a, b = tokens.bounds[begin], tokens.bounds[end]
        at = wanted[tokens.index[a:b]]
        text = np.repeat(np.arange(end - begin), np.diff(tokens.bounds[begin : end + 1]))[at >= 0]
        used, column = np.unique(at[at >= 0], return_inverse=True)
        if not len(used):
            continue
        counts = np.bincount(text * len(used) + column, minlength=(end - begin) * len(used)).reshape(end - begin, len(used))
        raw = (counts * (K1 + 1) / (counts + (K1 * (1 - B + B * tokens.lengths[begin:end] / mean_length))[:, None])) @ q.weights[used]
        least = np.partition(raw, -k, axis=0)[-k] if len(raw) > k else np.zeros(raw.shape[1])
        row, question = np.nonzero((raw >= least - 1e-5) & (raw > 0))
        yield row + begin, question, raw[row, question]


def _best_of_all(parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """What may be among the k best of each question over all blocks of a batch; scores that tie with the k-th stay."""
    found = list(parts)
    if not found:
        return
    text, question, raw = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((-raw, question))
    text, question, raw = text[order], question[order], raw[order]
    begin = np.flatnonzero(np.concatenate([[True], question[1:] != question[:-1]]))
    size = np.diff(np.concatenate([begin, [len(question)]]))
    kth = raw[begin + np.minimum(k, size) - 1]
    keep = raw >= np.repeat(kth, size) - 1e-5
    yield text[keep], question[keep], raw[keep]


def bm25_top_k(queries: DataFrame, index: LexicalIndex, k: int) -> DataFrame:
    """(query_id, id, score, rank): the k best of positive score, scores over ten cut to one, ties by id.

    The terms of the questions with their weights are written in blocks of questions. The
    texts are read and split once; every task holds a batch of them against one block of
    questions after the other, so that a frequent term costs no row per question and text,
    and only the k best per batch and question are shuffled. Repeated query tokens add again.
    """
    kinds = queries.schema["query_id"].dataType.simpleString(), index.texts.schema["id"].dataType.simpleString()
    asked = queries.select("query_id", F.explode("tokens").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    weights = asked.join(index.terms, "term").select("query_id", "term", (F.col("times") * F.col("idf")).alias("weight"))
    blocks, mean_length = written_blocks(weights, "query_id", QUESTION_BLOCK, "asked-terms"), index.mean_length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = _tokens(batch.column(1))
            for rows in blocks.read():
                q = _questions(rows)
                for text, question, raw in _best_of_all(_best(tokens, q, mean_length, k), k):
                    yield pa.RecordBatch.from_arrays([q.ids.take(pa.array(question)), batch.column(0).take(pa.array(text)), pa.array(raw)], ["query_id", "id", "raw"])

    scored = index.texts.mapInArrow(run, f"query_id {kinds[0]}, id {kinds[1]}, raw double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.round("raw", 6).desc(), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "id", F.least(F.col("raw") / 10, F.lit(1.0)).alias("score"), "rank")
