"""Questions to answers to judgments, in batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagewright.functions.predicates import NO_ANSWER_PHRASE, no_answer, no_answer_case
from pagewright.functions.text import preview
from pagewright.operators.evaluation import parse_scores, with_expected
from pagewright.operators.hybrid import search as hybrid_search
from pagewright.operators.lexical import build_index, search_text
from pagewright.operators.vectors import top_k
from pagewright.plans.lineage import materialize
from pagewright.providers import ExtractiveAnswerer, HashEmbedder, OverlapJudge, Provider, applied, asked, cached
from pagewright.sources.store import cache_key


def source_refs(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, sources, context): retrieved chunks in order, and the text shown to the model."""
    rows = hits.join(chunks.select("chunk_id", "doc_id", "page", F.col("content")), "chunk_id")
    ref = F.struct("n", "doc_id", "page", "chunk_id", "type", "score", preview(F.col("content")).alias("preview"), F.col("content").alias("full_content"))
    grouped = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(ref)).alias("sources"))  # at most k a question
    shown = F.transform("sources", lambda s: F.concat(F.lit("["), F.concat_ws("|", s["doc_id"], s["page"].cast("string"), s["chunk_id"], s["type"]), F.lit("]\n"), s["full_content"], F.lit("\n")))
    return grouped.withColumn("context", F.array_join(shown, "\n---\n"))


def embedding_text(content: Column, kind: Column, image_type: Column) -> Column:
    """Text that is embedded: tables with their flattened form, images with their type."""
    flat = F.trim(F.regexp_replace(F.replace(content, F.lit("|"), F.lit(" ")), r"(?U)\s+", " "))
    return F.when((kind == "table") & ~F.contains(content, flat), F.concat(content, F.lit("\n\n"), flat)).when(kind.isin("image_ocr", "image_caption"), F.concat(F.lit("image "), F.coalesce(image_type, kind), F.lit(": "), content)).otherwise(content)


def embed_chunks(chunks: DataFrame, provider: Provider | None = None, cache: str | None = None) -> DataFrame:
    """(chunk_id, vector, doc_id, page, type, content_preview) of the chunks that can be indexed.

    Equal texts are asked for once; with a cache folder, texts that were embedded by the same
    model before are not asked for at all.
    """
    provider = provider or HashEmbedder()
    good = chunks.where("metadata.processing_status = 'success'").where(F.col("content").rlike(r"(?U)\S")).withColumn("text", embedding_text(F.col("content"), F.col("type"), F.col("metadata.image_type")))
    keyed = good.withColumn("key", cache_key(provider.name, F.col("text")))
    vectors = cached(keyed, provider, "key", "text", cache, "vector") if cache else applied(keyed.select("key", "text"), provider, "key", "text", None, "vector")[0]
    return keyed.select("key", "chunk_id", "doc_id", "page", "type", F.substring("content", 1, 100).alias("content_preview")).join(vectors, "key").select("chunk_id", "vector", "doc_id", "page", "type", "content_preview")


def retrieve(questions: DataFrame, chunks: DataFrame, vectors: DataFrame, k: int = 12, hybrid: bool = True, embedder: Provider | None = None) -> DataFrame:
    """(query_id, n, chunk_id, type, score) of the k best chunks of each question (query_id, question).

    The hybrid search is that of ``operators.hybrid``; equal questions are searched for once.
    """
    valid = chunks.where("metadata.processing_status = 'success'")
    embedder = embedder or HashEmbedder()
    if not hybrid:
        asked_vectors = materialize(asked(questions, embedder, "query_id", "question", "vector"), "question-vectors")
        dense = top_k(asked_vectors, vectors.join(valid.select("chunk_id"), "chunk_id", "left_semi"), k).join(valid.select("chunk_id", "type"), "chunk_id")
        return dense.select("query_id", F.col("rank").alias("n"), "chunk_id", "type", "score")
    distinct = materialize(questions.where("question is not null").groupBy("question").agg(F.collect_list("query_id").alias("query_ids")), "questions")
    vectors_asked = asked(distinct.withColumn("query_id", F.col("question")), embedder, "query_id", "question", "vector")
    asked_vectors = distinct.join(materialize(vectors_asked.select(F.col("query_id").alias("question"), "vector"), "question-vectors"), "question")
    texts = valid.select("chunk_id", "type", search_text(F.col("content"), F.col("type"), F.col("metadata.image_type")).alias("text"))
    rows = texts.join(vectors.select("chunk_id", "vector").dropDuplicates(["chunk_id"]), "chunk_id", "left")
    return hybrid_search(asked_vectors, rows, build_index(texts), valid, k, max(10 * k, 50), max(3 * k, 20))


def answer(questions: DataFrame, hits: DataFrame, chunks: DataFrame, provider: Provider | None = None) -> DataFrame:
    """Predictions: (query_id, question, answer, sources, has_answer_pred); no context and failed calls give the fixed phrase or an ERROR row."""
    rows = questions.join(source_refs(hits, chunks), "query_id", "left").withColumn("prompt", F.concat("question", F.lit("\x1f"), F.coalesce("context", F.lit(""))))
    replies = asked(rows.where("context is not null"), provider or ExtractiveAnswerer(), "query_id", "prompt")
    joined = rows.join(replies, "query_id", "left")
    text = F.when(F.col("context").isNull(), NO_ANSWER_PHRASE).when(F.col("error").isNotNull(), F.concat(F.lit("ERROR: "), F.col("error"))).otherwise(F.col("reply"))
    out = joined.withColumn("answer", text)
    return out.select("query_id", "question", "answer", "sources", "context", (~no_answer(F.col("answer")) & F.col("error").isNull() & F.col("context").isNotNull()).alias("has_answer_pred"))


def judge(predictions: DataFrame, dataset: DataFrame, provider: Provider | None = None) -> DataFrame:
    """Judgments with the four scores, the slice and notes, one row per prediction."""
    rows = with_expected(predictions, dataset).withColumn("prompt", F.concat_ws("\x1f", "answer", F.coalesce("expected_answer", F.lit("")), F.coalesce("context", F.lit(""))))
    replies = asked(rows, provider or OverlapJudge(), "query_id", "prompt")
    case = no_answer_case(F.col("slice"), F.lit(True))
    scored = rows.join(replies, "query_id").withColumn("judge", parse_scores(F.coalesce("reply", F.lit("")), case))
    return scored.select("query_id", "question", "answer", "expected_answer", "slice", "judge.*")
