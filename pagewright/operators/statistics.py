"""Counts and rates over chunks, documents and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pagewright.functions.text import word_count
from pagewright.schemas import CHUNK_TYPES


def plain_type(kind: Column) -> Column:
    """The chunk type in one spelling; NULL and blank count as text."""
    return F.coalesce(F.nullif(F.regexp_replace(F.lower(F.trim(kind)), r"[\s-]+", "_"), F.lit("")), F.lit("text"))


def parse_time(text: Column) -> Column:
    """A timestamp from ISO text with Z or an offset; NULL if unreadable."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))


def latest_rows(chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """One row per key: the last ingested, of equal ones the greatest content."""
    n = F.row_number().over(W.partitionBy(key).orderBy(parse_time(F.col("metadata.ingest_ts")).desc_nulls_last(), F.col("content").desc_nulls_last(), F.col("doc_id").desc_nulls_last()))
    return chunks.withColumn("_n", n).where("_n = 1").drop("_n")


def type_counts(chunks: DataFrame, by: str = "doc_id") -> DataFrame:
    """Chunks of each type per document."""
    kind = plain_type(F.col("type"))
    return chunks.groupBy(by).agg(*(F.count_if(kind == t).alias(t) for t in CHUNK_TYPES))


def image_rates(chunks: DataFrame) -> DataFrame:
    """Per document: share of images whose recognition failed and share that vision described; 0 without images."""
    kind, m = plain_type(F.col("type")), F.col("metadata")
    image = F.regexp_extract("chunk_id", r"_i(\d+)_", 1)
    n = F.count_distinct(F.when(kind.isin("image_ocr", "image_caption"), image))
    failed = F.count_if((kind == "image_ocr") & m["ocr_failed"])
    seen = F.count_if((kind == "image_caption") & m["vision_used"])
    rate = lambda x: F.round(F.coalesce(F.try_divide(x.cast("double"), n.cast("double")), F.lit(0.0)), 4)
    total_failures = F.count_if(kind.isin("image_ocr", "image_caption") & (m["processing_status"] == "failed"))
    return chunks.groupBy("doc_id").agg(n.alias("images"), rate(failed).alias("ocr_failure_rate"), rate(seen).alias("vision_rate"), rate(total_failures).alias("failed_rate"))


def document_statistics(chunks: DataFrame) -> DataFrame:
    """One row over everything: documents, chunks by type, failed recognitions and vision calls, with percentages."""
    kind, m = plain_type(F.col("type")), F.col("metadata")
    share = lambda x: F.round(F.coalesce(F.try_divide(100.0 * x, F.count_if(kind.isin("image_ocr", "image_caption"))), F.lit(0.0)), 2)
    failed, seen = F.count_if(m["ocr_failed"]), F.count_if(m["vision_used"])
    return chunks.agg(F.count_distinct(F.coalesce("doc_id", F.lit(""))).alias("documents"), F.count("*").alias("chunks"), *(F.count_if(kind == t).alias(t) for t in CHUNK_TYPES), failed.alias("ocr_failed"), seen.alias("vision_used"), share(failed).alias("ocr_failed_pct"), share(seen).alias("vision_pct"))


def page_coverage(elements: DataFrame, total_pages: DataFrame | None = None, page_chars: int = 200, least_share: float = 0.6, least_chars: int = 1500) -> DataFrame:
    """Per document: characters, share of pages with enough of them, and whether the text is accepted."""
    pages = elements.groupBy("doc_id", "page").agg(F.sum(F.coalesce(F.length(F.trim(F.regexp_replace("content", r"(?U)^\s+|\s+$", ""))), F.lit(0))).alias("chars"))
    docs = pages.groupBy("doc_id").agg(F.sum("chars").alias("chars"), F.count_if(F.col("chars") >= page_chars).alias("full_pages"), F.max("page").alias("pages"))
    if total_pages is not None:
        docs = docs.drop("pages").join(total_pages, "doc_id", "left")
    share = F.col("full_pages") / F.greatest(F.coalesce("pages", F.lit(1)), F.lit(1))
    return docs.withColumn("coverage", F.round(share, 4)).withColumn("accepted", (share >= least_share) & (F.col("chars") >= least_chars))


def candidate_pages(elements: DataFrame, is_table: Column) -> DataFrame:
    """Pages with a block that looks like a table, or all pages of documents that have none."""
    pages = elements.groupBy("doc_id", "page").agg(F.bool_or(is_table).alias("hit"))
    none = ~F.bool_or("hit").over(W.partitionBy("doc_id"))
    return pages.withColumn("none", none).where(F.col("hit") | F.col("none")).select("doc_id", "page")


def joined_words(words: DataFrame) -> DataFrame:
    """Recognition result per image from its words: text in order and mean confidence of words with text and confidence above 0."""
    good = (F.trim("text") != "") & (F.col("conf") > 0)
    rows = words.groupBy("image_hash").agg(F.avg(F.when(good, F.col("conf"))).alias("confidence"), F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.trim("text") != "", F.struct("pos", "text")))), lambda s: s["text"]), " ").alias("text"))
    return rows.select("image_hash", "text", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), word_count(F.col("text")).alias("word_count"), F.length("text").alias("char_count"))


def stage_percentiles(timing: DataFrame, stage: str = "stage", duration: str = "duration_ms") -> DataFrame:
    """Calls, p50, p90 and mean of the duration of each stage."""
    p = F.percentile(F.col(duration).cast("double"), F.array(F.lit(0.5), F.lit(0.9)))
    return timing.groupBy(stage).agg(F.count("*").alias("calls"), F.round(p[0], 4).alias("p50"), F.round(p[1], 4).alias("p90"), F.round(F.avg(duration), 4).alias("mean"))


def content_fingerprint(rows: DataFrame, *columns: str) -> DataFrame:
    """One row: number of rows and a sum of their hashes that no order of rows changes."""
    part = F.conv(F.substring(F.md5(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in columns))), 1, 12), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count("*").alias("rows"), F.sum(part).cast("string").alias("fingerprint"))


def needs_evaluation(datasets: DataFrame, runs: DataFrame) -> DataFrame:
    """Adds needs_eval: the data set has a hash, and no run or a run on another hash."""
    joined = datasets.join(runs.select("dataset_path", F.col("dataset_hash").alias("run_hash")), "dataset_path", "left")
    return joined.withColumn("needs_eval", F.col("dataset_hash").isNotNull() & ~F.col("dataset_hash").eqNullSafe(F.col("run_hash")))


def matching_run(meta: DataFrame, runs: DataFrame) -> DataFrame:
    """For each data set the newest run on its chunks hash and its own hash."""
    hit = meta.join(runs, ["chunks_hash", "dataset_hash"], "left")
    return hit.groupBy(*meta.columns).agg(F.max_by("run_id", "mtime").alias("run_id"))
