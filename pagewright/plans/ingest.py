"""Ingestion: elements to linked chunks, registry rows and error rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from pagewright.functions.predicates import low_information_caption, ocr_catastrophic, ocr_failed, usable_caption
from pagewright.functions.text import alnum_ratio, failure_reason, word_count
from pagewright.operators.chunking import chunk_texts, link_chunks, name_pieces
from pagewright.operators.images import clean_caption, image_chunks, image_class, low_information, raw_gray_features, route
from pagewright.operators.parsing import ordered_elements
from pagewright.operators.statistics import image_rates, type_counts
from pagewright.operators.tables import attach_captions, distinct_tables, page_captions, split_table
from pagewright.plans.lineage import materialize
from pagewright.providers import Provider, StatisticsCaptioner, StoredRecognizer, applied
from pagewright.schemas import METADATA_DDL


def text_and_table_chunks(elements: DataFrame, size: int = 400, overlap: int = 50) -> DataFrame:
    """(doc_id, page, chunk_id, type, content, prev_chunk_id, next_chunk_id) of ordered text and table elements.

    Elements are (doc_id, page, elem_idx, type, content).
    """
    ordered = ordered_elements(elements)
    at = ordered.select("doc_id", "page", "seq", "type", "content").withColumnRenamed("seq", "elem_idx")
    text = name_pieces(chunk_texts(at.where("type = 'text'"), size, overlap), "text")
    captioned = attach_captions(distinct_tables(at.where("type = 'table'")), page_captions(at.where("type = 'text'")))
    tables = captioned.select("doc_id", "page", "elem_idx", F.posexplode(split_table(F.col("content"), min(400, size // 2))).alias("piece_idx", "content"))
    columns = ["doc_id", "page", "elem_idx", "piece_idx", "content", "type", "chunk_id"]
    both = text.select(*columns).unionByName(name_pieces(tables, "table").select(*columns))
    return link_chunks(both, ["elem_idx", "piece_idx"]).drop("elem_idx", "piece_idx")


def recognized_images(images: DataFrame, recognizer: Provider | None = None, captioner: Provider | None = None) -> tuple[DataFrame, DataFrame]:
    """Images with what recognition and vision said of them, and (doc_id, page, element_type, error) of failed calls.

    Input: doc_id, page, image_index, width, height, pixels (raw gray), recognised (what the
    recogniser gets). Equal pixels are recognised and described once, whatever documents
    they are in; only images that routing sends to vision are described.
    """
    rows = images.withColumn("image_hash", F.md5("pixels")).withColumn("f", raw_gray_features(F.col("width"), F.col("height"), F.col("pixels")))
    rows = rows.withColumn("image_type", image_class(F.col("f"))).select("*", F.col("f.ahash").alias("ahash"), F.col("f.entropy").alias("entropy"), F.col("f.deviation").alias("deviation")).drop("pixels", "f")
    rows = materialize(rows, "images")
    low = low_information(rows).withColumn("low_info", F.lit(True))
    read, asked_ocr = applied(rows.select("image_hash", "recognised"), recognizer or StoredRecognizer(), "image_hash", "recognised", None, "ocr")
    measured = rows.join(low, ["doc_id", "image_index"], "left").fillna(False, ["low_info"]).join(read, "image_hash", "left")
    text = F.coalesce("ocr.text", F.lit(""))
    measured = measured.withColumns({"text": text, "confidence": F.col("ocr.confidence"), "char_count": F.when(F.col("ocr").isNotNull(), F.length(text)), "word_count": F.when(F.col("ocr").isNotNull(), word_count(text)), "alpha_ratio": F.when(F.col("ocr").isNotNull(), alnum_ratio(text))}).drop("ocr")
    sizes = [F.col(c) for c in ("confidence", "char_count", "word_count", "alpha_ratio")]
    routed = route(measured).withColumns({"ocr_failed": F.coalesce(ocr_failed(*sizes), F.lit(True)), "catastrophic": ocr_catastrophic(*sizes[1:]), "ocr_reason": failure_reason(*sizes)})
    routed = materialize(routed, "routed-images")
    seen = routed.where("needs_vision").select("image_hash", F.concat_ws(" ", F.lit("type"), "image_type", F.lit("text"), "text").alias("shown"))
    captions, asked_vision = applied(seen, captioner or StatisticsCaptioner(), "image_hash", "shown", None, "caption")
    told = clean_caption(usable_caption(F.col("caption")))
    captions = captions.select("image_hash", F.when(~low_information_caption(told), told).alias("caption"))
    out = routed.join(captions, "image_hash", "left").withColumn("caption", F.when(F.col("needs_vision"), F.col("caption")))
    failed = asked_ocr.select("image_hash", "error").unionByName(asked_vision.select("image_hash", "error")).where("error is not null")
    return out, failed.join(rows.select("image_hash", "doc_id", "page"), "image_hash").select("doc_id", "page", F.lit("image").alias("element_type"), "error")


@dataclass
class Ingested:
    chunks: DataFrame
    registry: DataFrame
    errors: DataFrame


def ingest(elements: DataFrame, images: DataFrame, recognizer: Provider | None = None, captioner: Provider | None = None, size: int = 400, overlap: int = 50) -> Ingested:
    """Everything that a set of parsed documents gives: linked chunks of text, tables and images, registry rows and error rows.

    Every image comes out as at least one chunk, be it one of failure. Documents are
    independent of each other, and equal images are processed once.
    """
    pictures, errors = recognized_images(images, recognizer, captioner)
    errors = materialize(errors.distinct(), "ingest-errors").withColumn("ts", F.current_timestamp()).withColumn("traceback", F.lit(None).cast("string"))
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    plain = text_and_table_chunks(elements, size, overlap).withColumn("processing_status", F.lit("success"))
    drawn = image_chunks(pictures).select("doc_id", "page", "chunk_id", "type", "content", "processing_status", "image_hash", "image_type", F.when(F.col("type") != "image_caption", F.col("confidence")).alias("ocr_confidence"), "ocr_failed", F.when(F.col("ocr_failed"), F.col("ocr_reason")).alias("ocr_failed_reason"), "vision_used", "vision_error", "ocr_error", "table_source")
    both = plain.unionByName(drawn, allowMissingColumns=True).withColumn("ingest_ts", now)
    fields = [f.split(":") for f in METADATA_DDL.removeprefix("struct<").removesuffix(">").split(", ")]
    metadata = F.struct(*((F.col(n.strip()) if n.strip() in both.columns else F.lit(None)).cast(kind.strip()).alias(n.strip()) for n, kind in fields))
    chunks = materialize(both.select("doc_id", "page", "chunk_id", "type", "content", metadata.alias("metadata")), "ingested-chunks")
    return Ingested(chunks, registry_rows(chunks, errors), errors)


def registry_rows(chunks: DataFrame, errors: DataFrame) -> DataFrame:
    """(doc_id, pages, counts by type, rates, errors) of ingested documents."""
    counted = type_counts(chunks).join(image_rates(chunks), "doc_id").join(chunks.groupBy("doc_id").agg(F.max("page").alias("pages")), "doc_id")
    failed = errors.groupBy("doc_id").agg(F.count("*").alias("errors"))
    return counted.join(failed, "doc_id", "left").fillna(0, ["errors"])


def reingest(chunks: DataFrame, new: DataFrame, policy: str = "new_version") -> DataFrame:
    """Chunks after another ingestion: ``overwrite`` replaces the documents of ``new``, ``new_version`` gives those that exist a version mark.

    A later version has ``_v2`` and so on after its doc_id, by the versions that exist.
    """
    if policy == "overwrite":
        return chunks.join(new.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(new)
    base = F.regexp_extract("doc_id", r"^(.*?)(?:_v\d+)?$", 1)
    version = F.coalesce(F.nullif(F.regexp_extract("doc_id", r"_v(\d+)$", 1), F.lit("")).cast("int"), F.lit(1))
    have = chunks.groupBy(base.alias("base")).agg(F.max(version).alias("have"))
    marked = new.withColumn("base", F.col("doc_id")).join(have, "base", "left")
    renamed = F.when(F.col("have").isNotNull(), F.concat("doc_id", F.lit("_v"), (F.col("have") + 1).cast("string"))).otherwise(F.col("doc_id"))
    # Identifiers begin with the document's, so they move with it.
    moved = lambda c: F.when(F.col(c).startswith(F.col("base")), F.concat(F.col("_doc"), F.substring(F.col(c), F.length("base") + 1, F.length(c)))).otherwise(F.col(c))
    out = marked.withColumn("_doc", renamed)
    for c in ("chunk_id", "prev_chunk_id", "next_chunk_id"):
        if c in new.columns:
            out = out.withColumn(c, moved(c))
    return chunks.unionByName(out.withColumn("doc_id", F.col("_doc")).select(*new.columns))


def missing_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks that can be indexed but have no vector: what a new run has to embed."""
    return chunks.where("metadata.processing_status = 'success'").where(F.col("content").rlike(r"(?U)\S")).join(vectors.select("chunk_id"), "chunk_id", "left_anti")
