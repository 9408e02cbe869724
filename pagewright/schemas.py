"""Schemas of the engine's tables."""

from __future__ import annotations

CHUNK_TYPES = ["text", "table", "image_ocr", "image_caption"]
SLICES = ["overall", "table", "image", "no-answer"]


def ddl(text: str) -> str:
    """A schema in one line."""
    return " ".join(text.split())


METADATA_DDL = ddl("""struct<source_path: string, bbox: array<double>, image_hash: string, image_type: string, ocr_confidence: double, ocr_failed: boolean,
    ocr_failed_reason: string, vision_used: boolean, processing_status: string, vision_error: string, ocr_error: string, table_source: string,
    prev_chunk_id: string, next_chunk_id: string, ingest_ts: string>""")
CHUNKS = f"doc_id string, page int, chunk_id string, type string, content string, metadata {METADATA_DDL}"
ELEMENTS = "doc_id string, elem_idx int, type string, content string, page int, image_path string, bbox array<double>"
REGISTRY = "doc_id string, filename string, filepath string, pages int, chunks struct<text: int, table: int, image_ocr: int, image_caption: int>, ocr_failure_rate double, vision_fallback_rate double, errors int, parse_failed boolean, ingest_ts timestamp"
ERROR_LOG = "ts timestamp, doc_id string, page int, element_type string, error string, traceback string"
TIMING = "run_id string, pdf_path string, stage string, duration_ms bigint, timestamp timestamp"
DATASET = "question string, slice string, has_answer boolean, expected_answer string, doc_id string"
SOURCE_REF = "struct<doc_id: string, page: int, chunk_id: string, type: string, score: double, preview: string, full_content: string>"
PREDICTIONS = f"question string, answer string, sources array<{SOURCE_REF}>, retrieved_chunks array<{SOURCE_REF}>, slice string, has_answer_pred boolean"
SCORES = "struct<faithfulness: double, relevancy: double, context_precision: double, context_recall: double, no_answer_correct: boolean, notes: string>"
JUDGMENTS = f"question string, answer string, expected_answer string, judge {SCORES}"
VECTORS = "chunk_id string, vector array<float>, doc_id string, page int, type string, content_preview string"
OCR_RESULTS = "image_hash string, text string, confidence double, word_count int, char_count int, alpha_ratio double"
REPORT = "slice string, faithfulness double, relevancy double, context_precision double, context_recall double, no_answer_accuracy double, false_positive_rate double, count bigint, scope string"
IMAGES = "doc_id string, page int, image_index int, width int, height int, pixels binary, recognised string"
