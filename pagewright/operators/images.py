"""Routing of images: features in Arrow batches, decisions in Catalyst."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.functions import pandas_udf

from pagewright.functions.predicates import ocr_blank, ocr_catastrophic, ocr_failed, tiny_image, uniform_image
from pagewright.operators.tables import split_table

#: ``least_side`` is the shorter side of the image as it is classified, at most 512 pixels long.
FEATURES = "width int, height int, least_side int, diversity double, contrast double, edge_ratio double, line_density double, entropy double, deviation double, ahash string"
#: Fixed values of the classification: longest side, pixels looked at for edges, and steps of gray that make an edge and a line.
LONGEST, SAMPLED, EDGE, LINE, PEAK = 512, 5000, 30, 50, 0.3


def _weights(size: int, old: int, reach: float) -> np.ndarray:
    """Weights (size x old) of a triangle filter that widens with the reduction, so that every pixel counts."""
    scale = old / size
    wide = max(scale, 1.0)
    centre = (np.arange(size) + 0.5) * scale
    away = np.abs((np.arange(old)[None, :] + 0.5 - centre[:, None]) / wide)
    if reach == 1.0:
        w = np.maximum(1.0 - away, 0.0)
    else:  # a cubic with a = -0.5
        w = np.where(away < 1, (1.5 * away - 2.5) * away**2 + 1, np.where(away < 2, ((-0.5 * away + 2.5) * away - 4) * away + 2, 0.0))
    return w / w.sum(1, keepdims=True)


def resized(gray: np.ndarray, height: int, width: int, reach: float = 1.0) -> np.ndarray:
    """Antialiased scaling, linear (reach 1) or cubic (reach 2), along rows first; gray steps are whole in between."""
    whole = lambda a: np.clip(np.floor(a + 0.5), 0, 255)
    across = whole(gray @ _weights(width, gray.shape[1], reach).T) if gray.shape[1] != width else gray
    return whole(_weights(height, gray.shape[0], reach) @ across) if gray.shape[0] != height else across


def gray_features(gray: np.ndarray) -> tuple:
    """Features of a gray image (height x width of 0..255).

    Edges and lines are counted over every so many-th pixel inside the border, at most about
    ``SAMPLED`` of them: a pixel is an edge if it differs from its left or upper neighbour.
    """
    height, width = gray.shape
    small = gray
    if max(height, width) > LONGEST:
        ratio = LONGEST / max(height, width)
        small = resized(gray, max(1, int(height * ratio)), max(1, int(width * ratio)))
    h, w = small.shape
    at = np.arange(0, h * w, max(1, h * w // min(SAMPLED, h * w)))
    x, y = at % w, at // w
    inside = (x > 0) & (x < w - 1) & (y > 0) & (y < h - 1)
    x, y = x[inside], y[inside]
    across, down = np.abs(small[y, x] - small[y, x - 1]), np.abs(small[y, x] - small[y - 1, x])
    n = len(x)
    edges = float(((across > EDGE) | (down > EDGE)).sum() / n) if n else 0.0
    peaks = (np.bincount(y[down > LINE], minlength=h) > n / h * PEAK).sum() + (np.bincount(x[across > LINE], minlength=w) > n / w * PEAK).sum()
    square = resized(gray, 128, 128, 2.0)
    share = np.bincount(square.astype(int).ravel(), minlength=256) / square.size
    entropy = -sum(p * math.log2(p) for p in share if p > 0)
    cells = resized(gray, 8, 8, 2.0).ravel()
    bits = "".join("1" if c >= cells.mean() else "0" for c in cells)
    return width, height, min(h, w), len(np.unique(small)) / 256, float(small.std()) / 255, edges, float(peaks / (h + w)), float(entropy), float(square.std()), f"{int(bits, 2):016x}"


def _feature_frame(width: pd.Series, height: pd.Series, pixels: pd.Series) -> pd.DataFrame:
    rows = []
    for w, h, p in zip(width, height, pixels):
        ok = p is not None and w and h and len(p) == int(w) * int(h)
        rows.append(gray_features(np.frombuffer(p, np.uint8).reshape(int(h), int(w)).astype(float)) if ok else (None,) * 10)
    return pd.DataFrame(rows, columns=[x.split(" ")[0] for x in FEATURES.split(", ")])


def raw_gray_features(width: Column, height: Column, pixels: Column) -> Column:
    """Features of raw 8-bit gray pixels as a struct; NULLs where the size does not fit the bytes."""
    return pandas_udf(_feature_frame, FEATURES)(width, height, pixels)


def image_class(f: Column) -> Column:
    """An ordered list of rules over the features; chart by default and without features."""
    d, c, e, n = f["diversity"], f["contrast"], f["edge_ratio"], f["line_density"]
    return (
        F.when(f["least_side"] < 20, "text_scan")
        .when((d < 0.08) & (e < 0.15) & (c > 0.3), "text_scan")
        .when((d < 0.12) & (e >= 0.15) & (e < 0.30) & (n > 0.1), "table_scan")
        .when(d >= 0.35, "photo")
        .when((d >= 0.08) & (d < 0.40) & (e >= 0.25), "diagram")
        .when((d >= 0.08) & (d < 0.35) & (e >= 0.20), "chart")
        .otherwise("chart")
    )


def low_information(images: DataFrame, least_repeats: int = 3) -> DataFrame:
    """(doc_id, image_index): tiny images, and small ones whose average hash recurs in their document."""
    tiny = images.where(tiny_image(F.col("width"), F.col("height"))).select("doc_id", "image_index")
    small = images.where(~tiny_image(F.col("width"), F.col("height")) & (F.greatest("width", "height") <= 200))
    again = small.groupBy("doc_id", "ahash").agg(F.count("*").alias("n")).where(F.col("n") >= least_repeats)
    return tiny.unionByName(small.join(again, ["doc_id", "ahash"], "left_semi").select("doc_id", "image_index")).distinct()


def route(images: DataFrame) -> DataFrame:
    """Adds needs_vision and skip_reason. Input: image_type, low_info, confidence, char_count, word_count, alpha_ratio, entropy, deviation.

    Decided before any model is called, so that only rows with needs_vision reach the
    provider. Low-information images with hopeless recognition are skipped for every type,
    repeated ones included.
    """
    hopeless = ocr_catastrophic(F.col("char_count"), F.col("word_count"), F.col("alpha_ratio"))
    failed = F.coalesce(ocr_failed(F.col("confidence"), F.col("char_count"), F.col("word_count"), F.col("alpha_ratio")), F.lit(True))
    empty = ocr_blank(F.col("char_count"), F.col("word_count")) & uniform_image(F.col("entropy"), F.col("deviation"))
    scan = F.col("image_type").isin("text_scan", "table_scan")
    reason = (
        F.when(F.col("low_info") & hopeless, "low-info catastrophic OCR")
        .when(scan & ~(failed & hopeless), "OCR sufficient")
        .when(empty, "blank/uniform")
        .when(~scan & F.col("low_info"), "low-info")
    )
    return images.withColumn("skip_reason", reason).withColumn("needs_vision", reason.isNull())


def image_chunks(images: DataFrame) -> DataFrame:
    """Chunks of each image: its caption and its recognised text as far as there are any, else a row of failure.

    Input: doc_id, page, image_index, image_type, text, caption, ocr_failed, catastrophic,
    skip_reason, ocr_reason. Visual types give the caption first; scans give the text, and
    the caption only where recognition failed; the text of a scanned table is cut like a
    table. Text that is hopeless is kept with the status of a failure.
    """
    has_text, has_caption = F.coalesce(F.trim("text") != "", F.lit(False)), F.coalesce(F.trim("caption") != "", F.lit(False))
    failed, hopeless = F.coalesce("ocr_failed", F.lit(True)), F.coalesce("catastrophic", F.lit(False))
    scan, table = F.col("image_type").isin("text_scan", "table_scan"), F.col("image_type") == "table_scan"
    name = lambda s: F.concat("doc_id", F.lit("_p"), F.col("page").cast("string"), F.lit("_i"), F.col("image_index").cast("string"), s)
    null = F.lit(None).cast("string")

    def row(suffix: Column, kind: str, content: Column, status: Column, ocr: Column, vision: Column, ocr_error: Column, vision_error: Column, source: Column = null) -> Column:
        fields = {"chunk_id": name(suffix), "type": F.lit(kind), "content": content, "processing_status": status, "ocr_failed": ocr, "vision_used": vision, "ocr_error": ocr_error, "vision_error": vision_error, "table_source": source}
        return F.struct(*(c.alias(n) for n, c in fields.items()))

    yes, no = F.lit(True), F.lit(False)
    status, ocr_error = F.when(hopeless, "failed").otherwise("success"), F.when(hopeless, "catastrophic_ocr")
    no_vision = F.when(~has_caption & ~scan, F.coalesce("skip_reason", F.lit("no caption, recognised text instead")))
    text = F.when(has_text, row(F.lit("_ocr"), "image_ocr", F.col("text"), status, failed, no, ocr_error, no_vision))
    caption = F.when(has_caption & (~scan | failed | (table & has_text)), row(F.lit("_cap"), "image_caption", F.col("caption"), F.lit("success"), F.when(scan, failed).otherwise(no), yes, null, null))
    parts = F.transform(split_table(F.col("text")), lambda t, i: row(F.concat(F.lit("_table"), F.when(i > 0, F.concat(F.lit("_"), i.cast("string"))).otherwise("")), "table", t, status, failed, no, ocr_error, null, F.lit("ocr")))
    made = F.when(table & has_text, F.concat(parts, F.array_compact(F.array(caption)))).otherwise(F.array_compact(F.when(scan, F.array(text, caption)).otherwise(F.array(caption, text))))
    lost = F.concat(F.lit("[Image processing failed: "), F.col("image_type"), F.lit(" on page "), F.col("page").cast("string"), F.lit("]"))
    no_text = F.when(failed, F.coalesce("ocr_reason", F.lit("recognition failed"))).otherwise("no text recognised")
    lose = lambda kind: F.array(row(F.lit("_fail"), kind, lost, F.lit("failed"), failed, no, no_text, F.coalesce("skip_reason", F.lit("no caption"))))
    rows = images.withColumn("c", F.explode(F.when(F.size(made) > 0, made).when(scan, lose("image_ocr")).otherwise(lose("image_caption"))))
    return rows.select(*(c for c in images.columns if c != "ocr_failed"), "c.*")


def clean_caption(caption: Column) -> Column:
    """Lines without blanks, step markers and rules; the caption itself if nothing is left."""
    lines = F.filter(F.transform(F.split(caption, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~F.lower(x).rlike(r"^step [12]|^rules"))
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(caption)


def once_per_document(images: DataFrame) -> DataFrame:
    """Adds first_index: the first image of the document with the same hash, whose result the others share."""
    return images.withColumn("first_index", F.min("image_index").over(W.partitionBy("doc_id", "image_hash")))
