"""Predicates of the retrieval pipeline as boolean Columns (three-valued where NULL can occur)."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from pagewright.functions.sql import is_blank
from pagewright.functions.text import count_of

IMAGE_TYPES = ["image_ocr", "image_caption"]
#: Fixed value: the answer that stands for no answer.
NO_ANSWER_PHRASE = "В документах нет ответа / недостаточно данных."
#: Parts of answers that mean that there is none.
NO_ANSWER_PARTS = ["нет ответа", "недостаточно данных", "не содержит информации", "не найдено", "no answer", "not found", "insufficient information", "cannot answer", "don't have enough"]
#: Captions that are refusals.
REFUSED_CAPTION = r"(?i)^I cannot\b|^I'm unable\b|^I can't\b|^Sorry,\s+I\b|^I'm sorry\b|unable to (?:analyze|process|view|see)|cannot (?:analyze|process|view|see) (?:this|the) image"
#: Parts of questions about tables, of metrics, and of questions about images.
TABLE_PARTS = ["table", "табл", "таблица", "таб.", "row", "rows", "column", "columns", "cell", "cells", "строка", "строки", "столбец", "столбцы", "колонка", "колонки", "ячейка", "ячейки"]
METRIC_PARTS = ["accuracy", "precision", "recall", "f1", "auc", "bleu", "rouge", "map", "mrr", "top-1", "top-5", "score", "scores", "benchmark", "baseline", "results", "metrics", "dataset", "ablation", "значен", "метрик", "результ", "точност"]
IMAGE_PARTS = ["image", "figure", "fig.", "diagram", "chart", "graph", "рис", "рис.", "диаграм", "схем", "график", "иллюстр", "архитектур"]


def any_part(text: Column, parts: list[str]) -> Column:
    """Contains one of the literals, case aside: one pass of a regular expression."""
    return F.lower(text).rlike("|".join(re.escape(p) for p in sorted(set(parts), key=len)))


def succeeded(status: Column) -> Column:
    return F.coalesce(status == "success", F.lit(False))


def indexable(content: Column, status: Column) -> Column:
    """Non-blank and processed with success."""
    return succeeded(status) & ~is_blank(content)


def ocr_failed(confidence: Column, chars: Column, words: Column, alpha: Column) -> Column:
    return (confidence < 60) | (chars < 50) | (words < 10) | (alpha < 0.4)


def ocr_catastrophic(chars: Column, words: Column, alpha: Column) -> Column:
    """Hopeless, or never recognised (NULL)."""
    return chars.isNull() | words.isNull() | alpha.isNull() | (chars < 30) | (words < 5) | (alpha < 0.20)


def ocr_strong(chars: Column, words: Column, alpha: Column) -> Column:
    return F.coalesce((chars >= 120) & (words >= 30) & (alpha >= 0.45), F.lit(False))


def ocr_blank(chars: Column, words: Column) -> Column:
    return F.coalesce((chars == 0) & (words == 0), F.lit(False))


def uniform_image(entropy: Column, deviation: Column) -> Column:
    return F.coalesce((entropy <= 0.5) & (deviation <= 5.0), F.lit(False))


def tiny_image(width: Column, height: Column) -> Column:
    return (F.greatest(width, height) <= 48) | (width * height <= 2304)


def usable_caption(caption: Column) -> Column:
    """The caption, or NULL where it is a refusal."""
    return F.when(~caption.rlike(REFUSED_CAPTION), caption)


def low_information_caption(caption: Column) -> Column:
    c = F.lower(F.regexp_replace(caption, r"(?U)^\s+|\s+$", ""))
    tokens = F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""))
    return is_blank(caption) | (c == "unreadable") | (c.startswith("unreadable") & (F.length(c) < 120)) | ((F.length(c) < 12) & ~c.rlike(r"\d") & (tokens <= 2))


def table_question(question: Column) -> Column:
    return any_part(question, TABLE_PARTS) | (question.rlike(r"[\d%]") & any_part(question, METRIC_PARTS))


def image_question(question: Column) -> Column:
    return any_part(question, IMAGE_PARTS)


def no_answer(answer: Column) -> Column:
    return any_part(answer, [NO_ANSWER_PHRASE.lower(), *NO_ANSWER_PARTS])


def looks_like_table(text: Column) -> Column:
    digits = F.length(F.regexp_replace(text, r"[^0-9]", ""))
    return F.lower(text).rlike("table|табл") | text.contains("|") | text.rlike(r"\S {2,}\S+(?: \S+)* {2,}\S") | ((digits >= 12) & (digits >= 0.05 * F.length(text)))


def clean_text(content: Column, status: Column, kind: Column) -> Column:
    """Text chunks good enough to ask questions about."""
    body = F.regexp_replace(content, r"(?U)^\s+|\s+$", "")
    return F.coalesce(succeeded(status) & (kind == "text") & ~F.lower(content).contains("unreadable") & (F.length(body) >= 200) & (count_of(body, "|") <= 0.01 * F.length(body)), F.lit(False))


def answer_in_content(expected: Column, content: Column, strict: bool) -> Column:
    """Verbatim, case aside; not strict: or two tokens of more than three characters, repeated ones counting again."""
    e, c = F.lower(F.trim(expected)), F.lower(content)
    verbatim = (F.length(e) > 0) & F.contains(c, e)
    if strict:
        return F.coalesce(verbatim, F.lit(False))
    tokens = F.filter(F.split(e, r"(?U)\W+"), lambda t: (F.length(t) > 3) & F.contains(c, t))
    return F.coalesce(verbatim | (F.size(tokens) >= 2), F.lit(False))


def no_answer_case(slice_: Column, has_answer: Column) -> Column:
    return (slice_ == "no-answer") | ~has_answer


def judged_well(notes: Column) -> Column:
    """The notes report no error."""
    return ~F.coalesce(F.lower(notes).contains("error"), F.lit(False))
