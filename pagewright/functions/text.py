"""Scalar functions over text, each a Column expression that stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pagewright.functions.sql import blanks_split

BREAK = "\ue000"  # stands for a paragraph break while lines are joined


def normalize_text(text: Column, legacy_whitespace: bool = False) -> Column:
    """Paragraphs kept, line ends joined, torn words closed, digits and letters spaced apart.

    ``legacy_whitespace`` also turns each lower-case ``t`` and backslash into a space, for
    comparison with indexes that were built that way.
    """
    steps = [
        (r"(?U)\n\s*\n", BREAK),
        (r"(?U)(?<=\w)-\n(?=[a-zа-я])", ""),
        (r"\n+", " "),
        (r"(?U)(?<=[A-Za-zА-Яа-я])(?=\d)", " "),
        (r"(?U)(?<=\d)(?=[A-Za-zА-Яа-я])", " "),
        (r"(?<=[a-zа-я])(?=[A-ZА-Я])", " "),
        (r"[ \\t]+" if legacy_whitespace else r"[ \t]+", " "),
    ]
    for pattern, put in steps:
        text = F.regexp_replace(text, pattern, put)
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), BREAK, "\n\n")


def split_blocks(text: Column) -> Column:
    """Normalised text cut at blank lines; trimmed, without empty blocks."""
    blocks = F.transform(F.split(normalize_text(text), r"(?U)\n\s*\n"), lambda b: F.regexp_replace(b, r"(?U)^\s+|\s+$", ""))
    return F.filter(blocks, lambda b: b != "")


def alnum_ratio(text: Column) -> Column:
    """Share of letters and digits; 0 for empty and NULL text."""
    n = F.length(text).cast("double")
    return F.when(F.coalesce(n, F.lit(0.0)) > 0, F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", "")) / n).otherwise(0.0)


def word_count(text: Column) -> Column:
    """Whitespace-separated words; 0 for NULL."""
    return F.coalesce(F.size(blanks_split(text)), F.lit(0))


def failure_reason(confidence: Column, chars: Column, words: Column, alpha: Column, limits: tuple[float, int, int, float] = (60.0, 50, 10, 0.4)) -> Column:
    """What fell short of the limits, joined by ``; ``; NULL if nothing did."""
    c, n, w, a = limits
    parts = [
        F.when(confidence < c, F.concat(F.lit("confidence="), F.format_string("%.1f", F.round(confidence, 1)), F.lit(f"<{c:g}"))),
        F.when(chars < n, F.concat(F.lit("chars="), chars.cast("string"), F.lit(f"<{n}"))),
        F.when(words < w, F.concat(F.lit("tokens="), words.cast("string"), F.lit(f"<{w}"))),
        F.when(alpha < a, F.concat(F.lit("alpha_ratio="), F.format_string("%.2f", F.round(alpha, 2)), F.lit(f"<{a:g}"))),
    ]
    return F.nullif(F.concat_ws("; ", *parts), F.lit(""))


def redact_secrets(text: Column) -> Column:
    return F.regexp_replace(text, r"sk-(?:proj-)?[A-Za-z0-9_\-]{10,}", "sk-***")


def duration_label(seconds: Column) -> Column:
    """``M:SS`` of whole seconds; negative counts as 0."""
    s = F.greatest(seconds.cast("long"), F.lit(0))
    return F.format_string("%d:%02d", F.floor(s / 60).cast("long"), (s % 60).cast("long"))


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def preview(text: Column, words: int = 20) -> Column:
    """The first words, with ``...`` if there are more."""
    w = blanks_split(text)
    return F.concat(F.array_join(F.slice(w, 1, words), " "), F.when(F.size(w) > words, "...").otherwise(""))


def flattened_table(text: Column) -> Column:
    """Lower case, pipes as spaces, single spaces, ``table`` in front."""
    flat = F.trim(F.regexp_replace(F.replace(F.lower(text), F.lit("|"), F.lit(" ")), r"(?U)\s+", " "))
    return F.when(flat.startswith("table "), flat).otherwise(F.concat(F.lit("table "), flat))


def count_of(text: Column, part: str) -> Column:
    """Occurrences of a literal, without overlaps."""
    return (F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)


def vector_unit(vector: Column) -> Column:
    """L2-normalised; a zero vector stays zero."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(0.0))


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda a, x: a + x)


def anchor_span(text: Column) -> Column:
    """struct(anchor, span): the most telling token of a text and the sentence or window around it; NULL where there is none.

    Tokens of four characters and more score 4 with a digit, 2 with two capitals, 1 from
    eight characters on, -1 as a stop word; the first best counts and needs 1.
    """
    body = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    tokens = F.regexp_extract_all(body, F.lit(r"([A-Za-zА-Яа-я0-9%µμ]{4,})"), F.lit(1))
    scored = F.transform(tokens, lambda t, i: F.struct(
        F.when(F.lower(t).isin(ANCHOR_STOP), -1).otherwise(
            F.when(t.rlike(r"\d"), 4).otherwise(0) + F.when(F.length(F.regexp_replace(t, r"[^A-ZА-ЯЁ]", "")) >= 2, 2).otherwise(0) + F.when(F.length(t) >= 8, 1).otherwise(0)
        ).alias("score"), (-i).alias("order"), t.alias("token")))
    best = F.array_max(scored)
    usable = (F.length(body) >= 80) & ~F.lower(body).contains("unreadable") & (count_of(body, "|") / F.length(body) <= 0.01)
    return F.when(usable & (best["score"] >= 1), _span_around(body, best))


def _span_around(body: Column, best: Column) -> Column:
    pos = F.instr(F.lower(body), F.lower(best["token"]))  # 1-based
    head = F.substring(body, F.lit(1), pos - 1)
    left = F.length(head) - F.length(F.regexp_extract(head, r"(?s)([^\n.]*)\z", 1))
    tail = F.regexp_extract(F.substring(body, pos, F.length(body)), r"(?s)^([^\n.]*[\n.]?)", 1)
    raw = F.regexp_replace(F.substring(body, left + 1, pos - 1 - left + F.length(tail)), r"(?U)^\s+|\s+$", "")
    begin = F.greatest(pos - 1 - 60, F.lit(0))
    window = F.regexp_replace(F.substring(body, begin + 1, pos - 1 + 180 - begin), r"(?U)^\s+|\s+$", "")
    chosen = F.when(F.length(raw) < 40, window).otherwise(raw)
    return F.struct(best["token"].alias("anchor"), F.regexp_replace(F.substring(chosen, F.lit(1), F.lit(160)), r"(?U)\s+$", "").alias("span"))


def image_anchor_span(text: Column) -> Column:
    """struct(anchor, span) for text read from an image: the first token with a digit or a capital and what stands around it up to line ends and stops; NULL where there is none."""
    tokens = F.regexp_extract_all(text, F.lit(r"([A-Za-zА-Яа-я0-9%µμ]{4,})"), F.lit(1))
    anchor = F.get(F.filter(tokens, lambda t: t.rlike(r"[\d\p{Lu}]")), F.lit(0))
    at = F.instr(text, anchor)  # 1-based; an earlier place inside a longer token would have made that one the first
    head = F.substring(text, F.lit(1), at - 1)
    before = F.regexp_extract(head, r"(?s)([^\n.]*)\z", 1)
    after = F.regexp_extract(F.substring(text, at + F.length(anchor), F.length(text)), r"(?s)^([^\n.]*)", 1)
    raw = F.regexp_replace(F.concat(before, anchor, after), r"(?U)^\s+|\s+$", "")
    begin = F.greatest(at - 1 - 60, F.lit(0))
    window = F.regexp_replace(F.substring(text, begin + 1, at - 1 + F.length(anchor) + 60 - begin), r"(?U)^\s+|\s+$", "")
    return F.when(anchor.isNotNull(), F.struct(anchor.alias("anchor"), F.when(F.length(raw) > 240, window).otherwise(raw).alias("span")))


#: Tokens that are no anchors.
ANCHOR_STOP = ["table", "таблица", "figure", "рисунок", "chart", "diagram", "this", "that", "with", "from", "were", "have", "has", "using", "used", "into", "between", "within", "their"]
