"""Cell grids, markdown tables and their captions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def grid_ok(cells: Column) -> Column:
    """At least two rows and two columns, at most 70 % empty cells. ``cells`` is array<array<string>>."""
    flat = F.flatten(F.filter(cells, lambda r: r.isNotNull()))
    empty = F.size(F.filter(flat, lambda c: c.isNull() | (F.trim(c) == "")))
    widest = F.array_max(F.transform(cells, lambda r: F.coalesce(F.size(r), F.lit(0))))
    return F.coalesce((F.size(cells) >= 2) & (widest >= 2) & (empty <= 0.7 * F.greatest(F.size(flat), F.lit(1))), F.lit(False))


def grid_to_markdown(cells: Column) -> Column:
    """Rows padded to the widest, line ends as spaces, a rule after the header."""
    widest = F.array_max(F.transform(cells, lambda r: F.coalesce(F.size(r), F.lit(0))))
    clean = lambda c: F.trim(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")))
    pad = lambda r: F.concat(F.transform(F.coalesce(r, F.array().cast("array<string>")), clean), F.array_repeat(F.lit(""), F.greatest(widest - F.coalesce(F.size(r), F.lit(0)), F.lit(0))))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    lines = F.transform(cells, lambda r: line(pad(r)))
    rule = line(F.array_repeat(F.lit("---"), widest))
    return F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(1)))), "\n")


def html_to_markdown(html: Column) -> Column:
    """Rows of the first level of tr and td or th; NULL where there are none."""
    strip = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]+>", ""), r"\s+", " "))
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    grid = F.filter(F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), strip)), lambda r: F.size(r) > 0)
    return F.when(F.size(grid) > 0, grid_to_markdown(grid))


def distinct_tables(tables: DataFrame) -> DataFrame:
    """The first of equal tables of a page (case and whitespace aside); blank ones are dropped."""
    norm = F.trim(F.regexp_replace(F.lower("content"), r"(?U)\s+", " "))
    first = F.row_number().over(W.partitionBy("doc_id", "page", F.md5(norm)).orderBy("elem_idx")) == 1
    return tables.where(norm != "").withColumn("_first", first).where("_first").drop("_first")


def page_captions(page_texts: DataFrame) -> DataFrame:
    """(doc_id, page, caption): the first short line of a page that speaks of a table."""
    lines = F.filter(F.transform(F.split("content", "\n"), lambda x: F.trim(x)), lambda x: (F.length(x) <= 200) & F.lower(x).rlike("table|табл"))
    first = page_texts.withColumn("caption", F.get(lines, F.lit(0))).where("caption is not null")
    return first.groupBy("doc_id", "page").agg(F.min_by("caption", "elem_idx").alias("caption"))


def attach_captions(tables: DataFrame, captions: DataFrame) -> DataFrame:
    """The caption of the page in front of each table that does not contain it."""
    joined = tables.join(captions, ["doc_id", "page"], "left")
    new = F.when(F.col("caption").isNotNull() & ~F.contains("content", "caption"), F.concat("caption", F.lit("\n"), F.col("content"))).otherwise(F.col("content"))
    return joined.withColumn("content", new).drop("caption")


def header_flags(lines: Column) -> Column:
    """Booleans of the first two lines: whether they are the header, having no digit in their first 20 characters; the first line is one where neither is."""
    plain = F.transform(F.slice(lines, 1, 2), lambda x: ~F.substring(x, 1, 20).rlike(r"\p{Nd}"))
    return F.when(F.exists(plain, lambda x: x), plain).otherwise(F.transform(plain, lambda _, i: i == 0))


def split_table(text: Column, max_tokens: int = 400) -> Column:
    """Pieces of a markdown table of at most about ``max_tokens``, the header repeated in each.

    Tokens are a fourth of the characters, rounded down for each line. Lines are held by
    their place, so a later row that equals the header stays; a single row over the limit
    makes a piece of its own. A table that is all header comes out as one piece. NULL gives NULL.
    The fold keeps only where pieces begin, and each line is copied once.
    """
    lines = F.split(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), "\n")
    flags = header_flags(lines)
    is_head = lambda i: F.coalesce(F.get(flags, i), F.lit(False))
    head = F.array_join(F.filter(lines, lambda _, i: is_head(i)), "\n")
    body = F.filter(lines, lambda _, i: ~is_head(i))
    tokens = lambda x: F.floor(F.length(x) / 4).cast("int")
    start = F.struct(F.array().cast("array<int>").alias("begins"), F.lit(0).alias("at"), tokens(head).alias("total"))

    def add(acc: Column, n: Column) -> Column:
        new = (acc["at"] == 0) | (acc["total"] + n > max_tokens)
        return F.struct(F.when(new, F.concat(acc["begins"], F.array(acc["at"]))).otherwise(acc["begins"]).alias("begins"), (acc["at"] + 1).alias("at"), (F.when(new, tokens(head)).otherwise(acc["total"]) + n).alias("total"))

    begins = F.aggregate(F.transform(body, tokens), start, add)["begins"]
    ends = F.concat(F.slice(begins, F.lit(2), F.size(begins)), F.array(F.size(body)))
    pieces = F.zip_with(begins, ends, lambda a, b: F.concat(head, F.lit("\n"), F.array_join(F.slice(body, a + 1, b - a), "\n")))
    return F.when(text.isNull(), F.lit(None).cast("array<string>")).when(tokens(text) <= max_tokens, F.array(text)).when(F.size(begins) > 0, pieces).otherwise(F.array(head))
