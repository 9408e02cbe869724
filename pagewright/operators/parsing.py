"""From files to elements: identifiers, pages, order, and the union of what parsers give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pagewright.functions.text import split_blocks


def document_id(path: Column, modified: Column, strategy: str = "hash") -> Column:
    """12 characters: of the hash of path and time, the file's stem, a random id, or the hash of the path."""
    if strategy == "stem":
        return F.regexp_extract(path, r"([^/\\]+?)(?:\.[^./\\]*)?$", 1)
    if strategy == "uuid":
        return F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 12)
    return F.substring(F.md5(F.concat_ws(":", path, modified.cast("string")) if strategy == "hash" else path), 1, 12)


def image_page(file_name: Column) -> Column:
    """The page in a file name of the form img-PAGE-NUMBER.ext, else 1."""
    return F.coalesce(F.nullif(F.regexp_extract(file_name, r"img-(\d+)-\d+\.", 1), F.lit("")).cast("int"), F.lit(1))


def text_elements(pages: DataFrame) -> DataFrame:
    """(doc_id, page, elem_idx, type, content) of the blocks of each page (doc_id, page, content); blank pages give none."""
    return pages.select("doc_id", "page", F.posexplode(split_blocks(F.col("content"))).alias("elem_idx", "content")).withColumn("type", F.lit("text"))


def carried_pages(elements: DataFrame) -> DataFrame:
    """Elements whose page is missing get the last page seen before them in their document."""
    w = W.partitionBy("doc_id").orderBy("elem_idx").rowsBetween(W.unboundedPreceding, W.currentRow)
    return elements.withColumn("page", F.coalesce(F.last("page", ignorenulls=True).over(w), F.lit(1)))


def wanted_elements(elements: DataFrame) -> DataFrame:
    """Of an alternative parser's elements the running text, without its tables, images and captions."""
    return elements.where(F.col("category").isin("NarrativeText", "Text", "Title", "ListItem", "UncategorizedText"))


def with_fallback(primary: DataFrame, alternative: DataFrame, coverage: DataFrame, many_images: DataFrame | None = None) -> DataFrame:
    """The primary text, or the alternative's for documents whose coverage was not accepted.

    Documents in ``many_images`` keep the primary text; documents without alternative too.
    """
    poor = coverage.where(~F.col("accepted")).select("doc_id").join(alternative.select("doc_id").distinct(), "doc_id", "left_semi")
    if many_images is not None:
        poor = poor.join(many_images.select("doc_id").distinct(), "doc_id", "left_anti")
    return primary.join(poor, "doc_id", "left_anti").unionByName(alternative.join(poor, "doc_id", "left_semi"))


def ordered_elements(*parts: DataFrame) -> DataFrame:
    """All elements with ``seq`` by page, then text, table, image, then their own order.

    Elements are numbered within their page; the numbers of the pages before are added up
    over one row per page.
    """
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    rank = F.when(F.col("type") == "text", 0).when(F.col("type") == "table", 1).otherwise(2)
    sizes = rows.groupBy("doc_id", "page").agg(F.count("*").alias("_n"))
    earlier = F.coalesce(F.sum("_n").over(W.partitionBy("doc_id").orderBy("page").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col("doc_id").alias("_doc"), F.col("page").alias("_page"), earlier.alias("_earlier"))
    inside = rows.withColumn("_at", F.row_number().over(W.partitionBy("doc_id", "page").orderBy(rank, "elem_idx")) - 1)
    joined = inside.join(offsets, inside["doc_id"].eqNullSafe(F.col("_doc")) & inside["page"].eqNullSafe(F.col("_page")))
    return joined.select(*(inside[c] for c in rows.columns), (F.col("_at") + F.col("_earlier")).cast("int").alias("seq"))


def page_texts(elements: DataFrame) -> DataFrame:
    """(doc_id, page, content): the text of each page in element order."""
    rows = elements.where("type = 'text'").groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("elem_idx", "content"))).alias("xs"))
    return rows.select("doc_id", "page", F.array_join(F.transform("xs", lambda s: s["content"]), "\n").alias("content"))


def listed_images(files: DataFrame) -> DataFrame:
    """Image files in name order without masks: (doc_id, image_index, path, page)."""
    kept = files.where(~F.col("path").rlike(r"-s?mask\.[^.]+$"))
    return kept.withColumn("image_index", F.row_number().over(W.partitionBy("doc_id").orderBy("path")) - 1).withColumn("page", image_page(F.col("path")))
