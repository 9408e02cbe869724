"""Tables of the engine on files: JSON lines in and out, versioned replacement, caches."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagewright.functions.sql import is_blank
from pagewright.schemas import REPORT


def read_json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """Rows of a JSON-lines table; unreadable lines are left out, or raise when ``strict``."""
    if strict:
        return spark.read.schema(schema).json(path, mode="FAILFAST")
    rows = spark.read.schema(f"{schema}, _corrupt string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt")
    return rows.where("_corrupt is null").drop("_corrupt")


def unreadable_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(line) that ``read_json_lines`` leaves out."""
    rows = spark.read.text(path).where("trim(value) <> ''").select(F.col("value").alias("line"), F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    return rows.where("r._corrupt is not null").select("line")


def append_chunks(chunks: DataFrame, path: str) -> None:
    """Appends chunks with text as JSON lines."""
    chunks.where(~is_blank(F.col("content"))).write.mode("append").json(path)


def append_rows(rows: DataFrame, path: str) -> None:
    """Appends registry, error or timing rows as JSON lines."""
    rows.write.mode("append").json(path)


def replace_table(rows: DataFrame, path: str) -> str:
    """Writes a new version beside the old ones and returns its folder; readers take the newest by ``current``."""
    spark = rows.sparkSession
    version = f"{path.rstrip('/')}/v-{uuid.uuid1().hex}"
    rows.write.parquet(version)
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}/_current")
    return version


def current(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of a replaced table."""
    return spark.read.parquet(spark.read.text(f"{path.rstrip('/')}/_current").first().value)


def without_document(rows: DataFrame, doc_id: str) -> DataFrame:
    """Rows of other documents; rows without one stay."""
    return rows.where(~F.col("doc_id").eqNullSafe(F.lit(doc_id)))


def vectors_without_document(vectors: DataFrame, chunks: DataFrame, doc_id: str) -> DataFrame:
    """Vectors of other documents' chunks; to be taken before the chunks are removed."""
    return vectors.join(chunks.where(F.col("doc_id") == doc_id).select("chunk_id").distinct(), "chunk_id", "left_anti")


def image_hashes(chunks: DataFrame, doc_id: str) -> DataFrame:
    return chunks.where((F.col("doc_id") == doc_id) & F.col("metadata.image_hash").isNotNull()).select(F.col("metadata.image_hash").alias("image_hash")).distinct()


def cache_key(model: str, text: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{model}:"), text))


def cache_misses(rows: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Distinct keys that the cache lacks, with one row each."""
    return rows.where(F.col(key).isNotNull()).join(cache.select(key), key, "left_anti").dropDuplicates([key])


def with_cached(rows: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Rows with the cached columns; NULL where the cache has none."""
    return rows.join(cache.dropDuplicates([key]), key, "left")


def without_keys(cache: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return cache.join(keys.select(key).distinct(), key, "left_anti")


def write_report_csv(metrics: DataFrame, path: str) -> None:
    """The rows of all slices first the overall one, with a header; NULLs blank. A handful of rows."""
    order = F.when(F.col("scope") == "all", 0).otherwise(1)
    metrics.orderBy(order, "slice").coalesce(1).write.mode("overwrite").csv(path, header=True)


def read_report_csv(spark: SparkSession, path: str) -> DataFrame:
    """Report rows with blanks as 0; of repeated slices the last of the file counts."""
    rows = spark.read.csv(path, header=True, inferSchema=False)
    names = [c.strip().split(" ")[0] for c in REPORT.split(", ")]
    kinds = dict(c.split(" ") for c in REPORT.split(", "))
    kept = [c for c in names if c in rows.columns]
    placed = rows.select(*(F.col(c).cast(kinds[c]).alias(c) for c in kept), F.struct(F.input_file_name(), F.monotonically_increasing_id()).alias("place")).fillna(0)
    return placed.groupBy("slice", "scope").agg(F.max_by(F.struct(*kept), "place").alias("r")).select("r.*")


def files_by_pattern(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, modificationTime, length, content) of files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)


def newest(files: DataFrame, n: int) -> DataFrame:
    """The n files changed last."""
    return files.orderBy(F.col("modificationTime").desc(), F.col("path").desc()).limit(n)


def dataset_meta(dataset: DataFrame, chunks: DataFrame, path: str) -> DataFrame:
    """One row about a saved question set: hash and number of the chunks it was made from, their first time, its own size."""
    rows = chunks.agg(F.count("*").alias("chunks_count"), F.min("metadata.ingest_ts").alias("ingest_ts"), F.md5(F.sum(F.xxhash64("chunk_id", "content").cast("decimal(38,0)")).cast("string")).alias("chunks_hash"))
    counted = dataset.agg(F.count("*").alias("dataset_count"))
    return rows.withColumn("one", F.lit(1)).join(counted.withColumn("one", F.lit(1)), "one").drop("one").withColumn("dataset_path", F.lit(path)).withColumn("created_at", F.current_timestamp())
