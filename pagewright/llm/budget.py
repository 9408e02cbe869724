"""Problem 5: token totals by slice, kept up to date through signed deltas.

State is two tables, written as versions in a folder. ``counts`` holds the token count of
each content under a tokenizer (``content_key``, ``n_tokens``); ``units`` holds what is
counted now: one row per document, type and content with its slices and its number of
chunks. A new snapshot encodes only contents whose key is not in ``counts``, each once, and
changes the cube by +n for units that came and -n for units that went. A changed chunk, a
removed document and a document whose slices changed in the catalog do both or the latter.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagewright.functions.sql import is_blank
from pagewright.llm.encoding import content_key, with_token_count
from pagewright.llm.tokenizer import Tokenizer
from pagewright.sources.store import current, replace_table

SLICES = ["type", "source", "lang", "domain"]
UNITS = ["doc_id", *SLICES, "content_key", "n_tokens"]
UNKNOWN = "unknown"


@dataclass
class BudgetState:
    counts: DataFrame  # content_key, n_tokens
    units: DataFrame  # doc_id, the slices, content_key, n_tokens, n_chunks
    cube: DataFrame  # the slices, n_chunks, n_tokens


def plain_name(value: Column) -> Column:
    """Trimmed lower case with one kind of separator; NULL and blank become ``unknown``."""
    return F.coalesce(F.nullif(F.regexp_replace(F.lower(F.trim(value)), r"[\s-]+", "_"), F.lit("")), F.lit(UNKNOWN))


def plain_language(value: Column) -> Column:
    """The two-letter code before any region mark."""
    return F.coalesce(F.nullif(F.regexp_extract(F.lower(F.trim(value)), r"^([a-z]{2})(?:[_-].*)?$", 1), F.lit("")), F.lit(UNKNOWN))


def usable_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks whose text can be used: processed with success and not blank. NULL status is not success."""
    return chunks.where((F.col("metadata.processing_status") == "success") & ~is_blank(F.col("content"))).select("chunk_id", "doc_id", plain_name(F.col("type")).alias("type"), "content")


def catalog_slices(catalog: DataFrame) -> DataFrame:
    """One row per doc_id; of rows that differ the one with the fewest unknown fields, then the least."""
    rows = catalog.where("doc_id is not null").select("doc_id", plain_name(F.col("source")).alias("source"), plain_language(F.col("lang")).alias("lang"), plain_name(F.col("domain")).alias("domain"))
    gaps = sum((F.col(c) == UNKNOWN).cast("int") for c in SLICES[1:])
    return rows.groupBy("doc_id").agg(F.min(F.struct(gaps.alias("gaps"), *SLICES[1:])).alias("s")).select("doc_id", *(F.col(f"s.{c}").alias(c) for c in SLICES[1:]))


def _units(chunks: DataFrame, catalog: DataFrame) -> DataFrame:
    """Units from (chunk_id, doc_id, type, content_key, n_tokens): repeated rows count once, and a chunk_id with several contents counts each of them."""
    rows = chunks.groupBy("chunk_id", "content_key").agg(F.min("doc_id").alias("doc_id"), F.min("type").alias("type"), F.max("n_tokens").alias("n_tokens"))
    # Fewer rows go into the join with the catalog when the chunks of a document are added up first.
    rows = rows.groupBy("doc_id", "type", "content_key", "n_tokens").agg(F.count("*").alias("n_chunks"))
    return rows.join(catalog_slices(catalog), "doc_id", "left").fillna(UNKNOWN, SLICES[1:]).select(*UNITS, "n_chunks")


def cube_of(units: DataFrame) -> DataFrame:
    """(slices, n_chunks, n_tokens) of units; cells without a chunk are left out, negative ones are not."""
    return units.groupBy(*SLICES).agg(F.sum("n_chunks").alias("n_chunks"), F.sum(F.col("n_chunks") * F.col("n_tokens")).alias("n_tokens")).where("n_chunks <> 0 or n_tokens <> 0")


def signed_deltas(old: DataFrame, new: DataFrame) -> DataFrame:
    """The units that came, and with a negative n_chunks those that went; what is in both is in neither."""
    signed = new.select(*UNITS, "n_chunks").unionByName(old.select(*UNITS, (-F.col("n_chunks")).alias("n_chunks")))
    return signed.groupBy(*UNITS).agg(F.sum("n_chunks").alias("n_chunks")).where("n_chunks <> 0")


def add_deltas(cube: DataFrame, deltas: DataFrame) -> DataFrame:
    """The cube after the deltas; cells that became empty are dropped."""
    return cube.unionByName(cube_of(deltas)).groupBy(*SLICES).agg(F.sum("n_chunks").alias("n_chunks"), F.sum("n_tokens").alias("n_tokens")).where("n_chunks <> 0")


def snapshot(chunks: DataFrame, catalog: DataFrame, tokenizer: Tokenizer = Tokenizer(), before: BudgetState | None = None, keep: Callable[[DataFrame, str], DataFrame] = lambda table, name: table) -> BudgetState:
    """The state after ``chunks`` and ``catalog``; contents counted in ``before`` are not encoded again, new ones once each.

    ``keep`` gets each table of the state and its name, and may write it: what comes after
    reads what it returns.
    """
    keyed = usable_chunks(chunks).withColumn("content_key", content_key(F.col("content"), tokenizer.fingerprint()))
    if before is None:
        # Everything is unseen: count where the text is read, so that no text is shuffled; the encoder of a task counts equal fragments once.
        units = keep(_units(with_token_count(keyed, "content", tokenizer), catalog), "units")
        return BudgetState(keep(units.groupBy("content_key").agg(F.max("n_tokens").alias("n_tokens")), "counts"), units, keep(cube_of(units), "cube"))
    unseen = keyed.join(before.counts.select("content_key"), "content_key", "left_anti").groupBy("content_key").agg(F.first("content").alias("content"))
    counts = keep(before.counts.select("content_key", "n_tokens").unionByName(with_token_count(unseen, "content", tokenizer)), "counts")
    units = keep(_units(keyed.select("chunk_id", "doc_id", "type", "content_key").join(counts, "content_key"), catalog), "units")
    return BudgetState(counts, units, keep(add_deltas(before.cube, signed_deltas(before.units, units)), "cube"))


def update_state(chunks: DataFrame, catalog: DataFrame, folder: str, tokenizer: Tokenizer = Tokenizer()) -> BudgetState:
    """Brings the state in ``folder`` up to ``chunks`` and ``catalog``, or begins one, and returns it as written.

    Each table is written once as a new version, the next is made from it, and the versions
    count only when all are there: a run that dies leaves the earlier state in force.
    """
    spark, versions = chunks.sparkSession, {}
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/state")
    before = read_state(spark, folder, tokenizer) if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) else None

    def keep(rows: DataFrame, name: str) -> DataFrame:
        versions[name] = replace_table(rows, f"{folder}/{name}")
        return spark.read.schema(rows.schema).parquet(versions[name])

    state = snapshot(chunks, catalog, tokenizer, before, keep)
    replace_table(spark.createDataFrame([(json.dumps({"tokenizer": tokenizer.fingerprint(), "versions": versions}),)], "state string"), f"{folder}/state")
    return state


def read_state(spark: SparkSession, folder: str, tokenizer: Tokenizer = Tokenizer()) -> BudgetState:
    """The last complete state; another tokenizer's counts are an error, as they are not comparable."""
    state = json.loads(current(spark, f"{folder}/state").first().state)
    if state["tokenizer"] != tokenizer.fingerprint():
        raise ValueError("the state was counted with another tokenizer")
    return BudgetState(*(spark.read.parquet(state["versions"][name]) for name in ("counts", "units", "cube")))


def budget_report(cube: DataFrame) -> DataFrame:
    """Totals per cell and by each slice alone; ``by`` names the slices of a row, others are NULL."""
    sets = [[c] for c in SLICES] + [SLICES, []]
    grouped = cube.groupingSets(sets, *SLICES).agg(F.sum("n_chunks").alias("n_chunks"), F.sum("n_tokens").alias("n_tokens"), *(F.grouping(c).alias(f"no_{c}") for c in SLICES))
    by = F.concat_ws("+", *(F.when(F.col(f"no_{c}") == 0, F.lit(c)) for c in SLICES))
    return grouped.select(F.when(by == "", "all").otherwise(by).alias("by"), *SLICES, "n_chunks", "n_tokens").where("n_chunks is not null")


def token_budget(chunks: DataFrame, catalog: DataFrame, folder: str, tokenizer: Tokenizer = Tokenizer()) -> DataFrame:
    """Token totals of all usable chunks by type, source, lang and domain, from the state kept in ``folder``.

    Where the folder holds no state yet everything is encoded; else only what is not in the
    count table, and the cube changes by signed deltas. The new state is written.
    NULL content, blank content and failed chunks count nothing; documents missing from
    the catalog and NULL slices come under ``unknown``; empty tables give no rows.
    """
    return budget_report(update_state(chunks, catalog, folder, tokenizer).cube)
