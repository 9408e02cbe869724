"""Problem 8: mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pagewright.llm.encoding import with_token_count
from pagewright.llm.tokenizer import Tokenizer

#: Bins that a source's documents are spread over by their seeded hash, so that running totals need no task per source.
BINS = 1024
#: Rows of a plan that are sent to every task.
BROADCAST_ROWS = 10_000


def sized_documents(documents: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """(doc_id, source, n_tokens) of each distinct document that has tokens and a source."""
    rows = with_token_count(documents.where("source is not null").select("doc_id", "source", F.col("text").cast("string").alias("text")), "text", tokenizer)
    return rows.where("n_tokens > 0").groupBy("doc_id", "source").agg(F.max("n_tokens").alias("n_tokens"))


def water_fill(targets: DataFrame, sizes: DataFrame, total: Column | None = None) -> DataFrame:
    """Tokens that each source gives to each mix.

    Level by level: sources are sorted by how often they would have to be repeated for a
    unit of weight (max_repeats * size / share). A source is clamped at its cap when its
    share of what the earlier ones left exceeds the cap; the excess is spread over the rest
    in proportion to their shares. In that order one pass over running sums finds the
    feasible level. ``total`` is the wanted size of a mix, by default the tokens of its
    sources used once. Sources without documents give nothing. ``targets`` is a parameter
    table with a row per mix and source; ``sizes`` has a row per source.
    """
    rows = targets.groupBy("mix_id", "source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    rows = rows.join(sizes, "source", "left").fillna({"n_tokens": 0, "n_docs": 0})
    mix = W.partitionBy("mix_id")
    share, cap = F.col("target_share"), F.col("cap")
    rows = rows.withColumn("cap", (F.col("n_tokens") * F.coalesce(F.col("max_repeats"), F.lit(1))).cast("double"))
    rows = rows.withColumn("total", (F.sum("n_tokens").over(mix) if total is None else total).cast("double"))
    by_level = mix.orderBy(F.when(share > 0, cap / share).otherwise(F.lit(float("inf"))), "source")
    earlier, rest = by_level.rowsBetween(W.unboundedPreceding, -1), by_level.rowsBetween(W.currentRow, W.unboundedFollowing)
    left = F.col("total") - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))
    rows = rows.withColumn("fair", F.when(F.sum("target_share").over(rest) > 0, left * share / F.sum("target_share").over(rest)).otherwise(0.0))
    # Once a source is not clamped, no later one is: the level of that source holds for all of them.
    rows = rows.withColumn("free", F.max((F.col("fair") < cap).cast("int")).over(by_level.rowsBetween(W.unboundedPreceding, W.currentRow)) == 1)
    level = F.first(F.when(F.col("free") & (share > 0), F.col("fair") / share), ignorenulls=True).over(by_level.rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.withColumn("planned", F.when(F.col("free"), F.coalesce(F.least(level * share, cap), F.lit(0.0))).otherwise(cap)).select("mix_id", "source", "target_share", "max_repeats", "n_docs", "n_tokens", "total", "planned")


def select_documents(plan: DataFrame, sized: DataFrame, seed: int = 42) -> DataFrame:
    """(mix_id, source, doc_id, n_tokens, repeats): whole repetitions, and a seeded part of the documents once more.

    The part is what comes first by the seeded hash of (mix, document) while the planned
    rest is not used up. Running totals are taken over bins of the hash first and then
    inside the bins, so a source with a third of all rows is still spread over many tasks.
    """
    plan = plan.where("n_tokens > 0 and planned > 0").select("mix_id", "source", F.col("n_tokens").alias("source_tokens"), "planned", "max_repeats")
    # The plan is a parameter table with a row per mix and source; one beyond the bound is joined by key.
    small = len(plan.select("mix_id").limit(BROADCAST_ROWS + 1).collect()) <= BROADCAST_ROWS
    joined = sized.join(F.broadcast(plan) if small else plan, "source")
    order = F.xxhash64(F.lit(seed), "mix_id", "doc_id")
    rows = joined.withColumn("rank_hash", order).withColumn("bin", F.shiftrightunsigned(F.col("rank_hash"), 64 - BINS.bit_length() + 1))
    rows = rows.withColumn("whole", F.floor(F.col("planned") / F.col("source_tokens")))
    rows = rows.withColumn("part", F.when(F.col("whole") < F.coalesce("max_repeats", F.lit(1)), F.col("planned") - F.col("whole") * F.col("source_tokens")).otherwise(0.0))
    key = ["mix_id", "source", "bin"]
    bins = rows.groupBy(*key).agg(F.sum("n_tokens").alias("bin_tokens"))
    before = W.partitionBy("mix_id", "source").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    bins = bins.select(*key, F.coalesce(F.sum("bin_tokens").over(before), F.lit(0)).alias("bins_before"))
    inside = W.partitionBy(*key).orderBy(F.col("rank_hash"), F.col("doc_id")).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("running", F.sum("n_tokens").over(inside)).join(bins, key)
    once_more = (F.col("bins_before") + F.col("running") <= F.col("part") + 1e-6).cast("int")
    return rows.withColumn("repeats", (F.col("whole") + once_more).cast("int")).where("repeats > 0").select("mix_id", "source", "doc_id", "n_tokens", "repeats")


def mix_documents(documents: DataFrame, targets: DataFrame, tokenizer: Tokenizer = Tokenizer(), seed: int = 42, total_tokens: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The selection and the report of actual shares.

    Documents without text, tokens or source are never selected; repeated rows count once;
    NULL max_repeats means once; a mix whose sources have no documents reports zero shares.
    The selection has a row per mix and document with its number of uses; the report a row
    per mix and source with the wanted size of the mix, whether the source is clamped at its
    cap below its share of it, target, planned and actual share and the epochs used.
    """
    sized = sized_documents(documents, tokenizer)
    sizes = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    plan = water_fill(targets.where("mix_id is not null and source is not null"), sizes, None if total_tokens is None else F.lit(total_tokens))
    chosen = select_documents(plan, sized, seed)
    used = chosen.groupBy("mix_id", "source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("used_tokens"), F.sum("repeats").alias("used_docs"))
    report = plan.join(used, ["mix_id", "source"], "left").fillna(0, ["used_tokens", "used_docs"])
    mix = W.partitionBy("mix_id")
    share = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), F.sum(c).over(mix).cast("double")), F.lit(0.0))
    share_of_total = F.col("total") * F.col("target_share")
    report = report.select("mix_id", "source", "target_share", "max_repeats", "n_docs", "n_tokens", F.col("total").alias("mix_tokens"), (F.col("planned") < share_of_total - 1e-6).alias("clamped"), F.round(share("planned"), 6).alias("planned_share"), F.round(share("used_tokens"), 6).alias("actual_share"), "used_docs", "used_tokens", F.round(F.coalesce(F.try_divide(F.col("used_tokens").cast("double"), F.col("n_tokens").cast("double")), F.lit(0.0)), 6).alias("epochs"))
    return chosen, report
