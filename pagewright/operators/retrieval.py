"""Hybrid retrieval for batches of questions: every step is set-based over (query_id, chunk_id).

Scored rows are ``hits``: query_id, chunk_id, type, score, ord. ``ord`` is the place a row
was first put in; it breaks ties as a stable sort would.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pagewright.functions.predicates import IMAGE_TYPES, image_question, table_question
from pagewright.plans.lineage import materialize, written_blocks

HITS = ["query_id", "chunk_id", "type", "score", "ord"]


def quoted_anchor(question: Column) -> Column:
    """The phrase after ``phrase includes``, else the longest quoted span of 3 to 120 characters (the first of equal ones)."""
    named = F.regexp_extract(question, r"(?i)phrase includes\s+[\"“«]([^\"”»]{3,120})[\"”»]", 1)
    spans = F.regexp_extract_all(question, F.lit(r"[\"“«]([^\"“”«»]{3,120})[\"”»]"), F.lit(1))
    longest = F.array_max(F.transform(spans, lambda s, i: F.struct(F.length(s).alias("n"), (-i).alias("at"), s.alias("s"))))["s"]
    return F.nullif(F.trim(F.when(named != "", named).otherwise(longest)), F.lit(""))


def intent(questions: DataFrame, question: str = "question") -> DataFrame:
    """Adds is_table, is_image, anchor and preferred types (image before table before anchored text)."""
    q = F.col(question)
    rows = questions.withColumn("is_table", table_question(q)).withColumn("is_image", image_question(q)).withColumn("anchor", quoted_anchor(q))
    preferred = F.when(F.col("is_image"), F.array(*map(F.lit, IMAGE_TYPES))).when(F.col("is_table"), F.array(F.lit("table"))).when(F.col("anchor").isNotNull(), F.array(F.lit("text"))).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("preferred", preferred)


#: Anchors that are searched for at a time, and texts that a task holds against them.
ANCHOR_BLOCK, TEXT_BLOCK = 20_000, 16_384


def anchor_candidates(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id, type, score) of chunks that contain a question's anchor (4 characters and more), case aside.

    The distinct anchors are written in blocks; the texts are read once, and every task runs
    those it holds through one automaton of anchors after the other.
    """
    asked = questions.where(F.length("anchor") >= 4).withColumn("needle", F.lower("anchor"))
    blocks = written_blocks(asked.select("needle").distinct(), "needle", ANCHOR_BLOCK, "anchors")
    held = chunks.where("content is not null").select("chunk_id", "type", F.lower("content").alias("body"))

    def found(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        bodies = rows["body"].to_pylist()
        for block in blocks.read():
            needles = block["needle"].to_pylist()
            if not needles:
                continue
            automaton = ahocorasick.Automaton()
            for needle in needles:
                automaton.add_word(needle, needle)
            automaton.make_automaton()
            hits = [(i, x) for i, body in enumerate(bodies) for x in {x for _, x in automaton.iter(body)}]
            at = pa.array([i for i, _ in hits], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x for _, x in hits], pa.string()), rows["chunk_id"].combine_chunks().take(at), rows["type"].combine_chunks().take(at), pa.array([len(bodies[i]) for i, _ in hits], pa.int32())], ["needle", "chunk_id", "type", "n_chars"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= TEXT_BLOCK:
                yield from found(held)
                held = []
        if held:
            yield from found(held)

    both = asked.select("query_id", "needle", "preferred").join(held.mapInArrow(run, "needle string, chunk_id string, type string, n_chars int"), "needle")
    bonus = F.when(F.col("type") == "text", 0.02).otherwise(0.04) + F.when(F.array_contains("preferred", F.col("type")), 0.20).otherwise(0.0)
    return both.select("query_id", "chunk_id", "type", (F.length("needle") / F.greatest(F.col("n_chars"), F.lit(1)) + bonus).alias("score"))


def merge_hybrid(dense: DataFrame, lexical: DataFrame) -> DataFrame:
    """Full outer merge: the mean of both scores, the dense score alone, half of the lexical score alone.

    Inputs are (query_id, chunk_id, type, score, rank); dense rows come first in order.
    """
    d = dense.select("query_id", "chunk_id", F.col("type").alias("dt"), F.col("score").alias("ds"), F.col("rank").alias("dr"))
    x = lexical.select("query_id", "chunk_id", F.col("type").alias("lt"), F.col("score").alias("ls"), F.col("rank").alias("lr"))
    both = d.join(x, ["query_id", "chunk_id"], "full")
    score = F.when(F.col("ds").isNotNull() & F.col("ls").isNotNull(), (F.col("ds") + F.col("ls")) / 2).when(F.col("ds").isNotNull(), F.col("ds")).otherwise(F.col("ls") * 0.5)
    return both.select("query_id", "chunk_id", F.coalesce("dt", "lt").alias("type"), score.alias("score"), F.coalesce(F.col("dr"), F.col("lr") + 1_000_000).cast("bigint").alias("ord"))


def _ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "ord", "chunk_id")))


def _top_score(hits: DataFrame) -> DataFrame:
    return hits.groupBy("query_id").agg(F.max("score").alias("top"))


def anchor_topup(hits: DataFrame, candidates: DataFrame, k: int, step: float = 0.02, most: int = 2) -> DataFrame:
    """The first candidates are lifted above the best score, each by another step, until min(2, k) were lifted.

    Candidates that already have at least the best score so far are passed over; only the
    ones before the first lift can be.
    """
    order = F.row_number().over(W.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "chunk_id"))
    walked = candidates.withColumn("walk", order).join(_top_score(hits), "query_id", "left").withColumn("top", F.coalesce("top", F.lit(1.0)))
    walked = walked.join(hits.select("query_id", "chunk_id", F.col("score").alias("now")), ["query_id", "chunk_id"], "left")
    behind = F.col("now").isNull() | (F.col("now") < F.col("top"))
    first = F.min(F.when(behind, F.col("walk"))).over(W.partitionBy("query_id"))
    lifted = walked.withColumn("first", first).where(F.col("walk") >= F.col("first")).withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy("walk"))).where(F.col("n") <= min(most, k))
    raised = lifted.select("query_id", "chunk_id", "type", (F.col("top") + step * F.col("n")).alias("score"), (F.col("n") + 2_000_000).cast("bigint").alias("ord"))
    kept = hits.join(raised.select("query_id", "chunk_id", F.col("score").alias("up")), ["query_id", "chunk_id"], "left")
    kept = kept.select("query_id", "chunk_id", "type", F.coalesce("up", "score").alias("score"), "ord")
    return kept.unionByName(raised.join(hits, ["query_id", "chunk_id"], "left_anti").select(*HITS))


def type_topup(hits: DataFrame, pool: DataFrame, queries: DataFrame, types: list[str], k: int, step: float = 0.01, most: int = 2) -> DataFrame:
    """New chunks of ``types`` for ``queries`` (query_id) that have fewer than min(2, k): each above the best score by a step.

    ``pool`` is (query_id, chunk_id, type, stage, rank) in the order of trying: stage before rank.
    """
    have = hits.where(F.col("type").isin(types)).groupBy("query_id").agg(F.count("*").alias("have"))
    need = queries.select("query_id").distinct().join(have, "query_id", "left").join(_top_score(hits), "query_id", "left").select("query_id", (F.lit(min(most, k)) - F.coalesce("have", F.lit(0))).alias("lack"), F.coalesce("top", F.lit(1.0)).alias("top")).where("lack > 0")
    fresh = pool.where(F.col("type").isin(types)).groupBy("query_id", "chunk_id", "type").agg(F.min(F.struct("stage", "rank")).alias("at")).join(hits, ["query_id", "chunk_id"], "left_anti").join(need, "query_id")
    n = F.row_number().over(W.partitionBy("query_id").orderBy("at", "chunk_id"))
    new = fresh.withColumn("n", n).where(F.col("n") <= F.col("lack")).select("query_id", "chunk_id", "type", (F.col("top") + step * F.col("n")).alias("score"), (F.col("n") + 3_000_000).cast("bigint").alias("ord"))
    return hits.unionByName(new)


def first_k(hits: DataFrame, k: int) -> DataFrame:
    """The k best per query with their rank ``n``."""
    return _ranked(hits).where(F.col("n") <= k)


def ensure_type(top: DataFrame, hits: DataFrame, queries: DataFrame, types: list[str], k: int) -> DataFrame:
    """For ``queries`` whose top k has none of ``types``, the last one gives way to the best of them."""
    lacking = queries.select("query_id").distinct().join(top.where(F.col("type").isin(types)), "query_id", "left_anti")
    best = _ranked(hits.where(F.col("type").isin(types)).join(lacking, "query_id", "left_semi")).where("n = 1").drop("n")
    last = F.max("n").over(W.partitionBy("query_id"))
    swapped = top.withColumn("last", last).join(best.select("query_id", F.lit(True).alias("swap")), "query_id", "left")
    kept = swapped.where(~(F.coalesce("swap", F.lit(False)) & (F.col("n") == F.col("last")))).drop("last", "swap")
    places = swapped.where("swap").select("query_id", "last").distinct()
    return kept.unionByName(best.join(places, "query_id").withColumnRenamed("last", "n").select(*kept.columns))


def search(questions: DataFrame, chunks: DataFrame, dense: DataFrame, lexical: DataFrame, k: int, dense_pool: DataFrame | None = None, lexical_pool: DataFrame | None = None) -> DataFrame:
    """(query_id, n, chunk_id, type, score): the whole hybrid search.

    ``questions`` is (query_id, question); ``dense`` the 2k and ``lexical`` the k best hits
    (query_id, chunk_id, type, score, rank), the pools longer lists for top-ups. Questions
    whose anchor is in at least k chunks are answered by those alone; the others go through
    merge, anchor lift, table and image top-up, ranking, and the guarantee of a table or an
    image where the question asks for one.
    """
    # Every step reads the one before several times: each is written once.
    asked = materialize(intent(questions), "questions")
    candidates = materialize(anchor_candidates(asked, chunks), "anchor-candidates")
    n = F.row_number().over(W.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "chunk_id"))
    ranked = candidates.withColumn("n", n)
    fast = ranked.where(F.col("n") <= k).withColumn("all", F.count("*").over(W.partitionBy("query_id"))).where(F.col("all") >= k)
    fast = fast.select("query_id", "n", "chunk_id", "type", (1.0 - 0.01 * (F.col("n") - 1)).alias("score"))
    done = fast.select("query_id").distinct()
    slow = asked.join(done, "query_id", "left_anti")
    only = lambda rows: rows.join(slow.select("query_id"), "query_id", "left_semi")
    hits = materialize(anchor_topup(materialize(merge_hybrid(only(dense), only(lexical)), "merged"), only(candidates), k), "lifted")
    pool = only(lexical_pool if lexical_pool is not None else lexical).withColumn("stage", F.lit(0)).unionByName(only(dense_pool if dense_pool is not None else dense).withColumn("stage", F.lit(1)))
    pool = materialize(pool.select("query_id", "chunk_id", "type", "stage", "rank"), "pool")
    tables, images = slow.where("is_table"), slow.where("is_image")
    hits = materialize(type_topup(hits, pool, tables, ["table"], k), "with-tables")
    hits = materialize(type_topup(hits, pool, images, IMAGE_TYPES, k), "with-images")
    top = materialize(first_k(hits, k), "top")
    top = ensure_type(top, hits, tables, ["table"], k)
    top = ensure_type(top, hits, images, IMAGE_TYPES, k)
    return fast.unionByName(top.select("query_id", "n", "chunk_id", "type", "score"))
