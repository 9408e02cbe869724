"""The hybrid search of whole batches: each test failed before its finding of the second review was settled."""

import random
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from pagewright.operators import hybrid, lexical, retrieval, vectors
from pagewright.plans import queries as core
from pagewright.plans.answering import embed_chunks
from pagewright.providers import HashEmbedder


def test_blocks_give_what_the_joins_of_lists_give(spark, make_chunks):
    pick = random.Random(3)
    words = ["lens", "beam", "the", "of", "table", "rotor", "figure", "signal", "of", "the", "pump", "42", "датчик", *(f"w{i}" for i in range(150))]
    text = lambda n: " ".join(pick.choices(words, [9] * 13 + [1] * 150, k=n))
    rows = [(f"c{pick.randint(0, 10**6):06d}", text(pick.randint(1, 25)), {"type": pick.choice(["text"] * 6 + ["table", "image_ocr", "image_caption"])}) for _ in range(300)]
    chunks = make_chunks([*{r[0]: r for r in rows}.values(), ("dots", "...")])
    embedded = embed_chunks(chunks).where("chunk_id not like '%7'").localCheckpoint()
    asked = sorted({*(text(pick.randint(1, 6)) + "?" for _ in range(40)), 'which phrase includes "the lens"?', 'table "rotor pump beam"', 'figure "signal 42 of the"', "?!", "results 12 %"})
    questions = spark.createDataFrame([(q, q) for q in asked], "query_id string, question string")
    asked_vectors = spark.createDataFrame([(q, v) for q, v in zip(asked, HashEmbedder().reply(asked))], "query_id string, vector array<float>")
    texts = chunks.select("chunk_id", "type", F.lower("content").alias("text"))
    index, kinds, k = lexical.build_index(texts.select("chunk_id", "text")), chunks.select("chunk_id", "type"), 5
    dense = vectors.top_k(asked_vectors, embedded, 50).join(kinds, "chunk_id")
    worded = lexical.bm25_top_k(questions.select("query_id", lexical.query_tokens(F.col("question")).alias("tokens")), index, 20).withColumnRenamed("id", "chunk_id").join(kinds, "chunk_id")
    want = retrieval.search(questions, chunks, dense.where(F.col("rank") <= 2 * k), worded.where(F.col("rank") <= k), k, dense, worded)
    held = asked_vectors.select(F.col("query_id").alias("question"), F.array("query_id").alias("query_ids"), "vector")
    got = hybrid.search(held, texts.join(embedded.select("chunk_id", "vector"), "chunk_id", "left"), index, chunks, k, 50, 20, chunk_block=70, question_block=9)
    plain = lambda rows: sorted((r.query_id, r.n, r.chunk_id, r.type, round(r.score, 6)) for r in rows.collect())
    assert plain(got) == plain(want) and len({r[0] for r in plain(got)}) == len(asked)


def test_nearest_stay_within_memory_and_ties_do_not_pile_up():
    rng = np.random.default_rng(1)
    m = rng.normal(size=(131_072, 64)).astype(np.float32)
    m[5_000:60_000] = m[5_000]
    norms = np.sqrt((m.astype(np.float64) ** 2).sum(axis=1))
    block, near = hybrid.Block(m, np.ones(len(m), bool), norms, {}, len(m)), hybrid.Near(np.arange(1_024), np.repeat(m[4_990:5_006].astype(np.float64) / norms[4_990:5_006, None], 64, axis=0), 24)
    tracemalloc.start()
    for begin in range(0, 131_072, hybrid.RIGHT):
        near.add(block, begin, (m[begin : begin + hybrid.RIGHT] / norms[begin : begin + hybrid.RIGHT, None]).astype(np.float32), 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    found = {row: docs for row, docs, _ in near.lists()}
    assert found[1_023] == list(range(5_000, 5_024)) and found[0][0] == 4_990 and peak < 900e6


def test_every_question_is_searched(spark, make_chunks, tmp_path):
    make_chunks([(f"c{i}", f"The lens {i} has a thermal detector number {i}.") for i in range(15)]).write.parquet(f"{tmp_path}/chunks.parquet")
    spark.createDataFrame([(1, "which lens?"), (7, "which lens?"), (19, "detector 3"), (20, "detector 4"), (21, None)], "entry_id long, question string").write.parquet(f"{tmp_path}/dataset.parquet")
    found = core.hybrid_search(spark, str(tmp_path)).collect()
    assert {i: sum(r.query_id == i for r in found) for i in (1, 7, 19, 20, 21)} == {1: 12, 7: 12, 19: 12, 20: 12, 21: 0}
    assert {(r.n, r.chunk_id) for r in found if r.query_id == 1} == {(r.n, r.chunk_id) for r in found if r.query_id == 7}
