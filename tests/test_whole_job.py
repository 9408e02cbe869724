"""Findings of the first review: each test failed before its finding was settled."""

import random

from pyspark.sql import functions as F

from pagewright.functions import predicates as P
from pagewright.operators import evaluation
from pagewright.plans import queries as core


def test_answer_in_content_reads_every_page(spark, make_chunks, tmp_path):
    make_chunks([("a", "the beam was bent", {"page": 1}), ("b", "a beam of light", {"page": 40}), ("c", "elsewhere", {"doc_id": "d2", "page": 99})]).write.parquet(f"{tmp_path}/chunks.parquet")
    rows = [(1, "q", "overall", True, "Beam", "d1"), (1, "q", "overall", True, "Beam", "d1"), (2, "q", "overall", True, "of light", "d1"), (3, "q", "overall", True, "nowhere", "d2"), (4, "q", "overall", True, "x", "d3"), (5, "q", "overall", False, "beam", "d1")]
    spark.createDataFrame(rows, "entry_id long, question string, slice string, has_answer boolean, expected_answer string, doc_id string").write.parquet(f"{tmp_path}/dataset.parquet")
    assert {tuple(r) for r in core.answer_in_content(spark, str(tmp_path)).collect()} == {(1, 2, 2), (2, 1, 1), (3, 0, 0)}


def test_answers_in_contents_agree_with_the_predicate(spark, make_chunks, monkeypatch):
    monkeypatch.setattr(evaluation, "ANSWER_BLOCK", 20)
    monkeypatch.setattr(evaluation, "CONTENT_BLOCK", 15)
    pick = random.Random(1)
    parts = ["Beam", "beams", "lens", "a", "of", "12", "%", "(x)", "—", "Датчик", "signal-noise", "sensor_1", "  ", "\n"]
    text = lambda n: pick.choice(["", " "]).join(pick.choices(parts, k=n))
    answers = spark.createDataFrame([(i, pick.choice(["d1", "d2"]), text(pick.randint(0, 4))) for i in range(80)], "entry_id long, doc_id string, answer string")
    contents = make_chunks([(f"c{i}", text(pick.randint(1, 12)), {"doc_id": pick.choice(["d1", "d1", "d2"])}) for i in range(60)])
    pairs = answers.join(contents.select("doc_id", "content"), "doc_id")
    hit = lambda strict: F.count_if(P.answer_in_content(F.col("answer"), F.col("content"), strict))
    want = {tuple(r) for r in pairs.groupBy("entry_id").agg(hit(True), hit(False)).collect()}
    assert {tuple(r) for r in evaluation.answers_in_contents(answers, contents).collect()} == want and len(want) == 80
