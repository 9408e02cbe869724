"""python -m pagewright COMMAND: ingest, ask, eval and reindex over tables in folders."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession, functions as F

from pagewright.config import Settings, load_settings
from pagewright.operators.evaluation import markdown_report, report_examples, slice_metrics
from pagewright.plans.answering import answer, embed_chunks, judge, retrieve
from pagewright.plans.ingest import ingest, missing_vectors
from pagewright.schemas import IMAGES
from pagewright.sources.store import write_report_csv


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="pagewright", description=__doc__)
    p.add_argument("command", choices=["ingest", "ask", "eval", "reindex"])
    p.add_argument("--config")
    p.add_argument("--chunks", help="folder of the chunks table")
    p.add_argument("--elements", help="folder of the elements table (ingest)")
    p.add_argument("--images", help="folder of the images table (ingest)")
    p.add_argument("--cache", help="folder that keeps embeddings by model and text (reindex)")
    p.add_argument("--vectors", help="folder of the vector table")
    p.add_argument("--dataset", help="folder of the question set (eval)")
    p.add_argument("--question", help="question (ask)")
    p.add_argument("--out", help="folder for results")
    a = p.parse_args(args)
    settings = load_settings(a.config) if a.config else Settings()
    spark = SparkSession.builder.getOrCreate()
    if a.command == "ingest":
        pictures = spark.read.parquet(a.images) if a.images else spark.createDataFrame([], IMAGES)
        done = ingest(spark.read.parquet(a.elements), pictures, size=settings.chunk_size_tokens, overlap=settings.chunk_overlap_tokens)
        for name, rows in (("chunks", done.chunks), ("registry", done.registry), ("errors", done.errors)):
            rows.write.mode("append").parquet(f"{a.out}/{name}")
        return 0
    chunks = spark.read.parquet(a.chunks)
    if a.command == "reindex":
        embed_chunks(missing_vectors(chunks, spark.read.parquet(a.vectors)) if a.vectors else chunks, cache=a.cache).write.mode("append").parquet(a.out)
        return 0
    vectors = spark.read.parquet(a.vectors) if a.vectors else embed_chunks(chunks)
    if a.command == "ask":
        questions = spark.createDataFrame([("q", a.question)], "query_id string, question string")
        row = answer(questions, retrieve(questions, chunks, vectors, settings.top_k, settings.hybrid_enabled), chunks).first()
        print(row.answer)
        for s in row.sources or ():
            print(f"  [{s.doc_id}|{s.page}|{s.chunk_id}] {s.score:.3f} {s.preview[:80]}")
        return 0
    dataset = spark.read.parquet(a.dataset)
    questions = dataset.select(F.col("entry_id").alias("query_id"), "question").dropDuplicates(["query_id"])
    judged = judge(answer(questions, retrieve(questions, chunks, vectors, settings.top_k, settings.hybrid_enabled), chunks), dataset)
    metrics = slice_metrics(judged)
    if a.out:
        judged.write.parquet(f"{a.out}/judgments")
        write_report_csv(metrics, f"{a.out}/report")
    print(markdown_report(metrics, report_examples(judged, "query_id")))
    return 0


if __name__ == "__main__":
    sys.exit(main())
