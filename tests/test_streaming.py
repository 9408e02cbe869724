import pytest
from pyspark.sql import functions as F

from pagewright.sources.store import current, replace_table
from pagewright.streaming import ingest as S


def test_one_bad_row_costs_only_itself(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"in{i}.json").write_text('{"k": %d, "ts": "2026-01-0%dT00:00:00Z"}\n' % (i, i + 1))
    rows = S.arriving_rows(spark, str(tmp_path / "in*.json"), "k int, ts timestamp")
    done, failed, sink = [], [], str(tmp_path / "errors")

    def step(batch, number):
        ks = [r.k for r in batch.collect()]
        if 1 in ks:
            raise RuntimeError("bad one")
        done.extend(ks)

    S.run_batches(rows, step, lambda n, e: failed.append(str(e)), str(tmp_path / "cp"), sink, "k").awaitTermination()
    assert sorted(done) == [0, 2] and failed == ["bad one"]
    assert [(r.k, r._error) for r in spark.read.parquet(sink).collect()] == [(1, "RuntimeError: bad one")]


def test_without_a_sink_a_failing_batch_is_tried_again(spark, tmp_path):
    (tmp_path / "in.json").write_text('{"k": 1}\n')
    rows = lambda: S.arriving_rows(spark, str(tmp_path / "in*.json"), "k int")
    failed, done = [], []

    def bad(batch, number):
        raise RuntimeError("down")

    with pytest.raises(Exception):  # noqa: B017
        S.run_batches(rows(), bad, lambda n, e: failed.append(str(e)), str(tmp_path / "cp")).awaitTermination()
    S.run_batches(rows(), lambda b, n: done.extend(r.k for r in b.collect()), lambda n, e: None, str(tmp_path / "cp")).awaitTermination()
    assert failed == ["down"] and done == [1]


def test_vectors_follow_a_stream(spark, tmp_path):
    index, src = str(tmp_path / "index"), tmp_path / "src"
    schema = "chunk_id string, vector array<float>"
    replace_table(spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], schema), index)
    spark.createDataFrame([("a", [3.0, 4.0])], schema).write.parquet(str(src))
    S.upsert_vectors(S.arriving_rows(spark, str(src), schema, "parquet"), index, lambda n, e: (_ for _ in ()).throw(e), str(tmp_path / "cp")).awaitTermination()
    got = {r.chunk_id: [round(x, 2) for x in r.vector] for r in current(spark, index).collect()}
    assert got == {"a": [0.6, 0.8], "b": [0.0, 1.0]}


def test_windows_and_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.pdf").write_bytes(b"%PDF")
    seen = []
    S.run_batches(S.arriving_files(spark, str(tmp_path / "d")), lambda b, n: seen.extend(r.path for r in b.select("path").collect()), lambda n, e: None, str(tmp_path / "cp")).awaitTermination()
    assert len(seen) == 1
    batch = spark.createDataFrame([("s", 5), ("s", 7)], "stage string, duration_ms int").withColumn("timestamp", F.lit("2026-01-01").cast("timestamp"))
    assert S.stage_windows(batch).first().mean == 6.0
