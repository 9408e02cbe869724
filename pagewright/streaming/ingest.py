"""Streams: files and log rows as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from pagewright.operators.vectors import upsert
from pagewright.sources.store import current, replace_table


def arriving_files(spark: SparkSession, folder: str, pattern: str = "*.pdf", per_batch: int = 100) -> DataFrame:
    """New files of a folder as a stream of (path, modificationTime, length, content)."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_batch).load(folder)


def arriving_rows(spark: SparkSession, folder: str, schema: str, fmt: str = "json") -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).load(folder)


def stage_windows(timing: DataFrame, time: str = "timestamp", stage: str = "stage", duration: str = "duration_ms", window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Calls and mean duration per stage and tumbling window; rows later than the watermark are dropped."""
    grouped = timing.withWatermark(time, late).groupBy(F.window(time, window), stage)
    return grouped.agg(F.count("*").alias("calls"), F.avg(duration).alias("mean")).select(F.col("window.start").alias("window_start"), stage, "calls", "mean")


def once_per_key(rows: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def run_batches(stream: DataFrame, step: Callable[[DataFrame, int], None], on_error: Callable[[int, Exception], None], checkpoint: str, error_sink: str | None = None, key: str | None = None) -> StreamingQuery:
    """Runs ``step`` on each batch until all that is there is done; an error is reported and the stream goes on.

    When the step fails on a batch, it is run on each ``key`` of the batch alone, so that one
    bad file costs only itself; rows that fail alone, or the batch where no key is given, are
    appended to ``error_sink`` before the offset is committed, so no input is lost. Without a
    sink a failing batch ends the stream, and is tried again by the next run. A batch has as many
    keys as its source allows (``maxFilesPerTrigger``).
    """
    def keep(rows: DataFrame, number: int, e: Exception) -> None:
        on_error(number, e)
        if error_sink is None:
            raise e
        rows.withColumns({"_batch": F.lit(number), "_error": F.lit(f"{type(e).__name__}: {e}"[:10_000])}).write.mode("append").parquet(error_sink)

    def safe(batch: DataFrame, number: int) -> None:
        try:
            step(batch, number)
        except Exception as e:  # noqa: BLE001
            if key is None or error_sink is None:
                keep(batch, number, e)
                return
            for (value,) in batch.select(key).distinct().collect():
                one = batch.where(F.col(key).eqNullSafe(F.lit(value)))
                try:
                    step(one, number)
                except Exception as alone:  # noqa: BLE001
                    keep(one, number, alone)

    return stream.writeStream.foreachBatch(safe).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_vectors(stream: DataFrame, index_path: str, on_error: Callable[[int, Exception], None], checkpoint: str) -> StreamingQuery:
    """Keeps a versioned vector table up to date with a stream of vectors."""
    def step(batch: DataFrame, number: int) -> None:
        replace_table(upsert(current(batch.sparkSession, index_path), batch), index_path)

    return run_batches(stream, step, on_error, checkpoint)


class Progress(StreamingQueryListener):
    """Calls back with the number of rows of each batch."""

    def __init__(self, tell: Callable[[int, int], None]):
        self.tell = tell

    def onQueryStarted(self, event) -> None: ...  # noqa: N802, ANN001

    def onQueryProgress(self, event) -> None:  # noqa: N802, ANN001
        self.tell(event.progress.batchId, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None: ...  # noqa: N802, ANN001

    def onQueryTerminated(self, event) -> None: ...  # noqa: N802, ANN001
