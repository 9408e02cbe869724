"""Cutting lineage in a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a folder of our own only where the setting is missing (tests, local runs)."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.gettempdir()}/pagewright-shared"
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    A written table survives the loss of executors, is columnar and compressed, and
    later readers prune its columns; each call has a folder of its own, so that runs
    do not meet.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class Blocks:
    """Rows written to the shared folder in blocks that tasks read one after the other."""

    files: tuple[str, ...]

    def read(self) -> Iterator[pa.Table]:
        for file in self.files:
            system, path = pyarrow.fs.FileSystem.from_uri(file)
            yield pyarrow.parquet.ParquetFile(system.open_input_file(path)).read()


def written_blocks(rows: DataFrame, key: str, size: int, what: str) -> Blocks:
    """``rows`` in blocks of about ``size`` keys, by the hash of the key; rows of a key stay together.

    No task sorts or holds all rows, and nothing but the names of the files, one per block,
    comes to the driver.
    """
    spark = rows.sparkSession
    kept = materialize(rows, what)
    n = max(1, -(-kept.select(key).distinct().count() // size))
    path = f"{shared_folder(spark).rstrip('/')}/{what}-blocks-{uuid.uuid4().hex}"
    kept.repartition(n, F.xxhash64(key)).write.option("maxRecordsPerFile", 0).parquet(path)
    return Blocks(tuple(sorted(spark.read.parquet(path).inputFiles())))
