"""Reading the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagewright.plans.shipping import ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder; pruning and pushdown are left to Catalyst."""
    ship(spark)
    # A union that keeps its parts' partitioning zips them, which fails when adaptive execution coalesces the parts differently.
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark.read.parquet(f"{folder}/{name}.parquet")
