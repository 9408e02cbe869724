"""Making the package importable where Python workers run."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Sends the package's source to all executors, once per Spark context.

    The archive lies on the driver, from where Spark serves it to each executor that asks,
    also to ones that join later.
    """
    context = spark.sparkContext
    if getattr(context, "_pagewright_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    if root.is_dir():
        path = Path(tempfile.mkdtemp(prefix="pagewright-")) / "pagewright.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        context.addPyFile(str(path))
    context._pagewright_shipped = True
