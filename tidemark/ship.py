"""Make the package importable in Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once for each application."""
    root, context = Path(__file__).resolve().parent, spark.sparkContext
    if context.applicationId in _done:
        return
    path = f"{tempfile.mkdtemp()}/tidemark.zip"
    with zipfile.ZipFile(path, "w") as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, p.relative_to(root.parent))
    context.addPyFile(path)
    _done.add(context.applicationId)
