"""Sending this package's code to the Python workers of a session that can't import it by itself."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once; not where PYTHONPATH already leads to it."""
    root = Path(__file__).resolve().parent
    on_path = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    app = spark.sparkContext.applicationId
    if app in _sent or str(root.parent) in on_path:
        return
    at = os.path.join(tempfile.mkdtemp(prefix="spark-loomgraph-code-"), "loomgraph.zip")
    with zipfile.ZipFile(at, "w") as out:
        for f in sorted(root.rglob("*.py")):
            out.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(at)
    _sent.add(app)
