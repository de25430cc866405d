"""Makes this package importable in Python workers that don't have the repository on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files once, unless workers inherit it by PYTHONPATH."""
    sc = spark.sparkContext
    if getattr(sc, "_attrispark_shipped", False):
        return
    sc._attrispark_shipped = True
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    to = Path(tempfile.mkdtemp()) / "attrispark_worker.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in (ROOT / "attrispark").rglob("*.py"):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(str(to))
