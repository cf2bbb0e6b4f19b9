"""Makes this package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, unless their Python path has it already."""
    sc = spark.sparkContext
    path = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if sc.applicationId in _shipped or str(ROOT) in path or (Path.cwd() == ROOT and sc.master.startswith("local[")):
        return
    target = Path(tempfile.mkdtemp()) / "graphloom.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted((ROOT / "graphloom").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)
