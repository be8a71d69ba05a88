"""Session helpers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable on every executor, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parents[2]
        target = Path(tempfile.mkdtemp(prefix="marram-ship-")) / "marram_package.zip"
        with zipfile.ZipFile(target, "w") as z:
            for source in sorted((root / "marram").rglob("*.py")):
                z.write(source, source.relative_to(root))
        spark.sparkContext.addPyFile(str(target))
        _shipped.add(app)
    return spark
