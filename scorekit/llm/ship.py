"""Takes the package to the executors, for sessions whose Python workers would not find it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

import scorekit

_MARK = "_scorekit_shipped"


def ship(spark: SparkSession) -> None:
    """Add the package's source to the session's Python files, once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, _MARK, False):
        return
    root = Path(scorekit.__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="scorekit-")) / "scorekit.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    setattr(context, _MARK, True)
