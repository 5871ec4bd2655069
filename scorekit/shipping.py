"""Takes the package to the executors, for sessions whose Python workers would not find it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_MARK = "_scorekit_shipped"


def ship(spark: SparkSession) -> None:
    """Add the package's source to the session's Python files, once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, _MARK, False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="scorekit-")) / "scorekit.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    setattr(context, _MARK, True)


#: Bytes of one Arrow batch: texts and blocks differ in length by orders of magnitude, so rows alone do not bound a batch.
BATCH_BYTES = 4 << 20
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Bound batches by bytes in this session, unless a smaller bound is set."""
    now = spark.conf.get(_BYTES, None)
    try:
        unset = now is None or int(now) <= 0 or int(now) > BATCH_BYTES
    except ValueError:
        unset = True
    if unset:
        spark.conf.set(_BYTES, str(BATCH_BYTES))
