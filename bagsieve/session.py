"""What a session needs before Python stages of this library run on executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent
#: Bytes in an Arrow batch at most, where the session doesn't say: batches of long texts stay small then.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark context, and bound the batches that Python gets."""
    context = spark.sparkContext
    if spark.conf.get(_BATCH) == f"{64 << 20}b":  # the default
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    if getattr(context, "_bagsieve_shipped", False):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="bagsieve-"), f"{PACKAGE.name}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(PACKAGE.rglob("*.py")):
            z.write(path, path.relative_to(PACKAGE.parent))
    context.addPyFile(archive)
    context._bagsieve_shipped = True


def keep(rows: DataFrame) -> DataFrame:
    """Cuts lineage: a checkpoint where the context has a folder for them, else the cache."""
    context = rows.sparkSession.sparkContext
    return rows.checkpoint() if context._jsc.sc().getCheckpointDir().isDefined() else rows.cache()
