"""Tables written to the folder that the cluster shares, to cut lineage.

A written table survives the loss of any executor: it is read back from the shared file system instead of
being recomputed from shuffle files.  The folder is the session's ``spark.checkpoint.dir``; only where that is
unset and Spark runs in this process (tests, a laptop) is a temporary folder made.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended; nothing is left to ask
        pass


def shared_dir(spark: SparkSession) -> str:
    """The folder for written tables; sets one only where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="bagsieve-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return the table read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_delete, spark, path)
    back = spark.read.schema(df.schema).parquet(path)
    back._written_to = path
    return back


def discard(table: DataFrame) -> None:
    """Delete a table that ``written`` made, when nothing that is still to run reads it."""
    _delete(table.sparkSession, table._written_to)
