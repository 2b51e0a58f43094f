"""Selecting from bags as their files arrive: the streaming form of skipping bags that are done.

Each micro-batch is selected by a batch operator and appended; the query's checkpoint remembers the files, and a bag
that the target already holds isn't written again, so that a restarted batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.bags import write_selection


def select_arrivals(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, select: Callable[[DataFrame], DataFrame], once: bool = False) -> StreamingQuery:
    """Starts a stream over Parquet files of bags; ``select`` maps a batch's rows to (bag, vec_id)."""
    rows = spark.readStream.schema(schema).parquet(source)

    def land(batch: DataFrame, _: int) -> None:
        write_selection(select(batch), target)

    writer = rows.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
