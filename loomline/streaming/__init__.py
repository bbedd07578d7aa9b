"""Repeated runs: waves of whole passes, and incremental pickup of new files."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def wave(run: Callable[[], object], passes: int, pause: float = 0.0) -> list[object]:
    """Run one pass after the other; a failure stops the wave and is raised."""
    out = []
    for i in range(passes):
        if i and pause:
            time.sleep(pause)
        out.append(run())
    return out


def ripple(spark: SparkSession, source: str, schema: StructType, transform: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> None:
    """Append what new Parquet files give since the last call, exactly once, and return when all are done."""
    new = transform(spark.readStream.schema(schema).parquet(source))
    new.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
