"""Wheels dropped into a folder, scanned as they come (Structured Streaming)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.plans.policy import Policy, load
from granary.plans.scan import Scan

_FILES = "path string, modificationTime timestamp, length long, content binary"


def dropped(spark: SparkSession, folder: str, files_a_batch: int = 64) -> DataFrame:
    """A stream of wheels; the source's own log is what has been seen."""
    raw = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", "*.whl").option("maxFilesPerTrigger", files_a_batch).load(folder)
    return raw.select("path", F.substring_index("path", "/", -1).alias("filename"), "content")


def scan_stream(spark: SparkSession, folder: str, checkpoint: str, sink: Callable[[DataFrame, int], None], policy: Policy | None = None, once: bool = False):
    """Scan each batch of new wheels and hand its records to the sink with the batch number;
    sinks keyed by it make a repeated batch harmless."""
    policy = policy or load()

    def batch(wheels: DataFrame, number: int) -> None:
        if not wheels.isEmpty():
            sink(Scan(wheels, policy).records(), number)

    writer = dropped(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
