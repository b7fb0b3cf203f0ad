"""A cache of records by content, name and everything that shapes a record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.plans.scan import ANALYZER_VERSION, SCHEMA_VERSION, TOOL


def keyed(wheels: DataFrame) -> DataFrame:
    """(path, filename, wheel_id) of wheels: one map over their bytes."""
    key = F.sha2(F.concat(F.sha2("content", 256), "filename"), 256)
    return wheels.select(*[c for c in ("path",) if c in wheels.columns], "filename", key.alias("wheel_id"))


class RecordCache:
    """Parquet files under root, a folder for each salt; a new salt never reads old answers.
    The salt is of everything that shapes a record, the limits on members too."""

    def __init__(self, spark: SparkSession, root: str, ruleset: str, level: str = "standard", limits: str = ""):
        salt = spark.range(1).select(T.cache_key(F.lit(str(SCHEMA_VERSION)), F.lit(str(ANALYZER_VERSION)), F.lit(ruleset), F.lit(level), F.lit(TOOL), F.lit(limits))).first()[0]
        self.spark, self.path = spark, f"{root.rstrip('/')}/salt={salt}"

    def read(self) -> DataFrame:
        """(wheel_id, filename, line); nothing for a cache that is not there yet."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], "wheel_id string, filename string, line string")
        return self.spark.read.schema("wheel_id string, filename string, line string").parquet(self.path)

    def found(self, keys: DataFrame) -> DataFrame:
        """The rows of `keyed` that have a record, with it as `line`; a wheel read twice at the
        same time has two equal ones."""
        return keys.join(self.read().dropDuplicates(["wheel_id"]).select("wheel_id", "line"), "wheel_id")

    def misses(self, keys: DataFrame) -> DataFrame:
        """The rows of `keyed` without a record."""
        return keys.join(self.read().select("wheel_id"), "wheel_id", "left_anti")

    def put(self, records: DataFrame) -> None:
        """Add records (wheel_id, filename, line), but for those of wheels whose reading broke off."""
        from granary.sinks.jsonl import parsed

        parsed(records.select("wheel_id", "line"), "line").where("not aborted").select("wheel_id", "filename", "line").write.mode("append").parquet(self.path)
