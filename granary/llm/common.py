"""Shared parts of the text operators: tables, partitions, kept results, Arrow maps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one Arrow batch may hold, and rows.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2_000


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*(columns or ("doc_id", "text")))


def tokenizer_path(name: str) -> str:
    """The installed place of a public tokenizer's file; the same on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small: texts can be very long, and workers have little memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or, only where that is
    unset and there is but one machine (as in tests), a new temporary folder that is then set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='granary-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write a result to the shared folder and read it again: cuts the lineage, survives
    lost executors, and is computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete what `kept` wrote, once nothing will read it again."""
    spark = df.sparkSession
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def arrow_map(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema) -> DataFrame:
    """One record batch out (or none) for each batch in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (out := f(b)) is not None and out.num_rows:
                yield out
                del out
            pa.default_memory_pool().release_unused()  # the JVM beside needs it

    return df.mapInArrow(run, schema)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


def remainder(doc_id, m: int):
    """crc32 of the id as text, modulo m."""
    return F.crc32(doc_id.cast("string").cast("binary")) % m


__all__ = ["BATCH_BYTES", "BATCH_ROWS", "arrow_map", "bounded_batches", "discard", "documents", "kept", "partitions", "remainder", "shared_dir", "text_bytes", "tokenizer_path"]
