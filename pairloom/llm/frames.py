"""What the operators of this package share: reading, cleaning, and cutting lineage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables of a data folder; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, text) with null texts empty; every other column is pruned at the scan."""
    return docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, from spark.checkpoint.dir.

    Where that is unset, a local folder takes its place on a local master (tests); elsewhere that is an error,
    as executors would write to disks that others do not see.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that executors share")
        found = "file://" + tempfile.mkdtemp(prefix="pairloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def kept(df: DataFrame, name: str, zstd: int | None = None) -> DataFrame:
    """df written to the shared folder as Parquet and read back: lineage ends here.

    The rows outlive any executor, and a later stage reads only the columns it needs. All tables of an application
    are in one folder, pairloom/{application}, which can go when its results are written. zstd is a level of
    compression for what the session's own codec hardly shrinks.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/pairloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    how = {"compression": "zstd", "parquet.compression.codec.zstd.level": str(zstd)} if zstd else {}
    df.write.options(**how).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches by bytes rather than rows, so long texts do not pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")


def trimmed() -> None:
    """Hand what this process has freed back to the system: Python workers outlive their tasks, and wait beside the executor's next ones."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow with batches bounded in bytes; a task starts and ends without memory that only the allocator holds."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trimmed()
        try:
            yield from f(batches)
        finally:
            trimmed()

    return df.mapInArrow(run, schema)
