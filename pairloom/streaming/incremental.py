"""An extension, not part of the batch contract: contamination checks of new documents as they arrive.

A stream of (doc_id, text) is probed, micro-batch by micro-batch, against stored bands of training texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pairloom.functions import text
from pairloom.operators import dedup


def index(train: DataFrame, path: str) -> None:
    """Store training texts, normalized, and their bands."""
    docs = train.select(F.col("doc_id").alias("train_id"), text.normalize(F.col("text")).alias("s"))
    docs.write.parquet(f"{path}/texts")
    dedup.banded(dedup.minhash(docs, "train_id", "s"), "train_id").write.parquet(f"{path}/bands")


def probe(batch: DataFrame, path: str, threshold: float = dedup.THRESHOLD) -> DataFrame:
    """(doc_id, best, similarity) of the batch's contaminated documents."""
    spark = batch.sparkSession
    docs = batch.select("doc_id", text.normalize(F.col("text")).alias("s"))
    bands = dedup.banded(dedup.minhash(docs, "doc_id", "s"), "doc_id")
    met = dedup.candidates(bands, spark.read.parquet(f"{path}/bands"), "doc_id", "train_id")
    exact = dedup.verified(met, docs, spark.read.parquet(f"{path}/texts"), "doc_id", "train_id", "s")
    return dedup.contaminated(exact, "doc_id", "train_id", threshold)


def watch(stream: DataFrame, path: str, out: str, checkpoint: str) -> StreamingQuery:
    """Write each micro-batch's contaminated documents; a batch that is retried replaces its own folder."""

    def each(batch: DataFrame, number: int) -> None:
        probe(batch, path).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
