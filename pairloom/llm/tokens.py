"""Token counts from flat token files: a separator scan over blocks.

A shard is a flat run of unsigned 16- or 32-bit identifiers, documents ending in one separator, with no
index. It is stored in blocks of a fixed number of identifiers that know nothing of documents. The scan
searches each block for separators with one vectorised comparison and keeps the distances between them; what
a block holds before its first and after its last separator is stitched to its neighbours by a prefix scan
over the blocks of the shard (a running sum of open tails since the last separator).

pack() makes such shards from texts, and keeps apart, in a second column, which document was written when;
scan() never looks at it. read_flat() cuts flat files into the same blocks by byte ranges; no task holds a file.
Identifiers take 16 bits where the vocabulary's largest one fits, else 32. The tokenizer's special strings are
ordinary text, so that a separator is never part of a document.

Null and empty texts have no tokens; long texts span as many blocks as they need. Rows repeat as they are, so ties
need no rule. An empty table gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.llm.frames import kept, map_arrow, texts

#: Identifiers in a block.
BLOCK = 1 << 20


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def width(largest: int) -> np.dtype:
    """The type of identifiers up to the largest."""
    return np.dtype("<u2") if largest < 1 << 16 else np.dtype("<u4")


def pack(docs: DataFrame, path: str, pattern: str, eod: int, block: int = BLOCK) -> DataFrame:
    """(shard, block_no, ids binary, written array<doc_id>): flat shards, one for each input partition.

    written lists, in order, the documents that ended in the block.
    """
    kind = width(max(eod, tokenizer(path, pattern).max_token_value))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard, number = tokenizer(path, pattern), TaskContext.get().partitionId(), 0
        held, size, written = [], 0, []

        def out(ids: np.ndarray, names: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([number], pa.int64()), pa.array([ids.tobytes()], pa.binary()), pa.array([names], pa.list_(pa.int64()))], ["shard", "block_no", "ids", "written"])

        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text")):
                held.append(np.append(np.asarray(coder.encode_to_numpy(t.as_py()) if len(t.as_py()) else [], dtype=kind), kind.type(eod)))
                size += len(held[-1])
                written.append(i)
                if size >= block:
                    flat = np.concatenate(held)
                    for at in range(0, len(flat) - block + 1, block):
                        last = at + 2 * block > len(flat)
                        part = flat[at : at + block]
                        n = int((part == eod).sum())
                        yield out(part, written[:n])
                        written, number = written[n:], number + 1
                        if last:
                            flat = flat[at + block :]
                            break
                    held, size = [flat], len(flat)
        if size:
            yield out(np.concatenate(held), written)

    return map_arrow(texts(docs), run, "shard long, block_no long, ids binary, written array<long>")


def read_flat(spark: SparkSession, path: str, largest: int, block: int = BLOCK) -> DataFrame:
    """(shard, block_no, ids) from flat files in a folder: a shard for each file, in blocks read by byte ranges.

    Spark lists the files; each range is opened by pyarrow's filesystems (local, hdfs, s3, gs). Bytes after the last
    whole identifier are an error.
    """
    size = width(largest).itemsize
    files = spark.read.format("binaryFile").load(path).select("path", "length")  # contents are pruned
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("length") / (size * block)) - 1, F.lit(0)))).alias("block_no"))
    ranges = ranges.repartition("path", "block_no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for name, length, number in zip(*(b.column(c).to_pylist() for c in ("path", "length", "block_no"))):
                if length % size:
                    raise ValueError(f"{name} has {length} bytes, which are no whole number of identifiers of {size} bytes")
                store, at = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", re.sub("^file:/*", "file:///", quote(name, safe="/:"))))
                with store.open_input_file(at) as f:
                    ids = f.read_at(min(size * block, length - number * size * block), number * size * block)
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh64_intdigest(name) >> 1], pa.int64()), pa.array([number], pa.int64()), pa.array([ids], pa.binary())], ["shard", "block_no", "ids"])

    return map_arrow(ranges.select("path", "length", F.col("block_no").cast("long")), run, "shard long, block_no long, ids binary")


def scan(blocks: DataFrame, eod: int, largest: int) -> DataFrame:
    """(shard, ordinal, n_tokens) of every document in (shard, block_no, ids), in order from 0.

    Identifiers after a shard's last separator are a document that was cut off; it is counted too.
    """
    kind = width(max(eod, largest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            inner, head, tail, ends = [], [], [], []
            for raw in b.column("ids"):
                ids = np.frombuffer(raw.as_py(), kind)
                at = np.flatnonzero(ids == eod)
                ends.append(len(at))
                head.append(int(at[0]) if len(at) else 0)
                tail.append(len(ids) - int(at[-1]) - 1 if len(at) else len(ids))
                inner.append((np.diff(at) - 1).tolist())
            yield pa.RecordBatch.from_arrays([b.column("shard"), b.column("block_no"), pa.array(ends, pa.int64()), pa.array(head, pa.int64()), pa.array(tail, pa.int64()), pa.array(inner, pa.list_(pa.int64()))], ["shard", "block_no", "ends", "head", "tail", "inner"])

    found = kept(map_arrow(blocks.select("shard", "block_no", "ids"), run, "shard long, block_no long, ends long, head long, tail long, inner array<long>"), "separators")
    order = Window.partitionBy("shard").orderBy("block_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("group", F.coalesce(F.sum((F.col("ends") > 0).cast("long")).over(before), F.lit(0)))
    found = found.withColumn("first", F.coalesce(F.sum("ends").over(before), F.lit(0)))
    # the running sum of tails since the block that held the last separator
    found = found.withColumn("open", F.coalesce(F.sum(F.when(F.col("ends") > 0, 0).otherwise(F.col("tail"))).over(Window.partitionBy("shard", "group").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    carried = F.coalesce(F.last(F.when(F.col("ends") > 0, F.col("tail")), ignorenulls=True).over(before), F.lit(0))
    found = found.withColumn("carried", carried + F.col("open"))
    sized = found.where("ends > 0").select("shard", "first", F.posexplode(F.concat(F.array(F.col("carried") + F.col("head")), F.col("inner"))).alias("at", "n_tokens"))
    whole = sized.select("shard", (F.col("first") + F.col("at")).alias("ordinal"), "n_tokens")
    rest = found.groupBy("shard").agg(F.sum("ends").alias("ordinal"), F.max_by(F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("carried") + F.col("tail")), "block_no").alias("n_tokens"))
    return whole.unionByName(rest.where("n_tokens > 0"))


def counts(docs: DataFrame, path: str, pattern: str, eod: int, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_tokens) of every text, by packing and scanning flat shards in the shared folder."""
    flat = kept(pack(docs, path, pattern, eod, block), "tokens")
    order = Window.partitionBy("shard").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    listed = flat.select("shard", "block_no", "written", F.size("written").alias("n"))
    listed = listed.withColumn("first", F.coalesce(F.sum("n").over(order), F.lit(0)))
    listed = listed.select("shard", "first", F.posexplode("written").alias("at", "doc_id")).select("shard", (F.col("first") + F.col("at")).alias("ordinal"), "doc_id")
    return scan(flat, eod, tokenizer(path, pattern).max_token_value).join(listed, ["shard", "ordinal"]).select("doc_id", "n_tokens")
