"""Importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Both models are bags of hashed byte n-grams (GRAMS bytes, BUCKETS buckets). The raw model counts every
document; the target model counts a bounded, documented sample of documents labelled as good. The n-grams of
one text are not independent: n of them tell as much as n / (1 + (n - 1) / ALIKE) that are, as in a sample of
clusters. A document's log weight is its mean log ratio times that number, so that a long text of a rarer language
does not sink by its length alone. Gumbel noise, fixed by seed and doc_id (by the text where there is none), is
added, and the k largest are the sample: k = rows x the share of good labels, two standard errors upward.
The k-th value is found by radix selection, without sorting; rows that tie with it are all in the sample.

Null and empty texts have weight 0; long texts are weighed whole, a piece at a time. Rows that repeat a doc_id and
text have one weight and stay or go together. Without labels of either kind nothing is known and all rows stay. An
empty table gives an empty table. Extra columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.frames import kept, map_arrow, texts

GRAMS, BUCKETS_LOG2, ALIKE, SMOOTH, TARGETS, SEED = (3, 6), 18, 400, 1.0, 20_000, 7
#: n-grams counted at once.
CHUNK = 1 << 20


def hashed(text: str, grams: tuple[int, ...] = GRAMS, bits: int = BUCKETS_LOG2) -> Iterator[np.ndarray]:
    """Buckets of a text's n-grams, in pieces of bounded size."""
    raw = text.encode("utf-8", "surrogatepass")
    for at in range(0, len(raw), CHUNK):
        part = raw[at : at + CHUNK + max(grams) - 1] + bytes(8)
        every = np.ndarray((len(part) - 7,), "<u8", part, strides=(1,))
        for n in grams:
            some = min(CHUNK, len(part) - 8 - n + 1)
            if some > 0:
                yield ((every[:some] & np.uint64((1 << 8 * n) - 1)) * np.uint64(0x9E3779B97F4A7C15 + 2 * n) >> np.uint64(64 - bits)).astype(np.int32)


@dataclass
class Model:
    """Log ratios by bucket, and the share of rows to keep."""

    ratio: np.ndarray
    share: float
    seed: int = SEED

    def weight(self, text: str) -> float:
        total, n = 0.0, 0
        for part in hashed(text):
            total, n = total + float(self.ratio[part].sum()), n + len(part)
        return total / (1 + (n - 1) / ALIKE) if n else 0.0

    def key(self, doc_id: int | None, text: str) -> tuple[float, int]:
        """The weight, and the weight plus Gumbel noise as an integer of the same order."""
        weight, name = self.weight(text), str(doc_id) if doc_id is not None else f"\0{text}"
        u = (xxhash.xxh64_intdigest(name.encode("utf-8", "surrogatepass"), self.seed) + 0.5) / 2**64
        bits = int(np.float64(weight - np.log(-np.log(u)) + 0.0).view(np.int64))
        return weight, bits if bits >= 0 else bits ^ 0x7FFFFFFFFFFFFFFF


def fit(docs: DataFrame, labels: DataFrame, targets: int = TARGETS, seed: int = SEED) -> Model:
    """Count both models over docs; labels (doc_id, quality) name the good documents."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n, good = known.agg(F.count("*"), F.sum("quality")).first()
    if not n or not good:
        return Model(np.zeros(1 << BUCKETS_LOG2), 1.0, seed)
    chosen = {r.doc_id for r in known.where("quality = 1").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(targets).collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << BUCKETS_LOG2), np.int64)
        held: tuple[list, list] = [], []

        def flush(k: int) -> None:
            if held[k]:
                counts[k] += np.bincount(np.concatenate(held[k]), minlength=1 << BUCKETS_LOG2)
                held[k].clear()

        size = [0, 0]
        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text")):
                for part in hashed(t.as_py()):
                    for k in (0, 1) if i in chosen else (0,):
                        held[k].append(part)
                        size[k] += len(part)
                        if size[k] > CHUNK:
                            flush(k)
                            size[k] = 0
        flush(0)
        flush(1)
        there = np.flatnonzero(counts[0]).astype(np.int32)
        for at in range(0, len(there), 1 << 16):
            some = there[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[0][some]), pa.array(counts[1][some])], ["bucket", "raw", "target"])

    summed = map_arrow(texts(docs), run, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    got = summed.toPandas()  # at most BUCKETS rows
    raw, target = np.zeros(1 << BUCKETS_LOG2), np.zeros(1 << BUCKETS_LOG2)
    raw[got.bucket.to_numpy()], target[got.bucket.to_numpy()] = got.raw, got.target
    if not target.sum():
        return Model(np.zeros(1 << BUCKETS_LOG2), 1.0, seed)
    part = target.sum() / raw.sum()
    ratio = np.log((target + SMOOTH * part) / target.sum()) - np.log((raw + SMOOTH) / raw.sum())
    p = good / n
    return Model(ratio, min(1.0, p + 2 * (p * (1 - p) / n) ** 0.5), seed)


def weights(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, log_weight, rank_key) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS doubles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            got = [m.key(i, t.as_py()) for i, t in zip(b.column("doc_id").to_pylist(), b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x[0] for x in got], pa.float64()), pa.array([x[1] for x in got], pa.int64())], ["doc_id", "log_weight", "rank_key"])

    return map_arrow(texts(docs), run, "doc_id long, log_weight double, rank_key long")


def kth_largest(keys: DataFrame, k: int) -> int:
    """The k-th largest of the longs in column rank_key: four histograms of 16 bits, each summed before the shuffle."""
    high = F.shiftrightunsigned(F.col("rank_key").bitwiseXOR(F.lit(-(1 << 63))), 48)
    prefix, rest = 0, keys
    for level in range(4):
        digit = high if level == 0 else F.shiftrightunsigned("rank_key", 48 - 16 * level).bitwiseAND(F.lit(0xFFFF).cast("long"))
        counts = sorted(((r.digit, r.n) for r in rest.groupBy(digit.alias("digit")).agg(F.count("*").alias("n")).collect()), reverse=True)
        for d, n in counts:
            if k <= n:
                break
            k -= n
        rest, prefix = rest.where(digit == d), prefix << 16 | d
    return prefix - (1 << 63)


def threshold(scored: DataFrame, model: Model) -> int:
    """The smallest rank_key in the sample."""
    n = scored.count()
    return kth_largest(scored, max(1, int(np.ceil(n * model.share)))) if n else 0


def resample(docs: DataFrame, labels: DataFrame, **how: int) -> DataFrame:
    """(doc_id, log_weight, rank_key) of the documents in the sample."""
    model = fit(docs, labels, **how)
    scored = kept(weights(docs, model), "weights")
    return scored.where(F.col("rank_key") >= threshold(scored, model))


def filtered(docs: DataFrame, labels: DataFrame, **how: int) -> DataFrame:
    """The rows of docs in the sample, all columns: texts are weighed again rather than shuffled."""
    model = fit(docs, labels, **how)
    least = threshold(kept(weights(docs, model), "weights"), model)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            stay = [m.key(i, t.as_py() or "")[1] >= least for i, t in zip(b.column("doc_id").to_pylist(), b.column("text"))]
            yield b.filter(pa.array(stay, pa.bool_()))

    return map_arrow(docs, run, docs.schema)
