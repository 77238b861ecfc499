"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, then Hamming distance.

A fingerprint of 64 bits is cut into BLOCKS blocks. Two fingerprints that differ in at most DISTANCE bits
agree in at least BLOCKS - DISTANCE blocks, so joining on every choice of that many blocks finds every
close pair. Only distinct fingerprints are joined: exact copies meet in a group-by first. A block value
shared by more than HOT distinct fingerprints is cut into tiles of bounded size, each of which returns a
spanning forest of its links rather than its pairs; connectivity, and so the components, are the same.

Tables that grow with the corpus are merged, never broadcast, as small as they are on disk: the driver would hold them whole.

Null and empty texts have fingerprint zero and link like any other; long texts are hashed whole, in pieces.
Repeated rows share one component. Ties need no rule: links are symmetric, and a component is named by its
smallest doc_id (null only where all of its rows lack one). Extra columns are ignored. An empty table gives an
empty table.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm import neartexts
from pairloom.llm.components import components
from pairloom.llm.frames import kept, map_arrow, texts

WORDS, SEED, DISTANCE, BLOCKS = 4, 42, 4, 7
#: Distinct fingerprints in one block value that a plain join takes; more go in tiles of TILE.
HOT, TILE = 64, 2048
#: Shingles hashed at once, so that one long text stays bounded.
CHUNK = 1 << 16
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str, words: int = WORDS) -> int:
    """The unsigned fingerprint of one text."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    words = min(words, len(parts))
    ones, n = np.zeros((8, 8), np.int64), len(parts) - words + 1
    for at in range(0, n, CHUNK):
        some = parts[at : at + CHUNK + words - 1]
        whole = b" ".join(some)
        ends = list(itertools.accumulate((len(x) + 1 for x in some), initial=0))
        hashed = [xxhash.xxh64_intdigest(whole[a : b - 1], SEED) for a, b in zip(ends, ends[words:])]
        columns = np.array(hashed, dtype=">u8").view(np.uint8).reshape(-1, 8)
        for k in range(8):
            ones[k] += np.bincount(columns[:, k], minlength=256) @ BITS
    return int.from_bytes(np.packbits((ones * 2 > n).ravel()).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp long): one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([fingerprint(t.as_py(), words) for t in b.column("text")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(got)], ["doc_id", "fp"])

    return map_arrow(texts(docs), run, "doc_id long, fp long")


def block_keys(fp: Column, distance: int = DISTANCE, blocks: int = BLOCKS) -> Column:
    """Array of the block values, one for each choice of blocks - distance blocks."""
    low, extra = divmod(64, blocks)
    widths = [low + (i < extra) for i in range(blocks)]
    starts = [sum(widths[:i]) for i in range(blocks)]
    value = [F.shiftrightunsigned(fp, s).bitwiseAND(F.lit((1 << w) - 1).cast("long")) for s, w in zip(starts, widths)]
    keys = []
    for n, chosen in enumerate(itertools.combinations(range(blocks), blocks - distance)):
        key = F.lit(n).cast("long")
        for i in chosen:
            key = F.shiftleft(key, widths[i]).bitwiseOR(value[i])
        keys.append(key)
    return F.array(*keys)


def tile_forest(fp: np.ndarray, rep: np.ndarray, side: np.ndarray, same: bool, distance: int) -> list[tuple[int, int]]:
    """Links of one tile as a forest over its members, found without keeping its pairs."""
    root = list(range(len(fp)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links = []
    for i in range(len(fp)):
        near = np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= distance) + i + 1
        for j in near if same else near[side[near] != side[i]]:
            if (a := find(i)) != (b := find(int(j))):
                root[b] = a
                links.append((int(rep[i]), int(rep[j])))
    return links


def links(reps: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """(u, v): links that connect exactly what close pairs of reps (fp, rep) connect."""
    keyed = reps.select("fp", "rep", F.explode(block_keys(F.col("fp"), distance, blocks)).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = kept(keyed.join(shared.hint("merge"), "key"), "blocks")
    cold = met.where(F.col("n") <= HOT)
    a, b = cold.select("key", "fp", "rep"), cold.select("key", F.col("fp").alias("fp2"), F.col("rep").alias("rep2"))
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= distance
    plain = a.join(b.hint("merge"), (a["key"] == b["key"]) & (F.col("fp") < F.col("fp2")) & close).select(F.col("rep").alias("u"), F.col("rep2").alias("v")).distinct()

    tiles = F.ceil(F.col("n") / TILE)
    dealt = met.where(F.col("n") > HOT).withColumn("side", F.pmod(F.xxhash64("fp"), tiles))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)))
    dealt = dealt.select("key", "fp", "rep", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("fp")
        found = tile_forest(part.fp.to_numpy().view(np.uint64), part.rep.to_numpy(), part.side.to_numpy(), bool(part.i.iloc[0] == part.j.iloc[0]), distance)
        return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    return plain.unionByName(dealt.groupBy("key", "i", "j").applyInPandas(run, "u long, v long"))


def near_duplicates(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, fingerprint, component_id): components of documents linked within the distance.

    component_id is the smallest doc_id that can be reached, the document itself included.
    """
    found = kept(fingerprints(docs, words), "fingerprints")
    reps = kept(found.groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps")
    stars = components(links(reps, distance, blocks))
    roots = kept(reps.join(stars.hint("merge"), reps["rep"] == stars["node"], "left").select("fp", F.coalesce("root", "rep").alias("component_id")), "roots")
    # both sides are plain scans, so that a fingerprint of many copies is split by the skew-join rule
    return found.join(roots.hint("merge"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, per_cent: int = neartexts.PER_CENT) -> DataFrame:
    """docs with one document of each group of near copies: five-word shingles, a similarity of per_cent or more.

    A similarity of 0.8 is beyond blocks of 64 bits (such pairs differ in ten bits on average), so this form of the
    operator joins on blocks of wider SimHash fingerprints, takes their Hamming distance and verifies whole sets; see neartexts.
    """
    return neartexts.deduplicated(docs, per_cent)
