"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Examples are a bounded sample of training labels (EXAMPLES, by hash order). A term's weight is its logarithmic
frequency times its inverse document frequency, counted over all documents, times the root of the likelihood
ratio G2 of its presence among toxic and other examples. Every term of every example counts; a term that no
example has tells nothing, its G2 is 0, and so is its weight, by the rule itself. Terms are known by a hash of
64 bits.

The index keeps, by term, its examples and weights. Terms that few examples have are summed first; those that
many have (over one in DENSE) lie in rows over all examples with their largest weight in each block of
BLOCK. A block's upper bound is its best sum so far plus what the frequent terms can add there. A search sums
the blocks of the highest bounds, and of the others those whose bound reaches the k-th best; so it is exact.
Examples that tie with the k-th all vote. Votes are weighted by similarity; a logistic fit of leave-one-out votes makes them scores.

A text with no term of an example is the zero vector, whose neighbours are the examples that are zero too;
null and empty texts are such. Long texts are scored whole. Repeated rows are scored alike. Labels that are
null, repeated or of other values are passed over (of repeated ones the larger holds). Without examples of both
classes the score is the known share, or 0. An empty table gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Collection, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.frames import kept, map_arrow, texts

EXAMPLES, NEIGHBOURS, BLOCK, DENSE, PRIOR = 4096, 25, 64, 2, 1.0
WORD = regex.compile(r"\p{L}+")
#: Latin-1 bytes as WORD finds their lower case: letters, and blanks for all others.
LATIN = bytes(ord(c.lower()) if WORD.fullmatch(c.lower()) else 32 for c in map(chr, range(256)))
#: Texts whose answers a worker remembers, by digest.
MEMO = 20_000


def words(text: str) -> list[bytes]:
    """A text's terms in lower case, as UTF-8."""
    try:
        said = text.encode("latin-1").translate(LATIN)
    except UnicodeEncodeError:
        return " ".join(WORD.findall(text.lower())).encode("utf-8", "surrogatepass").split()
    return (said if text.isascii() else said.decode("latin-1").encode()).split()


def hashes(terms: Collection[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, terms), np.uint64, len(terms)).view(np.int64)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a text's terms, sorted, and how often each occurs."""
    found = Counter(words(text))
    keys = hashes(found)
    order = np.argsort(keys)
    return keys[order], np.fromiter(found.values(), np.int64, len(found))[order]


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def training(labels: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """(doc_id, toxic) of the examples: never a held-out document."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out())
    return known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples)


def places(vocabulary: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are in the sorted vocabulary, and where those are."""
    if not len(vocabulary):
        return np.zeros(len(keys), bool), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(vocabulary, keys), len(vocabulary) - 1)
    there = vocabulary[at] == keys
    return there, at[there]


def relevance(toxic: np.ndarray, terms: list[np.ndarray], size: int) -> np.ndarray:
    """The root of each term's G2: how unlike its shares among toxic and other examples are."""
    seen = np.stack([np.bincount(np.concatenate([np.zeros(0, np.int64), *(t for t, y in zip(terms, toxic) if y == c)]), minlength=size) for c in (1, 0)]).astype(float)
    rows = np.array([[toxic.sum()], [len(toxic) - toxic.sum()]])
    share = seen.sum(0) / max(len(toxic), 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        cell = lambda n, want: np.where(n > 0, n * np.log(n / want), 0.0)
        g2 = 2 * (cell(seen, rows * share) + cell(rows - seen, rows * (1 - share))).sum(0)
    return np.sqrt(np.maximum(g2, 0))


@dataclass
class Index:
    """Examples by term and block; calibration by two numbers."""

    vocabulary: np.ndarray
    weight: np.ndarray
    ids: np.ndarray
    toxic: np.ndarray
    rows: list[tuple[np.ndarray, np.ndarray]]
    neighbours: int = NEIGHBOURS
    slope: float = 1.0
    shift: float = 0.0
    prior: float = field(init=False)

    def __post_init__(self) -> None:
        n, size = len(self.ids), len(self.vocabulary)
        heaviest = [int(o[w.argmax()]) if len(o) else -1 for o, w in self.rows]
        order = np.lexsort((self.ids, heaviest))  # examples of one telling term share blocks
        self.ids, self.toxic, self.rows = self.ids[order], self.toxic[order], [(self.rows[i][0], self.rows[i][1].astype(np.float32)) for i in order]
        self.prior = float(self.toxic.mean()) if n else 0.0
        self.zero = np.array([i for i, r in enumerate(self.rows) if not len(r[0])], np.int64)
        blocks = max(1, -(-n // BLOCK))
        term = np.concatenate([np.zeros(0, np.int64), *(r[0] for r in self.rows)])
        who = np.repeat(np.arange(n), [len(r[0]) for r in self.rows])
        said = np.concatenate([np.zeros(0, np.float32), *(r[1] for r in self.rows)])
        by = np.argsort(term, kind="stable")
        term, self.who, self.said = term[by], who[by].astype(np.int32), said[by]
        many = np.bincount(term, minlength=size)
        self.first = np.concatenate([[0], np.cumsum(many)])
        frequent = np.flatnonzero(many * DENSE > n)
        self.row = np.full(size, -1, np.int32)
        self.row[frequent] = np.arange(len(frequent))
        self.dense = np.zeros((len(frequent), blocks, BLOCK), np.float32)
        for k, t in enumerate(frequent.tolist()):
            a, z = self.first[t], self.first[t + 1]
            self.dense[k].ravel()[self.who[a:z]] = self.said[a:z]
        self.bounds = self.dense.max(2)

    def vector(self, keys: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The unit vector of counted terms."""
        there, at = places(self.vocabulary, keys)
        return weigh(self.weight, at, tf[there])

    def search(self, ords: np.ndarray, w: np.ndarray, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Examples and cosines of the k nearest and all that tie with the k-th."""
        if not len(ords):
            near = self.zero[self.zero != skip]
            return near, np.ones(len(near))
        row = self.row[ords]
        often = row >= 0
        a, z = self.first[ords[~often]], self.first[ords[~often] + 1]
        n = z - a
        at = np.repeat(a - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        held = np.bincount(self.who[at], np.repeat(w[~often], n) * self.said[at], minlength=self.bounds.shape[1] * BLOCK)
        blocks, heavy, row = held.reshape(-1, BLOCK), w[often], row[often]
        upper = blocks.max(1) + np.einsum("i,ij->j", heavy, self.bounds[row])
        order = np.argsort(-upper, kind="stable")
        lead = order[: -(-2 * self.neighbours // BLOCK)]  # these give a first k-th best, and rule out most of the rest

        def summed(some: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
            sums = (blocks[some] + np.einsum("i,ijk->jk", heavy, self.dense[row[:, None], some])).ravel()
            place = (some[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            there = (sums > max(least - 1e-9, 0)) & (place != skip)
            return place[there], sums[there].round(9)

        def kth_of(score: np.ndarray) -> float:
            return float(np.partition(score, -self.neighbours)[-self.neighbours]) if len(score) >= self.neighbours else 0.0

        place, score = summed(lead, 0.0)
        kth = kth_of(score)
        rest = order[len(lead) :]
        rest = rest[(upper[rest] > 0) & (upper[rest] >= kth - 1e-9)]
        if len(rest):
            place, score = (np.concatenate(x) for x in zip((place, score), summed(rest, kth)))
            kth = kth_of(score)
        stay = (score >= kth) & (score > 0)
        return place[stay], score[stay]

    def vote(self, near: np.ndarray, score: np.ndarray) -> float:
        return float(((score * self.toxic[near]).sum() + PRIOR * self.prior) / (score.sum() + PRIOR))

    def calibrate(self) -> None:
        """Platt's two numbers from leave-one-out votes of the examples."""
        if not 0 < self.prior < 1:
            return
        x = logit(np.array([self.vote(*self.search(o, w, skip=i)) for i, (o, w) in enumerate(self.rows)]))
        y, ab = self.toxic, np.array([1.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(ab[0] * x + ab[1], -30, 30)))
            grad = np.array([((p - y) * x).sum() + 0.01 * (ab[0] - 1), (p - y).sum() + 0.01 * ab[1]])
            r = p * (1 - p)
            hess = np.array([[(r * x * x).sum() + 0.01, (r * x).sum()], [(r * x).sum(), r.sum() + 0.01]])
            step = np.linalg.solve(hess, grad)
            ab -= np.clip(step, -1, 1)
            if np.abs(step).max() < 1e-9:
                break
        self.slope, self.shift = (float(ab[0]), float(ab[1])) if ab[0] > 0 else (1.0, 0.0)

    def score(self, vote: float) -> float:
        if not 0 < self.prior < 1:
            return self.prior
        return float(1 / (1 + np.exp(-np.clip(self.slope * logit(vote) + self.shift, -30, 30))))


def weigh(weight: np.ndarray, ords: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vector of unit length; terms without weight are not in it."""
    w = (1 + np.log(np.maximum(tf, 1))) * weight[ords]
    ords, w = ords[w > 0], w[w > 0]
    return ords, w / np.sqrt((w * w).sum()) if len(w) else w


def logit(p: np.ndarray | float) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def build(docs: DataFrame, examples: DataFrame) -> Index:
    """The index over examples (doc_id, toxic), with document frequencies over all docs."""

    def terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, y, t in zip(b.column("doc_id"), b.column("toxic"), b.column("text")):
                keys, tf = counted(t.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([i.as_py()], pa.int64()), pa.array([y.as_py()], pa.int32()), pa.array([keys], pa.list_(pa.int64())), pa.array([tf], pa.list_(pa.int64()))], ["doc_id", "toxic", "keys", "tf"])

    told = texts(docs).join(F.broadcast(examples), "doc_id")  # EXAMPLES rows
    told = map_arrow(told, terms_of, "doc_id long, toxic int, keys array<long>, tf array<long>").dropDuplicates(["doc_id"])
    got = told.orderBy("doc_id").toArrow()  # the terms of EXAMPLES texts
    list_of = lambda c: [x.values.to_numpy(zero_copy_only=False) for x in got.column(c)]
    keys, tf = list_of("keys"), list_of("tf")
    vocabulary = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]))
    shared, size = docs.sparkSession.sparkContext.broadcast(vocabulary), len(vocabulary)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size + 1, np.int64)
        for b in batches:
            df[size] += b.num_rows
            for t in b.column("text"):
                df[places(shared.value, np.sort(hashes(set(words(t.as_py())))))[1]] += 1
        there = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(df[there])], ["t", "n"])

    df = np.zeros(size + 1)
    for b in map_arrow(texts(docs).select("text"), seen, "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow().to_batches():  # a row for each term of the examples
        df[b.column("t").to_numpy()] = b.column("n").to_numpy()
    n, df = df[size], df[:size]
    ids, toxic = (np.array(got.column(c).to_pylist(), kind) for c, kind in (("doc_id", np.int64), ("toxic", float)))
    ords = [places(vocabulary, k)[1] for k in keys]
    weight = (np.log((1 + n) / (1 + df)) + 1) * relevance(toxic, ords, size)
    index = Index(vocabulary, weight, ids, toxic, [weigh(weight, o, f) for o, f in zip(ords, tf)])
    index.calibrate()
    return index


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence): evidence holds up to NEIGHBOURS nearest examples' ids."""
    shared = docs.sparkSession.sparkContext.broadcast(build(docs, kept(training(labels), "examples")))  # the terms of EXAMPLES texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, memo = shared.value, {}
        for b in batches:
            out = []
            for t in b.column("text"):
                said = t.as_py()
                at = xxhash.xxh3_128_digest(said.encode("utf-8", "surrogatepass"))
                if at not in memo:
                    if len(memo) >= MEMO:
                        memo.clear()
                    near, sim = index.search(*index.vector(*counted(said)))
                    first = near[np.lexsort((index.ids[near], -sim))][: index.neighbours]
                    memo[at] = index.score(index.vote(near, sim)), index.ids[first].tolist()
                out.append(memo[at])
            s = [x[0] for x in out]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32()), pa.array([x[1] for x in out], pa.list_(pa.int64()))], ["doc_id", "score", "predicted", "evidence"])

    got = map_arrow(texts(docs), run, "doc_id long, score double, predicted int, evidence array<long>")
    return got.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted", "evidence")
