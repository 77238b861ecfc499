"""BPE encoding and decoding with a contiguous rank array per word.

A word is held as its part boundaries and, beside them, the rank of each adjacent pair. The smallest
rank (the leftmost of equals) is sought by a scan, its right boundary is deleted, and the ranks at both
sides are refreshed. Words of more than LONG parts keep the same order of merges in a heap, so that a
word of a hundred thousand letters stays n log n. Words repeat, so a bounded memo holds their ids.

The vocabulary is read from a tokenizer file given by a parameter. The pre-tokenization is that of the
file: special strings are cut out first, then NFC, runs of white space to one blank, lower case by code
point, and the pieces that the file's pattern matches; each piece's UTF-8 bytes end in a word-end mark.

Null and empty texts have no tokens; the decoded text is then empty. Long texts are encoded whole. Of equal ranks
the leftmost pair merges first, so there are no ties. Repeated rows are encoded alike and returned as often. An
empty table gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import struct
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from pairloom.llm.frames import map_arrow, texts

#: Parts beyond which a word is merged by a heap, not by scans.
LONG = 96
#: Words in each of a worker's two memos; when the young one is full, it takes the old one's place.
MEMO = 250_000
NONE = 1 << 30


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def merge_scan(ids: list[int], ranks: dict[tuple[int, int], int], merged: list[int]) -> list[int]:
    """Merge one short word: parts and adjacent ranks are two contiguous arrays."""
    parts, rank_of = list(ids), ranks.get
    near = [rank_of(pair, NONE) for pair in zip(parts, parts[1:])]
    while near:
        best = min(near)
        if best == NONE:
            break
        i = near.index(best)
        parts[i] = merged[best]
        del parts[i + 1], near[i]
        if i < len(near):
            near[i] = rank_of((parts[i], parts[i + 1]), NONE)
        if i:
            near[i - 1] = rank_of((parts[i - 1], parts[i]), NONE)
    return parts


def merge_heap(ids: list[int], ranks: dict[tuple[int, int], int], merged: list[int]) -> list[int]:
    """Merge one long word in the same order, with linked boundaries and a heap of (rank, place)."""
    parts, n = list(ids), len(ids)
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    heap = [(got, i, parts[i], parts[i + 1]) for i in range(n - 1) if (got := ranks.get((parts[i], parts[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i, a, b = heapq.heappop(heap)
        j = after[i] if parts[i] == a else -1
        if j < 0 or parts[j] != b:
            continue
        parts[i], parts[j], after[i] = merged[rank], -1, after[j]
        if after[j] >= 0:
            before[after[j]] = i
            if (got := ranks.get((parts[i], parts[after[i]]))) is not None:
                heapq.heappush(heap, (got, i, parts[i], parts[after[i]]))
        if before[i] >= 0 and (got := ranks.get((parts[before[i]], parts[i]))) is not None:
            heapq.heappush(heap, (got, before[i], parts[before[i]], parts[i]))
    return [x for x in parts if x >= 0]


class Words(dict):
    """Piece -> its ids as little-endian 32-bit bytes, filled as pieces come."""

    def __init__(self, coder: Coder):
        self.coder, self.old = coder, {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMO:
            self.old = dict(self)
            self.clear()
        out = self.old.get(word)
        if out is None:
            ids = self.coder.word_ids(word)
            out = struct.pack(f"<{len(ids)}I", *ids)
        self[word] = out
        return out


class Coder:
    """A word-level BPE vocabulary: encode() and decode() of whole texts."""

    def __init__(self, spec: dict):
        model, vocab = spec["model"], spec["model"]["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.tokens = {i: t for t, i in vocab.items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        self.ranks = {(vocab[a], vocab[b]): rank for rank, (a, b) in enumerate(pairs)}
        self.merged = [vocab[a + b] for a, b in pairs]
        letters = byte_letters()
        self.inner = [vocab.get(letters[b]) for b in range(256)]
        self.last = [vocab.get(letters[b] + self.end) for b in range(256)]
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"])
        self.blanks = regex.compile(r"\p{White_Space}+")
        self.cut = regex.compile("|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.words = Words(self)

    @classmethod
    @functools.lru_cache(maxsize=4)  # noqa: B019
    def load(cls, path: str) -> Coder:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def word_ids(self, word: str) -> list[int]:
        raw = word.encode()
        ids = [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        ids = [x for x in ids if x is not None]
        return (merge_scan if len(ids) <= LONG else merge_heap)(ids, self.ranks, self.merged)

    def normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final sigma: case goes by code point
        return self.blanks.sub(" ", text).lower()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.cut is None or not any(x in text for x in self.special):
            return self._plain(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [self._plain(text[at : m.start()]), self.special[m[0]].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.pieces.findall(self.normal(text)))) if text else b""

    def decode(self, ids: bytes) -> str:
        """The tokens' strings, joined by blanks: the vocabulary names no decoder."""
        return " ".join(map(self.tokens.__getitem__, memoryview(ids).cast("I").tolist()))


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids binary, decoded string): the ids and what they decode to, for every text.

    One pass without a shuffle; a hot source or a long text only lengthens its own batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.load(vocabulary)
        for b in batches:
            ids = [coder.encode(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary()), pa.array(map(coder.decode, ids), pa.string())], ["doc_id", "ids", "decoded"])

    docs = texts(docs)
    return map_arrow(docs, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary, decoded string")


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), digested in the worker that encodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.load(vocabulary)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            n, first, second = [], [], []
            for t in b.column("text"):
                ids = coder.encode(t.as_py())
                n.append(len(ids) // 4)
                first.append(sha(ids))
                second.append(sha(coder.decode(ids).encode()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    docs = texts(docs)
    return map_arrow(docs, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
