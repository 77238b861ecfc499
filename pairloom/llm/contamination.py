"""Benchmark decontamination by the q-gram lemma.

A passage of m bytes that occurs with at most k edits shares at least m - q + 1 - kq of its q-grams with the
text, all on k + 1 neighbouring diagonals. Shared q-grams are counted per item in overlapping bands of
diagonals, as wide as the item's own budget asks; bands that meet the item's bound are verified by banded
alignment, which gives every place where the item can end within its budget. Both sides are compared in lower
case (character by character, where that keeps the number of bytes) with runs of blanks and ASCII punctuation
as one blank.

Of places whose regions overlap, the one of fewest edits stands, of ties the first; regions of one item never
overlap, regions of several may. k is BUDGET of an item's length, less where the bound would otherwise not be
positive. Items shorter than q are searched exactly, as whole words; empty and null ones are in no text. Equal
items each report. The benchmark is a query set: its blocks of at most ITEMS_BYTES are all held against a batch
of texts in one pass over the documents.

Null and empty texts report nothing. Rows that repeat report alike. Long texts are cut into pieces that overlap
by more than an item, and regions are settled over the whole text. An empty table gives an empty table. Extra
columns are ignored, or carried along by clean().
"""

from __future__ import annotations

import re
import sys
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.frames import map_arrow, texts

Q, BUDGET, ITEMS_BYTES = 8, 0.1, 4 << 20
#: Bytes of texts worked on together, and pairs of q-grams counted together.
BUFFER, PAIRS = 1 << 20, 1 << 22
#: Places, and lanes, looked at together.
STEP = 1 << 17
#: Alignments done in step, and the narrowest band.
LANES, NARROW = 1024, 32
TABLE_LOG2 = 20
MIX = np.uint64(0x9E3779B97F4A7C15)
FOLD = np.array([32 if b < 128 and not chr(b).isalnum() else b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


class Lower(dict):
    """What str.translate asks: a character's lower case if it has as many bytes, else the character."""

    def __missing__(self, code: int) -> int | str:
        c = chr(code)
        low = c.lower()
        size = lambda v: len(v.encode("utf-8", "surrogatepass"))
        self[code] = out = low if size(low) == size(c) else code
        return out


LOWER = Lower()


@lru_cache(maxsize=1)
def unlike() -> re.Pattern:
    """Characters whose lower case by text.lower() is another than by LOWER: other sizes, and the final sigma."""
    odd = [c for c in map(chr, range(128, sys.maxunicode + 1)) if c.lower() != c and LOWER[ord(c)] == ord(c)]
    return re.compile("[" + "".join(map(re.escape, [*odd, "\u03a3"])) + "]")


def lowered(text: str) -> str:
    """text in lower case, byte for byte in its place."""
    if text.isascii():
        return text  # FOLD does it
    return text.translate(LOWER) if unlike().search(text) else text.lower()


def folded(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes to compare, and where each stood in the text's UTF-8 bytes."""
    x = FOLD[np.frombuffer(lowered(text).encode("utf-8", "surrogatepass"), np.uint8)]
    blank = x == 32
    stay = ~blank
    stay[1:] |= blank[1:] & ~blank[:-1]
    at = np.flatnonzero(stay)
    return x[at], at


def grams(x: np.ndarray) -> np.ndarray:
    """The Q-gram at each place, as one integer."""
    if len(x) < Q:
        return np.zeros(0, np.uint64)
    return np.ndarray((len(x) - Q + 1,), "<u8", x.tobytes(), strides=(1,))


@dataclass
class Items:
    """A block of the benchmark: items, their budgets and bounds, and an index of their q-grams."""

    ids: list[int]
    texts: list[np.ndarray]

    def __post_init__(self) -> None:
        self.size = np.array([len(t) for t in self.texts], np.int64)
        self.edits = np.maximum(np.minimum((self.size * BUDGET).astype(np.int64), (self.size - Q) // Q), 0)
        self.bound = self.size - Q + 1 - Q * self.edits
        self.width = np.array([max(NARROW, 1 << int(k).bit_length()) for k in self.edits], np.int64)
        self.short = [i for i, n in enumerate(self.size) if n < Q]
        gram = np.concatenate([grams(t) for t in self.texts]) if self.texts else np.zeros(0, np.uint64)
        count = np.maximum(self.size - Q + 1, 0)
        item = np.repeat(np.arange(len(self.texts)), count)
        place = np.arange(len(gram)) - np.repeat(np.cumsum(count) - count, count)
        order = np.argsort(gram, kind="stable")
        self.gram, self.first, self.many = np.unique(gram[order], return_index=True, return_counts=True)
        self.item, self.place = item[order], place[order]
        self.seen = np.zeros(1 << TABLE_LOG2, bool)
        self.seen[self._slot(self.gram)] = True

    @staticmethod
    def _slot(gram: np.ndarray) -> np.ndarray:
        return (gram * MIX >> np.uint64(64 - TABLE_LOG2)).astype(np.int64)

    def bands(self, x: np.ndarray) -> np.ndarray:
        """(item, first diagonal) of the bands, two widths each, that meet their item's bound."""
        gram = grams(x)
        at = np.concatenate([np.zeros(0, np.int64), *(i + np.flatnonzero(self.seen[self._slot(gram[i : i + STEP])]) for i in range(0, len(gram), STEP))])
        which = np.searchsorted(self.gram, gram[at])
        fine = which < len(self.gram)
        fine[fine] = self.gram[which[fine]] == gram[at[fine]]
        at, which = at[fine], which[fine]
        # the first and the last lanes of an item stay empty, so that no band reaches into the next item
        lanes = (len(x) + self.size) // self.width + 3
        base = np.cumsum(lanes) - lanes
        many, dense = self.many[which], int(lanes.sum()) <= 1 << 23
        total = np.zeros(int(lanes.sum()) if dense else 0, np.int32)
        keys, ends, i = [], np.cumsum(many), 0
        while i < len(at):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS, "right")))
            n = many[i:j]
            offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            source = np.repeat(self.first[which[i:j]], n) + offset
            item = self.item[source]
            key = base[item] + (np.repeat(at[i:j], n) - self.place[source] + self.size[item]) // self.width[item] + 1
            if dense:
                np.add.at(total, key, np.int32(1))
            else:
                keys.append(np.unique(key, return_counts=True))
            i = j
        if dense:
            least, met = np.maximum(self.bound, 1), [np.zeros(0, np.int64)]
            for i in range(0, len(total) - 1, STEP):
                two = total[i : i + STEP]
                two = two[: len(total) - 1 - i] + total[i + 1 : i + 1 + len(two)]
                some = np.flatnonzero(two >= least.min())
                met.append(i + some[two[some] >= least[np.searchsorted(base, i + some, "right") - 1]])
            met = np.concatenate(met)
        elif keys:
            key, where = np.unique(np.concatenate([k for k, _ in keys]), return_inverse=True)
            n = np.bincount(where, np.concatenate([c for _, c in keys])).astype(np.int64)
            both = np.unique(np.concatenate([key, key - 1]))
            look = lambda k: np.where(key[np.minimum(np.searchsorted(key, k), len(key) - 1)] == k, n[np.minimum(np.searchsorted(key, k), len(key) - 1)], 0)
            met = both[look(both) + look(both + 1) >= self.bound[np.searchsorted(base, both, "right") - 1]]
        else:
            met = np.zeros(0, np.int64)
        item = np.searchsorted(base, met, "right") - 1
        return np.stack([item, (met - base[item] - 1) * self.width[item] - self.size[item]], 1)

    def ends(self, x: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, stop, edits) of every place where an item of Q bytes or more ends within its budget."""
        found = self.bands(x)
        for width in np.unique(self.width[found[:, 0]]):
            some = found[self.width[found[:, 0]] == width]
            most = int(self.edits[some[:, 0]].max())
            yield from align(self, x, [(i, low - most) for i, low in some.tolist()], 2 * int(width) + 2 * most)

    def words(self, x: np.ndarray) -> Iterator[tuple[int, int]]:
        """(item, stop) of the items shorter than Q, as whole words of a whole text."""
        raw = b" " + x.tobytes() + b" "
        for i in self.short:
            word = b" " + self.texts[i].tobytes() + b" "
            at = raw.find(word)
            while at >= 0:
                yield i, at + len(word) - 2
                at = raw.find(word, at + len(word) - 1)

    def settled(self, x: np.ndarray, i: int, ends: dict[int, int]) -> list[tuple[int, int, int]]:
        """(start, stop, edits) of the regions of item i in x, given the edits of its ends."""
        taken: list[tuple[int, int]] = []
        out, size = [], int(self.size[i])
        for d, stop in sorted((d, stop) for stop, d in ends.items()):
            if any(a < stop and stop - size + d < b for a, b in taken):  # overlaps wherever it starts
                continue
            back = x[max(0, stop - size - d) : stop][::-1]
            start = stop - (prefix(self.texts[i][::-1], back) if d else size)
            if all(stop <= a or start >= b for a, b in taken):
                taken.append((start, stop))
                out.append((start, stop, d))
        return out


def prefix(pattern: np.ndarray, x: np.ndarray) -> int:
    """The length of the prefix of x that the whole pattern aligns to with the fewest edits."""
    steps = np.arange(len(x) + 1)
    row = steps
    for i, c in enumerate(pattern.tolist()):
        new = np.append(i + 1, np.minimum(row[:-1] + (x != c), row[1:] + 1))
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.argmin())


def align(items: Items, x: np.ndarray, asked: list[tuple[int, int]], band: int) -> Iterator[tuple[int, int, int]]:
    """(item, stop, edits) of all ends of the asked (item, first diagonal) within budget on `band` diagonals.

    All are aligned in step, a row of the pattern at a time; those beyond their budget drop out.
    """
    for at in range(0, len(asked), LANES):
        item = np.array([i for i, _ in asked[at : at + LANES]])
        low = np.array([d for _, d in asked[at : at + LANES]])
        size, edits, pad = items.size[item], items.edits[item], band + int(items.size.max()) + 1
        text = np.concatenate([np.full(pad, 255, np.uint8), x, np.full(pad, 255, np.uint8)])
        steps, row, base = np.arange(band), np.zeros((len(item), band), np.int32), low + pad
        base = np.clip(base, 0, len(text) - pad)
        pattern = np.zeros((len(item), int(size.max())), np.uint8)
        for n, i in enumerate(item.tolist()):
            pattern[n, : size[n]] = items.texts[i]
        steps = steps.astype(np.int32)
        for i in range(pattern.shape[1]):
            new = row + (text[base[:, None] + (i + steps)] != pattern[:, i : i + 1])
            np.minimum(new[:, :-1], row[:, 1:] + 1, out=new[:, :-1])
            row = np.minimum.accumulate(new - steps, axis=1) + steps
            best = row.min(1)
            live = best <= edits
            for n in np.flatnonzero(live & (size == i + 1)).tolist():
                for at_end in np.flatnonzero(row[n] <= edits[n]).tolist():
                    if 0 < (stop := int(base[n]) - pad + at_end + i + 1) <= len(x):
                        yield int(item[n]), stop, int(row[n, at_end])
            live &= size > i + 1
            if not live.all():
                item, size, edits, base, row, pattern = (v[live] for v in (item, size, edits, base, row, pattern))
                if not len(item):
                    break


def blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The benchmark in blocks of at most ITEMS_BYTES (or one item)."""
    ids, found, size = [], [], 0
    for r in benchmark.select("item_id", "text").where(F.col("text").isNotNull()).toLocalIterator():
        x = folded(r.text)[0]
        x = x[int(len(x) > 0 and x[0] == 32) : len(x) - int(len(x) > 1 and x[-1] == 32)]
        if not len(x) or not x.tobytes().strip():
            continue
        if found and size + len(x) > ITEMS_BYTES:
            yield Items(ids, found)
            ids, found, size = [], [], 0
        ids.append(r.item_id)
        found.append(x)
        size += len(x)
    if found:
        yield Items(ids, found)


def searcher(items: Items):
    """A function from texts to their (item_id, start, stop, edits), in UTF-8 byte offsets."""
    gap = np.full(int(items.edits.max()) + 1, 255, np.uint8)  # no region within budget spans it
    lap = int((items.size + items.edits).max())

    def flush(held: list, out: dict) -> None:
        flat = np.concatenate([p for _, x, _ in held for p in (x, gap)])
        begins = np.cumsum([0, *(len(x) + len(gap) for _, x, _ in held)])
        for i, stop, d in items.ends(flat):
            n = int(np.searchsorted(begins, stop - 1, "right")) - 1
            row, x, at = held[n]
            if 0 < (stop := stop - int(begins[n])) <= len(x):
                known = out[row][i]
                known[at + stop] = min(d, known.get(at + stop, d))
        held.clear()

    def search(said: list[str]) -> list[list[tuple[int, int, int, int]]]:
        found: dict = defaultdict(lambda: defaultdict(dict))
        held, size = [], 0
        for row, t in enumerate(said):
            x = folded(t)[0]
            for i, stop in items.words(x) if items.short else ():
                found[row][i][stop] = 0
            for p in range(0, max(len(x), 1), BUFFER):
                held.append((row, x[p : p + BUFFER + lap], p))
                size += len(held[-1][1]) + len(gap)
                if size >= BUFFER:
                    flush(held, found)
                    size = 0
        if held:
            flush(held, found)
        out: list[list] = [[] for _ in said]
        for row, of in found.items():
            x, at = folded(said[row])
            out[row] = [(items.ids[i], int(at[a]), int(at[b - 1]) + 1, d) for i, ends in sorted(of.items()) for a, b, d in sorted(items.settled(x, i, ends))]
        return out

    return search


def search_all(shared: list, said: list[str]) -> list[list[tuple[int, int, int, int]]]:
    """The regions of all broadcast blocks of items in some texts; of several blocks, one is held at a time."""
    out: list[list] = [[] for _ in said]
    for block in shared:
        for held, got in zip(out, searcher(block.value)(said)):
            held += got
        if len(shared) > 1:
            vars(block).pop("_value", None)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, stop, edits): every region of a text that holds an item within its budget."""
    docs = texts(docs)
    shared = [docs.sparkSession.sparkContext.broadcast(x) for x in blocks(benchmark)]  # a few times ITEMS_BYTES each
    if not shared:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, start long, stop long, edits long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, *r) for i, got in zip(b.column("doc_id").to_pylist(), search_all(shared, b.column("text").to_pylist())) for r in got]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], ["doc_id", "item_id", "start", "stop", "edits"])

    return map_arrow(docs, run, "doc_id long, item_id long, start long, stop long, edits long")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without any item of the benchmark; texts never leave their task."""
    shared = [docs.sparkSession.sparkContext.broadcast(x) for x in blocks(benchmark)]
    if not shared:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([not x for x in search_all(shared, [t or "" for t in b.column("text").to_pylist()])], pa.bool_()))

    return map_arrow(docs, run, docs.schema)
