"""Exact substring deduplication with shard suffix arrays.

A byte is removed if a WINDOW-byte string that covers it also starts earlier in the corpus. Equal strings
are brought together without moving every text: each window has an anchor, the leftmost of its GRAM-byte
grams with the smallest hash, so equal windows have equal anchors. Consecutive windows with one anchor are a
span; a text of n bytes has about n/35 spans. Then:

1. spans travel as (anchor hash, span hash, place). Within each input segment a span that repeats is settled
   at once, so a copied span travels once per segment however many copies there are;
2. sorted by anchor, a span that repeats as a whole is settled; spans that only share an anchor are kept. Anchors
   that are frequent in a sample of texts are dealt by span instead: they have spans that differ, which are kept,
   and equal ones still meet. The sample decides where rows go, never the result;
3. the bytes of those spans, fetched once, form shards by anchor. Of a shard goes on what can share a window with another
   span: equal windows hold their anchor at one place, so around it a stretch of WINDOW - STEP bytes at one of four offsets is
   equal too; what shares none is left out, and the rest is trimmed to where it can. The shard's suffix array is built by
   induced sorting, and permuted common prefixes give the runs of suffixes that share WINDOW bytes; in each
   run the earliest place stays. An anchor with more than HOT different spans is keyed by whole windows
   instead and settled as in 1, so no shard grows with one passage;
4. the removed ranges meet their texts once more, and the rest is digested.

Null and empty texts, and those shorter than a window, lose nothing; long texts are worked off CHUNK windows at a
time. Rows without a doc_id are left whole. Rows that repeat a doc_id and text are one document that is returned as
often; texts that share a doc_id are documents of their own, in the order of a hash (places carry MARK bits of it).
Of equal strings the earliest place stays, so there are no ties. An empty table gives an empty table. Extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.frames import kept, map_arrow, texts
from pairloom.llm.suffixes import common_prefixes, suffix_array

WINDOW, GRAM = 100, 32
#: A window begins at most WINDOW - GRAM bytes before its anchor; spans are compared at offsets STEP apart.
STEP = 17
#: Spans settled together in a worker; different spans of one anchor that a shard takes; bytes in a shard.
SEGMENT, HOT, SHARD = 1 << 18, 20_000, 2 << 20
#: About how many texts are looked at for frequent anchors, and in how many of them an anchor is frequent.
SAMPLE, FREQUENT = 4096, 8
NONE = np.zeros(0, np.int64)
#: Windows of a text worked on at once.
CHUNK = 1 << 22
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
MIX, BASE = 0x9FB21C651E98DF25, 0xA0761D6478BD642F


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    at = 1
    while at < n:
        out[at : 2 * at] = out[: min(at, n - at)] * np.uint64(pow(base, at, 1 << 64))
        at *= 2
    return out


POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, at least n of them."""
    size = 1 << max(12, (n - 1).bit_length())
    if size not in POWERS:
        POWERS.clear()
        POWERS[size] = _powers(BASE, size), _powers(pow(BASE, -1, 1 << 64), size)
    return POWERS[size]


def gram_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each GRAM bytes."""
    n = len(raw) - GRAM + 1
    words = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    h = np.zeros(n, np.uint64)
    for j, odd in enumerate(ODD):
        x = words[8 * j : 8 * j + n] * np.uint64(odd)
        x ^= x >> np.uint64(29)
        h += x
        h *= np.uint64(MIX)
    return h ^ (h >> np.uint64(32))


def range_hashes(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges [a, b) from gram hashes: what two equal ranges share, wherever they are."""
    up, down = powers(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=total[1:])
    out = (total[b - GRAM + 1] - total[a]) * down[a] + (b - a).astype(np.uint64) * np.uint64(ODD[1])
    out ^= out >> np.uint64(31)
    return out * np.uint64(MIX)


def spans(raw: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor hash, span hash, start, end) of a text's spans, CHUNK windows at a time."""
    for at in range(0, len(raw) - WINDOW + 1, CHUNK):
        part = raw[at : at + CHUNK + WINDOW - 1]
        h = gram_hashes(part)
        least, width, reach = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64), 1, WINDOW - GRAM + 1
        while 2 * width <= reach:
            least, width = np.minimum(least[:-width], least[width:]), 2 * width
        if width < reach:
            least = np.minimum(least[: len(least) - reach + width], least[reach - width :])
        place = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        start = np.append(0, np.flatnonzero(place[1:] != place[:-1]) + 1)
        end = np.append(start[1:], len(place)) - 1 + WINDOW
        yield h[place[start]].view(np.int64), range_hashes(h, start, end).view(np.int64), start + at, end + at


#: Places hold, above the offset, bits of a hash of the text, so that texts of one doc_id are told apart.
MARK, OFFSET = (1 << 22) - 1, 40
#: What travels between the steps: R is a removed range, C a span that shares its anchor, S a span still open,
#: T a span with its bytes, H an open span of a frequent anchor.
R, C, S, T, H = range(5)
MOVED = "kind int, g long, s long, doc_id long, a long, b long"
NAMES = ["kind", "g", "s", "doc_id", "a", "b"]


def marked(raw: bytes) -> int:
    """What is added to the places of a text."""
    return (xxhash.xxh64_intdigest(raw) & MARK) << OFFSET


def _batch(kind: int, g: np.ndarray, s: np.ndarray, doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(g), kind, np.int32)), *(pa.array(np.ascontiguousarray(x, np.int64)) for x in (g, s, doc, a, b))], NAMES)


def _settle(held: list[tuple[np.ndarray, ...]], frequent: np.ndarray = NONE) -> Iterator[pa.RecordBatch]:
    """One segment: the first of equal spans travels on, the others are removed ranges."""
    g, s, doc, a, b = (np.concatenate(x) for x in zip(*held))
    order = np.lexsort((a, doc, g, s))
    g, s, doc, a, b = (x[order] for x in (g, s, doc, a, b))
    new = np.append(True, (s[1:] != s[:-1]) | (g[1:] != g[:-1]))
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    later = (doc != doc[first]) | (a != a[first])
    wide = new & np.isin(g, frequent)
    for kind, some in ((S, new & ~wide), (H, wide)):
        if some.any():
            yield _batch(kind, g[some], s[some], doc[some], a[some], b[some])
    yield from _ranges(doc[later], a[later], b[later])


def _ranges(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Removed ranges, those that touch joined; g is only there to spread them."""
    if len(doc):
        doc = np.ascontiguousarray(doc)
        order = np.lexsort((b, a, doc))
        doc, a, b = doc[order], a[order], b[order]
        new = np.append(True, (doc[1:] != doc[:-1]) | (a[1:] > b[:-1]))  # ranges of one length class never nest
        start = np.flatnonzero(new)
        yield _batch(R, (doc[start].view(np.uint64) * np.uint64(MIX)).view(np.int64), np.zeros(len(start)), doc[start], a[start], np.maximum.reduceat(b, start))


def _open_spans(batches: Iterator[pa.RecordBatch], frequent: np.ndarray = NONE) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            raw = t.as_py().encode("utf-8", "surrogatepass") if i is not None else b""
            mark = marked(raw)
            for g, s, a, b in spans(raw):
                held.append((g, s, np.full(len(g), i, np.int64), a + mark, b + mark))
                size += len(g)
                if size >= SEGMENT:
                    yield from _settle(held, frequent)
                    held, size = [], 0
    if held:
        yield from _settle(held, frequent)


def _repeats(rows: np.ndarray, last: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of spans sorted by (g, s, doc_id, a), after a first span `last`: those that repeat, the first ones, and the last of these."""
    lead = int(last is not None)
    rows = np.concatenate([[last], rows]) if lead else rows
    new = np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(1))
    rep = np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))
    later = (rows[:, 2:4] != rows[rep, 2:4]).any(1)
    new[:lead] = False  # it went on before
    return rows[later], rows[new], rows[rep[-1]]


def _sorted_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open spans sorted by (g, s, doc_id, a): whole repeats become R, different spans of one anchor, and those of frequent ones, C."""
    first = prev = last_spread = None  # of the anchor that is still open, and the first of its last span
    told = False
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        g, s, doc, a, b = (batch.column(c).to_numpy() for c in NAMES[1:])
        done = kind == R
        if done.any():
            yield _batch(R, g[done], s[done], doc[done], a[done], b[done])
        rows = np.stack([g, s, doc, a, b], 1)
        if (kind == H).any():
            again, some, last_spread = _repeats(rows[kind == H], last_spread)
            yield from _ranges(*again[:, 2:].T)
            if len(some):
                yield _batch(C, *some.T)
        rows = rows[kind == S]
        if not len(rows):
            continue
        lead = 0
        if first is not None:
            rows = np.concatenate([[first, prev], rows])
            lead = 2
        g, s = rows[:, 0], rows[:, 1]
        new_g = np.append(True, g[1:] != g[:-1])
        new_s = new_g | np.append(True, s[1:] != s[:-1])
        at = np.arange(len(g))
        head, rep = np.maximum.accumulate(np.where(new_g, at, 0)), np.maximum.accumulate(np.where(new_s, at, 0))
        later = (at >= lead) & ((rows[:, 2] != rows[rep, 2]) | (rows[:, 3] != rows[rep, 3]))
        yield from _ranges(*rows[later][:, 2:].T)
        shared = new_s & ~new_g
        shared[:lead] = False  # those are of the last batch
        told_heads = np.unique(head[shared])
        if lead and told:
            told_heads = told_heads[told_heads > 0]
        out = np.sort(np.concatenate([np.flatnonzero(shared), told_heads]))
        if len(out):
            yield _batch(C, *rows[out].T)
        last = head[-1]
        told = bool((shared & (head == last)).any()) or (bool(lead) and last == 0 and told)
        first, prev = rows[last], rows[rep[-1]]


def _by_anchor(rows: DataFrame) -> DataFrame:
    dealt = F.when(F.col("kind") == H, F.col("s")).otherwise(F.col("g"))
    return map_arrow(rows.repartition(dealt).sortWithinPartitions("g", "s", "doc_id", "a"), _sorted_spans, MOVED)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the spans asked for; spans of hot anchors as windows instead."""
    for batch in batches:
        for i, packed, asked in zip(batch.column("doc_id").to_pylist(), batch.column("packed"), batch.column("asked")):
            raw, asked = zlib.decompress(packed.as_py()), asked.values
            mark = marked(raw)
            g, a, b, hot = (asked.field(c).to_numpy(zero_copy_only=False) for c in ("g", "a", "b", "hot"))
            own = a >> OFFSET == mark >> OFFSET  # not those of another text of this doc_id
            cold, hot = np.flatnonzero(own & ~hot), own & hot
            if len(cold):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cold), T, np.int32)), pa.array(g[cold]), pa.array(np.zeros(len(cold), np.int64)), pa.array(np.full(len(cold), i)), pa.array(a[cold]), pa.array(b[cold]), pa.array([raw[x:y] for x, y in zip((a[cold] - mark).tolist(), (b[cold] - mark).tolist())], pa.binary())], [*NAMES, "piece"])
            for x, y in zip((a[hot] - mark).tolist(), (b[hot] - mark).tolist()):
                h = gram_hashes(raw[x:y])
                start = np.arange(y - x - WINDOW + 1)
                one, two = range_hashes(h, start, start + WINDOW).view(np.int64), h[start].view(np.int64)
                rest = _batch(S, one, two, np.full(len(start), i), start + x + mark, start + x + mark + WINDOW)
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.nulls(len(start), pa.binary())], [*NAMES, "piece"])


def shard_ranges(doc: np.ndarray, a: np.ndarray, pieces: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Removed ranges of one shard: its suffix array, common prefixes, and the earliest place of each run."""
    end = np.cumsum([len(p) + 1 for p in pieces])
    text = np.frombuffer(b"\xff".join(pieces) + b"\xff", np.uint8)
    sa = suffix_array(text)
    shared = common_prefixes(text, sa, WINDOW)
    row = np.searchsorted(end, sa, "right")
    inside = sa + WINDOW < end[row]
    run = np.cumsum(shared[sa] < WINDOW)
    sa, row, run = sa[inside], row[inside], run[inside]
    place = a[row] + sa - (end[row] - np.array([len(p) + 1 for p in pieces])[row])
    order = np.lexsort((place, doc[row], run))
    run, where, place = run[order], doc[row][order], place[order]
    new = np.append(True, run[1:] != run[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    later = (where != where[first]) | (place != place[first])
    yield from _ranges(where[later], place[later], place[later] + WINDOW)


def shared_parts(g: np.ndarray, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which, from, to): the spans, and the part of each, that hold all windows which spans of one anchor g share.

    A window that begins `back` to `back` + STEP bytes before its anchor holds the WINDOW - STEP bytes from `back` before it on.
    """
    size = np.array([len(p) for p in pieces])
    end = np.cumsum(size)
    start, h = end - size, gram_hashes(b"".join(pieces))
    hit = np.flatnonzero(h == np.repeat(g.view(np.uint64), size)[: len(h)])
    own = np.searchsorted(end, hit, "right")
    inside = hit + GRAM <= end[own]
    place = hit[inside][np.unique(own[inside], return_index=True)[1]]  # the anchor is the leftmost in its span
    low, high = np.zeros((2, len(pieces)), np.int64)
    for back in range(0, WINDOW - GRAM, STEP):
        x = place - back
        fit = np.flatnonzero((x >= start) & (x + WINDOW - STEP <= end))
        key = g[fit].view(np.uint64)
        for at, odd in zip((0, GRAM, WINDOW - STEP - GRAM), ODD):
            key = (key ^ h[x[fit] + at]) * np.uint64(odd)
            key ^= key >> np.uint64(31)
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        some = fit[order[np.append(same, False) | np.append(False, same)]] if len(fit) else fit
        low[some] = np.maximum(start[some], x[some] - STEP)
        high[some] = np.maximum(high[some], np.minimum(end[some], x[some] + WINDOW))
    which = np.flatnonzero(high - low >= WINDOW)
    return which, (low - start)[which], (high - start)[which]


def _shard(held: list[tuple]) -> Iterator[pa.RecordBatch]:
    """The removed ranges of whole anchors (g, doc_id, a, piece)."""
    g, doc, a, pieces = zip(*held)
    which, low, high = shared_parts(np.array(g, np.int64), list(pieces))
    if len(which):
        some = [pieces[i][x:y] for i, x, y in zip(which.tolist(), low.tolist(), high.tolist())]
        yield from shard_ranges(np.array(doc)[which], np.array(a)[which] + low, some)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by anchor, cut into shards between anchors."""
    held, size, last = [], 0, None
    for batch in batches:
        for r in zip(*(batch.column(c).to_pylist() for c in ("g", "doc_id", "a", "piece"))):
            if size >= SHARD and r[0] != last:
                yield from _shard(held)
                held, size = [], 0
            held.append(r)
            size, last = size + len(r[3]), r[0]
    if held:
        yield from _shard(held)


def _packed(docs: DataFrame) -> DataFrame:
    """(doc_id, packed): texts that may travel, compressed before they do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([zlib.compress(t.as_py().encode("utf-8", "surrogatepass"), 1) for t in b.column("text")], pa.binary())], ["doc_id", "packed"])

    return map_arrow(docs, run, "doc_id long, packed binary")


def frequent_anchors(docs: DataFrame) -> np.ndarray:
    """Anchors that FREQUENT texts of a sample have, each counted once for equal spans."""
    step = max(1, docs.count() // SAMPLE)
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column("text"):
                for g, s, _, _ in spans(t.as_py().encode("utf-8", "surrogatepass")):
                    yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(s)], ["g", "s"])

    counted = map_arrow(some, run, "g long, s long").distinct().groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT)
    return np.sort(np.array([r.g for r in counted.select("g").collect()], np.int64))


def removed_ranges(docs: DataFrame) -> DataFrame:
    """(doc_id, a, b): byte ranges to remove; they may overlap and repeat."""
    docs = texts(docs)
    spread = docs.sparkSession.sparkContext.broadcast(frequent_anchors(docs))  # at most SAMPLE / FREQUENT times the anchors of a text
    met = kept(_by_anchor(map_arrow(docs, lambda batches: _open_spans(batches, spread.value), MOVED)), "spans")
    asked = met.where(F.col("kind") == C).select("g", "doc_id", "a", "b")
    hot = kept(asked.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("g", F.lit(True).alias("hot")), "hot")
    asked = asked.join(hot, "g", "left").select("doc_id", F.struct("g", "a", "b", F.coalesce("hot", F.lit(False)).alias("hot")).alias("x"))
    asked = asked.groupBy("doc_id").agg(F.collect_list("x").alias("asked"))  # at most a text's own spans
    pieces = kept(map_arrow(_packed(docs).join(asked, "doc_id").select("doc_id", "packed", "asked"), _pieces, MOVED + ", piece binary"), "pieces")
    sharded = map_arrow(pieces.where(F.col("kind") == T).select("g", "doc_id", "a", "piece").repartition("g").sortWithinPartitions("g"), _shards, MOVED)
    whole = _by_anchor(pieces.where(F.col("kind") == S).select(*NAMES))
    found = met.where(F.col("kind") == R).unionByName(sharded).unionByName(whole.where(F.col("kind") == R))
    return found.select("doc_id", "a", "b")


def cut(raw: bytes, ranges: list[tuple[int, int]]) -> tuple[bytes, int]:
    """What is left of raw, and the number of maximal removed runs."""
    kept_parts, at, runs, end = [], 0, 0, -1
    for a, b in sorted(ranges):
        if a > end:
            runs += 1
            kept_parts.append(raw[at:a])
        at = end = max(end, b)
    return b"".join([*kept_parts, raw[at:]]), runs


def deduplicated(docs: DataFrame) -> DataFrame:
    """(doc_id, rest binary, n_bytes, n_spans): every text without its removed bytes."""
    ranges = removed_ranges(docs).groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
    joined = _packed(texts(docs)).join(ranges, "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, rests, runs = [], [], []
            for p, r in zip(b.column("packed"), b.column("ranges").to_pylist()):
                raw = zlib.decompress(p.as_py())
                mark = marked(raw)
                rest, n = cut(raw, [(x["a"] - mark, x["b"] - mark) for x in r or () if x["a"] >> OFFSET == mark >> OFFSET])
                sizes.append(len(raw))
                rests.append(rest)
                runs.append(n)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(runs, pa.int64())], ["doc_id", "rest", "n_bytes", "n_spans"])

    return map_arrow(joined, run, "doc_id long, rest binary, n_bytes long, n_spans long")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    got = deduplicated(docs)
    return got.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("rest")).alias("n_removed"), "n_spans", F.sha2("rest", 256).alias("kept_sha256"))
