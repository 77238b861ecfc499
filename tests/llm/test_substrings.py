from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from helpers import empty, odd, odd_rows, prose

from pairloom.llm import substrings, suffixes


@pytest.mark.parametrize("buckets", [0, 3, 1024])
def test_suffix_array(monkeypatch, buckets):
    monkeypatch.setattr(suffixes, "BUCKETS", buckets)
    r = random.Random(buckets)
    for _ in range(250):
        k, n = r.choice([1, 2, 3, 26, 255]), r.randint(0, 150)
        t = np.array([r.randrange(k) for _ in range(n)], np.uint8)
        t = np.tile(t[: r.randint(0, 9)], 20) if r.random() < 0.3 else t
        raw, sa = t.tobytes(), suffixes.suffix_array(t)
        assert sa.tolist() == sorted(range(len(t)), key=lambda i: raw[i:])
        shared = suffixes.common_prefixes(t, sa, 20)
        for a, b in zip(sa, sa[1:]):
            n = next((i for i in range(20) if raw[a + i : a + i + 1] != raw[b + i : b + i + 1] or b + i >= len(t) or a + i >= len(t)), 20)
            assert shared[b] == n


def test_large_texts_recurse(monkeypatch):
    """A megabyte: names are sorted by the same routine, level by level, and the order is right."""
    depth, plain = [], suffixes._sorted
    monkeypatch.setattr(suffixes, "_sorted", lambda t, size: depth.append((len(t), size)) or plain(t, size))
    raw = (prose(1, 100_000) + prose(2, 50_000) + prose(1, 60_000)).encode()[:1_000_000]
    sa = suffixes.suffix_array(np.frombuffer(raw, np.uint8))
    assert len(depth) > 2 and max(size for _, size in depth) > suffixes.BUCKETS and all(b[0] <= a[0] / 2 + 1 for a, b in zip(depth, depth[1:]))
    assert (np.sort(sa) == np.arange(len(raw))).all()
    for k in random.Random(1).sample(range(len(sa) - 1), 20_000):
        assert raw[sa[k] : sa[k] + 300_000] < raw[sa[k + 1] : sa[k + 1] + 300_000]


def brute(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        raw = t.encode()
        mark = bytearray(len(raw))
        for a in range(len(raw) - 99):
            w = raw[a : a + 100]
            if w in seen:
                mark[a : a + 100] = b"\1" * 100
            seen.add(w)
        rest = bytes(b for b, m in zip(raw, mark) if not m)
        out[i] = (len(raw), len(raw) - len(rest), sum(1 for k in range(len(mark)) if mark[k] and not (k and mark[k - 1])), hashlib.sha256(rest).hexdigest())
    return out


def corpus():
    passage, twist = prose(90, 60), prose(91, 40)
    rows = [(i, prose(i, 60) + (passage[i % 7 :] if i % 3 == 0 else "") + prose(i + 100, 30) + (twist if i % 4 == 0 else "")) for i in range(40)]
    rows += [(50, rows[3][1]), (51, rows[3][1].replace("th", "TH", 2)), (52, "ab " * 300), (53, "ab " * 200), (54, "x" * 99), (55, "x" * 101), (56, "é" * 200)]
    return rows


@pytest.mark.parametrize("hot, frequent", [(20_000, 8), (1, 8), (20_000, 1), (2, 2)])
def test_against_brute_force(spark, monkeypatch, hot, frequent):
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "FREQUENT", frequent)
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    want = brute(corpus())
    assert sum(x[1] for x in want.values()) > 5000
    assert {r.doc_id: tuple(r)[1:] for r in substrings.digests(df).collect()} == want


def test_odd_rows(spark):
    want = brute([(i, t or "") for i, t, *_ in dict.fromkeys(r for r in odd_rows() if r[0] is not None)])
    got = substrings.digests(odd(spark)).collect()
    assert len(got) == len(odd_rows())
    assert all(tuple(r)[1:] == want[r.doc_id] for r in got if r.doc_id is not None)
    assert all(r.n_removed == 0 for r in got if r.doc_id is None)
    assert substrings.digests(empty(spark)).count() == 0


@pytest.mark.parametrize("least", [1, 3, 1000])
def test_small_segments_and_shards(monkeypatch, least):
    """The steps that run in workers, in one process and in small pieces; anchors of `least` spans count as frequent."""
    import pyarrow as pa

    monkeypatch.setattr(substrings, "SEGMENT", 37)
    monkeypatch.setattr(substrings, "SHARD", 500)
    monkeypatch.setattr(substrings, "CHUNK", 211)
    rows = corpus()
    many = Counter(g for _, t in rows for gs, *_ in substrings.spans(t.encode()) for g in gs.tolist())
    frequent = np.array([g for g, n in many.items() if n >= least], np.int64)
    open_rows = [r for b in substrings._open_spans(iter([pa.RecordBatch.from_pydict({"doc_id": [i], "text": [t]}) for i, t in rows]), frequent) for r in b.to_pylist()]
    open_rows.sort(key=lambda r: (r["g"], r["s"], r["doc_id"], r["a"]))
    schema = pa.schema([("kind", pa.int32()), *((c, pa.int64()) for c in substrings.NAMES[1:])])
    batches = [pa.RecordBatch.from_pylist(open_rows[i : i + 23], schema) for i in range(0, len(open_rows), 23)]
    met = [r for b in substrings._sorted_spans(iter(batches)) for r in b.to_pylist()]
    texts = {i: t.encode() for i, t in rows}
    asked = sorted((r for r in met if r["kind"] == substrings.C), key=lambda r: r["g"])
    at = lambda r, c: r[c] - substrings.marked(texts[r["doc_id"]])
    pieces = [pa.RecordBatch.from_pylist([{"g": r["g"], "doc_id": r["doc_id"], "a": r["a"], "piece": texts[r["doc_id"]][at(r, "a") : at(r, "b")]}]) for r in asked]
    found = [r for r in met if r["kind"] == substrings.R] + [r for b in substrings._shards(iter(pieces)) for r in b.to_pylist()]
    for i, want in brute(rows).items():
        rest, runs = substrings.cut(texts[i], [(at(r, "a"), at(r, "b")) for r in found if r["doc_id"] == i])
        assert (len(texts[i]) - len(rest), runs, hashlib.sha256(rest).hexdigest()) == want[1:]


@pytest.mark.parametrize("hot", [20_000, 1])
def test_texts_that_share_a_doc_id(spark, monkeypatch, hot):
    """They are documents of their own: each loses what another holds earlier, and neither gets the other's ranges."""
    monkeypatch.setattr(substrings, "HOT", hot)
    one, two, both = prose(1, 50), prose(2, 70), prose(3, 60)
    rows = [(7, one + both), (7, two + both), (7, two + both), (8, both + " end"), (9, one)]
    first, second = sorted([one + both, two + both], key=lambda t: substrings.marked(t.encode()))
    want = brute([(0, first), (1, second), (8, both + " end"), (9, one)])
    got = sorted(tuple(r)[1:] for r in substrings.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([want[0], want[1], want[0 if first == two + both else 1], want[8], want[9]])


def test_a_long_text(spark):
    said = prose(4, 150_000)
    rows = [(1, said), (2, "x " + said[300_000:] + prose(5, 50)), (3, prose(6, 150_000))]
    got = {r.doc_id: r.n_removed for r in substrings.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == got[3] == 0 and abs(got[2] - len(said[300_000:])) < 30


def test_shards_take_only_what_can_be_shared(monkeypatch):
    """All windows that spans of one anchor share are in the parts that go on; spans that share the anchor alone are not."""
    r = random.Random(8)
    by_anchor: dict[int, set[bytes]] = {}
    said = [prose(i, 60) for i in range(40)]
    texts = [prose(900 + i, 12) + said[r.randrange(40)][r.randrange(90) :] + prose(600 + i, 12) for i in range(300)]
    gram = prose(77, 40)[:34]  # many texts that share little more than a gram
    texts += [prose(2000 + i, 25) + gram + prose(3000 + i, 25) for i in range(200)]
    for raw in (t.encode() for t in texts):
        for gs, _, a, b in substrings.spans(raw):
            for g, x, y in zip(gs.tolist(), a.tolist(), b.tolist()):
                by_anchor.setdefault(g, set()).add(raw[x:y])
    rows = [(g, i, 0, p) for g, found in sorted(by_anchor.items()) if len(found) > 1 for i, p in enumerate(sorted(found))]
    which, low, high = substrings.shared_parts(np.array([x[0] for x in rows]), [x[3] for x in rows])
    part = {i: (x, y) for i, x, y in zip(which.tolist(), low.tolist(), high.tolist())}
    held: dict[tuple, list] = {}
    for i, (g, _, _, p) in enumerate(rows):
        for at in range(len(p) - 99):
            held.setdefault((g, p[at : at + 100]), []).append((i, at))
    shared = [x for found in held.values() if len(found) > 1 for x in found]
    assert len(shared) > 1000
    assert all(i in part and part[i][0] <= at and at + 100 <= part[i][1] for i, at in shared)
    alone = set(range(len(rows))) - {i for i, _ in shared}
    assert len(alone) > 100 and sum(i in part for i in alone) < len(alone) / 3
    sorted_bytes, plain = [], substrings.suffix_array
    monkeypatch.setattr(substrings, "suffix_array", lambda t: sorted_bytes.append(len(t)) or plain(t))
    list(substrings._shard(rows))
    assert sum(sorted_bytes) < 0.9 * sum(len(x[3]) for x in rows)
