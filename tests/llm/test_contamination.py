from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pytest
from helpers import empty, odd, odd_rows, prose

from pairloom.llm import contamination as c


def least_edits(p, x):
    steps = np.arange(len(x) + 1)
    row = np.zeros(len(x) + 1, int)
    for i, b in enumerate(p.tolist()):
        new = np.append(i + 1, np.minimum(row[:-1] + (x != b), row[1:] + 1))
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min())


def worn(text, k, r):
    t = list(text)
    for _ in range(k):
        p = r.randrange(len(t))
        t[p : p + 1] = r.choice([[], [r.choice("abcdef")], [t[p], r.choice("abcdef")]])
    return "".join(t)


@pytest.mark.parametrize("pairs", [1 << 22, 50])
def test_exact_to_the_budget(monkeypatch, pairs):
    monkeypatch.setattr(c, "PAIRS", pairs)
    r = random.Random(3)
    items = c.Items(list(range(25)), [c.folded(prose(200 + i, r.randint(3, 60)))[0] for i in range(25)])
    search = c.searcher(items)
    texts = [prose(i, 90) + ". " + worn(prose(200 + i % 25, 1) and bytes(items.texts[i % 25]).decode(), int(items.edits[i % 25]) + r.choice([-1, 0, 0, 1, 3]), r).upper() + "\n" + prose(i + 700, 30) for i in range(100)]
    for t, got in zip(texts, search(texts)):
        x = c.folded(t)[0]
        for i in range(25):
            d, mine = least_edits(items.texts[i], x), [g for g in got if g[0] == i]
            assert bool(mine) == (d <= items.edits[i])
            if mine:
                assert min(g[3] for g in mine) == d


def test_places(spark):
    bench = spark.createDataFrame([(7, prose(1, 30)), (8, "tiny"), (9, None), (10, prose(1, 30))], "item_id long, text string")
    said = "ÄÖ " + prose(2, 9) + "  " + prose(1, 30).upper() + "!! " + prose(3, 9)
    docs = spark.createDataFrame([(1, said), (2, prose(2, 50)), (3, None)], "doc_id long, text string")
    got = c.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id, r.edits) for r in got} == {(1, 7, 0), (1, 10, 0)}
    assert all(said.encode()[r.start : r.stop].decode().strip() == prose(1, 30).upper() for r in got)
    assert [r.doc_id for r in c.clean(docs, bench).orderBy("doc_id").collect()] == [2, 3]


def every_region(items, x):
    """All regions by a whole table of edits: for each end the fewest edits, then the same choice among overlaps."""
    out = []
    for i, p in enumerate(items.texts):
        k, p = int(items.edits[i]), p.tolist()
        if len(p) < c.Q:
            raw, word = b" " + x.tobytes() + b" ", b" " + bytes(p) + b" "
            out += [(i, a, a + len(p), 0) for a in range(len(raw)) if raw[a : a + len(word)] == word]
            continue
        row = [(j, 0) for j in range(len(p) + 1)]  # edits and length of the region for each prefix of the pattern
        found = []
        for e, byte in enumerate(x.tolist(), 1):
            new = [(0, 0)]
            for j in range(1, len(p) + 1):
                diagonal, down, right = row[j - 1], new[j - 1], row[j]
                new.append(min((diagonal[0] + (p[j - 1] != byte), diagonal[1] + 1), (down[0] + 1, down[1]), (right[0] + 1, right[1] + 1)))
            row = new
            if row[-1][0] <= k:
                found.append((row[-1][0], e, e - row[-1][1]))
        taken = []
        for d, e, a in sorted(found):
            if all(e <= s or a >= t for s, t in taken):
                taken.append((a, e))
                out.append((i, a, e, d))
    return sorted(out)


@pytest.mark.parametrize("buffer, dense", [(1 << 20, True), (90, True), (1 << 20, False)])
def test_every_region_of_mixed_sizes(monkeypatch, buffer, dense):
    """A long item beside short ones; repeated and worn occurrences, alone and side by side in tiny texts."""
    monkeypatch.setattr(c, "BUFFER", buffer)
    r = random.Random(8)
    said = [prose(400, 160), prose(401, 3), prose(402, 4), prose(403, 12), "ab", "the cat", "tiny", prose(404, 30), "exactly8", "sixteen letters."]
    items = c.Items(list(range(len(said))), [c.folded(t)[0] for t in said])
    if not dense:
        monkeypatch.setattr(c, "NARROW", 1)
    texts = []
    for n in range(40):
        parts = []
        for _ in range(r.randint(1, 5)):
            t = r.choice(said[1:])
            parts += [worn(t, r.choice([0, 0, 1, 2, 3]), r) if len(t) > 8 else t, prose(r.randint(1, 10**6), r.randint(0, 3))]
        texts.append(" ".join(parts))
    texts += [worn(said[1], 1, r), said[1], worn(said[2], 1, r), said[2], said[3] + " " + said[3] + " " + said[3], "İ " + said[1].upper(), "ÄÖÜẞ İ " + worn(said[0], 9, r), "", "ab", "ab ab,ab"]
    search = c.searcher(items)
    for t, got in zip(texts, search(texts)):
        x, at = c.folded(t)
        want = [(i, int(at[a]), int(at[b - 1]) + 1, d) for i, a, b, d in every_region(items, x)]
        assert sorted(got) == sorted(want)


def test_lower_case_by_character():
    for t in ("İSTANBUL ÄÖ", "K ẞ Å Σ ΟΔΟΣ ÉÈ", "ÄÖÜ", "plain A"):
        raw = t.encode()
        x, at = c.folded(t)
        assert len(at) == len(x) and at[-1] < len(raw)
    assert c.folded("İ ÄPFEL")[0].tobytes().endswith("äpfel".encode())
    assert c.folded("ΟΔΟΣ")[0].tobytes() == c.folded("οδοσ")[0].tobytes()


def test_a_long_text(spark):
    bench = spark.createDataFrame([(1, prose(300, 30)), (2, "zz top")], "item_id long, text string")
    long = prose(1, 200_000) + " " + prose(300, 30) + " " + prose(2, 200_000) + " ZZ top."
    got = c.contaminated(spark.createDataFrame([(5, long)], "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as start"), bench.selectExpr("*", "'x' as doc_id", "1 as stop")).collect()
    assert sorted((r.item_id, r.edits) for r in got) == [(1, 0), (2, 0)]


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(c, "ITEMS_BYTES", 200)
    bench = spark.createDataFrame([(i, prose(300 + i, 30)) for i in range(5)], "item_id long, text string")
    docs = spark.createDataFrame([(i, prose(i, 20) + " " + prose(300 + i, 30)) for i in range(5)] + [(9, prose(9, 90))], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in c.contaminated(docs, bench).collect()} == {(i, i) for i in range(5)}
    assert [r.doc_id for r in c.clean(docs, bench).collect()] == [9]


def test_memory_of_a_search():
    """What a search of a buffer of texts against 200 items takes, besides its input, fits beside another worker's."""
    search = c.searcher(c.Items(list(range(200)), [c.folded(prose(300 + i, 60))[0] for i in range(200)]))
    said = [prose(i, 2_000) for i in range(120)]
    tracemalloc.start()
    try:
        search(said)
        assert tracemalloc.get_traced_memory()[1] < 80 << 20
    finally:
        tracemalloc.stop()


def test_odd_rows(spark):
    bench = spark.createDataFrame([(1, prose(1, 80)), (2, ""), (None, "x" * 300)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in c.contaminated(odd(spark), bench).collect()}
    assert {(3, 1), (4, 1), (12, 1), (5, None)} == got
    left = c.clean(odd(spark), bench)
    assert left.columns == odd(spark).columns and left.count() == len(odd_rows()) - 5
    assert c.contaminated(empty(spark), bench).count() == c.clean(empty(spark), bench).count() == 0
    assert c.contaminated(odd(spark), bench.where("false")).count() == 0
