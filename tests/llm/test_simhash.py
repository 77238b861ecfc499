from __future__ import annotations

import numpy as np
import xxhash
from brute import brute_near
from helpers import empty, odd, odd_rows, prose

from pairloom.llm import simhash
from pairloom.llm.components import components


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + n]), 42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in fps:
        for j in fps:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= 4 and (a := find(i)) != (b := find(j)):
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in fps}


def test_fingerprints():
    for t in ("", "a", "A b c", prose(4, 300), "É Σ x y\x0bz\x1fq w"):
        assert simhash.fingerprint(t) == brute_fingerprint(t)
    simhash_chunk, simhash.CHUNK = simhash.CHUNK, 7
    assert simhash.fingerprint(prose(4, 300)) == brute_fingerprint(prose(4, 300))
    simhash.CHUNK = simhash_chunk


def test_odd_rows(spark):
    got = simhash.near_duplicates(odd(spark)).collect()
    fps = {i: brute_fingerprint(t) for i, t, *_ in odd_rows() if i is not None}
    want = brute_components(fps)
    assert len(got) == len(odd_rows())
    for r in got:
        if r.doc_id is not None:
            assert (int(r.fingerprint, 16), r.component_id) == (fps[r.doc_id], want[r.doc_id])
    assert simhash.near_duplicates(empty(spark)).count() == 0
    left = simhash.deduplicated(odd(spark))
    assert left.columns == odd(spark).columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted([*map(str, brute_near({i: t or "" for i, t, *_ in odd_rows() if i is not None})), "0", "3", "None", "None"])


def test_links_of_hot_and_cold_blocks(spark, monkeypatch):
    r = np.random.default_rng(5)
    base = [int(x) for x in r.integers(0, 1 << 63, 4)]
    fps = {}
    for i in range(300):
        f = base[i % 4]
        for bit in r.integers(0, 64, int(r.integers(0, 7))):
            f ^= 1 << int(bit)
        fps[i] = f
    unique = {f: min(i for i in fps if fps[i] == f) for f in fps.values()}
    rows = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for f, i in unique.items()], "fp long, rep long")
    want = brute_components({i: f for f, i in unique.items()})
    for hot, tile in ((1 << 30, 1 << 30), (1, 20), (3, 7)):
        monkeypatch.setattr(simhash, "HOT", hot)
        monkeypatch.setattr(simhash, "TILE", tile)
        got = {r.node: r.root for r in components(simhash.links(rows)).collect()}
        assert {i: got.get(i, i) for i in want} == want


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 400), (400, 400), (500, 400)], "u long, v long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {500: 400}
    assert components(edges.where("false")).count() == 0


def test_no_table_of_the_corpus_is_broadcast(spark, monkeypatch):
    from pairloom.llm import components

    plans, plain = [], simhash.kept
    seen = lambda df, *rest: plans.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df, *rest)
    monkeypatch.setattr(simhash, "kept", seen)
    monkeypatch.setattr(components, "kept", seen)
    docs = spark.createDataFrame([(i, f"some words of a text that number {i % 5} has too") for i in range(40)], "doc_id long, text string")
    found = simhash.near_duplicates(docs)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert found.count() == 40 and sum("SortMergeJoin" in p for p in plans) >= 3
    assert not any("Broadcast" in p for p in plans)
