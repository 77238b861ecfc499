"""j7 and j8 against brute force, with copies and near copies on both sides."""

from __future__ import annotations

import hashlib
import random

import pytest

from pairloom.operators import dedup
from pairloom.plans import catalog


def words(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def shingles(s: str) -> set[str]:
    return {s[i : i + 5] for i in range(len(s) - 4)}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path, texts = tmp_path_factory.mktemp("sides"), {}
    for g in range(6):
        base = words(g, 80)
        near = " ".join([*base[:40], "changed", *base[41:]])
        first = 20 * g + g % 2
        # the text on both sides, twice on each; a near copy whose two smallest ids have the parity of the text's
        texts |= {first + k: " ".join(base) for k in (0, 1, 2, 3)} | {first + k: near for k in (4, 6, 9)}
        # near copies that are on one side by their smallest ids, but cross by a later copy
        texts |= {first + k: " ".join(words(100 + g, 70)) for k in (10, 12)} | {first + k: " ".join([*words(100 + g, 70)[:-1], "other"]) for k in (14, 17)}
    texts |= {200 + i: " ".join(words(500 + i, 60)) for i in range(20)}
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"file://{path}/documents.parquet")
    return f"file://{path}", texts


def test_j8_is_brute_force(spark, tables):
    path, texts = tables
    want = {}
    for i in (i for i in texts if i % 2 == 0):
        alike = {j: len(shingles(texts[i]) & shingles(texts[j])) / len(shingles(texts[i]) | shingles(texts[j])) for j in texts if j % 2}
        best = max(alike, key=lambda j: (alike[j], -j))
        if alike[best] > 0.7:
            want[i] = (best, round(alike[best], 9))
    got = catalog.QUERIES["j8_contaminated"](spark, path).collect()
    assert len(got) == len(want) > 30
    assert {r.test_id: (r.best, round(r.similarity, 9)) for r in got} == want


def test_j7_and_membership_hold_every_pair_across(spark, tables):
    path, texts = tables
    members = {}
    for r in catalog.QUERIES["j7_membership"](spark, path).collect():
        members.setdefault(r.first_id, []).append(r.doc_id)
    assert sorted(x for m in members.values() for x in m) == sorted(texts)
    got = {(a, b) for r in catalog.QUERIES["j7_lsh_candidates"](spark, path).collect() for a in members[r.test_id] for b in members[r.train_id]}
    assert {(i, j) for i in texts for j in texts if i % 2 == 0 and j % 2 and texts[i] == texts[j]} <= got


def test_exact_pairs_are_all_pairs(spark, tables):
    path, texts = tables
    first = {}
    for i in sorted(texts):
        first.setdefault((texts[i], i % 2), i)
    want = {}
    for (a, p), i in first.items():
        for (b, q), j in first.items():
            if p == 0 and q == 1:
                s = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
                if s > 0.7:
                    want[i, j] = round(s, 9)
    got = {(r.test_id, r.train_id): round(r.similarity, 9) for r in catalog.QUERIES["j8_exact_pairs"](spark, path).collect()}
    assert got == want and len(want) > 20


def brute(texts):
    """test_id -> (best, similarity) over train texts that share a band, from signatures made plainly."""
    a, b = dedup.permutations()
    signs = {i: [min((int.from_bytes(hashlib.md5(x.encode()).digest()[:4], "big") % dedup.PRIME * int(p) + int(q)) % dedup.PRIME for x in shingles(t)) if shingles(t) else dedup.PRIME for p, q in zip(a, b)] for i, t in texts.items()}
    found = {}
    for i, t in texts.items():
        for j, u in texts.items():
            if i % 2 == 0 and j % 2 and any(signs[i][k : k + 8] == signs[j][k : k + 8] for k in range(0, 128, 8)):
                s = len(shingles(t) & shingles(u)) / len(shingles(t) | shingles(u)) if shingles(t) | shingles(u) else 1.0
                if s > 0.7 and (i not in found or (s, -j) > (found[i][1], -found[i][0])):
                    found[i] = (j, s)
    return found


@pytest.mark.parametrize(("hot", "block"), [(64, 256), (4, 3), (0, 256)])
def test_best_in_bands_is_brute_force_in_small_and_large_bands(spark, monkeypatch, hot, block):
    monkeypatch.setattr(dedup, "HOT", hot)
    monkeypatch.setattr(dedup, "BLOCK", block)
    r, texts = random.Random(3), {}
    for g in range(4):
        base = words(g, 40)
        texts |= {40 * g + i: " ".join(w if r.random() > 0.02 else "other" + w for w in base) for i in range(22)}
    texts |= {300: "", 301: "abc", 302: "ab", 303: "", 305: "漢字仮名交じり😀文", 306: "漢字仮名交じり😀文"}
    docs = spark.createDataFrame([(i % 2, i, t) for i, t in texts.items()], "side int, id long, s string")
    got = {x.test_id: (x.best, x.similarity) for x in dedup.contaminated(dedup.best_in_bands(docs), "test_id", "train_id").collect()}
    assert got == brute(texts) and len(got) > 20


def test_memo_of_shingles_stays_bounded_and_gives_the_same_signatures(monkeypatch):
    r = random.Random(7)
    monkeypatch.setattr(dedup.Minima, "ROWS", 1 << 14)
    known = dedup.Minima(*dedup.permutations(16))
    for n in (0, 4, 5, 300, 9000, 40000):
        said = "".join(r.choice("abcdefghijklmnopqrstuvwxyz漢😀") for _ in range(n))
        h = [int.from_bytes(hashlib.md5(x.encode()).digest()[:4], "big") % dedup.PRIME for x in shingles(said)]
        got, m = known.signature(said)
        assert m == len(h) and got.tolist() == [min(((x * int(a) + int(b)) % dedup.PRIME for x in h), default=dedup.PRIME) for a, b in zip(known.a, known.b)]
        assert len(known.at) + len(known.new) <= known.ROWS


def test_each_shingle_is_digested_once(monkeypatch):
    known, seen = dedup.Minima(*dedup.permutations(8)), []
    plain = known.permuted
    monkeypatch.setattr(known, "permuted", lambda x: seen.extend(x) or plain(x))
    for _ in range(3):
        known.signature("one text of some words and one more")
    assert len(seen) == len(set(seen))
