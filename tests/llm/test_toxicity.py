from __future__ import annotations

import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from helpers import empty, odd, odd_rows, prose
from pyspark.sql import functions as F

from pairloom.llm import toxicity


@pytest.mark.parametrize("dense", [1, 16, 1000])
def test_search_is_exact(monkeypatch, dense):
    monkeypatch.setattr(toxicity, "DENSE", dense)
    r = np.random.default_rng(1)
    weight = r.random(20) + 1

    def some(least):
        o = np.sort(r.choice(20, r.integers(least, 6), replace=False))
        return toxicity.weigh(weight, o, r.integers(1, 4, len(o)))

    index = toxicity.Index(np.arange(20), weight, np.arange(700), r.integers(0, 2, 700).astype(float), [some(0) for _ in range(700)], neighbours=7)
    for n in range(60):
        o, w = some(1)
        vector = np.zeros(20)
        vector[o] = w
        sims = np.array([vector[a] @ b for a, b in index.rows]).round(9)
        sims[n] = -1  # as in leave-one-out
        kth = np.sort(sims)[-7]
        want = {i for i in range(700) if sims[i] > 0 and sims[i] >= kth}
        near, score = index.search(o, w, skip=n)
        assert set(near.tolist()) == want and np.allclose(np.sort(score), np.sort(sims[sorted(want)]))


def test_terms_and_what_they_take():
    """Terms are the runs of letters in lower case, whatever the text's characters; Latin-1 texts need no pattern."""
    r = random.Random(3)
    pools = [[chr(i) for i in range(128)], [chr(i) for i in range(256)], [*map(chr, range(256)), *"œŒİıΣσςẞ’“ÅK𝐀Ⅷ²½\ud800"]]
    for said in ["", "ÀÉÿ ß µ ª", "ΟΔΟΣ İ", *("".join(r.choice(pool) for _ in range(400)) for pool in pools for _ in range(100))]:
        found = Counter(xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in toxicity.WORD.findall(said.lower()))
        keys, tf = toxicity.counted(said)
        assert dict(zip(keys.view(np.uint64).tolist(), tf.tolist())) == found and (np.diff(keys) > 0).all()

    def seconds(f):
        began = time.process_time()
        for t in texts:
            f(t)
        return time.process_time() - began

    texts = [prose(i, 500) + " é" for i in range(100)]
    assert min(seconds(lambda t: toxicity.words(t)) for _ in range(3)) < 0.5 * min(seconds(lambda t: toxicity.WORD.findall(t.lower())) for _ in range(3))


def corpus(spark):
    bad = ["grot", "flim", "zurk"]
    rows = [(i, prose(i, 40) + (f" {bad[i % 3]} " + prose(i + 900, 9) if i % 5 == 0 else ""), int(i % 5 == 0)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return df.select("doc_id", "text"), df.select("doc_id", "toxic")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    got = toxicity.scores(docs, labels).join(labels, "doc_id").collect()
    assert len(got) == 600
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert np.mean([r.predicted == r.toxic for r in got if r.held_out]) > 0.97
    toxic_evidence = [r.evidence for r in got if r.predicted]
    assert all(e and len(e) <= toxicity.NEIGHBOURS for e in toxic_evidence)


def brute_scores(texts, labels):
    """Scores by plain dictionaries: every pair of a text and an example."""
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    bags = {i: Counter(toxicity.WORD.findall(t.lower())) for i, t in texts.items()}
    df = Counter(w for b in bags.values() for w in b)
    known = {i: y for i, y in labels.items() if not held(i)}
    n1, n = sum(known.values()), len(known)
    seen = [Counter(w for i, y in known.items() if y == c for w in bags[i]) for c in (0, 1)]
    cell = lambda a, e: a * math.log(a / e) if a else 0.0

    def weight(w):
        a, b = seen[1][w], seen[0][w]
        s = (a + b) / n
        g2 = 2 * (cell(a, n1 * s) + cell(b, (n - n1) * s) + cell(n1 - a, n1 * (1 - s)) + cell(n - n1 - b, (n - n1) * (1 - s))) if 0 < s else 0.0
        return (math.log((1 + len(texts)) / (1 + df[w])) + 1) * math.sqrt(max(g2, 0))

    def vector(bag):
        v = {w: (1 + math.log(f)) * weight(w) for w, f in bag.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items() if x > 0}

    rows = {i: vector(bags[i]) for i in known}

    def vote(v, skip=None):
        sims = {i: round(sum(x * r.get(w, 0.0) for w, x in v.items()), 9) for i, r in rows.items() if i != skip}
        kth = sorted(sims.values(), reverse=True)[toxicity.NEIGHBOURS - 1]
        near = {i: s for i, s in sims.items() if s >= kth and s > 0}
        return (sum(s * known[i] for i, s in near.items()) + toxicity.PRIOR * n1 / n) / (sum(near.values()) + toxicity.PRIOR)

    x, y = toxicity.logit(np.array([vote(rows[i], i) for i in known])), np.array([*known.values()], float)
    def loss(ab):
        z = ab[0] * x + ab[1]
        return np.logaddexp(0, np.where(y == 1, -z, z)).sum() + 0.005 * ((ab[0] - 1) ** 2 + ab[1] ** 2)

    at, step = (1.0, 0.0), 1.0
    while step > 1e-7:  # a pattern search for the same optimum
        best = min(((at[0] + i * step, at[1] + j * step) for i in (-1, 0, 1) for j in (-1, 0, 1)), key=loss)
        at, step = (best, step) if loss(best) < loss(at) else (at, step / 2)
    a, b = at
    return {i: 1 / (1 + math.exp(-(a * toxicity.logit(vote(vector(bag))) + b))) for i, bag in bags.items()}


def test_scores_like_brute_force(spark):
    docs, labels = corpus(spark)
    docs, labels = docs.where("doc_id < 150"), labels.where("doc_id < 150")
    want = brute_scores({r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.toxic for r in labels.collect()})
    got = {r.doc_id: r.score for r in toxicity.scores(docs, labels).collect()}
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-3


def test_few_examples_of_a_lexicon_count(spark):
    """A rare language's insult, in three examples only, is known again."""
    docs, labels = corpus(spark)
    rare = spark.createDataFrame([(1000 + i, prose(5000 + i, 30).replace("e", "ö") + " schwurk " + prose(6000 + i, 5), 1) for i in range(40)], "doc_id long, text string, toxic int")
    few = rare.where("doc_id < 1010")
    got = toxicity.scores(docs.unionByName(rare.select("doc_id", "text")), labels.unionByName(few.select("doc_id", "toxic"))).where("doc_id >= 1010").collect()
    assert np.mean([r.predicted for r in got]) > 0.9


def test_long_text(spark):
    docs, labels = corpus(spark)
    long = spark.createDataFrame([(9000, "grot " + prose(77, 300_000)), (9001, prose(78, 300_000))], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.scores(docs.unionByName(long), labels).where("doc_id >= 9000").collect()}
    assert got[9000] > got[9001]


def test_held_out_labels_are_never_used(spark):
    docs, labels = corpus(spark)
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r.doc_id: r.score for r in toxicity.scores(docs, x).collect()} for x in (labels, turned))
    assert a == b


@pytest.mark.parametrize("labelled", [[], [(3, 1)], [(3, 1), (3, 0), (None, 1), (6, None), (7, 0), (8, 5)]])
def test_odd_rows(spark, labelled):
    labels = spark.createDataFrame(labelled, "doc_id long, toxic int").selectExpr("*", "'x' as text", "1 as keys", "2 as score")
    assert toxicity.scores(odd(spark), labels).count() == len(odd_rows())
    assert toxicity.scores(empty(spark), labels).count() == 0
