from __future__ import annotations

import numpy as np
import pytest
from helpers import CLASHING, empty, odd, odd_rows, prose

from pairloom.llm import importance


def brute_grams(text, n):
    raw = text.encode()
    for i in range(len(raw) - n + 1):
        yield int.from_bytes(raw[i : i + n], "little") * (0x9E3779B97F4A7C15 + 2 * n) % 2**64 >> 64 - importance.BUCKETS_LOG2


@pytest.mark.parametrize("chunk", [importance.CHUNK, 11])
def test_hashing(monkeypatch, chunk):
    monkeypatch.setattr(importance, "CHUNK", chunk)
    for t in ("", "a", "abcde", prose(1, 50) + "é"):
        got = np.concatenate([*importance.hashed(t), np.zeros(0, np.int32)])
        assert sorted(got.tolist()) == sorted(x for n in importance.GRAMS for x in brute_grams(t, n))


def corpus(spark):
    rows = [(i, prose(i, 60) if i % 4 else " ".join(w + "$$$" for w in prose(i, 60).split()), int(i % 4 > 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    return df.select("doc_id", "text"), df.select("doc_id", "quality")


def test_sample(spark):
    docs, labels = corpus(spark)
    model = importance.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    raw, target = np.zeros((2, 1 << importance.BUCKETS_LOG2))
    for i, t in texts.items():
        for n in importance.GRAMS:
            for x in brute_grams(t, n):
                raw[x] += 1
                target[x] += i % 4 > 0
    part = target.sum() / raw.sum()
    assert np.allclose(model.ratio, np.log((target + part) / target.sum()) - np.log((raw + 1) / raw.sum()))
    keys = {i: model.key(i, t)[1] for i, t in texts.items()}
    grams = {i: [x for n in importance.GRAMS for x in brute_grams(t, n)] for i, t in texts.items()}
    assert all(np.isclose(model.weight(t), sum(model.ratio[grams[i]]) / (1 + (len(grams[i]) - 1) / importance.ALIKE)) for i, t in texts.items())
    k = int(np.ceil(400 * model.share))
    want = set(sorted(keys, key=keys.get, reverse=True)[:k])
    assert {r.doc_id for r in importance.resample(docs, labels).collect()} == want
    assert {r.doc_id for r in importance.filtered(docs, labels).collect()} == want
    assert {i for i in texts if i % 4} <= want


def test_kth_largest(spark):
    r = np.random.default_rng(2)
    keys = [int(x) for x in r.integers(-(1 << 62), 1 << 62, 200)] + [5] * 30 + [-1, 0, (1 << 63) - 1, -(1 << 63)]
    df = spark.createDataFrame([(k,) for k in keys], "rank_key long")
    for k in (1, 2, 60, 110, 130, len(keys)):
        assert importance.kth_largest(df, k) == sorted(keys, reverse=True)[k - 1]


@pytest.mark.parametrize("labelled", [[], [(3, 0)], [(3, 1), (4, 0), (None, 1), (5, None), (6, 9), (3, 1)]])
def test_odd_rows(spark, labelled):
    labels = spark.createDataFrame(labelled, "doc_id long, quality int").selectExpr("*", "'x' as text", "1 as bucket", "2 as rank_key")
    got = importance.filtered(odd(spark), labels)
    assert got.columns == odd(spark).columns and set(CLASHING) < set(got.columns)
    assert got.count() == len(odd_rows()) if len(labelled) < 2 else got.count() > 0
    assert importance.filtered(empty(spark), labels).count() == importance.resample(empty(spark), labels).count() == 0


def test_rows_without_a_doc_id_draw_their_own_noise():
    model = importance.Model(np.zeros(1 << importance.BUCKETS_LOG2), 0.5)
    assert model.key(None, "a")[1] != model.key(None, "b")[1] and model.key(None, "a") == model.key(None, "a")
    assert model.key(1, "a") == model.key(1, "b") and model.key(1, "x" * 3_000_000)[0] == 0
