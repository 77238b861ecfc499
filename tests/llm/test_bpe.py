from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from helpers import empty, odd, odd_rows
from tokenizers import Tokenizer

from pairloom.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_like_the_library(library):
    coder, r = bpe.Coder.load(PATH), random.Random(1)
    pool = [chr(c) for c in (*range(0x250), *range(0x300, 0x340), *range(0x370, 0x400), *range(0x1E00, 0x1F00), *range(0x2000, 0x2070), 0x3000, 0x212B, 0x1F600, 0xAC00, 0x1100, 0x1161, 0xFB01)]
    more = ["<|endoftext|>", "<|startoftext|>", " the ", "it's WE'LL", "12", "\n", "ΑΣ"]
    for _ in range(3000):
        said = "".join(r.choice(pool) if r.random() < 0.7 else r.choice(more) for _ in range(r.randint(0, 30)))
        want, ids = library.encode(said, add_special_tokens=False).ids, coder.encode(said)
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert coder.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_long_words_merge_alike(library):
    coder, said = bpe.Coder.load(PATH), "a" * 5000 + "thatthe" * 500
    assert np.frombuffer(coder.encode(said), "<u4").tolist() == library.encode(said, add_special_tokens=False).ids
    word = [coder.inner[b] for b in b"thatthethat" * 5]
    assert bpe.merge_scan(word, coder.ranks, coder.merged) == bpe.merge_heap(word, coder.ranks, coder.merged)


def test_query_rows(spark, library):
    got = sorted(map(tuple, bpe.digests(odd(spark), PATH).collect()), key=str)
    want = []
    for i, t, *_ in odd_rows():
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.digests(empty(spark), PATH).count() == 0
    assert bpe.encode(odd(spark), PATH).count() == len(odd_rows())
