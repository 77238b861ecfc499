"""Small documents that hold what goes wrong: nulls, empty and long texts, repeated rows, clashing columns."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "fp key g s a b kind rid spans start stop ids decoded rank_key log_weight ords tf score digest found i d shard evidence packed ranges n rep node root u v packed_0 doc_0 found_0".split()


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("th er on an re he in ed nd ha at en es of".split()) for _ in range(r.randint(1, 3))) for _ in range(words))


def odd_rows() -> list[tuple]:
    near = prose(50, 120)
    texts = [None, "", "   ", prose(1, 80), prose(1, 80), "x" * 5000, prose(2, 4000), near, near.replace("th", "ht", 1), "é ß İ Σ 😀 " * 30, "\x00\x01", "one", prose(3, 60) + " " + prose(1, 80)]
    rows = [(i, t, "en" if i % 2 else None, f"src{i % 2}", len(t) if t is not None else None) for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[0], (None, "no id", "en", "src0", 5), (None, None, None, None, None)]


def odd(spark):
    df = spark.createDataFrame(odd_rows(), SCHEMA)
    return df.withColumns({c: F.lit(c) for c in CLASHING})


def empty(spark):
    return odd(spark).where("false")
