"""The whole forms of queries whose SQL takes the first rows only."""

from __future__ import annotations

import hashlib

from pairloom.plans import catalog


def folder(spark, path) -> tuple[str, list]:
    rows = [(i, f"line {i}\n2) second of {i}\n```cpp last", "en" if i % 2 else "fr", "src0", 30) for i in range(90)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{path}/documents.parquet")
    return f"file://{path}", rows


def test_whole(spark, tmp_path):
    path, rows = folder(spark, tmp_path / "t")
    run = lambda name: catalog.QUERIES[name](spark, path).collect()
    en, fr = ([r[0] for r in rows if r[2] == x] for x in ("en", "fr"))
    assert {(r.l, r.r) for r in run("j10_offset_negatives")} == {(en[i], fr[(i + 15) % 45]) for i in range(45)}
    assert {(r.l, r.r) for r in run("j11_ordered_negatives")} == set([(en[i], fr[j]) for i in range(45) for j in range(45) if i != j][:1000])
    want = {r[0]: hashlib.md5(r[1].replace("```cpp", "").encode()).hexdigest() for r in rows}
    assert {r.doc_id: r.digest for r in run("f28_numbering")} == want
    h = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:8], 16)
    p, got = 2**31 - 1, {(r.doc_id, r.place): r.value for r in run("f6_minhash")}
    assert len(got) == 90 * 128
    said = "line 7 2) second of 7 ```cpp last"
    grams = [h(said[i : i + 5]) % p for i in range(len(said) - 4)]
    assert [got[7, k] for k in range(128)] == [min((g * (h(f"a:{k}") % (p - 1) + 1) + h(f"b:{k}") % p) % p for g in grams) for k in range(128)]
