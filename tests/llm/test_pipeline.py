"""run() over a small folder, held against a plain version of every stage."""

from __future__ import annotations

import hashlib
import random
import shutil
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from brute import brute_near
from helpers import odd, odd_rows, prose
from test_contamination import least_edits
from test_importance import brute_grams
from test_pii import RULES, fine
from tokenizers import Tokenizer

import __spark_entry__
from pairloom.llm import contamination, importance
from pairloom.llm.queries import QUERIES

import re


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path, r = tmp_path_factory.mktemp("tables"), random.Random(4)
    texts = []
    for i in range(240):
        t = prose(i, r.randint(20, 90))
        if i % 5 == 0:
            t = " ".join(w + "###" for w in t.split())
        elif i % 7 == 0:
            t = texts[i - 7].replace("th", "TH", 1)
        elif i % 11 == 0:
            t += " " + prose(5000 + i % 3, 30) + " end"
        elif i % 13 == 0:
            t += f" me{i}@x.org or 10.0.0.{i} +1 (407) 555-{1000 + i}"
        texts.append(t)
    docs = spark.createDataFrame([(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"file://{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"file://{path}/labels.parquet")
    spark.createDataFrame([(i, prose(5000 + i, 30)) for i in range(3)], "item_id long, text string").write.parquet(f"file://{path}/benchmark.parquet")
    return f"file://{path}", texts


def brute(texts):
    raw, target = np.zeros((2, 1 << importance.BUCKETS_LOG2))
    grams = {i: [x for n in importance.GRAMS for x in brute_grams(t, n)] for i, t in enumerate(texts)}
    for i, found in grams.items():
        np.add.at(raw, found, 1)
        if i % 5:
            np.add.at(target, found, 1)
    ratio = np.log((target + target.sum() / raw.sum()) / target.sum()) - np.log((raw + 1) / raw.sum())
    model = importance.Model(ratio, min(1.0, 0.8 + 2 * (0.8 * 0.2 / 240) ** 0.5))
    keys = {i: model.key(i, t)[1] for i, t in enumerate(texts)}
    left = sorted(keys, key=keys.get, reverse=True)[: int(np.ceil(240 * model.share))]
    left = brute_near({i: texts[i] for i in sorted(left)})
    items = [contamination.folded(prose(5000 + i, 30))[0] for i in range(3)]
    left = [i for i in left if all(least_edits(p, contamination.folded(texts[i])[0]) > int(len(p) * contamination.BUDGET) for p in items)]
    library, out = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for i in left:
        t, at, parts = texts[i], 0, []
        for a, _, b, k in sorted((m.start(), n, m.end(), k) for n, (k, r) in enumerate(RULES.items()) for m in re.finditer(r, t) if fine(k, m[0])):
            if a >= at:
                parts += [t[at:a], f"<{k.upper()}>"]
            at = max(at, b)
        ids = library.encode("".join([*parts, t[at:]]), add_special_tokens=False).ids
        out.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()))
    return out


def test_run(spark, folder):
    path, texts = folder
    got = corpus_pipeline.run(spark, path).collect()
    want = brute(texts)
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in got) == want
    assert 100 < len(want) < 230


def test_stages_return_the_columns_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder[0]).dtypes == docs.dtypes


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert set(QUERIES) <= set(names) and set(__spark_entry__.oracle_sql()) <= set(names)


def write(spark, path, docs, labels=(), benchmark=()):
    docs.write.parquet(f"file://{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").selectExpr("*", "'x' as text", "1 as rank_key").write.parquet(f"file://{path}/labels.parquet")
    spark.createDataFrame(list(benchmark), "item_id long, text string").selectExpr("*", "1 as doc_id", "'y' as found").write.parquet(f"file://{path}/benchmark.parquet")
    return f"file://{path}"


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    """Nulls, empty, long and repeated rows, and columns that clash, in every stage; no labels, so that all stay at first."""
    path = write(spark, tmp_path, odd(spark), benchmark=[(1, prose(3, 60)), (None, None), (2, "")])
    kept_ids = brute_near({i: t or "" for i, t, *_ in odd_rows() if i is not None})
    gone = {12}  # holds the item
    rows = [r for r in odd_rows() if r[0] is None or (r[0] in kept_ids and r[0] not in gone)]
    got = corpus_pipeline.run(spark, path).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((str(i), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == want


def test_empty_tables(spark, tmp_path):
    path = write(spark, tmp_path, odd(spark).where("false"))
    assert corpus_pipeline.run(spark, path).count() == 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd(spark).where("false"), path).columns == odd(spark).columns


def test_entry_hides_only_what_was_deleted(tmp_path):
    """Without the package the entry works; with it but for something that it needs, the error is not swallowed."""
    root = Path(__file__).resolve().parents[2]
    shutil.copytree(root / "pairloom", tmp_path / "pairloom", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        shutil.copy(root / name, tmp_path / name)
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), sum(n.startswith('op') for n in e.queries()))"], cwd=tmp_path, capture_output=True, text=True)
    assert run().stdout.split()[1] == "10"
    flac = (tmp_path / "pairloom/llm/flac.py").read_text()
    (tmp_path / "pairloom/llm/flac.py").write_text(flac + "import no_such_library\n")
    assert "no_such_library" in run().stderr and run().returncode
    shutil.rmtree(tmp_path / "pairloom/llm")
    assert run().stdout.split()[1] == "0"
    (tmp_path / "corpus_pipeline.py").unlink()
    assert run().stdout.split()[1] == "0"
