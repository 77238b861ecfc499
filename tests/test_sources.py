from __future__ import annotations

import zipfile

import pytest
from pyspark.sql import functions as F

from pairloom.sources import readers, sinks
from pairloom.streaming import incremental


def test_metadata(spark, tmp_path):
    subs = spark.createDataFrame([("s1", "Python", "Accepted", "py", "10", "p1"), ("s2", "Java", "Wrong Answer", "java", "x", "p2")], readers.METADATA + ", problem_id string")
    path = f"file://{tmp_path}/m"
    sinks.write_metadata(subs, path)
    got = {(r.problem_id, r.submission_id, r.code_size) for r in readers.read_metadata(spark, path).collect()}
    assert got == {("p1", "s1", 10), ("p2", "s2", 0)}
    assert readers.read_metadata(spark, path, languages=["Java"]).count() == 1


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n{"a": \n{"a": 2}\n')
    assert [r.a for r in readers.read_jsonl(spark, f"file://{tmp_path}/a.jsonl", "a int").collect()] == [1, 2]
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_jsonl(spark, f"file://{tmp_path}/a.jsonl", "a int", strict=True).collect()


def test_archives_and_blocks(spark, tmp_path):
    said = sinks.RULE + "\na\n" + sinks.BAR + "\nb\n" + sinks.RULE + "\nonly\n" + sinks.RULE
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("in.txt", said)
    got = readers.read_zipped(spark, f"file://{tmp_path}").select("member", readers.clone_blocks(F.col("text")).alias("b")).first()
    assert got.member == "in.txt" and got.b == [["a", "b"]]


def test_sources_and_aligned(spark, tmp_path):
    (tmp_path / "data/p1/Python").mkdir(parents=True)
    (tmp_path / "data/p1/Python/s1.py").write_bytes(b"x = 1\xff\n")
    row = readers.read_sources(spark, f"file://{tmp_path}/data").first()
    assert (row.problem_id, row.lang, row.submission_id, row.ext) == ("p1", "Python", "s1", "py") and row.text.startswith("x = 1")
    (tmp_path / "l").write_text("a\nb\nc\n")
    (tmp_path / "r").write_text("1\n2\n")
    assert [(r.left, r.right) for r in readers.read_aligned(spark, f"file://{tmp_path}/l", f"file://{tmp_path}/r").orderBy("line_no").collect()] == [("a", "1"), ("b", "2")]


def test_clone_report(spark, tmp_path):
    df = spark.createDataFrame([(80, "a&b.py", "c.py")], "s int, a string, b string")
    sinks.write_clones(df.select(F.col("s").alias("similarity"), F.array("a", "b").alias("files")), f"file://{tmp_path}/c")
    row = readers.read_clones(spark, f"file://{tmp_path}/c").first()
    assert row.similarity == 80 and row.files == ["a&b.py", "c.py"]
    with pytest.raises(ValueError):
        sinks.write_clones(df.where("false").select(F.col("s").alias("similarity"), F.array("a").alias("files")), f"file://{tmp_path}/d")
    assert df.select(sinks.clone_element(F.col("s"), F.col("a")).alias("x")).first().x == '<clone similarity="80"><source file="a&amp;b.py" startline="1" endline="1"></source></clone>'


def test_metric_files_last_wins(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"checkpoint": "c", "f1": 0.1}')
    (tmp_path / "b.json").write_text('{"checkpoint": "c", "f1": 0.2}')
    assert [r.f1 for r in readers.read_metric_files(spark, f"file://{tmp_path}/*.json", "checkpoint string, f1 double").collect()] == [0.2]


def test_incremental_probe(spark, tmp_path):
    words = "the quick brown fox jumps over the lazy dog and runs far away into the deep woods"
    incremental.index(spark.createDataFrame([(1, words)], "doc_id long, text string"), f"file://{tmp_path}/i")
    spark.createDataFrame([(7, words), (8, "quite another text that shares nothing")], "doc_id long, text string").write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("doc_id long, text string").parquet(f"file://{tmp_path}/in")
    incremental.watch(stream, f"file://{tmp_path}/i", f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination(120)
    assert [(r.doc_id, r.best) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()] == [(7, 1)]


def test_lines_are_numbered_over_splits(spark, tmp_path):
    (tmp_path / "b").write_text("".join(f"line {i}\n" for i in range(500)))
    (tmp_path / "a").write_text("first\r\n\nthird")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        got = {r.line_no: r.text for r in readers.read_lines(spark, f"file://{tmp_path}").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == dict(enumerate(["first", "", "third", *(f"line {i}" for i in range(500))]))


def test_split_files(spark, tmp_path):
    for pair, name in (("a_b", "train_a.jsonl"), ("a_b", "val.jsonl"), ("c_d", "test_dd.jsonl"), ("c_d", "other.jsonl")):
        (tmp_path / pair).mkdir(exist_ok=True)
        (tmp_path / pair / name).write_text('{"x": 1}\n')
    got = {(r.lang_pair, r.split) for r in readers.read_split_files(spark, f"file://{tmp_path}", "x int").collect()}
    assert got == {("a_b", "train_a"), ("a_b", "val"), ("c_d", "test_dd")}


def test_swap_replaces_a_table_that_is_read(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.range(5).write.parquet(path)
    for n in (1, 2):
        sinks.swap(spark, sinks.rewrite(spark.read.parquet(path).withColumn("id", F.col("id") + 10), path), path)
        assert sorted(r.id for r in spark.read.parquet(path).collect()) == [10 * n + i for i in range(5)]
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_small_documents_are_small(spark):
    assert sinks.small_document(spark.range(2).selectExpr("id", "'é' as x")).count("é") == 2
    with pytest.raises(ValueError):
        sinks.small_document(spark.range(20), most=10)


def test_shared_folders_only(spark):
    class Elsewhere:
        conf = {"spark.master": "yarn"}

    with pytest.raises(ValueError, match="share"):
        sinks.scratch(Elsewhere(), "x")
