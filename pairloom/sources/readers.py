"""Readers: metadata CSV, source files, JSON lines, archives, aligned files, clone XML, lists and logs."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.functions import text

#: The columns of metadata, and the rules of validation texts.
METADATA = "submission_id string, language string, status string, filename_ext string, code_size string"
RULE, BAR = "$" * 40, "-" * 40


def read_metadata(spark: SparkSession, path: str, languages: list[str] | None = None, statuses: list[str] | None = None) -> DataFrame:
    """Submissions from a CSV per problem; the problem is the file's stem, or its folder problem_id=..., the size 0 if it is no number."""
    rows = spark.read.option("recursiveFileLookup", "true").csv(path, schema=METADATA, header=True, mode="PERMISSIVE")
    file = F.col("_metadata.file_path")
    folder = F.regexp_extract(file, r"problem_id=([^/]+)/", 1)
    rows = rows.withColumn("problem_id", F.when(folder != "", F.url_decode(folder)).otherwise(F.regexp_extract(file, r"([^/]+?)\.[^./]*$", 1)))
    rows = rows.withColumn("code_size", text.safe_int(F.col("code_size")))
    for c, some in (("language", languages), ("status", statuses)):
        rows = rows.where(F.col(c).isin(some)) if some else rows
    return rows


def read_sources(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, problem_id, lang, submission_id, ext, text) of data/{problem}/{lang}/{submission}.{ext}; bad bytes are replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    part = lambda n: F.regexp_extract("path", r"([^/]+)/([^/]+)/([^/]+?)\.([^./]+)$", n)
    return files.select("path", part(1).alias("problem_id"), part(2).alias("lang"), part(3).alias("submission_id"), part(4).alias("ext"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """JSON lines; malformed rows are dropped, or are an error if strict."""
    return spark.read.json(path, schema=schema, mode="FAILFAST" if strict else "DROPMALFORMED")


def read_split_tree(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines in a tree; lang_pair and split from the folders."""
    rows = spark.read.option("recursiveFileLookup", "true").json(path, schema=schema)
    part = lambda name: F.regexp_extract("_metadata.file_path", rf"{name}=([^/]+)/", 1)
    return rows.withColumn("lang_pair", part("lang_pair")).withColumn("split", part("split"))


#: The split that each file name stands for.
SPLITS = {"train_a.jsonl": "train_a", "train_b.jsonl": "train_b", "val.jsonl": "val", "test_sd.jsonl": "test_sd", "test_dd.jsonl": "test_dd"}


def read_split_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of {lang_pair}/{name}.jsonl (files, or folders of parts); other names than those of SPLITS are passed over."""
    rows = spark.read.option("recursiveFileLookup", "true").json(path, schema=schema)
    part = lambda n: F.regexp_extract("_metadata.file_path", r"([^/]+)/([^/]+\.jsonl)(?:/part-[^/]*)?$", n)
    names = F.create_map(*[F.lit(x) for pair in SPLITS.items() for x in pair])
    return rows.withColumn("lang_pair", part(1)).withColumn("split", F.try_element_at(names, part(2))).where("split is not null")


def read_zipped(spark: SparkSession, path: str, member: str | None = None) -> DataFrame:
    """(path, member, text) of archives' text members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, raw in zip(b.column("path").to_pylist(), b.column("content")):
                with zipfile.ZipFile(io.BytesIO(raw.as_py())) as z:
                    for name in z.namelist():
                        if member in (None, name) and not name.endswith("/"):
                            yield pa.RecordBatch.from_pydict({"path": [p], "member": [name], "text": [z.read(name).decode(errors="replace")]})

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content").mapInArrow(run, "path string, member string, text string")


def clone_blocks(said: Column) -> Column:
    """array of arrays: the parts of each block of a validation text; blocks of fewer than two parts are left out."""
    parts = F.transform(F.split(said, f"(?:\\Q{RULE}\\E)", -1), lambda b: F.filter(F.transform(F.split(b, BAR, -1), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != ""))
    return F.filter(parts, lambda p: F.size(p) >= 2)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, text) of a file, or of a folder's files by name, numbered from 0 in order; no task holds a whole file.

    Lines are numbered within their split, and splits by file and offset; the offsets are one small row per split.
    """
    at = ["_metadata.file_path", "_metadata.file_block_start"]
    rows = spark.read.text(path).select(F.col("value").alias("text"), *(F.col(c).alias(n) for c, n in zip(at, ("file", "start"))), F.monotonically_increasing_id().alias("order"))
    sizes = rows.groupBy("file", "start").agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("file", "start").orderBy("order")) - 1
    numbered = rows.withColumn("within", within).join(F.broadcast(sizes.select("file", "start", before.alias("before"))), ["file", "start"])
    return numbered.select((F.col("before") + F.col("within")).alias("line_no"), "text")


def read_aligned(spark: SparkSession, left: str, right: str) -> DataFrame:
    """(line_no, left, right) as far as both files go."""
    a, b = read_lines(spark, left).withColumnRenamed("text", "left"), read_lines(spark, right).withColumnRenamed("text", "right")
    return a.join(b, "line_no")


def read_clones(spark: SparkSession, path: str) -> DataFrame:
    """(similarity, files) of a clone detector's XML."""
    rows = spark.read.schema("_similarity int, source array<struct<_file:string,_startline:int,_endline:int>>").format("xml").option("rowTag", "clone").load(path)
    return rows.select(F.col("_similarity").alias("similarity"), F.transform("source", lambda s: s["_file"]).alias("files"))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """One path a line; blank lines are kept."""
    return spark.read.text(path).select(F.col("value").alias("path"))


def log_entries(said: Column, schema: str = "loss double, grad_norm double, learning_rate double, epoch double") -> Column:
    """The dicts with a loss in a trainer's log text, as structs."""
    found = F.regexp_extract_all(F.replace(said, F.lit("\r"), F.lit("\n")), F.lit(r"(\{[^{}]*'loss'[^{}]*\})"), F.lit(1))
    return F.transform(found, lambda x: F.from_json(text.literal_to_json(x), schema))


def read_metric_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Metric documents, the last file of each checkpoint."""
    rows = spark.read.json(path, schema=schema, multiLine=True).withColumn("file", F.col("_metadata.file_path"))
    names = [c for c in rows.columns if c != "file"]
    return rows.groupBy("checkpoint").agg(F.max_by(F.struct(*names), "file").alias("last")).select("last.*")


def list_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(path, length) of the files that a pattern names; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "length")


def read_summary(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A summary document, an array of objects over several lines."""
    return spark.read.json(path, schema=schema, multiLine=True)


def folder_counts(files: DataFrame, depth: int = 2) -> DataFrame:
    """Files and bytes of listed files (path, length) by the `depth` folders above each."""
    folders = F.slice(F.split(F.col("path"), "/"), -(depth + 1), depth)
    return files.groupBy(*(F.url_decode(F.get(folders, F.lit(i))).alias(f"folder{i + 1}") for i in range(depth))).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
