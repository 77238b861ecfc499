"""Writers: CSV per problem, JSON lines, fan-out, validation blocks, clone XML, small documents."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pairloom.functions import text
from pairloom.sources.readers import BAR, RULE


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share, from spark.checkpoint.dir; without one, a local folder on a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that executors share")
        base = "file://" + tempfile.mkdtemp(prefix="pairloom-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_metadata(subs: DataFrame, path: str) -> None:
    """A folder of CSV for each problem."""
    columns = ["submission_id", "language", "status", "filename_ext", "code_size"]
    subs.select("problem_id", *columns).repartition("problem_id").write.partitionBy("problem_id").csv(path, header=True)


def write_jsonl(df: DataFrame, path: str) -> int:
    """JSON lines; the number of rows, counted as they are written."""
    seen = Observation()
    df.observe(seen, F.count("*").alias("n")).write.option("ignoreNullFields", "false").json(path)
    return seen.get["n"]


def write_metrics(df: DataFrame, path: str) -> None:
    """Metrics as JSON, a document a file, nulls kept."""
    df.write.option("ignoreNullFields", "false").option("maxRecordsPerFile", 1).json(path)


def fan_out(df: DataFrame, path: str, *keys: str) -> None:
    """JSON lines by folders of keys; rows of a folder are gathered before the write, so files stay few."""
    df.repartition(*keys).write.partitionBy(*keys).json(path)


def write_kept(lines: DataFrame, kept: DataFrame, key: str, path: str) -> None:
    """The lines (value, key) whose key is kept, byte for byte."""
    lines.join(kept.select(key).distinct(), key, "left_semi").select("value").write.text(path)


def missing(df: DataFrame, written: DataFrame, key: str) -> DataFrame:
    """The rows that are not there yet."""
    return df.join(written.select(key).distinct(), key, "left_anti")


def rewrite(df: DataFrame, path: str) -> str:
    """A new version beside the old one, which may be what df reads; the new path."""
    new = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    df.write.parquet(new)
    return new


def swap(spark: SparkSession, new: str, path: str) -> None:
    """new in the place of path: the old version is renamed away first and deleted last, so one whole version is always there."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    old, target, source = hadoop(f"{path.rstrip('/')}-old-{uuid.uuid4().hex}"), hadoop(path), hadoop(new)
    fs = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if fs.exists(target) and not fs.rename(target, old):
        raise OSError(f"{path} could not be renamed")
    if not fs.rename(source, target):
        fs.rename(old, target)
        raise OSError(f"{new} could not be renamed")
    fs.delete(old, True)


def append_text(lines: DataFrame, path: str) -> None:
    lines.select("value").write.mode("append").text(path)


def block_text(*parts: Column) -> Column:
    """One validation block: a rule, parts between bars, and a rule."""
    return F.concat(F.lit(RULE + "\n"), F.concat_ws(f"\n{BAR}\n", *parts), F.lit("\n" + RULE))


def clone_element(similarity: Column, *files: Column) -> Column:
    """One clone of a clone report, its files' names escaped."""
    sources = [F.concat(F.lit('<source file="'), F.replace(text.xml_escape(f), F.lit('"'), F.lit("&quot;")), F.lit('" startline="1" endline="1"></source>')) for f in files]
    return F.concat(F.lit('<clone similarity="'), similarity.cast("string"), F.lit('">'), *sources, F.lit("</clone>"))


def write_clones(clones: DataFrame, path: str) -> None:
    """A clone report of (similarity, files), names escaped by the writer; an empty report is an error."""
    if clones.isEmpty():
        raise ValueError("a clone report needs a clone")
    source = F.transform("files", lambda f: F.struct(F.lit("").alias("_VALUE"), f.alias("_file"), F.lit(1).alias("_startline"), F.lit(1).alias("_endline")))
    clones.select(F.col("similarity").alias("_similarity"), source.alias("source")).write.format("xml").option("rootTag", "clones").option("rowTag", "clone").save(path)


def small_document(df: DataFrame, indent: int = 2, most: int = 10_000) -> str:
    """A small aggregate as a JSON document; more than `most` rows are an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"an aggregate of over {most} rows is no small document")
    return json.dumps([r.asDict(recursive=True) for r in rows], indent=indent, ensure_ascii=False)
