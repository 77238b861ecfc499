"""Queries on readers and writers: each writes a table in the reference's layout, reads it back, and is held against SQL over the table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators import metrics
from pairloom.plans.registry import Tables, query
from pairloom.plans.reporting import METRICS, _scored
from pairloom.sources import readers, sinks

C = F.col


def _tree(t: Tables) -> str:
    """Texts as files under data/{problem}/{lang}/, of a thousand rows at most."""
    path = sinks.scratch(t.spark, "tree")
    t.documents.select("text", C("source").alias("problem"), "lang").write.partitionBy("problem", "lang").option("maxRecordsPerFile", 1000).text(path)
    return path


@query("s2_source_files", "SELECT 'problem=' || source AS problem_id, 'lang=' || lang AS lang, sum(length(text) + 1)::BIGINT AS chars FROM documents GROUP BY ALL")
def s2(t: Tables) -> DataFrame:
    return readers.read_sources(t.spark, _tree(t), "*.txt").groupBy("problem_id", "lang").agg(F.sum(F.length("text")).alias("chars"))


@query("s3_enumeration", "SELECT 'problem=' || source AS folder1, 'lang=' || lang AS folder2, sum(strlen(text) + 1)::BIGINT AS bytes, true AS some FROM documents GROUP BY ALL")
def s3(t: Tables) -> DataFrame:
    return readers.folder_counts(readers.list_files(t.spark, _tree(t), "*.txt")).select("folder1", "folder2", "bytes", (C("files") > 0).alias("some"))


@query("s5_jsonl_strict", "SELECT doc_id, lang, n_chars FROM documents")
def s5(t: Tables) -> DataFrame:
    path = sinks.scratch(t.spark, "strict")
    sinks.write_jsonl(t.documents.select("doc_id", "lang", "n_chars"), path)
    return readers.read_jsonl(t.spark, path, "doc_id long, lang string, n_chars long", strict=True)


@query("s6_split_map", "SELECT CASE source WHEN 'src0' THEN 'train_a' WHEN 'src1' THEN 'val' WHEN 'src2' THEN 'test_sd' END AS split, lang AS lang_pair, count(*) AS n FROM documents WHERE source IN ('src0', 'src1', 'src2') GROUP BY ALL")
def s6(t: Tables) -> DataFrame:
    path = sinks.scratch(t.spark, "splits")
    langs = ("de", "en", "es", "fr")
    docs = t.documents.select("doc_id", "lang", "source")
    for lang in langs:
        for source, name in (("src0", "train_a"), ("src1", "val"), ("src2", "test_sd"), ("src3", "unknown")):
            docs.where((C("lang") == lang) & (C("source") == source)).select("doc_id").write.json(f"{path}/{lang}/{name}.jsonl")
    return readers.read_split_files(t.spark, path, "doc_id long").groupBy("split", "lang_pair").agg(F.count("*").alias("n"))


@query("s8_aligned", "WITH e AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS line_no, doc_id::VARCHAR AS l FROM documents WHERE lang = 'en'), f AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS line_no, doc_id::VARCHAR AS r FROM documents WHERE lang = 'fr') SELECT line_no, l AS \"left\", r AS \"right\" FROM e JOIN f USING (line_no)")
def s8(t: Tables) -> DataFrame:
    paths = {}
    for lang in ("en", "fr"):
        paths[lang] = sinks.scratch(t.spark, f"lines-{lang}")
        t.documents.where(C("lang") == lang).select("doc_id").orderBy("doc_id").select(C("doc_id").cast("string").alias("value")).write.text(paths[lang])
    return readers.read_aligned(t.spark, paths["en"], paths["fr"])


@query("s9_k11_clones", "SELECT n_chars % 101 AS similarity, 'a&b/<' || source || '\"' AS \"first\", lang || '.py' AS second, count(*) AS n FROM documents GROUP BY ALL")
def s9(t: Tables) -> DataFrame:
    path = sinks.scratch(t.spark, "clones")
    files = F.array(F.concat(F.lit("a&b/<"), "source", F.lit('"')), F.concat("lang", F.lit(".py")))
    sinks.write_clones(t.documents.select((C("n_chars") % 101).cast("int").alias("similarity"), files.alias("files")), path)
    return readers.read_clones(t.spark, path).groupBy("similarity", F.get("files", F.lit(0)).alias("first"), F.get("files", F.lit(1)).alias("second")).agg(F.count("*").alias("n"))


@query("s10_list_file", "SELECT path, count(*) AS n FROM (SELECT CASE WHEN page_id % 5 = 0 THEN '' ELSE url END AS path FROM pages) GROUP BY 1")
def s10(t: Tables) -> DataFrame:
    path = sinks.scratch(t.spark, "list")
    t.pages.select(F.when(C("page_id") % 5 == 0, "").otherwise(C("url")).alias("value")).write.text(path)
    return readers.read_list(t.spark, path).groupBy("path").agg(F.count("*").alias("n"))


@query("s12_k4_summary", "SELECT lang, count(*) AS n, max(n_chars) AS longest FROM documents GROUP BY 1")
def s12(t: Tables) -> DataFrame:
    path = sinks.scratch(t.spark, "summary")
    said = sinks.small_document(t.documents.groupBy("lang").agg(F.count("*").alias("n"), F.max("n_chars").alias("longest")))
    t.spark.createDataFrame([(said,)], "value string").coalesce(1).write.text(path)
    return readers.read_summary(t.spark, path, "lang string, n long, longest long")


@query("s13_k6_metrics", f"WITH {METRICS} SELECT lang AS checkpoint, n_total, f1 FROM r")
def s13(t: Tables) -> DataFrame:
    """Two runs of metrics by checkpoint; the later file wins."""
    path = sinks.scratch(t.spark, "metrics")
    m = metrics.binary_metrics(_scored(t), "label", "pred", "lang").select(C("lang").alias("checkpoint"), "n_total", F.round("f1", 9).alias("f1"))
    sinks.write_metrics(m.withColumn("f1", F.lit(-1.0)), f"{path}/run-1")
    sinks.write_metrics(m, f"{path}/run-2")
    return readers.read_metric_files(t.spark, f"{path}/*", "checkpoint string, n_total long, f1 double")


@query("s15_listing", "SELECT 'lang=' || lang AS folder1, sum(length('{\"doc_id\":' || doc_id || '}') + 1)::BIGINT AS bytes FROM documents GROUP BY 1")
def s15(t: Tables) -> DataFrame:
    path = sinks.scratch(t.spark, "listing")
    t.documents.select("doc_id", "lang").write.partitionBy("lang").json(f"{path}/x")
    t.documents.select("doc_id", "lang").write.partitionBy("lang").csv(f"{path}/y")
    return readers.folder_counts(readers.list_files(t.spark, path, "*.json"), 1).select("folder1", "bytes")


@query("k1_jsonl_count", "SELECT count(*) AS n FROM documents")
def k1(t: Tables) -> DataFrame:
    n = sinks.write_jsonl(t.documents.select("doc_id", "lang"), sinks.scratch(t.spark, "lines"))
    return t.spark.createDataFrame([(n,)], "n long")


@query("k3_kept_lines", "SELECT d.doc_id, md5('{\"doc_id\":' || d.doc_id || ', \"lang\" : \"' || lang || '\"}') AS digest FROM documents d SEMI JOIN (SELECT doc_id FROM labels WHERE quality = 1) USING (doc_id)")
def k3(t: Tables) -> DataFrame:
    """Lines with blanks that no JSON writer would make come through as they were."""
    source, target = sinks.scratch(t.spark, "stored"), sinks.scratch(t.spark, "kept")
    t.documents.select(F.format_string('{"doc_id":%d, "lang" : "%s"}', "doc_id", "lang").alias("value")).write.text(source)
    stored = t.spark.read.text(source).withColumn("doc_id", F.get_json_object("value", "$.doc_id").cast("long"))
    sinks.write_kept(stored, t.labels.where("quality = 1"), "doc_id", target)
    return t.spark.read.text(target).select(F.get_json_object("value", "$.doc_id").cast("long").alias("doc_id"), F.md5("value").alias("digest"))


@query("k7_in_place", "SELECT doc_id, 1 - quality AS quality FROM labels")
def k7(t: Tables) -> DataFrame:
    path = sinks.scratch(t.spark, "rewritten")
    t.labels.select("doc_id", "quality").write.parquet(path)
    new = sinks.rewrite(t.spark.read.parquet(path).withColumn("quality", 1 - C("quality")), path)
    sinks.swap(t.spark, new, path)
    return t.spark.read.parquet(path)


@query("k9_append", "SELECT value, count(*) AS n FROM (SELECT lang AS value FROM documents UNION ALL SELECT source FROM documents) GROUP BY 1")
def k9(t: Tables) -> DataFrame:
    path = sinks.scratch(t.spark, "appended")
    for c in ("lang", "source"):
        sinks.append_text(t.documents.select(C(c).alias("value")), path)
    return t.spark.read.text(path).groupBy("value").agg(F.count("*").alias("n"))


@query("p6_drop_columns", "SELECT doc_id, lang, n_chars FROM documents")
def p6(t: Tables) -> DataFrame:
    return t.documents.drop("text", "source")


@query("k4_pretty_document", "SELECT toxic, count(*) AS n FROM labels GROUP BY 1")
def k4(t: Tables) -> DataFrame:
    rows = json.loads(sinks.small_document(t.labels.groupBy("toxic").agg(F.count("*").alias("n"))))
    return t.spark.createDataFrame([(r["toxic"], r["n"]) for r in rows], "toxic int, n long")
