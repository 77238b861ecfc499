"""Registered queries, each beside the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions import text
from pairloom.sources import sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of a folder by name, read lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def submissions(self, with_text: bool = False) -> DataFrame:
        """documents as submissions: source is the problem, quality the status; lines are measured."""
        docs = self.documents
        subs = docs.select(
            F.col("doc_id").alias("submission_id"), F.col("source").alias("problem_id"), "lang", F.col("n_chars").alias("code_size"),
            text.line_count(F.col("text")).alias("n_lines"), text.widest(F.col("text")).alias("max_chars"), *(["text"] if with_text else []),
        )
        status = F.when(F.col("quality") == 1, "Accepted").when(F.col("quality") == 0, "Wrong Answer")
        return subs.join(self.labels.select(F.col("doc_id").alias("submission_id"), status.alias("status")), "submission_id", "left")

    def gated(self) -> DataFrame:
        """Submissions within the limits on lines; the limit on width is off, as prose has long lines."""
        return self.submissions().where(text.length_gate(F.col("n_lines"), widest_line=None))

    def measured(self) -> DataFrame:
        """gated() as a table of six narrow columns, for plans that read it more than once: texts are measured once."""
        path = sinks.scratch(self.spark, "measured")
        self.gated().where("status is not null").select("lang", "problem_id", "submission_id", "n_lines", "max_chars", "status").write.parquet(path)
        return self.spark.read.parquet(path)


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of Tables as a query, with its SQL."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return add


LINES = "CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN right(text, 1) = chr(10) THEN 0 ELSE 1 END END"
WIDEST = "coalesce(list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))), 0)"
SUBS = f"""subs AS (SELECT d.doc_id AS submission_id, d.source AS problem_id, d.lang, d.n_chars AS code_size, {LINES} AS n_lines, {WIDEST} AS max_chars, d.text,
CASE l.quality WHEN 1 THEN 'Accepted' WHEN 0 THEN 'Wrong Answer' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)),
gated AS (SELECT * FROM subs WHERE n_lines BETWEEN 4 AND 74)"""


def rank_sql(seed: str, *keys: str) -> str:
    return f"md5(concat_ws(':', '{seed}', {', '.join(keys)}))"


def normal_sql(column: str, comments: bool = True) -> str:
    c = column
    if comments:
        for pattern, flags in ((r"#[^\n]*", "g"), (r"//[^\n]*", "g"), (r"/\*.*?\*/", "gs")):
            c = f"regexp_replace({c}, '{pattern}', '', '{flags}')"
    return rf"lower(trim(regexp_replace({c}, '[ \t\n\r\f\v]+', ' ', 'g'), ' '))"


def column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def shingles_sql(s: str) -> str:
    """The distinct substrings of five characters of a list of characters."""
    return f"list_distinct(list_transform(range(1, greatest(len({s}) - 3, 1)), lambda i: {s}[i] || {s}[i+1] || {s}[i+2] || {s}[i+3] || {s}[i+4]))"


def signature_sql(rows: str, key: str, n: int) -> str:
    """CTEs g (key, list of shingles), sig (key, i, v) and bands (key, band, band_key) over rows (key, s)."""
    return f"""g AS (SELECT {key}, {shingles_sql("c")} AS g FROM (SELECT {key}, string_split(s, '') AS c FROM {rows})),
h AS (SELECT {key}, ('0x' || substr(md5(u), 1, 8))::BIGINT % 2147483647 AS h FROM (SELECT {key}, unnest(g) AS u FROM g)),
p AS (SELECT range AS i, ('0x' || substr(md5('a:' || range), 1, 8))::BIGINT % 2147483646 + 1 AS a, ('0x' || substr(md5('b:' || range), 1, 8))::BIGINT % 2147483647 AS b FROM range({n})),
m AS (SELECT {key}, i, min((h * a + b) % 2147483647) AS v FROM h, p GROUP BY ALL),
sig AS (SELECT d.{key}, d.i, coalesce(v, 2147483647) AS v FROM (SELECT {key}, range AS i FROM {rows}, range({n})) d LEFT JOIN m ON m.{key} = d.{key} AND m.i = d.i),
bands AS (SELECT {key}, i // 8 AS band, md5(string_agg(v::VARCHAR, ',' ORDER BY i)) AS band_key FROM sig GROUP BY ALL)"""
