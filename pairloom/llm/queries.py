"""The queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pairloom.llm import bpe, contamination, flac, importance, pii, simhash, substrings, tokens, toxicity, warc
from pairloom.llm.frames import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence of every document."""
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens of every document, scanned from flat token shards."""
    return tokens.counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, 50256)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of every page."""
    return warc.derivatives(table(spark, sf_dir, "pages"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data of every document: counts, digest and list."""
    return pii.spans(table(spark, sf_dir, "documents")).drop("digest", "found")


def pii_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op5 by kind, which SQL can express: its base rules without the method's spans."""
    return op5_pii(spark, sf_dir).select("doc_id", *(f"n_{k}" for k in pii.BASE))


def op6_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The resampled documents: doc_id, log_weight, rank_key."""
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, start, stop, edits of every benchmark passage in a document."""
    return contamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated 100-byte strings, digested."""
    return substrings.digests(table(spark, sf_dir, "documents"))


def op9_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as FLAC, read back and digested."""
    return flac.digests(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_token_counts": op2_token_counts,
    "op3_warc": op3_warc,
    "op4_simhash": op4_simhash,
    "op5_pii": op5_pii,
    "op6_importance": op6_importance,
    "op7_contamination": op7_contamination,
    "op8_substrings": op8_substrings,
    "op9_flac": op9_flac,
    "op10_bpe": op10_bpe,
    "pii_base_counts": pii_base_counts,
}

DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"
#: Luhn's sum of a string of digits d: every second one from the right counts twice, less nine from ten on.
LUHN = "list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN (length(d) - i) % 2 = 0 THEN d[i]::INT WHEN d[i]::INT > 4 THEN 2 * d[i]::INT - 9 ELSE 2 * d[i]::INT END))"

#: DuckDB SQL where it can express a query; the others are tested against brute force in tests/llm.
ORACLES: dict[str, str] = {
    "pii_base_counts": rf"""WITH t AS (SELECT doc_id, coalesce(text, '') AS s FROM documents)
SELECT doc_id, len(regexp_extract_all(s, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'))::BIGINT AS n_email,
len(list_filter(regexp_extract_all(s, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda x: list_max(list_transform(string_split(x, '.'), lambda p: coalesce(TRY_CAST(p AS BIGINT), 256))) <= 255))::BIGINT AS n_ip,
len(list_filter(list_transform(list_filter(list_transform(regexp_extract_all(s, '[0-9]([ -]?[0-9])+'), lambda x: {DIGITS}), lambda d: length(d) BETWEEN 14 AND 19), lambda d: {LUHN} % 10 = 0), lambda fine: fine))::BIGINT AS n_card,
len(list_filter(regexp_extract_all(s, '\+[0-9][ ().0-9-]+[0-9]'), lambda x: length({DIGITS}) BETWEEN 10 AND 15))::BIGINT AS n_phone FROM t""",
}
