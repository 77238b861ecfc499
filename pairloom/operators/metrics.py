"""Scores of predictions, with both denominators, and reports over groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def binary_metrics(df: DataFrame, label: str, pred: str, *groups: str) -> DataFrame:
    """Counts, response rate and precision, recall, F1, accuracy over parseable rows; *_all over all rows.

    A null prediction is unparseable; over all rows it counts as wrong. Divisions by zero give 0.
    """
    said, gold = F.col(pred), F.col(label)
    hit = lambda g, p: F.count_if((gold == g) & (said == p))
    counted = df.groupBy(*groups).agg(F.count("*").alias("n_total"), F.count(said).alias("n_parseable"), hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(0, 0).alias("tn"), F.count_if(gold == 1).alias("gold"))
    c = F.col
    precision, recall = _ratio(c("tp"), c("tp") + c("fp")), _ratio(c("tp"), c("tp") + c("fn"))
    recall_all = _ratio(c("tp"), c("gold"))
    f1 = lambda p, r: _ratio(2 * p * r, p + r)
    return counted.select(
        *groups, "n_total", "n_parseable", _ratio(c("n_parseable"), c("n_total")).alias("response_rate"), precision.alias("precision"), recall.alias("recall"), f1(precision, recall).alias("f1"),
        _ratio(c("tp") + c("tn"), c("n_parseable")).alias("accuracy"), recall_all.alias("recall_all"), f1(precision, recall_all).alias("f1_all"), _ratio(c("tp") + c("tn"), c("n_total")).alias("accuracy_all"),
    )


def macro(metrics: DataFrame, column: str = "f1", digits: int = 3) -> DataFrame:
    return metrics.agg(F.round(F.avg(column), digits).alias(f"macro_{column}"))


def outcomes(preds: DataFrame, gold: str, *columns: str) -> DataFrame:
    """How often each combination of the gold label and the predictions occurs."""
    return preds.groupBy(gold, *columns).agg(F.count("*").alias("n"))


def rescue_rate(preds: DataFrame, gold: str, weak: str, strong: str) -> DataFrame:
    """Of what the weak predictions miss, how much the strong ones get right."""
    missed = preds.where(~F.col(weak).eqNullSafe(F.col(gold)))
    return missed.agg(F.count("*").alias("missed"), F.count_if(F.col(strong) == F.col(gold)).alias("rescued")).withColumn("rate", _ratio(F.col("rescued"), F.col("missed")))


def summary(df: DataFrame, column: str, *groups: str) -> DataFrame:
    """n, min, quartiles and tails by exact linear interpolation, mean, max; one decimal."""
    p = lambda q: F.round(F.percentile(column, F.lit(q)), 1)
    return df.groupBy(*groups).agg(F.count(column).alias("n"), F.min(column).alias("min"), p(0.25).alias("p25"), p(0.5).alias("median"), F.round(F.avg(column), 1).alias("mean"), p(0.75).alias("p75"), p(0.9).alias("p90"), p(0.95).alias("p95"), F.max(column).alias("max"))


def shares(df: DataFrame, group: list[str], within: list[str]) -> DataFrame:
    """Counts by group, and each one's share of its within group, over the counted rows only."""
    counted = df.groupBy(*group).agg(F.count("*").alias("n"))
    whole = counted.groupBy(*within).agg(F.sum("n").alias("whole")) if within else counted.agg(F.sum("n").alias("whole"))
    joined = counted.join(whole, within) if within else counted.join(F.broadcast(whole))
    return joined.select(*group, "n", F.round(100 * F.col("n") / F.col("whole"), 2).alias("percent"))
