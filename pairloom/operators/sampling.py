"""Seeded ranks, top-k, stratified samples and splits.

Order by md5 of seed and key stands for a seeded shuffle: it is the same on every run and every engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded(seed: object, *key: str | Column) -> Column:
    """A reproducible random order of keys."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in key]))


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark prunes groups before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k).drop("rank")


def sample_per_group(df: DataFrame, keys: list[str], key: str, k: int, seed: object) -> DataFrame:
    return top_k(df, keys, [seeded(seed, key), F.col(key)], k)


def sample_first(df: DataFrame, n: int, *key: str, seed: object) -> DataFrame:
    """n rows at random; a distributed top-n, not a sort of all rows."""
    return df.orderBy(seeded(seed, *key), *key).limit(n)


def stratified(df: DataFrame, stratum: str, strata: int, n: int, *key: str, seed: object) -> DataFrame:
    """n rows, as evenly from the strata as they allow; shortfalls are filled from the others' rest.

    Each stratum gives max(1, n div strata); only n rows a stratum and n of the rest are ever ranked globally.
    """
    quota = max(1, n // strata)
    order = [seeded(seed, *key), *(F.col(k) for k in key)]
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(stratum).orderBy(*order))).where(F.col("rank") <= n + quota)
    rest = (F.col("rank") > quota).cast("int")
    return ranked.orderBy(rest, *order).limit(n).drop("rank")


def _ranked(parts: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Rows with their rank from 0 in their group, given parts that follow each other in the order.

    Rows are counted per part and ranked within it; the offsets are one small row per part.
    """
    counts = parts.groupBy(*group, "part").agg(F.count("*").alias("size"))  # at most 65,536 rows a group
    before = F.sum("size").over(Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*group, "part", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy(*group, "part").orderBy(*order)) - 1
    return parts.withColumn("within", within).join(offsets, [*group, "part"]).withColumn("rank", F.col("before") + F.col("within")).drop("part", "within", "before")


def ranks(df: DataFrame, order: Column, *ties: str, group: list[str] | None = None) -> DataFrame:
    """Rows with their rank from 0 over all rows, or over a group's, without gathering them in one task.

    order is a digest in hexadecimal: its first four digits deal the rows.
    """
    parts = df.withColumn("order", order).withColumn("part", F.conv(F.substring("order", 1, 4), 16, 10).cast("int"))
    return _ranked(parts, group or [], ["order", *ties]).drop("order")


def with_parts(df: DataFrame, key: str) -> DataFrame:
    """df with parts by equal ranges of a whole number, 65,536 at most."""
    ends = F.broadcast(df.agg(F.min(key).cast("decimal(38,0)").alias("least"), F.max(key).cast("decimal(38,0)").alias("most")))  # one row
    part = ((F.col(key).cast("decimal(38,0)") - F.col("least")) * 65536 / (F.col("most") - F.col("least") + 1)).cast("int")
    return df.join(ends).withColumn("part", part).drop("least", "most")


def ranks_by_id(df: DataFrame, key: str, group: list[str] | None = None) -> DataFrame:
    """Rows with their rank from 0 in the order of a whole number, over all rows or a group's; no task gathers them."""
    return _ranked(with_parts(df, key), group or [], [key])


def pool_split(ids: DataFrame, key: str, test: float = 0.10, val: float = 0.05, seed: object = 42) -> DataFrame:
    """(key, pool): int(test n) ids for test, int(val n) for val, the others for train."""
    n = ids.agg(F.count("*").alias("n"))
    ranked = ranks(ids.select(key), seeded(seed, key), key).withColumn("rank", F.col("rank") + 1)
    cut = lambda share: F.floor(F.col("n") * F.lit(share))
    pool = F.when(F.col("rank") <= cut(test), "test").when(F.col("rank") <= cut(test) + cut(val), "val").otherwise("train")
    return ranked.join(F.broadcast(n)).select(key, pool.alias("pool"))  # n is one row


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str = "number") -> DataFrame:
    """Rows of each group numbered from 0."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_k(df, keys, order, 1)


def balanced_refill(kept: DataFrame, spare: DataFrame, label: str, key: str, per_label: int, seed: object) -> DataFrame:
    """kept, at most per_label rows of each label, filled up from spare rows of the label."""
    held = top_k(kept, [label], [F.col(key)], per_label)
    have = held.groupBy(label).count()
    ranked = spare.withColumn("rank", F.row_number().over(Window.partitionBy(label).orderBy(seeded(seed, key), key))).where(F.col("rank") <= per_label)
    fill = ranked.join(have, label, "left").where(F.col("rank") <= per_label - F.coalesce("count", F.lit(0))).drop("rank", "count")
    return held.unionByName(fill)
