"""Sorting, limits and pagination."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motorcade.checkpoints import ensure


def keyset_page(df: DataFrame, time: str, key: str, size: int, after: tuple | None = None) -> DataFrame:
    """The page behind (time, key), newest first. The plain test on time lets files be pruned; the pair decides."""
    if after is not None:
        t, k = F.lit(after[0]), F.lit(after[1])
        df = df.where(F.col(time) <= t).where((F.col(time) < t) | (F.col(key) < k))
    return df.orderBy(F.col(time).desc(), F.col(key).desc()).limit(size)


def offset_page(df: DataFrame, order: list, size: int, skip: int) -> DataFrame:
    return df.orderBy(*order).offset(skip).limit(size)


def top_per_group(df: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def leaderboard(df: DataFrame, score: str, key: str, ascending: bool = False) -> DataFrame:
    """Dense ranks by score, without one task that sees all rows: distinct scores are dealt by range, ranked within each
    part, and moved by the number of scores in the parts before, of which there are as many as shuffle partitions."""
    ensure(df.sparkSession)
    order = F.col(score).asc() if ascending else F.col(score).desc()
    parts = df.select(score).distinct().repartitionByRange(order).withColumn("_part", F.spark_partition_id()).checkpoint()
    before = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = before.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    ranks = parts.withColumn("_place", place).join(before, "_part").select(score, (F.col("_place") + F.col("_before")).alias("rank"))
    return df.join(ranks, score)
