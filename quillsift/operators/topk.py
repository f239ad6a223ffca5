"""Ranked examples. Ties are broken by the review key, so results do not depend on task order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64


def top_per_group(
    df: DataFrame, group: str, order: list[Column | str], n: int, output: str = "rank", row_id: str = "review_id"
) -> DataFrame:
    """The first ``n`` rows of each group by an order that leaves no ties, with their rank.

    Every task passes on at most ``n`` rows per group. With very many tasks that is still much for
    a large group, so its rows first meet in ``SALTS`` parts, of which each passes on ``n`` again.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(row_id), F.lit(SALTS)))
    in_part = Window.partitionBy(group, "_salt").orderBy(*order)
    in_group = Window.partitionBy(group).orderBy(*order)
    kept = salted.withColumn("_nth", F.row_number().over(in_part)).filter(F.col("_nth") <= n).drop("_nth", "_salt")
    return kept.withColumn(output, F.row_number().over(in_group)).filter(F.col(output) <= n)


def most_confident(df: DataFrame, n: int = 10, row_id: str = "review_id") -> DataFrame:
    return df.orderBy(F.desc("confidence"), row_id).limit(n)


def least_confident(df: DataFrame, n: int = 10, row_id: str = "review_id") -> DataFrame:
    return df.orderBy(F.asc("confidence"), row_id).limit(n)


def error_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col("true_label") != F.col("predicted_label"))


def confident_errors(df: DataFrame, n: int = 10, row_id: str = "review_id") -> DataFrame:
    return most_confident(error_rows(df), n, row_id)


def k_smallest(df: DataFrame, key: str, n: int, row_id: str = "review_id") -> DataFrame:
    return df.orderBy(key, row_id).limit(n)
