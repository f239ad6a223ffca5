"""Joins on the review key in place of alignment by row position, and unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_topics_back(reviews: DataFrame, topics: DataFrame, row_id: str = "review_id") -> DataFrame:
    """Topic columns of a sample on the full table; other rows get nulls."""
    return reviews.join(topics.select(row_id, "dominant_topic", "topic_label"), row_id, "left")


def attach_rating(predictions: DataFrame, reviews: DataFrame, row_id: str = "review_id") -> DataFrame:
    return predictions.join(reviews.select(row_id, "rating"), row_id)


def flag_membership(
    df: DataFrame, members: DataFrame, inside: str, outside: str, output: str, row_id: str = "review_id"
) -> DataFrame:
    """One of two values, by whether the row's key is among the members."""
    marks = members.select(row_id).distinct().withColumn("_member", F.lit(True))
    flag = F.when(F.col("_member"), inside).otherwise(outside)
    return df.join(marks, row_id, "left").withColumn(output, flag).drop("_member")


def union_batches(batches: list[DataFrame]) -> DataFrame:
    """Stack batches by column name."""
    return reduce(lambda a, b: a.unionByName(b), batches)
