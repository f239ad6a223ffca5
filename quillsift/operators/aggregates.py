"""Counts, shares, cross-tabs and trends.

All are grouped aggregates, so Spark sums within each task first and only one row per group and
task is shuffled. Values are not rounded; rounding is a matter of display.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillsift.functions.columns import LABELS
from quillsift.operators.quality import percentiles_of_counts, value_counts


def _percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part * 100.0, whole)


def counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per non-null value."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("count"))


def shares(df: DataFrame, column: str) -> DataFrame:
    """Percent of rows per value; the window runs over one row per value."""
    counted = counts(df, column)
    total = F.sum("count").over(Window.partitionBy(F.lit(1)))
    return counted.select(column, "count", _percent(F.col("count"), total).alias("share"))


def counts_fixed_order(df: DataFrame, column: str = "sentiment_label", order: list[str] = LABELS) -> DataFrame:
    """One row per listed value in the listed order; the count of an absent value stays null."""
    found = df.agg(*[F.nullif(F.count_if(F.col(column) == v), F.lit(0)).alias(v) for v in order])
    position = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(column)).cast("int")
    return found.unpivot([], order, column, "count").select(position.alias("position"), column, "count")


def overview_kpis(df: DataFrame) -> DataFrame:
    """Rows, mean rating, percent positive and percent verified in one pass."""
    positive = (F.col("sentiment_label") == "positive").cast("int")
    return df.agg(
        F.count("*").alias("reviews"),
        F.avg("rating").alias("avg_rating"),
        _percent(F.sum(F.coalesce(positive, F.lit(0))), F.count("*")).alias("pct_positive"),
        (F.avg(F.col("verified_purchase").cast("int")) * 100).alias("pct_verified"),
    )


def mean_by(df: DataFrame, group: str, value: str, output: str) -> DataFrame:
    """Mean of a value per group, largest first."""
    means = df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.avg(value).alias(output))
    return means.orderBy(F.desc(output), group)


def helpful_by_sentiment(df: DataFrame) -> DataFrame:
    return mean_by(df, "sentiment_label", "helpful_vote", "avg_helpful")


def helpful_by_topic(df: DataFrame) -> DataFrame:
    return mean_by(df, "topic_label", "helpful_vote", "avg_helpful")


def row_shares(df: DataFrame, rows: str, column: str, values: list, names: list[str] | None = None) -> DataFrame:
    """Cross-tab in percent of each row's total; listed values that are absent give 0.

    The values are given, so Spark needs no extra pass to find them.
    """
    names = names or [str(v) for v in values]
    known = df.filter(F.col(rows).isNotNull() & F.col(column).isNotNull())
    cells = [F.count_if(F.col(column) == F.lit(v)).alias(n) for v, n in zip(values, names)]
    table = known.groupBy(rows).agg(F.count("*").alias("_total"), *cells)
    return table.select(rows, *[_percent(F.col(n), F.col("_total")).alias(n) for n in names])


def verified_x_sentiment(df: DataFrame) -> DataFrame:
    return row_shares(df, "verified_purchase", "sentiment_label", LABELS)


def topic_x_sentiment(df: DataFrame) -> DataFrame:
    """Sentiment mix of every topic, most negative topic first."""
    return row_shares(df, "topic_label", "sentiment_label", LABELS).orderBy(F.desc("negative"), "topic_label")


def negative_topics(df: DataFrame) -> DataFrame:
    """Topics by percent of negative reviews: the pain points."""
    negative = F.coalesce((F.col("sentiment_label") == "negative").cast("int"), F.lit(0))
    known = df.filter(F.col("topic_label").isNotNull())
    return (
        known.groupBy("topic_label")
        .agg((F.avg(negative) * 100).alias("pct_negative"))
        .orderBy(F.desc("pct_negative"), "topic_label")
    )


def verified_by_topic(df: DataFrame) -> DataFrame:
    """Percent of verified and other purchases per topic."""
    table = row_shares(df, "topic_label", "verified_purchase", [False, True], ["not_verified", "verified"])
    return table.orderBy(F.desc("verified"), "topic_label")


def topic_frequency(df: DataFrame, n: int | None = None) -> DataFrame:
    """Reviews per topic, largest first; with ``n`` only the first ones."""
    ranked = counts(df, "topic_label").orderBy(F.desc("count"), "topic_label")
    return ranked.limit(n) if n else ranked


def monthly_volume(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Rows per month; rows without a time are left out."""
    return df.where(F.col(ts).isNotNull()).groupBy(F.date_trunc("month", ts).alias("date")).agg(F.count("*").alias("count"))


def monthly_sentiment(df: DataFrame, month: str = "year_month") -> DataFrame:
    return row_shares(df, month, "sentiment_label", LABELS)


def monthly_sentiment_long(df: DataFrame, month: str = "date") -> DataFrame:
    """Same as rows of month, sentiment and share."""
    return monthly_sentiment(df, month).unpivot(month, LABELS, "sentiment", "share")


def topic_trend_in_group(df: DataFrame, topics: list[str], month: str = "year_month") -> DataFrame:
    """Share of each topic per month among the reviews of the listed topics only."""
    return row_shares(df.filter(F.col("topic_label").isin(*topics)), month, "topic_label", topics)


def length_boxstats(df: DataFrame, value: str = "clean_text_length", group: str = "sentiment_label") -> DataFrame:
    """Quartiles and whiskers (farthest values within 1.5 quartile ranges) per group."""
    known = df.filter(F.col(group).isNotNull())
    counted = value_counts(known, F.col(value), [group])
    box = percentiles_of_counts(counted, [0.25, 0.5, 0.75], ["q1", "median", "q3"], [group])
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = F.col("value").between(F.col("q1") - reach, F.col("q3") + reach)
    within = counted.join(box, group).filter(inside)
    return within.groupBy(group, "q1", "median", "q3").agg(
        F.min("value").alias("whisker_low"), F.max("value").alias("whisker_high")
    )


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)


def date_bounds(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    return df.agg(F.to_date(F.min(ts)).alias("first_date"), F.to_date(F.max(ts)).alias("last_date"))


def label_distribution(df: DataFrame, column: str = "sentiment_label") -> DataFrame:
    """Class shares as fractions rounded half to even at three places."""
    counted = counts(df, column)
    total = F.sum("count").over(Window.partitionBy(F.lit(1)))
    return counted.select(column, F.bround(F.try_divide(F.col("count"), total), 3).alias("share"))
