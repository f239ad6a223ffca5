"""Explicit schemas of the tables that enter and leave the jobs."""

from pyspark.sql import types as T

# Column names, order and types of a raw review record.
CORE_COLUMNS = [
    "rating",
    "title",
    "text",
    "asin",
    "user_id",
    "timestamp",
    "helpful_vote",
    "verified_purchase",
]

RAW_REVIEW = T.StructType(
    [
        T.StructField("review_id", T.LongType()),
        T.StructField("rating", T.DoubleType()),
        T.StructField("title", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("asin", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("helpful_vote", T.LongType()),
        T.StructField("verified_purchase", T.BooleanType()),
    ]
)

# The columns of the enriched table, in order, after the review_id key.
ENRICHED_COLUMNS = [
    "rating",
    "title",
    "text",
    "timestamp",
    "year_month",
    "helpful_vote",
    "verified_purchase",
    "sentiment_label",
    "predicted_label",
    "confidence",
    "dominant_topic",
    "topic_label",
]

TOPIC_INFO = T.StructType(
    [
        T.StructField("Topic", T.LongType()),
        T.StructField("Count", T.LongType()),
        T.StructField("Name", T.StringType()),
    ]
)
