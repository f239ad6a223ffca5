"""Review tables derived from the given tables.

One SQL text per view serves Spark and the checks, so both start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.session import spread

# Raw review records. The rating follows the language of the text, with one in seventeen turned
# round; some titles are null and some texts carry markup, contractions and links.
REVIEWS_SQL = """
SELECT doc_id AS review_id,
  CAST(CASE WHEN doc_id % 17 = 0 THEN 6 - r ELSE r END AS DOUBLE) AS rating,
  CASE WHEN doc_id % 11 = 0 THEN NULL ELSE substr(text, 1, 24) END AS title,
  CASE WHEN doc_id % 5 = 0 THEN concat(text, ' I can''t say it''s bad &amp; won''t return: https://ex.com/a?b=1 <br />Bob''s')
       ELSE text END AS text,
  concat('P', CAST(doc_id % 200 AS STRING)) AS asin,
  CAST(doc_id % 150 AS STRING) AS user_id,
  1514764800000 + (doc_id * 7919 % 2190) * 86400000 + (doc_id % 24) * 3600000 AS ts_ms,
  CASE WHEN doc_id % 3 = 0 THEN (doc_id * 31) % 7 ELSE 0 END AS helpful_vote,
  doc_id % 10 <> 0 AS verified_purchase
FROM (SELECT *, CASE lang WHEN 'en' THEN 4 + doc_id % 2 WHEN 'fr' THEN 3 ELSE 1 + doc_id % 2 END AS r
      FROM {documents}) d
"""

# Scored reviews: a predicted label, a confidence and a topic for every review.
SCORED_SQL = """
SELECT review_id, rating, title, text, ts_ms, helpful_vote, verified_purchase,
  CASE WHEN rating <= 2 THEN 'negative' WHEN rating = 3 THEN 'neutral' ELSE 'positive' END AS true_label,
  CASE (review_id * 7919 + 13) % 10 WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' WHEN 2 THEN 'positive'
       ELSE CASE WHEN rating <= 2 THEN 'negative' WHEN rating = 3 THEN 'neutral' ELSE 'positive' END
  END AS predicted_label,
  CASE (review_id * 104729 + 7) % 8 WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' WHEN 2 THEN 'positive'
       ELSE CASE WHEN rating <= 2 THEN 'negative' WHEN rating = 3 THEN 'neutral' ELSE 'positive' END
  END AS other_label,
  CAST(50 + (review_id * 31) % 51 AS DOUBLE) / 100 AS confidence,
  CASE WHEN review_id % 9 = 0 THEN NULL ELSE CAST((review_id * 5) % 14 AS INT) END AS dominant_topic
FROM {reviews} r
"""

# Many narrow facts for aggregates; review_id repeats here.
REVIEW_FACTS_SQL = """
SELECT l_orderkey * 8 + l_linenumber AS review_id,
  CAST(CASE WHEN h < 62 THEN 5 WHEN h < 82 THEN 4 WHEN h < 89 THEN 3 WHEN h < 94 THEN 2 ELSE 1 END AS DOUBLE) AS rating,
  p.p_type AS topic_label, l_shipdate AS ts, CAST(l_quantity AS INT) % 5 AS helpful_vote,
  l_returnflag <> 'N' AS verified_purchase,
  CASE WHEN h2 < 80 THEN 'positive' WHEN h2 < 90 THEN 'neutral' ELSE 'negative' END AS predicted_label,
  0.5 + 5 * l_discount AS confidence,
  CASE WHEN h < 82 THEN 'positive' WHEN h < 89 THEN 'neutral' ELSE 'negative' END AS sentiment_label
FROM (SELECT *, (l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31) % 100 AS h,
             (l_orderkey * 31 + l_linenumber * 7 + l_suppkey) % 100 AS h2 FROM {lineitem}) l
JOIN {part} p ON l.l_partkey = p.p_partkey
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reviews(spark: SparkSession, sf_dir: str, heavy: bool = False) -> DataFrame:
    """Raw reviews with ``ts_ms``; ``heavy`` for work that needs all cores."""
    documents = table(spark, sf_dir, "documents")
    return spark.sql(REVIEWS_SQL, documents=spread(documents, "doc_id") if heavy else documents)


def timed_reviews(spark: SparkSession, sf_dir: str, heavy: bool = False) -> DataFrame:
    """Raw reviews in the core column order, with the time as a timestamp."""
    raw = reviews(spark, sf_dir, heavy)
    return raw.select(
        "review_id",
        "rating",
        "title",
        "text",
        "asin",
        "user_id",
        F.timestamp_millis("ts_ms").alias("timestamp"),
        "helpful_vote",
        "verified_purchase",
    )


def scored_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = spark.sql(SCORED_SQL, reviews=reviews(spark, sf_dir))
    return scored.withColumn("timestamp", F.timestamp_millis("ts_ms")).drop("ts_ms")


def review_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(
        REVIEW_FACTS_SQL, lineitem=table(spark, sf_dir, "lineitem"), part=table(spark, sf_dir, "part")
    )


def review_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with ten planted groups, and one row in five as noise."""
    planted = F.transform(
        "embedding",
        lambda x, i: F.when(F.col("vec_id") % 5 == 0, x.cast("double")).otherwise(
            x.cast("double") * 0.1 + F.when(i == F.col("label"), 1.0).otherwise(0.0)
        ),
    )
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("review_id"), "label", planted.alias("vec"))
