"""Queries that run a stream over the given tables to its end and read what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillsift.functions.columns import full_text, sentiment_label
from quillsift.operators.classify import batch_model_scoring
from quillsift.plans.catalog.models import keyword_model
from quillsift.plans.registry import query
from quillsift.session import scratch_path
from quillsift.sources.tables import reviews
from quillsift.streaming import streams as S


BATCHES = 4


def _arrivals(spark, sf_dir):
    """The reviews as JSON files, read as a stream of ``BATCHES`` batches, whose files grow in number with the table."""
    path = scratch_path(spark, "arrivals")
    raw = reviews(spark, sf_dir).withColumnRenamed("ts_ms", "timestamp")
    files = max(1, -(-raw.rdd.getNumPartitions() // BATCHES))
    raw.repartition(BATCHES * files, "review_id").write.json(path)
    return S.stream_reviews(spark, path, files_per_batch=files)


@query(
    "stream_reservoir",
    """SELECT review_id, rating FROM reviews
    ORDER BY CAST('0x' || substr(md5('42:' || CAST(review_id AS VARCHAR)), 1, 15) AS BIGINT), review_id LIMIT 200""",
)
def _(spark, sf_dir):
    path = scratch_path(spark, "reservoir")
    run = S.stream_reservoir(_arrivals(spark, sf_dir), path, 200)
    run.awaitTermination()
    return S.latest_sample(spark, path, S.last_batch(run)).select("review_id", "rating")


@query(
    "stream_score",
    """SELECT review_id, CASE WHEN a >= b AND a >= c THEN 'negative' WHEN b >= c THEN 'neutral' ELSE 'positive' END AS predicted_label
    FROM (SELECT review_id, 1 + (length(t) - length(replace(t, 'e', ''))) % 7 AS a, 1 + (length(t) - length(replace(t, ' ', ''))) % 5 AS b,
      1 + length(t) % 11 AS c FROM (SELECT review_id,
        full_text AS t FROM joined))""",
)
def _(spark, sf_dir):
    def score(df):
        ready = df.withColumn("full_text", full_text())
        return batch_model_scoring(ready, keyword_model).select("review_id", "predicted_label", "confidence")

    path = scratch_path(spark, "scored")
    S.stream_score(_arrivals(spark, sf_dir), score, path).awaitTermination()
    return spark.read.parquet(f"{path}/scored").select("review_id", "predicted_label")


@query("stream_monthly_trend", "SELECT CAST(date_trunc('month', timestamp) AS TIMESTAMP) AS date, sentiment_label, count(*) AS count FROM labelled GROUP BY 1, 2")
def _(spark, sf_dir):
    timed = _arrivals(spark, sf_dir).withColumns(
        {"timestamp": F.timestamp_millis("timestamp"), "sentiment_label": sentiment_label()}
    )
    path = scratch_path(spark, "trend")
    run = S.stream_monthly_trend(timed, path)
    run.awaitTermination()
    return S.latest_trend(spark, path, S.last_batch(run))
