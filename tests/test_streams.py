"""Streams give what the batch operators give, also when a batch is run again."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillsift.functions.columns import full_text, sentiment_label
from quillsift.operators.classify import batch_model_scoring
from quillsift.operators.sampling import reservoir_sample
from quillsift.plans.catalog.models import keyword_model
from quillsift.session import scratch_path
from quillsift.sources.tables import reviews
from quillsift.streaming import streams as S


@pytest.fixture(scope="module")
def arrivals(spark, sf_dir):
    path = scratch_path(spark, "arrivals")
    raw = reviews(spark, sf_dir).withColumnRenamed("ts_ms", "timestamp")
    raw.repartition(3, "review_id").write.json(path)
    return path


def ids(df):
    return sorted(r["review_id"] for r in df.select("review_id").collect())


def test_reservoir_equals_batch_sample(spark, sf_dir, arrivals):
    path = scratch_path(spark, "reservoir")
    run = S.stream_reservoir(S.stream_reviews(spark, arrivals, 1), path, 60)
    run.awaitTermination()
    assert S.last_batch(run) == 2
    assert ids(S.latest_sample(spark, path, 2)) == ids(reservoir_sample(reviews(spark, sf_dir), 60))


def test_reservoir_goes_on_after_a_restart(spark, sf_dir, arrivals):
    path, inbox = scratch_path(spark, "again"), scratch_path(spark, "inbox")
    rows = spark.read.schema(S.RAW_REVIEW).json(arrivals)
    for part in range(2):
        rows.filter(F.col("review_id") % 2 == part).write.mode("append").json(inbox)
        run = S.stream_reservoir(S.stream_reviews(spark, inbox), path, 60)
        run.awaitTermination()
    assert ids(S.latest_sample(spark, path, S.last_batch(run))) == ids(reservoir_sample(rows, 60))


def test_old_versions_of_the_sample_go(spark, sf_dir, arrivals):
    path = scratch_path(spark, "versions")
    run = S.stream_reservoir(S.stream_reviews(spark, arrivals, 1), path, 60)
    run.awaitTermination()
    versions = lambda: sorted(p.name for p in Path(f"{path}/sample").iterdir())
    assert versions() == ["version=1", "version=2"]
    # The last batch again, as after a lost commit.
    (Path(f"{path}/checkpoint/commits/2")).unlink()
    (Path(f"{path}/checkpoint/commits/.2.crc")).unlink(missing_ok=True)
    again = S.stream_reservoir(S.stream_reviews(spark, arrivals, 1), path, 60)
    again.awaitTermination()
    assert versions() == ["version=1", "version=2"]
    kept = S.only_latest_sample(spark, path, 2)
    assert versions() == ["version=2"]
    assert ids(kept) == ids(reservoir_sample(reviews(spark, sf_dir), 60))


def test_scores_equal_batch_scores(spark, sf_dir, arrivals):
    def score(df):
        scored = batch_model_scoring(df.withColumn("full_text", full_text()), keyword_model)
        return scored.select("review_id", "predicted_label", "confidence")

    path = scratch_path(spark, "scored")
    S.stream_score(S.stream_reviews(spark, arrivals, 1), score, path).awaitTermination()
    streamed = spark.read.parquet(f"{path}/scored").collect()
    assert sorted(streamed) == sorted(score(reviews(spark, sf_dir)).collect())


def test_trend_with_a_watermark(spark, sf_dir, arrivals):
    timed = S.stream_reviews(spark, arrivals, 1).withColumns(
        {"timestamp": F.timestamp_millis("timestamp"), "sentiment_label": sentiment_label()}
    )
    path = scratch_path(spark, "trend")
    run = S.stream_monthly_trend(timed, path, watermark="10 days")
    run.awaitTermination()
    table = S.latest_trend(spark, path, S.last_batch(run))
    assert table.agg(F.sum("count")).head()[0] == reviews(spark, sf_dir).count()


def test_the_files_of_a_batch_grow_in_number_with_the_table(spark, sf_dir, monkeypatch):
    from quillsift.plans.catalog import streams as catalog

    whole = catalog.reviews(spark, sf_dir)
    monkeypatch.setattr(catalog, "reviews", lambda *_: whole.repartition(10))
    written = []
    monkeypatch.setattr(catalog.S, "stream_reviews", lambda _, path, files_per_batch: written.append((path, files_per_batch)))
    catalog._arrivals(spark, sf_dir)
    path, files = written[0]
    assert files == 3 and spark.read.json(path).count() == whole.count()
    assert len(spark.read.text(path).inputFiles()) == catalog.BATCHES * files
