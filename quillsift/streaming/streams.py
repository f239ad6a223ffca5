"""Streaming forms of the sample, the scorer and the monthly table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillsift.operators.sampling import reservoir_sample
from quillsift.sources.schemas import RAW_REVIEW
from quillsift.sources.sinks import is_finished, remove


def stream_reviews(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Raw reviews arriving as JSON files."""
    reader = spark.readStream.schema(RAW_REVIEW)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def stream_reservoir(stream: DataFrame, path: str, n: int, seed: int = 42) -> StreamingQuery:
    """Keep a uniform sample of ``n`` rows over all that has arrived.

    Every batch writes a new version of the sample, made from the previous version and the batch. A
    batch that is run again reads the same previous version, and the random keys depend on the row's
    id alone, so it writes the same rows. A batch that begins has the one before it behind it for good, so
    the version before that goes: two are left, or one after ``only_latest_sample``. The rows of a batch
    are read once and held while the sample is drawn.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        remove(spark, f"{path}/sample/version={batch_id - 2}")
        batch = batch.persist()
        try:
            write(spark, batch, batch_id)
        finally:
            batch.unpersist()

    def write(spark: SparkSession, batch: DataFrame, batch_id: int) -> None:
        before = f"{path}/sample/version={batch_id - 1}"
        rows = batch
        if is_finished(spark, before):
            rows = spark.read.schema(batch.schema).parquet(before).unionByName(batch)
        elif batch_id > 0:
            raise FileNotFoundError(f"the sample before batch {batch_id} is gone: {before}")
        reservoir_sample(rows, n, seed).write.mode("overwrite").parquet(f"{path}/sample/version={batch_id}")

    return (
        stream.writeStream.foreachBatch(merge)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def only_latest_sample(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """The sample of the last finished batch; the version before it, which no batch reads any more, goes."""
    remove(spark, f"{path}/sample/version={batch_id - 1}")
    return latest_sample(spark, path, batch_id)


def latest_sample(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    return spark.read.parquet(f"{path}/sample/version={batch_id}")


def stream_score(stream: DataFrame, score: Callable[[DataFrame], DataFrame], path: str) -> StreamingQuery:
    """Score rows as they arrive and append them to a table."""
    return (
        score(stream)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{path}/scored")
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def stream_monthly_trend(
    stream: DataFrame, path: str, ts: str = "timestamp", label: str = "sentiment_label", watermark: str | None = None
) -> StreamingQuery:
    """Rows per month and class, kept up to date: one state row per pair.

    Each batch writes the whole (small) table as a new version.
    """
    if watermark:
        stream = stream.withWatermark(ts, watermark)
    counted = stream.groupBy(F.date_trunc("month", ts).alias("date"), label).agg(F.count("*").alias("count"))

    def publish(table: DataFrame, batch_id: int) -> None:
        table.write.mode("overwrite").parquet(f"{path}/trend/version={batch_id}")

    return (
        counted.writeStream.outputMode("complete")
        .foreachBatch(publish)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def latest_trend(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    return spark.read.parquet(f"{path}/trend/version={batch_id}")


def last_batch(query: StreamingQuery) -> int:
    """Number of the last batch of a finished query."""
    return query.lastProgress["batchId"]
