"""Sinks, stage reuse and model storage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sink_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a table and return it as read back from the path.

    With partition columns the rows are first brought together by them, so that a month is a few
    files. It is a rebalancing, which splits a month that holds a third of all rows into many tasks.
    """
    if partition_by:
        df.hint("rebalance", *partition_by).write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sink_csv(df: DataFrame, path: str) -> None:
    """Write a small result table as CSV with a header line."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def sink_metrics_json(df: DataFrame, path: str) -> DataFrame:
    """Write nested metrics as one JSON line per row and return the lines."""
    lines = df.select(F.to_json(F.struct(*df.columns)).alias("value"))
    lines.write.mode("overwrite").text(path)
    return df.sparkSession.read.text(path)


def _hadoop_path(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def is_finished(spark: SparkSession, path: str) -> bool:
    """Whether a finished output is at the path, on any file system Spark knows.

    Only the ``_SUCCESS`` mark counts: a job lost halfway leaves a folder without it.
    """
    files, mark = _hadoop_path(spark, f"{path}/_SUCCESS")
    return files.exists(mark)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of our own, if it is there."""
    files, place = _hadoop_path(spark, path)
    files.delete(place, True)


def materialize(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Reuse the table at ``path`` if a finished one is there; otherwise build and store it."""
    if not is_finished(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def model_store(spark: SparkSession, path: str, fit: Callable[[], PipelineModel]) -> PipelineModel:
    """Load the fitted model at ``path``, or fit it once and store it there.

    A model is many files, so the mark is set after the last one.
    """
    if not is_finished(spark, path):
        fit().write().overwrite().save(path)
        files, mark = _hadoop_path(spark, f"{path}/_SUCCESS")
        files.create(mark).close()
    return PipelineModel.load(path)
