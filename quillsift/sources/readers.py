"""Scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillsift.sources.schemas import RAW_REVIEW

CORRUPT = "_corrupt_record"


def scan_jsonl(
    spark: SparkSession, path: str, schema: T.StructType = RAW_REVIEW, corrupt: str | None = None
) -> DataFrame:
    """Read line-delimited JSON with a fixed schema, so nothing is inferred and files split freely.

    A line that does not parse gives a row of nulls; name a ``corrupt`` column to keep its text.
    """
    reader = spark.read.option("mode", "PERMISSIVE")
    if corrupt:
        schema = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
        reader = reader.option("columnNameOfCorruptRecord", corrupt)
    return reader.schema(schema).json(path)


def scan_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Read parquet; with ``columns`` the scan reads only those."""
    table = spark.read.parquet(path)
    return table.select(*columns) if columns else table


def scan_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read a CSV result table with a header line; quotes inside fields are doubled."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def epoch_ms_to_ts(column) -> "F.Column":
    """Milliseconds since 1970 (UTC) as a timestamp."""
    return F.timestamp_millis(column)
