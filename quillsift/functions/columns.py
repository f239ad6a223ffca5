"""Scalar column expressions and row filters over review tables."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Class names in their fixed order (the position is the class id).
LABELS = ["negative", "neutral", "positive"]

# Business labels of the topic ids.
TOPIC_LABELS = {
    0: "Ease of Use & Cleaning",
    1: "Bedding & Sleep",
    2: "Bath & Soft Furnishings",
    3: "Home Appliances (Fans & Vacuums)",
    4: "Price, Value & Delivery Issues",
    5: "Furniture & Cutlery",
    6: "Size, Fit & Storage",
    7: "Cookware & Kitchen",
    8: "Drinkware & Beverages",
    9: "Gifts & Recommendations",
    10: "Appearance & Design",
    11: "Complaints & Malfunctions",
}

# Fixed value: shorter review texts are dropped.
MIN_TEXT_LENGTH = 20


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def full_text(title: Column | str = "title", text: Column | str = "text") -> Column:
    """Title and text as one string; a null part counts as empty."""
    return F.concat(F.coalesce(_col(title), F.lit("")), F.lit(". "), F.coalesce(_col(text), F.lit("")))


def sentiment_label(rating: Column | str = "rating", default: str | None = None) -> Column:
    """Weak label from the stars; other ratings give ``default``."""
    stars = _col(rating)
    return (
        F.when(stars.isin(1, 2), "negative")
        .when(stars == 3, "neutral")
        .when(stars.isin(4, 5), "positive")
        .otherwise(F.lit(default).cast("string"))
    )


def year_month(ts: Column | str = "timestamp") -> Column:
    return F.date_format(_col(ts), "yyyy-MM")


def month_start(ts: Column | str = "timestamp") -> Column:
    return F.date_trunc("month", _col(ts))


def char_length(text: Column | str) -> Column:
    return F.char_length(_col(text))


def label_id(label: Column | str, labels: list[str] = LABELS) -> Column:
    """Position of the label in the fixed order; null if it is not listed."""
    position = F.array_position(F.array(*[F.lit(name) for name in labels]), _col(label))
    return F.nullif(position, F.lit(0)).cast("int") - 1


def label_name(class_id: Column | str, labels: list[str] = LABELS) -> Column:
    """Label at a position of the fixed order; null outside it."""
    return F.get(F.array(*[F.lit(name) for name in labels]), _col(class_id).cast("int"))


def topic_label(topic_id: Column | str, names: dict[int, str] = TOPIC_LABELS, fallback: bool = True) -> Column:
    """Business label of a topic id, or ``Topic {id}`` where none is known.

    The names are a handful of literals, so this is a map lookup in the row and not a join.
    """
    known = F.create_map(*[F.lit(part) for pair in names.items() for part in pair])
    label = F.try_element_at(known, _col(topic_id).cast("int"))
    return F.coalesce(label, F.concat(F.lit("Topic "), _col(topic_id).cast("string"))) if fallback else label


def lookup_labels(df: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """Same lookup when the labels are a table; Spark broadcasts it only if it measures small."""
    known = labels.select(F.col(key), F.col(label).alias("_label"))
    named = df.join(known, key, "left")
    return named.withColumn(
        label, F.coalesce("_label", F.concat(F.lit("Topic "), F.col(key).cast("string")))
    ).drop("_label")


def min_length_filter(df: DataFrame, column: str = "text", minimum: int = MIN_TEXT_LENGTH) -> DataFrame:
    """Keep rows whose raw text has at least ``minimum`` characters; null text goes."""
    return df.filter(F.char_length(column) >= minimum)


def _start_of(day: datetime.date) -> Column:
    """The first moment of a day in the session's time zone, whatever the zone of the driver."""
    return F.lit(day.isoformat()).cast("timestamp")


def filter_min_year(df: DataFrame, year: int = 2019, ts: str = "timestamp") -> DataFrame:
    """Keep rows from ``year`` on, as a range on the stored column so that it reaches the scan."""
    return df.filter(F.col(ts) >= _start_of(datetime.date(year, 1, 1)))


def filter_date_range(
    df: DataFrame, first: datetime.date, last: datetime.date, ts: str = "timestamp"
) -> DataFrame:
    """Keep rows dated from ``first`` to ``last``, both days included."""
    after = last + datetime.timedelta(days=1)
    return df.filter((F.col(ts) >= _start_of(first)) & (F.col(ts) < _start_of(after)))


def filter_in_list(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.filter(F.col(column).isin(*values))


def filter_verified(df: DataFrame, choice: str = "all", column: str = "verified_purchase") -> DataFrame:
    """``all``, ``verified`` or ``unverified`` purchases."""
    if choice == "verified":
        return df.filter(F.col(column))
    if choice == "unverified":
        return df.filter(~F.col(column))
    if choice != "all":
        raise ValueError(f"unknown choice {choice!r}")
    return df


def filter_selectivity(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows selected by a predicate, and all rows, in one pass."""
    return df.agg(F.count_if(predicate).alias("selected"), F.count("*").alias("total"))


def drop_if_exists(df: DataFrame, *columns: str) -> DataFrame:
    """Drop optional columns such as image arrays; absent ones are ignored."""
    return df.drop(*columns)


def project(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns)


def rename_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def assert_labelled(df: DataFrame, column: str = "sentiment_label") -> DataFrame:
    """One row with the number of unlabelled rows; the query fails when it is not zero."""
    bad = F.count_if(F.col(column).isNull() | (F.col(column) == "unknown"))
    checked = df.agg(bad.alias("unlabelled"), F.count("*").alias("total"))
    message = F.concat(F.col("unlabelled").cast("string"), F.lit(" rows have no label"))
    return checked.select(
        F.when(F.col("unlabelled") == 0, F.col("unlabelled")).otherwise(F.raise_error(message).cast("bigint")).alias(
            "unlabelled"
        ),
        "total",
    )
