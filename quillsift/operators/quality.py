"""Table profiles, duplicates and summary statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillsift.functions.columns import MIN_TEXT_LENGTH, drop_if_exists, min_length_filter
from quillsift.session import cut_lineage


def _per_column(df: DataFrame, count_of) -> DataFrame:
    """One pass over the table that gives one row per column."""
    counted = df.agg(
        F.count("*").alias("_rows"), *[count_of(F.col(f"`{c}`")).alias(c) for c in df.columns]
    )
    return counted.unpivot("_rows", df.columns, "column", "n")


def table_profile(df: DataFrame) -> DataFrame:
    """Name, type, row count and non-null count of every column."""
    types = F.create_map(*[F.lit(p) for f in df.schema.fields for p in (f.name, f.dataType.simpleString())])
    return _per_column(df, F.count).select(
        "column", types[F.col("column")].alias("type"), F.col("_rows").alias("rows"), F.col("n").alias("non_null")
    )


def null_counts(df: DataFrame) -> DataFrame:
    return _per_column(df, lambda c: F.count_if(c.isNull())).select("column", F.col("n").alias("nulls"))


def dup_row_count(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows that repeat an earlier one; nulls equal each other because the struct itself is not null."""
    key = F.struct(*(columns or df.columns))
    return df.agg((F.count("*") - F.count_distinct(key)).alias("duplicates"))


def dup_text_count(df: DataFrame, column: str = "text") -> DataFrame:
    return dup_row_count(df, [column])


def dedup_rows(df: DataFrame, ignore: list[str] | None = None) -> DataFrame:
    """Drop full-row duplicates; ``ignore`` names key columns that were added at ingest.

    Copies collapse before the shuffle, so a row repeated a billion times costs one row per task.
    """
    if not ignore:
        return df.dropDuplicates()
    values = [c for c in df.columns if c not in ignore]
    firsts = df.groupBy(*values).agg(*[F.min(c).alias(c) for c in ignore])
    return firsts.select(*df.columns)


def dedup_text_keep_first(df: DataFrame, column: str = "text", order: str = "review_id") -> DataFrame:
    """One row per text, the first by ``order``; null texts count as equal.

    Spark keeps only the first row per text in each task before it shuffles (the limit on the row
    number is pushed below the exchange), so many copies of one text do not gather anywhere. Sorting
    by the hash first makes most comparisons one of integers.
    """
    same_text = Window.partitionBy(F.xxhash64(column), F.col(column)).orderBy(order)
    return df.withColumn("_nth", F.row_number().over(same_text)).filter("_nth = 1").drop("_nth")


def clean_dataset(df: DataFrame, minimum: int = MIN_TEXT_LENGTH) -> DataFrame:
    """Drop image arrays, repeated texts and short texts.

    Equal rows have equal texts, so keeping the first row of each text already drops repeated rows.
    A text and its copies have the same length, so the cheap length filter runs before the shuffle.
    """
    return dedup_text_keep_first(min_length_filter(drop_if_exists(df, "images"), minimum=minimum))


def clean_dataset_counts(df: DataFrame, minimum: int = MIN_TEXT_LENGTH) -> DataFrame:
    """Rows before and after each cleaning step, counted per distinct text."""
    values = [c for c in df.columns if c not in ("review_id", "images")]
    per_row = df.groupBy(*values).agg(F.count("*").alias("copies"))
    per_text = per_row.groupBy("text").agg(F.sum("copies").alias("copies"), F.count("*").alias("versions"))
    long_enough = F.char_length("text") >= minimum
    return per_text.agg(
        F.sum("copies").alias("rows_in"),
        F.sum("versions").alias("after_row_dedup"),
        F.count("*").alias("after_text_dedup"),
        F.count_if(long_enough).alias("rows_out"),
    )


def value_counts(df: DataFrame, value: Column, by: list[str]) -> DataFrame:
    """Distinct non-null values with their counts, written once because they are read repeatedly."""
    valued = df.select(*by, value.cast("double").alias("value"))
    # A filter on the count stays above the aggregate; one on the value would move below it and work
    # the value out twice.
    return cut_lineage(valued.groupBy(*by, "value").agg(F.count("value").alias("n")).filter("n > 0"))


def _join_groups(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join on group columns where a null group equals a null group."""
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in on]
    return left.alias("l").join(right.alias("r"), same).drop(*[F.col(f"r.{c}") for c in on])


def exact_percentiles(
    df: DataFrame, value: Column, shares: list[float], names: list[str], by: list[str] | None = None
) -> DataFrame:
    """Exact percentiles with linear interpolation, one row per group."""
    return percentiles_of_counts(value_counts(df, value, by or []), shares, names, by or [])


#: Distinct values among which one task finds a rank, and the parts into which a round cuts those that are left.
RANGE_VALUES, PARTS = 50_000, 256


def percentiles_of_counts(counts: DataFrame, shares: list[float], names: list[str], by: list[str]) -> DataFrame:
    """The same from distinct values and their counts, see ``value_counts``.

    A percentile lies between two ranks. Each rank has a range of values that holds it, at first all
    values of its group. A round cuts the range into parts of about equal size (a sketch suffices for the
    cuts), counts the rows of each part, and goes on with the part that holds the rank. There are as
    many rounds as it takes until a range has few values, whatever their distribution.
    """
    distinct = counts.count()
    rounds = 0
    # The sketch is off by up to a part, so a round leaves at most three parts of the range.
    while distinct > RANGE_VALUES:
        distinct, rounds = distinct * 3 // PARTS, rounds + 1
    totals = counts.groupBy(*by).agg(F.sum("n").alias("_total"))
    places = [F.lit(share) * (F.col("_total") - 1) for share in shares]
    ranks = F.array_sort(F.array_distinct(F.array(*[f(p).cast("long") for p in places for f in (F.floor, F.ceil)])))
    wanted = totals.where("_total > 0").select(
        *by,
        "_total",
        F.explode(ranks).alias("_rank"),
        F.lit(None).cast("double").alias("_above"),
        F.lit(None).cast("double").alias("_upto"),
        F.lit(0).cast("long").alias("_before"),
    )
    for _ in range(rounds):
        wanted = _narrowed(counts, wanted, by)
    # A rank per share and end, each with few values.
    running = Window.partitionBy(*by, "_rank").orderBy("value")
    through = F.col("_before") + F.sum("n").over(running)
    found = _inside(counts, wanted, by).withColumn("_through", through).where(F.col("_through") > F.col("_rank"))
    value = found.groupBy(*by, "_rank").agg(F.min("value").alias("_value"), F.first("_total").alias("_total"))
    by_rank = value.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_value"))).alias("_at"), F.first("_total").alias("_total"))
    results = []
    for place, name in zip(places, names):
        low, high = (F.try_element_at("_at", f(place).cast("long")) for f in (F.floor, F.ceil))
        results.append((low + (high - low) * (place - F.floor(place))).alias(name))
    return by_rank.select(*by, *results)


def _inside(counts: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """Values in the range of each rank; the ranks are a few rows per group."""
    if by:
        joined = _join_groups(counts, wanted, by)
    else:  # the ranks are one value then, which Spark works out once and inlines
        joined = counts.withColumn("_ranks", wanted.agg(F.collect_list(F.struct(*wanted.columns))).scalar())
        joined = joined.select(*counts.columns, F.inline("_ranks"))
    above = F.col("_above").isNull() | (F.col("value") > F.col("_above"))
    return joined.where(above & (F.col("_upto").isNull() | (F.col("value") <= F.col("_upto"))))


def _narrowed(counts: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """Each rank with the part of its range that holds it."""
    grid = [i / PARTS for i in range(1, PARTS)]
    rank = [*by, "_rank"]
    inside = _inside(counts, wanted, by)
    cuts = inside.groupBy(*rank).agg(F.percentile_approx("value", grid, 10 * PARTS).alias("_cuts"))
    cut = _join_groups(inside, cuts, rank)
    upper = F.array_min(F.filter("_cuts", lambda c: c >= F.col("value")))
    # Behind the last cut the range itself is the end.
    parts = cut.withColumn("_part", upper).groupBy(*rank, "_part").agg(
        F.sum("n").alias("_rows"), *[F.first(c).alias(c) for c in ("_total", "_above", "_upto", "_before")]
    )
    order = F.col("_part").asc_nulls_last()
    along = Window.partitionBy(*rank).orderBy(order)
    start = F.col("_before") + F.sum("_rows").over(along) - F.col("_rows")
    parts = parts.withColumns({"_start": start, "_below": F.lag("_part").over(along)})
    holds = (F.col("_start") <= F.col("_rank")) & (F.col("_rank") < F.col("_start") + F.col("_rows"))
    return parts.where(holds).select(
        *by, "_total", "_rank", F.coalesce("_below", "_above").alias("_above"), F.coalesce("_part", "_upto").alias("_upto"), F.col("_start").alias("_before")
    )


def describe_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, deviation, extremes and quartiles; one row per column, all in one pass."""
    values = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    moments = values.groupBy("column").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quartiles = exact_percentiles(values, F.col("value"), [0.25, 0.5, 0.75], ["p25", "p50", "p75"], ["column"])
    return moments.join(quartiles, "column", "left")


def argmax_row(df: DataFrame, measure: Column, output: list[str], order: str = "review_id") -> DataFrame:
    """The row with the largest measure, the first by ``order`` on a tie."""
    best = F.max_by(F.struct(*output), F.struct(measure, -F.col(order)))
    return df.agg(best.alias("best")).select("best.*")


def preview_short(df: DataFrame, column: str = "text", below: int = MIN_TEXT_LENGTH, n: int = 10) -> DataFrame:
    return df.filter(F.char_length(column) < below).orderBy("review_id").limit(n)
