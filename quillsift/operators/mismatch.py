"""Reviews whose predicted sentiment contradicts their stars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillsift.operators.topk import top_per_group

# Confidence limit of the report, and the dashboard's default.
REPORT_CONFIDENCE = 0.70
DASHBOARD_CONFIDENCE = 0.90

FIVE_NEGATIVE = (5, "negative")
ONE_POSITIVE = (1, "positive")


def _is(kind: tuple[int, str]) -> Column:
    return (F.col("rating") == kind[0]) & (F.col("predicted_label") == kind[1])


def _kind() -> Column:
    return F.when(_is(FIVE_NEGATIVE), "5star_negative").when(_is(ONE_POSITIVE), "1star_positive")


def mismatch_5neg(df: DataFrame) -> DataFrame:
    return df.filter(_is(FIVE_NEGATIVE))


def mismatch_1pos(df: DataFrame) -> DataFrame:
    return df.filter(_is(ONE_POSITIVE))


def mismatch_high_conf(df: DataFrame, confidence: float = REPORT_CONFIDENCE) -> DataFrame:
    """Both kinds from a confidence on, with the kind named."""
    kinds = df.withColumn("kind", _kind())
    return kinds.filter(F.col("kind").isNotNull() & (F.col("confidence") >= confidence))


def mismatch_rates(df: DataFrame, confidence: float = REPORT_CONFIDENCE) -> DataFrame:
    """Count and percent of all reviews with that star, for each kind: all and confident ones."""
    sure = F.col("confidence") >= confidence
    tallies = df.groupBy("rating").agg(
        F.count("*").alias("star_total"),
        F.count_if(_kind().isNotNull()).alias("count"),
        F.count_if(_kind().isNotNull() & sure).alias("count_confident"),
    )
    named = tallies.filter(F.col("rating").isin(1, 5))
    return named.select(
        F.when(F.col("rating") == 5, "5star_negative").otherwise("1star_positive").alias("kind"),
        "star_total",
        "count",
        F.try_divide(F.col("count") * 100.0, F.col("star_total")).alias("pct"),
        "count_confident",
        F.try_divide(F.col("count_confident") * 100.0, F.col("star_total")).alias("pct_confident"),
    )


def mean_confidence_mismatch(df: DataFrame) -> DataFrame:
    """Mean confidence of each kind of mismatch."""
    kinds = df.withColumn("kind", _kind()).filter(F.col("kind").isNotNull())
    return kinds.groupBy("kind").agg(F.avg("confidence").alias("avg_confidence"))


def mismatch_top(
    df: DataFrame, n: int = 15, confidence: float = DASHBOARD_CONFIDENCE, row_id: str = "review_id"
) -> DataFrame:
    """The most confident rows of each kind."""
    order = [F.desc("confidence"), F.col(row_id)]
    ranked = top_per_group(mismatch_high_conf(df, confidence), "kind", order, n, row_id=row_id)
    columns = ["rating", "predicted_label", "confidence", "title", "text", "topic_label"]
    return ranked.select("kind", "rank", row_id, *columns)


def mismatch_threshold_sweep(df: DataFrame, low: float = 0.5, steps: int = 50, per_unit: int = 100) -> DataFrame:
    """Count of each kind for every confidence limit of the slider, in one pass.

    A row is placed at the highest limit it reaches, rows are counted per limit, and the counts of
    the at most ``steps + 1`` limits are added up from the top. Arithmetic gives the place only up to
    one, as decimal steps are not exact in binary, and comparing with the limits next to it settles it.
    """

    def limit(step: Column) -> Column:
        return F.lit(low) + step.cast("double") / float(per_unit)

    near = F.floor((F.col("confidence") - low) * per_unit).cast("int")
    below = near - (limit(near) > F.col("confidence")).cast("int") + (limit(near + 1) <= F.col("confidence")).cast("int")
    level = F.least(below, F.lit(steps))
    counted = (
        df.filter(F.col("confidence") >= low)
        .groupBy(level.alias("level"))
        .agg(F.count_if(_is(FIVE_NEGATIVE)).alias("five"), F.count_if(_is(ONE_POSITIVE)).alias("one"))
    )
    frame = df.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("level"))
    above = Window.partitionBy(F.lit(1)).orderBy(F.desc("level"))
    return frame.join(counted, "level", "left").select(
        limit(F.col("level")).alias("threshold"),
        F.coalesce(F.sum("five").over(above), F.lit(0)).alias("five_negative"),
        F.coalesce(F.sum("one").over(above), F.lit(0)).alias("one_positive"),
    )
