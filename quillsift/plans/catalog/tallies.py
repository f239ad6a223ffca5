"""Queries over aggregates, mismatches and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillsift.functions import columns as C
from quillsift.operators import aggregates as A
from quillsift.operators import evaluate as E
from quillsift.operators import joins, mismatch, topk
from quillsift.plans.catalog.tables import facts, labelled, topical
from quillsift.plans.registry import query, rounded, view
from quillsift.sources.tables import scored_reviews

_SHARES = ["negative", "neutral", "positive"]

view(
    "dated",
    """SELECT *, strftime(ts, '%Y-%m') AS year_month, CAST(date_trunc('month', ts) AS TIMESTAMP) AS date FROM facts""",
)


def _percents(group, column, values, names=None, source="dated"):
    """Cross-tab in percent, in SQL."""
    cells = ", ".join(
        f"round(100.0 * count(*) FILTER ({column} = {v!r}) / count(*), 6)::DOUBLE AS \"{n}\""
        for v, n in zip(values, names or values)
    )
    return f"SELECT {group}, {cells} FROM {source} GROUP BY {group}"


@query("rating_counts", "SELECT rating, count(*) AS count FROM facts GROUP BY rating")
def _(spark, sf_dir):
    return A.counts(facts(spark, sf_dir), "rating")


@query("rating_shares", "SELECT rating, count(*) AS count, round(count(*) * 100.0 / sum(count(*)) OVER (), 6)::DOUBLE AS share FROM facts GROUP BY rating")
def _(spark, sf_dir):
    return rounded(A.shares(facts(spark, sf_dir), "rating"), "share")


@query(
    "sentiment_counts_fixed",
    """SELECT o.position, o.sentiment_label, c.count FROM (VALUES (1, 'negative'), (2, 'neutral'), (3, 'positive')) o(position, sentiment_label)
    LEFT JOIN (SELECT sentiment_label, count(*) AS count FROM facts GROUP BY 1) c ON o.sentiment_label = c.sentiment_label""",
)
def _(spark, sf_dir):
    return A.counts_fixed_order(facts(spark, sf_dir))


@query("verified_counts", "SELECT verified_purchase, count(*) AS count FROM facts GROUP BY 1")
def _(spark, sf_dir):
    return A.counts(facts(spark, sf_dir), "verified_purchase")


@query(
    "overview_kpis",
    """SELECT count(*) AS reviews, round(avg(rating), 6) AS avg_rating,
    round(avg(CASE WHEN sentiment_label = 'positive' THEN 100.0::DOUBLE ELSE 0 END), 6) AS pct_positive,
    round(avg(CASE WHEN verified_purchase THEN 100.0::DOUBLE ELSE 0 END), 6) AS pct_verified FROM facts""",
)
def _(spark, sf_dir):
    return rounded(A.overview_kpis(facts(spark, sf_dir)), "avg_rating", "pct_positive", "pct_verified")


@query("helpful_by_sentiment", "SELECT sentiment_label, round(avg(helpful_vote), 6) AS avg_helpful FROM facts GROUP BY 1")
def _(spark, sf_dir):
    return rounded(A.helpful_by_sentiment(facts(spark, sf_dir)), "avg_helpful")


@query("verified_x_sentiment", _percents("verified_purchase", "sentiment_label", _SHARES))
def _(spark, sf_dir):
    return rounded(A.verified_x_sentiment(facts(spark, sf_dir)), *_SHARES)


@query("topic_x_sentiment", _percents("topic_label", "sentiment_label", _SHARES))
def _(spark, sf_dir):
    return rounded(A.topic_x_sentiment(facts(spark, sf_dir)), *_SHARES)


@query("negative_topics", "SELECT topic_label, round(avg(CASE WHEN sentiment_label = 'negative' THEN 100.0::DOUBLE ELSE 0 END), 6) AS pct_negative FROM facts GROUP BY 1")
def _(spark, sf_dir):
    return rounded(A.negative_topics(facts(spark, sf_dir)), "pct_negative")


@query("helpful_by_topic", "SELECT topic_label, round(avg(helpful_vote), 6) AS avg_helpful FROM facts GROUP BY 1")
def _(spark, sf_dir):
    return rounded(A.helpful_by_topic(facts(spark, sf_dir)), "avg_helpful")


@query("verified_by_topic", _percents("topic_label", "verified_purchase", [False, True], ["not_verified", "verified"]))
def _(spark, sf_dir):
    return rounded(A.verified_by_topic(facts(spark, sf_dir)), "not_verified", "verified")


@query("topic_frequency", "SELECT topic_label, count(*) AS count FROM facts GROUP BY 1")
def _(spark, sf_dir):
    return A.topic_frequency(facts(spark, sf_dir))


@query("monthly_volume", "SELECT date, count(*) AS count FROM dated WHERE date IS NOT NULL GROUP BY 1")
def _(spark, sf_dir):
    return A.monthly_volume(facts(spark, sf_dir))


@query("monthly_sentiment", _percents("year_month", "sentiment_label", _SHARES))
def _(spark, sf_dir):
    return rounded(A.monthly_sentiment(facts(spark, sf_dir)), *_SHARES)


@query(
    "monthly_sentiment_long",
    f"""WITH wide AS ({_percents("date", "sentiment_label", _SHARES)})
    SELECT date, sentiment, share FROM (UNPIVOT wide ON negative, neutral, positive INTO NAME sentiment VALUE share)""",
)
def _(spark, sf_dir):
    return rounded(A.monthly_sentiment_long(facts(spark, sf_dir)), "share")


_GROUP = ["ECONOMY", "PROMO", "STANDARD"]


@query("topic_trend_in_group", _percents("year_month", "topic_label", _GROUP, source=f"(SELECT * FROM dated WHERE topic_label IN ({', '.join(map(repr, _GROUP))}))"))
def _(spark, sf_dir):
    return rounded(A.topic_trend_in_group(facts(spark, sf_dir), _GROUP), *_GROUP)


@query(
    "length_boxstats",
    """WITH lens AS (SELECT sentiment_label, CAST(length(text) AS DOUBLE) AS len FROM labelled),
    box AS (SELECT sentiment_label, quantile_cont(len, 0.25) AS q1, quantile_cont(len, 0.5) AS median, quantile_cont(len, 0.75) AS q3
      FROM lens GROUP BY 1)
    SELECT sentiment_label, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
      min(len) AS whisker_low, max(len) AS whisker_high FROM lens JOIN box USING (sentiment_label)
    WHERE len BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1) GROUP BY sentiment_label, q1, median, q3""",
)
def _(spark, sf_dir):
    sized = labelled(spark, sf_dir).withColumn("text_length", C.char_length("text"))
    return rounded(A.length_boxstats(sized, "text_length"), "q1", "median", "q3")


@query(
    "mean_confidence_mismatch",
    """SELECT CASE rating WHEN 5 THEN '5star_negative' ELSE '1star_positive' END AS kind, round(avg(confidence), 6) AS avg_confidence FROM facts
    WHERE (rating = 5 AND predicted_label = 'negative') OR (rating = 1 AND predicted_label = 'positive') GROUP BY 1""",
)
def _(spark, sf_dir):
    return rounded(mismatch.mean_confidence_mismatch(facts(spark, sf_dir)), "avg_confidence")


@query("distinct_sorted", "SELECT DISTINCT topic_label FROM topical WHERE topic_label IS NOT NULL ORDER BY 1")
def _(spark, sf_dir):
    return A.distinct_sorted(topical(spark, sf_dir), "topic_label")


@query("date_bounds", "SELECT CAST(min(ts) AS DATE) AS first_date, CAST(max(ts) AS DATE) AS last_date FROM facts")
def _(spark, sf_dir):
    return A.date_bounds(facts(spark, sf_dir))


@query("label_distribution", "SELECT sentiment_label, round_even(count(*)::DOUBLE / sum(count(*)) OVER (), 3) AS share FROM facts GROUP BY 1")
def _(spark, sf_dir):
    return A.label_distribution(facts(spark, sf_dir))


# Mismatches between stars and predicted sentiment.

_MISMATCH = ["review_id", "rating", "predicted_label", "confidence"]


def _scored(spark, sf_dir):
    return scored_reviews(spark, sf_dir).select(*_MISMATCH)


@query("mismatch_5neg", f"SELECT {', '.join(_MISMATCH)} FROM scored WHERE rating = 5 AND predicted_label = 'negative'")
def _(spark, sf_dir):
    return mismatch.mismatch_5neg(_scored(spark, sf_dir))


@query("mismatch_1pos", f"SELECT {', '.join(_MISMATCH)} FROM scored WHERE rating = 1 AND predicted_label = 'positive'")
def _(spark, sf_dir):
    return mismatch.mismatch_1pos(_scored(spark, sf_dir))


_KINDS = """SELECT *, CASE WHEN rating = 5 AND predicted_label = 'negative' THEN '5star_negative'
  WHEN rating = 1 AND predicted_label = 'positive' THEN '1star_positive' END AS kind FROM topical"""


@query("mismatch_high_conf", f"SELECT {', '.join(_MISMATCH)}, kind FROM ({_KINDS}) WHERE kind IS NOT NULL AND confidence >= 0.7::DOUBLE")
def _(spark, sf_dir):
    return mismatch.mismatch_high_conf(_scored(spark, sf_dir))


@query(
    "mismatch_rates",
    """WITH k AS (SELECT *, (rating = 5 AND predicted_label = 'negative') OR (rating = 1 AND predicted_label = 'positive') AS hit,
      confidence >= 0.7::DOUBLE AS sure FROM facts WHERE rating IN (1, 5))
    SELECT CASE rating WHEN 5 THEN '5star_negative' ELSE '1star_positive' END AS kind, count(*) AS star_total,
      count(*) FILTER (hit) AS count, round(100.0 * count(*) FILTER (hit) / count(*), 6)::DOUBLE AS pct,
      count(*) FILTER (hit AND sure) AS count_confident, round(100.0 * count(*) FILTER (hit AND sure) / count(*), 6)::DOUBLE AS pct_confident
    FROM k GROUP BY rating""",
)
def _(spark, sf_dir):
    return rounded(mismatch.mismatch_rates(facts(spark, sf_dir)), "pct", "pct_confident")


@query(
    "mismatch_top",
    f"""SELECT kind, CAST(row_number() OVER (PARTITION BY kind ORDER BY confidence DESC, review_id) AS INT) AS rank, review_id, rating,
    predicted_label, confidence, title, text, topic_label FROM ({_KINDS}) WHERE kind IS NOT NULL AND confidence >= 0.5::DOUBLE
    QUALIFY rank <= 15""",
)
def _(spark, sf_dir):
    return mismatch.mismatch_top(topical(spark, sf_dir), confidence=0.5)


@query(
    "mismatch_threshold_sweep",
    """SELECT t.threshold, count(*) FILTER (rating = 5 AND predicted_label = 'negative') AS five_negative,
      count(*) FILTER (rating = 1 AND predicted_label = 'positive') AS one_positive
    FROM (SELECT 0.5::DOUBLE + i::DOUBLE / 100 AS threshold FROM range(0, 51) r(i)) t
    LEFT JOIN facts f ON f.confidence >= t.threshold GROUP BY 1""",
)
def _(spark, sf_dir):
    return mismatch.mismatch_threshold_sweep(facts(spark, sf_dir))


# Metrics of predicted against true labels.


def _judged(spark, sf_dir):
    return facts(spark, sf_dir).withColumnRenamed("sentiment_label", "true_label")


view("judged", "SELECT *, sentiment_label AS true_label FROM facts")
view(
    "class_scores",
    """SELECT c.class, tp, pred, sup, coalesce(tp::DOUBLE / nullif(pred, 0), 0) AS p, coalesce(tp::DOUBLE / nullif(sup, 0), 0) AS r,
      coalesce(2.0::DOUBLE * tp / nullif(pred + sup, 0), 0) AS f1 FROM (
      SELECT l.class, count(*) FILTER (true_label = l.class AND predicted_label = l.class) AS tp,
        count(*) FILTER (predicted_label = l.class) AS pred, count(*) FILTER (true_label = l.class) AS sup
      FROM judged, (VALUES ('negative'), ('neutral'), ('positive')) l(class) GROUP BY l.class) c""",
)


@query("accuracy", "SELECT round(avg(CASE WHEN true_label = predicted_label THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy FROM judged")
def _(spark, sf_dir):
    return rounded(E.accuracy(_judged(spark, sf_dir)), "accuracy")


@query("macro_f1", "SELECT round(avg(f1), 6) AS macro_f1 FROM class_scores")
def _(spark, sf_dir):
    return rounded(E.macro_f1(_judged(spark, sf_dir)), "macro_f1")


@query("weighted_f1", "SELECT round(sum(f1 * sup) / sum(sup), 6) AS weighted_f1 FROM class_scores")
def _(spark, sf_dir):
    return rounded(E.weighted_f1(_judged(spark, sf_dir)), "weighted_f1")


@query(
    "confusion_matrix",
    """SELECT true_label, count(*) FILTER (predicted_label = 'negative') AS negative, count(*) FILTER (predicted_label = 'neutral') AS neutral,
    count(*) FILTER (predicted_label = 'positive') AS positive FROM judged GROUP BY 1""",
)
def _(spark, sf_dir):
    return E.confusion_matrix(_judged(spark, sf_dir))


@query(
    "classification_report",
    """SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, sup AS support FROM class_scores
    UNION ALL SELECT 'accuracy', NULL, NULL, round(avg(CASE WHEN true_label = predicted_label THEN 1.0::DOUBLE ELSE 0 END), 6), count(*) FROM judged
    UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f1), 6), CAST(sum(sup) AS BIGINT) FROM class_scores
    UNION ALL SELECT 'weighted avg', round(sum(p * sup) / sum(sup), 6), round(sum(r * sup) / sum(sup), 6),
      round(sum(f1 * sup) / sum(sup), 6), CAST(sum(sup) AS BIGINT) FROM class_scores""",
)
def _(spark, sf_dir):
    return rounded(E.classification_report(_judged(spark, sf_dir)), "precision", "recall", "f1")


def _stacked(spark, sf_dir):
    scored = scored_reviews(spark, sf_dir)
    first = scored.select(F.lit("first").alias("model"), "review_id", "true_label", "predicted_label")
    second = scored.select(
        F.lit("second").alias("model"), "review_id", "true_label", F.col("other_label").alias("predicted_label")
    )
    return joins.union_batches([first, second])


@query("union_model_rows", "SELECT model, review_id, true_label, predicted_label FROM stacked")
def _(spark, sf_dir):
    return _stacked(spark, sf_dir)


@query("model_comparison", "SELECT * FROM compared")
def _(spark, sf_dir):
    return rounded(E.model_comparison(_stacked(spark, sf_dir)), "accuracy", "macro_f1", "weighted_f1")


@query("model_comparison_long", "SELECT model, metric, score FROM (UNPIVOT (SELECT * FROM compared) ON accuracy, macro_f1, weighted_f1 INTO NAME metric VALUE score)")
def _(spark, sf_dir):
    return rounded(E.model_comparison_long(E.model_comparison(_stacked(spark, sf_dir))), "score")


@query("error_rows", "SELECT review_id, true_label, predicted_label FROM scored WHERE true_label <> predicted_label")
def _(spark, sf_dir):
    return topk.error_rows(scored_reviews(spark, sf_dir).select("review_id", "true_label", "predicted_label"))


_KEY = "CAST('0x' || substr(md5('42:' || CAST(review_id AS VARCHAR)), 1, 15) AS BIGINT)"


@query(
    "error_samples_by_class",
    f"""WITH errors AS (SELECT review_id, true_label, predicted_label FROM scored WHERE true_label <> predicted_label)
    SELECT *, 'all' AS part FROM (SELECT * FROM errors ORDER BY {_KEY}, review_id LIMIT 10)
    UNION ALL SELECT *, true_label FROM (SELECT * FROM errors QUALIFY row_number() OVER (PARTITION BY true_label ORDER BY {_KEY}, review_id) <= 10)""",
)
def _(spark, sf_dir):
    return E.error_samples_by_class(scored_reviews(spark, sf_dir).select("review_id", "true_label", "predicted_label"))


@query("bootstrap_macro_f1_diff")
def _(spark, sf_dir):
    return E.bootstrap_macro_f1_diff(scored_reviews(spark, sf_dir), "predicted_label", "other_label")


@query(
    "bootstrap_facts",
    """SELECT round((SELECT macro_f1 FROM compared WHERE model = 'first') - (SELECT macro_f1 FROM compared WHERE model = 'second'), 5) AS observed_diff,
    true AS ordered, true AS near_the_mean""",
)
def _(spark, sf_dir):
    """The observed difference is that of the two models; mean and limits of the resamples lie around it."""
    found = E.bootstrap_macro_f1_diff(scored_reviews(spark, sf_dir), "predicted_label", "other_label")
    spread = F.col("ci_high") - F.col("ci_low")
    return found.select(
        F.round("observed_diff", 5).alias("observed_diff"),
        ((F.col("ci_low") <= F.col("mean_diff")) & (F.col("mean_diff") <= F.col("ci_high"))).alias("ordered"),
        (F.abs(F.col("mean_diff") - F.col("observed_diff")) <= spread / 4).alias("near_the_mean"),
    )
