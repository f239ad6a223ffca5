"""The main jobs: prepare, fit, enrich, and the tables of the dashboard."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.functions import columns as C
from quillsift.functions.text import STOP_WORDS, add_clean_columns, clean_text, remove_stopwords
from quillsift.operators import aggregates as A
from quillsift.operators import mismatch as M
from quillsift.operators.features import Terms, count_features
from quillsift.operators.quality import clean_dataset
from quillsift.operators.topics import TopicShares, add_dominant_topic, lda_fit, lda_topic_mix
from quillsift.session import cut_lineage
from quillsift.sources.schemas import ENRICHED_COLUMNS


def prepare(raw: DataFrame, stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """Clean reviews with label, cleaned texts, their length and the month."""
    kept = add_clean_columns(clean_dataset(raw), stop_words)
    return kept.withColumns(
        {
            "sentiment_label": C.sentiment_label(),
            "clean_text_length": C.char_length("clean_text"),
            "year_month": C.year_month(),
        }
    )


@dataclass
class TopicModel:
    """Terms, their counts and the topics over them, applied and stored as one."""

    counter: PipelineModel
    topics: TopicShares
    names: dict[int, str]

    def pipeline(self) -> PipelineModel:
        """The stages as one model, which ``model_store`` can keep."""
        return PipelineModel([*self.counter.stages, self.topics])

    @classmethod
    def of(cls, stored: PipelineModel, names: dict[int, str] = C.TOPIC_LABELS) -> TopicModel:
        """The way back from ``pipeline``; the names of the topics are a choice of the job."""
        return cls(PipelineModel(stored.stages[:-1]), stored.stages[-1], names)

    def apply(self, df: DataFrame) -> DataFrame:
        mixed = lda_topic_mix(self.topics, self.counter.transform(df))
        return add_dominant_topic(mixed, names=self.names).drop("topic_terms", "counts", "mixture")


def fit_topics(
    df: DataFrame,
    topics: int = 12,
    iterations: int = 30,
    min_df: float = 10,
    max_df: float = 0.5,
    max_features: int = 10_000,
    names: dict[int, str] = C.TOPIC_LABELS,
    seed: int = 42,
) -> TopicModel:
    """Topics over words and bigrams of the stop-word-free text."""
    terms = Terms(inputCol="clean_text_no_stopwords", outputCol="topic_terms")
    prepared = cut_lineage(terms.transform(df).select("topic_terms"))
    counter = count_features(prepared, "topic_terms", "counts", min_df, max_df, max_features)
    fitted = lda_fit(counter.transform(prepared).select("counts"), topics, iterations, seed=seed)
    return TopicModel(PipelineModel([terms, counter]), fitted, names)


Scorer = Callable[[DataFrame], DataFrame]


def enrich_reviews(raw: DataFrame, score: Scorer, topics: TopicModel, stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """Raw reviews to the enriched table, keyed by ``review_id``.

    ``score`` adds ``predicted_label`` and ``confidence`` to rows that have ``full_text``. All is one
    plan; the only shuffle is the one that drops repeated texts.
    """
    scored = score(prepare(raw, stop_words))
    return topics.apply(scored).select("review_id", *ENRICHED_COLUMNS)


def score_and_topic(texts: DataFrame, score: Scorer, topics: TopicModel, text: str = "text") -> DataFrame:
    """Class probabilities, label, confidence and topic for a table of raw texts.

    Here the text stands alone, without a title; one with nothing left after cleaning has no topic.
    """
    ready = texts.withColumn("full_text", F.coalesce(F.col(text), F.lit("")))
    return topics.apply(score(add_clean_words(ready)))


def add_clean_words(df: DataFrame, stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """Cleaned text with and without stop words, from ``full_text``."""
    cleaned = df.withColumn("clean_text", clean_text(F.col("full_text")))
    return cleaned.withColumn("clean_text_no_stopwords", remove_stopwords(F.col("clean_text"), stop_words))


def dashboard_filter(
    df: DataFrame,
    first: datetime.date | None = None,
    last: datetime.date | None = None,
    topics: list[str] | None = None,
    verified: str = "all",
) -> DataFrame:
    """Rows chosen by date range, topics and kind of purchase. The default keeps all with a topic."""
    chosen = df.filter(F.col("topic_label").isNotNull())
    if first or last:
        chosen = C.filter_date_range(chosen, first or datetime.date.min, last or datetime.date(9998, 12, 31))
    if topics is not None:
        chosen = C.filter_in_list(chosen, "topic_label", topics)
    return C.filter_verified(chosen, verified)


def dashboard_tables(df: DataFrame, confidence: float = M.DASHBOARD_CONFIDENCE) -> dict[str, DataFrame]:
    """All tables of the dashboard over already filtered rows; persist those first."""
    dated = df.withColumn("date", C.month_start())
    return {
        "kpis": A.overview_kpis(df),
        "rating_counts": A.counts(df, "rating"),
        "sentiment_counts": A.counts_fixed_order(df),
        "topic_sentiment": A.topic_x_sentiment(df),
        "negative_topics": A.negative_topics(df),
        "helpful_by_topic": A.helpful_by_topic(df),
        "monthly_volume": A.monthly_volume(df),
        "monthly_sentiment": A.monthly_sentiment_long(dated),
        "mismatch_rates": M.mismatch_rates(df, confidence),
        "mismatch_top": M.mismatch_top(df, confidence=confidence),
    }
