"""Word and bigram frequencies. Words are counted within slices of each task before they are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillsift.functions.text import ENGLISH_STOP_WORDS, bigrams, tokenize_words, without, words
from quillsift.operators.quality import percentiles_of_counts, value_counts
from quillsift.operators.tallies import term_tallies


def _counted(df: DataFrame, items: Column, name: str, by: list[str]) -> DataFrame:
    """Counts of the items, for each value of the column in ``by`` if there is one."""
    counted = term_tallies(df, items, df.count(), *map(F.col, by))
    return counted.select(*[F.col("name").cast(df.schema[c].dataType).alias(c) for c in by], F.col("term").alias(name), F.col("n").alias("count"))


def _top(counted: DataFrame, name: str, n: int, by: list[str]) -> DataFrame:
    if not by:
        return counted.orderBy(F.desc("count"), name).limit(n)
    ranks = Window.partitionBy(*by).orderBy(F.desc("count"), name)
    return counted.withColumn("rank", F.row_number().over(ranks)).filter(F.col("rank") <= n)


def word_counts(df: DataFrame, column: str = "clean_text", n: int = 30) -> DataFrame:
    return _top(_counted(df, words(F.col(column)), "word", []), "word", n, [])


def top_words_by_class(
    df: DataFrame, column: str = "clean_text_no_stopwords", label: str = "sentiment_label", n: int = 20
) -> DataFrame:
    known = df.filter(F.col(label).isNotNull())
    return _top(_counted(known, words(F.col(column)), "word", [label]), "word", n, [label])


def _bigram_counts(df: DataFrame, column: str, stop_words: list[str], by: list[str]) -> DataFrame:
    """Stop words go before pairing, so a pair may bridge one."""
    kept = without(tokenize_words(F.col(column)), stop_words)
    return _counted(df, bigrams(kept), "bigram", by)


def bigram_counts(
    df: DataFrame, column: str = "clean_text", n: int = 30, stop_words: list[str] = ENGLISH_STOP_WORDS
) -> DataFrame:
    return _top(_bigram_counts(df, column, stop_words, []), "bigram", n, [])


def bigrams_by_class(
    df: DataFrame,
    column: str = "clean_text",
    label: str = "sentiment_label",
    n: int = 20,
    stop_words: list[str] = ENGLISH_STOP_WORDS,
) -> DataFrame:
    known = df.filter(F.col(label).isNotNull())
    return _top(_bigram_counts(known, column, stop_words, [label]), "bigram", n, [label])


def token_length_stats(df: DataFrame, tokens: Column, limit: int = 128) -> DataFrame:
    """Percent of rows above a token limit, median and 95th percentile of the token count.

    ``tokens`` is any expression that gives an array; word tokens are the usual one.
    """
    counts = value_counts(df, F.size(tokens), [])
    over = counts.agg(
        F.try_divide(F.sum(F.when(F.col("value") > limit, F.col("n")).otherwise(0)) * 100.0, F.sum("n"))
    )
    places = percentiles_of_counts(counts, [0.5, 0.95], ["median", "p95"], [])
    return places.select(over.scalar().alias("pct_over"), "median", "p95")
