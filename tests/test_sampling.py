"""Samples and splits: sizes, proportions, and the same rows however they are spread."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillsift.operators import sampling as S


@pytest.fixture(scope="module")
def rows(spark):
    """One class holds 82 % of the rows."""
    label = F.when(F.col("review_id") % 100 < 11, "negative").when(F.col("review_id") % 100 < 18, "neutral").otherwise("positive")
    return spark.range(5003).withColumnRenamed("id", "review_id").withColumn("sentiment_label", label).persist()


def ids(df):
    return sorted(r["review_id"] for r in df.select("review_id").collect())


def test_sample_is_the_smallest_keys(rows):
    keyed = rows.withColumn("k", S.sample_key(42)).collect()
    expected = sorted(r["review_id"] for r in sorted(keyed, key=lambda r: (r["k"], r["review_id"]))[:777])
    assert ids(S.reservoir_sample(rows, 777)) == expected
    assert ids(S.reservoir_sample(rows.repartition(13), 777)) == expected
    assert ids(S.sample_n(rows, 777, seed=1)) != expected


def test_sample_larger_than_the_table(rows):
    assert ids(S.sample_n(rows, 10**9)) == list(range(5003))
    assert ids(S.sample_n(rows, 0)) == []


def test_rank_is_a_permutation_per_group(rows):
    ranked = S.random_rank(rows, 42, ["sentiment_label"], bits=5).collect()
    for label, n in Counter(r["sentiment_label"] for r in ranked).items():
        assert sorted(r["rank"] for r in ranked if r["sentiment_label"] == label) == list(range(1, n + 1))


@pytest.mark.parametrize("bits", [1, 8, 16])
def test_rank_does_not_depend_on_the_slices(rows, bits):
    mine = sorted(S.random_rank(rows, 7, bits=bits).collect())
    assert mine == sorted(S.random_rank(rows.repartition(3), 7, bits=12).collect())


def test_per_group_samples(rows):
    taken = S.sample_n_per_group(rows, "sentiment_label", 50).collect()
    assert set(Counter(r["sentiment_label"] for r in taken).values()) == {50}
    totals = Counter(r["sentiment_label"] for r in rows.collect())
    part = Counter(r["sentiment_label"] for r in S.sample_frac_per_group(rows, "sentiment_label", 0.25).collect())
    assert part == {c: round(0.25 * n) for c, n in totals.items()}


def test_split_quotas(rows):
    split = S.persist_split(rows).collect()
    assert len(split) == 5003 and len({r["review_id"] for r in split}) == 5003
    totals = Counter(r["sentiment_label"] for r in split)
    test = Counter(r["sentiment_label"] for r in split if r["split"] == "test")
    assert sum(test.values()) == math.ceil(0.2 * 5003)
    assert all(abs(test[c] - 0.2 * n) <= 1 for c, n in totals.items())
    again = S.persist_split(rows.repartition(9)).collect()
    assert sorted(again) == sorted(split)
    kept = ids(S.lookup_split(rows, S.persist_split(rows), "train"))
    assert len(kept) == 5003 - math.ceil(0.2 * 5003)


def test_split_takes_the_smallest_keys_of_each_class(rows):
    split = S.stratified_split(rows).withColumn("k", S.sample_key(42)).collect()
    for label in ("negative", "neutral", "positive"):
        mine = sorted((r for r in split if r["sentiment_label"] == label), key=lambda r: (r["k"], r["review_id"]))
        sides = [r["split"] for r in mine]
        assert sides == sorted(sides) and set(sides) == {"test", "train"}


def test_split_leaves_wide_rows_in_place(spark, rows):
    """No text passes a shuffle; the written cuts are the only other table of the plan."""
    wide = S.stratified_split(rows.withColumn("text", F.repeat(F.lit("x"), 50)))
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_rows_without_a_class_are_kept(spark):
    rows = spark.createDataFrame([(i, None if i % 4 == 0 else "a") for i in range(40)], "review_id long, sentiment_label string")
    split = S.stratified_split(rows).collect()
    assert len(split) == 40 and sum(r["split"] == "test" for r in split) == 8


def test_folds_are_even(rows):
    folds = S.stratified_kfold(rows, folds=3).collect()
    for label in ("negative", "neutral", "positive"):
        sizes = Counter(r["fold"] for r in folds if r["sentiment_label"] == label)
        assert set(sizes) == {0, 1, 2} and max(sizes.values()) - min(sizes.values()) <= 1


def test_topic_examples(spark):
    rows = spark.range(3000).select(F.col("id").alias("review_id"), F.when(F.col("id") % 3 > 0, "hot").otherwise("b").alias("topic_label"))
    taken = S.topic_examples(rows).collect()
    assert Counter(r["topic_label"] for r in taken) == {"hot": 10, "b": 10}
    assert max(r["review_id"] for r in taken if r["topic_label"] == "b") < 600
    assert max(r["review_id"] for r in taken if r["topic_label"] == "hot") < 302
