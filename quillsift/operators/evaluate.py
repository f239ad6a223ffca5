"""Metrics of predicted labels, all taken from one count per pair of true and predicted label."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.evaluation import Evaluator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.functions.columns import LABELS
from quillsift.operators.sampling import sample_n, sample_n_per_group
from quillsift.operators.topk import error_rows


def _or_zero(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def _mean(columns: list[Column]) -> Column:
    return sum(columns[1:], columns[0]) / float(len(columns))


def _tallies(df: DataFrame, true: str, predicted: str, labels: list[str], by: list[str]) -> DataFrame:
    """Per label the hits, predictions and true rows; one row per group."""
    is_true = [F.col(true) == F.lit(c) for c in labels]
    is_predicted = [F.col(predicted) == F.lit(c) for c in labels]
    aggregates = [F.count("*").alias("n"), F.count_if(F.col(true) == F.col(predicted)).alias("hits")]
    for i in range(len(labels)):
        aggregates += [
            F.count_if(is_true[i] & is_predicted[i]).alias(f"hit{i}"),
            F.count_if(is_predicted[i]).alias(f"predicted{i}"),
            F.count_if(is_true[i]).alias(f"support{i}"),
        ]
    return df.groupBy(*by).agg(*aggregates)


def _class_scores(i: int) -> tuple[Column, Column, Column, Column]:
    hit, predicted, support = (F.col(f"{name}{i}") for name in ("hit", "predicted", "support"))
    return _or_zero(hit, predicted), _or_zero(hit, support), _or_zero(2 * hit, predicted + support), support


def confusion_matrix(
    df: DataFrame, true: str = "true_label", predicted: str = "predicted_label", labels: list[str] = LABELS
) -> DataFrame:
    """Counts of predicted labels (columns) for each of ``labels`` as true label, in their order; absent ones are 0."""
    cells = [
        F.count_if((F.col(true) == t) & (F.col(predicted) == c)).alias(f"cell_{i}_{j}")
        for i, t in enumerate(labels)
        for j, c in enumerate(labels)
    ]
    rows = [
        F.struct(F.lit(t).alias(true), *(F.col(f"cell_{i}_{j}").alias(c) for j, c in enumerate(labels)))
        for i, t in enumerate(labels)
    ]
    return df.agg(*cells).select(F.inline(F.array(*rows)))


def classification_report(
    df: DataFrame, true: str = "true_label", predicted: str = "predicted_label", labels: list[str] = LABELS
) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted averages."""
    tallies = _tallies(df, true, predicted, labels, [])
    scores = [_class_scores(i) for i in range(len(labels))]
    supports = [s[3] for s in scores]
    all_support = sum(supports[1:], supports[0])

    def row(name: str, precision: Column, recall: Column, f1: Column, support: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"),
            precision.alias("precision"),
            recall.alias("recall"),
            f1.alias("f1"),
            support.cast("bigint").alias("support"),
        )

    def weighted(k: int) -> Column:
        parts = [s[k] * s[3] for s in scores]
        return _or_zero(sum(parts[1:], parts[0]), all_support)

    none = F.lit(None).cast("double")
    rows = [row(name, *score) for name, score in zip(labels, scores)]
    rows.append(row("accuracy", none, none, _or_zero(F.col("hits"), F.col("n")), F.col("n")))
    rows.append(row("macro avg", *[_mean([s[k] for s in scores]) for k in range(3)], all_support))
    rows.append(row("weighted avg", *[weighted(k) for k in range(3)], all_support))
    return tallies.select(F.inline(F.array(*rows)))


def model_comparison(
    df: DataFrame,
    model: str = "model",
    true: str = "true_label",
    predicted: str = "predicted_label",
    labels: list[str] = LABELS,
) -> DataFrame:
    """Accuracy, macro F1 and weighted F1 per model, over stacked predictions."""
    tallies = _tallies(df, true, predicted, labels, [model])
    scores = [_class_scores(i) for i in range(len(labels))]
    weighted = [s[2] * s[3] for s in scores]
    supports = [s[3] for s in scores]
    return tallies.select(
        model,
        _or_zero(F.col("hits"), F.col("n")).alias("accuracy"),
        _mean([s[2] for s in scores]).alias("macro_f1"),
        _or_zero(sum(weighted[1:], weighted[0]), sum(supports[1:], supports[0])).alias("weighted_f1"),
    )


def metrics(df: DataFrame, true: str = "true_label", predicted: str = "predicted_label", labels: list[str] = LABELS) -> DataFrame:
    """Accuracy, macro F1 and weighted F1 of one model."""
    return model_comparison(df.withColumn("_model", F.lit(0)), "_model", true, predicted, labels).drop("_model")


def accuracy(df: DataFrame, **columns) -> DataFrame:
    return metrics(df, **columns).select("accuracy")


def macro_f1(df: DataFrame, **columns) -> DataFrame:
    return metrics(df, **columns).select("macro_f1")


def weighted_f1(df: DataFrame, **columns) -> DataFrame:
    return metrics(df, **columns).select("weighted_f1")


def model_comparison_long(comparison: DataFrame, model: str = "model") -> DataFrame:
    """Rows of model, metric and score."""
    return comparison.unpivot(model, ["accuracy", "macro_f1", "weighted_f1"], "metric", "score")


def nested_report(df: DataFrame, **columns) -> DataFrame:
    """The report and summary metrics as one row of nested values, ready to be written as JSON."""
    report = classification_report(df, **columns)
    entry = F.struct("precision", "recall", F.col("f1").alias("f1-score"), "support")
    classes = report.agg(F.map_from_entries(F.collect_list(F.struct(F.col("class"), entry))).alias("report"))
    # One row per summary name: six entries in all.
    get = lambda name: F.col("report")[name]["f1-score"]
    return classes.select(
        get("accuracy").alias("test_accuracy"),
        get("macro avg").alias("test_macro_f1"),
        get("weighted avg").alias("test_weighted_f1"),
        "report",
    )


def error_samples_by_class(df: DataFrame, n: int = 10, seed: int = 42) -> DataFrame:
    """Up to ``n`` random errors: over all, and of each true class."""
    errors = error_rows(df)
    overall = sample_n(errors, n, seed).withColumn("part", F.lit("all"))
    per_class = sample_n_per_group(errors, "true_label", n, seed).withColumn("part", F.col("true_label"))
    return overall.unionByName(per_class)


def bootstrap_macro_f1_diff(
    df: DataFrame,
    first: str,
    second: str,
    true: str = "true_label",
    resamples: int = 1000,
    seed: int = 42,
    labels: list[str] = LABELS,
) -> DataFrame:
    """Bootstrap of the difference in macro F1, ``first`` minus ``second``.

    Macro F1 depends only on how often each triple (true, first, second) occurs. Drawing n rows with
    replacement is one multinomial draw over these triples (27 for three classes), so the table is
    counted once and each resample costs 27 numbers instead of n rows.
    """
    k = len(labels)
    listed = [F.col(c).isin(*labels) for c in (true, first, second)]
    cells = df.filter(listed[0] & listed[1] & listed[2]).groupBy(true, first, second).agg(F.count("*").alias("n"))
    place = {name: i for i, name in enumerate(labels)}
    table = np.zeros((k, k, k), dtype=np.int64)
    for row in cells.collect():
        table[place[row[0]], place[row[1]], place[row[2]]] = row[3]

    def macro(pairs: np.ndarray) -> float:
        hits, sizes = np.diagonal(pairs), pairs.sum(axis=0) + pairs.sum(axis=1)
        return float(np.mean(np.where(sizes > 0, 2 * hits / np.maximum(sizes, 1), 0.0)))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = int(table.sum())
        shares = (table / max(total, 1)).ravel()
        for batch in batches:
            diffs = []
            for i in batch["id"]:
                counts = np.random.default_rng([seed, int(i)]).multinomial(total, shares).reshape(table.shape)
                diffs.append(macro(counts.sum(axis=2)) - macro(counts.sum(axis=1)))
            yield pd.DataFrame({"diff": diffs})

    diffs = df.sparkSession.range(resamples).mapInPandas(draw, "diff double")
    return diffs.agg(
        F.lit(macro(table.sum(axis=2)) - macro(table.sum(axis=1))).alias("observed_diff"),
        F.avg("diff").alias("mean_diff"),
        F.percentile("diff", F.lit(0.025)).alias("ci_low"),
        F.percentile("diff", F.lit(0.975)).alias("ci_high"),
        F.avg((F.col("diff") <= 0).cast("int")).alias("share_no_gain"),
    )


class MacroF1(Evaluator):
    """Macro F1 over a fixed number of classes, for model selection; an absent class counts as 0."""

    def __init__(self, classes: int = len(LABELS), label: str = "label", prediction: str = "prediction"):
        super().__init__()
        self.classes, self.label, self.prediction = classes, label, prediction

    def _evaluate(self, dataset: DataFrame) -> float:
        ids = [float(i) for i in range(self.classes)]
        return macro_f1(dataset, true=self.label, predicted=self.prediction, labels=ids).head()[0]

    def isLargerBetter(self) -> bool:
        return True
