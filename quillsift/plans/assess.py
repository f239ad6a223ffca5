"""One job over the predictions of fitted models: which is best, by how much, and where text and rating disagree."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.operators import evaluate as E
from quillsift.operators import mismatch as X
from quillsift.operators.classify import score_table
from quillsift.operators.joins import union_batches


def predictions(models: dict[str, PipelineModel], test: DataFrame, *more: str) -> DataFrame:
    """The prediction tables of all models, stacked, with the name of the model and further columns of ``test``."""
    scored = [score_table(model, test, *more).select(F.lit(name).alias("model"), "*") for name, model in models.items()]
    return union_batches(scored)


def side_by_side(stacked: DataFrame, first: str, second: str) -> DataFrame:
    """A row per review with the labels of two models."""

    def label(name: str) -> Column:
        return F.max(F.when(F.col("model") == name, F.col("predicted_label")))

    pairs = stacked.where(F.col("model").isin(first, second)).groupBy("review_id", "true_label")
    return pairs.agg(label(first).alias("predicted_label"), label(second).alias("other_label"))


def assess(stacked: DataFrame, first: str, second: str, judge: str) -> dict[str, DataFrame]:
    """The tables of the job over stored predictions (``predictions`` with ``rating``).

    ``comparison``: all models; ``gain``: the bootstrap of ``first`` over ``second``; ``mismatches``,
    ``mismatch_confidence`` and ``errors``: by the predictions of ``judge``, whose confidences are shares.
    """
    judged = stacked.where(F.col("model") == judge)
    return {
        "comparison": E.model_comparison(stacked),
        "gain": E.bootstrap_macro_f1_diff(side_by_side(stacked, first, second), "predicted_label", "other_label"),
        "mismatches": X.mismatch_rates(judged),
        "mismatch_confidence": X.mean_confidence_mismatch(judged),
        "errors": E.error_samples_by_class(judged.select("review_id", "true_label", "predicted_label")),
    }
