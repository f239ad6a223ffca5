"""Sentiment classifiers, their calibration and scoring."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillsift.functions.arrays import fenced, row_argmax, row_max
from quillsift.functions.columns import LABELS, label_id, label_name
from quillsift.functions.text import truncate_tokens
from quillsift.operators import linear as L
from quillsift.operators.boosting import NODE, TreeScores, fit_trees
from quillsift.operators.features import CleanText, Terms, tfidf_features
from quillsift.session import cut_lineage

CLASSES = len(LABELS)


def add_label(df: DataFrame, label: str = "sentiment_label") -> DataFrame:
    """Class id as the double that Spark ML expects."""
    return df.withColumn("label", label_id(label).cast("double"))


def _features(df: DataFrame, features: str, *more: str) -> DataFrame:
    """The labelled rows of a fit: label, the parts of the vector, and further columns."""
    return df.where(F.col("label").isNotNull()).select("label", *L.entries(features), *more)


def _width(df: DataFrame, features: str) -> int:
    """Length of the vectors."""
    parts = F.unwrap_udt(F.col(features))
    found = df.select(F.coalesce(parts["size"], F.size(parts["values"])).alias("n")).head()
    return found["n"] if found else 0


_WEIGHTS = "number int, weights array<double>"


def _as_table(weights: np.ndarray) -> pa.Table:
    return pa.table({"number": pa.array(range(len(weights)), pa.int32()), "weights": pa.array(list(weights), pa.list_(pa.float64()))})


def _fit_linear(df: DataFrame, features: str, fit: Callable, in_blocks: Callable) -> np.ndarray:
    """Weights of one fit over all rows: (classes, width + 1). ``fit`` takes rows that one task can hold, ``in_blocks`` any number."""
    width = _width(df, features)

    def run(table: pa.Table) -> pa.Table:
        labels, rows = L.packed(table)
        return _as_table(fit(replace(rows, shape=(len(labels), width)), labels))

    rows = _features(df, features)
    if not L.in_bounds(rows, F.size("values")):
        with L.Blocks.of(rows, width) as blocks:
            return in_blocks(blocks)
    fitted = L.in_one_task(rows, run, _WEIGHTS).orderBy("number").collect()
    return np.array([r["weights"] for r in fitted]) if fitted else np.zeros((CLASSES, width + 1))


def train_logreg(
    df: DataFrame,
    c: float = 1.0,
    max_iter: int = 1000,
    features: str = "features",
    tolerance: float = 1e-5,
) -> PipelineModel:
    """Multinomial logistic regression with balanced classes; ``c`` is the inverse penalty per row.

    ``max_iter`` limits the Newton steps, of which a fit takes some ten until the gradient has fallen to
    ``tolerance`` of the first one.
    """
    how = {"classes": CLASSES, "c": c, "tolerance": tolerance, "max_iter": max_iter}
    weights = _fit_linear(df, features, partial(L.fit_softmax, **how), partial(L.softmax_in_blocks, **how))
    return PipelineModel([L.LinearScores(inputCol=features, link="softmax", classes=CLASSES).of(weights)])


def train_linear_svc(
    df: DataFrame,
    c: float = 1.0,
    max_iter: int = 100,
    features: str = "features",
    tolerance: float = 1e-5,
) -> PipelineModel:
    """Linear SVM with squared hinge loss, one against the rest; the largest margin gives the class."""
    how = {"classes": CLASSES, "c": c, "tolerance": tolerance, "max_iter": max_iter}
    weights = _fit_linear(df, features, partial(L.fit_hinge, **how), partial(L.hinge_in_blocks, held=[None], **how))
    return PipelineModel([L.LinearScores(inputCol=features, link="margin", classes=CLASSES).of(weights)])


def calibrate_sigmoid(
    df: DataFrame,
    fold: str = "fold",
    folds: int = 3,
    c: float = 1.0,
    max_iter: int = 100,
    features: str = "features",
    tolerance: float = 1e-5,
) -> PipelineModel:
    """Linear SVMs fitted without each fold and calibrated on it; scores average over the folds.

    A fold is one task: the SVMs of all classes on the rows outside, then a sigmoid per class from the margins
    of the rows inside; with more rows than a task holds, the models of all folds are fitted side by side in passes over
    all rows. The class is the largest mean probability, which need not be the largest margin.
    """
    width = _width(df, features)
    rows = _features(df.withColumn("_fold", F.col(fold).cast("int")), features, "_fold")
    if not L.in_bounds(rows, F.size("values")):
        with L.Blocks.of(rows, width, "_fold") as blocks:
            weights = L.hinge_in_blocks(blocks, [*range(folds)], CLASSES, c, tolerance, max_iter)
            slopes, offsets = L.sigmoids_in_blocks(blocks, weights, folds, CLASSES).tolist()
        return PipelineModel([L.LinearScores(inputCol=features, link="sigmoids", classes=CLASSES, slopes=slopes, offsets=offsets).of(weights)])
    # Every fold reads all rows, so a row goes to each of them.
    tasks = rows.withColumn("held", F.explode(F.array(*map(F.lit, range(folds))))).repartition(8 * folds, "held")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        labels, packed = L.packed(table)
        packed = replace(packed, shape=(len(labels), width))
        inside = table.column("_fold").to_numpy(zero_copy_only=False) == key[0].as_py()
        weights = L.fit_hinge(packed.where(~inside), labels[~inside], CLASSES, c, tolerance, max_iter)
        margin = packed.where(inside).times(np.ascontiguousarray(weights[:, :-1].T)) + weights[:, -1]
        pairs = [L.fit_sigmoid(margin[:, k], labels[inside] == k) for k in range(CLASSES)]
        number = pa.array([key[0].as_py() * CLASSES + k for k in range(CLASSES)], pa.int32())
        return _as_table(weights).set_column(0, "number", number).append_column("pair", pa.array(pairs, pa.list_(pa.float64())))

    fitted = tasks.groupBy("held").applyInArrow(run, f"{_WEIGHTS}, pair array<double>").orderBy("number").collect()
    if not fitted:
        return PipelineModel([L.LinearScores(inputCol=features, link="softmax").of(np.zeros((CLASSES, width + 1)))])
    scores = L.LinearScores(
        inputCol=features,
        link="sigmoids",
        classes=CLASSES,
        slopes=[r["pair"][0] for r in fitted],
        offsets=[r["pair"][1] for r in fitted],
    )
    return PipelineModel([scores.of(np.array([r["weights"] for r in fitted]).reshape(len(fitted), width + 1))])


def train_boosted_trees(
    df: DataFrame,
    trees: int = 300,
    leaves: int = 63,
    rate: float = 0.1,
    bins: int = 32,
    least_rows: int = 20,
    features: str = "features",
) -> PipelineModel:
    """Boosted trees on all features and labelled rows: a tree per class and round on the softmax margins, balanced classes.

    Trees grow leaf by leaf up to ``leaves``; a leaf has ``least_rows`` rows or more. One task fits them and holds all
    entries in memory, see ``boosting``.
    """

    def run(table: pa.Table) -> pa.Table:
        labels, rows = L.packed(table)
        nodes = fit_trees(rows, labels, CLASSES, trees, leaves, rate, bins, least_rows)
        kinds = [pa.int32()] * 4 + [pa.float64()] + [pa.int32()] * 2 + [pa.float64()]
        names = [part.split()[0] for part in NODE.split(", ")]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, zip(*nodes), kinds)})

    nodes = L.in_one_task(_features(df, features), run, NODE).collect()
    return PipelineModel([TreeScores(inputCol=features, classes=CLASSES).of([tuple(r) for r in nodes])])


def end_to_end_model(
    df: DataFrame, train, text: str = "full_text", cleaned: bool = False, **feature_options
) -> PipelineModel:
    """Text to class as one model that can be stored: clean, terms, tf-idf, classifier.

    ``train`` takes a frame with ``label`` and ``features`` and returns the fitted classifier. Where
    the job has the text ``cleaned`` in a column already, the model starts from that.
    """
    clean = [] if cleaned else [CleanText(inputCol=text, outputCol="_clean")]
    terms = Terms(inputCol=text if cleaned else "_clean", outputCol="terms")
    first = PipelineModel([*clean, terms])
    prepared = cut_lineage(first.transform(df).select("label", "terms"))
    tfidf = tfidf_features(prepared, **feature_options)
    classifier = train(cut_lineage(tfidf.transform(prepared).select("label", "features")))
    return PipelineModel([*first.stages, *tfidf.stages, *classifier.stages])


def score_table(model: PipelineModel, df: DataFrame, *more: str, true: str = "sentiment_label") -> DataFrame:
    """Key, text, true and predicted label, and the confidence: the largest class probability; then further columns.

    For models that give margins and no probabilities the confidence is the largest margin.
    """
    return model.transform(df).select(
        "review_id",
        "text",
        F.col(true).alias("true_label"),
        label_name(row_argmax(F.col("scores"))).alias("predicted_label"),
        row_max(F.col("scores")).alias("confidence"),
        *more,
    )


def first_words(text: Column, limit: int = 128) -> Column:
    """What a model limited to ``limit`` tokens can see: no word makes less than one token."""
    return F.array_join(truncate_tokens(F.split(F.trim(text), r"\s+"), limit), " ")


def batch_model_scoring(
    df: DataFrame,
    make_model,
    labels: list[str] = LABELS,
    text: str = "full_text",
    batch_size: int = 64,
    max_tokens: int | None = None,
) -> DataFrame:
    """Score texts with a pretrained model, in batches.

    ``make_model`` runs once per Python worker and returns a function from an array of texts to an
    array of class probabilities, in the order of ``labels``. It gets whole texts, or their first ``max_tokens`` words. The call is marked as not
    deterministic, so that Spark does not repeat it for each use of the probabilities.
    """
    score = predict_batch_udf(make_model, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    seen = first_words(F.col(text), max_tokens) if max_tokens else F.col(text)
    ready = df.withColumn("_seen", fenced(seen))
    scored = ready.withColumn("probabilities", score.asNondeterministic()(F.col("_seen"))).drop("_seen")
    return scored.withColumns(
        {
            "predicted_label": label_name(row_argmax(F.col("probabilities")), labels),
            "confidence": row_max(F.col("probabilities")).cast("double"),
        }
    )


