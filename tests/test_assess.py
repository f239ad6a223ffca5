"""The job over the predictions of several models."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors

from quillsift.operators.linear import LinearScores
from quillsift.plans.assess import assess, predictions, side_by_side


def _model(rows):
    """Shares from the products with fixed weights."""
    return PipelineModel([LinearScores(link="softmax").of(np.array(rows))])


@pytest.fixture(scope="module")
def stacked(spark):
    names = ["negative", "neutral", "positive"]
    rows = [(i, f"text {i}", names[i % 3], float(1 + 2 * (i % 3)), Vectors.sparse(3, {i % 3: 4.0})) for i in range(30)]
    test = spark.createDataFrame(rows, ["review_id", "text", "sentiment_label", "rating", "features"])
    right = np.column_stack([np.eye(3), np.zeros(3)])
    turned = right[[2, 1, 0]]
    return predictions({"right": _model(right), "turned": _model(turned)}, test, "rating").persist()


def test_predictions_of_all_models_are_stacked(stacked):
    assert stacked.columns == ["model", "review_id", "text", "true_label", "predicted_label", "confidence", "rating"]
    assert {(r["model"], r["count"]) for r in stacked.groupBy("model").count().collect()} == {("right", 30), ("turned", 30)}


def test_labels_of_two_models_side_by_side(stacked):
    rows = side_by_side(stacked, "right", "turned").collect()
    assert len(rows) == 30
    for r in rows:
        assert r["predicted_label"] == r["true_label"]
        assert (r["other_label"] == r["true_label"]) == (r["true_label"] == "neutral")


def test_tables_of_the_job(stacked):
    tables = assess(stacked, "right", "turned", "turned")
    scores = {r["model"]: r["macro_f1"] for r in tables["comparison"].collect()}
    assert scores == {"right": 1.0, "turned": pytest.approx(1 / 3)}
    gain = tables["gain"].head()
    assert gain["observed_diff"] == pytest.approx(2 / 3) and gain["share_no_gain"] == 0
    stars = {r["kind"]: (r["star_total"], r["count"]) for r in tables["mismatches"].collect()}
    assert stars == {"5star_negative": (10, 10), "1star_positive": (10, 10)}
    assert {r["kind"] for r in tables["mismatch_confidence"].collect()} == set(stars)
    assert tables["errors"].where("part = 'negative'").count() == 10
