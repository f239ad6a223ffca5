"""Features, classifiers, calibration, metrics and scoring."""

import inspect
import json
import threading
from functools import partial
from unittest.mock import MagicMock

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from quillsift.functions.arrays import softmax
from quillsift.functions.columns import LABELS, full_text
from quillsift.operators import classify as M
from quillsift.operators import evaluate as E
from quillsift.operators import boosting, linear
from quillsift.operators import features as V
from quillsift.operators import search as S
from quillsift.operators.boosting import Binned, Forest, fit_trees, grow
from quillsift.operators.linear import LinearScores
from quillsift.operators.sampling import stratified_kfold, stratified_split
from quillsift.plans.catalog import models as catalog
from quillsift.plans.catalog.models import _dataset, keyword_model
from quillsift.plans.enrich import fit_topics, prepare, score_and_topic
from quillsift.plans.registry import QUERIES
from quillsift.session import scratch_path
from quillsift.sources.sinks import sink_metrics_json
from quillsift.sources.tables import reviews, scored_reviews, timed_reviews


@pytest.fixture(scope="module")
def data(spark, sf_dir):
    return _dataset(spark, sf_dir).persist()


@pytest.fixture(scope="module")
def vectors(data):
    terms = V.Terms(inputCol="clean_text", outputCol="terms").transform(data)
    tfidf = V.tfidf_features(terms.filter("split = 'train'"), min_df=3)
    done = tfidf.transform(terms).select("review_id", "text", "sentiment_label", "label", "split", "features").persist()
    return done.filter("split = 'train'"), done.filter("split = 'test'")


def majority(df):
    """Macro F1 of always naming the largest class."""
    shares = [r["count"] for r in df.groupBy("sentiment_label").count().collect()]
    best = max(shares) / sum(shares)
    return 2 * best / (1 + best) / 3


def test_tfidf_rows_have_unit_length(vectors):
    train, _ = vectors
    for r in train.limit(20).collect():
        norm = float(r["features"].norm(2))
        assert norm == pytest.approx(1.0) or norm == 0.0


def test_vector_parts_round_trip(vectors):
    train, _ = vectors
    parts = V.vector_entries(F.col("features"))
    back = train.select("features", V.sparse_vector(parts["size"], parts["indices"], parts["values"]).alias("back"))
    assert all(r["features"] == r["back"] for r in back.limit(20).collect())


def test_class_weights(spark):
    rows = spark.createDataFrame([("a",)] * 6 + [("b",)] * 3 + [("c",)], "sentiment_label string")
    assert {r["sentiment_label"]: r["weight"] for r in V.class_weights(rows).collect()} == pytest.approx(
        {"a": 10 / 18, "b": 10 / 9, "c": 10 / 3}
    )


@pytest.mark.parametrize("train", [M.train_logreg, M.train_linear_svc])
def test_linear_models_beat_the_majority(vectors, train):
    rows, test = vectors
    scored = M.score_table(train(rows, max_iter=10), test)
    assert E.macro_f1(scored).head()[0] > majority(test) + 0.1


def test_boosted_trees_beat_the_majority_and_survive_storage(spark, vectors):
    rows, test = vectors
    model = M.train_boosted_trees(rows, trees=30)
    scored = M.score_table(model, test)
    assert E.macro_f1(scored).head()[0] > majority(test)
    path = scratch_path(spark, "trees")
    model.write().save(path)
    assert sorted(M.score_table(PipelineModel.load(path), test).collect()) == sorted(scored.collect())


def test_calibrated_scores_are_probabilities_and_survive_storage(spark, vectors):
    rows, test = vectors
    folded = rows.join(stratified_kfold(rows).select("review_id", "fold"), "review_id").persist()
    model = M.calibrate_sigmoid(folded, max_iter=5)
    scored = model.transform(test).select("review_id", "scores", "prediction").collect()
    for r in scored:
        assert sum(r["scores"]) == pytest.approx(1.0) and min(r["scores"]) >= 0
        assert r["prediction"] == int(np.argmax(r["scores"]))
    assert E.macro_f1(M.score_table(model, test)).head()[0] > majority(test)
    path = scratch_path(spark, "calibrated")
    model.write().save(path)
    again = PipelineModel.load(path).transform(test).select("review_id", "scores", "prediction").collect()
    assert sorted(again) == sorted(scored)


def test_mean_sigmoid_by_hand(spark):
    margins = np.array([[0.5, -1.0, 0.2], [1.5, 0.0, -0.3]])
    slopes, offsets = [1.0, 2.0, 0.5, 1.5, 1.0, 3.0], [0.0, 0.1, -0.2, 0.3, 0.0, 0.4]
    model = LinearScores(link="sigmoids", classes=3, slopes=slopes, offsets=offsets).of(np.column_stack([margins.ravel(), np.zeros(6)]))
    rows = spark.createDataFrame([(Vectors.dense([1.0]),), (Vectors.sparse(1, {}),)], ["features"])
    got = [r["scores"] for r in model.transform(rows).collect()]
    for scores, flat in zip(got, (margins.ravel(), np.zeros(6))):
        p = 1 / (1 + np.exp(-(flat * slopes + offsets))).reshape(2, 3)
        assert scores == pytest.approx(list((p / p.sum(axis=1, keepdims=True)).mean(axis=0)))


def _rows(spark, n=90, width=12, seed=1):
    """Sparse rows of three classes, some of them hard to tell apart."""
    rng = np.random.default_rng(seed)
    x = np.where(rng.random((n, width)) < 0.4, rng.random((n, width)), 0.0)
    y = rng.integers(0, 3, n) * (rng.random(n) < 0.8)
    x[np.arange(n), y] += 0.7
    frame = [(float(c), Vectors.sparse(width, {j: float(v) for j, v in enumerate(row) if v})) for c, row in zip(y, x)]
    return x, y, spark.createDataFrame(frame, ["label", "features"]).repartition(3)


def _descend(loss, w, steps=30_000, rate=0.5):
    """Plain gradient descent with backtracking: slow, and nothing like the solver."""
    value, slope = loss(w)
    for _ in range(steps):
        if np.abs(slope).max() < 1e-7:
            break
        while True:
            new = w - rate * slope
            new_value, new_slope = loss(new)
            if new_value <= value - 0.5 * rate * (slope**2).sum() + 1e-13 * abs(value):
                break
            rate /= 2
        w, value, slope, rate = new, new_value, new_slope, rate * 1.1
    return w


@pytest.mark.parametrize("share", [0.02, 2.0])
def test_logreg_is_the_minimum_of_its_loss(spark, monkeypatch, share):
    """Whether the columns are in the dense block or not."""
    monkeypatch.setattr(linear, "DENSE_SHARE", share)
    x, y, frame = _rows(spark)
    weight = (len(y) / (3 * np.bincount(y)))[y]
    ones = np.column_stack([x, np.ones(len(x))])

    def loss(w):
        z = ones @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        kept = w * np.array([1.0] * x.shape[1] + [0.0])[:, None]
        value = -(weight * np.log(p[np.arange(len(y)), y])).sum() + 0.5 / 2.0 * (kept**2).sum()
        return value, ones.T @ (weight[:, None] * (p - np.eye(3)[y])) + kept / 2.0

    model = M.train_logreg(frame, c=2.0, tolerance=1e-9).stages[0]
    want = _descend(loss, np.zeros((13, 3)), rate=0.01)
    assert model.weights[:, :-1].T == pytest.approx(want[:-1], abs=2e-3)
    assert loss(model.weights.T)[0] <= loss(want)[0] + 1e-4


def test_svc_is_the_minimum_of_its_loss(spark):
    x, y, frame = _rows(spark, seed=2)
    ones = np.column_stack([x, np.ones(len(x))])
    model = M.train_linear_svc(frame, c=0.7, tolerance=1e-9).stages[0]
    for k in range(3):
        sign = np.where(y == k, 1.0, -1.0)
        weight = np.where(y == k, len(y) / (3 * (y == k).sum()), 1.0)

        def loss(w):
            short = np.maximum(0, 1 - sign * (ones @ w))
            return 0.5 * w @ w + 0.7 * (weight * short**2).sum(), w - 1.4 * ones.T @ (weight * sign * short)

        assert model.weights[k] == pytest.approx(_descend(loss, np.zeros(13), rate=0.01), abs=1e-4)


def test_calibration_equals_the_same_steps_by_hand(spark):
    x, y, frame = _rows(spark, seed=3)
    folded = frame.withColumn("fold", F.pmod(F.xxhash64("features"), F.lit(3)).cast("int")).persist()
    model = M.calibrate_sigmoid(folded, tolerance=1e-9).stages[0]
    for f in range(3):
        alone = M.train_linear_svc(folded.where(F.col("fold") != f), tolerance=1e-9).stages[0]
        assert model.weights[3 * f : 3 * f + 3] == pytest.approx(alone.weights, abs=1e-6)
        held = folded.where(F.col("fold") == f).collect()
        for k in range(3):
            margin = np.array([r["features"].toArray() @ alone.weights[k, :-1] + alone.weights[k, -1] for r in held])
            hit = np.array([r["label"] == k for r in held])
            target = np.where(hit, (hit.sum() + 1) / (hit.sum() + 2), 1 / ((~hit).sum() + 2))

            def loss(w):
                p = 1 / (1 + np.exp(-(w[0] * margin + w[1])))
                return -(target * np.log(p) + (1 - target) * np.log(1 - p)).sum(), np.array([((p - target) * margin).sum(), (p - target).sum()])

            want = _descend(loss, np.zeros(2))
            got = [model.getOrDefault(p)[3 * f + k] for p in (model.slopes, model.offsets)]
            assert got == pytest.approx(list(want), abs=1e-3)


def test_models_of_odd_rows(spark):
    """No rows, one class, rows without a label, null ids; dense vectors."""
    _, _, frame = _rows(spark)
    none = frame.where("false")
    one = frame.where("label = 1").union(frame.withColumn("label", F.lit(None).cast("double")))
    dense = spark.createDataFrame([(float(i % 3), Vectors.dense([i % 3, -1.0 * (i % 3 == 1)])) for i in range(60)], ["label", "features"])
    for train in (M.train_logreg, M.train_linear_svc, partial(M.train_boosted_trees, trees=2)):
        assert train(none).transform(frame).where("prediction in (0, 1, 2)").count() == 90
        assert train(one).transform(frame).where("prediction = 1").count() == 90
        assert train(dense).transform(dense).where("prediction = label").count() == 60
    folded = frame.withColumn("fold", F.lit(0))
    assert M.calibrate_sigmoid(folded.where("false")).transform(frame).where("prediction in (0, 1, 2)").count() == 90
    texts = spark.createDataFrame([("good mug", 1.0, 0), (None, 1.0, 1), ("", None, 2)], "clean_text string, label double, fold int")
    for rows in (texts, texts.where("false")):
        results = S.random_search(rows, draws=2)
        assert results.count() == 2
        assert S.refit_best(rows, results).transform(texts).count() == 3


def test_fits_take_a_bounded_part_of_many_rows(spark):
    rows = spark.range(4000).select((F.col("id") % 3).cast("double").alias("label"), "id")
    taken = linear.at_most(rows, F.lit(5), rows=500)
    assert 350 < taken.count() <= 500
    assert taken.where("label = 1").count() > 50
    assert linear.at_most(rows, F.lit(5), rows=4000).count() == 4000
    assert 800 < linear.at_most(rows, F.lit(linear.MAX_ENTRIES // 1000)).count() < 1200
    same = spark.range(3000).select(F.lit(1.0).alias("label"))
    assert linear.at_most(same, F.lit(1), rows=100).count() <= 100


def test_linear_fits_take_all_rows_beyond_the_bounds_of_a_task(spark, monkeypatch):
    """The same coefficients as in one task, whatever rows do not fit there; null labels, null folds and empty rows among them."""
    _, _, frame = _rows(spark, n=150, width=5, seed=5)
    odd = spark.createDataFrame([(None, Vectors.dense([1.0] * 5)), (1.0, Vectors.sparse(5, {})), (2.0, Vectors.dense([0.5] * 5))], frame.schema)
    frame = frame.union(odd).withColumn("fold", F.nullif(F.pmod(F.xxhash64("features"), F.lit(4)), F.lit(3)).cast("int")).coalesce(2).persist()
    fits = [partial(train, tolerance=1e-6) for train in (M.train_logreg, M.train_linear_svc, M.calibrate_sigmoid)]
    want = [fit(frame).stages[0] for fit in fits]
    monkeypatch.setattr(linear, "MAX_ENTRIES", 100)
    for fit, one in zip(fits, want):
        got = fit(frame).stages[0]
        assert got.weights == pytest.approx(one.weights, abs=1e-3)
        for part in ("slopes", "offsets"):
            assert got.getOrDefault(part) == pytest.approx(one.getOrDefault(part), abs=1e-3)


def test_search_and_refit_take_all_rows_beyond_the_bounds_of_a_task(spark, monkeypatch):
    """The same scores and machines as in one task; a fold that is null, a label that is null, and texts that are."""
    rng = np.random.default_rng(11)
    words = np.array(["mug", "lid", "bad", "good", "fine", "tea", "cup", "hot"])
    rows = [(" ".join(rng.choice(words, 6, p=np.roll([0.3] + [0.1] * 7, i % 3))), float(i % 3), i // 3 % 2) for i in range(150)]
    rows += [(None, 1.0, 0), ("", 2.0, 1), ("mug lid", None, 0), ("tea cup", 0.0, None)]
    frame = spark.createDataFrame(rows, "clean_text string, label double, fold int").coalesce(2).persist()

    def both():
        results = S.random_search(frame, draws=2, folds=2)
        return results.orderBy("draw").collect(), S.refit_best(frame, results, tolerance=1e-6).fitted

    found, one = both()
    monkeypatch.setattr(linear, "MAX_ENTRIES", 100)
    again, got = both()
    for new, want in zip(again, found):
        assert new["cv_macro_f1"] == pytest.approx(want["cv_macro_f1"], abs=1e-9)
    assert got.terms.tolist() == one.terms.tolist(), (len(got.terms), len(one.terms))
    assert len(got.terms) >= 8
    assert got.idf == pytest.approx(one.idf) and got.weights == pytest.approx(one.weights, abs=1e-3)


def test_trees_take_all_rows_beyond_the_bounds_of_a_linear_fit(spark, monkeypatch):
    x, y, frame = _rows(spark, n=200, seed=6)
    at = np.nonzero(x)
    rows = linear.SparseRows(at[0], at[1], x[at], x.shape)
    monkeypatch.setattr(linear, "MAX_ENTRIES", 100)
    model = M.train_boosted_trees(frame, trees=2).stages[0]
    # The same rows in another order: sums differ by rounding.
    assert Forest(model.nodes, 3).margins(rows) == pytest.approx(Forest(fit_trees(rows, y, 3, 2, 63, 0.1, 32, 20), 3).margins(rows))


def test_sums_over_blocks_take_every_row_once(spark, monkeypatch):
    monkeypatch.setattr(linear, "FAN", 2)
    _, y, frame = _rows(spark, n=60)
    parts = F.unwrap_udt("features")
    rows = frame.repartition(7).select("label", parts["size"].alias("size"), parts["indices"].alias("indices"), parts["values"].alias("values"))
    with linear.Blocks.of(rows, 12) as blocks:
        got = blocks.sums(3, lambda block: np.bincount(block.labels, minlength=3).astype(float))
    assert got.tolist() == np.bincount(y, minlength=3).tolist()
    assert not linear.in_bounds(rows, F.lit(linear.MAX_ENTRIES)) and linear.in_bounds(rows, F.lit(1))


def test_blocks_keep_every_row():
    sizes = np.array([0, 3, 0, 5, 1, 0])
    rows = linear.SparseRows(np.repeat(np.arange(6), sizes), np.arange(9), np.arange(9.0), (6, 9))
    many = linear.BLOCK_ENTRIES
    linear.BLOCK_ENTRIES = 4
    try:
        packed = linear.pack(rows, np.arange(6), np.arange(6) - 1).to_pylist()
    finally:
        linear.BLOCK_ENTRIES = many
    blocks = [linear.Block.of(tuple(row.values()), 9) for row in packed]
    assert len(blocks) > 1 and np.concatenate([b.labels for b in blocks]).tolist() == [*range(6)]
    assert np.concatenate([b.folds for b in blocks]).tolist() == [*range(-1, 5)]
    w = np.arange(10.0)[:, None]
    dense = np.zeros((6, 9))
    dense[rows.rows, rows.columns] = rows.values
    assert np.concatenate([b.times(w) for b in blocks]) == pytest.approx(dense @ w[:-1] + 9)
    r = np.arange(6.0)[:, None]
    assert sum(b.back(r[b.labels]) for b in blocks) == pytest.approx(np.concatenate([dense.T @ r, [[15.0]]]))


def _gain(g, h):
    return g * g / h


def test_first_cut_of_a_tree_is_the_best_of_all():
    """Every cut of every feature tried on dense columns, zeros and negative values among them."""
    rng = np.random.default_rng(7)
    for turn in range(6):
        x = np.where(rng.random((80, 6)) < 0.5, np.round(rng.random((80, 6)), 1), 0.0)
        x[:, 5] -= 0.4 * (turn % 2)
        g, h = rng.normal(size=80), rng.random(80) + 0.1
        at = np.nonzero(x)
        data = Binned.of(linear.SparseRows(at[0], at[1], x[at], x.shape), 1000, 5)
        nodes, added = grow(data, 80, g, h, 2, 5, 1e-3, 1.0)
        best = (0.0, None)
        for j in range(6):
            for cut in np.unique(x[:, j])[:-1]:
                right = x[:, j] > cut
                if 5 <= right.sum() <= 75:
                    gain = _gain(g[right].sum(), h[right].sum()) + _gain(g[~right].sum(), h[~right].sum()) - _gain(g.sum(), h.sum())
                    best = max(best, (gain, (j, cut)))
        j, cut = best[1]
        right = x[:, j] > cut
        want = np.where(right, -g[right].sum() / h[right].sum(), -g[~right].sum() / h[~right].sum())
        assert nodes[0][1] == j and added == pytest.approx(want)


def test_trees_keep_their_limits_and_score_what_they_fitted():
    rng = np.random.default_rng(8)
    x = np.where(rng.random((400, 20)) < 0.3, rng.random((400, 20)), 0.0)
    y = (x[:, 0] + 2 * x[:, 1] * (x[:, 2] > 0.5) > 0.5).astype(int) + (x[:, 3] > 0.6)
    at = np.nonzero(x)
    rows = linear.SparseRows(at[0], at[1], x[at], x.shape)
    nodes = fit_trees(rows, y, 3, 40, 7, 0.1, 32, 20)
    trees = {}
    for turn, k, node, feature, *_ in nodes:
        trees.setdefault((turn, k), []).append(feature)
    assert all(sum(f < 0 for f in tree) <= 7 for tree in trees.values()) and len(trees) == 3 + 120
    got = Forest(nodes, 3).margins(rows, block=64)
    assert (got.argmax(axis=1) == y).mean() > 0.9
    assert got == pytest.approx(Forest(nodes, 3).margins(rows))


def test_end_to_end_model_equals_model_on_cleaned_text(spark, data):
    """Stored and loaded, the model scores raw text as the steps did one by one."""
    train, test = data.filter("split = 'train'"), data.filter("split = 'test'")
    model = M.end_to_end_model(train, lambda d: M.train_logreg(d, max_iter=5), min_df=3)
    path = scratch_path(spark, "end-to-end")
    model.write().save(path)
    stored = M.score_table(PipelineModel.load(path), test).collect()
    assert sorted(stored) == sorted(M.score_table(model, test).collect())
    steps = V.Terms(inputCol="clean_text", outputCol="terms").transform(test)
    by_hand = PipelineModel(model.stages[2:]).transform(steps)
    assert [r["prediction"] for r in by_hand.orderBy("review_id").collect()] == [
        r["prediction"] for r in model.transform(test).orderBy("review_id").collect()
    ]


def test_two_raw_sentences(data):
    """Sentences made of the words of a class get that class."""
    model = M.end_to_end_model(data.filter("split = 'train'"), lambda d: M.train_logreg(d, max_iter=10), min_df=3)
    spark = data.sparkSession
    rows = spark.createDataFrame(
        [(1, "the and of the it was that with for the on", "x"), (2, "der die und das ein nicht sch ich aulich", "x")],
        "review_id long, full_text string, text string",
    ).withColumn("sentiment_label", F.lit("unknown"))
    got = {r["review_id"]: r["predicted_label"] for r in M.score_table(model, rows).collect()}
    assert got == {1: "positive", 2: "negative"}


def test_search_and_refit(spark, data):
    train = data.filter("split = 'train'")
    folded = train.join(stratified_kfold(train).select("review_id", "fold"), "review_id").persist()
    results = S.random_search(folded, draws=4)
    rows = results.collect()
    assert len(rows) == 4 and [r["cv_macro_f1"] for r in rows] == sorted((r["cv_macro_f1"] for r in rows), reverse=True)
    # The mean of a draw, made anew from the vectors of Spark.
    draw = rows[0]
    scores = []
    for f in range(3):
        terms = V.Terms(ngrams=draw["ngrams"]).transform(folded)
        inside, outside = terms.where(F.col("fold") == f), terms.where(F.col("fold") != f)
        tfidf = V.tfidf_features(outside, min_df=draw["min_df"], max_df=1.0, max_features=draw["max_features"], sublinear=draw["sublinear"])
        svc = M.train_linear_svc(tfidf.transform(outside).select("label", "features"), c=draw["c"], tolerance=1e-4)
        scores.append(E.MacroF1().evaluate(svc.transform(tfidf.transform(inside))))
    assert draw["cv_macro_f1"] == pytest.approx(np.mean(scores), abs=0.02)
    model = S.refit_best(train, results)
    test = data.filter("split = 'test'")
    scored = model.transform(test)
    assert E.MacroF1().evaluate(scored) > majority(test) + 0.1
    assert scored.columns == [*test.columns, "scores", "prediction"]
    path = scratch_path(spark, "svc")
    model.write().save(path)
    again = S.TfidfSvcScores.load(path).transform(test)
    assert sorted(again.select("review_id", "scores").collect()) == sorted(scored.select("review_id", "scores").collect())
    setting, score = S.best_setting(results)
    assert score == draw["cv_macro_f1"] and json.loads(setting) == {k: draw[k] for k in ("c", "max_features", "min_df", "ngrams", "sublinear")}


def test_refit_reads_the_stored_search(spark, sf_dir, monkeypatch):
    table = spark.createDataFrame([(0, 0.5, 20_000, 5, 1, True, 0.4), (1, 2.0, 50_000, 2, 2, False, 0.6)], S.SETTING + ", cv_macro_f1 double")
    monkeypatch.setattr(S, "random_search", lambda folded: table)
    monkeypatch.setattr(catalog, "stored_path", lambda spark, name, sf_dir: scratch_path(spark, name))
    report = QUERIES["refit_best"](spark, sf_dir).collect()
    assert {r["class"] for r in report} >= {*LABELS, "accuracy"}
    assert all(json.loads(r["best_params"])["max_features"] == 50_000 and r["cv_macro_f1"] == 0.6 for r in report)


def test_random_draws_are_seeded():
    draws = S.random_draws()
    assert draws == S.random_draws() and len(draws) == 15 and draws != S.random_draws(seed=1)
    assert all(0.01 <= d.c <= 10 for d in draws)
    assert all(getattr(d, name) in choices for d in draws for name, choices in S.SEARCH_SPACE.items())


@pytest.mark.parametrize("limit", [None, 128])
def test_batch_scoring_sees_whole_texts_or_the_first_words(spark, sf_dir, limit):
    rows = reviews(spark, sf_dir).withColumn("full_text", full_text())
    scored = M.batch_model_scoring(rows, keyword_model, batch_size=7, max_tokens=limit).collect()
    predict = keyword_model()
    for r in scored[:50]:
        seen = " ".join(r["full_text"].split()[:limit]) if limit else r["full_text"]
        p = predict(np.array([seen]))[0]
        assert r["predicted_label"] == LABELS[int(np.argmax(p))]
        assert r["confidence"] == pytest.approx(float(p.max()))


def test_score_and_topic(spark, data):
    topics = fit_topics(data.withColumn("clean_text_no_stopwords", F.col("clean_text")), topics=3, iterations=3, min_df=2, max_df=0.9)
    texts = spark.createDataFrame([(1, None), (2, "..."), (3, data.head()["text"])], "review_id long, text string")
    scored = {r["review_id"]: r for r in score_and_topic(texts, lambda d: M.batch_model_scoring(d, keyword_model), topics).collect()}
    assert scored[1]["dominant_topic"] is None and scored[2]["topic_label"] is None
    assert scored[3]["dominant_topic"] in (0, 1, 2) and sum(scored[3]["probabilities"]) == pytest.approx(1, abs=1e-5)


def test_softmax(spark):
    got = spark.range(1).select(softmax(F.array(F.lit(1000.0), F.lit(999.0))).alias("p")).head()["p"]
    assert got == pytest.approx([1 / (1 + np.exp(-1)), 1 / (1 + np.exp(1))])


# Metrics.


def test_report_averages_agree_with_published_ones(spark):
    """Class scores of a published report must average to its published means."""
    f1, support = [0.7588, 0.4336, 0.9587], [10332, 6505, 75303]
    assert sum(support) == 92140
    assert np.mean(f1) == pytest.approx(0.7170, abs=1e-4)
    assert np.average(f1, weights=support) == pytest.approx(0.8992, abs=2e-4)


def test_absent_class_counts_as_zero(spark):
    rows = spark.createDataFrame([("negative", "negative"), ("positive", "positive")], "true_label string, predicted_label string")
    assert E.macro_f1(rows).head()[0] == pytest.approx(2 / 3)
    report = {r["class"]: r for r in E.classification_report(rows).collect()}
    assert report["neutral"]["f1"] == 0 and report["accuracy"]["f1"] == 1 and report["weighted avg"]["support"] == 2


def test_evaluator_equals_table_metric(spark):
    pairs = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (2.0, 0.0), (2.0, 2.0)]
    rows = spark.createDataFrame(pairs, "label double, prediction double")
    named = spark.createDataFrame([(LABELS[int(a)], LABELS[int(b)]) for a, b in pairs], "true_label string, predicted_label string")
    assert E.MacroF1().evaluate(rows) == pytest.approx(E.macro_f1(named).head()[0])


def test_bootstrap_agrees_with_resampling_rows(spark, sf_dir):
    scored = scored_reviews(spark, sf_dir)
    mine = E.bootstrap_macro_f1_diff(scored, "predicted_label", "other_label", resamples=400).head()
    rows = [(LABELS.index(r[0]), LABELS.index(r[1]), LABELS.index(r[2])) for r in scored.select("true_label", "predicted_label", "other_label").collect()]
    data = np.array(rows)
    rng = np.random.default_rng(0)

    def f1(true, got):
        return np.mean([2 * np.sum((true == c) & (got == c)) / max(np.sum(true == c) + np.sum(got == c), 1) for c in range(3)])

    diffs = []
    for _ in range(400):
        pick = data[rng.integers(0, len(data), len(data))]
        diffs.append(f1(pick[:, 0], pick[:, 1]) - f1(pick[:, 0], pick[:, 2]))
    assert mine["observed_diff"] == pytest.approx(f1(data[:, 0], data[:, 1]) - f1(data[:, 0], data[:, 2]))
    spread = np.std(diffs)
    assert mine["mean_diff"] == pytest.approx(np.mean(diffs), abs=spread / 3)
    assert mine["ci_low"] == pytest.approx(np.percentile(diffs, 2.5), abs=spread)
    assert mine["ci_high"] == pytest.approx(np.percentile(diffs, 97.5), abs=spread)


def test_metrics_json(spark, sf_dir):
    line = sink_metrics_json(E.nested_report(scored_reviews(spark, sf_dir)), scratch_path(spark, "metrics")).head()[0]
    report = json.loads(line)
    assert set(report["report"]) == {"negative", "neutral", "positive", "accuracy", "macro avg", "weighted avg"}
    assert report["test_macro_f1"] == pytest.approx(np.mean([report["report"][c]["f1-score"] for c in LABELS]))


@pytest.mark.parametrize("sublinear", [False, True])
def test_relational_weights_equal_those_of_the_vectors(spark, sublinear):
    texts = [(i, f"good soap {'bad ' * (i % 4)} smell w{i % 7}") for i in range(60)] + [(60, ""), (61, None)]
    terms = V.Terms().transform(spark.createDataFrame(texts, "review_id long, clean_text string")).where("terms is not null")
    model = V.tfidf_features(terms, min_df=3, sublinear=sublinear)
    wide = V.long_form(model.transform(terms), "features", model.stages[0], "weight")
    narrow = V.tfidf_weights(terms, min_df=3, sublinear=sublinear)
    expected = {(r.review_id, r.term): r.weight for r in wide.collect()}
    got = {(r.review_id, r.term): r.weight for r in narrow.collect()}
    assert expected.keys() == got.keys() and len(got) > 100
    assert all(abs(w - got[key]) < 1e-9 for key, w in expected.items())


@pytest.mark.parametrize(
    "name, fits",
    [
        ("train_logreg", ["train_logreg"]),
        ("score_table", ["train_logreg"]),
        ("train_linear_svc", ["train_linear_svc"]),
        ("calibrate_sigmoid", ["calibrate_sigmoid"]),
        ("train_boosted_trees", ["train_boosted_trees"]),
        ("random_search", ["random_search"]),
        ("refit_best", ["random_search"]),
        ("end_to_end_model", ["train_logreg"]),
        ("score_and_topic", ["train_logreg"]),
        ("enrich_reviews", ["train_logreg"]),
    ],
)
def test_queries_fit_in_full(spark, monkeypatch, name, fits):
    """No query limits the iterations, trees, draws or features of a fit below the operator's defaults."""
    limits, seen = {"max_iter", "trees", "leaves", "draws", "folds", "tolerance", "max_rows"}, []

    def recorded(fit):
        real = inspect.signature(getattr(S if fit == "random_search" else M, fit))

        def run(*args, **options):
            call = real.bind(*args, **options)
            call.apply_defaults()
            seen.append(fit)
            assert all(call.arguments[p] == real.parameters[p].default for p in limits & set(real.parameters))
            return MagicMock()

        return run

    for fit in fits:
        monkeypatch.setattr(S if fit == "random_search" else M, fit, recorded(fit))
    monkeypatch.setattr(M, "end_to_end_model", lambda df, train, *args, **options: train(df))
    for part in ("score_table", "label_name", "add_label"):
        monkeypatch.setattr(M, part, MagicMock())
    monkeypatch.setattr(S, "refit_best", MagicMock())
    monkeypatch.setattr(S, "best_setting", lambda results: ("{}", 0.0))
    monkeypatch.setattr(catalog, "materialize", lambda spark, path, build: build())
    monkeypatch.setattr(catalog, "model_store", lambda spark, path, fit: fit())
    for part in ("_dataset", "stratified_kfold", "classification_report", "fit_topics", "spread", "cut_lineage", "prepare", "stored_path", "TopicModel"):
        monkeypatch.setattr(catalog, part, MagicMock())
    for part in ("timed_reviews", "reviews", "score_and_topic", "enrich_reviews"):
        monkeypatch.setattr(catalog, part, MagicMock())
    monkeypatch.setattr(catalog, "_vectors", lambda spark, sf_dir: (MagicMock(), MagicMock()))
    QUERIES[name](spark, "")
    assert seen == fits


def test_leaves_keep_only_the_slots_where_a_cut_is_possible():
    rng = np.random.default_rng(8)
    x = np.where(rng.random((120, 30)) < rng.uniform(0.02, 0.6, 30), rng.random((120, 30)), 0.0)
    x[:, 3] = np.where(rng.random(120) < 0.4, 1.0, 0.0)
    x[:, 7] = x[:, 3]  # equal cuts: the first is taken
    at = np.nonzero(x)
    data = Binned.of(linear.SparseRows(at[0], at[1], x[at], x.shape), 16, 5)
    g, h = rng.normal(size=120) + 3.0 * (x[:, 3] > 0), np.full(120, 0.25)
    leaf = boosting._Leaf(np.arange(120), np.arange(len(data.feature)), boosting._all_sums(data, g, h))
    boosting._best_cut(data, leaf, g, h, 20, 1e-3)
    right = [np.unique(data.rows[(data.slots >= s) & (data.slots < data.end[s])]) for s in range(len(data.feature))]
    fits = [s for s, rows in enumerate(right) if 20 <= len(rows) <= 100]
    gains = {s: g[r].sum() ** 2 / h[r].sum() + (g.sum() - g[r].sum()) ** 2 / (h.sum() - h[r].sum()) for s, r in enumerate(right) if s in fits}
    assert set(fits) <= set(leaf.slots.tolist()) and len(leaf.slots) < len(data.feature)
    assert gains[leaf.slot] >= max(gains.values()) * (1 - 1e-9) and data.feature[leaf.slot] == 3
    part = np.flatnonzero(x[:, 3] > 0)
    places, sums = boosting._sums(data, part, leaf.slots, g, h)
    for s, own in zip(leaf.slots[places], sums.T):
        rows = np.intersect1d(right[s], part)
        np.testing.assert_allclose(own, [g[rows].sum(), h[rows].sum(), len(rows)], atol=1e-9)


def test_counts_of_batches_are_those_of_all_rows():
    rng = np.random.default_rng(3)
    texts = [rng.integers(-5, 5, rng.integers(0, 9)).tolist() for _ in range(1200)]
    words = [len(t) // 2 for t in texts]

    def batch(lo, hi):
        lists = pa.array(texts[lo:hi], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(words[lo:hi], pa.int32()), lists, pa.array([1.0] * (hi - lo))], names=["n_words", "terms", "label"])

    for ngrams in (1, 2):
        counts, (labels,) = S._whole(iter([batch(0, 700), batch(0, 0), batch(700, 1200)]), ngrams, "label")
        got = {}
        for r, c, v in zip(counts.rows.rows.tolist(), counts.terms[counts.rows.columns].tolist(), counts.rows.values):
            assert (r, c) not in got
            got[r, c] = v
        seen = [t[:w] if ngrams == 1 else t for t, w in zip(texts, words)]
        assert got == {(i, t): own.count(t) for i, own in enumerate(seen) for t in own} and len(labels) == 1200
        order = counts.rows.rows.astype(np.int64) * len(counts.terms) + counts.rows.columns
        assert (np.diff(order) > 0).all()


def test_search_deals_no_copies_of_its_rows(spark, monkeypatch):
    """A fit of the search scans the stored rows; they are not sent to every setting and fold."""
    texts = spark.createDataFrame([(f"good mug {i % 3}", float(i % 3), i % 2) for i in range(30)], "clean_text string, label double, fold int")
    plans, real = [], S.cut_lineage

    def cut(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df)

    monkeypatch.setattr(S, "cut_lineage", cut)
    assert S.random_search(texts, draws=2, folds=2).count() == 2
    assert "Generate" not in plans[-1] and plans[-1].count("MapInArrow") == 4


def test_dataset_stores_each_text_once(spark, sf_dir, monkeypatch):
    paths = []
    real = catalog.materialize

    def kept(spark, path, build):
        paths.append(path)
        return real(spark, path, build)

    monkeypatch.setattr(catalog, "materialize", kept)
    monkeypatch.setattr(catalog, "stored_path", lambda spark, name, sf_dir: scratch_path(spark, name))
    rows = _dataset(spark, sf_dir)
    stored = [spark.read.parquet(path) for path in paths]
    assert not any("full_text" in df.columns for df in stored) and sum("text" in df.columns for df in stored) == 1
    clean = prepare(timed_reviews(spark, sf_dir))
    whole = {(r["review_id"], r["full_text"], r["split"]) for r in stratified_split(clean).select("review_id", "full_text", "split").collect()}
    assert {(r["review_id"], r["full_text"], r["split"]) for r in rows.collect()} == whole


def test_trees_are_fitted_beside_the_other_models(spark, monkeypatch):
    met = threading.Barrier(2)

    def model(spark, sf_dir, name):
        if name in ("train_boosted_trees", "train_logreg"):
            met.wait(20)
        return name, None

    monkeypatch.setattr(catalog, "_model", model)
    monkeypatch.setattr(catalog, "_vectors", lambda spark, sf_dir: (None, "test"))
    monkeypatch.setattr(catalog, "materialize", lambda spark, path, build: build())
    monkeypatch.setattr(catalog, "predictions", lambda models, test, *more: (models, test, more))
    monkeypatch.setattr(catalog, "assess", lambda *args: {})
    stacked, _ = catalog._assessed(spark, "")
    assert stacked == ({name: name for name in catalog.FITS}, "test", ("rating",)) and list(stacked[0]) == list(catalog.FITS)


def test_topics_are_fitted_beside_the_classifier(spark, monkeypatch):
    met, prepared = threading.Barrier(2), []

    def store(spark, path, fit):
        fit()
        met.wait(20)
        return path

    monkeypatch.setattr(catalog, "model_store", store)
    monkeypatch.setattr(catalog, "stored_path", lambda spark, name, sf_dir: name)
    monkeypatch.setattr(M, "end_to_end_model", MagicMock())
    monkeypatch.setattr(catalog, "cut_lineage", lambda df: prepared.append(df) or df)
    for part in ("fit_topics", "prepare", "timed_reviews", "spread"):
        monkeypatch.setattr(catalog, part, MagicMock())
    monkeypatch.setattr(catalog, "TopicModel", MagicMock(of=lambda stored: stored))
    assert catalog._fitted(spark, "")[1] == "topics" and len(prepared) == 1
