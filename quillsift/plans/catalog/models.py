"""Queries over features, classifiers and scoring."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import cache, reduce
from threading import Lock

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillsift.functions.columns import LABELS, full_text, topic_label
from quillsift.operators import classify as M
from quillsift.operators import features as V
from quillsift.operators import search as S
from quillsift.operators.evaluate import classification_report, nested_report
from quillsift.operators.sampling import split_at, split_cuts, stratified_kfold
from quillsift.operators.tallies import term_tallies
from quillsift.plans.assess import assess, predictions
from quillsift.plans.catalog.tables import labelled
from quillsift.plans.catalog.text import cleaned
from quillsift.plans.enrich import TopicModel, enrich_reviews, fit_topics, prepare, score_and_topic
from quillsift.plans.registry import query, rounded, view
from quillsift.session import cut_lineage, spread, stored_path
from quillsift.sources.sinks import materialize, model_store, sink_metrics_json
from quillsift.sources.tables import reviews, timed_reviews

# A setting of these runs, for which the tables here are small; the fits run by the operators' defaults.
MIN_DF = 5

SETTING_JSON = "struct<c: double, max_features: int, min_df: int, ngrams: int, sublinear: boolean>"


def _terms(spark, sf_dir):
    return V.Terms(inputCol="clean_text", outputCol="terms").transform(cleaned(spark, sf_dir)).select("review_id", "terms")


_WORDS = "list_filter(string_split(clean_text, ' '), lambda w: length(w) >= 2)"
view(
    "termed",
    f"""SELECT review_id, unnest(list_concat(t, list_transform(range(1, greatest(len(t), 1)), lambda i: t[i] || ' ' || t[i + 1]))) AS term
    FROM (SELECT review_id, {_WORDS} AS t FROM cleaned)""",
)
view("tallied", "SELECT review_id, term, count(*) AS tf FROM termed GROUP BY 1, 2")


def _chosen(min_df, max_df):
    """Terms within the limits of document frequency."""
    return f"""SELECT term, count(*) AS df FROM tallied GROUP BY 1
    HAVING count(*) >= {min_df} AND count(*) <= {max_df}::DOUBLE * (SELECT count(*) FROM cleaned)"""


@query(
    "count_features",
    f"WITH chosen AS ({_chosen(10, 0.5)}) SELECT review_id, term, CAST(tf AS DOUBLE) AS n FROM tallied JOIN chosen USING (term)",
)
def _(spark, sf_dir):
    return V.term_counts(_terms(spark, sf_dir)).select("review_id", "term", "n")


@query("document_frequency", "SELECT term, count(*) AS df FROM tallied GROUP BY 1")
def _(spark, sf_dir):
    return V.document_frequency(_terms(spark, sf_dir))


def _weighted(tf):
    return f"""WITH chosen AS ({_chosen(MIN_DF, 0.9)}),
    raw AS (SELECT review_id, term, {tf} * (ln((1.0::DOUBLE + (SELECT count(*) FROM cleaned)) / (1 + df)) + 1) AS w FROM tallied JOIN chosen USING (term)),
    norms AS (SELECT review_id, sqrt(sum(w * w)) AS norm FROM raw GROUP BY 1)
    SELECT review_id, term, round(w / norm, 6) AS weight FROM raw JOIN norms USING (review_id)"""


def _tfidf(spark, sf_dir, sublinear):
    return rounded(V.tfidf_weights(_terms(spark, sf_dir), min_df=MIN_DF, sublinear=sublinear), "weight")


@query("tfidf_features", _weighted("tf"))
def _(spark, sf_dir):
    return _tfidf(spark, sf_dir, False)


@query("tfidf_sublinear", _weighted("(1.0::DOUBLE + ln(tf))"))
def _(spark, sf_dir):
    return _tfidf(spark, sf_dir, True)


def _most_frequent(form, min_df, max_df, limit):
    return f"""SELECT '{form}' AS form, count(*) AS terms, CAST(min(n) AS BIGINT) AS least_n, CAST(sum(n) AS BIGINT) AS total_n FROM (
      SELECT term, sum(tf) AS n FROM tallied GROUP BY 1
      HAVING count(*) >= {min_df} AND count(*) <= {max_df}::DOUBLE * (SELECT count(*) FROM cleaned) ORDER BY n DESC LIMIT {limit})"""


@query(
    "vocabulary_limits",
    f"{_most_frequent('counts', 10, 0.5, 10_000)} UNION ALL {_most_frequent('tfidf', MIN_DF, 0.9, 50_000)}",
)
def _(spark, sf_dir):
    """The vocabularies of the vector forms: as many terms as the limit allows, and the most frequent ones."""
    terms = cut_lineage(_terms(spark, sf_dir).select("terms"))
    totals = cut_lineage(term_tallies(terms, F.col("terms"), terms.count()).select("term", "n"))
    counters = {"counts": V.count_features(terms), "tfidf": V.tfidf_features(terms, min_df=MIN_DF).stages[0]}

    def row(form, counter):
        used = totals.join(V.vocabulary(counter, spark), "term")
        return used.agg(
            F.lit(form).alias("form"), F.count("*").alias("terms"), F.min("n").alias("least_n"), F.sum("n").alias("total_n")
        )

    return reduce(DataFrame.unionByName, [row(form, counter) for form, counter in counters.items()])


@query(
    "class_weights",
    """SELECT sentiment_label, count(*) AS n, round(sum(count(*)) OVER ()::DOUBLE / (count(*) OVER () * count(*)), 6) AS weight
    FROM labelled GROUP BY 1""",
)
def _(spark, sf_dir):
    return rounded(V.class_weights(labelled(spark, sf_dir)), "weight")


def _dataset(spark, sf_dir):
    """Clean labelled texts with their side of the split, written once for all fits.

    The side follows from the id and a stored row per class, and the full text from title and text.
    """

    def build():
        rows = M.add_label(prepare(timed_reviews(spark, sf_dir, heavy=True)))
        return rows.select("review_id", "rating", "title", "text", "clean_text", "sentiment_label", "label")

    rows = spread(materialize(spark, stored_path(spark, "dataset", sf_dir), build), "review_id")
    cuts = materialize(spark, stored_path(spark, "dataset-cuts", sf_dir), lambda: split_cuts(rows))
    columns = ["review_id", "rating", "text", "full_text", "clean_text", "sentiment_label", "label", "split"]
    return split_at(rows.withColumn("full_text", full_text()), cuts).select(*columns)


def _vectors(spark, sf_dir):
    """Training and test rows as tf-idf vectors, the weights learnt on the training rows alone."""
    data = _dataset(spark, sf_dir)
    terms = V.Terms(inputCol="clean_text", outputCol="terms")

    def fit():
        rows = cut_lineage(terms.transform(data.filter("split = 'train'")).select("terms"))
        return PipelineModel([terms, *V.tfidf_features(rows, min_df=MIN_DF).stages])

    tfidf = model_store(spark, stored_path(spark, "tfidf", sf_dir), fit)

    def vectors(side, *columns):
        return tfidf.transform(data.filter(F.col("split") == side)).select("review_id", *columns, "sentiment_label", "label", "features")

    train = materialize(spark, stored_path(spark, "train-vectors", sf_dir), lambda: vectors("train"))
    return train, vectors("test", "rating", "text")


def _calibrated(train):
    folded = train.join(stratified_kfold(train).select("review_id", "fold"), "review_id")
    return M.calibrate_sigmoid(cut_lineage(folded))


FITS = {
    "train_logreg": lambda train: M.train_logreg(train),
    "train_linear_svc": lambda train: M.train_linear_svc(train),
    "calibrate_sigmoid": _calibrated,
    "train_boosted_trees": lambda train: M.train_boosted_trees(train),
}


def _model(spark, sf_dir, name):
    """A fitted classifier over the vectors, fitted once; and the test rows."""
    train, test = _vectors(spark, sf_dir)
    return model_store(spark, stored_path(spark, name, sf_dir), lambda: FITS[name](train)), test


def _scored(spark, sf_dir, name):
    model, test = _model(spark, sf_dir, name)
    return M.score_table(model, test)


@query("train_logreg")
def _(spark, sf_dir):
    return _scored(spark, sf_dir, "train_logreg")


@query("train_linear_svc")
def _(spark, sf_dir):
    return _scored(spark, sf_dir, "train_linear_svc")


@query("calibrate_sigmoid")
def _(spark, sf_dir):
    return _scored(spark, sf_dir, "calibrate_sigmoid")


@query("train_boosted_trees")
def _(spark, sf_dir):
    return _scored(spark, sf_dir, "train_boosted_trees")


@query("end_to_end_model")
def _(spark, sf_dir):
    data = _dataset(spark, sf_dir)
    model = M.end_to_end_model(data.filter("split = 'train'"), M.train_logreg, min_df=MIN_DF)
    return M.score_table(model, data.filter("split = 'test'"))


@query("score_table")
def _(spark, sf_dir):
    return _scored(spark, sf_dir, "train_logreg").groupBy("true_label", "predicted_label").agg(
        F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("avg_confidence")
    )


def _assessed(spark, sf_dir):
    """The predictions of all models on the test rows, and the tables over them."""

    def build():
        _, test = _vectors(spark, sf_dir)

        @inheritable_thread_target(spark)
        def fit(names):
            return {name: _model(spark, sf_dir, name)[0] for name in names}

        # The trees take one task for most of the time, so the other models are fitted meanwhile.
        slow = ["train_boosted_trees"]
        with ThreadPoolExecutor(2) as pool:
            first, second = pool.map(fit, (slow, [name for name in FITS if name not in slow]))
        return predictions({name: {**first, **second}[name] for name in FITS}, test, "rating")

    stacked = materialize(spark, stored_path(spark, "predictions", sf_dir), build)
    return stacked, assess(stacked, "train_boosted_trees", "train_logreg", "calibrate_sigmoid")


# The cleaned reviews and their split, as the models get them.
view("clean_kept", """SELECT * FROM (SELECT * FROM labelled QUALIFY row_number() OVER (PARTITION BY text ORDER BY review_id) = 1)
    WHERE length(text) >= 20""")
view(
    "clean_quotas",
    """SELECT sentiment_label, n * t // a + CAST(row_number() OVER (ORDER BY n * t % a DESC, sentiment_label)
        <= t - sum(n * t // a) OVER () AS BIGINT) AS quota
    FROM (SELECT sentiment_label, CAST(count(*) AS HUGEINT) AS n, CAST(sum(count(*)) OVER () AS HUGEINT) AS a,
          CAST(ceil(sum(count(*)) OVER () * 0.2) AS HUGEINT) AS t FROM clean_kept GROUP BY 1)""",
)
view(
    "clean_test",
    """SELECT k.review_id, k.rating, k.sentiment_label AS true_label FROM clean_kept k JOIN clean_quotas q ON k.sentiment_label = q.sentiment_label
    QUALIFY row_number() OVER (PARTITION BY k.sentiment_label
        ORDER BY CAST('0x' || substr(md5('42:' || CAST(k.review_id AS VARCHAR)), 1, 15) AS BIGINT), k.review_id) <= q.quota""",
)


@query(
    "assess_predictions",
    f"""SELECT m.model, review_id, true_label, rating, true AS named, m.shares AS sure FROM clean_test,
    (VALUES {", ".join(f"('{name}', {name != 'train_linear_svc'})" for name in FITS)}) m(model, shares)""",
)
def _(spark, sf_dir):
    """Every test review scored by every model; whether the label is one of the classes and the confidence a share."""
    stacked, _ = _assessed(spark, sf_dir)
    shares = F.col("model") != "train_linear_svc"  # margins
    return stacked.select(
        "model",
        "review_id",
        "true_label",
        "rating",
        F.col("predicted_label").isin(*LABELS).alias("named"),
        (shares & F.col("confidence").between(1 / len(LABELS) - 1e-9, 1 + 1e-9)).alias("sure"),
    )


@query(
    "assess_stars",
    """SELECT CASE WHEN rating = 5 THEN '5star_negative' ELSE '1star_positive' END AS kind, count(*) AS star_total, true AS in_bounds
    FROM clean_test WHERE rating IN (1, 5) GROUP BY rating""",
)
def _(spark, sf_dir):
    """Reviews with each star that the mismatch rates refer to; the counted mismatches are among them."""
    _, tables = _assessed(spark, sf_dir)
    within = F.col("count").between(F.col("count_confident"), F.col("star_total"))
    return tables["mismatches"].select("kind", "star_total", within.alias("in_bounds"))


@query("assess_mismatches")
def _(spark, sf_dir):
    return _assessed(spark, sf_dir)[1]["mismatches"]


@query("assess_comparison")
def _(spark, sf_dir):
    return _assessed(spark, sf_dir)[1]["comparison"]


@query("assess_gain")
def _(spark, sf_dir):
    return _assessed(spark, sf_dir)[1]["gain"]


def _search(spark, sf_dir):
    """The data set, and the table of the search over its training rows: made once, then read."""
    data = _dataset(spark, sf_dir)

    def search():
        train = data.filter("split = 'train'")
        folded = train.join(stratified_kfold(train).select("review_id", "fold"), "review_id")
        return S.random_search(cut_lineage(folded.select("label", "fold", "clean_text")))

    return data, materialize(spark, stored_path(spark, "search", sf_dir), search)


@query("random_search")
def _(spark, sf_dir):
    _, results = _search(spark, sf_dir)
    return results.orderBy(F.desc("cv_macro_f1"), "draw")


@query(
    "random_search_facts",
    """SELECT CAST(d AS INT) AS draw, true AS listed, true AS in_range, true AS in_order FROM range(15) t(d)""",
)
def _(spark, sf_dir):
    """Per draw whether its setting is one of those to search, its score is a share, and better draws stand before it."""
    _, results = _search(spark, sf_dir)
    listed = [F.col(name).isin(*choices) for name, choices in S.SEARCH_SPACE.items()]
    low, high = S.PENALTY_RANGE
    before = F.lag("cv_macro_f1").over(Window.partitionBy(F.lit(1)).orderBy(F.desc("cv_macro_f1"), "draw"))  # a row per draw
    return results.select(
        "draw",
        reduce(Column.__and__, listed).alias("listed"),
        (F.col("c").between(low, high) & F.col("cv_macro_f1").between(0.0, 1.0)).alias("in_range"),
        F.coalesce(before >= F.col("cv_macro_f1"), F.lit(True)).alias("in_order"),
    )


def _refitted(spark, sf_dir):
    """The report of the best setting on the test rows, and the stored results that name the setting."""
    data, results = _search(spark, sf_dir)
    model = S.refit_best(data.filter("split = 'train'"), results)
    tested = model.transform(data.filter("split = 'test'"))
    named = tested.select(
        F.col("sentiment_label").alias("true_label"), M.label_name(F.col("prediction")).alias("predicted_label")
    )
    return cut_lineage(named), results


@query("refit_best")
def _(spark, sf_dir):
    """The report of the best setting, with the setting and its score in the search."""
    named, results = _refitted(spark, sf_dir)
    setting, score = S.best_setting(results)
    return classification_report(named).withColumns({"best_params": F.lit(setting), "cv_macro_f1": F.lit(score)})


@query(
    "refit_report_json",
    """SELECT true_label AS class, count(*) AS support, true AS scored, true AS tuned FROM clean_test GROUP BY 1
    UNION ALL SELECT 'weighted avg', count(*), true, true FROM clean_test""",
)
def _(spark, sf_dir):
    """The stored report of the refit, read back: supports, scores that are shares, and the setting beside them."""
    named, results = _refitted(spark, sf_dir)
    setting, score = S.best_setting(results)
    report = nested_report(named).withColumns({"best_params": F.from_json(F.lit(setting), SETTING_JSON), "cv_macro_f1": F.lit(score)})
    lines = sink_metrics_json(report, stored_path(spark, "refit-report", sf_dir))
    scores = "map<string, struct<support: double, `f1-score`: double>>"
    read = lines.select(F.from_json("value", f"report {scores}, best_params {SETTING_JSON}, cv_macro_f1 double").alias("r")).select("r.*")
    listed = [F.col("best_params")[name].isin(*choices) for name, choices in S.SEARCH_SPACE.items()]
    tuned = reduce(Column.__and__, listed) & F.col("cv_macro_f1").between(0.0, 1.0)
    rows = read.select(F.explode(F.map_entries("report")).alias("e"), tuned.alias("tuned")).where("e.key NOT IN ('accuracy', 'macro avg')")
    return rows.select(
        F.col("e.key").alias("class"),
        F.col("e.value.support").cast("long").alias("support"),
        F.col("e.value")["f1-score"].between(0.0, 1.0).alias("scored"),
        "tuned",
    )


def keyword_model():
    """Stands in for a pretrained classifier: class shares from the lengths and letters of the words."""

    def predict(texts: np.ndarray) -> np.ndarray:
        scores = np.array(
            [[1 + t.count("e") % 7, 1 + t.count(" ") % 5, 1 + len(t) % 11] for t in texts], dtype=np.float32
        )
        return scores / scores.sum(axis=1, keepdims=True)

    return predict


@query(
    "batch_model_scoring",
    r"""WITH seen AS (SELECT review_id, full_text AS t FROM joined),
    marks AS (SELECT review_id, 1 + (length(t) - length(replace(t, 'e', ''))) % 7 AS a, 1 + (length(t) - length(replace(t, ' ', ''))) % 5 AS b,
      1 + length(t) % 11 AS c FROM seen)
    SELECT review_id, CASE WHEN a >= b AND a >= c THEN 'negative' WHEN b >= c THEN 'neutral' ELSE 'positive' END AS predicted_label,
      round(greatest(a, b, c)::DOUBLE / (a + b + c), 5) AS confidence FROM marks""",
)
def _(spark, sf_dir):
    rows = reviews(spark, sf_dir, heavy=True).withColumn("full_text", full_text())
    scored = M.batch_model_scoring(rows, keyword_model)
    return scored.select("review_id", "predicted_label", F.round("confidence", 5).alias("confidence"))


def _fitted(spark, sf_dir):
    """A scorer and a topic model fitted on the clean reviews: made once, then loaded."""

    lock = Lock()

    @cache
    def prepared():
        rows = M.add_label(prepare(timed_reviews(spark, sf_dir, heavy=True)))
        return spread(cut_lineage(rows.select("review_id", "label", "clean_text", "clean_text_no_stopwords")), "review_id")

    def ready():
        with lock:
            return prepared()

    fits = {
        "classifier": lambda: M.end_to_end_model(ready(), M.train_logreg, "clean_text", cleaned=True, min_df=MIN_DF),
        "topics": lambda: fit_topics(ready()).pipeline(),
    }

    @inheritable_thread_target(spark)
    def stored(name):
        return model_store(spark, stored_path(spark, name, sf_dir), fits[name])

    # The classifier takes one task for most of its time, so the topics are found meanwhile.
    with ThreadPoolExecutor(len(fits)) as pool:
        classifier, found = pool.map(stored, fits)
    topics = TopicModel.of(found)

    def score(df):
        scored = classifier.transform(df)
        extra = [c for c in scored.columns if c not in df.columns and c != "scores"]
        return (
            scored.withColumns(
                {
                    "predicted_label": M.label_name(M.row_argmax(F.col("scores"))),
                    "confidence": M.row_max(F.col("scores")),
                }
            )
            .drop(*extra)
            .withColumnRenamed("scores", "probabilities")
        )

    return score, topics


@query("score_and_topic")
def _(spark, sf_dir):
    score, topics = _fitted(spark, sf_dir)
    texts = reviews(spark, sf_dir, heavy=True).select("review_id", "text")
    scored = score_and_topic(texts, score, topics)
    shares = [F.col("probabilities")[i].alias(f"p_{name}") for i, name in enumerate(LABELS)]
    return scored.select("review_id", *shares, "predicted_label", "confidence", "dominant_topic", "topic_label")


@query("enrich_reviews")
def _(spark, sf_dir):
    score, topics = _fitted(spark, sf_dir)
    return enrich_reviews(timed_reviews(spark, sf_dir, heavy=True), score, topics)


@query(
    "enrich_reviews_plain",
    """SELECT review_id, rating, title, text, timestamp, strftime(timestamp, '%Y-%m') AS year_month, helpful_vote, verified_purchase,
      sentiment_label FROM (SELECT * FROM labelled QUALIFY row_number() OVER (PARTITION BY text ORDER BY review_id) = 1) WHERE length(text) >= 20""",
)
def _(spark, sf_dir):
    """The columns of the enriched table that follow from the review alone."""
    score, topics = _fitted(spark, sf_dir)
    enriched = enrich_reviews(timed_reviews(spark, sf_dir, heavy=True), score, topics)
    return enriched.select(
        "review_id", "rating", "title", "text", "timestamp", "year_month", "helpful_vote", "verified_purchase", "sentiment_label"
    )


@query(
    "enrich_reviews_facts",
    """SELECT review_id, sentiment_label, strftime(timestamp, '%Y-%m') AS year_month, true AS named, true AS sure, true AS topic_named FROM clean_kept""",
)
def _(spark, sf_dir):
    """Every clean review comes out once, with one of the classes, a share as confidence, and a topic that has its name."""
    score, topics = _fitted(spark, sf_dir)
    enriched = enrich_reviews(timed_reviews(spark, sf_dir, heavy=True), score, topics)
    label = topic_label("dominant_topic", topics.names)
    return enriched.select(
        "review_id",
        "sentiment_label",
        "year_month",
        F.col("predicted_label").isin(*LABELS).alias("named"),
        F.col("confidence").between(1 / len(LABELS) - 1e-9, 1 + 1e-9).alias("sure"),
        (F.col("topic_label").eqNullSafe(label) & F.coalesce(F.col("dominant_topic").between(0, 11), F.lit(True))).alias("topic_named"),
    )
