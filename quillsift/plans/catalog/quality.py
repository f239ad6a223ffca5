"""Queries over table quality, samples, splits, joins and top rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillsift.functions import columns as C
from quillsift.functions.arrays import row_argmax, row_max
from quillsift.operators import joins, quality, sampling, topk
from quillsift.plans.catalog.tables import facts, labelled, topical
from quillsift.plans.registry import query, rounded, view
from quillsift.sources.tables import reviews, scored_reviews, table, timed_reviews

_TYPES = {
    "review_id": "bigint", "rating": "double", "title": "string", "text": "string", "asin": "string",
    "user_id": "string", "timestamp": "timestamp", "helpful_vote": "bigint", "verified_purchase": "boolean",
}


def _key(seed, row_id="review_id"):
    return f"CAST('0x' || substr(md5('{seed}:' || CAST({row_id} AS VARCHAR)), 1, 15) AS BIGINT)"


@query(
    "table_profile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{t}' AS type, count(*) AS rows, count({c}) AS non_null FROM timed" for c, t in _TYPES.items()
    ),
)
def _(spark, sf_dir):
    return quality.table_profile(timed_reviews(spark, sf_dir))


@query(
    "null_counts",
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls FROM timed" for c in _TYPES),
)
def _(spark, sf_dir):
    return quality.null_counts(timed_reviews(spark, sf_dir))


@query("dup_row_count", "SELECT (SELECT count(*) FROM facts) - (SELECT count(*) FROM (SELECT DISTINCT * FROM facts)) AS duplicates")
def _(spark, sf_dir):
    return quality.dup_row_count(facts(spark, sf_dir).drop("year_month", "date"))


@query("dup_text_count", "SELECT (SELECT count(*) FROM reviews) - (SELECT count(*) FROM (SELECT DISTINCT text FROM reviews)) AS duplicates")
def _(spark, sf_dir):
    return quality.dup_text_count(reviews(spark, sf_dir))


@query("dedup_rows", "SELECT DISTINCT title, text, rating FROM reviews")
def _(spark, sf_dir):
    return quality.dedup_rows(reviews(spark, sf_dir).select("title", "text", "rating"))


_FIRST_TEXT = "SELECT * FROM timed QUALIFY row_number() OVER (PARTITION BY text ORDER BY review_id) = 1"


@query("dedup_text_keep_first", f"SELECT review_id, rating, text FROM ({_FIRST_TEXT})")
def _(spark, sf_dir):
    return quality.dedup_text_keep_first(timed_reviews(spark, sf_dir).select("review_id", "rating", "text"))


def _described(column):
    return f"""SELECT '{column}' AS "column", count({column}) AS count, round(avg({column}), 6) AS mean,
      round(stddev_samp({column}), 6) AS std, CAST(min({column}) AS DOUBLE) AS min, CAST(max({column}) AS DOUBLE) AS max,
      round(quantile_cont(CAST({column} AS DOUBLE), 0.25), 6) AS p25, round(quantile_cont(CAST({column} AS DOUBLE), 0.5), 6) AS p50,
      round(quantile_cont(CAST({column} AS DOUBLE), 0.75), 6) AS p75 FROM measured"""


view("measured", "SELECT rating, helpful_vote, length(text) AS text_length FROM reviews")


@query("describe_numeric", " UNION ALL ".join(_described(c) for c in ("rating", "helpful_vote", "text_length")))
def _(spark, sf_dir):
    measured = reviews(spark, sf_dir).withColumn("text_length", C.char_length("text"))
    described = quality.describe_numeric(measured, ["rating", "helpful_vote", "text_length"])
    return rounded(described, "mean", "std", "p25", "p50", "p75")


@query("argmax_row", "SELECT review_id, text FROM reviews ORDER BY length(text) DESC, review_id LIMIT 1")
def _(spark, sf_dir):
    return quality.argmax_row(reviews(spark, sf_dir), C.char_length("text"), ["review_id", "text"])


@query("preview_short", "SELECT review_id, rating, text FROM reviews WHERE length(text) < 20 ORDER BY review_id LIMIT 10")
def _(spark, sf_dir):
    return quality.preview_short(reviews(spark, sf_dir)).select("review_id", "rating", "text")


@query("clean_dataset", f"SELECT * FROM ({_FIRST_TEXT}) WHERE length(text) >= 20")
def _(spark, sf_dir):
    return quality.clean_dataset(timed_reviews(spark, sf_dir))


@query(
    "clean_dataset_counts",
    f"""SELECT (SELECT count(*) FROM timed) AS rows_in,
    (SELECT count(*) FROM (SELECT DISTINCT * EXCLUDE (review_id) FROM timed)) AS after_row_dedup,
    (SELECT count(*) FROM ({_FIRST_TEXT})) AS after_text_dedup,
    (SELECT count(*) FROM ({_FIRST_TEXT}) WHERE length(text) >= 20) AS rows_out""",
)
def _(spark, sf_dir):
    return quality.clean_dataset_counts(timed_reviews(spark, sf_dir))


# Samples and splits: the random key is an MD5 digest, which SQL can work out too.


def _slim(spark, sf_dir):
    return labelled(spark, sf_dir).select("review_id", "rating", "sentiment_label")


_SLIM = "SELECT review_id, rating, sentiment_label FROM labelled"


@query("reservoir_sample", f"{_SLIM} WHERE year(timestamp) >= 2019 ORDER BY {_key(42)}, review_id LIMIT 500")
def _(spark, sf_dir):
    recent = C.filter_min_year(labelled(spark, sf_dir)).select("review_id", "rating", "sentiment_label")
    return sampling.reservoir_sample(recent, 500)


@query("sample_n", f"{_SLIM} ORDER BY {_key(7)}, review_id LIMIT 300")
def _(spark, sf_dir):
    return sampling.sample_n(_slim(spark, sf_dir), 300, seed=7)


@query("sample_n_per_group", f"{_SLIM} QUALIFY row_number() OVER (PARTITION BY sentiment_label ORDER BY {_key(42)}, review_id) <= 100")
def _(spark, sf_dir):
    return sampling.sample_n_per_group(_slim(spark, sf_dir), "sentiment_label", 100)


@query(
    "sample_frac_per_group",
    f"""{_SLIM} QUALIFY row_number() OVER (PARTITION BY sentiment_label ORDER BY {_key(42)}, review_id)
    <= round_even(0.3::DOUBLE * count(*) OVER (PARTITION BY sentiment_label), 0)""",
)
def _(spark, sf_dir):
    return sampling.sample_frac_per_group(_slim(spark, sf_dir), "sentiment_label", 0.3)


view(
    "quotas",
    """SELECT sentiment_label, n * t // a + CAST(row_number() OVER (ORDER BY n * t % a DESC, sentiment_label)
        <= t - sum(n * t // a) OVER () AS BIGINT) AS quota
    FROM (SELECT sentiment_label, CAST(count(*) AS HUGEINT) AS n, CAST(sum(count(*)) OVER () AS HUGEINT) AS a,
          CAST(ceil(sum(count(*)) OVER () * 0.2) AS HUGEINT) AS t FROM labelled GROUP BY 1)""",
)
view(
    "split_rows",
    f"""SELECT l.review_id, l.sentiment_label, CASE WHEN row_number() OVER (PARTITION BY l.sentiment_label
        ORDER BY {_key(42, "l.review_id")}, l.review_id) <= q.quota THEN 'test' ELSE 'train' END AS split
    FROM labelled l JOIN quotas q ON l.sentiment_label = q.sentiment_label""",
)


@query("stratified_split", "SELECT l.review_id, rating, l.sentiment_label, s.split FROM labelled l JOIN split_rows s ON l.review_id = s.review_id")
def _(spark, sf_dir):
    return sampling.stratified_split(_slim(spark, sf_dir))


@query("persist_split", "SELECT review_id, sentiment_label, split FROM split_rows")
def _(spark, sf_dir):
    return sampling.persist_split(_slim(spark, sf_dir))


@query("lookup_split", "SELECT review_id, rating, sentiment_label FROM labelled WHERE review_id IN (SELECT review_id FROM split_rows WHERE split = 'test')")
def _(spark, sf_dir):
    rows = _slim(spark, sf_dir)
    return sampling.lookup_split(rows, sampling.persist_split(rows))


@query(
    "class_shares",
    """SELECT split, sentiment_label, n, round(n * 100.0 / sum(n) OVER (PARTITION BY split), 6)::DOUBLE AS share FROM (
      SELECT s.split, sentiment_label, count(*) AS n FROM split_rows s GROUP BY 1, 2
      UNION ALL SELECT 'all', sentiment_label, count(*) FROM split_rows GROUP BY 2)""",
)
def _(spark, sf_dir):
    return rounded(sampling.class_shares(sampling.persist_split(_slim(spark, sf_dir))), "share")


@query(
    "stratified_kfold",
    f"""SELECT review_id, sentiment_label, CAST((row_number() OVER (PARTITION BY sentiment_label
      ORDER BY {_key(42)}, review_id) - 1) % 3 AS INT) AS fold FROM labelled""",
)
def _(spark, sf_dir):
    return sampling.stratified_kfold(_slim(spark, sf_dir))


@query(
    "topic_examples",
    f"""SELECT review_id, topic_label, rating, helpful_vote FROM (
      SELECT * FROM topical WHERE topic_label IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY topic_label ORDER BY review_id) <= 200)
    QUALIFY row_number() OVER (PARTITION BY topic_label ORDER BY {_key(42)}, review_id) <= 10""",
)
def _(spark, sf_dir):
    examples = sampling.topic_examples(topical(spark, sf_dir))
    return examples.select("review_id", "topic_label", "rating", "helpful_vote")


# Joins and unions.


def _even_topics(spark, sf_dir):
    """Topics of a sample of the reviews."""
    return topical(spark, sf_dir).filter("verified_purchase").select("review_id", "dominant_topic", "topic_label")


@query(
    "join_topics_back",
    """SELECT r.review_id, r.rating, t.dominant_topic, t.topic_label FROM reviews r
    LEFT JOIN (SELECT * FROM topical WHERE verified_purchase) t ON r.review_id = t.review_id""",
)
def _(spark, sf_dir):
    full = reviews(spark, sf_dir).select("review_id", "rating")
    return joins.join_topics_back(full, _even_topics(spark, sf_dir))


@query("semi_split", "SELECT review_id, confidence FROM scored WHERE review_id IN (SELECT review_id FROM split_rows WHERE split = 'test')")
def _(spark, sf_dir):
    split = sampling.persist_split(_slim(spark, sf_dir))
    return sampling.lookup_split(scored_reviews(spark, sf_dir).select("review_id", "confidence"), split)


@query("lookup_labels", "SELECT d.doc_id, d.doc_id % 30 AS topic, coalesce(n.n_name, 'Topic ' || CAST(d.doc_id % 30 AS VARCHAR)) AS topic_name FROM documents d LEFT JOIN nation n ON d.doc_id % 30 = n.n_nationkey")
def _(spark, sf_dir):
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("topic"), F.col("n_name").alias("topic_name"))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 30).alias("topic"))
    return C.lookup_labels(rows, names, "topic", "topic_name")


@query("attach_rating", "SELECT s.review_id, s.predicted_label, s.confidence, r.rating FROM scored s JOIN reviews r ON s.review_id = r.review_id")
def _(spark, sf_dir):
    predictions = scored_reviews(spark, sf_dir).select("review_id", "predicted_label", "confidence")
    return joins.attach_rating(predictions, reviews(spark, sf_dir))


@query(
    "flag_membership",
    """SELECT r.review_id, CASE WHEN t.review_id IS NULL THEN 'outside' ELSE 'inside' END AS place FROM reviews r
    LEFT JOIN (SELECT review_id FROM topical WHERE verified_purchase) t ON r.review_id = t.review_id""",
)
def _(spark, sf_dir):
    full = reviews(spark, sf_dir).select("review_id")
    return joins.flag_membership(full, _even_topics(spark, sf_dir), "inside", "outside", "place")


@query("union_batches", "SELECT review_id, rating FROM reviews UNION ALL SELECT review_id, rating FROM facts")
def _(spark, sf_dir):
    return joins.union_batches(
        [df.select("review_id", "rating") for df in (reviews(spark, sf_dir), facts(spark, sf_dir))]
    )


# Ranked rows and reductions over vectors.

_PREDICTION = ["review_id", "true_label", "predicted_label", "confidence"]


def _predictions(spark, sf_dir):
    return scored_reviews(spark, sf_dir).select(*_PREDICTION)


@query("most_confident", f"SELECT {', '.join(_PREDICTION)} FROM scored ORDER BY confidence DESC, review_id LIMIT 10")
def _(spark, sf_dir):
    return topk.most_confident(_predictions(spark, sf_dir))


@query("least_confident", f"SELECT {', '.join(_PREDICTION)} FROM scored ORDER BY confidence, review_id LIMIT 10")
def _(spark, sf_dir):
    return topk.least_confident(_predictions(spark, sf_dir))


@query("confident_errors", f"SELECT {', '.join(_PREDICTION)} FROM scored WHERE true_label <> predicted_label ORDER BY confidence DESC, review_id LIMIT 10")
def _(spark, sf_dir):
    return topk.confident_errors(_predictions(spark, sf_dir))


@query("k_smallest", f"SELECT review_id, {_key(42)} AS key FROM reviews ORDER BY key, review_id LIMIT 25")
def _(spark, sf_dir):
    keyed = reviews(spark, sf_dir).select("review_id", sampling.sample_key(42).alias("key"))
    return topk.k_smallest(keyed, "key", 25)


@query("row_argmax", "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) AS at FROM embeddings")
def _(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", row_argmax(F.col("embedding")).alias("at"))


@query("row_max", "SELECT vec_id, round(CAST(list_max(embedding) AS DOUBLE), 6) AS best FROM embeddings")
def _(spark, sf_dir):
    best = row_max(F.col("embedding")).cast("double")
    return rounded(table(spark, sf_dir, "embeddings").select("vec_id", best.alias("best")), "best")
