"""Queries over topics from word counts and from embeddings."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from quillsift.functions import text as X
from quillsift.functions.columns import full_text
from quillsift.operators import embedding_topics as B
from quillsift.operators import features as V
from quillsift.operators import topics as L
from quillsift.plans.catalog.tables import topical
from quillsift.plans.catalog.text import cleaned
from quillsift.plans.registry import query, rounded, view
from quillsift.session import cut_lineage, spread
from quillsift.sources.tables import review_vectors, reviews


def _counts(spark, sf_dir):
    """Term counts of the stop-word-free texts, and the fitted counter."""
    terms = V.Terms(inputCol="clean_text_no_stopwords", outputCol="terms").transform(cleaned(spark, sf_dir))
    ready = spread(cut_lineage(terms.select("review_id", "terms")), "review_id")
    counter = V.count_features(ready)
    return cut_lineage(counter.transform(ready).select("review_id", "counts")), counter


def _topic_model(spark, sf_dir):
    counts, counter = _counts(spark, sf_dir)
    return L.lda_fit(counts), counts, counter


@query("lda_fit")
def _(spark, sf_dir):
    model, _, _ = _topic_model(spark, sf_dir)
    return model.describe_topics(10)


@query("lda_topic_mix")
def _(spark, sf_dir):
    model, counts, _ = _topic_model(spark, sf_dir)
    return L.lda_topic_mix(model, counts).select("review_id", "mixture")


@query("dominant_topic")
def _(spark, sf_dir):
    model, counts, _ = _topic_model(spark, sf_dir)
    mixed = L.add_dominant_topic(L.lda_topic_mix(model, counts))
    return mixed.select("review_id", "dominant_topic", "topic_label")


@query(
    "lda_facts",
    """SELECT count(*) AS n_rows, true AS shares, true AS terms_in_order, 12 AS topics FROM cleaned""",
)
def _(spark, sf_dir):
    """Shares of all rows add up to one, or to zero without a known term; every topic lists its heaviest terms first."""
    model, counts, _ = _topic_model(spark, sf_dir)
    mixed = L.lda_topic_mix(model, counts).select("counts", F.aggregate("mixture", F.lit(0.0), lambda a, x: a + x).alias("total"))
    known = F.size(F.unwrap_udt("counts")["values"]) > 0
    right = F.when(known, F.abs(F.col("total") - 1) < 1e-9).otherwise(F.col("total") == 0)
    weights = F.col("termWeights")
    ordered = F.forall(F.sequence(F.lit(1), F.size(weights) - 1), lambda i: weights[i - 1] >= weights[i])
    lists = model.describe_topics(10).agg(F.every(ordered & (F.size(weights) == 10)).alias("in_order"), F.count("*").cast("int").alias("n"))
    return mixed.agg(
        F.count("*").alias("n_rows"),
        F.every(right).alias("shares"),
        lists.select("in_order").scalar().alias("terms_in_order"),
        lists.select("n").scalar().alias("topics"),
    )


@query("topic_top_words")
def _(spark, sf_dir):
    model, _, counter = _topic_model(spark, sf_dir)
    return L.topic_top_words(model, counter)


def letter_encoder():
    """Stands in for a pretrained encoder: how often each of 16 letters occurs, at unit length."""

    def encode(texts: np.ndarray) -> np.ndarray:
        counts = np.array([[t.count(c) for c in "etaoinshrdluçñüé"] for t in texts], dtype=np.float32)
        return counts / np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-9)

    return encode


_LETTERS = "etaoinshrdluçñüé"


@query(
    "embed_texts",
    f"""WITH lit AS (SELECT review_id, trim(regexp_replace(regexp_replace(replace(full_text, '&amp;', '&'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM joined),
    counted AS (SELECT review_id, [{", ".join(f"(length(t) - length(replace(t, '{c}', '')))::DOUBLE" for c in _LETTERS)}] AS v FROM lit)
    SELECT review_id, round(list_sum(list_transform(v, lambda x: x)) / greatest(sqrt(list_sum(list_transform(v, lambda x: x * x))), 1e-9), 3) AS total FROM counted""",
)
def _(spark, sf_dir):
    rows = reviews(spark, sf_dir, heavy=True).select("review_id", X.light_clean(full_text()).alias("light_text"))
    embedded = B.embed_texts(rows, letter_encoder)
    total = F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x)
    return embedded.select("review_id", F.round(total, 3).alias("total"))


def _reduced(spark, sf_dir):
    tokens = X.tokenize_words(F.col("clean_text_no_stopwords"))
    ready = cleaned(spark, sf_dir).select("review_id", "clean_text", tokens.alias("tokens"))
    ready = spread(cut_lineage(ready), "review_id")
    embedded = B.fit_hashed_embedding(ready).transform(ready)
    reduced = B.reduce_dims(embedded, 8)
    return reduced.select("review_id", "clean_text", vector_to_array("reduced").alias("vec"))


@query("reduce_dims")
def _(spark, sf_dir):
    return _reduced(spark, sf_dir).select("review_id", "vec")


def _planted(spark, sf_dir):
    """Vectors with planted groups, and topics found in them."""
    vectors = review_vectors(spark, sf_dir)
    found = B.density_topics(vectors, radius=0.5, min_points=5, min_topic_size=20, centres=256)
    return found.assign(vectors)


@query(
    "density_topics",
    """SELECT vec_id AS review_id, label, vec_id % 5 = 0 AS outlier,
    count(*) OVER (PARTITION BY vec_id % 5 = 0, CASE WHEN vec_id % 5 = 0 THEN -1 ELSE label END) AS topic_rows FROM embeddings""",
)
def _(spark, sf_dir):
    """Each row with the size of its topic: the planted groups and the noise must come out."""
    found = _planted(spark, sf_dir).select("review_id", "label", "topic")
    sizes = found.groupBy("topic").agg(F.count("*").alias("topic_rows"))
    return found.join(sizes, "topic").select("review_id", "label", (F.col("topic") == B.OUTLIER).alias("outlier"), "topic_rows")


@query("merge_topics")
def _(spark, sf_dir):
    return B.merge_topics(_planted(spark, sf_dir), n=4).select("review_id", "label", "topic")


@query(
    "merge_topics_facts",
    """SELECT label, count(*) AS n, CAST(1 AS BIGINT) AS topics, (SELECT least(4, count(DISTINCT label)) FROM embeddings WHERE vec_id % 5 <> 0) AS merged
    FROM embeddings WHERE vec_id % 5 <> 0 GROUP BY 1""",
)
def _(spark, sf_dir):
    """The planted groups stay whole when topics merge, and as many topics as asked for are left."""
    planted = B.merge_topics(_planted(spark, sf_dir), n=4).filter(F.col("topic") != B.OUTLIER)
    left = planted.agg(F.count_distinct("topic")).scalar()
    return planted.groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("topic").alias("topics")).withColumn("merged", left)


@query("embedding_topics")
def _(spark, sf_dir):
    """The whole chain over texts: embed, reduce, group, name, and merge to fewer topics."""
    rows = _reduced(spark, sf_dir)
    found = B.density_topics(rows, radius=0.15, min_points=5, min_topic_size=15, centres=64)
    merged = cut_lineage(B.merge_topics(found.assign(rows), n=10))
    return B.topic_view_other(B.topic_info(merged, B.ctfidf_words(merged, min_df=1)))


def _both_tables(spark, sf_dir):
    rows = _reduced(spark, sf_dir)
    found = B.density_topics(rows, radius=0.15, min_points=5, min_topic_size=15, centres=64)
    return B.topic_tables(cut_lineage(found.assign(rows)), n=10, min_df=1)


@query("embedding_topic_tables")
def _(spark, sf_dir):
    """The topics of the texts as found, and beside them as merged."""
    return _both_tables(spark, sf_dir)


@query(
    "embedding_topic_totals",
    "SELECT stage, (SELECT count(*) FROM cleaned) AS n_rows, true AS few_enough FROM (VALUES ('found'), ('merged')) s(stage)",
)
def _(spark, sf_dir):
    """Every text is in one topic of each table, and merging leaves ten topics at most."""
    topics = F.count_if(F.col("Topic") >= 0)
    return _both_tables(spark, sf_dir).groupBy("stage").agg(F.sum("Count").alias("n_rows"), topics.alias("n")).select(
        "stage", "n_rows", ((F.col("stage") == "found") | (F.col("n") <= 10)).alias("few_enough")
    )


# Class-based tf-idf with a topic that SQL knows as well: the language of the text, one as outlier.

_TOPIC = "CASE WHEN rating = 5 THEN -1 WHEN rating = 4 THEN 0 WHEN rating = 3 THEN 1 ELSE 2 END"


def _grouped(spark, sf_dir):
    return cleaned(spark, sf_dir).withColumn("topic", F.expr(_TOPIC))


view(
    "topic_counts",
    f"""SELECT topic, term, count(*) AS n FROM (
      SELECT topic, unnest(list_concat(t, list_transform(range(1, greatest(len(t), 1)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM (
        SELECT {_TOPIC} AS topic, list_filter(string_split(clean_text, ' '), lambda w: length(w) >= 2
          AND NOT list_contains([{", ".join(repr(w) for w in X.ENGLISH_STOP_WORDS)}], w)) AS t FROM cleaned)) GROUP BY 1, 2""",
)
view(
    "distinctive",
    """SELECT topic, term, n, n * ln(1.0::DOUBLE + mean / everywhere) AS weight FROM (
      SELECT *, sum(n) OVER ()::DOUBLE / (SELECT count(DISTINCT topic) FROM topic_counts) AS mean FROM (
        SELECT *, sum(n) OVER (PARTITION BY term) AS everywhere, count(*) OVER (PARTITION BY term) AS topics FROM topic_counts)
      WHERE topics >= 2)""",
)
view(
    "distinctive_top",
    """SELECT topic, CAST(row_number() OVER (PARTITION BY topic ORDER BY round(weight, 9) DESC, term) AS INT) AS rank, term, n,
      round(weight, 6) AS weight FROM distinctive QUALIFY rank <= 10""",
)
view(
    "topic_names",
    f"""SELECT CAST(c.topic AS BIGINT) AS "Topic", c.n AS "Count", c.topic || '_' || w.words AS "Name"
    FROM (SELECT {_TOPIC} AS topic, count(*) AS n FROM cleaned GROUP BY 1) c
    JOIN (SELECT topic, string_agg(term, '_' ORDER BY rank) AS words FROM distinctive_top WHERE rank <= 4 GROUP BY 1) w ON c.topic = w.topic""",
)


@query("ctfidf_words", "SELECT topic, rank, term, n, weight FROM distinctive_top")
def _(spark, sf_dir):
    return rounded(B.ctfidf_words(_grouped(spark, sf_dir), min_df=2), "weight")


def _info(spark, sf_dir):
    grouped = _grouped(spark, sf_dir)
    return B.topic_info(grouped, B.ctfidf_words(grouped, min_df=2))


@query("topic_info", "SELECT * FROM topic_names")
def _(spark, sf_dir):
    return _info(spark, sf_dir)


view(
    "topic_sizes",
    'SELECT CAST(coalesce(dominant_topic, -1) AS BIGINT) AS "Topic", count(*) AS "Count", min(coalesce(topic_label, \'none\')) AS "Name" FROM topical GROUP BY 1',
)


def _sizes(spark, sf_dir):
    topic = F.coalesce("dominant_topic", F.lit(B.OUTLIER)).cast("bigint")
    name = F.min(F.coalesce("topic_label", F.lit("none")))
    return topical(spark, sf_dir).groupBy(topic.alias("Topic")).agg(F.count("*").alias("Count"), name.alias("Name"))


@query(
    "topic_summary",
    """SELECT count(*) FILTER ("Topic" >= 0) AS topics, CAST(sum("Count") FILTER ("Topic" = -1) AS BIGINT) AS outliers,
    round(sum("Count") FILTER ("Topic" = -1) * 100.0 / sum("Count"), 6)::DOUBLE AS outlier_share FROM topic_sizes""",
)
def _(spark, sf_dir):
    return rounded(B.topic_summary(_sizes(spark, sf_dir)), "outlier_share")


@query("topic_view_other", """SELECT "Topic", "Count", CASE WHEN "Topic" = -1 THEN 'Other (misc)' ELSE "Name" END AS "Name" FROM topic_sizes""")
def _(spark, sf_dir):
    return B.topic_view_other(_sizes(spark, sf_dir))
