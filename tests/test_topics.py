"""Topics: planted groups are found, merged and named; outliers stay apart."""

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from quillsift.operators import embedding_topics as B
from quillsift.operators import features as V
from quillsift.operators import topics as L
from quillsift.plans.catalog import topics as catalog
from quillsift.plans.catalog.topics import letter_encoder
from quillsift.plans.enrich import TopicModel, fit_topics
from quillsift.session import scratch_path
from quillsift.sources.sinks import model_store
from quillsift.sources.tables import review_vectors


@pytest.fixture(scope="module")
def planted(spark, sf_dir):
    vectors = review_vectors(spark, sf_dir).persist()
    found = B.density_topics(vectors, radius=0.5, min_points=5, min_topic_size=20, centres=128)
    return found.assign(vectors).persist()


def test_planted_groups_are_found(planted):
    rows = planted.collect()
    groups = defaultdict(set)
    for r in rows:
        if r["review_id"] % 5 == 0:
            assert r["topic"] == -1
        else:
            groups[r["label"]].add(r["topic"])
    assert len(groups) == 10 and all(len(g) == 1 for g in groups.values())
    assert {t for g in groups.values() for t in g} == set(range(10))
    sizes = Counter(r["topic"] for r in rows if r["topic"] >= 0)
    assert [sizes[t] for t in range(10)] == sorted(sizes.values(), reverse=True)


def test_small_groups_dissolve(spark):
    rows = [(i, [0.0, 0.0]) for i in range(50)] + [(100 + i, [9.0, 9.0]) for i in range(5)]
    points = spark.createDataFrame(rows, "review_id long, vec array<double>")
    topics = B.density_topics(points, radius=1.0, min_points=3, min_topic_size=20, centres=4).assign(points).collect()
    assert Counter(r["topic"] for r in topics) == {0: 50, -1: 5}


def test_a_third_of_the_rows_may_be_equal(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [1.0, 1.0, 0.0]) for i in range(400)]
    rows += [(1000 + i, (np.array([-1.0, 0.0, 1.0]) + 0.05 * rng.normal(size=3)).tolist()) for i in range(800)]
    points = spark.createDataFrame(rows, "review_id long, vec array<double>")
    topics = B.density_topics(points, radius=0.4, min_points=10, centres=16).assign(points).collect()
    assert Counter(r["topic"] for r in topics) == {0: 800, 1: 400}


def test_more_groups_than_centres(spark):
    rng = np.random.default_rng(7)
    places = rng.normal(size=(60, 8)) * 10
    rows = [(i, (places[i % 60] + 0.05 * rng.normal(size=8)).tolist()) for i in range(2400)]
    points = spark.createDataFrame(rows, "review_id long, vec array<double>").repartition(3)
    found = B.density_topics(points, radius=1.0, min_points=5, min_topic_size=20, centres=32).assign(points).collect()
    topics = defaultdict(set)
    for r in found:
        topics[r["review_id"] % 60].add(r["topic"])
    assert len(found) == 2400 and {t for s in topics.values() for t in s} == set(range(60))
    assert all(len(s) == 1 for s in topics.values())


def _plain_density(points, radius, min_points, least):
    """Every pair of rows compared; the topic of each row as a set of rows, None for outliers."""
    near = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2)) <= radius * (1 + 1e-9)
    dense = near.sum(axis=1) >= min_points
    label = np.arange(len(points))
    while True:
        new = np.array([min(label[j] for j in np.flatnonzero(near[i] & dense)) if dense[i] else label[i] for i in range(len(points))])
        if (new == label).all():
            break
        label = new
    out = {}
    for i, p in enumerate(points):
        reach = np.flatnonzero(near[i] & dense)
        if len(reach):
            out[i] = label[reach[np.argmin(((points[reach] - p) ** 2).sum(axis=1))]]
    sizes = Counter(out.values())
    return {i: {j for j in out if out[j] == t} for i, t in out.items() if sizes[t] >= least}


@pytest.mark.parametrize("block, centres", [(2048, 10), (8, 40), (20, 3)])
def test_topics_equal_those_of_all_pairs(spark, monkeypatch, block, centres):
    """Scattered groups, noise and repeated rows; few and many cells."""
    monkeypatch.setattr(B, "BLOCK_ROWS", block)
    rng = np.random.default_rng(block)
    points = np.concatenate([rng.normal(size=(60, 3)) * 0.5 + c for c in ([0, 0, 0], [3, 0, 0], [0, 4, 1])] + [rng.uniform(-3, 6, (60, 3))])
    points = np.concatenate([points, points[:20]])
    rows = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "review_id long, vec array<double>").repartition(3)
    found = B.density_topics(rows, radius=0.6, min_points=5, min_topic_size=10, centres=centres).assign(rows).collect()
    groups = defaultdict(set)
    for r in found:
        groups[r["topic"]].add(r["review_id"])
    want = _plain_density(points, 0.6, 5, 10)
    assert {r["review_id"]: groups[r["topic"]] for r in found if r["topic"] >= 0} == want
    assert len(groups) > 2


def test_vectors_of_separate_groups_do_not_meet():
    """Each vector goes to its own cell and few others, however many groups there are."""
    rng = np.random.default_rng(9)
    for count in (20, 200):
        places = rng.normal(size=(count, 16)) * 3
        points = (places.repeat(30, axis=0) + 0.05 * rng.normal(size=(30 * count, 16)))
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(points))), pa.array(list(points))], names=["_id", "_point"])
        placed = next(B._cells(places)([batch]))
        reach = np.zeros(count)
        np.maximum.at(reach, placed.column("_cell").to_numpy(), placed.column("_away").to_numpy())
        sent = next(B._targets(places, reach, 0.6)([batch]))
        assert len(points) <= sent.num_rows < 1.2 * len(points)


def test_a_chain_over_many_blocks_is_one_topic(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_ROWS", 16)
    rows = [(i, [0.9 * i, 0.0]) for i in range(200)] + [(1000, [0.0, 50.0]), (1001, None), (1002, [180.0, 0.0])]
    points = spark.createDataFrame(rows, "review_id long, vec array<double>")
    found = B.density_topics(points, radius=1.0, min_points=3, min_topic_size=20, centres=6).assign(points).collect()
    topics = {r["review_id"]: r["topic"] for r in found}
    assert len(topics) == 203 and {i for i, t in topics.items() if t == -1} == {1000, 1001}
    assert {t for i, t in topics.items() if i not in (1000, 1001)} == {0}


def test_merging_keeps_groups_whole(planted):
    merged = B.merge_topics(planted, n=4).collect()
    assert {r["topic"] for r in merged} == {-1, 0, 1, 2, 3}
    before = {r["review_id"]: r["topic"] for r in planted.collect()}
    mapping = defaultdict(set)
    for r in merged:
        mapping[before[r["review_id"]]].add(r["topic"])
    assert all(len(m) == 1 for m in mapping.values()) and mapping[-1] == {-1}


def _merge(means, sizes, n):
    """Average-linkage merging by cosine distance, pair after pair on the whole matrix; the new number of each topic."""
    unit = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-12)
    distance = np.round(1.0 - unit @ unit.T, 12)
    np.fill_diagonal(distance, np.inf)
    parts = [[i] for i in range(len(means))]
    alive = len(means)
    while alive > max(n, 1):
        a, b = sorted(np.unravel_index(np.argmin(distance), distance.shape))
        share = len(parts[a]) / (len(parts[a]) + len(parts[b]))
        joined = share * distance[a] + (1.0 - share) * distance[b]
        distance[a], distance[:, a] = joined, joined
        distance[b], distance[:, b] = np.inf, np.inf
        distance[a, a] = np.inf
        parts[a], parts[b] = parts[a] + parts[b], []
        alive -= 1
    groups = sorted((p for p in parts if p), key=lambda p: (-int(sizes[p].sum()), p[0]))
    return [next(g for g, part in enumerate(groups) if i in part) for i in range(len(means))]


@pytest.mark.parametrize("block, n", [(2048, 25), (16, 25), (16, 1), (7, 90), (2048, 100)])
def test_merging_in_rounds_equals_merging_on_a_matrix(spark, monkeypatch, block, n):
    """Also where the topics do not fit a block, and where they are fewer than asked for."""
    monkeypatch.setattr(B, "BLOCK_ROWS", block)
    rng = np.random.default_rng(n)
    means = rng.normal(size=(100, 6)) + 2 * rng.normal(size=(10, 6)).repeat(10, axis=0)
    sizes = rng.integers(1, 4, 100)
    rows = [(10 + i, m.tolist()) for i, m in enumerate(means) for _ in range(sizes[i])]
    rows += [(-1, [9.0] * 6), (-1, [0.0] * 6), (None, [1.0] * 6)]
    frame = spark.createDataFrame(rows, "topic int, vec array<double>").withColumns({"_id": F.lit(0), "_number": F.lit("x")})
    got = B.merge_topics(frame, n)
    assert got.columns == frame.columns
    by_vector = {tuple(r["vec"]): r["topic"] for r in got.collect()}
    want = _merge(means, sizes, n)
    assert [by_vector[tuple(m.tolist())] for m in means] == want
    assert by_vector[(9.0,) * 6] == -1 and by_vector[(1.0,) * 6] == -1
    assert B.merge_topics(frame.where("topic = -1"), n).count() == 2


def test_density_topics_survive_storage(spark, planted, sf_dir):
    vectors = review_vectors(spark, sf_dir)
    found = B.density_topics(vectors, radius=0.5, min_points=5, min_topic_size=20, centres=128)
    path = scratch_path(spark, "density")
    found.save(path)
    again = B.DensityTopics.load(spark, path)
    assert again.radius == found.radius and (again.pivots == found.pivots).all()
    assert sorted(r["topic"] for r in again.assign(vectors).collect()) == sorted(r["topic"] for r in planted.collect())


def test_ctfidf_by_hand(spark):
    rows = spark.createDataFrame([(0, "mug mug cup"), (0, "mug lid"), (1, "lamp cup"), (-1, "cup")], "topic int, clean_text string")
    words = {(r["topic"], r["term"]): r["weight"] for r in B.ctfidf_words(rows, min_df=1).collect()}
    counts = {0: {"mug": 3, "cup": 1, "lid": 1, "mug mug": 1, "mug cup": 1, "mug lid": 1}, 1: {"lamp": 1, "cup": 1, "lamp cup": 1}, -1: {"cup": 1}}
    mean = sum(sum(c.values()) for c in counts.values()) / 3
    for topic, terms in counts.items():
        for term, n in terms.items():
            everywhere = sum(c.get(term, 0) for c in counts.values())
            assert words[topic, term] == pytest.approx(n * np.log(1 + mean / everywhere))
    info = {r["Topic"]: r for r in B.topic_info(rows, B.ctfidf_words(rows, min_df=1)).collect()}
    assert info[0]["Count"] == 2 and info[0]["Name"].startswith("0_mug_")
    assert B.topic_summary(B.topic_info(rows, B.ctfidf_words(rows, min_df=1))).head().asDict() == {"topics": 2, "outliers": 1, "outlier_share": 25.0}


def test_summary_without_outliers(spark):
    info = spark.createDataFrame([(0, 5, "a"), (1, 5, "b")], "Topic long, Count long, Name string")
    assert B.topic_summary(info).head().asDict() == {"topics": 2, "outliers": 0, "outlier_share": 0.0}


def test_embedding_after_any_expression(spark):
    """The encoder's input and output may be parts of lambda expressions."""
    rows = spark.createDataFrame([("abc",), ("eee",)], "t string")
    ready = rows.withColumn("light_text", F.transform(F.array("t"), lambda x: F.upper(F.lower(x)))[0]).withColumn("light_text", F.lower("light_text"))
    embedded = B.embed_texts(ready, letter_encoder)
    totals = embedded.select(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x).alias("s")).collect()
    assert sorted(round(r["s"], 5) for r in totals) == [1.0, 1.0]


def test_lda_row_without_known_terms_has_no_topic(spark):
    rows = spark.createDataFrame(
        [(i, ["mug", "cup"] if i % 2 else ["lamp", "desk"]) for i in range(40)] + [(99, ["zzz"])], "review_id long, terms array<string>"
    )
    counter = V.count_features(rows, min_df=2)
    counts = counter.transform(rows)
    model = L.lda_fit(counts, topics=2, iterations=10)
    mixed = {r["review_id"]: r for r in L.add_dominant_topic(L.lda_topic_mix(model, counts), names={0: "Zero"}).collect()}
    assert mixed[99]["dominant_topic"] is None and mixed[99]["topic_label"] is None
    assert all(sum(r["mixture"]) == pytest.approx(1) for i, r in mixed.items() if i != 99)
    assert {r["topic_label"] for i, r in mixed.items() if i != 99} <= {"Zero", "Topic 1"}
    words = {r["topic"]: r["words"] for r in L.topic_top_words(model, counter, 2).collect()}
    assert set(words) == {0, 1} and all(len(w.split(", ")) == 2 for w in words.values())


def test_every_row_counts_in_the_topics(spark):
    """The topic-term matrix without its prior adds up to the counts of each term over all rows."""
    rows = [(i, ["mug"] * (1 + i % 4) + ["cup"] * (i % 3) + ["lamp", "desk"] * (i % 2) + [f"rare{i}"]) for i in range(60)]
    terms = spark.createDataFrame(rows, "review_id long, terms array<string>")
    counts = V.count_features(terms, min_df=1, max_df=1.0).transform(terms).persist()
    totals = np.sum([r["counts"].toArray() for r in counts.collect()], axis=0)
    for parts in (1, 5):
        matrix = L.lda_fit(counts.repartition(parts), topics=3, iterations=5).matrix
        assert (matrix - 1 / 3).sum(axis=0) == pytest.approx(totals, rel=1e-6)


def _plain_batch(counts, topics, iterations, seed=42):
    """Batch variational inference on dense rows, one row after the other."""
    prior, width = 1 / topics, counts.shape[1]
    matrix = np.random.default_rng(seed).gamma(100.0, 0.01, (topics, width))

    def expected(w):
        at = lambda x: np.vectorize(lambda v: (math.lgamma(v + 1e-5) - math.lgamma(v - 1e-5)) / 2e-5)(x)
        return np.exp(at(w) - at(w.sum(axis=-1, keepdims=True)))

    for _ in range(iterations):
        factors, total = expected(matrix), np.zeros((topics, width))
        for row in counts:
            gamma = np.ones(topics)
            for _ in range(100):
                theta = expected(gamma)
                new = prior + theta * (factors @ (row / (theta @ factors + 1e-100)))
                moved = np.abs(new - gamma).mean()
                gamma = new
                if moved < 1e-3:
                    break
            theta = expected(gamma)
            total += np.outer(theta, row / (theta @ factors + 1e-100))
        matrix = prior + factors * total
    return matrix


def test_topics_equal_a_plain_batch_fit(spark):
    """A planted corpus: three groups of words, mixed in some rows."""
    rng = np.random.default_rng(5)
    counts = np.zeros((45, 12))
    for i in range(45):
        counts[i, 4 * (i % 3) : 4 * (i % 3) + 4] = rng.integers(1, 6, 4)
        if i % 5 == 0:
            counts[i, rng.integers(0, 12)] += 2
    sparse = [(i, Vectors.sparse(12, {j: float(v) for j, v in enumerate(row) if v})) for i, row in enumerate(counts)]
    rows = spark.createDataFrame(sparse, ["review_id", "counts"])
    model = L.lda_fit(rows.repartition(4), topics=3, iterations=8)
    assert model.matrix == pytest.approx(_plain_batch(counts, 3, 8), rel=1e-2, abs=1e-2)
    found = {r["review_id"]: r["mixture"] for r in L.lda_topic_mix(model, rows).collect()}
    groups = [{int(np.argmax(found[i])) for i in range(g, 45, 3)} for g in range(3)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3


def test_digamma():
    x = np.array([1e-3, 0.08, 1.0, 2.5, 40.0])
    assert L.digamma(np.array([1.0]))[0] == pytest.approx(-0.5772156649015329, abs=1e-9)
    slope = [(math.lgamma(v * (1 + 1e-6)) - math.lgamma(v * (1 - 1e-6))) / (2e-6 * v) for v in x]
    assert L.digamma(x) == pytest.approx(slope, rel=1e-6)


def test_sums_of_many_tasks_meet_in_steps(spark, monkeypatch):
    monkeypatch.setattr(L, "FAN", 2)
    rows = spark.range(7).repartition(7).selectExpr("int(0) AS topic", "array(double(id), 1D) AS weights")
    assert L._added(rows, 7, 1, 2).tolist() == [[21.0, 7.0]]


def test_topic_model_survives_storage(spark):
    rows = spark.createDataFrame([(i, "mug cup mug" if i % 2 else "lamp desk") for i in range(30)] + [(99, None)], "review_id long, clean_text_no_stopwords string")
    model = fit_topics(rows, topics=2, iterations=5, min_df=2, max_df=0.9)
    path = scratch_path(spark, "topics")
    again = TopicModel.of(model_store(spark, path, model.pipeline))
    assert sorted(again.apply(rows).collect()) == sorted(model.apply(rows).collect())


def test_topic_queries_fit_in_full(monkeypatch):
    seen = []
    monkeypatch.setattr(catalog, "_counts", lambda spark, sf_dir: (None, None))
    monkeypatch.setattr(L, "lda_fit", lambda counts, topics=12, iterations=30: seen.append(iterations))
    catalog._topic_model(None, "")
    assert seen == [30]


def test_inference_of_rows_of_all_sizes_is_that_of_each_row():
    rng = np.random.default_rng(3)
    terms = L._expected(rng.gamma(100.0, 0.01, (5, 400)))
    sizes = np.concatenate([[0, 1, 300, 0], rng.integers(1, 120, 60)])
    columns = np.concatenate([np.sort(rng.choice(400, n, replace=False)) for n in sizes]).astype(np.int64)
    rows = L.SparseRows(np.repeat(np.arange(len(sizes)), sizes), columns, rng.integers(1, 9, len(columns)).astype(float), (len(sizes), 400))
    assert any(len(set(sizes[group])) > 1 for group in L._alike(sizes))
    gamma, share, theta = L.infer(rows, terms, 0.2)
    for i, n in enumerate(sizes):
        own = rows.rows == i
        factor, values, want = terms.T[columns[own]], rows.values[own], np.full(5, 1.0 if n else 0.2)
        for _ in range(L.STEPS if n else 0):
            weight = np.exp(L.digamma(want) - L.digamma(np.array([want.sum()])))
            new = 0.2 + weight * (values / (factor @ weight)) @ factor
            want, change = new, np.abs(new - want).mean()
            if change < L.CHANGE:
                break
        np.testing.assert_allclose(gamma[i], want, rtol=1e-9)
        np.testing.assert_allclose(share[own], values / (factor @ theta[i]), rtol=1e-9)


def test_only_vectors_that_are_not_dense_are_compared_with_dense_ones(spark, monkeypatch):
    rng = np.random.default_rng(4)
    points = np.concatenate([rng.normal(size=(60, 3)) * 0.05 + 3.0 * k for k in range(3)] + [rng.uniform(-9, 9, size=(20, 3))])
    rows = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "review_id long, vec array<double>")
    real, compared = B._nearest, []

    def counted(points, *rest):
        compared.append(points.count())
        return real(points, *rest)

    monkeypatch.setattr(B, "_nearest", counted)
    found = B.density_topics(rows, radius=0.3, min_points=5, min_topic_size=20, centres=4)
    topics = {r["review_id"]: r["topic"] for r in found.assign(rows).collect()}
    near = np.linalg.norm(points[:, None] - points, axis=2) <= 0.3
    dense = near.sum(axis=1) >= 5
    assert compared == [(~dense).sum()] * 2
    assert all((topics[i] >= 0) == (near[i] & dense).any() for i in range(len(points)))
    assert len({topics[i] for i in range(180)} - {B.OUTLIER}) == 3


def test_a_block_meets_others_without_being_copied_for_both_sides(spark):
    """The pairs of blocks are dealt once, by the second block."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.createDataFrame([(i, 1, [float(i % 7), 0.0]) for i in range(50)], B._POINT)
        pivots = np.array([[0.0, 0.0], [5.0, 0.0]])
        met = B._compared(rows, B._blocks(rows, pivots), pivots, 1.0, B._weigh(1.0), "_id long, n long")
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 4  # sizes of cells, packing, pairs by block, the blocks themselves
        assert {r["_id"]: r["n"] for r in met.groupBy("_id").agg(F.sum("n").alias("n")).collect()} == {
            i: sum(abs(i % 7 - j % 7) <= 1 for j in range(50)) for i in range(50)
        }
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
