"""Counts of terms by messages, against plain dictionaries."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import IllegalArgumentException
from pyspark.sql import functions as F

from quillsift.operators import features as V
from quillsift.operators import tallies as T
from quillsift.operators.words import bigram_counts

ROWS = [
    (1, ["a", "b", "a"], 1),
    (2, ["b", "", "ä é"], 2),
    (2, ["b", "c"], 1),  # the key twice
    (3, [], 1),
    (4, None, 2),
    (None, ["a", "c c"], 1),
    (None, ["a"], 2),
    *[(i, ["a", f"w{i % 5}", f"w{i % 3}"], i % 3) for i in range(10, 60)],
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "review_id long, terms array<string>, kind int").repartition(7)


def test_tallies_by_hand(rows):
    n, df = Counter(), Counter()
    for _, terms, kind in ROWS:
        n.update((kind, t) for t in terms or [])
        df.update((kind, t) for t in set(terms or []))
    got = T.term_tallies(rows, F.col("terms"), 500_000, F.col("kind")).collect()
    assert {(int(r["name"]), r.term): (r.n, r.df) for r in got} == {k: (n[k], df[k]) for k in n} and len(got) == len(n)
    whole = T.term_tallies(rows, F.col("terms"), len(ROWS)).collect()
    assert {r.term: r.n for r in whole} == {t: sum(c for (_, u), c in n.items() if u == t) for _, t in n}


@pytest.mark.parametrize("least, share", [(1, 1.0), (2, 0.5), (1000, 1.0)])
def test_counts_of_repeated_and_missing_keys(rows, least, share):
    n = Counter((key, t) for key, terms, _ in ROWS for t in terms or [])
    df = Counter(t for _, t in n)
    used = {t for t in df if least <= df[t] <= share * len(ROWS)}
    got = V.term_counts(rows, min_df=least, max_df=share).collect()
    assert {(r.review_id, r.term): (r.n, r.df) for r in got} == {(k, t): (c, df[t]) for (k, t), c in n.items() if t in used}
    assert len(got) == len({k for k in n if k[1] in used})


def test_weights_move_no_row_per_term(spark):
    """An exchange that gets a row for each term of each text, or a window over them, grows with all words."""
    rows = spark.createDataFrame([(i, ["a", "b", f"c{i}"]) for i in range(50)], "review_id long, terms array<string>")
    for df in (V.term_counts(rows, min_df=1), V.tfidf_weights(rows, min_df=1), V.document_frequency(rows)):
        plan = df._jdf.queryExecution().toString()
        assert "Generate" not in plan and "Window" not in plan
    texts = spark.createDataFrame([("good soap bad smell",)], "clean_text string")
    assert "Generate" not in bigram_counts(texts)._jdf.queryExecution().toString()


@pytest.mark.parametrize("parts", [1, 5])
def test_vocabulary_ties_go_by_the_term(spark, parts):
    rows = spark.createDataFrame([([f"w{i}", f"w{i + 1}", "z"],) for i in range(20)], "terms array<string>").repartition(parts)
    model = V.count_features(rows, min_df=1, max_df=1.0, max_features=6)
    assert model.vocabulary == ["z", "w1", "w10", "w11", "w12", "w13"]
    assert V.count_features(rows, min_df=2, max_df=0.5).vocabulary == sorted(f"w{i}" for i in range(1, 20))
    with pytest.raises(IllegalArgumentException):
        V.count_features(rows, min_df=21, max_df=1.0)


def test_buckets_depend_on_the_term_alone():
    words = pa.array([f"w{i}" for i in range(1000)] + ["", "é", "a b"])
    whole = T._bucket(words, 97)
    assert (T._bucket(words.slice(990), 97) == whole[990:]).all()
    assert np.bincount(whole, minlength=97).max() < 40
    x = np.array([0, 1, 255, 256, 2**32 - 1])
    assert (T.numbers(T.packed_numbers(x)) == x).all() and len(T.numbers(b"")) == 0
