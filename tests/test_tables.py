"""Sources, sinks, stage reuse, quality and aggregates."""

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import Tokenizer
from pyspark.sql import functions as F

from quillsift.functions import columns as C
from quillsift.operators import aggregates, mismatch, quality
from quillsift.session import cut_lineage, scratch_path, shared_dir
from quillsift.sources import readers, sinks
from quillsift.sources.schemas import TOPIC_INFO


def test_scan_jsonl_keeps_broken_lines(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text('{"review_id": 1, "rating": 5, "text": "a\\nb", "images": [{"u": 1}]}\nnot json\n{"review_id": 2, "timestamp": 1546300800000}\n')
    rows = readers.scan_jsonl(spark, str(path), corrupt=readers.CORRUPT).collect()
    assert [r["review_id"] for r in rows] == [1, None, 2]
    assert rows[0]["text"] == "a\nb" and rows[0]["rating"] == 5.0 and rows[0]["title"] is None
    assert rows[1][readers.CORRUPT] == "not json"


def test_csv_roundtrip_keeps_quotes_and_lines(spark):
    info = spark.createDataFrame([(-1, 3, 'say "x", y'), (0, 5, "two\nlines")], TOPIC_INFO)
    path = scratch_path(spark, "csv")
    sinks.sink_csv(info, path)
    assert sorted(readers.scan_csv(spark, path, TOPIC_INFO).collect()) == sorted(info.collect())


def test_materialize_builds_once(spark):
    path, built = scratch_path(spark, "stage"), []

    def build():
        built.append(1)
        return spark.range(5)

    assert sinks.materialize(spark, path, build).count() == 5
    assert sinks.materialize(spark, path, build).count() == 5
    assert len(built) == 1


def test_materialize_ignores_an_unfinished_output(spark, tmp_path):
    (tmp_path / "half").mkdir()
    assert sinks.materialize(spark, str(tmp_path / "half"), lambda: spark.range(3)).count() == 3


def test_model_store_fits_once(spark):
    path, fitted = scratch_path(spark, "model"), []
    rows = spark.createDataFrame([("a b",)], "text string")

    def fit():
        fitted.append(1)
        return Pipeline(stages=[Tokenizer(inputCol="text", outputCol="w")]).fit(rows)

    for _ in range(2):
        assert sinks.model_store(spark, path, fit).transform(rows).head()["w"] == ["a", "b"]
    assert len(fitted) == 1


def test_shared_dir_is_the_configured_one(spark, tmp_path):
    unset = shared_dir(spark)
    assert shared_dir(spark) == unset
    assert cut_lineage(spark.range(4)).count() == 4


def test_full_text_and_length_filter(spark):
    rows = spark.createDataFrame([(None, "ok"), ("t", None), ("x", "a" * 19), ("y", "b" * 20)], "title string, text string")
    assert [r[0] for r in rows.select(C.full_text()).collect()][:2] == [". ok", "t. "]
    assert [r["title"] for r in C.min_length_filter(rows).collect()] == ["y"]


def test_sentiment_label_and_contract(spark):
    rows = spark.createDataFrame([(float(i),) for i in range(7)], "rating double")
    labelled = rows.withColumn("sentiment_label", C.sentiment_label())
    assert [r["sentiment_label"] for r in labelled.collect()] == [None, "negative", "negative", "neutral", "positive", "positive", None]
    with pytest.raises(Exception, match="2 rows have no label"):
        C.assert_labelled(labelled).collect()
    assert rows.select(C.sentiment_label(default="unknown")).collect()[0][0] == "unknown"


def test_dedup_keeps_the_first_and_treats_nulls_as_equal(spark):
    rows = spark.createDataFrame([(5, "a"), (1, "a"), (3, None), (2, None), (4, "b")], "review_id long, text string").repartition(3)
    assert sorted(r["review_id"] for r in quality.dedup_text_keep_first(rows).collect()) == [1, 2, 4]
    assert quality.dup_text_count(rows).head()[0] == 2
    assert sorted(r["review_id"] for r in quality.dedup_rows(rows, ["review_id"]).collect()) == [1, 2, 4]


def test_percentiles_are_exact_with_one_heavy_value(spark):
    import numpy as np

    values = [7.0] * 400 + [float(x) ** 1.5 for x in range(601)]
    rows = spark.createDataFrame([("a" if i % 3 else "b", v) for i, v in enumerate(values)], "g string, v double").repartition(5)
    shares, names = [0.0, 0.1, 0.5, 0.95, 1.0], ["p0", "p10", "p50", "p95", "p100"]
    for r in quality.exact_percentiles(rows, F.col("v"), shares, names, ["g"]).collect():
        mine = [v for i, v in enumerate(values) if (i % 3 == 0) == (r["g"] == "b")]
        assert [r[n] for n in names] == pytest.approx(list(np.percentile(mine, [100 * s for s in shares])))
    whole = quality.exact_percentiles(rows, F.col("v"), shares, names).head()
    assert [whole[n] for n in names] == pytest.approx(list(np.percentile(values, [100 * s for s in shares])))


@pytest.mark.parametrize("values, parts", [(5, 8), (1, 16), (60, 4)])
def test_percentiles_by_narrower_ranges(spark, monkeypatch, values, parts):
    """Rounds that cut the ranges change nothing, with null groups, ties and a heavy tail."""
    import numpy as np

    monkeypatch.setattr(quality, "RANGE_VALUES", values)
    monkeypatch.setattr(quality, "PARTS", parts)
    rows = [(g, v) for g, scale in (("a", 1.0), (None, -1e6), ("c", 1e300)) for v in [scale * x**3 for x in range(150)] + [scale] * 80]
    rows += [("d", 4.0), ("e", None)]
    frame = spark.createDataFrame(rows, "g string, v double").repartition(4)
    shares, names = [0.0, 0.25, 0.5, 0.97, 1.0], ["a", "b", "c", "d", "e"]
    got = {r["g"]: [r[n] for n in names] for r in quality.exact_percentiles(frame, F.col("v"), shares, names, ["g"]).collect()}
    for g in ("a", None, "c", "d"):
        mine = [v for key, v in rows if key == g]
        assert got[g] == pytest.approx(list(np.percentile(mine, [100 * s for s in shares])))
    whole = quality.exact_percentiles(frame.where("g = 'a'"), F.col("v"), shares, names).head()
    assert [whole[n] for n in names] == pytest.approx(got["a"])


def test_percentiles_of_nothing(spark):
    empty = spark.createDataFrame([], "v double")
    assert quality.exact_percentiles(empty, F.col("v"), [0.5], ["p50"]).head()["p50"] is None


def test_empty_input_gives_no_division_error(spark):
    empty = spark.createDataFrame([], "rating double, sentiment_label string, verified_purchase boolean, topic_label string")
    kpis = aggregates.overview_kpis(empty).head()
    assert kpis["reviews"] == 0 and kpis["pct_positive"] is None
    assert aggregates.topic_x_sentiment(empty).collect() == []


def test_null_groups_do_not_appear(spark):
    rows = spark.createDataFrame([(None, "negative"), ("t", "negative"), ("t", None)], "topic_label string, sentiment_label string")
    assert [tuple(r) for r in aggregates.topic_x_sentiment(rows).collect()] == [("t", 100.0, 0.0, 0.0)]
    assert [tuple(r) for r in aggregates.negative_topics(rows).collect()] == [("t", 50.0)]


def test_threshold_sweep_equals_filters(spark):
    confidences = [0.49, 0.5, 0.57, 0.58, 0.7, 0.29 + 0.28, 0.9999, 1.0, 1.2, None, -3.0]
    rows = spark.createDataFrame([(5.0, "negative", c) for c in confidences] + [(1.0, "positive", 0.81)], "rating double, predicted_label string, confidence double")
    sweep = mismatch.mismatch_threshold_sweep(rows).collect()
    assert len(sweep) == 51
    for r in sweep:
        assert r["five_negative"] == sum(1 for c in confidences if c is not None and c >= r["threshold"])
        assert r["one_positive"] == int(0.81 >= r["threshold"])
    assert sorted(r["threshold"] for r in sweep) == [0.5 + i / 100 for i in range(51)]


def test_dashboard_tables(spark, sf_dir):
    import datetime

    from quillsift.plans.catalog.tables import topical
    from quillsift.plans.enrich import dashboard_filter, dashboard_tables

    rows = topical(spark, sf_dir).withColumnRenamed("true_label", "sentiment_label")
    chosen = dashboard_filter(rows, datetime.date(2019, 1, 1), datetime.date(2022, 12, 31), verified="verified").persist()
    tables = {name: table.collect() for name, table in dashboard_tables(chosen, 0.5).items()}
    n = chosen.count()
    assert 0 < n < rows.count()
    assert tables["kpis"][0]["reviews"] == n and tables["kpis"][0]["pct_verified"] == 100.0
    assert sum(r["count"] for r in tables["rating_counts"]) == n
    assert sum(r["count"] for r in tables["monthly_volume"]) == n
    for r in tables["topic_sentiment"]:
        assert r["negative"] + r["neutral"] + r["positive"] == pytest.approx(100)


def test_date_filters_do_not_depend_on_the_zone_of_the_driver(spark, monkeypatch):
    import datetime
    import time

    from quillsift.functions.columns import filter_date_range, filter_min_year

    rows = spark.sql("SELECT timestamp '2018-12-31 23:30:00' AS timestamp UNION ALL SELECT timestamp '2019-01-01 00:30:00'")
    monkeypatch.setenv("TZ", "America/New_York")
    time.tzset()
    try:
        assert filter_min_year(rows, 2019).count() == 1
        assert filter_date_range(rows, datetime.date(2018, 12, 31), datetime.date(2018, 12, 31)).count() == 1
    finally:
        monkeypatch.undo()
        time.tzset()
