"""Every query with a SQL check gives the same rows as DuckDB; the entry points hold together."""

import pytest

import __spark_entry__ as spec
from tests.checking import compare, connect


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(spec.oracle_sql()))
def test_same_rows_as_sql(name, spark, sf_dir, duck):
    difference = compare(spec.queries()[name](spark, sf_dir), duck, spec.oracle_sql()[name])
    assert difference is None, difference


def test_checks_belong_to_queries():
    assert set(spec.oracle_sql()) <= set(spec.queries())


def test_entry_has_the_enriched_columns(spark):
    from quillsift.sources.schemas import ENRICHED_COLUMNS

    result = spec.entry(spark)
    assert result.columns == ["review_id", *ENRICHED_COLUMNS]
    rows = result.collect()
    assert rows and all(r["predicted_label"] in ("negative", "neutral", "positive") for r in rows)
    assert all(0 < r["confidence"] <= 1 for r in rows)
    assert len({r["review_id"] for r in rows}) == len(rows)
