"""Reductions over score vectors held as arrays, and naming of intermediate values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once per row, however often the body uses it.

    Spark copies an expression wherever a name for it is used when it merges projections or moves a
    filter below them; nested guards would then grow without bound. A lambda's variable is never
    replaced by its expression.
    """
    return F.transform(F.array(value), body)[0]


def fenced(value: Column) -> Column:
    """The value itself, in a form that Spark leaves in its own projection.

    A batched Python function cannot take an argument that contains a lambda, which is what the
    argument becomes when Spark merges the projection that makes it with the one that uses it. It
    does not merge what it takes for not deterministic, such as the number of the task.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def row_max(values: Column) -> Column:
    """Largest entry."""
    return F.array_max(values)


def row_argmax(values: Column) -> Column:
    """Position (from 0) of the largest entry, the first one on a tie."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def dominant_topic(mixture: Column) -> Column:
    """Position of the largest share; null for a mixture of zeros, i.e. no known word."""
    return F.when(F.array_max(mixture) > 0, row_argmax(mixture))


def softmax(scores: Column) -> Column:
    """Scores scaled to shares that sum to 1; the largest is taken off first to avoid overflow."""
    top = F.array_max(scores)
    powers = F.transform(scores, lambda s: F.exp(s - top))
    total = F.aggregate(powers, F.lit(0.0), lambda acc, p: acc + p)
    return F.transform(powers, lambda p: p / total)
