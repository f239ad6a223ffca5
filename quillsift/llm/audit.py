"""Filter interaction audit: what each filter of a chain removes, in every order, from one contingency tensor.

Every row is reduced to a pattern, one bit per filter. The rows of a part are then a tensor with two cells
(pass, fail) along an axis per filter, and every figure of the audit is a contraction of it: an axis is
multiplied by (1, 0) for pass, (0, 1) for fail or (1, 1) for all. ``einsum`` does this for all orders and
steps at once. The rows are read once; a part has at most 2^filters counts, however many rows it has.

A copy is a property of all rows with a text. The copies of a text share their pattern, so they are counted
and never joined: all rows less those of the first id of each text are the copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import permutations
from string import ascii_lowercase

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.llm.common import cut_lineage

PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)

#: Parts whose tensors one contraction takes.
TOGETHER = 64

RESULT = """part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long,
good_lost long, toxic_lost long, shapley long"""


def words(text: Column) -> Column:
    """The words of a text, cut at ASCII white space."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def text_checks(text: str = "text") -> list[Column]:
    """Failure conditions on one text: few words, few distinct words, many capitals, odd symbols."""
    t, w = F.col(text), F.col("_words")
    capitals = F.char_length(F.regexp_replace(t, "[^A-Z]+", ""))
    return [
        F.size(w) < 100,
        100 * F.size(F.array_distinct(w)) < 80 * F.size(w),
        100 * capitals > 10 * F.char_length(t),
        t.rlike("[#$%&*|]"),
    ]


def patterns(docs: DataFrame, marks: DataFrame, checks: list[Column]) -> DataFrame:
    """(doc_id, part, digest, pattern, good, toxic): a narrow row per row of ``docs``.

    ``marks`` has doc_id, good and toxic (boolean); a document with several rows there has a mark if any
    row sets it.
    """
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        F.coalesce(docs["lang"].cast("string"), F.lit("")).alias("part"),
        F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"),
    ).withColumn("_words", words(F.col("text")))
    bits = [F.when(check, 1 << i).otherwise(0) for i, check in enumerate(checks)]
    narrow = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), reduce(Column.__add__, bits).alias("pattern"))
    known = marks.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(*[F.max(F.coalesce(F.col(c), F.lit(False))).cast("long").alias(c) for c in ("good", "toxic")])
    narrow = cut_lineage(narrow)
    # Rows without an id have no marks; they would all meet in one task of the join.
    marked = narrow.where("doc_id is not null").join(known.hint("merge"), "doc_id", "left").fillna(0, ["good", "toxic"])
    without = narrow.where("doc_id is null").withColumns({"good": F.lit(0).cast("long"), "toxic": F.lit(0).cast("long")})
    return cut_lineage(marked.unionByName(without))


def _counted(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def pattern_counts(rows: DataFrame, copy_bit: int) -> DataFrame:
    """(part, pattern, n, good, toxic) with the bit of copies set: texts that a smaller id has too.

    Rows of one id are no copies of each other, and a row without an id is none and makes none.
    """
    by_id = _counted(rows.where("doc_id is not null"), "digest", "doc_id", "part", "pattern")
    cells = F.collect_list(F.struct("part", "pattern", "n", "good", "toxic"))  # a cell per part of one id and text
    by_text = by_id.groupBy("digest", "doc_id").agg(cells.alias("cells"))
    first = by_text.groupBy("digest").agg(F.min_by("cells", "doc_id").alias("cells")).select(F.inline("cells"))
    first = first.unionByName(_counted(rows.where("doc_id is null"), "part", "pattern"))
    less = first.select("part", (F.col("pattern") + copy_bit).alias("pattern"), *[(-F.col(c)).alias(c) for c in ("n", "good", "toxic")])
    every = _counted(rows, "part", "pattern").withColumn("pattern", F.col("pattern") + copy_bit)
    summed = every.unionByName(first).unionByName(less).groupBy("part", "pattern")
    return summed.agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def _selectors(filters: int) -> tuple[list[tuple[int, ...]], dict[str, np.ndarray]]:
    """All orders, and per figure what is taken along each axis: (order, step, axis, 2)."""
    orders = list(permutations(range(filters)))
    taken = {name: np.empty((len(orders), filters, filters, 2), dtype=np.int64) for name in ("kept", "removed", "failing", "unique")}
    for o, order in enumerate(orders):
        for s, own in enumerate(order):
            for name, before, at, after in (
                ("kept", PASS, PASS, ALL),
                ("removed", PASS, FAIL, ALL),
                ("failing", ALL, FAIL, ALL),
                ("unique", PASS, FAIL, PASS),
            ):
                taken[name][o, s, list(order[:s])] = before
                taken[name][o, s, own] = at
                taken[name][o, s, list(order[s + 1 :])] = after
    return orders, taken


def contract(tensors: np.ndarray, filters: int) -> tuple[list[tuple[int, ...]], dict[str, np.ndarray]]:
    """The figures of tensors shaped (part, measure, 2, 2, ...) as arrays (part, measure, order, step)."""
    orders, taken = _selectors(filters)
    axes = ascii_lowercase[:filters]
    formula = f"xy{axes}," + ",".join(f"zw{a}" for a in axes) + "->xyzw"
    out = {
        name: np.einsum(formula, tensors, *[pick[:, :, a] for a in range(filters)], optimize="greedy")
        for name, pick in taken.items()
    }
    return orders, out


def interactions(counts: DataFrame, names: str) -> DataFrame:
    """One row per part, order of the filters and step, from ``pattern_counts``; bit i is the filter names[i]."""
    filters = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                yield from figures(batch.slice(at, TOGETHER))

    def figures(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        parts, cells = batch.column(0), batch.column(1)
        flat = np.zeros((len(parts), 3, 1 << filters), dtype=np.int64)
        row = np.repeat(np.arange(len(parts)), np.diff(cells.offsets.to_numpy()))
        pattern, *measures = (c.to_numpy() for c in cells.flatten().flatten())
        for m, values in enumerate(measures):
            flat[row, m, pattern] = values
        # The last axis of a reshaped tensor is the lowest bit; turn the axes round.
        tensors = flat.reshape(-1, 3, *[2] * filters).transpose(0, 1, *range(filters + 1, 1, -1))
        orders, got = contract(tensors, filters)
        removed = got["removed"][:, 0]
        own = np.array(orders)
        shapley = np.zeros((len(parts), filters), dtype=np.int64)
        for f in range(filters):
            shapley[:, f] = removed[:, own == f].sum(axis=1)
        rows = len(orders) * filters
        spelt = ["".join(names[f] for f in order) for order in orders]
        columns = [
            parts.take(pa.array(np.repeat(np.arange(len(parts)), rows))),
            pa.array(np.tile(np.repeat(np.array(spelt, dtype=object), filters), len(parts)), pa.string()),
            pa.array(np.tile(np.arange(1, filters + 1, dtype=np.int32), len(parts) * len(orders))),
            got["kept"][:, 0],
            removed,
            got["failing"][:, 0] - removed,
            got["unique"][:, 0],
            got["removed"][:, 1],
            got["removed"][:, 2],
            shapley[:, own],
        ]
        fields = [f.split()[0] for f in RESULT.replace("\n", " ").split(",")]
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c.ravel()) for c in columns], names=fields)

    cells = F.collect_list(F.struct("pattern", "n", "good", "toxic"))  # at most 2^filters
    return counts.groupBy("part").agg(cells.alias("cells")).mapInArrow(run, RESULT)


def audit_filters(docs: DataFrame, marks: DataFrame, checks: list[Column] | None = None, names: str = "ABCDE") -> DataFrame:
    """The audit of ``checks`` and, as the last filter, exact copies: a row per part, order and step.

    ``docs`` has doc_id, text and lang (the part), ``marks`` has doc_id, good and toxic; other columns are
    ignored, whatever their names. A null text is empty, a null part the empty string; marks of unknown or
    null ids are not used, null marks are unset. A text that a smaller id has is a copy, wherever in the
    table; rows of one id, or without one, are no copies of each other. Parts without rows give none, so an
    empty table gives no rows. Checks are columns over ``text`` and ``_words``.
    """
    checks = text_checks() if checks is None else checks
    if len(names) != len(checks) + 1:
        raise ValueError("a name for each check and one for copies")
    rows = patterns(docs, marks, checks)
    return interactions(pattern_counts(rows, 1 << len(checks)), names)
