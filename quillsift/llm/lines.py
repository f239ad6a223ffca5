"""Repeated line runs: line-id sequences named by distributed prefix doubling; later copies are deleted.

A run of lines is named by its first occurrence. Runs of one line are named by a digest of the line, runs
of 2^(k+1) lines by the pair of names of their halves, so a round is a join of neighbours and an
aggregate. Only runs that occur more than once go on: a suffix whose prefix is unique is alone in its
interval of common prefixes for good. Doubling stops at ``min_lines``: the classes there are the intervals
whose common prefix is long enough, and every member but the first is a copy. Copies overlap into maximal
runs, which are deleted whole.

DataFrame expressions only. The tables after the first are as narrow as their names; a line that very many
documents share is a group of equal keys in aggregates (summed per task first) and in plain joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillsift.llm.common import cut_lineage


def _lines(docs: DataFrame) -> DataFrame:
    """One row per line with a number that rises by one along a document."""
    exploded = docs.select("row_id", "doc_id", F.split("text", "\n").alias("lines")).select(
        "row_id", "doc_id", F.size("lines").alias("n"), F.posexplode("lines").alias("pos", "line")
    )
    return cut_lineage(
        exploded.select(
            F.monotonically_increasing_id().alias("line_id"),
            "row_id",
            "doc_id",
            "pos",
            (F.col("n") - F.col("pos")).alias("left"),
            F.char_length("line").alias("chars"),
            F.xxhash64("line").alias("h"),
            F.xxhash64(F.lit("second"), "line").alias("g"),
        )
    )


def _named(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Runs whose key occurs more than once, named by the first occurrence in the order of documents."""
    first = runs.groupBy(*keys).agg(
        F.min(F.struct("doc_id", "line_id")).alias("first"), F.count(F.lit(1)).alias("members")
    ).where("members > 1")
    # Written, so that the aggregate does not fix how the join deals its rows: then a key with very many rows is split.
    first = cut_lineage(first.select(*keys, F.col("first.line_id").alias("name")))
    named = runs.join(first.hint("merge"), keys)
    return named.select("line_id", "doc_id", "left", "chars", "name")


def _pairs(names: DataFrame, step: int, need: int) -> DataFrame:
    """Each run with the name of the run ``step`` lines further on, within a document that has ``need`` lines left."""
    ahead = names.select((F.col("line_id") - step).alias("line_id"), F.col("name").alias("behind"))
    return names.where(F.col("left") >= need).withColumnRenamed("name", "half").join(ahead, "line_id")


def copied_lines(lines: DataFrame, min_lines: int, min_chars: int) -> DataFrame:
    """(line_id, run): starts of copies, and how many lines each covers."""
    names = cut_lineage(_named(lines, ["h", "g"]))
    copy = F.col("name") != F.col("line_id")
    found = names.where(copy & (F.col("chars") >= min_chars)).select("line_id", F.lit(1).alias("run"))
    size = 1
    while size < min_lines:
        step = min(size, min_lines - size)  # the last round overlaps its halves if the length asks for it
        size += step
        names = cut_lineage(_named(_pairs(names, step, size), ["half", "behind"]))
    if min_lines > 1:
        found = found.union(names.where(copy).select("line_id", F.lit(min_lines).alias("run")))
    elif min_lines == 1:
        found = names.where(copy).select("line_id", F.lit(1).alias("run"))
    return found.groupBy("line_id").agg(F.max("run").alias("run"))


def _flags(lines: DataFrame, copies: DataFrame) -> DataFrame:
    """Per row with a copy in it: an array with whether each of its lines goes, and the number of maximal runs."""
    touched = lines.join(copies, "line_id").select("row_id").distinct()
    along = Window.partitionBy("row_id").orderBy("pos")
    reach = F.max(F.col("pos") + F.col("run")).over(along.rowsBetween(Window.unboundedPreceding, 0))
    marked = (
        lines.select("line_id", "row_id", "pos")
        .join(touched, "row_id", "left_semi")
        .join(copies, "line_id", "left")
        .withColumn("goes", F.coalesce(reach > F.col("pos"), F.lit(False)))
        .withColumn("starts", F.col("goes") & ~F.coalesce(F.lag("goes").over(along), F.lit(False)))
    )
    return marked.groupBy("row_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "goes"))), lambda x: x["goes"]).alias("goes"),
        F.count(F.when(F.col("starts"), 1)).alias("n_runs"),
    )


def without_copies(
    docs: DataFrame, min_lines: int = 3, min_chars: int = 50, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every row of ``docs`` with ``kept_text, n_lines, n_removed, n_runs`` added.

    Lines end at a line feed. A line goes if it lies in a run of ``min_lines`` lines that occurs before, or
    is itself a line of at least ``min_chars`` characters that occurs before; before means in a document of
    smaller id, or further up in the same one. The first occurrence of every line stays. Everything is
    judged on the input. A null text is empty and has one empty line; rows of equal or null id stand in the
    order they are read; an empty table gives no rows. An input column that has a name of the result's is
    left out.
    """
    own = ("kept_text", "n_lines", "n_removed", "n_runs", "row_id", "goes")
    rest = [c for c in docs.columns if c not in own]
    rows = cut_lineage(docs.select(F.monotonically_increasing_id().alias("row_id"), *rest))
    lines = _lines(
        rows.select("row_id", rows[id_col].cast("long").alias("doc_id"), F.coalesce(rows[text_col], F.lit("")).alias("text"))
    )
    flags = cut_lineage(_flags(lines, cut_lineage(copied_lines(lines, min_lines, min_chars))))
    # One kind of join at every size: a broadcast while the flags are few would move no texts, a merge moves all.
    joined = rows.join(flags.hint("merge"), "row_id", "left")
    text = F.coalesce(rows[text_col], F.lit(""))
    parts = F.split(text, "\n")

    def kept() -> Column:
        pairs = F.zip_with(parts, "goes", lambda line, goes: F.when(~goes, line))
        return F.array_join(F.filter(pairs, lambda line: line.isNotNull()), "\n")

    return joined.select(
        *rest,
        F.when(F.col("goes").isNull(), text).otherwise(kept()).alias("kept_text"),
        F.size(parts).alias("n_lines"),
        F.when(F.col("goes").isNull(), 0).otherwise(F.size(F.filter("goes", lambda x: x))).alias("n_removed"),
        F.coalesce("n_runs", F.lit(0)).alias("n_runs"),
    )
