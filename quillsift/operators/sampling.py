"""Seeded samples, splits and folds.

Every draw orders rows by a key made from a seed and the row's id. The order is therefore the same
however the rows are spread over tasks, and a task that is run again draws the same rows.

Fixed-size draws per class must not send a class to one task. The key space is cut into equal
slices; counting rows per slice tells how many rows of the class come before each slice, so a rank
needs an order only within a slice, and a draw only touches the slices it reaches. The counts are
written as a small table: Spark then knows its size and broadcasts it if it is small, and if it is
not, the join is on class and slice, which no class can overload.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillsift.operators.topk import top_per_group
from quillsift.session import cut_lineage

KEY_BITS = 60


def sample_key(seed: int | str, row_id: Column | str = "review_id") -> Column:
    """Uniform 60-bit key of a row under a seed."""
    row_id = F.col(row_id) if isinstance(row_id, str) else row_id
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), row_id.cast("string")))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("bigint")


def _keyed(df: DataFrame, by: list[str], seed: int | str, row_id: str) -> DataFrame:
    """Rows with key and group."""
    return df.withColumns(
        {
            # A struct is never null and compares by its parts, so rows without a class are one too.
            "_group": F.struct(*[F.col(c) for c in by] or [F.lit(1).alias("all")]),
            "_key": sample_key(seed, row_id),
        }
    )


def _slices(df: DataFrame, by: list[str], seed: int | str, row_id: str, bits: int) -> tuple[DataFrame, DataFrame]:
    """Rows with key, group and slice; and per group and slice the rows in it and before it."""
    keyed = _keyed(df, by, seed, row_id).withColumn("_slice", F.shiftright("_key", KEY_BITS - bits).cast("int"))
    counted = cut_lineage(keyed.groupBy("_group", "_slice").agg(F.count("*").alias("_rows")))
    earlier = Window.partitionBy("_group").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return keyed, counted.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))


def _ranked(keyed: DataFrame, sizes: DataFrame, row_id: str, rank: str) -> DataFrame:
    """Rank from 1 within the group, for rows whose slice is listed in ``sizes``."""
    joined = keyed.join(sizes, ["_group", "_slice"])
    in_slice = Window.partitionBy("_group", "_slice").orderBy("_key", row_id)
    return joined.withColumn(rank, F.col("_before") + F.row_number().over(in_slice))


def random_rank(
    df: DataFrame, seed: int | str, by: list[str] | None = None, rank: str = "rank", row_id: str = "review_id", bits: int = 12
) -> DataFrame:
    """Exact rank of every row in the random order of its group."""
    keyed, sizes = _slices(df, by or [], seed, row_id, bits)
    return _ranked(keyed, sizes, row_id, rank).select(*df.columns, rank)


def take_random(
    df: DataFrame, quota: Column, seed: int | str, by: list[str] | None = None, row_id: str = "review_id", bits: int = 16
) -> DataFrame:
    """The first ``quota`` rows of each group in its random order.

    The quota may use ``group_rows``, the size of the group.
    """
    keyed, sizes = _slices(df, by or [], seed, row_id, bits)
    wanted = (
        sizes.withColumn("group_rows", F.sum("_rows").over(Window.partitionBy("_group")))
        .withColumn("_quota", quota.cast("bigint"))
        .filter("_before < _quota")
        .drop("group_rows")
    )
    return _ranked(keyed, wanted, row_id, "_rank").filter("_rank <= _quota").select(*df.columns)


def sample_n(df: DataFrame, n: int, seed: int | str = 42, row_id: str = "review_id") -> DataFrame:
    """Uniform sample without replacement of ``n`` rows, or all rows if there are fewer."""
    return take_random(df, F.lit(n), seed, row_id=row_id)


def reservoir_sample(df: DataFrame, n: int = 500_000, seed: int | str = 42, row_id: str = "review_id") -> DataFrame:
    """The ``n`` rows with the smallest random keys; a batch of it can be merged with later ones."""
    return sample_n(df, n, seed, row_id)


def sample_n_per_group(df: DataFrame, group: str, n: int, seed: int | str = 42, row_id: str = "review_id") -> DataFrame:
    return take_random(df.filter(F.col(group).isNotNull()), F.lit(n), seed, [group], row_id)


def sample_frac_per_group(
    df: DataFrame, group: str, frac: float, seed: int | str = 42, row_id: str = "review_id"
) -> DataFrame:
    """A share of each group, its size rounded half to even."""
    quota = F.bround(F.lit(frac) * F.col("group_rows"), 0)
    return take_random(df.filter(F.col(group).isNotNull()), quota, seed, [group], row_id)


def _test_quotas(sizes: DataFrame, test_size: float) -> DataFrame:
    """Test rows per class: proportional, the total rounded up, leftovers to the largest remainders.

    One row per class. Decimal products keep the remainders exact at any table size.
    """
    classes = Window.partitionBy(F.lit(1))
    by_rest = classes.orderBy(F.desc("rest"), "_group")
    counted = sizes.groupBy("_group").agg(F.sum("_rows").cast("decimal(19,0)").alias("n"))
    return (
        counted.withColumn("all", F.sum("n").over(classes).cast("decimal(19,0)"))
        .withColumn("test", F.ceil(F.col("all") * F.lit(str(test_size)).cast("decimal(9,8)")).cast("decimal(19,0)"))
        .withColumn("share", (F.col("n") * F.col("test")).cast("decimal(38,0)"))
        .withColumn("floor", F.expr("CAST(share DIV all AS BIGINT)"))
        .withColumn("rest", F.expr("share % all"))
        .withColumn("missing", F.col("test").cast("bigint") - F.sum("floor").over(classes))
        .withColumn("extra", (F.row_number().over(by_rest) <= F.col("missing")).cast("bigint"))
        .select("_group", (F.col("floor") + F.col("extra")).alias("_quota"))
    )


def stratified_split(
    df: DataFrame, label: str = "sentiment_label", test_size: float = 0.2, seed: int | str = 42, row_id: str = "review_id"
) -> DataFrame:
    """All rows with a ``split`` column, ``train`` or ``test``, the classes in proportion in both.

    Every row is compared with the last test row of its class and stays where it is. Rows of one id go to the same side.
    """
    # One row per class, written so that Spark knows its size.
    return split_at(df, cut_lineage(split_cuts(df, label, test_size, seed, row_id)), label, seed, row_id)


def split_cuts(
    df: DataFrame, label: str = "sentiment_label", test_size: float = 0.2, seed: int | str = 42, row_id: str = "review_id"
) -> DataFrame:
    """The place of the last test row of each class. Only the slice that holds it is ranked, by key and id alone."""
    keyed, sizes = _slices(df, [label], seed, row_id, 12)
    edges = sizes.join(_test_quotas(sizes, test_size), "_group").filter("_before < _quota AND _quota <= _before + _rows")
    last = _ranked(keyed.select("_group", "_slice", "_key", row_id), edges, row_id, "_rank").filter("_rank = _quota")
    return last.select("_group", F.struct("_key", row_id).alias("_cut"))


def split_at(
    df: DataFrame, cuts: DataFrame, label: str = "sentiment_label", seed: int | str = 42, row_id: str = "review_id"
) -> DataFrame:
    """All rows with a ``split`` column by stored cuts (``split_cuts``)."""
    side = F.when(F.struct("_key", row_id) <= F.col("_cut"), "test").otherwise("train")
    return _keyed(df, [label], seed, row_id).join(cuts, "_group", "left").select(*df.columns, side.alias("split"))


def persist_split(
    df: DataFrame, label: str = "sentiment_label", test_size: float = 0.2, seed: int | str = 42, row_id: str = "review_id"
) -> DataFrame:
    """The split as a slim table to store: key, class and side."""
    return stratified_split(df.select(row_id, label), label, test_size, seed, row_id)


def lookup_split(df: DataFrame, split: DataFrame, side: str = "test", row_id: str = "review_id") -> DataFrame:
    """Rows on one side of a stored split."""
    return df.join(split.filter(F.col("split") == side).select(row_id), row_id, "left_semi")


def class_shares(split: DataFrame, label: str = "sentiment_label") -> DataFrame:
    """Share of each class in percent: overall, in train and in test."""
    counts = split.groupBy("split", label).agg(F.count("*").alias("n"))
    overall = counts.groupBy(label).agg(F.sum("n").alias("n")).withColumn("split", F.lit("all"))
    both = overall.unionByName(counts)
    total = F.sum("n").over(Window.partitionBy("split"))
    return both.select("split", label, "n", (F.try_divide(F.col("n") * 100.0, total)).alias("share"))


def stratified_kfold(
    df: DataFrame, label: str = "sentiment_label", folds: int = 3, seed: int | str = 42, row_id: str = "review_id"
) -> DataFrame:
    """Key, class and fold; the folds of a class differ by at most one row."""
    ranked = random_rank(df.select(row_id, label), seed, [label], "_rank", row_id)
    return ranked.select(row_id, label, F.pmod(F.col("_rank") - 1, F.lit(folds)).cast("int").alias("fold"))


def topic_examples(
    df: DataFrame, topic: str = "topic_label", first: int = 200, n: int = 10, seed: int | str = 42, row_id: str = "review_id"
) -> DataFrame:
    """Per topic, ``n`` random rows out of its first ``first`` rows by id."""
    known = df.filter(F.col(topic).isNotNull())
    early = top_per_group(known, topic, [row_id], first, "_nth", row_id).withColumn("_key", sample_key(seed, row_id))
    # At most ``first`` rows per topic are left.
    drawn = Window.partitionBy(topic).orderBy("_key", row_id)
    return early.withColumn("_nth", F.row_number().over(drawn)).filter(F.col("_nth") <= n).select(*df.columns)
