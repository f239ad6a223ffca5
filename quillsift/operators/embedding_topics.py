"""Topics from text embeddings: embed, reduce, group by density, name, merge.

Density is that of the rows themselves: equal vectors are counted once with their number, and the distinct
ones are dealt to the cells of some pivots, each to its nearest. A vector is sent to those cells alone that can
hold one in reach of it: a cell is out of reach if the plane between its pivot and the vector's own is farther
than the radius, or its outermost member is. So the vectors of separate groups never meet, and what meets
does so by an equality of cells. A cell is cut into blocks of bounded size, and a task compares two blocks
by a matrix product. Dense vectors are linked within each block first, so a heap of near ones yields one edge
per pair of groups and not one per pair of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import IDF, PCA, HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillsift.functions.arrays import fenced
from quillsift.functions.text import ENGLISH_STOP_WORDS, terms, tokenize_words, without
from quillsift.operators.components import components
from quillsift.operators.tallies import term_tallies
from quillsift.session import cut_lineage

# Smallest topic, and the number of topics after merging.
MIN_TOPIC_SIZE = 150
MERGED_TOPICS = 25

OUTLIER = -1

# Vectors of a block, and how many of them a task compares at a time.
BLOCK_ROWS = 2048
STRIP = 256


def embed_texts(df: DataFrame, make_encoder, text: str = "light_text", output: str = "vec", batch_size: int = 256) -> DataFrame:
    """Embed texts with a pretrained encoder, in batches.

    ``make_encoder`` runs once per Python worker and returns a function from an array of texts to an
    array of vectors. The call is marked as not deterministic, so that Spark neither repeats it nor
    moves it into an expression that cannot hold a Python function.
    """
    encode = predict_batch_udf(make_encoder, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    ready = df.withColumn("_text", fenced(F.col(text)))
    return ready.withColumn(output, encode.asNondeterministic()(F.col("_text"))).drop("_text")


def fit_hashed_embedding(df: DataFrame, tokens: str = "tokens", dimensions: int = 256, output: str = "features") -> PipelineModel:
    """An encoder without pretrained weights: hashed words, weighted by rarity, at unit length."""
    hashed = HashingTF(inputCol=tokens, outputCol="_hashed", numFeatures=dimensions)
    idf = IDF(inputCol="_hashed", outputCol="_weighted").fit(hashed.transform(df))
    return PipelineModel([hashed, idf, Normalizer(inputCol="_weighted", outputCol=output)])


def reduce_dims(df: DataFrame, k: int, vector: str = "features", output: str = "reduced") -> DataFrame:
    """Principal components; the fit sums one square of the dimension per task."""
    return PCA(k=k, inputCol=vector, outputCol=output).fit(df).transform(df)


_SETTINGS = "radius double, pivots array<array<double>>"


@dataclass
class DensityTopics:
    """Fitted topics: the dense vectors (written, in blocks) with the topic of each, -1 where it was too small."""

    blocks: DataFrame
    radius: float
    pivots: np.ndarray

    def save(self, path: str) -> None:
        """Store the blocks, and last the settings: a folder without them is not finished."""
        self.blocks.write.mode("overwrite").parquet(f"{path}/blocks")
        settings = [(self.radius, self.pivots.tolist())]
        self.blocks.sparkSession.createDataFrame(settings, _SETTINGS).coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> DensityTopics:
        radius, pivots = spark.read.schema(_SETTINGS).parquet(f"{path}/settings").head()
        return cls(spark.read.schema(_BLOCK).parquet(f"{path}/blocks"), radius, np.array(pivots, dtype=np.float64))

    def assign(self, df: DataFrame, vector: str = "vec", output: str = "topic") -> DataFrame:
        """Topic of each row: that of the nearest dense vector, or -1 if none is in reach."""
        rows = cut_lineage(df.withColumn("_point", _doubles(F.col(vector))))
        # A dense vector is its own nearest one, so only the others are compared.
        dense = self.blocks.mapInArrow(_unpacked, "_point array<double>, _topic long")
        points = cut_lineage(_points(rows.select("_point")).join(dense, "_point", "left"))
        found = _nearest(points.where("_topic IS NULL"), self.blocks, self.pivots, self.radius)
        topics = points.select("_id", "_point", "_topic").join(found, "_id", "left")
        topics = topics.select("_point", F.coalesce("_topic", "_value").cast("int").alias("_topic"))
        topic = F.coalesce("_topic", F.lit(OUTLIER))
        return rows.join(topics, "_point", "left").withColumn(output, topic).drop("_point", "_topic")


def _doubles(vector: Column) -> Column:
    """The vector as doubles; null if a component is missing or not finite, which is in reach of nothing."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    whole = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(F.coalesce(whole, F.lit(False)), wide)


def _points(vectors: DataFrame) -> DataFrame:
    """Distinct vectors with an id and, as _value, their number of rows."""
    counted = vectors.where(F.col("_point").isNotNull()).groupBy("_point").agg(F.count("*").alias("_value"))
    return cut_lineage(counted.withColumn("_id", F.monotonically_increasing_id()))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of two matrices, taken about the mean of the first."""
    middle = a.mean(axis=0)
    a, b = a - middle, b - middle
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2.0 * (a @ b.T), 0.0)


def _limit(radius: float) -> float:
    """Squared radius, with room for the rounding of distances."""
    return (radius * (1.0 + 1e-9)) ** 2


def _strips(points: np.ndarray, pivots: np.ndarray):
    """Squared distances to the pivots, some rows at a time."""
    for i in range(0, len(points), STRIP):
        yield i, _squares(points[i : i + STRIP], pivots)


def _cells(pivots: np.ndarray):
    """Marks each vector with its nearest pivot, and with the distance to it."""

    def run(batches):
        for batch in batches:
            points = _matrix(pa.chunked_array([batch.column("_point")]))
            cell, away = np.zeros(len(points), dtype=np.int64), np.zeros(len(points))
            for i, squares in _strips(points, pivots):
                cell[i : i + STRIP] = squares.argmin(axis=1)
                away[i : i + STRIP] = np.sqrt(squares.min(axis=1))
            yield batch.append_column("_cell", pa.array(cell)).append_column("_away", pa.array(away))

    return run


def _targets(pivots: np.ndarray, reach: np.ndarray, radius: float):
    """A row per vector and cell that may hold another one in reach; ``reach`` is negative for cells without any."""
    between = np.sqrt(_squares(pivots, pivots))
    limit = radius * (1.0 + 1e-6) + 1e-9

    def run(batches):
        for batch in batches:
            points = _matrix(pa.chunked_array([batch.column("_point")]))
            rows, cells = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for i, squares in _strips(points, pivots):
                home = squares.argmin(axis=1)
                own = squares[np.arange(len(home)), home]
                # Half the difference of squares over the distance of the pivots is the distance to the plane.
                gap = squares - own[:, None]
                near = gap <= 2.0 * limit * between[home] + 1e-9 * np.maximum(squares, 1.0)
                near &= (np.sqrt(squares) - reach <= limit) & (reach >= 0)
                at, cell = np.nonzero(near)
                rows.append(at + i)
                cells.append(cell)
            out = batch.take(pa.array(np.concatenate(rows)))
            yield out.append_column("_to", pa.array(np.concatenate(cells)))

    return run


def _groups(points: np.ndarray, radius: float) -> np.ndarray:
    """For each row, the first row it is connected to by steps within the radius."""
    group = np.full(len(points), -1)
    for start in range(len(points)):
        if group[start] >= 0:
            continue
        group[start], frontier = start, np.array([start])
        while len(frontier):
            left = np.flatnonzero(group < 0)
            reached = np.zeros(len(left), dtype=bool)
            for i in range(0, len(frontier), STRIP):
                reached |= (_squares(points[frontier[i : i + STRIP]], points[left]) <= _limit(radius)).any(axis=0)
            frontier = left[reached]
            group[frontier] = start
    return group


def _pack(radius: float | None):
    """One row for the vectors of a block; with a radius, _value becomes the id that names the group within it."""

    def run(table: pa.Table) -> pa.Table:
        ids, values = (table.column(c).to_numpy() for c in ("_id", "_value"))
        points = _matrix(table.column("_point"))
        if radius is not None:
            values = ids[_groups(points, radius)]
        row = [table.column(c)[0].as_py() for c in ("_block", "_cell")]
        row += [float(table.column("_away").to_numpy().max()), ids, values, points.astype(np.float64).tobytes()]
        kinds = [("_block", pa.int64()), ("_cell", pa.int64()), ("_reach", pa.float64())]
        kinds += [("_ids", pa.list_(pa.int64())), ("_values", pa.list_(pa.int64())), ("_points", pa.binary())]
        return pa.table({name: pa.array([x], kind) for (name, kind), x in zip(kinds, row)})

    return run


def _unpacked(batches):
    """A row per vector of the blocks, with its value."""
    for batch in batches:
        for values, flat in zip(batch.column("_values").to_pylist(), batch.column("_points")):
            points = np.frombuffer(flat.as_py(), dtype=np.float64).reshape(len(values), -1)
            offsets = pa.array(np.arange(0, points.size + 1, points.shape[1], dtype=np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(points.ravel()))
            yield pa.RecordBatch.from_arrays([lists, pa.array(values, pa.int64())], names=["_point", "_topic"])


_POINT = "_id long, _value long, _point array<double>"
_BLOCK = "_block long, _cell long, _reach double, _ids array<long>, _values array<long>, _points binary"


def _pivots(points: DataFrame, most: int, seed: int) -> np.ndarray:
    """Some of the vectors, by a digest: one for BLOCK_ROWS of them, and ``most`` at most.

    Their number decides how many vectors meet, and never what is found.
    """
    n = max(1, min(most, points.count() // BLOCK_ROWS))
    picked = points.orderBy(F.xxhash64(F.lit(seed), "_point"), "_point").limit(n).collect()
    return np.array([row["_point"] for row in picked], dtype=np.float64)


def _dealt(placed: DataFrame, cell: str) -> DataFrame:
    """Rows of a cell in blocks of about BLOCK_ROWS."""
    # One row per cell, and their number is a parameter.
    sizes = F.broadcast(placed.groupBy(cell).agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("_parts")))
    block = F.col(cell) * 2**32 + F.pmod(F.xxhash64("_id"), F.col("_parts"))
    return placed.join(sizes, cell).withColumn("_block", block).drop("_parts")


def _blocks(points: DataFrame, pivots: np.ndarray, radius: float | None = None) -> DataFrame:
    """Vectors in blocks by their cells, written."""
    if not len(pivots):
        return points.sparkSession.createDataFrame([], _BLOCK)
    placed = points.select("_id", "_value", "_point").mapInArrow(_cells(pivots), f"{_POINT}, _cell long, _away double")
    dealt = _dealt(cut_lineage(placed), "_cell")
    return cut_lineage(dealt.groupBy("_block").applyInArrow(_pack(radius), _BLOCK))


def _compared(points: DataFrame, blocks: DataFrame, pivots: np.ndarray, radius: float, run, schema: str) -> DataFrame:
    """``run`` on pairs of blocks: of ``points`` sent to a cell, and of that cell of ``blocks``."""
    if not len(pivots):
        return points.sparkSession.createDataFrame([], schema)
    reach = np.full(len(pivots), -1.0)
    for row in blocks.groupBy("_cell").agg(F.max("_reach").alias("reach")).collect():  # a row per cell
        reach[row["_cell"]] = row["reach"]
    sent = points.select("_id", "_value", "_point").mapInArrow(_targets(pivots, reach, radius), f"{_POINT}, _to long")
    dealt = _dealt(cut_lineage(sent), "_to").withColumns({"_cell": F.col("_to"), "_away": F.lit(0.0)})
    a = dealt.groupBy("_block").applyInArrow(_pack(None), _BLOCK).drop("_reach").withColumnsRenamed(
        {c: f"a{c}" for c in ("_block", "_ids", "_values", "_points")}
    )
    b = blocks.drop("_reach").withColumnsRenamed({c: f"b{c}" for c in ("_block", "_ids", "_values", "_points")})
    # A row per block, not per vector. What is joined by block stays where it is for the pairs of blocks.
    met = a.join(F.broadcast(b.select("_cell", "b_block")), "_cell").drop("_cell")
    return met.join(b.drop("_cell"), "b_block").groupBy("a_block", "b_block").applyInArrow(run, schema)


def _sides(table: pa.Table) -> list[np.ndarray]:
    """Ids, values and vectors of the two blocks of a pair."""
    out = []
    for side in "ab":
        ids, values = (np.array(table.column(f"{side}{c}")[0].as_py(), dtype=np.int64) for c in ("_ids", "_values"))
        flat = np.frombuffer(table.column(f"{side}_points")[0].as_py(), dtype=np.float64)
        out += [ids, values, flat.reshape(len(ids), -1)]
    return out


def _weigh(radius: float):
    """Rows in reach of each vector of the first block."""

    def run(table: pa.Table) -> pa.Table:
        ids, _, a, _, values, b = _sides(table)
        n = [(_squares(a[i : i + STRIP], b) <= _limit(radius)) @ values for i in range(0, len(a), STRIP)]
        rows = np.concatenate(n)
        return pa.table({"_id": pa.array(ids[rows > 0]), "n": pa.array(rows[rows > 0], pa.int64())})

    return run


def _link(radius: float):
    """Pairs of groups of two blocks that have vectors in reach of each other."""

    def run(table: pa.Table) -> pa.Table:
        _, own, a, _, other, b = _sides(table)
        order = np.argsort(other, kind="stable")
        b, (names, starts) = b[order], np.unique(other[order], return_index=True)
        found = []
        for i in range(0, len(a), STRIP):
            met = np.logical_or.reduceat(_squares(a[i : i + STRIP], b) <= _limit(radius), starts, axis=1)
            at, group = np.nonzero(met)
            found.append(np.stack([own[i + at], names[group]], axis=1))
        links = np.unique(np.concatenate(found), axis=0)
        return pa.table({"a": pa.array(links[:, 0], pa.int64()), "b": pa.array(links[:, 1], pa.int64())})

    return run


def _closest(radius: float):
    """The nearest vector of the second block in reach of each of the first, by its value."""

    def run(table: pa.Table) -> pa.Table:
        ids, _, a, _, values, b = _sides(table)
        out = []
        for i in range(0, len(a), STRIP):
            squares = _squares(a[i : i + STRIP], b)
            best = squares.argmin(axis=1)
            least = squares[np.arange(len(best)), best]
            near = least <= _limit(radius)
            out.append((ids[i : i + STRIP][near], least[near], values[best[near]]))
        flat = [np.concatenate(x) for x in zip(*out)]
        return pa.table({"_id": pa.array(flat[0]), "_square": pa.array(flat[1]), "_value": pa.array(flat[2])})

    return run


def _nearest(points: DataFrame, dense: DataFrame, pivots: np.ndarray, radius: float) -> DataFrame:
    """(_id, _value): the value of the nearest dense vector, for vectors that have one in reach."""
    near = _compared(points, dense, pivots, radius, _closest(radius), "_id long, _square double, _value long")
    return near.groupBy("_id").agg(F.min(F.struct("_square", "_value"))["_value"].alias("_value"))


def density_topics(
    df: DataFrame,
    radius: float,
    min_points: int = 10,
    min_topic_size: int = MIN_TOPIC_SIZE,
    centres: int = 1000,
    vector: str = "vec",
    seed: int = 42,
) -> DensityTopics:
    """Find topics whose number follows from the data; the largest is topic 0.

    A vector is dense if at least ``min_points`` rows, its own included, lie within the radius of it.
    Dense vectors within the radius of each other are of one topic, and a row belongs to its nearest
    dense vector in reach. Topics with fewer than ``min_topic_size`` rows dissolve into the outliers.
    ``centres`` is the largest number of pivots, and so of cells; it decides the speed alone.
    """
    points = _points(df.select(_doubles(F.col(vector)).alias("_point")))
    pivots = _pivots(points, centres, seed)
    reached = _compared(points, _blocks(points, pivots), pivots, radius, _weigh(radius), "_id long, n long")
    dense = reached.groupBy("_id").agg(F.sum("n").alias("n")).where(F.col("n") >= min_points).select("_id")
    dense = cut_lineage(points.join(dense, "_id"))
    grouped = _blocks(dense, pivots, radius)
    members = grouped.select(F.explode(F.arrays_zip("_ids", "_values")).alias("m"))
    members = cut_lineage(members.select(F.col("m._ids").alias("_id"), F.col("m._values").alias("_value")))
    linked = dense.drop("_value").join(members, "_id")
    edges = _compared(linked, grouped, pivots, radius, _link(radius), "a long, b long")
    joined = components(edges)
    group = members.join(joined, F.col("_value") == F.col("node"), "left")
    group = group.select("_id", F.coalesce("component", "_value").alias("_group"))
    named = cut_lineage(points.join(group, "_id").select("_id", F.col("_group").alias("_value"), "_point"))
    # A dense vector is its own nearest one, so only the others are compared.
    others = points.join(named.select("_id"), "_id", "left_anti")
    found = named.select("_id", "_value").unionByName(_nearest(others, _blocks(named, pivots), pivots, radius))
    sizes = points.select("_id", "_point", F.col("_value").alias("n")).join(found, "_id").groupBy("_value")
    sizes = sizes.agg(F.sum("n").alias("n"), F.min("_point").alias("_first")).where(F.col("n") >= min_topic_size)
    # One row per topic; equal sizes in an order that does not depend on the ids.
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("n"), "_first")
    numbers = sizes.select("_value", (F.row_number().over(order) - 1).alias("_topic"))
    topic = F.coalesce("_topic", F.lit(OUTLIER)).cast("long").alias("_value")
    kept = cut_lineage(named.join(numbers, "_value", "left").select("_id", topic, "_point"))
    return DensityTopics(_blocks(kept, pivots), radius, pivots)


def topic_terms(
    df: DataFrame, text: str = "clean_text", topic: str = "topic", stop_words: list[str] = ENGLISH_STOP_WORDS
) -> DataFrame:
    """How often each word and bigram occurs in each topic."""
    kept = terms(without(tokenize_words(F.col(text)), stop_words))
    known = df.filter(F.col(topic).isNotNull())
    counted = term_tallies(known, kept, known.count(), F.col(topic))
    return counted.select(F.col("name").cast(df.schema[topic].dataType).alias(topic), "term", "n")


def ctfidf_weights(counts: DataFrame, topic: str = "topic", min_df: int = 10) -> DataFrame:
    """Class-based tf-idf of every term: n(t, c) x ln(1 + A / n(t)), with A the mean terms per topic.

    All texts of a topic count as one document, so ``min_df`` is a number of topics.
    """
    per_term = counts.groupBy("term").agg(F.sum("n").alias("everywhere"), F.count("*").alias("topics"))
    kept = counts.join(per_term.filter(F.col("topics") >= min_df), "term")
    mean = kept.agg(F.try_divide(F.sum("n"), F.count_distinct(topic)))
    weight = F.col("n") * F.log(F.lit(1.0) + F.col("_mean") / F.col("everywhere"))
    return kept.withColumn("_mean", mean.scalar()).select(topic, "term", "n", weight.alias("weight"))


def ctfidf_words(
    df: DataFrame,
    n: int = 10,
    min_df: int = 10,
    text: str = "clean_text",
    topic: str = "topic",
    stop_words: list[str] = ENGLISH_STOP_WORDS,
) -> DataFrame:
    """The ``n`` most distinctive words and bigrams of each topic."""
    counts = cut_lineage(topic_terms(df, text, topic, stop_words))
    weights = ctfidf_weights(counts, topic, min_df)
    ranks = Window.partitionBy(topic).orderBy(F.desc(F.round("weight", 9)), "term")
    ranked = weights.withColumn("rank", F.row_number().over(ranks)).filter(F.col("rank") <= n)
    return ranked.select(topic, "rank", "term", "n", "weight")


def merge_topics(df: DataFrame, n: int = MERGED_TOPICS, topic: str = "topic", vector: str = "vec") -> DataFrame:
    """Merge the most similar topics until ``n`` remain; outliers stay apart.

    Each topic is its mean vector and its size, taken per task and then summed. Topics are merged by average
    cosine distance, in rounds over a table with a row per topic; rows are then relabelled by a join. The
    largest merged topic gets number 0; a row without a topic becomes an outlier.
    """
    grouped = df.filter(F.col(topic) != OUTLIER).groupBy(F.col(topic).cast("long").alias("_id"))
    mean = vector_to_array(Summarizer.mean(array_to_vector(F.col(vector))))
    topics = cut_lineage(grouped.agg(mean.alias("_mean"), F.count("*").alias("_rows")))
    edges = cut_lineage(_lowest_merges(topics, n).select("a", "b"))
    group = F.coalesce("component", "_id").alias("_group")
    members = topics.join(components(edges), F.col("_id") == F.col("node"), "left").select("_id", "_rows", group)
    sizes = members.groupBy("_group").agg(F.sum("_rows").alias("_rows"), F.min("_id").alias("_least"))
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("_rows"), "_least")  # a row per merged topic
    numbers = sizes.select("_group", (F.row_number().over(order) - 1).alias("_number"))
    named = cut_lineage(members.join(numbers, "_group").select("_id", "_number")).alias("named")
    rows = df.alias("rows")
    labelled = rows.join(named, F.col(f"rows.{topic}").cast("long") == F.col("named._id"), "left")
    number = F.coalesce("named._number", F.lit(OUTLIER))
    kind = df.schema[topic].dataType
    return labelled.select(*[number.cast(kind).alias(c) if c == topic else F.col(f"rows.{c}") for c in df.columns])


_MERGE = "a long, b long, height double"
_CLUSTER = "_id long, _parts long, _point array<double>"


def _lowest_merges(topics: DataFrame, n: int) -> DataFrame:
    """The merges (a, b, height) that leave ``n`` of the topics.

    Two topics that are nearest to each other merge in any order of merging by average distance, so a round
    merges all such pairs at once. The distance of two groups is that of the means of their unit vectors, so no
    matrix is kept. What fits a block is merged to the end in one task. Of all merges the lowest count.
    """

    def unit(batches):
        for batch in batches:
            points = _matrix(pa.chunked_array([batch.column(1)]))
            points = points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-12)
            yield _clusters_batch(batch.column(0).to_numpy(), np.ones(len(points), dtype=np.int64), points)

    clusters = cut_lineage(topics.select("_id", "_mean").mapInArrow(unit, _CLUSTER))
    total = alive = clusters.count()
    if total <= max(n, 1):
        return topics.sparkSession.createDataFrame([], _MERGE)
    merges = []
    while alive > BLOCK_ROWS:
        nearest = cut_lineage(_nearest_clusters(clusters, alive))
        back = nearest.select(F.col("_id").alias("other"), F.col("other").alias("_id"))
        pairs = cut_lineage(nearest.where("_id < other").join(back, ["_id", "other"]).select("_id", "other", "height"))
        merges.append(pairs.toDF("a", "b", "height"))
        clusters = cut_lineage(_joined(clusters, pairs))
        alive = clusters.count()
    merges.append(clusters.withColumn("_all", F.lit(0)).groupBy("_all").applyInArrow(_merged_to_the_end, _MERGE))
    every = merges[0]
    for more in merges[1:]:
        every = every.unionByName(more)
    return every.orderBy("height", "a", "b").limit(total - max(n, 1))


def _clusters_batch(ids: np.ndarray, parts: np.ndarray, points: np.ndarray) -> pa.RecordBatch:
    lists = pa.array(list(points), pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(parts, pa.int64()), lists], names=["_id", "_parts", "_point"])


def _nearest_clusters(clusters: DataFrame, count: int) -> DataFrame:
    """(_id, other, height): the nearest other cluster of each, the smaller id on a tie; block against block."""
    blocks = -(-count // BLOCK_ROWS)
    dealt = clusters.withColumn("block", F.pmod(F.xxhash64("_id"), F.lit(blocks)).cast("int"))
    left = dealt.withColumn("against", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def best(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        ids, others = (t.column("_id").to_numpy() for t in (a, b))
        found, heights = np.empty(len(ids), dtype=np.int64), np.full(len(ids), np.inf)
        if len(ids) and len(others):
            order = np.argsort(others)
            others, right = others[order], _matrix(b.column("_point"))[order]
            points = _matrix(a.column("_point"))
            for i in range(0, len(ids), STRIP):
                # Rounded, so that both sides of a pair have the same distance.
                distance = np.round(1.0 - points[i : i + STRIP] @ right.T, 12)
                distance[ids[i : i + STRIP, None] == others] = np.inf
                at = distance.argmin(axis=1)
                found[i : i + STRIP], heights[i : i + STRIP] = others[at], distance[np.arange(len(at)), at]
        real = np.isfinite(heights)
        return pa.table({"_id": pa.array(ids[real]), "other": pa.array(found[real]), "height": pa.array(heights[real])})

    # A block meets each of the others in a task of its own.
    right = dealt.withColumn("from", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = left.groupBy("block", "against").cogroup(right.groupBy("from", "block")).applyInArrow(best, "_id long, other long, height double")
    least = met.groupBy("_id").agg(F.min(F.struct("height", "other")).alias("least"))
    return least.select("_id", F.col("least.other").alias("other"), F.col("least.height").alias("height"))


def _joined(clusters: DataFrame, pairs: DataFrame) -> DataFrame:
    """Clusters after the pairs have merged; a merged one keeps the smaller id."""
    ends = pairs.select(F.col("_id").alias("_own"), F.col("_id").alias("_to")).union(pairs.select("other", "_id"))
    placed = clusters.join(ends, F.col("_id") == F.col("_own"), "left").withColumn("_to", F.coalesce("_to", "_id"))
    # One row, or the two of a pair.
    both = placed.groupBy("_to").agg(F.sort_array(F.collect_list(F.struct("_id", "_parts", "_point"))).alias("c"), F.sum("_parts").alias("_parts"))
    a, b = F.col("c")[0], F.get("c", F.lit(1))
    mean = F.zip_with(a["_point"], b["_point"], lambda x, y: (x * a["_parts"] + y * b["_parts"]) / F.col("_parts"))
    return both.select(F.col("_to").alias("_id"), "_parts", F.when(F.size("c") == 1, a["_point"]).otherwise(mean).alias("_point"))


def _merged_to_the_end(table: pa.Table) -> pa.Table:
    """All merges of at most a block of clusters; the nearest pair first, smaller ids on a tie."""
    order = np.argsort(table.column("_id").to_numpy())
    ids, parts = (table.column(c).to_numpy()[order] for c in ("_id", "_parts"))
    unit = _matrix(table.column("_point"))[order]
    parts = parts.astype(float)
    distance = np.round(1.0 - unit @ unit.T, 12)
    np.fill_diagonal(distance, np.inf)
    rows = []
    for _ in range(len(ids) - 1):
        least = distance.min(axis=1)  # per row, then over the rows
        a = int(least.argmin())
        b = int(distance[a].argmin())
        a, b = min(a, b), max(a, b)
        rows.append((int(ids[a]), int(ids[b]), float(distance[a, b])))
        share = parts[a] / (parts[a] + parts[b])
        joined = share * distance[a] + (1.0 - share) * distance[b]
        distance[a], distance[:, a] = joined, joined
        distance[b], distance[:, b] = np.inf, np.inf
        distance[a, a] = np.inf
        parts[a] += parts[b]
    columns = zip(*rows) if rows else ([], [], [])
    return pa.table({n: pa.array(c, t) for n, c, t in zip("abh", columns, (pa.int64(), pa.int64(), pa.float64()))}).rename_columns(["a", "b", "height"])


def topic_info(topics: DataFrame, distinctive: DataFrame, topic: str = "topic", n: int = 4) -> DataFrame:
    """Topic, row count and a name made of the number and the first distinctive words."""
    sizes = topics.filter(F.col(topic).isNotNull()).groupBy(topic).agg(F.count("*").alias("Count"))
    # At most n rows per topic.
    firsts = (
        distinctive.filter(F.col("rank") <= n)
        .groupBy(topic)
        .agg(F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("_terms"))
    )
    terms = F.transform(F.coalesce("_terms", F.array().cast("array<struct<rank:int,term:string>>")), lambda e: e["term"])
    name = F.array_join(F.concat(F.array(F.col(topic).cast("string")), terms), "_")
    return sizes.join(firsts, topic, "left").select(
        F.col(topic).cast("bigint").alias("Topic"), "Count", name.alias("Name")
    )


def topic_tables(df: DataFrame, n: int = MERGED_TOPICS, min_df: int = 10, topic: str = "topic", vector: str = "vec") -> DataFrame:
    """The topic table as the topics were found and after merging to ``n``, as ``stage`` found and merged."""
    stages = {"found": df, "merged": cut_lineage(merge_topics(df, n, topic, vector))}
    tables = [
        topic_info(rows, ctfidf_words(rows, min_df=min_df, topic=topic), topic).select(F.lit(stage).alias("stage"), "*")
        for stage, rows in stages.items()
    ]
    return tables[0].unionByName(tables[1])


def topic_summary(info: DataFrame) -> DataFrame:
    """Number of topics, outlier rows and their share in percent; zero where there are none."""
    outliers = F.sum(F.when(F.col("Topic") == OUTLIER, F.col("Count")).otherwise(0))
    return info.agg(
        F.count_if(F.col("Topic") >= 0).alias("topics"),
        outliers.alias("outliers"),
        F.try_divide(outliers * 100.0, F.sum("Count")).alias("outlier_share"),
    )


def topic_view_other(info: DataFrame) -> DataFrame:
    """The topic table with the outliers named as such."""
    return info.select(
        "Topic", "Count", F.when(F.col("Topic") == OUTLIER, "Other (misc)").otherwise(F.col("Name")).alias("Name")
    )
