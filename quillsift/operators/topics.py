"""Topics by latent Dirichlet allocation over term counts: batch variational inference.

Every iteration takes all rows once. A task infers the topic shares of its rows against the topic-term
matrix, whose size the vocabulary bounds, and adds up one matrix of statistics; the matrices of the tasks are
added up in two steps, a batch at a time, and replace the topic-term matrix. Rows start from equal shares, so
the partitioning of the table changes the result by rounding only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.functions.arrays import dominant_topic
from quillsift.functions.columns import TOPIC_LABELS, topic_label
from quillsift.operators.features import vocabulary
from quillsift.operators.linear import SparseRows, entries
from quillsift.session import cut_lineage

#: Entries of a block of rows, and of rows of similar size that the inference takes at once; steps and change of a
#: row's shares at which it ends.
TOGETHER, AT_ONCE, STEPS, CHANGE = 200_000, 60_000, 100, 1e-3

#: Statistics of so many tasks are added up by one task.
FAN = 64

_MATRIX = "topic int, weights array<double>"


def digamma(x: np.ndarray) -> np.ndarray:
    """The logarithmic derivative of the gamma function, for x > 0."""
    # Six steps of the recurrence, as one fraction, lead to where the series holds.
    y = x * (x + 5)
    steps = (2 * x + 5) * ((3 * y + 20) * y + 24) / (y * (y + 4) * (y + 6))
    x = x + 6
    inverse = 1 / x
    r = inverse * inverse
    series = r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r * (1 / 132)))))
    return np.log(x) - 0.5 * inverse - series - steps


def _expected(weights: np.ndarray) -> np.ndarray:
    """exp(E[log p]) of Dirichlet weights, by row."""
    return np.exp(digamma(weights) - digamma(weights.sum(axis=1, keepdims=True)))


def _alike(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Rows with entries in groups of similar size, each of about ``AT_ONCE`` entries."""
    order = np.argsort(sizes, kind="stable")
    order = order[np.searchsorted(sizes[order], 1) :]
    at = 0
    while at < len(order):
        least = int(sizes[order[at]])
        to = int(np.searchsorted(sizes[order], least + least // 8, side="right"))
        to = min(to, at + max(1, AT_ONCE // least))
        yield order[at:to]
        at = to


def _settled(values: np.ndarray, factor: np.ndarray, prior: float) -> np.ndarray:
    """Dirichlet weights (rows, topics) from counts (rows, places) and topic factors (rows, places, topics)."""
    gamma = np.ones((len(values), factor.shape[2]))
    live, moving = np.arange(len(values)), np.ones(len(values), dtype=bool)
    even = np.full(gamma.shape[1], 1 / gamma.shape[1])
    for _ in range(STEPS):
        if not moving.any():
            break
        # Whatever scales the factors of a row cancels out.
        theta = np.exp(digamma(gamma[live]))
        norm = np.matmul(factor, theta[:, :, None])[:, :, 0] + 1e-100
        new = prior + theta * np.matmul((values / norm)[:, None, :], factor)[:, 0, :]
        # A row that has come to rest stays as it is, whatever rows it shares a group with.
        far = np.abs(new - gamma[live]) @ even >= CHANGE
        gamma[live[moving]] = new[moving]
        moving &= far
        if np.count_nonzero(moving) < 0.7 * len(moving):
            factor, values, live = factor[moving], values[moving], live[moving]
            moving = np.ones(len(live), dtype=bool)
    return gamma


def infer(rows: SparseRows, terms: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Dirichlet weights of the topics of each row; with them the share that every entry gives each topic.

    ``terms`` is exp(E[log p]) by topic and term. Returns the weights (rows, topics), and for all entries the
    count over its norm, and the topic factors of its row.
    """
    n, topics = rows.shape[0], len(terms)
    gamma = np.full((n, topics), prior)
    sizes = np.bincount(rows.rows, minlength=n)
    starts = np.cumsum(sizes) - sizes
    by_term = np.ascontiguousarray(terms.T)
    norm = np.empty(len(rows.values))
    for group in _alike(sizes):
        # Shorter rows are filled up with places of count 0.
        inside = np.arange(sizes[group].max()) < sizes[group][:, None]
        place = np.where(inside, starts[group][:, None] + np.arange(inside.shape[1]), starts[group][:, None])
        factor = by_term[rows.columns[place]]
        gamma[group] = _settled(np.where(inside, rows.values[place], 0.0), factor, prior)
        norm[place[inside]] = np.matmul(factor, _expected(gamma[group])[:, :, None])[:, :, 0][inside]
    return gamma, rows.values / (norm + 1e-100), _expected(gamma)


def _tally(total: np.ndarray, rows: SparseRows, share: np.ndarray, theta: np.ndarray) -> None:
    """Add what the entries of some rows give each topic to the statistics, by topic and term."""
    used, place = np.unique(rows.columns, return_inverse=True)
    for k in range(len(total)):
        total[k, used] += np.bincount(place, share * theta[rows.rows, k], minlength=len(used))


def _blocks(indices: pa.Array, values: pa.Array, width: int) -> Iterator[SparseRows]:
    """Rows of a batch in steps of about ``TOGETHER`` entries."""
    at, ends = 0, np.cumsum(np.diff(values.offsets.to_numpy()))
    while at < len(values):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + TOGETHER, side="right")))
        yield SparseRows.from_lists(indices.slice(at, to - at), values.slice(at, to - at), width)
        at = to


def _matrix_batch(matrix: np.ndarray) -> pa.RecordBatch:
    number = pa.array(range(len(matrix)), pa.int32())
    return pa.RecordBatch.from_arrays([number, pa.array(list(matrix), pa.list_(pa.float64()))], names=["topic", "weights"])


def _added(parts: DataFrame, tasks: int, topics: int, width: int) -> np.ndarray:
    """The sum of the matrices of all ``tasks``; a task holds one matrix, however many it adds."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((topics, width))
        for batch in batches:
            weights = batch.column(1).flatten().to_numpy().reshape(-1, width)
            np.add.at(total, batch.column(0).to_numpy(), weights)
        yield _matrix_batch(total)

    if tasks > FAN:
        parts = parts.repartition(math.ceil(tasks / FAN)).mapInArrow(add, _MATRIX)
    total = np.zeros((topics, width))
    for row in parts.repartition(1).mapInArrow(add, _MATRIX).collect():
        total[row["topic"]] = row["weights"]
    return total


class _Writer(MLWriter):
    def __init__(self, instance: TopicShares):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        rows = [(i, row.tolist()) for i, row in enumerate(self.instance.matrix)]
        self.sparkSession.createDataFrame(rows, _MATRIX).coalesce(1).write.parquet(f"{path}/topics")


class _Reader(MLReader):
    def load(self, path: str) -> TopicShares:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        instance = TopicShares()
        instance._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(instance, metadata)
        rows = self.sparkSession.read.parquet(f"{path}/topics").orderBy("topic").collect()
        instance.matrix = np.array([r["weights"] for r in rows])
        return instance


class TopicShares(Transformer, HasInputCol, HasOutputCol, MLReadable, MLWritable):
    """A fitted topic model: adds the topic shares of each row, all zero for a row without a known term."""

    prior = Param(Params._dummy(), "prior", "Dirichlet prior of a topic in a row", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCol: str = "counts", outputCol: str = "mixture", prior: float = 1.0):
        super().__init__()
        self._setDefault(inputCol="counts", outputCol="mixture", prior=1.0)
        self._set(**self._input_kwargs)
        self.matrix = np.ones((1, 0))

    def of(self, matrix: np.ndarray) -> TopicShares:
        """With Dirichlet weights by topic and term."""
        self.matrix = matrix
        return self

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()

    def _transform(self, dataset: DataFrame) -> DataFrame:
        prior, topics, width = self.getOrDefault(self.prior), *self.matrix.shape
        # The vocabulary limit times the number of topics.
        shared = dataset.sparkSession.sparkContext.broadcast(_expected(self.matrix))

        @F.arrow_udf("array<double>")
        def shares(indices: pa.Array, values: pa.Array) -> pa.Array:
            out = np.zeros((len(values), topics))
            at = 0
            for rows in _blocks(indices, values, width):
                gamma, _, _ = infer(rows, shared.value, prior)
                known = np.bincount(rows.rows, minlength=rows.shape[0]) > 0
                out[at : at + len(gamma)][known] = (gamma / gamma.sum(axis=1, keepdims=True))[known]
                at += len(gamma)
            return pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, topics, dtype=np.int32)), pa.array(out.ravel()))

        _, indices, values = entries(self.getInputCol())
        # Not deterministic for Spark, so that it is not repeated for each use of the shares.
        return dataset.withColumn(self.getOutputCol(), shares.asNondeterministic()(indices, values))

    def describe_topics(self, n: int = 10) -> DataFrame:
        """The ``n`` heaviest terms of each topic as (topic, termIndices, termWeights); ties by the index."""
        shares = self.matrix / self.matrix.sum(axis=1, keepdims=True)
        rows = []
        for topic, weights in enumerate(shares):
            best = np.argsort(-weights, kind="stable")[:n]
            rows.append((topic, best.tolist(), weights[best].tolist()))
        schema = "topic int, termIndices array<int>, termWeights array<double>"
        return SparkSession.active().createDataFrame(rows, schema)


def lda_fit(df: DataFrame, topics: int = 12, iterations: int = 30, counts: str = "counts", seed: int = 42) -> TopicShares:
    """Variational topic model with fixed priors of one over the number of topics, by full iterations over all rows."""
    parts = F.unwrap_udt(F.col(counts))
    found = df.select(F.coalesce(parts["size"], F.size(parts["values"])).alias("n")).head()
    width = found["n"] if found else 0
    prior = 1.0 / topics
    matrix = np.random.default_rng(seed).gamma(100.0, 0.01, (topics, width))
    rows = cut_lineage(df.select(*entries(counts)[1:]))
    tasks = rows.rdd.getNumPartitions()
    context = df.sparkSession.sparkContext
    for _ in range(iterations if width else 0):
        factors = _expected(matrix)
        shared = context.broadcast(factors)

        def statistics(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = np.zeros((topics, width))
            for batch in batches:
                for block in _blocks(batch.column(0), batch.column(1), width):
                    _, share, theta = infer(block, shared.value, prior)
                    _tally(total, block, share, theta)
            yield _matrix_batch(total)

        matrix = prior + factors * _added(rows.mapInArrow(statistics, _MATRIX), tasks, topics, width)
        shared.destroy()
    return TopicShares(inputCol=counts, prior=prior).of(matrix)


def lda_topic_mix(model: TopicShares, df: DataFrame, output: str = "mixture") -> DataFrame:
    """Topic shares of each row; all zero for a row without a known term."""
    return model.copy({model.outputCol: output}).transform(df)


def add_dominant_topic(df: DataFrame, mixture: str = "mixture", names: dict[int, str] = TOPIC_LABELS) -> DataFrame:
    """Topic with the largest share and its label; null for a row without a known term."""
    found = df.withColumn("dominant_topic", dominant_topic(F.col(mixture)))
    return found.withColumn("topic_label", topic_label("dominant_topic", names))


def topic_top_words(model: TopicShares, counter: CountVectorizerModel, n: int = 15) -> DataFrame:
    """The heaviest terms of each topic in order, one row per topic."""
    described = model.describe_topics(n)
    places = described.select(
        "topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "entry")
    )
    # The vocabulary has a fixed upper size, see count_features.
    terms = F.broadcast(vocabulary(counter, described.sparkSession))
    named = places.join(terms, F.col("entry.termIndices") == F.col("index"))
    # At most n rows per topic.
    ordered = F.sort_array(F.collect_list(F.struct("rank", "term")))
    return named.groupBy("topic").agg(F.array_join(F.transform(ordered, lambda e: e["term"]), ", ").alias("words"))
