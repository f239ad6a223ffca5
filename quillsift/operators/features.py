"""Text features as sparse vectors: term counts and tf-idf."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.errors import IllegalArgumentException
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from quillsift.functions import text as X
from quillsift.functions.arrays import fenced
from quillsift.operators.tallies import counted_rows, rows_with_frequency, term_tallies
from quillsift.session import cut_lineage

def vector_entries(vector: Column) -> Column:
    """Type, size, indices and values of a sparse vector, as Spark stores it."""
    return F.unwrap_udt(vector)


def sparse_vector(size: Column, indices: Column, values: Column) -> Column:
    """The way back: a sparse vector from its parts, which go through Arrow as they are; null if the size is."""

    @F.arrow_udf(VectorUDT())
    def vector(size: pa.Array, indices: pa.Array, values: pa.Array) -> pa.Array:
        sparse = pa.array(np.zeros(len(size), dtype=np.int8))
        parts = [sparse, size.cast(pa.int32()), indices, values]
        return pa.StructArray.from_arrays(parts, names=["type", "size", "indices", "values"], mask=size.is_null())

    return vector(size, indices, values)


class CleanText(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Text cleaning as the first step of a stored model, so that scoring cleans as training did."""

    @keyword_only
    def __init__(self, *, inputCol: str = "full_text", outputCol: str = "clean_text"):
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(inputCol="full_text", outputCol="clean_text")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getOutputCol(), X.clean_text(F.col(self.getInputCol())))


class Terms(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Words of a cleaned text, with bigrams if ``ngrams`` is 2; a null text has none."""

    ngrams = Param(Params._dummy(), "ngrams", "longest n-gram, 1 or 2", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol: str = "clean_text", outputCol: str = "terms", ngrams: int = 2):
        super().__init__()
        self._setDefault(inputCol="clean_text", outputCol="terms", ngrams=2)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        words = X.tokenize_words(F.coalesce(F.col(self.getInputCol()), F.lit("")))
        both = self.getOrDefault(self.ngrams) == 2
        return dataset.withColumn(self.getOutputCol(), X.terms(words) if both else words)


class SublinearTf(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Term counts c replaced by 1 + ln c."""

    @keyword_only
    def __init__(self, *, inputCol: str = "counts", outputCol: str = "log_counts"):
        super().__init__()
        self._setDefault(inputCol="counts", outputCol="log_counts")
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        parts = vector_entries(F.col(self.getInputCol()))
        # The logarithms have a projection of their own: a Python function cannot take a lambda.
        step = dataset.withColumn("_logs", fenced(F.transform(parts["values"], lambda c: F.log(c) + 1.0)))
        return step.withColumn(self.getOutputCol(), sparse_vector(parts["size"], parts["indices"], F.col("_logs"))).drop("_logs")


def _most_frequent(df: DataFrame, terms: str, min_df: float, max_df: float, max_features: int) -> tuple[list[Row], int]:
    """(term, n, df) of the most frequent terms within the limits, ties by the term, and the number of rows."""
    rows = df.count()
    least = min_df if min_df >= 1 else min_df * rows
    most = float("inf") if max_df == 1.0 else max_df if max_df > 1 else max_df * rows
    if least > most:
        raise IllegalArgumentException("max_df leaves fewer rows than min_df asks for")
    used = term_tallies(df, F.col(terms), rows).where(F.col("df").between(F.lit(float(least)), F.lit(float(most))))
    used = cut_lineage(used)
    # Every task gives the driver as many rows as the limit, so few tasks take what can be among them.
    counts = used.groupBy("n").agg(F.count("*").alias("terms"))
    above = F.sum("terms").over(Window.partitionBy(F.lit(1)).orderBy(F.desc("n")))  # a row per distinct count
    last = counts.withColumn("above", above).where(F.col("above") >= max_features).agg(F.max("n")).head()[0] or 0
    chosen = used.where(F.col("n") >= last).coalesce(8).orderBy(F.desc("n"), "term").limit(max_features).collect()
    if not chosen:
        raise IllegalArgumentException("no term is within the limits of document frequency")
    return chosen, rows


def _counter(chosen: list[Row], terms: str, output: str) -> CountVectorizerModel:
    return CountVectorizerModel.from_vocabulary([row["term"] for row in chosen], inputCol=terms, outputCol=output)


def count_features(
    df: DataFrame,
    terms: str = "terms",
    output: str = "counts",
    min_df: float = 10,
    max_df: float = 0.5,
    max_features: int = 10_000,
) -> CountVectorizerModel:
    """Term counts over the most frequent terms; the vocabulary is bounded by ``max_features``.

    Limits below 1 are shares of the rows, others numbers of rows; a ``max_df`` of 1.0 means all rows.
    """
    chosen, _ = _most_frequent(df, terms, min_df, max_df, max_features)
    return _counter(chosen, terms, output)


def tfidf_features(
    df: DataFrame,
    terms: str = "terms",
    output: str = "features",
    min_df: float = 5,
    max_df: float = 0.9,
    max_features: int = 50_000,
    sublinear: bool = False,
) -> PipelineModel:
    """Counts times (ln((1 + n) / (1 + df)) + 1), scaled to unit length."""
    chosen, rows = _most_frequent(df, terms, min_df, max_df, max_features)
    source = "log_counts" if sublinear else "counts"
    stages = [_counter(chosen, terms, "counts")]
    if sublinear:
        stages.append(SublinearTf(inputCol="counts", outputCol="log_counts"))
    having = np.array([row["df"] for row in chosen], dtype=float)
    weights = Vectors.dense(np.log((rows + 1.0) / (having + 1.0)) + 1.0)
    stages.append(ElementwiseProduct(inputCol=source, outputCol="weighted", scalingVec=weights))
    stages.append(Normalizer(inputCol="weighted", outputCol=output, p=2.0))
    return PipelineModel(stages)


def vocabulary(model: CountVectorizerModel, spark) -> DataFrame:
    """Index and term, as many rows as the vocabulary limit at most."""
    return spark.createDataFrame(list(enumerate(model.vocabulary)), "index int, term string")


def long_form(df: DataFrame, vector: str, model: CountVectorizerModel, value: str, row_id: str = "review_id") -> DataFrame:
    """Sparse vectors as rows of key, term and value."""
    parts = df.select(row_id, vector_entries(F.col(vector)).alias("_parts"))
    entries = parts.select(row_id, F.explode(F.arrays_zip("_parts.indices", "_parts.values")).alias("_entry"))
    # The vocabulary has a fixed upper size, see count_features.
    named = entries.join(F.broadcast(vocabulary(model, df.sparkSession)), F.col("_entry.indices") == F.col("index"))
    return named.select(row_id, "term", F.col("_entry.values").alias(value))


def _frequencies(df: DataFrame, terms: str, min_df: float, max_df: float, row_id: str, kept: str, make) -> DataFrame:
    """``make(rows, ids, terms, n, df, total)`` over the terms within the limits, ``total`` being the number of rows."""
    total = df.count()
    kind = df.schema[row_id].dataType.simpleString()
    counted = counted_rows(df, terms, row_id)

    def table(*found) -> pa.Table:
        return make(*found, total)

    schema = f"`{row_id}` {kind}, term string, {kept}"
    return rows_with_frequency(counted, total, min_df, float(max_df) * total, schema, table, row_id)


def term_counts(
    df: DataFrame, terms: str = "terms", min_df: float = 10, max_df: float = 0.5, row_id: str = "review_id"
) -> DataFrame:
    """Rows of key, term, count ``n`` and document frequency ``df``, over all terms within the limits.

    The relational form of ``count_features``: no vocabulary comes to the driver, so its size has no limit.
    ``min_df`` is a number of rows, ``max_df`` a share of them.
    """

    def make(rows, ids, terms, n, df, _) -> pa.Table:
        return pa.table({row_id: ids.take(pa.array(rows)), "term": terms, "n": pa.array(n.astype(float)), "df": pa.array(df)})

    return _frequencies(df, terms, min_df, max_df, row_id, "n double, df long", make)


def tfidf_weights(
    df: DataFrame,
    terms: str = "terms",
    min_df: float = 5,
    max_df: float = 0.9,
    sublinear: bool = False,
    row_id: str = "review_id",
) -> DataFrame:
    """The weights of ``tfidf_features`` as rows of key, term and ``weight``, over all terms within the limits."""

    def make(rows, ids, terms, n, df, total) -> pa.Table:
        tf = np.log(n) + 1.0 if sublinear else n.astype(float)
        raw = tf * (np.log((total + 1.0) / (df + 1)) + 1)
        norm = np.sqrt(np.bincount(rows, raw * raw, minlength=len(ids)))
        return pa.table({row_id: ids.take(pa.array(rows)), "term": terms, "weight": pa.array(raw / norm[rows])})

    return _frequencies(df, terms, min_df, max_df, row_id, "weight double", make)


def document_frequency(df: DataFrame, terms: str = "terms") -> DataFrame:
    """Rows in which each term occurs."""
    return term_tallies(df, F.col(terms), df.count()).select("term", "df")


def class_weights(df: DataFrame, label: str = "sentiment_label") -> DataFrame:
    """Rows / (classes x rows of the class); one row per class."""
    counted = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    totals = counted.agg(F.sum("n").alias("rows"), F.count("*").alias("classes"))
    weight = F.try_divide(totals.select("rows").scalar(), totals.select("classes").scalar() * F.col("n"))
    return counted.select(label, "n", weight.alias("weight"))


def add_class_weights(df: DataFrame, label: str = "label", output: str = "weight") -> DataFrame:
    """Weight of each row's class. The weights are as many numbers as there are classes."""
    weights = {row[0]: row["weight"] for row in class_weights(df, label).collect()}
    cases = F.create_map(*[F.lit(part) for pair in weights.items() for part in pair])
    return df.withColumn(output, F.try_element_at(cases, F.col(label)))
