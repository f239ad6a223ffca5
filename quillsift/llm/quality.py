"""Quality classifier: a generalised additive model with pairwise interactions, learnt by cyclic boosting.

Every text becomes a fixed row of counts and shares. Each feature is cut into bins; boosting goes round
the features and adds a shallow tree over one feature's bins to that feature's lookup table, then round
the strongest pairs of features, adding trees over two features to their two-way tables. Scoring adds the
table entries of a row's bins.

The model is fitted on at most ``max_rows`` labelled rows, taken in the order of a digest of their id;
every row is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.llm.common import batch_texts, cut_lineage, own_columns, slices, tidied, trim

FEATURES = """log_bytes log_words word_bytes upper digit bang stop_mark comma symbol bar non_ascii
newline_per_word distinct_words top_word next_repeat distinct_pairs distinct_lines line_words short_words
long_words""".split()

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "bang": b"!?",
    "stop_mark": b".",
    "comma": b",;:",
    "symbol": b"#$%&*@^~_=<>{}[]\\/+",
    "bar": b"|",
    "newline": b"\n",
}
_CLASS_OF = np.zeros(256, dtype=np.uint8)
for _number, _bytes in enumerate(_CLASSES.values(), 1):
    _CLASS_OF[list(_bytes)] = _number
_CLASS_OF[128:] = len(_CLASSES) + 1
_COUNT = len(_CLASSES) + 2


def _coded(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """Row numbers and value codes of a list column, the number of values, and the byte length of each value."""
    offsets = lists.offsets.to_numpy()
    values = lists.flatten().dictionary_encode()
    rows = np.repeat(np.arange(len(lists)), np.diff(offsets))
    return rows, values.indices.to_numpy().astype(np.int64), len(values.dictionary), np.asarray(
        pc.binary_length(values.dictionary), dtype=np.int64
    )


def _distinct(rows: np.ndarray, codes: np.ndarray, count: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: the number of distinct codes and the largest count of one code."""
    keys, counts = np.unique(rows * max(1, count) + codes, return_counts=True)
    at = keys // max(1, count)
    most = np.zeros(n)
    np.maximum.at(most, at, counts)
    return np.bincount(at, minlength=n), most


def features(texts: list[str]) -> np.ndarray:
    """One row of ``FEATURES`` per text; an empty text is all zeros."""
    n = len(texts)
    column = pa.array(texts, type=pa.large_string())
    sizes = np.asarray(pc.binary_length(column), dtype=np.int64)
    raw = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    own = np.repeat(np.arange(n) * _COUNT, sizes)
    by_class = np.bincount(own + _CLASS_OF[raw], minlength=n * _COUNT).reshape(n, _COUNT)
    rows, codes, count, lengths = _coded(pc.ascii_split_whitespace(column))
    keep = lengths[codes] > 0  # white space at an end gives an empty word
    rows, codes = rows[keep], codes[keep]
    words = np.bincount(rows, minlength=n)
    per_word = 1 / np.maximum(1, words)
    per_byte = 1 / np.maximum(1, sizes)
    word_bytes = lengths[codes]
    distinct, most = _distinct(rows, codes, count, n)
    inside = rows[1:] == rows[:-1]
    repeats = np.bincount(rows[1:][inside & (codes[1:] == codes[:-1])], minlength=n)
    pairs = np.maximum(0, words - 1)
    # Codes of pairs stay below 2**63: a slice of texts has some hundred thousand distinct words.
    pair_codes = codes[1:][inside] * max(1, count) + codes[:-1][inside]
    pair_values, pair_index = np.unique(pair_codes, return_inverse=True)
    distinct_pairs, _ = _distinct(rows[1:][inside], pair_index, len(pair_values), n)
    line_rows, line_codes, line_count, _ = _coded(pc.split_pattern(column, "\n"))
    lines = np.bincount(line_rows, minlength=n)
    distinct_lines, _ = _distinct(line_rows, line_codes, line_count, n)
    share = {name: by_class[:, i] * per_byte for i, name in enumerate(_CLASSES, 1)}
    out = np.column_stack(
        [
            np.log1p(sizes),
            np.log1p(words),
            np.bincount(rows, weights=word_bytes, minlength=n) * per_word,
            *(share[name] for name in ("upper", "digit", "bang", "stop_mark", "comma", "symbol", "bar")),
            by_class[:, -1] * per_byte,
            by_class[:, 1 + list(_CLASSES).index("newline")] * per_word,
            distinct * per_word,
            most * per_word,
            repeats * per_word,
            distinct_pairs / np.maximum(1, pairs),
            distinct_lines / np.maximum(1, lines),
            words / np.maximum(1, lines),
            np.bincount(rows, weights=word_bytes <= 3, minlength=n) * per_word,
            np.bincount(rows, weights=word_bytes >= 15, minlength=n) * per_word,
        ]
    )
    out[sizes == 0] = 0
    return out.astype(np.float32)


@dataclass
class AdditiveModel:
    """Bin edges, one table per feature, and one table per chosen pair over coarser bins."""

    edges: list[np.ndarray]
    intercept: float
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)])

    def margin(self, x: np.ndarray) -> np.ndarray:
        bins = self.bins(x)
        out = np.full(len(x), self.intercept)
        for f, values in enumerate(self.tables):
            out += values[bins[:, f]]
        for (i, j), values in zip(self.pairs, self.pair_tables):
            out += values[self.coarse[i][bins[:, i]], self.coarse[j][bins[:, j]]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.margin(x))


def _sigmoid(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def _tree(gradient: np.ndarray, weight: np.ndarray, depth: int, penalty: float, least: float) -> np.ndarray:
    """Leaf values over ordered bins: cut where the gain is largest, ``depth`` levels deep."""
    out = np.zeros(len(gradient))

    def grow(lo: int, hi: int, level: int) -> None:
        g, h = gradient[lo:hi], weight[lo:hi]
        if level and hi - lo > 1:
            gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
            gr, hr = g.sum() - gl, h.sum() - hl
            gain = gl**2 / (hl + penalty) + gr**2 / (hr + penalty) - g.sum() ** 2 / (h.sum() + penalty)
            gain[(hl < least) | (hr < least)] = 0
            cut = int(np.argmax(gain))
            if gain[cut] > 1e-9:
                grow(lo, lo + cut + 1, level - 1)
                grow(lo + cut + 1, hi, level - 1)
                return
        out[lo:hi] = g.sum() / (h.sum() + penalty)

    grow(0, len(gradient), depth)
    return out


def _corner_tree(gradient: np.ndarray, weight: np.ndarray, penalty: float, least: float) -> tuple[np.ndarray, float]:
    """The best pair of cuts, one on each side of a two-way table: four leaf values, and the gain."""
    g, h = gradient.cumsum(0).cumsum(1), weight.cumsum(0).cumsum(1)
    total_g, total_h = g[-1, -1], h[-1, -1]

    def parts(c: np.ndarray, total: float):
        a = c[:-1, :-1]
        left, top = c[:-1, -1:], c[-1:, :-1]
        return a, left - a, top - a, total - left - top + a

    gain = -(total_g**2) / (total_h + penalty)
    values = []
    fits = True
    for pg, ph in zip(parts(g, total_g), parts(h, total_h)):
        gain = gain + pg**2 / (ph + penalty)
        fits = fits & (ph >= least)
        values.append(pg / (ph + penalty))
    gain = np.where(fits, gain, 0.0)
    out = np.zeros_like(gradient)
    if not gain.size or gain.max() <= 1e-9:
        return out, 0.0
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out[: i + 1, : j + 1] = values[0][i, j]
    out[: i + 1, j + 1 :] = values[1][i, j]
    out[i + 1 :, : j + 1] = values[2][i, j]
    out[i + 1 :, j + 1 :] = values[3][i, j]
    return out, float(gain[i, j])


def fit(
    x: np.ndarray,
    y: np.ndarray,
    max_bins: int = 64,
    rounds: int = 120,
    pair_count: int = 10,
    pair_rounds: int = 60,
    pair_bins: int = 12,
    rate: float = 0.1,
    depth: int = 2,
    penalty: float = 1.0,
    least: float = 1.0,
) -> AdditiveModel:
    """Boost main effects in turn, then the pairs whose two-way tables explain most of what is left.

    Without rows, or with one class only, the tables stay at zero and the score is the smoothed share.
    """
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, max_bins + 1)[1:-1])) if len(x) else np.empty(0)
             for f in range(x.shape[1])]
    share = (y.sum() + 1) / (len(y) + 2)
    tables = [np.zeros(len(e) + 1) for e in edges]
    coarse = [np.arange(len(e) + 1) * pair_bins // (len(e) + 1) if len(e) + 1 > pair_bins else np.arange(len(e) + 1)
              for e in edges]
    model = AdditiveModel(edges, float(np.log(share / (1 - share))), tables, coarse)
    if not len(y) or y.min() == y.max():
        return model
    bins = model.bins(x)
    margin = np.full(len(y), model.intercept)
    for _ in range(rounds):
        for f, values in enumerate(tables):
            p = _sigmoid(margin)
            g = np.bincount(bins[:, f], weights=y - p, minlength=len(values))
            h = np.bincount(bins[:, f], weights=p * (1 - p), minlength=len(values))
            step = rate * _tree(g, h, depth, penalty, least)
            values += step
            margin += step[bins[:, f]]
    small = np.column_stack([c[bins[:, f]] for f, c in enumerate(coarse)])
    width = [int(c.max()) + 1 for c in coarse]

    def table_of(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = _sigmoid(margin)
        cell = small[:, i] * width[j] + small[:, j]
        size, shape = width[i] * width[j], (width[i], width[j])
        g = np.bincount(cell, weights=y - p, minlength=size).reshape(shape)
        h = np.bincount(cell, weights=p * (1 - p), minlength=size).reshape(shape)
        return cell, g, h

    ranked = []
    for i in range(len(edges)):
        for j in range(i):
            _, g, h = table_of(i, j)
            ranked.append((-_corner_tree(g, h, penalty, least)[1], i, j))
    model.pairs = [(i, j) for gain, i, j in sorted(ranked)[:pair_count] if gain < 0]
    model.pair_tables = [np.zeros((width[i], width[j])) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for (i, j), values in zip(model.pairs, model.pair_tables):
            cell, g, h = table_of(i, j)
            step = rate * _corner_tree(g, h, penalty, least)[0]
            values += step
            margin += step.ravel()[cell]
    return model


def feature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): the features of every whole text; null and empty texts are all zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch_texts(batch.column(1))
            for at, to in slices(map(len, texts), 2_000_000):
                x = features(texts[at:to])
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel())
                )
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), lists], names=["doc_id", "x"])

    return own_columns(docs, id_col, text_col).mapInArrow(tidied(run), "doc_id long, x array<float>")


def fit_quality(table: DataFrame, labels: DataFrame, max_rows: int = 50_000, **options) -> AdditiveModel:
    """Fit on rows of ``table`` (doc_id, x) that have a label in ``labels`` (doc_id, label 0 or 1).

    At most ``max_rows`` rows are used, in the order of a digest of their id. Rows without a label are not
    used; a document with several labels counts once for each.
    """
    known = labels.where("label in (0, 1)").select("doc_id", "label")
    chosen = (
        table.join(known, "doc_id")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label")
        .limit(max_rows)
        .select("x", "label")
        .toArrow()
    )
    if not len(chosen):
        return fit(np.zeros((0, len(FEATURES)), dtype=np.float32), np.zeros(0), **options)
    x = chosen.column("x").combine_chunks().flatten().to_numpy().reshape(len(chosen), -1)
    y = chosen.column("label").to_numpy().astype(float)
    return fit(x, y, **options)


def fit_on_texts(docs: DataFrame, labels: DataFrame, max_rows: int = 50_000, **options) -> AdditiveModel:
    """``fit_quality`` that reads only the texts it learns from: those of at most ``max_rows`` labelled ids.

    The ids are taken in the order of a digest, and so are their rows. Null ids and labels are not used.
    """
    known = labels.where("label in (0, 1)").select(labels["doc_id"].cast("long").alias("doc_id"), "label")
    present = docs.select(docs["doc_id"].cast("long").alias("doc_id")).distinct()
    chosen = known.join(present, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_rows)
    ids = cut_lineage(chosen.select("doc_id").distinct())
    # At most max_rows ids, so the texts stay where they are.
    texts = own_columns(docs, "doc_id", "text").join(F.broadcast(ids), "doc_id")
    return fit_quality(feature_table(texts), known, max_rows, **options)


def score_column(model: AdditiveModel, text: Column) -> Column:
    """The score of each text; only texts go to the Python workers. Null and empty texts are scored from zeros."""

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        texts = batch_texts(column)
        parts = [model.score(features(texts[at:to])) for at, to in slices(map(len, texts), 1_000_000)]
        trim()
        return pa.array(np.concatenate(parts) if parts else np.empty(0))

    return score(text)


def score_table(table: DataFrame, model: AdditiveModel) -> DataFrame:
    """(doc_id, score) for every row of a feature table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            x = lists.flatten().to_numpy().reshape(len(lists), len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    return table.mapInArrow(run, "doc_id long, score double")


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether a document belongs to the part that a model must not learn from; a null id does not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, max_rows: int = 50_000, parts: int = 5, part: int = 0) -> DataFrame:
    """Per document: ``doc_id, held_out, score``; labels of held-out documents are not learnt from.

    ``docs`` has doc_id and text, ``labels`` has doc_id and label; further columns are ignored. Null and
    empty texts are scored like any other, from zeros; repeated rows are scored each; null labels and
    labels of unknown documents are not used; an empty table gives no rows.
    """
    table = cut_lineage(feature_table(docs))
    outside = held_out(F.col("doc_id"), parts, part)
    model = fit_quality(table, labels.select("doc_id", "label").where(~outside), max_rows)
    return score_table(table, model).select("doc_id", outside.alias("held_out"), "score")
