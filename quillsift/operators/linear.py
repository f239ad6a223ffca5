"""Linear classifiers by Newton's method on packed sparse rows; scoring on every row of a table.

Newton steps come from conjugate gradients on products with the Hessian, so a fit ends at its tolerance after some
ten steps. Every fit takes all labelled rows. Up to ``MAX_ROWS`` of them with ``MAX_ENTRIES`` entries meet in one task:
the rows arrive as Arrow lists, columns that many rows have become one dense block for the matrix products, the rest
stays sparse; several fits (folds, draws of a search) are several tasks. More rows stay with the
executors, in blocks on their disks (``Blocks``): every product is a pass over them, in which a task adds up one vector as long as the coefficients,
and the driver takes the steps. Only coefficients come to the driver. Scoring is an Arrow function with the coefficients.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.functions.arrays import row_argmax

#: What one task takes: labelled rows, and entries of their vectors (some 60 bytes each in the task). More are fitted in blocks.
MAX_ROWS, MAX_ENTRIES = 200_000, 12_000_000

#: Entries of a block, and vectors that a task or the driver adds up.
BLOCK_ENTRIES, FAN = 250_000, 16

#: Bytes of the dense block of a task, and the share of rows that a column of it must have at least.
DENSE_BYTES, DENSE_SHARE = 256 << 20, 0.02


def in_bounds(df: DataFrame, entries: Column) -> bool:
    """Whether one task can hold all rows of ``df``; ``entries`` is the number of entries of a row."""
    count, total = df.agg(F.count("*"), F.coalesce(F.sum(entries), F.lit(0))).head()
    return count <= MAX_ROWS and total <= MAX_ENTRIES


def at_most(df: DataFrame, entries: Column, rows: int = MAX_ROWS, key: str | None = None) -> DataFrame:
    """All rows of ``df``, or as many as ``rows`` and ``MAX_ENTRIES`` allow, by a digest of their key (default: all columns).

    ``entries`` is the number of entries of a row. For trials by hand: no fit takes its rows from here.
    """
    count, total = df.agg(F.count("*"), F.coalesce(F.sum(entries), F.lit(0))).head()
    share = min(rows / max(1, count), MAX_ENTRIES / max(1, total))
    if share >= 1:
        return df
    columns = [key] if key else df.columns
    chosen = F.pmod(F.xxhash64(*columns, F.lit("fit")), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    return df.where(chosen).limit(rows)


def entries(vector: str) -> list[Column]:
    """Size, indices (null in a dense vector) and values of a vector column."""
    parts = F.unwrap_udt(F.col(vector))
    return [parts["size"].alias("size"), parts["indices"].alias("indices"), parts["values"].alias("values")]


@dataclass
class SparseRows:
    """Rows as (row, column, value) entries, by row."""

    rows: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    shape: tuple[int, int]

    @classmethod
    def from_lists(cls, indices: pa.Array, values: pa.Array, width: int | None = None) -> SparseRows:
        """From list columns; a null list of indices means that the values stand at 0, 1, ...; columns beyond a width are left out."""
        offsets = values.offsets.to_numpy()
        sizes = np.diff(offsets)
        flat = values.flatten().to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        if indices.null_count:
            columns = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            sparse = np.asarray(indices.is_valid())[rows]
            columns[sparse] = indices.flatten().to_numpy(zero_copy_only=False)
        else:
            columns = indices.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
        if width is None:
            width = int(columns.max(initial=-1)) + 1
        elif columns.max(initial=-1) >= width:
            known = columns < width
            rows, columns, flat = rows[known], columns[known], flat[known]
        return cls(rows, columns, flat.astype(np.float64), (len(sizes), width))

    def where(self, keep: np.ndarray) -> SparseRows:
        """The rows that are kept, numbered anew."""
        place = (np.cumsum(keep) - 1).astype(self.rows.dtype)
        own = keep[self.rows]
        return SparseRows(place[self.rows[own]], self.columns[own], self.values[own], (int(keep.sum()), self.shape[1]))

    def times(self, weights: np.ndarray) -> np.ndarray:
        """(rows, k) from (columns, k)."""
        out = np.empty((self.shape[0], weights.shape[1]))
        for k in range(weights.shape[1]):
            out[:, k] = np.bincount(self.rows, self.values * weights[self.columns, k], minlength=self.shape[0])
        return out


class Design:
    """Rows with a column of ones at the end, for products from both sides. Columns without an entry are left out."""

    def __init__(self, rows: SparseRows):
        n, self.width = rows.shape
        used, count = np.unique(rows.columns, return_counts=True)
        self.used = used
        place = np.zeros(self.width + 1, dtype=np.int64)
        place[used] = np.arange(len(used))
        columns = place[rows.columns]
        most = max(0, DENSE_BYTES // (4 * max(1, n)))
        order = np.argsort(-count, kind="stable")[:most]
        self.often = np.sort(order[count[order] >= max(2, DENSE_SHARE * n)])
        block = np.full(len(used) + 1, -1, dtype=np.int64)
        block[self.often] = np.arange(len(self.often))
        inside = block[columns] >= 0
        self.dense = np.zeros((n, len(self.often)), dtype=np.float32)
        np.add.at(self.dense, (rows.rows[inside], block[columns[inside]]), rows.values[inside].astype(np.float32))
        self.rows, self.columns, self.values = rows.rows[~inside], columns[~inside], rows.values[~inside]
        self.shape = n, len(used) + 1

    def times(self, w: np.ndarray) -> np.ndarray:
        out = (self.dense @ w[self.often].astype(np.float32)).astype(np.float64)
        for k in range(w.shape[1]):
            out[:, k] += np.bincount(self.rows, self.values * w[self.columns, k], minlength=self.shape[0])
        return out + w[-1]

    def back(self, r: np.ndarray) -> np.ndarray:
        out = np.empty((self.shape[1], r.shape[1]))
        for k in range(r.shape[1]):
            out[:, k] = np.bincount(self.columns, self.values * r[self.rows, k], minlength=self.shape[1])
        out[self.often] += self.dense.T @ r.astype(np.float32)
        out[-1] = r.sum(axis=0)
        return out

    def spread(self, w: np.ndarray) -> np.ndarray:
        """(k, width + 1) with zeros for unused columns and the intercept last."""
        out = np.zeros((w.shape[1], self.width + 1))
        out[:, self.used], out[:, -1] = w[:-1].T, w[-1]
        return out


class _Softmax:
    """Weighted cross-entropy of all classes at once; the intercepts are free."""

    def __init__(self, design: Design | Block, target: np.ndarray, weight: np.ndarray, c: float):
        self.design, self.target, self.weight = design, target, weight
        self.penalty = np.full((design.shape[1], 1), 1.0 / c)
        self.penalty[-1] = 0.0

    def dot(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.array([np.vdot(a, b)])

    def value(self, w: np.ndarray, z: np.ndarray) -> np.ndarray:
        top = z.max(axis=1, keepdims=True)
        logs = top[:, 0] + np.log(np.exp(z - top).sum(axis=1)) - (z * self.target).sum(axis=1)
        return np.array([self.weight @ logs + 0.5 * (self.penalty * w * w).sum()])

    def shares(self, z: np.ndarray) -> np.ndarray:
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def slope(self, w: np.ndarray, z: np.ndarray) -> np.ndarray:
        return self.design.back(self.weight[:, None] * (self.shares(z) - self.target)) + self.penalty * w

    def curve(self, z: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        p, weight = self.shares(z), self.weight[:, None]

        def product(v: np.ndarray) -> np.ndarray:
            u = p * self.design.times(v)
            return self.design.back(weight * (u - p * u.sum(axis=1, keepdims=True))) + self.penalty * v

        return product


class _SquaredHinge:
    """One machine per class against the rest, side by side; the intercept is penalised like a weight."""

    def __init__(self, design: Design | Block, sign: np.ndarray, weight: np.ndarray, c: float, penalty: float = 1.0):
        self.design, self.sign, self.weight, self.penalty = design, sign, 2.0 * c * weight, penalty

    def dot(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->j", a, b)

    def value(self, w: np.ndarray, z: np.ndarray) -> np.ndarray:
        short = np.maximum(0.0, 1.0 - self.sign * z)
        return 0.5 * self.penalty * (w * w).sum(axis=0) + 0.5 * (self.weight * short * short).sum(axis=0)

    def slope(self, w: np.ndarray, z: np.ndarray) -> np.ndarray:
        short = np.maximum(0.0, 1.0 - self.sign * z)
        return self.penalty * w - self.design.back(self.weight * self.sign * short)

    def curve(self, z: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        active = self.weight * (1.0 - self.sign * z > 0)

        def product(v: np.ndarray) -> np.ndarray:
            return self.penalty * v + self.design.back(active * self.design.times(v))

        return product


def _conjugate(curve, gradient, dot, goal: np.ndarray, steps: int = 250) -> np.ndarray:
    """A step that solves curve(step) = -gradient up to a residual of ``goal``, for each problem on its own."""
    step = np.zeros_like(gradient)
    left = -gradient
    way = left.copy()
    size = dot(left, left)
    for _ in range(steps):
        open_ = np.sqrt(size) > goal
        if not open_.any():
            break
        bent = curve(way)
        rate = np.where(open_, size / np.maximum(dot(way, bent), 1e-300), 0.0)
        step += rate * way
        left = left - rate * bent
        new = dot(left, left)
        way = np.where(open_, left + np.where(open_, new / np.maximum(size, 1e-300), 0.0) * way, way)
        size = np.where(open_, new, size)
    return step


def newton(problem, columns: int, tolerance: float, max_iter: int) -> np.ndarray:
    """The minimum, up to a gradient of ``tolerance`` times the first one."""
    design = problem.design
    w = np.zeros((design.shape[1], columns))
    z = design.times(w)
    first = None
    for _ in range(max_iter):
        gradient = problem.slope(w, z)
        norm = np.sqrt(problem.dot(gradient, gradient))
        first = np.maximum(norm, 1e-300) if first is None else first
        if (norm <= tolerance * first).all():
            break
        goal = np.where(norm <= tolerance * first, np.inf, np.minimum(0.1, np.sqrt(norm / first)) * norm)
        step = _conjugate(problem.curve(z), gradient, problem.dot, goal)
        ahead = design.times(step)
        value, falls = problem.value(w, z), problem.dot(gradient, step)
        length = np.ones_like(value)
        for _ in range(40):
            good = problem.value(w + length * step, z + length * ahead) <= value + 1e-4 * length * falls + 1e-12 * np.abs(value)
            if good.all():
                break
            length = np.where(good, length, length / 2)
        w, z = w + length * step, z + length * ahead
    return w


def balanced_by(count: np.ndarray) -> np.ndarray:
    """Rows / (present classes x rows of the class), from the rows by class; 1 for an absent one."""
    return np.where(count > 0, count.sum() / (np.maximum(1, count) * max(1, (count > 0).sum())), 1.0)


def balanced(labels: np.ndarray, classes: int) -> np.ndarray:
    """The same from the labels."""
    return balanced_by(np.bincount(labels, minlength=classes).astype(float))


#: The intercept of a class that no training row has: its share is 0.
ABSENT = -1e9


def fit_softmax(rows: SparseRows, labels: np.ndarray, classes: int, c: float, tolerance: float, max_iter: int) -> np.ndarray:
    """(classes, width + 1): weights and intercept of a multinomial logistic regression with balanced classes."""
    out = np.zeros((classes, rows.shape[1] + 1))
    known = np.flatnonzero(np.bincount(labels, minlength=classes))
    if len(known):
        design = Design(rows)
        target = (labels[:, None] == known).astype(float)
        problem = _Softmax(design, target, balanced(labels, classes)[labels], c)
        out[:, -1] = ABSENT
        out[known] = design.spread(newton(problem, len(known), tolerance, max_iter))
    return out


def fit_hinge(rows: SparseRows, labels: np.ndarray, classes: int, c: float, tolerance: float, max_iter: int) -> np.ndarray:
    """(classes, width + 1): a linear SVM per class against the rest, rows of the class with its balanced weight."""
    mine = labels[:, None] == np.arange(classes)
    weight = np.where(mine, balanced(labels, classes), 1.0)
    design = Design(rows)
    problem = _SquaredHinge(design, np.where(mine, 1.0, -1.0), weight, c)
    return design.spread(newton(problem, classes, tolerance, max_iter))


def fit_sigmoid(margin: np.ndarray, hit: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the sigmoid that best maps margins to the class; targets are pulled in from 0 and 1."""
    yes, no = hit.sum(), (~hit).sum()
    target = np.where(hit, (yes + 1.0) / (yes + 2.0), 1.0 / (no + 2.0))
    a, b = 0.0, float(np.log((yes + 1.0) / (no + 1.0)))

    def loss(a: float, b: float) -> float:
        z = a * margin + b
        return float((np.logaddexp(0, z) - target * z).sum())

    for _ in range(100):
        p = 1.0 / (1.0 + np.exp(-np.clip(a * margin + b, -500, 500)))
        r, q = p - target, p * (1.0 - p)
        ga, gb = (r * margin).sum(), r.sum()
        if abs(ga) < 1e-7 and abs(gb) < 1e-7:
            break
        haa, hab, hbb = (q * margin * margin).sum() + 1e-12, (q * margin).sum(), q.sum() + 1e-12
        det = haa * hbb - hab * hab
        da, db = -(hbb * ga - hab * gb) / det, -(haa * gb - hab * ga) / det
        step, now = 1.0, loss(a, b)
        while step > 1e-10 and loss(a + step * da, b + step * db) > now + 1e-4 * step * (ga * da + gb * db):
            step /= 2
        if step <= 1e-10:
            break
        a, b = a + step * da, b + step * db
    return a, b


def packed(table: pa.Table) -> tuple[np.ndarray, SparseRows]:
    """Labels and rows of a table with label, size, indices and values."""
    labels = table.column("label").to_numpy().astype(np.int64)
    sizes = table.column("size").drop_null().to_numpy()
    indices, values = table.column("indices").combine_chunks(), table.column("values").combine_chunks()
    width = int(sizes.max(initial=0)) or None  # dense vectors have no size
    return labels, SparseRows.from_lists(indices, values, width)


def in_one_task(df: DataFrame, run: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """The result of ``run`` on all rows of a table; nothing where there are none."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [batch for batch in batches if batch.num_rows]
        if own:
            yield from run(pa.Table.from_batches(own)).to_batches()

    return df.repartition(1).mapInArrow(whole, schema)


_BLOCK = "labels binary, folds binary, sizes binary, columns binary, values binary"


@dataclass
class Block:
    """Some whole rows, for products from both sides as a ``Design`` gives them; no column is left out."""

    labels: np.ndarray
    folds: np.ndarray
    sizes: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    @classmethod
    def of(cls, stored: tuple[bytes, ...], width: int) -> Block:
        kinds = [np.int8, np.int32, np.int32, np.int32, np.float64]
        parts = [np.frombuffer(part, kind) for part, kind in zip(stored, kinds)]
        return cls(parts[0].astype(np.int64), parts[1], parts[2], parts[3].astype(np.int64), parts[4], width)

    @property
    def shape(self) -> tuple[int, int]:
        return len(self.labels), self.width + 1

    @cached_property
    def filled(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows with entries, and where these begin."""
        rows = np.flatnonzero(self.sizes)
        return rows, (np.cumsum(self.sizes, dtype=np.int64) - self.sizes)[rows]

    def per_row(self, each: np.ndarray) -> np.ndarray:
        """Sums of what each entry has, by row."""
        out = np.zeros(len(self.sizes))
        rows, starts = self.filled
        if len(rows):
            out[rows] = np.add.reduceat(each, starts)
        return out

    def times(self, w: np.ndarray) -> np.ndarray:
        by_column = np.ascontiguousarray(w[:-1].T)
        return np.stack([self.per_row(self.values * own[self.columns]) for own in by_column], axis=1) + w[-1]

    def back(self, r: np.ndarray) -> np.ndarray:
        out = np.empty((self.width + 1, r.shape[1]))
        for k, own in enumerate(np.ascontiguousarray(r.T)):
            out[:-1, k] = np.bincount(self.columns, self.values * np.repeat(own, self.sizes), minlength=self.width)
        out[-1] = r.sum(axis=0)
        return out


def pack(rows: SparseRows, labels: np.ndarray, folds: np.ndarray) -> pa.RecordBatch:
    """Rows in blocks of about ``BLOCK_ENTRIES`` entries."""
    sizes = np.bincount(rows.rows, minlength=rows.shape[0]).astype(np.int32)
    ends = np.cumsum(sizes, dtype=np.int64)
    blocks, at = [], 0
    while at < len(sizes):
        before = int(ends[at - 1]) if at else 0
        # A row without entries counts as one, so that a block of such rows ends too.
        to = max(at + 1, min(int(np.searchsorted(ends, before + BLOCK_ENTRIES, side="right")), at + BLOCK_ENTRIES))
        own = slice(before, int(ends[to - 1]))
        parts = (labels[at:to].astype(np.int8), folds[at:to].astype(np.int32), sizes[at:to])
        blocks.append([x.tobytes() for x in (*parts, rows.columns[own].astype(np.int32), rows.values[own].astype(np.float64))])
        at = to
    names = [part.split()[0] for part in _BLOCK.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()) for c in zip(*blocks)], names=names)


class Blocks:
    """All rows of a fit in blocks, kept on the disks of the executors, and sums over them."""

    def __init__(self, stored: RDD, width: int):
        """``stored`` has blocks as ``pack`` makes them."""
        self.kept, self.width = stored.persist(StorageLevel.DISK_ONLY), width

    @classmethod
    def of(cls, df: DataFrame, width: int, fold: str | None = None) -> Blocks:
        """Of a table with label, size, indices and values."""

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    labels, rows = packed(pa.Table.from_batches([batch]))
                    folds = batch.column(fold).fill_null(-1).to_numpy() if fold else np.full(len(labels), -1)
                    yield pack(rows, labels, folds)

        return cls(df.mapInArrow(whole, _BLOCK).rdd.map(tuple), width)

    def __enter__(self) -> Blocks:
        return self

    def __exit__(self, *_) -> None:
        self.kept.unpersist()

    def sums(self, size: int, part: Callable[..., np.ndarray], *shared) -> np.ndarray:
        """The sum of ``part(block, *shared)``, a vector of ``size`` numbers, over all blocks."""
        width, sent = self.width, self.kept.context.broadcast(shared)

        def of_blocks(stored: Iterator[tuple[bytes, ...]]) -> Iterator[np.ndarray]:
            total = np.zeros(size)
            for own in stored:
                total += part(Block.of(own, width), *sent.value)
            yield total

        parts = self.kept.mapPartitions(of_blocks)
        tasks = parts.getNumPartitions()
        while tasks > FAN:
            tasks = math.ceil(tasks / FAN)
            numbered = parts.mapPartitionsWithIndex(lambda i, own, n=tasks: ((i % n, x) for x in own))
            parts = numbered.reduceByKey(np.add, tasks).values()
        total = sum(parts.collect(), np.zeros(size))
        sent.destroy()
        return total


def newton_in_blocks(
    blocks: Blocks, problem: Callable[[Block], _Softmax | _SquaredHinge], columns: int, penalty: np.ndarray, joint: bool, tolerance: float, max_iter: int
) -> np.ndarray:
    """What ``newton`` finds, from sums over the blocks.

    ``problem`` is that of one block, without the penalty, which is given by row of the coefficients; with ``joint`` all
    columns are one problem, else each is its own. A pass over the blocks gives the value and the slope behind a step, and
    another one tries shorter steps where that was too long.
    """
    shape = (len(penalty), columns)
    values = 1 if joint else columns
    penalty = penalty[:, None]
    size = shape[0] * columns

    def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.array([np.vdot(a, b)]) if joint else np.einsum("ij,ij->j", a, b)

    def rise(block: Block, w: np.ndarray) -> np.ndarray:
        own = problem(block)
        z = own.design.times(w)
        return np.concatenate([own.value(w, z), own.slope(w, z).ravel()])

    def bend(block: Block, w: np.ndarray, v: np.ndarray) -> np.ndarray:
        own = problem(block)
        return own.curve(own.design.times(w))(v).ravel()

    def tried(block: Block, w: np.ndarray, step: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        own = problem(block)
        z, ahead = own.design.times(w), own.design.times(step)
        return np.concatenate([own.value(w + length * step, z + length * ahead) for length in lengths])

    def at(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        got = blocks.sums(values + size, rise, w)
        return got[:values] + 0.5 * dot(penalty * w, w), got[values:].reshape(shape) + penalty * w

    w = np.zeros(shape)
    value, gradient = at(w)
    first = None
    for _ in range(max_iter):
        norm = np.sqrt(dot(gradient, gradient))
        first = np.maximum(norm, 1e-300) if first is None else first
        if (norm <= tolerance * first).all():
            break
        goal = np.where(norm <= tolerance * first, np.inf, np.minimum(0.1, np.sqrt(norm / first)) * norm)
        curve = lambda v: blocks.sums(size, bend, w, v).reshape(shape) + penalty * v  # noqa: B023, E731
        step = _conjugate(curve, gradient, dot, goal)
        falls = dot(gradient, step)
        new = w + step
        new_value, new_gradient = at(new)

        def falls_enough(found: np.ndarray, length: np.ndarray) -> np.ndarray:
            return found <= value + 1e-4 * length * falls + 1e-12 * np.abs(value)  # noqa: B023

        if not falls_enough(new_value, np.ones(values)).all():
            lengths = 0.5 ** np.arange(41)
            found = blocks.sums(len(lengths) * values, tried, w, step, lengths).reshape(len(lengths), values)
            found += np.array([0.5 * dot(penalty * (w + length * step), w + length * step) for length in lengths])
            good = falls_enough(found, lengths[:, None])
            good[-1] = True
            new = w + lengths[good.argmax(axis=0)] * step
            new_value, new_gradient = at(new)
        w, value, gradient = new, new_value, new_gradient
    return w


def softmax_in_blocks(blocks: Blocks, classes: int, c: float, tolerance: float, max_iter: int) -> np.ndarray:
    """``fit_softmax`` over all rows of the blocks."""
    count = blocks.sums(classes, lambda block: np.bincount(block.labels, minlength=classes).astype(float))
    out = np.zeros((classes, blocks.width + 1))
    known = np.flatnonzero(count)
    if len(known):
        weight = balanced_by(count)

        def problem(block: Block) -> _Softmax:
            return _Softmax(block, (block.labels[:, None] == known).astype(float), weight[block.labels], np.inf)

        penalty = np.append(np.full(blocks.width, 1.0 / c), 0.0)
        out[:, -1] = ABSENT
        out[known] = newton_in_blocks(blocks, problem, len(known), penalty, True, tolerance, max_iter).T
    return out


def hinge_in_blocks(
    blocks: Blocks,
    held: list[int | None],
    classes: int,
    c: float,
    tolerance: float,
    max_iter: int,
    ready: Callable[[Block], Block] = lambda block: block,
    width: int | None = None,
) -> np.ndarray:
    """``fit_hinge`` over all rows of the blocks but those of a fold (None: all), for each fold in ``held``.

    (folds * classes, width + 1). ``ready`` makes of a stored block the one with the vectors, of ``width``.
    """
    width = blocks.width if width is None else width

    def count(block: Block) -> np.ndarray:
        return np.concatenate([np.bincount(block.labels[block.folds != f], minlength=classes) for f in (-2 if f is None else f for f in held)])

    counts = blocks.sums(len(held) * classes, lambda block: count(block).astype(float)).reshape(len(held), classes)
    weights = [balanced_by(own) for own in counts]

    def problem(block: Block) -> _SquaredHinge:
        mine = block.labels[:, None] == np.arange(classes)
        each = [np.where(mine, own, 1.0) * (block.folds != (-2 if f is None else f))[:, None] for f, own in zip(held, weights)]
        return _SquaredHinge(ready(block), np.tile(np.where(mine, 1.0, -1.0), len(held)), np.concatenate(each, axis=1), c, 0.0)

    return newton_in_blocks(blocks, problem, len(held) * classes, np.ones(width + 1), False, tolerance, max_iter).T


def sigmoids_in_blocks(blocks: Blocks, weights: np.ndarray, folds: int, classes: int) -> np.ndarray:
    """``fit_sigmoid`` for each fold and class from the margins of the rows of the fold: slopes and offsets, (2, folds * classes)."""
    size = folds * classes

    def held(block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Whether a row counts for a model, and whether it is of the class."""
        own = np.repeat(block.folds[:, None] == np.arange(folds), classes, axis=1)
        return own, np.tile(block.labels[:, None] == np.arange(classes), folds)

    def counted(block: Block) -> np.ndarray:
        own, hit = held(block)
        return np.concatenate([(own & hit).sum(axis=0), (own & ~hit).sum(axis=0)]).astype(float)

    yes, no = blocks.sums(2 * size, counted).reshape(2, size)
    width, sent = blocks.width, blocks.kept.context.broadcast(weights.T)

    def margins(stored: tuple[bytes, ...]) -> tuple[bytes, ...]:
        """A block with the margins of each row, by the models of its fold, in place of its vector."""
        block = Block.of(stored, width)
        each = block.times(sent.value).reshape(len(block.labels), folds, classes)
        own = each[np.arange(len(each)), np.clip(block.folds, 0, folds - 1)]
        return (*stored[:2], b"", b"", own.tobytes())

    def parts(block: Block, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        own, hit = held(block)
        margin = np.tile(block.values.reshape(-1, classes), folds)
        target = np.where(hit, (yes + 1.0) / (yes + 2.0), 1.0 / (no + 2.0))
        z = a * margin + b
        p = 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))
        r, q = p - target, p * (1.0 - p)
        each = [np.logaddexp(0, z) - target * z, r * margin, r, q * margin * margin, q * margin, q]
        return np.concatenate([np.where(own, x, 0.0).sum(axis=0) for x in each])

    with Blocks(blocks.kept.map(margins), 0) as slim:
        return _sigmoids(lambda a, b: slim.sums(6 * size, parts, a, b).reshape(6, size), yes, no)


def _sigmoids(at: Callable[[np.ndarray, np.ndarray], np.ndarray], yes: np.ndarray, no: np.ndarray) -> np.ndarray:
    """The steps of ``fit_sigmoid`` for many models; ``at`` gives loss, gradient and curvature of slopes and offsets."""
    size = len(yes)
    a, b = np.zeros(size), np.log((yes + 1.0) / (no + 1.0))
    now = at(a, b)
    open_ = np.ones(size, dtype=bool)
    for _ in range(100):
        loss, ga, gb, haa, hab, hbb = now
        open_ &= (np.abs(ga) >= 1e-7) | (np.abs(gb) >= 1e-7)
        if not open_.any():
            break
        haa, hbb = haa + 1e-12, hbb + 1e-12
        det = haa * hbb - hab * hab
        # What has come to rest stays, whatever its curvature.
        da, db = (np.where(open_, -d / np.where(open_, det, 1.0), 0.0) for d in (hbb * ga - hab * gb, haa * gb - hab * ga))
        step = np.where(open_, 1.0, 0.0)
        while True:
            new = at(a + step * da, b + step * db)
            short = open_ & (step > 1e-10) & (new[0] > loss + 1e-4 * step * (ga * da + gb * db))
            if not short.any():
                break
            step = np.where(short, step / 2, step)
        open_ &= step > 1e-10
        step = np.where(step > 1e-10, step, 0.0)
        a, b, now = a + step * da, b + step * db, np.where(step > 0, new, now)
    return np.stack([a, b])


class _Writer(MLWriter):
    def __init__(self, instance: LinearScores):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        rows = [(i, row.tolist()) for i, row in enumerate(self.instance.weights)]
        self.sparkSession.createDataFrame(rows, "number int, weights array<double>").coalesce(1).write.parquet(f"{path}/weights")


class _Reader(MLReader):
    def load(self, path: str) -> LinearScores:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        instance = LinearScores()
        instance._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(instance, metadata)
        rows = self.sparkSession.read.parquet(f"{path}/weights").orderBy("number").collect()
        instance.weights = np.array([r["weights"] for r in rows])
        return instance


class LinearScores(Transformer, HasInputCol, HasOutputCol, MLReadable, MLWritable):
    """Class scores from the weights of linear models, and the class with the largest.

    ``link`` says what becomes of the products: ``softmax`` (shares of the classes), ``margin`` (as they are), or
    ``sigmoids``: several groups of one model per class, each product through its own sigmoid, scaled to sum 1
    within its group, then averaged over the groups. Vectors may be sparse or dense.
    """

    link = Param(Params._dummy(), "link", "softmax, margin or sigmoids", TypeConverters.toString)
    classes = Param(Params._dummy(), "classes", "number of classes", TypeConverters.toInt)
    slopes = Param(Params._dummy(), "slopes", "of the sigmoids, by model", TypeConverters.toListFloat)
    offsets = Param(Params._dummy(), "offsets", "of the sigmoids, by model", TypeConverters.toListFloat)

    @keyword_only
    def __init__(
        self,
        *,
        inputCol: str = "features",
        outputCol: str = "scores",
        link: str = "margin",
        classes: int = 3,
        slopes: list[float] | None = None,
        offsets: list[float] | None = None,
    ):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="scores", link="margin", classes=3, slopes=[], offsets=[])
        self._set(**self._input_kwargs)
        self.weights = np.zeros((0, 1))

    def of(self, weights: np.ndarray) -> LinearScores:
        """With weights of the models, a row each and the intercept last."""
        self.weights = weights
        return self

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()

    def linked(self, product: np.ndarray) -> np.ndarray:
        link, classes = self.getOrDefault(self.link), self.getOrDefault(self.classes)
        if link == "margin":
            return product
        if link == "softmax":
            share = np.exp(product - product.max(axis=1, keepdims=True))
            return share / share.sum(axis=1, keepdims=True)
        slopes, offsets = (np.array(self.getOrDefault(p)) for p in (self.slopes, self.offsets))
        each = 1.0 / (1.0 + np.exp(-np.clip(product * slopes + offsets, -500, 500)))
        each = each.reshape(len(product), -1, classes)
        total = each.sum(axis=2, keepdims=True)
        return np.where(total > 0, each / np.where(total > 0, total, 1.0), 1.0 / classes).mean(axis=1)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        weights = np.ascontiguousarray(self.weights[:, :-1].T), self.weights[:, -1]
        linked = self.linked

        @F.arrow_udf("array<double>")
        def score(indices: pa.Array, values: pa.Array) -> pa.Array:
            rows = SparseRows.from_lists(indices, values, len(weights[0]))
            got = linked(rows.times(weights[0]) + weights[1])
            offsets = np.arange(0, got.size + 1, got.shape[1], dtype=np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(got.ravel()))

        _, indices, values = entries(self.getInputCol())
        # Not deterministic for Spark, so that it is not repeated for each use of the scores.
        scored = dataset.withColumn(self.getOutputCol(), score.asNondeterministic()(indices, values))
        return scored.withColumn("prediction", row_argmax(F.col(self.getOutputCol())).cast("double"))
