"""Counts of terms by messages: a row holds what many rows of terms have for one bucket of all terms.

A task takes rows until they have ``TOGETHER`` terms (a slice), counts within the slice, and sends each bucket of a
digest of the term one message: the distinct terms, one after the other, and their counts as packed numbers. A
bucket adds up its messages. So a distinct term of a slice is moved once, no task holds more than a slice or a bucket,
and a very frequent term is one entry of each slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.session import cut_lineage

#: Terms of a slice, rows of the table for each bucket, and the most rows of an Arrow batch that a task gives back.
TOGETHER, BUCKET_ROWS, OUT_ROWS = 800_000, 2_048, 50_000


def buckets(rows: int) -> int:
    """The number of buckets for a table of so many rows."""
    return max(16, rows // BUCKET_ROWS)


def packed_numbers(x: np.ndarray) -> bytes:
    """Whole numbers below 2^32; their low bytes, then the next ones, ..., which compresses well."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def numbers(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


def _parts(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of strings without nulls, one after the other, and where each begins and the last one ends."""
    ends = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1]
    if not len(strings) or strings.buffers()[2] is None:
        return np.empty(0, np.uint8), np.zeros(len(strings) + 1, np.int64)
    return np.frombuffer(strings.buffers()[2], np.uint8)[ends[0] : ends[-1]], ends.astype(np.int64) - ends[0]


def _strings(texts: list[bytes], sizes: list[bytes]) -> pa.Array:
    """The strings of messages, one message after the other."""
    ends = np.cumsum(np.concatenate([[0], *map(numbers, sizes)])).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(b"".join(texts)))


def _bucket(strings: pa.Array, count: int) -> np.ndarray:
    """The bucket of each string, by a polynomial in its bytes."""
    data, ends = _parts(strings)
    sizes = np.diff(ends)
    place = np.arange(len(data)) - np.repeat(ends[:-1], sizes)
    powers = np.cumprod(np.full(int(sizes.max(initial=0)) + 1, 0x9E3779B97F4A7C15, np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[place])])
    digest = sums[ends[1:]] - sums[ends[:-1]]
    digest = (digest ^ (digest >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return ((digest >> np.uint64(32)) % np.uint64(count)).astype(np.int64)


class Slice:
    """Rows of terms: the distinct terms in the order of their buckets, and of each term its row and its place there."""

    def __init__(self, terms: pa.Array, count: int):
        offsets = terms.offsets.to_numpy().astype(np.int64)
        sizes = np.where(np.asarray(terms.is_valid()), np.diff(offsets), 0)
        flat = terms.flatten()
        coded = flat.dictionary_encode()
        self.rows = np.repeat(np.arange(len(terms), dtype=np.int32), sizes)
        #: Which of the entries are terms.
        self.real = np.asarray(flat.is_valid())
        code = coded.indices.fill_null(0).to_numpy(zero_copy_only=False)[self.real]
        bucket = _bucket(coded.dictionary, count)
        order = np.argsort(bucket, kind="stable")
        self.terms = coded.dictionary.take(pa.array(order))
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        self.rows, self.places = self.rows[self.real], place[code]
        #: The buckets that have terms, and where the terms of each begin and those of the last one end.
        self.buckets, starts = np.unique(bucket[order], return_index=True)
        self.starts = np.append(starts, len(order))
        self._data, self._ends = _parts(self.terms)

    def by_row(self, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, place and count of every distinct term of each row; an entry counts ``n`` times."""
        width = max(1, len(self.terms))
        cells = self.rows.astype(np.int64) * width + self.places
        if n is None:
            cells, counts = np.unique(cells, return_counts=True)
        else:
            cells, at = np.unique(cells, return_inverse=True)
            counts = np.bincount(at, n, minlength=len(cells)).astype(np.int64)
        return cells // width, cells % width, counts

    def message(self, i: int) -> tuple[slice, bytes, bytes]:
        """Of a bucket: the places of its terms, their bytes and sizes."""
        own = slice(self.starts[i], self.starts[i + 1])
        ends = self._ends[self.starts[i] : self.starts[i + 1] + 1]
        return own, self._data[ends[0] : ends[-1]].tobytes(), packed_numbers(np.diff(ends))


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch until they have ``TOGETHER`` terms, one row at least."""
    ends = np.cumsum(np.diff(batch.column(column).offsets.to_numpy()))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + TOGETHER, side="right")))
        yield batch.slice(at, to - at)
        at = to


def _pieces(table: pa.Table) -> pa.Table:
    """The same rows in Arrow batches of bounded size."""
    return pa.Table.from_batches(table.to_batches(OUT_ROWS), table.schema)


_TALLY = "bucket long, names array<string>, texts binary, sizes binary, places binary, groups binary, n binary, df binary"


def term_tallies(df: DataFrame, terms: Column, rows: int, by: Column | None = None) -> DataFrame:
    """Rows of ``term``, its count ``n`` and the rows ``df`` that have it; with ``by`` for each value of it, as ``name`` (a string).

    ``terms`` is an array of strings, of which nulls do not count; ``rows`` is the number of rows of ``df``.
    """
    count = buckets(rows)
    name = F.lit("") if by is None else by.cast("string")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 1):
                own = Slice(part.column(1), count)
                row, place, n = own.by_row()
                named = part.column(0).dictionary_encode()
                groups = max(1, len(named.dictionary))
                cell = place * groups + named.indices.to_numpy(zero_copy_only=False)[row]
                cells, at = np.unique(cell, return_inverse=True)
                place, group = cells // groups, cells % groups
                total, having = np.bincount(at, n, minlength=len(cells)), np.bincount(at, minlength=len(cells))
                cuts = np.searchsorted(place, own.starts)
                found = []
                for i, bucket in enumerate(own.buckets.tolist()):
                    inside, texts, sizes = own.message(i)
                    e = slice(cuts[i], cuts[i + 1])
                    packed = (packed_numbers(x) for x in (place[e] - inside.start, group[e], total[e], having[e]))
                    found.append((bucket, named.dictionary.to_pylist(), texts, sizes, *packed))
                if found:
                    kinds = [pa.int64(), pa.list_(pa.string()), *[pa.binary()] * 6]
                    columns = [pa.array(x, kind) for x, kind in zip(zip(*found), kinds)]
                    yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _TALLY.split(", ")])

    def add(table: pa.Table) -> pa.Table:
        lists = {c: table.column(c).to_pylist() for c in table.column_names if c != "bucket"}
        strings = _strings(lists["texts"], lists["sizes"]).dictionary_encode()
        number = strings.indices.to_numpy().astype(np.int64)
        known: dict[str, int] = {}
        terms, groups, at = [], [], 0
        for names, sizes, places, own in zip(lists["names"], lists["sizes"], lists["places"], lists["groups"]):
            to_all = np.array([known.setdefault(x, len(known)) for x in names], dtype=np.int64)
            terms.append(number[at + numbers(places)])
            groups.append(to_all[numbers(own)])
            at += len(sizes) // 4
        cell = np.concatenate(terms) * len(known) + np.concatenate(groups)
        cells, at = np.unique(cell, return_inverse=True)
        sums = [np.bincount(at, np.concatenate(list(map(numbers, lists[c])))).astype(np.int64) for c in ("n", "df")]
        out = {
            "name": pa.array(list(known), pa.string()).take(pa.array(cells % len(known))),
            "term": strings.dictionary.take(pa.array(cells // len(known))).cast(pa.string()),
            "n": pa.array(sums[0]),
            "df": pa.array(sums[1]),
        }
        return _pieces(pa.table(out))

    messages = df.select(name.alias("name"), terms.alias("terms")).mapInArrow(tally, _TALLY)
    added = messages.groupBy("bucket").applyInArrow(add, "name string, term string, n long, df long")
    return added.drop("name") if by is None else added


_MESSAGE = "bucket long, chunk long, start long, texts binary, sizes binary, df binary"


def counted_rows(df: DataFrame, terms: str, row_id: str) -> DataFrame:
    """(row_id, terms, ns): the terms of each key, with their counts where a key has several rows (else every entry is one)."""
    alone = df.select(row_id, terms, F.lit(None).cast("array<long>").alias("ns"))
    keys = cut_lineage(df.groupBy(row_id).agg(F.count("*").alias("_n")).where("_n > 1").select(F.col(row_id).alias("_key")))
    if keys.isEmpty():
        return alone
    same = F.col(row_id).eqNullSafe(F.col("_key"))
    repeated = df.select(row_id, F.explode(terms).alias("_t")).join(keys, same, "left_semi")
    counted = repeated.groupBy(row_id, "_t").agg(F.count("*").alias("_n"))
    lists = counted.groupBy(row_id).agg(F.collect_list(F.struct("_t", "_n")).alias("_c"))
    merged = lists.select(row_id, F.col("_c._t").alias(terms), F.col("_c._n").alias("ns"))
    return alone.join(keys, same, "left_anti").unionByName(merged)


def rows_with_frequency(df: DataFrame, rows: int, least: float, most: float, schema: str, make, row_id: str) -> DataFrame:
    """``make`` of every slice of ``counted_rows``, with the rows that have each term, for terms in ``least`` to ``most`` rows.

    A slice asks each bucket by a message that brings the counts of the slice as well; the bucket adds them up and
    answers with the terms within the limits. Then ``make(rows, ids, terms, n, df)`` gives the Arrow table of the slice.
    """
    count = buckets(rows)
    kind = df.schema[row_id].dataType
    stored = f"{_MESSAGE}, ids array<{kind.simpleString()}>, row binary, place binary, n binary"
    names = [c.split()[0] for c in _MESSAGE.split(", ")] + ["ids", "row", "place", "n"]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in _slices(batch, 1):
                own = Slice(part.column(1), count)
                ns = part.column(2)
                each = None
                if ns.null_count < len(ns):
                    each = np.ones(len(own.real), np.int64)
                    known = np.repeat(np.asarray(ns.is_valid()), np.diff(part.column(1).offsets.to_numpy()))
                    each[known] = ns.flatten().to_numpy(zero_copy_only=False)
                    each = each[own.real]
                row, place, n = own.by_row(each)
                having = np.bincount(place, minlength=len(own.terms))
                found = []
                for i, bucket in enumerate(own.buckets.tolist()):
                    inside, texts, sizes = own.message(i)
                    found.append((bucket, chunk, inside.start, texts, sizes, packed_numbers(having[inside]), None, None, None, None))
                ids = part.column(0)
                sizes = np.bincount(row, minlength=len(ids))  # the terms of a row stand together
                packed = (packed_numbers(x) for x in (sizes, place, n))
                found.append((-1, chunk, None, None, None, None, None, *packed))
                kinds = [pa.int64()] * 3 + [pa.binary()] * 3
                columns = [pa.array(x, k) for x, k in zip(list(zip(*found))[:6], kinds)]
                ends = np.zeros(len(found) + 1, np.int32)
                ends[-1] = len(ids)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), ids))
                columns += [pa.array(x, pa.binary()) for x in list(zip(*found))[7:]]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                chunk += 1

    def answer(table: pa.Table) -> pa.Table:
        texts, sizes, dfs = (table.column(c).to_pylist() for c in ("texts", "sizes", "df"))
        strings = _strings(texts, sizes).dictionary_encode()
        number = strings.indices.to_numpy().astype(np.int64)
        total = np.bincount(number, np.concatenate(list(map(numbers, dfs)))).astype(np.int64)
        used = (total >= least) & (total <= most)
        out, at = [], 0
        for chunk, start, own, width in zip(*(table.column(c).to_pylist() for c in ("chunk", "start", "texts", "sizes"))):
            size = numbers(width)
            codes = number[at : at + len(size)]
            at += len(size)
            keep = used[codes]
            if keep.any():
                kept = np.frombuffer(own, np.uint8)[np.repeat(keep, size)].tobytes()
                places = np.flatnonzero(keep) + start
                out.append((chunk, packed_numbers(places), kept, packed_numbers(size[keep]), packed_numbers(total[codes[keep]])))
        kinds = [pa.int64(), *[pa.binary()] * 4]
        columns = zip(*out) if out else [[]] * 5
        return pa.table({c: pa.array(x, k) for c, x, k in zip(("chunk", "places", "texts", "sizes", "df"), columns, kinds)})

    def weigh(own: pa.Table, answers: pa.Table) -> pa.Table:
        places, texts, sizes, dfs = (answers.column(c).to_pylist() for c in ("places", "texts", "sizes", "df"))
        strings = _strings(texts, sizes)
        place, n = (numbers(own.column(c)[0].as_py()) for c in ("place", "n"))
        ids = own.column("ids").combine_chunks().flatten()
        row = np.repeat(np.arange(len(ids)), numbers(own.column("row")[0].as_py()))
        at = np.full(int(place.max(initial=-1)) + 1, -1)
        df = np.concatenate([np.empty(0, np.int64), *map(numbers, dfs)])
        if len(df):
            at[np.concatenate(list(map(numbers, places)))] = np.arange(len(df))
        keep = at[place] >= 0
        row, n, at = row[keep], n[keep], at[place[keep]]
        return _pieces(make(row, ids, strings.take(pa.array(at)).cast(pa.string()), n, df[at]))

    slices = cut_lineage(df.mapInArrow(ask, stored))
    asked = slices.where("bucket >= 0").select(*names[:6])
    answers = asked.groupBy("bucket").applyInArrow(answer, "chunk long, places binary, texts binary, sizes binary, df binary")
    own = slices.where("bucket < 0").select("chunk", *names[6:])
    return own.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(weigh, schema)
