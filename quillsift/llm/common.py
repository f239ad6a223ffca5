"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillsift.session import scratch_path
from quillsift.sources.tables import table

__all__ = [
    "PACKED",
    "batch_texts",
    "cut_lineage",
    "differences",
    "from_differences",
    "own_columns",
    "pack_slices",
    "recorded",
    "release",
    "scratch_path",
    "slices",
    "table",
    "tidied",
    "trim",
    "unpack_slices",
]


_scopes: list[list[str]] = []


@contextmanager
def recorded(paths: list[str]) -> Iterator[None]:
    """Note the tables that ``cut_lineage`` writes meanwhile, for ``release``."""
    _scopes.append(paths)
    try:
        yield
    finally:
        _scopes.pop()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, "llm")
    df.write.parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Remove recorded tables; results that read them must be written by then."""
    while paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def trim() -> None:
    """Give memory that this Python worker has freed back to the machine; the worker lives on between tasks."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """A worker's function that ends with ``trim``."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return whole


def own_columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads, under fixed names; other columns cannot clash with its own."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def batch_texts(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """The texts of a column as Python strings, null as empty."""
    return [t or "" for t in column.to_pylist()]


def slices(sizes, limit: int):
    """Cut a run of sizes into (start, end) ranges of about ``limit`` in total; every range has a row at least."""
    start, end, total = 0, 0, 0
    for size in sizes:
        if end > start and total + size > limit:
            yield start, end
            start, total = end, 0
        total += size
        end += 1
    if start < end:
        yield start, end


#: Rows of ``pack_slices``: the number of a slice and some of its rows as one compressed table.
PACKED = "slice int, blob binary"


def pack_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each slice in a batch as one compressed table."""
    for batch in batches:
        number = batch.column(0).to_numpy()
        order = np.argsort(number, kind="stable")
        cuts = np.flatnonzero(np.diff(number[order])) + 1
        slices, blobs = [], []
        for rows in np.split(order, cuts) if len(order) else []:
            out = pa.BufferOutputStream()
            part = batch.take(pa.array(rows)).drop_columns(["slice"])
            with pa.ipc.new_stream(out, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(part)
            slices.append(number[rows[0]])
            blobs.append(out.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(slices, pa.int32()), pa.array(blobs, pa.binary())], names=["slice", "blob"])


def unpack_slices(table: pa.Table) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in table.column("blob").to_pylist()])


def differences(values: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as 48-bit differences; the first and any that does not fit are kept beside them."""
    gaps = np.diff(values, prepend=np.uint64(0))
    large = np.flatnonzero(gaps >> np.uint64(48))
    heads = np.concatenate([[len(large)], large, gaps[large].view(np.int64)]).astype("<i8")
    return heads.tobytes() + gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def from_differences(raw: bytes) -> np.ndarray:
    count = int(np.frombuffer(raw[:8], "<i8")[0])
    heads = np.frombuffer(raw[8 : 8 + 16 * count], "<i8")
    six = np.frombuffer(raw[8 + 16 * count :], np.uint8).reshape(-1, 6)
    gaps = np.zeros((len(six), 8), dtype=np.uint8)
    gaps[:, :6] = six
    gaps = gaps.view("<u8").ravel()
    gaps[heads[:count]] = heads[count:].view(np.uint64)
    return np.cumsum(gaps, dtype=np.uint64)
