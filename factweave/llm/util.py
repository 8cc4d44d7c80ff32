"""Shared helpers: written tables, batches of texts, and words over Arrow."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from factweave.plans.storage import shared_path
from factweave.plans.storage import ship as ship_package

#: Text bytes that Python code handles at once; a longer text makes a slice of its own.
SLICE_BYTES = 4 << 20
#: Rows of an Arrow batch, unless the session says otherwise: the JVM and the worker each hold a batch of whole texts.
ARROW_ROWS = 2000
#: White space that separates words: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"

#: glibc's malloc_trim, where there is one.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet into the shared folder and reads it back."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, and keeps Arrow batches small where the session leaves them at Spark's default."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    ship_package(spark)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts take about `limit` bytes, small ones put together; a text is never cut. At the end the worker gives its free memory back, since it
    lives on into later stages."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        n = pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(n.astype(np.int64))
        at = 0
        while at < b.num_rows:
            base = ends[at - 1] if at else 0
            to = int(np.searchsorted(ends, base + limit - size, side="right"))
            if to <= at and not held:
                to = at + 1
            if to > at:
                held.append(b.slice(at, to - at))
                size += int(ends[to - 1] - base)
                at = to
            if at < b.num_rows:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)
    held = []
    release()


def release() -> None:
    """Gives memory that Arrow and the C library hold unused back to the system."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of all texts in a row, and where each text's words start (one more entry than texts)."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    lists = pc.ascii_split_whitespace(texts)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten()
    offsets -= offsets[0]
    full = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        flat = flat.filter(pa.array(full))
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
    return flat, offsets


def coded(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Index of each word among the distinct words, and these."""
    d = flat.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False), d.dictionary


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values for each text, 0 for none; values may have more than one column."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), dtype=np.float64), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def binaries(rows: np.ndarray) -> pa.Array:
    """A binary value for each row of a two-dimensional array."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize if rows.ndim == 2 else rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(rows.tobytes())])


def ragged(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary value for each stretch data[offsets[i]:offsets[i+1]]; offsets start at 0."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * data.itemsize).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: two rounds of xor-shift and odd multiplication."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))
