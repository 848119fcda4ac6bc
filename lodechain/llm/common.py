"""Helpers that the corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of the first input that a Python worker takes at once.
AT_ONCE = 4 << 20


def runs(column: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``size`` bytes of a string or binary column each, in order; one row at least."""
    ends, lo = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 16), 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, "right")))
        yield lo, hi
        lo = hi


def trim() -> None:
    """Give memory that a task no longer needs back to the system, since idle Python workers live on."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, with unused memory given back at the end of each task."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return out


def gathered(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The runs ``at`` of ``values``, one behind the other."""
    n = lengths[at]
    ends = np.cumsum(n)
    shift = np.repeat(starts[at] - (ends - n), n)
    shift += np.arange(len(shift))
    return values[shift]


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of runs of ``values`` of the given sizes."""
    total = np.append(0, np.cumsum(values))
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def packed(ids: np.ndarray, counts: np.ndarray, dtype: str = "<u4") -> pa.Array:
    """Runs of ``ids`` of the given sizes as cells of bytes."""
    dtype = np.dtype(dtype)
    ends = np.append(0, np.cumsum(counts)) * dtype.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(ids, dtype))]).cast(pa.binary())


def append_columns(df: DataFrame, fn: Callable[[dict[str, pa.Array]], list[Iterable]], fields: list[T.StructField], inputs: list[str]) -> DataFrame:
    """``df`` with columns computed in Python, ``AT_ONCE`` bytes of the first input at a time; a column of the same name
    is replaced.

    ``fn`` gets the ``inputs`` as Arrow arrays and returns one sequence for each field, aligned with the rows.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    names = {f.name for f in fields}
    kept = [f for f in df.schema.fields if f.name not in names]
    types = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo, hi in runs(whole.column(whole.schema.names.index(inputs[0])), AT_ONCE):
                b = whole.slice(lo, hi - lo)
                made = fn({c: b.column(b.schema.names.index(c)) for c in inputs})
                arrays = [b.column(b.schema.names.index(f.name)) for f in kept] + [v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(made, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in kept] + [f.name for f in fields])

    return df.mapInArrow(trimmed(run), T.StructType(kept + fields))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has."""
    taken, mark = {c.lower() for c in df.columns}, "_"
    while any(c.startswith(mark) for c in taken):
        mark += "_"
    return [mark + n for n in names]


def text_key(c) -> F.Column:
    """Identity of a text (null counts as empty): its SHA-256."""
    return F.sha2(F.coalesce(c, F.lit("")), 256)
