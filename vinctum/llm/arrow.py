"""Row-wise Python inside Spark tasks: Arrow batches in, Arrow batches out, in small slices so that memory stays bounded."""

from __future__ import annotations

import contextlib
import ctypes
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows, and bytes of Arrow data, that are turned into Python objects at once.
SLICE_ROWS, SLICE_BYTES = 256, 8 << 20


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """The function for mapInArrow that gives free memory back when its task ends, as Python workers live on beside other tasks."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            with contextlib.suppress(OSError, AttributeError):  # a C library without it
                ctypes.CDLL(None).malloc_trim(0)

    return inner


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        step = max(1, min(SLICE_ROWS, SLICE_ROWS * SLICE_BYTES // max(1, batch.nbytes * SLICE_ROWS // max(1, batch.num_rows))))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def map_texts(df: DataFrame, make: Callable[[], Callable[[str], tuple]], fields: str, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """One output row per input row: the key columns and what make()(text) returns; a null text counts as empty."""
    out = StructType([df.schema[k] for k in keys] + list(StructType.fromDDL(fields)))
    schema = to_arrow_schema(out)
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for part in slices(batches):
            rows = [of(t or "") for t in part.column(n).to_pylist()]
            values = zip(*rows) if rows else [[] for _ in range(n, len(schema))]
            yield pa.RecordBatch.from_arrays([*(part.column(i).cast(schema.field(i).type) for i in range(n)), *(pa.array(v, f.type) for v, f in zip(values, list(schema)[n:]))], schema=schema)

    return df.select(*keys, text).mapInArrow(trimmed(run), out)


class Memo(dict):
    """A bounded memo of two generations: when the young one is full it becomes the old one, from which hits are taken over.

    Keys of over `longest` characters are computed each time and not held.
    """

    def __init__(self, compute: Callable, limit: int, longest: int = 200):
        super().__init__()
        self.compute, self.limit, self.longest, self.old = compute, limit, longest, {}

    def __missing__(self, key):
        if len(key) > self.longest:
            return self.compute(key)
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
