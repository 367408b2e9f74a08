"""Helpers shared by the corpus operators: tables by name, keys, Arrow batches in small blocks."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..plans.scratch import Scratch  # noqa: F401

#: Text bytes that one numpy block holds at most, but for a single longer text.
BLOCK_BYTES = 2_000_000
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def integer_key(docs: DataFrame, key: str) -> Column:
    """The key as a long; keys of another type are refused."""
    if not isinstance(docs.schema[key].dataType, IntegralType):
        raise TypeError(f"keys have to be integers: {key} is {docs.schema[key].dataType.simpleString()}")
    return docs[key].cast("long")


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of all texts: one native pass, one number to the driver."""
    return docs.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0


def small_batches(df: DataFrame) -> None:
    """Batches to Python of 1000 rows, unless the session asks for other than the default: texts are long, and a batch
    is held by the executor and by its Python worker."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(name) == "10000":
        conf.set(name, "1000")


_held: dict[str, Callable[[], None]] = {}


def claim(name: str, clear: Callable[[], None] | None = None) -> None:
    """Called by a task in its Python worker: what other operators keep between their tasks there is given back."""
    others = [k for k in _held if k != name]
    for k in others:
        _held.pop(k)()
    _held[name] = clear or (lambda: None)
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except OSError:  # another C library: memory is reused, not returned
            pass


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts have `limit` bytes together at most, but for a single longer text."""
    for batch in batches:
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for row, length in enumerate(lengths.tolist()):
            if held and held + length > limit:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += length
        if start < batch.num_rows:
            yield batch.slice(start)
