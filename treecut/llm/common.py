"""Helpers shared by the pipeline operators."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Hashable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path

#: Rows of an Arrow batch that a task yields at a time.
OUT_ROWS = 2000


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared checkpoint folder and read it back:
    lineage is cut, a lost executor costs nothing, work is not repeated."""
    path = scratch_path(df.sparkSession, f"llm-{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def growing(df: DataFrame) -> DataFrame:
    """Side of a join that grows with the corpus: sorted and merged at every
    size, never broadcast."""
    return df.hint("merge")


def scan(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of Arrow batches as Python tuples, one at a time (a batch may hold
    very long texts, so it is never turned into Python objects as a whole)."""
    for batch in batches:
        columns = [batch.column(n) for n in names]
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in columns)


def emit(rows: Iterable[tuple], schema: pa.Schema, size: int = OUT_ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most ``size`` rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, as UTF-8 (``bytes``
    methods lower and split on exactly those ASCII characters)."""
    return utf8(text).lower().split()


def input_tasks(df: DataFrame) -> int:
    """How many tasks a scan of ``df`` takes; it grows with the table."""
    return max(1, df.rdd.getNumPartitions())


def once_per_worker(key: Hashable, make: Callable):
    """``make()`` once in a Python worker's life.  The package travels to the
    workers by value, so its own globals live only as long as a task."""
    kept = sys.modules.setdefault("_treecut_worker", types.ModuleType("_treecut_worker")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]
