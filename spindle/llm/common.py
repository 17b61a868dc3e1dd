"""Shared helpers: bounded broadcasts, batches, reading of the corpus tables."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.durable import passed_on, released, shared_dir, stored, table_path  # noqa: F401
from spindle.ship import bounded

#: A set of ids or keys is broadcast up to this many rows; beyond, the join shuffles.
BROADCAST_ROWS = 2_000_000

#: The words of every contract: runs of characters other than these.
WORD = "[^\\x20\\x09-\\x0D]+"


def prepare(spark: SparkSession) -> None:
    """Sends the package to the Python workers and bounds an Arrow batch of long texts."""
    bounded(spark)


def trim() -> None:
    """Gives back to the system what this worker's allocators hold unused: a worker outlives its tasks."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable) -> Callable:
    """A function of batches that trims its worker every 16 of them and at the end."""

    def counted(batches: Iterator) -> Iterator:
        for i, b in enumerate(batches, 1):
            yield b
            if i % 16 == 0:
                trim()

    @wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        yield from run(counted(batches))
        trim()

    return wrapped


def lean_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """A function of a group's table that trims its worker after large ones."""

    @wraps(run)
    def wrapped(table: pa.Table) -> pa.Table:
        out = run(table)
        if table.nbytes > 1 << 20:
            trim()
        return out

    return wrapped


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def semi_by_id(rows: DataFrame, ids: DataFrame, column: str, how: str = "left_semi", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Rows with (``left_semi``) or without (``left_anti``) an id in ``ids``: by broadcast up to ``limit`` ids, else by shuffle."""
    ids = ids.select(column)
    n = ids.limit(limit + 1).count()
    return rows.join(F.broadcast(ids) if n <= limit else ids, column, how)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
