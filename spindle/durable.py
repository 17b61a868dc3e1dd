"""Intermediate tables in the folder that all executors share: lineage ends there and survives lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import suppress
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: Rows of one file of a table whose size is known, and files that such a table may always have.
FILE_ROWS = 20_000
FILES = 16
#: A local folder without Hadoop's native library: each file that is made, its checksum file and the marker of a job are
#: given their mode by a command of their own, and until that command runs its process counts as much memory as the JVM
#: that starts it.  So the tables' files, which have checksums of their pages, get no others; elsewhere this says nothing.
PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}

_PATHS: WeakKeyDictionary = WeakKeyDictionary()
_LEFT: dict[str, SparkSession] = {}
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where that is unset, a local master gets a folder of its own; a cluster, whose
    executors would each write to a disk of theirs, is refused.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if context.applicationId not in _OWN:
            own = tempfile.mkdtemp(prefix="spindle-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            _OWN[context.applicationId] = f"file://{own}"
        found = _OWN[context.applicationId]
    return found.rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again; removed by ``released``, else when the application ends.

    ``rows``: about how many there are at most; few are then written by few tasks, whatever the number of partitions.
    """
    spark = df.sparkSession
    path = table_path(spark, name)
    if rows is not None:
        df = df.coalesce(max(FILES, rows // FILE_ROWS))
    _LEFT[path] = spark
    df.write.options(**PLAIN).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def passed_on(out: DataFrame, of: DataFrame) -> DataFrame:
    """``out``, which reads the table of ``of`` and now stands for it in ``released``."""
    if of in _PATHS:
        _PATHS[out] = _PATHS.pop(of)
    return out


def released(*tables: DataFrame) -> None:
    """Removes tables of ``stored`` that nothing reads any more; others are left alone."""
    for df in tables:
        path = _PATHS.pop(df, None)
        if path is not None:
            _remove(path)


def _remove(path: str) -> None:
    spark = _LEFT.pop(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@atexit.register
def _end() -> None:
    for path in list(_LEFT):
        with suppress(Exception):  # the session may be gone
            _remove(path)
