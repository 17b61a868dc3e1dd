"""Sends this package to Python workers, which need not share a folder with the driver."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of one Arrow batch handed to Python, unless a single row is larger.
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20

_SHIPPED: set[str] = set()


def ship(spark: SparkSession | None = None) -> None:
    """Adds the package to the application's files, once."""
    spark = spark or SparkSession.active()
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    package = os.path.basename(top)
    path = os.path.join(tempfile.mkdtemp(prefix=f"{package}-code-"), f"{package}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for d, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(d, name)
                    z.write(full, os.path.join(package, os.path.relpath(full, top)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def bounded(spark: SparkSession | None = None) -> None:
    """``ship``, and a bound for an Arrow batch of long texts, so that a worker's memory doesn't grow with a partition's rows."""
    spark = spark or SparkSession.active()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    ship(spark)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores if its scan has fewer splits, such as one file of one row group: for work that outweighs moving the rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
