"""Reading on from where a job stopped: positions, visits, and file streams with checkpoints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def last_positions(log: DataFrame, *by: str, position: str, order: list[str]) -> DataFrame:
    """The last position of each dataset and worker."""
    return log.groupBy(*by).agg(F.max_by(position, F.struct(*order)).alias(position))


def remaining(rows: DataFrame, state: DataFrame, by: list[str], position: list[str]) -> DataFrame:
    """Rows after each worker's position, in (file, row group, row) order; workers without a position start at the front."""
    known = state.select(*by, F.struct(*position).alias("__at"))
    return rows.join(known, by, "left").where(F.col("__at").isNull() | (F.struct(*position) > F.col("__at"))).drop("__at")


def visit_counts(log: DataFrame, dataset: str, shard: str, shards: int) -> DataFrame:
    """Visits of each shard of each dataset, 0 for those never seen."""
    every = log.select(dataset).distinct().withColumn(shard, F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    return every.join(log.groupBy(dataset, shard).agg(F.count("*").alias("seen")), [dataset, shard], "left").withColumn("seen", F.coalesce("seen", F.lit(0).cast("bigint")))


def remaining_work(visits: DataFrame, dataset: str, shard: str) -> DataFrame:
    """A row for each visit that a shard is behind the most visited one of its dataset."""
    most = visits.groupBy(dataset).agg(F.max("seen").alias("__most"))
    behind = visits.join(most, dataset).where("seen < __most")
    return behind.withColumn("replica", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__most") - F.col("seen")))).drop("__most")


def restored_visits(state: DataFrame, path: str) -> None:
    """Writes a visit table in place of what is there: earlier local logs count no more."""
    state.write.mode("overwrite").parquet(path)


def file_stream(spark: SparkSession, path: str, schema: str, kind: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """A stream over the files of a folder, each read once for a checkpoint."""
    reader = spark.readStream.schema(schema).format(kind)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def run_available(stream: DataFrame, out: str, checkpoint: str, step: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Processes all files that are there and not done yet, appends the result to a folder and returns."""
    result = step(stream) if step else stream
    result.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def in_windows(events: DataFrame, ts: str, window: str, late: str, *by: str, slide: str | None = None) -> DataFrame:
    """Counts in event-time windows, rows later than ``late`` left out of a stream."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    return events.withWatermark(ts, late).groupBy(w, *by).agg(F.count("*").alias("n"))


def epoch_of(batch: Column, rows: Column) -> Column:
    """Epoch of the k-th draw from an endless pass over ``rows`` rows."""
    return F.floor(batch / rows)
