"""Writing results.  Every sink is a DataFrame writer, so a repeated task never leaves half a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindle.operators.records import kv_records, restored


def json_once(df: DataFrame, path: str) -> None:
    """JSON lines, unless the path exists: a job may run again."""
    df.write.mode("ignore").json(path)


def json_append(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def json_records(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def key_values(df: DataFrame, path: str, file: str, index: str) -> None:
    """``(key, value)`` Parquet in key order, and beside it ``keys``: the keys alone."""
    kv = kv_records(df, file, index).repartitionByRange("key").sortWithinPartitions("key")
    kv.write.mode("overwrite").parquet(f"{path}/kv")
    df.sparkSession.read.parquet(f"{path}/kv").select("key").write.mode("overwrite").parquet(f"{path}/keys")


def in_source_order(df: DataFrame, order: DataFrame, key: str, position: str, path: str, partitions: int, rows_per_file: int) -> None:
    """Parquet in the source's row order, files of a fixed number of rows."""
    restored(df, order, key, position, partitions).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)


def separated(df: DataFrame, path: str, sep: str = ",", drop: tuple[str, ...] = ()) -> None:
    df.drop(*drop).write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def named_lines(path: Column, caption: Column) -> Column:
    """A JSON line ``{base name: caption}``."""
    return F.to_json(F.create_map(F.element_at(F.split(path, "/"), -1), caption))


def text_report(df: DataFrame, path: str, line: Column) -> None:
    """One text line for each row, in the rows' order."""
    df.select(line.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def state_table(df: DataFrame, path: str, *by: str) -> None:
    """A loader's positions, partitioned so that one dataset's can be replaced alone."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
