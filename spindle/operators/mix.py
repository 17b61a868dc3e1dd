"""Choosing groups, datasets and buckets by weight, from hashes of stable keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindle.functions.det import uniform, weighted_index


def group_of(weights: list[float], seed: int, *key: str) -> Column:
    """A group for each key (such as a packed sequence's number): the first whose cumulative share is above the draw."""
    return weighted_index(weights, uniform(seed, "group", *key))


def cdf(groups: DataFrame, weight: str, *order: str) -> DataFrame:
    """``p``: cumulative share of weights in an order."""
    w = Window.orderBy(*order)
    total = F.sum(weight).over(Window.partitionBy())
    return groups.withColumn("p", F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0)) / total)


def dataset_of(datasets: list[str], weights: list[float] | None, seed: int, *key: str, replicas: list[int] | None = None) -> Column:
    """A dataset for each key, by weight (``None``: all alike); ``replicas`` multiply a dataset's share, as larger batches do."""
    w = [(weights[i] if weights else 1.0) * (replicas[i] if replicas else 1) for i in range(len(datasets))]
    return F.get(F.array(*map(F.lit, datasets)), weighted_index(w, uniform(seed, "dataset", *key)))


def bucket_of(draws: DataFrame, buckets: DataFrame, count: str, bucket: str, seed: int, *key: str) -> DataFrame:
    """``draws`` with a bucket each, with probability in proportion to its count.

    The cumulative counts are one small row, put beside each draw.
    """
    edges = cdf(buckets, count, bucket).agg(F.array_sort(F.collect_list(F.struct("p", bucket))).alias("edges"))
    u = uniform(seed, "bucket", *key)
    return draws.crossJoin(F.broadcast(edges)).withColumn(bucket, F.get(F.filter("edges", lambda e: u < e["p"]), 0)[bucket]).drop("edges")


def repeat_then_truncate(files: DataFrame, counts: DataFrame, dataset: str, order: str, n: str) -> DataFrame:
    """Files of each dataset, repeated as often as needed, then the first ``n`` of that dataset; ``place`` counts them."""
    w = Window.partitionBy(dataset)
    known = files.join(counts, dataset).withColumn("have", F.count("*").over(w)).withColumn("rn", F.row_number().over(w.orderBy(order)) - 1)
    copies = F.floor(F.col(n) / F.col("have"))
    every = known.withColumn("copy", F.explode(F.sequence(F.lit(0), copies.cast("int"))))
    return every.withColumn("place", F.col("copy") * F.col("have") + F.col("rn")).where(F.col("place") < F.col(n)).drop("have", "rn", "copy")
