"""Assigning ordered rows to shards, workers and chunks in closed form.

``position`` is a row's number from 0 in some total order and ``n`` the number of
rows; a shard is then arithmetic, so nothing is gathered.  ``numbered`` gives both
without putting all rows in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindle.durable import stored
from spindle.functions.det import digest


def numbered(df: DataFrame, *order: Column | str, position: str = "position", n: str = "n") -> DataFrame:
    """``df`` with each row's number in the order and the number of rows.

    Rows are ranged and sorted once and written to the shared folder with their
    range and their place in it; only a row for each range is numbered in one task.
    Numbers thus come from the very rows that were sorted, whatever a second look
    at them would sample.  Ties are broken by a hash of the whole row, then by its
    place in the input, so that ties and equal rows of any number spread over ranges too.
    """
    if {position, n} & set(df.columns):
        raise ValueError(f"the rows already have a column {position} or {n}")
    own = [F.col(f"`{c}`") for c in df.columns]
    rest = [F.col(f"`{f.name}`") for f in df.schema if _hashable(f.dataType)]
    order = (*order, "__tie", "__row")
    keyed = df.select(*own, (F.xxhash64(*rest) if rest else F.lit(0)).alias("__tie"), F.monotonically_increasing_id().alias("__row"))
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    in_range = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = stored(ranged.select(*own, F.spark_partition_id().alias("__part"), in_range.alias("__in")), "numbered")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__size"))
    starts = sizes.select("__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"), F.sum("__size").over(Window.partitionBy()).alias("__n"))
    found = placed.join(F.broadcast(starts), "__part")  # a row for each range
    return found.select(*own, (F.col("__start") + F.col("__in")).alias(position), F.col("__n").alias(n))


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind)
    return not isinstance(kind, (T.MapType, T.VariantType))


def floor_slice(position: Column, n: Column, shards: int) -> Column:
    """``n // shards`` rows each; null for the remainder, which this scheme leaves out."""
    per = F.floor(n / shards)
    shard = F.floor(position / per)
    return F.when((per > 0) & (shard < shards), shard).cast("int")


def reversed_place(position: Column, n: Column, shards: int) -> Column:
    """Place of a row in its floor slice when slices run backwards."""
    per = F.floor(n / shards)
    return F.when(floor_slice(position, n, shards).isNotNull(), per - 1 - position % per).cast("long")


def ceil_chunk(position: Column, n: Column, shards: int) -> Column:
    """Contiguous chunks of ``ceil(n / shards)``; the last may be smaller or empty."""
    return F.floor(position / F.ceil(n / shards)).cast("int")


def balanced(position: Column, n: Column, shards: int) -> Column:
    """Contiguous, the first ``n % shards`` shards with one row more."""
    small, more = F.floor(n / shards), n % shards
    edge = more * (small + 1)
    return F.when(position < edge, F.floor(position / (small + 1))).otherwise(more + F.floor((position - edge) / F.greatest(small, F.lit(1)))).cast("int")


def round_robin(position: Column, shards: int) -> Column:
    return F.pmod(position, F.lit(shards)).cast("int")


def fixed_size(position: Column, size: int) -> Column:
    return F.floor(position / size).cast("int")


def rotated(position: Column, n: Column, by: int) -> Column:
    """Place after ``by`` rows have moved from the front to the end."""
    return F.pmod(position - by, n).cast("long")


def two_level(position: Column, n: Column, world: int, workers: int, allow_empty: bool = False, force: bool = False) -> Column:
    """struct(rank, worker), each null where every shard takes the row.

    With as many rows as workers: round robin over ranks, then over a rank's
    workers.  With fewer: one row at most for each (``allow_empty``), or everyone a
    copy, unless ``force`` makes that an error.
    """
    rank = F.pmod(position, F.lit(world))
    worker = F.pmod(F.floor(position / world), F.lit(workers))
    enough = n >= world * workers
    none = F.lit(None).cast("int")
    if allow_empty:
        few = (F.floor(position / workers), F.pmod(position, F.lit(workers)))
    elif force:
        few = (F.raise_error(F.lit("fewer rows than workers")).cast("int"),) * 2
    else:
        few = (none, none)
    return F.struct(F.when(enough, rank).otherwise(few[0]).cast("int").alias("rank"), F.when(enough, worker).otherwise(few[1]).cast("int").alias("worker"))


def worker_seed(seed: int, rank: Column, workers: int, worker: Column) -> Column:
    return (F.lit(seed) + rank * workers + worker).cast("long")


def shuffled(df: DataFrame, seed: int | str, epoch: Column | int, *key: str) -> DataFrame:
    """``df`` with ``order_key``: sorting by it and the key is the epoch's shuffle."""
    e = F.lit(epoch) if isinstance(epoch, int) else epoch
    return df.withColumn("order_key", digest(seed, "shuffle", e, *key))


def block_shuffled(df: DataFrame, seed: int | str, file: str, block: Column, *key: str) -> DataFrame:
    """``df`` with ``k1, k2, k3``: files, then a file's blocks, then a block's rows in hash order."""
    return df.withColumns({"k1": digest(seed, "file", file), "k2": digest(seed, "block", F.col(file), block), "k3": digest(seed, "row", *key)})


def repeated_to(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The rows again and again in order up to ``n``: ``copy`` and ``place``."""
    every = numbered(df, *order)
    copies = F.when(F.col("position") < n, F.floor((F.lit(n) - 1 - F.col("position")) / F.col("n")))
    return every.where(copies.isNotNull()).withColumn("copy", F.explode(F.sequence(F.lit(0), copies.cast("int")))).withColumn("place", F.col("copy") * F.col("n") + F.col("position")).drop("position", "n")


def epochs(df: DataFrame, count: int) -> DataFrame:
    """A copy of the rows for each epoch."""
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
