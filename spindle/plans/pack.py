"""Packing samples into sequences of bounded tokens.

``greedy`` is next-fit as a fold and stays in SQL.  ``buffered`` is the full state
machine with a carry buffer, mandatory groups and weighted groups; its state is
sequential within a shard, so a shard is the unit of work: give it a bounded size
(``shard_of`` cuts sources of any share into shards of about equal size).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindle.functions.det import digest, uniform, weighted_index
from spindle.ship import ship

#: Rows of one shard.
SHARD_ROWS = 20_000


@dataclass(frozen=True)
class Limits:
    """Token limits of a sequence and the size of the carry buffer."""

    expected: int = 32768
    per_sample: int = 16384
    maximum: int = 36864
    prefer_buffer_before: int = 16384
    buffer: int = 50
    drop_on_overflow: bool = False  # the reference behaviour; else the sample that overflows is carried on
    keep_partial: bool = False


def shard_of(rows: DataFrame, source: str, seed: int, *key: str, size: int = SHARD_ROWS) -> DataFrame:
    """``rows`` with ``shard`` and ``order_key``: each source is cut by hash into as many shards as its size asks for."""
    counts = rows.groupBy(source).agg(F.ceil(F.count("*") / size).alias("__shards"))
    cut = rows.join(counts, source).withColumn("order_key", digest(seed, "pack", *key))
    number = F.floor(F.conv(F.substring("order_key", 9, 8), 16, 10).cast("long") * F.col("__shards") / F.lit(1 << 32))
    return cut.withColumn("shard", number.cast("int")).drop("__shards")


def greedy(rows: DataFrame, group: str | list[str], order: str, tokens: str, capacity: int) -> DataFrame:
    """``(group, bin, n, tokens)``: next-fit in order, samples above the capacity left out.

    A group is folded in one task: name a source with its shard (``shard_of``), whose size is bounded.
    """
    group = [group] if isinstance(group, str) else group
    state = "struct<bin:int,fill:bigint,n:bigint,done:array<struct<bin:int,n:bigint,tokens:bigint>>>"
    listed = rows.where(F.col(tokens) <= capacity).groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, tokens))), lambda x: x[tokens].cast("bigint")).alias("__t"))

    def step(s: Column, t: Column) -> Column:
        full = s["fill"] + t > capacity
        closed = F.concat(s["done"], F.array(F.struct(s["bin"].alias("bin"), s["n"].alias("n"), s["fill"].alias("tokens"))))
        return F.when(full, F.struct((s["bin"] + 1).alias("bin"), t.alias("fill"), F.lit(1).cast("bigint").alias("n"), closed.alias("done"))).otherwise(
            F.struct(s["bin"].alias("bin"), (s["fill"] + t).alias("fill"), (s["n"] + 1).alias("n"), s["done"].alias("done"))
        )

    start = F.struct(F.lit(0).alias("bin"), F.lit(0).cast("bigint").alias("fill"), F.lit(0).cast("bigint").alias("n"), F.array().cast("array<struct<bin:int,n:bigint,tokens:bigint>>").alias("done")).cast(state)
    end = lambda s: F.concat(s["done"], F.array(F.struct(s["bin"].alias("bin"), s["n"].alias("n"), s["fill"].alias("tokens"))))
    packed = listed.withColumn("__b", F.explode(F.aggregate("__t", start, step, end)))
    return packed.select(*group, F.col("__b.bin").alias("bin"), F.col("__b.n").alias("n"), F.col("__b.tokens").alias("tokens"))


def pack_samples(samples: dict[str, list[tuple[object, int, int]]], weights: dict[str, float], mandatory: set[str], draws: Iterator[float], limits: Limits) -> Iterator[list[tuple[str, object, int]]]:
    """Sequences of one shard: lists of (group, id, tokens).

    ``samples``: each group's (id, tokens, items) in order.  A sequence draws its group
    once.  It starts with a sample of every mandatory group; a carried sample goes
    first while the sequence is short.  A sample that would overflow is carried, or
    if the buffer is full or it was carried before, ends the sequence (and is carried
    into the next one, unless overflow drops it).  The shard ends where the drawn
    group has no more samples.
    """
    names = [g for g in samples if weights.get(g, 0) > 0]
    total, run, cuts = sum(weights[g] for g in names), 0.0, []
    for g in names:
        run += weights[g]
        cuts.append((run / total, g))
    queues = {g: deque(s) for g, s in samples.items()}
    buffer: deque = deque()
    now: list[tuple[str, object, int]] = []
    curr, waiting = 0, None

    def draw() -> str:
        u = next(draws)
        return next((g for cut, g in cuts if u < cut), cuts[-1][1])

    group = draw() if names else None
    while group is not None:
        if curr == 0 and not now:
            for g in sorted(mandatory):
                while queues[g]:
                    key, tokens, items = queues[g].popleft()
                    n = tokens + 2 * items
                    if n < limits.per_sample:
                        now.append((g, key, n))
                        curr += n
                        break
        if waiting is not None:
            (g, key, n), carried, waiting = waiting, True, None
        elif curr < limits.prefer_buffer_before and buffer:
            (g, key, n), carried = buffer.popleft(), True
        else:
            if not queues[group]:
                break
            key, tokens, items = queues[group].popleft()
            g, n, carried = group, tokens + 2 * items, False
            if n > limits.per_sample:
                continue
        if curr + n > limits.maximum:
            if len(buffer) < limits.buffer and not carried:
                buffer.append((g, key, n))
                continue
            if not limits.drop_on_overflow and now:
                waiting = (g, key, n)
            if now:
                yield now
            now, curr, group = [], 0, draw()
            continue
        now.append((g, key, n))
        curr += n
        if curr >= limits.expected:
            yield now
            now, curr, group = [], 0, draw()
    if now and limits.keep_partial:
        yield now


_PACKED = "shard string, bin long, place int, group_name string, id long, n long, start long"


def buffered(rows: DataFrame, limits: Limits = Limits(), weights: dict[str, float] | None = None, mandatory: tuple[str, ...] = (), seed: int = 0) -> DataFrame:
    """``rows(shard, group_name, id, tokens, items, order_key)`` -> a row for each packed sample with its sequence and place.

    Groups without a weight weigh 1.  Samples that are too long, dropped, or left in
    the buffer or an unfinished sequence have no row.
    """

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        import hashlib

        frame = frame.sort_values(["order_key", "id"], kind="stable")
        samples = {g: list(zip(f["id"], f["tokens"], f["items"], strict=True)) for g, f in frame.groupby("group_name", sort=True)}
        names = {g: (weights or {}).get(g, 1.0) for g in samples}

        def draws():
            i = 0
            while True:
                yield int(hashlib.md5(f"{seed}:pack:{key[0]}:{i}".encode()).hexdigest()[:8], 16) / 2**32
                i += 1

        out = []
        for b, sequence in enumerate(pack_samples(samples, names, set(mandatory) & set(samples), draws(), limits)):
            at = 0
            for place, (g, i, n) in enumerate(sequence):
                out.append((str(key[0]), b, place, g, int(i), int(n), at))
                at += int(n)
        return pd.DataFrame(out, columns=["shard", "bin", "place", "group_name", "id", "n", "start"])

    ship(rows.sparkSession)
    needed = rows.select(F.col("shard").cast("string").alias("shard"), F.col("group_name").cast("string").alias("group_name"), F.col("id").cast("long").alias("id"), F.col("tokens").cast("long").alias("tokens"), F.col("items").cast("int").alias("items"), "order_key")
    return needed.groupBy("shard").applyInPandas(run, _PACKED)


def group_draw(groups: list[str], weights: list[float], seed: int, *key: str) -> Column:
    """The group of a sequence by its number: for plans that need only the choice."""
    return F.get(F.array(*map(F.lit, groups)), weighted_index(weights, uniform(seed, "group", *key)))
