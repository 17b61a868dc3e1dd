"""Deterministic randomness: a stateless hash of (seed, purpose, keys) in place of generators.

A value depends on its row's keys alone: not on partitions, order or retries, and
any SQL engine with md5 gives the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often and wherever the body has it."""
    return F.get(F.transform(F.array(value), body), 0)


def digest(seed: int | str, purpose: str, *keys: Column | str) -> Column:
    """md5 of ``seed:purpose:key:...`` as 32 hex digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(purpose), *(F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys)))


def uniform(seed: int | str, purpose: str, *keys: Column | str) -> Column:
    """A double in [0, 1) from the first 32 bits of the digest."""
    return F.conv(F.substring(digest(seed, purpose, *keys), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def below(n: Column | int, seed: int | str, purpose: str, *keys: Column | str) -> Column:
    """An integer in [0, n)."""
    return F.floor(uniform(seed, purpose, *keys) * n).cast("int")


def choice(values: Column, seed: int | str, purpose: str, *keys: Column | str) -> Column:
    """An element of an array; null of an empty one."""
    return F.get(values, below(F.size(values), seed, purpose, *keys))


def weighted_index(weights: list[float], u: Column) -> Column:
    """The first index whose cumulative share exceeds ``u``; weights are not negative and one is above 0."""
    total, run, out = float(sum(weights)), 0.0, F.lit(len(weights) - 1)
    cuts = []
    for w in weights:
        run += w
        cuts.append(run / total)
    for i in range(len(weights) - 2, -1, -1):
        out = F.when(u < cuts[i], i).otherwise(out)
    return out


def sql_uniform(seed: int | str, purpose: str, *keys: str) -> str:
    """The same as ``uniform`` in DuckDB SQL."""
    parts = ", ".join([f"'{seed}'", f"'{purpose}'", *(f"CAST({k} AS VARCHAR)" for k in keys)])
    return f"(CAST('0x' || substr(md5(concat_ws(':', {parts})), 1, 8) AS BIGINT) / 4294967296.0)"
