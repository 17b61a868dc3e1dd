"""Connected components of an undirected edge table, by alternating large-star and small-star steps.

No step gathers the neighbours of a vertex: each is a grouped minimum and a join.
A hub's edges would meet in one task of a shuffled join, so that the minima of hubs, which are few,
are broadcast to the edges where these are.

The plans of a round cost the driver as much for a few edges as for many, so a table of
bounded size is solved by one task instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.llm.common import batch, lean, passed_on, prepare, released, stored

#: Edges of whole numbers that one task takes (some 130 MB); more take rounds of all tasks.
TASK_EDGES = 1_000_000
#: Rows of a batch that this task returns.
ROWS = 1 << 16
#: A vertex of so many edges is a hub; with many edges it takes more, so that there are ``HUBS`` at most.
HUB_EDGES = 1000
HUBS = 500_000


_STARS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every vertex but the least of its component, and that one."""
    ends, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(ends))
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))  # roots below roots: in two steps each meets another
        while not np.array_equal(root, up := root[root]):
            root = up
    below = np.flatnonzero(root != np.arange(len(ends)))
    return ends[below], ends[root[below]]


@lean
def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges in one task -> the stars of their components."""
    parts = [(np.asarray(b.column("u")), np.asarray(b.column("v"))) for b in batches]
    if parts:
        u, v = stars(*(np.concatenate(p) for p in zip(*parts, strict=True)))
        for i in range(0, len(u), ROWS):
            yield batch(_STARS, u[i : i + ROWS], v[i : i + ROWS])


def _with_least(edges: DataFrame, hub: int) -> DataFrame:
    """``(u, v, m)``: each edge with the least neighbour of ``u``."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
    hubs = least.where(F.col("degree") >= hub).select("u", "m")
    others = least.where(F.col("degree") < hub).select("u", "m")
    light = edges.join(F.broadcast(hubs.select("u")), "u", "left_anti")
    return edges.join(F.broadcast(hubs), "u").select("u", "v", "m").union(light.join(others, "u").select("u", "v", "m"))


def _large_star(edges: DataFrame, hub: int) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    moved = _with_least(both, hub).select("u", "v", F.least("u", "m").alias("m"))
    return moved.where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))  # repeats go in the small star


def _small_star(edges: DataFrame, hub: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    found = _with_least(down, hub)
    moved = found.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(down.groupBy("u").agg(F.min("v").alias("v"))).distinct()


def components(edges: DataFrame, name: str = "edges", rounds: int = 60, rows: int | None = None) -> DataFrame:
    """``edges(u, v)`` of any orderable type -> ``(vertex, root)`` for every vertex but the roots.

    The root is the least vertex of its component.  Nulls, loops and repeated
    edges are ignored; an empty table gives an empty result.  ``rows``: about how many edges there may be.
    """
    prepare(edges.sparkSession)
    now = stored(edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name, rows)
    state = (now.count(),)
    if state[0] <= TASK_EDGES and {t for _, t in now.dtypes} == {"bigint"}:
        after = stored(now.coalesce(1).mapInArrow(_solved, "u long, v long"), name, state[0])
        released(now)
        return passed_on(after.select(F.col("u").alias("vertex"), F.col("v").alias("root")), after)
    for _ in range(rounds):
        n = state[0]  # no step makes more
        hub = max(HUB_EDGES, -(-2 * n // HUBS))
        large = stored(_large_star(now, hub), name, 2 * n)
        after = stored(_small_star(large, hub), name, n)
        released(large, now)
        found = after.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found == state:
            return passed_on(after.select(F.col("u").alias("vertex"), F.col("v").alias("root")), after)
        now, state = after, found
    raise RuntimeError(f"components did not settle in {rounds} rounds")
