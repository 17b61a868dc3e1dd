"""Packing a stream: each shard's unfinished sequence and carry buffer are its state between batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spindle.ship import ship

_OUT = "shard string, bin long, place int, id long, n long"
_STATE = "bin long, ids string, sizes string"


def packed_stream(rows: DataFrame, expected: int, maximum: int) -> DataFrame:
    """``rows(shard, id, n)`` -> a row for each sample of each finished sequence; next-fit within a shard, samples above ``maximum`` left out.

    A shard's open sequence is kept in the state store, so a restart goes on with it.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, ids, sizes = (int(state.get[0]), *([int(x) for x in s.split(",") if x] for s in state.get[1:])) if state.exists else (0, [], [])
        out, total = [], sum(sizes)

        def emit() -> None:
            nonlocal number, ids, sizes, total
            out.extend((key[0], number, i, a, n) for i, (a, n) in enumerate(zip(ids, sizes, strict=True)))
            number, ids, sizes, total = number + 1, [], [], 0

        for frame in frames:
            for a, n in zip(frame["id"].tolist(), frame["n"].tolist(), strict=True):
                if n > maximum:
                    continue
                if total + n > maximum:
                    emit()
                ids.append(int(a))
                sizes.append(int(n))
                total += int(n)
                if total >= expected:
                    emit()
        state.update((number, ",".join(map(str, ids)), ",".join(map(str, sizes))))
        yield pd.DataFrame(out, columns=["shard", "bin", "place", "id", "n"])

    ship(rows.sparkSession)
    return rows.select("shard", "id", "n").groupBy("shard").applyInPandasWithState(run, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)
