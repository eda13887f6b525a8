"""Folds over a key's rows in order, where what a row means depends on the one before.

Rows are dealt by key and sorted in their partitions; a task streams through them and holds one key's state, so a key of any number of rows takes the memory of its state only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(df: DataFrame, key: str, order: list, schema: str, start: Callable[[], Any], step: Callable[[Any, Any], tuple[Any, tuple | None]], finish: Callable[[Any], Iterable[tuple]] | None = None) -> DataFrame:
    """step(state, row) gives the next state and a row to return, or None; finish(state) the rows to return behind a key's last."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = object(), None
        first = True
        for x in frames:
            out: list = []
            for row in x.itertuples(index=False):
                k = getattr(row, key)
                if first or k != now:
                    if finish and not first:
                        out += finish(held)
                    now, held, first = k, start(), False
                held, made = step(held, row)
                if made is not None:
                    out.append(made)
            yield pd.DataFrame(out, columns=names, dtype=None if out else object)
        if finish and not first:
            last = list(finish(held))
            yield pd.DataFrame(last, columns=names, dtype=None if last else object)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def first_hit_windows(df: DataFrame, key: str, at: str, row_id: str, seconds: int) -> DataFrame:
    """key, row_id, n: the n-th hit of a window that begins with a hit and lasts so many seconds."""
    rows = df.select(key, row_id, F.unix_micros(F.col(at).cast("timestamp")).alias("at"))

    def step(state: tuple[int, int] | None, row: Any) -> tuple[tuple[int, int], tuple]:
        began, n = state if state is not None and row.at - state[0] < seconds * 1_000_000 else (row.at, 0)
        return (began, n + 1), (getattr(row, key), getattr(row, row_id), n + 1)

    return fold(rows, key, ["at", row_id], f"{key} long, {row_id} long, n int", lambda: None, step)
