"""Exponential averages of several series in one ordered pass over each ticker, in constant memory."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Average:
    """e of the first value of x is x itself, later e is alpha x + (1 - alpha) e before; null where x is and before `least` values.

    x is a column, or two averages made before this one, whose difference is taken.
    """

    out: str
    x: str | tuple[str, str]
    alpha: float
    least: int = 1


def _pass(batches: Iterable[pa.RecordBatch], averages: tuple[Average, ...]) -> Iterator[pa.RecordBatch]:
    ticker, last, seen = object(), {}, {}
    for batch in batches:
        names = batch.column("ticker").to_pylist()
        starts = [i for i, name in enumerate(names) if i == 0 or name != names[i - 1]] + [len(names)]
        given = {a.x: batch.column(a.x).to_numpy(zero_copy_only=False).astype(float) for a in averages if isinstance(a.x, str)}
        made = {a.out: np.full(len(names), np.nan) for a in averages}
        for i, j in zip(starts, starts[1:], strict=False):
            if names[i] != ticker:
                ticker, last, seen = names[i], {}, dict.fromkeys(made, 0)
            for a in averages:
                x = given[a.x][i:j] if isinstance(a.x, str) else made[a.x[0]][i:j] - made[a.x[1]][i:j]
                at = np.flatnonzero(~np.isnan(x))
                if not len(at):
                    continue
                before = [last[a.out]] if a.out in last else []
                e = pd.Series(np.concatenate([before, x[at]])).ewm(alpha=a.alpha, adjust=False).mean().to_numpy()[len(before) :]
                hidden = max(0, a.least - 1 - seen[a.out])
                made[a.out][i + at[hidden:]] = e[hidden:]
                last[a.out], seen[a.out] = e[-1], seen[a.out] + len(at)
        columns = [pa.array(made[a.out], from_pandas=True) for a in averages]
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *made])


def averaged(df: DataFrame, *averages: Average) -> DataFrame:
    """df with a column for each average, in the order of the date within the ticker; NaN counts as null.

    Rows of a ticker meet in one task, as they do in a window, but stream through it: only the last averages are kept.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + "".join(f", `{a.out}` double" for a in averages)
    return df.repartition("ticker").sortWithinPartitions("ticker", "date").mapInArrow(lambda batches: _pass(batches, averages), schema)
