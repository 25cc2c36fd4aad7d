"""ST1: portfolios marked to market from a stream of daily prices or values."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "portfolio_id string, date timestamp, nav double, n_marks long"
STATE = "nav double, n long"


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    nav, n = state.get if state.exists else (100.0, 0)
    rows = pd.concat(list(frames)).sort_values("date")
    out = []
    for date, ret in zip(rows["date"], rows["ret"], strict=True):
        nav, n = nav * (1 + float(ret)), n + 1
        out.append((key[0], date, nav, n))
    state.update((nav, n))
    yield pd.DataFrame(out, columns=["portfolio_id", "date", "nav", "n_marks"])


def marks(stream: DataFrame, delay: str = "7 days") -> DataFrame:
    """A mark for every (portfolio_id, date, ret) of the stream in the order of its dates within a batch; the state of a
    portfolio is its value and its number of marks. Later than `delay` rows are dropped."""
    return stream.withWatermark("date", delay).groupBy("portfolio_id").applyInPandasWithState(_step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def batch_marks(rows: DataFrame) -> DataFrame:
    """The same marks from a table."""
    from pyspark.sql import Window

    w = Window.partitionBy("portfolio_id").orderBy("date", "ret").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("portfolio_id", "date", (100 * F.product(1 + F.col("ret")).over(w)).alias("nav"), F.count("*").over(w).alias("n_marks"))
