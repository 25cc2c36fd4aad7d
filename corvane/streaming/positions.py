"""ST1: books marked to market from a stream of their prices and trades, with positions, last prices and cash in state."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

DAY = 86_400_000
OUT = "portfolio_id string, kind string, date date, nav double, cash double, n_positions int, ticker string, price double, shares double"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Book(StatefulProcessor):
    """Rows of open days wait in a list. One timer a book stands at the end of its earliest waiting day; once the watermark
    has passed it, all days that are over are marked in one go, from rows in the order of their times, so state is read and
    written once a book and batch, not once a day. A row of a closed day is put out as `late`."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ms long, ticker string, price double, shares double")
        self.book = handle.getValueState("book", "cash double, closed long, tickers array<string>, shares array<double>, prices array<double>")

    def _book(self) -> tuple[float, int, dict[str, tuple[float, float]]]:
        kept = self.book.get()
        if kept is None:
            return 0.0, -(1 << 40), {}
        cash, closed, tickers, shares, prices = kept
        return cash, closed, {t: (n, x) for t, n, x in zip(tickers, shares, prices)}

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        _, closed, _ = self._book()
        waiting = []
        for r in rows:
            day = r.ms // DAY
            if day <= closed:
                yield Row(portfolio_id=key[0], kind="late", date=_date(day), nav=None, cash=None, n_positions=None, ticker=r.ticker, price=r.price, shares=r.shares)
            else:
                waiting.append((r.ms, r.ticker, r.price, r.shares))
        if waiting:
            self.waiting.appendList(waiting)
            self.handle.registerTimer((min(waiting)[0] // DAY + 1) * DAY - 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        over = max(expiredTimerInfo.getExpiryTimeInMs() // DAY, timerValues.getCurrentWatermarkInMs() // DAY - 1)
        cash, closed, held = self._book()
        if expiredTimerInfo.getExpiryTimeInMs() // DAY <= closed:
            return
        rows = sorted(tuple(r) for r in self.waiting.get())
        left = [r for r in rows if r[0] // DAY > over]
        for closed, own in groupby(rows[: len(rows) - len(left)], lambda r: r[0] // DAY):
            for _, ticker, price, shares in own:
                held[ticker] = (held[ticker][0] + shares if ticker in held else shares, price)
                cash -= shares * price
            nav = cash + sum(n * x for n, x in held.values())
            yield Row(portfolio_id=key[0], kind="mark", date=_date(closed), nav=nav, cash=cash, n_positions=sum(abs(n) > 1e-12 for n, _ in held.values()), ticker=None, price=None, shares=None)
        self.waiting.clear()
        if left:
            self.waiting.put(left)
            self.handle.registerTimer((left[0][0] // DAY + 1) * DAY - 1)
        self.book.update((cash, closed, list(held), [n for n, _ in held.values()], [x for _, x in held.values()]))

    def close(self) -> None:
        pass


def _date(day: int):
    from datetime import date, timedelta

    return date(1970, 1, 1) + timedelta(days=int(day))


def positions(stream: DataFrame, delay: str = "2 days") -> DataFrame:
    """A mark for each day of a book that has rows, once the day is over by the watermark, and the late rows. stream:
    portfolio_id, at (timestamp), ticker, price, shares (what is traded at the price; 0 or null for a price alone). Rows
    may come out of order by up to `delay`; a day's rows at one time are taken by ticker. Cash starts at 0, so nav is
    what trading has gained. State grows with a book's positions and open days, not with its history. Sets the session's
    state store to the one that keeps such state."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = stream.where("portfolio_id is not null and at is not null and ticker is not null and price is not null").withWatermark("at", delay)
    # without the watermark's own column the engine drops no late row before the book has seen it
    rows = rows.select("portfolio_id", F.unix_millis("at").alias("ms"), "ticker", "price", F.coalesce("shares", F.lit(0.0)).alias("shares"))
    return rows.groupBy("portfolio_id").transformWithState(statefulProcessor=Book(), outputStructType=OUT, outputMode="append", timeMode="eventTime")
