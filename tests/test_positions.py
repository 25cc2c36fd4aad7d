"""Position state over several micro-batches, with rows out of order and too late, against a plain walk."""

import datetime as dt

from pyspark.sql import Row
from pyspark.sql import types as T

from corvane.streaming.positions import DAY, Book, positions

SCHEMA = "portfolio_id string, at timestamp, ticker string, price double, shares double"


def at(day, hour):
    return dt.datetime(2020, 1, day, hour)


def test_marks_of_several_batches(spark, tmp_path):
    batches = [
        [("x", at(1, 10), "A", 10.0, 5.0), ("x", at(1, 12), "A", 11.0, None), ("y", at(1, 9), "B", 2.0, 100.0)],
        [("x", at(2, 15), "A", 12.0, -2.0), ("x", at(1, 14), "A", 11.5, 0.0), ("x", at(2, 9), "B", 3.0, 10.0)],  # a row of the first day comes after rows of the second
        [("x", at(6, 9), "A", 20.0, 0.0), ("y", at(6, 9), "B", 2.5, -100.0)],  # closes days 1 to 3
        [("x", at(2, 10), "A", 99.0, 1.0), ("x", at(5, 10), "B", 4.0, 0.0), ("y", at(12, 9), "B", 9.0, 0.0)],  # the first row is late
    ]
    rows, seen = str(tmp_path / "in"), []
    out = str(tmp_path / "out")
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(rows)
        stream = spark.readStream.schema(T._parse_datatype_string(SCHEMA)).parquet(rows)
        q = positions(stream, "2 days").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        seen.append(spark.read.parquet(out).count())
    got = sorted((r.portfolio_id, r.kind, r.date.day, r.nav, r.cash, r.n_positions, r.ticker, r.price) for r in spark.read.parquet(out).collect())
    assert got == [
        ("x", "late", 2, None, None, None, "A", 99.0),
        ("x", "mark", 1, -50.0 + 5 * 11.5, -50.0, 1, None, None),
        ("x", "mark", 2, -50.0 + 24 - 30 + 3 * 12 + 10 * 3, -56.0, 2, None, None),
        ("x", "mark", 5, -56.0 + 3 * 12 + 10 * 4, -56.0, 2, None, None),
        ("x", "mark", 6, -56.0 + 3 * 20 + 10 * 4, -56.0, 2, None, None),
        ("y", "mark", 1, 0.0, -200.0, 1, None, None),
        ("y", "mark", 6, 50.0, 50.0, 0, None, None),
    ]
    assert seen[1] == 0 and seen[2] == 3  # nothing is marked before its day is over


class _Handle:
    """Lists, values and maps of one key that count how often they are asked, and its timers."""

    def __init__(self):
        self.calls, self.timers, self.kept = 0, set(), {}

    def state(self, name, *schema):
        handle = self

        class State:
            def __getattr__(self, call):
                kept = handle.kept.setdefault(name, [[], None, {}])

                def run(*args):
                    handle.calls += 1
                    if name == "waiting":
                        if call == "get":
                            return iter(list(kept[0]))
                        kept[0] = {"appendList": lambda: kept[0] + args[0], "put": lambda: list(args[0]), "clear": list}[call]()
                    elif call in ("get", "exists"):
                        return kept[1] if call == "get" else kept[1] is not None
                    elif call == "update":
                        kept[1] = args[0]
                    elif call == "updateValue":
                        kept[2][args[0]] = args[1]
                    else:
                        return {"containsKey": lambda: args[0] in kept[2], "getValue": lambda: kept[2][args[0]], "iterator": lambda: list(kept[2].items())}[call]()

                return run

        return State()

    getListState = getValueState = getMapState = state

    def registerTimer(self, ms):
        self.timers.add(ms)


class _At:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms


def test_state_is_asked_once_a_book_not_once_a_day():
    row = Row("ms", "ticker", "price", "shares")
    handle, book = _Handle(), Book()
    book.init(handle)
    assert not list(book.handleInputRows(("x",), (row(d * DAY + 5, "A", 1.0 + d, 1.0) for d in range(300)), _At(0)))
    watermark, marks = 250 * DAY, []
    while due := [t for t in handle.timers if t < watermark]:
        handle.timers.remove(min(due))
        marks += book.handleExpiredTimer(("x",), _At(watermark), _At(min(due)))
    assert [(m.date - dt.date(1970, 1, 1)).days for m in marks] == list(range(250))
    assert marks[2].nav == 3 * 3.0 - (1.0 + 2.0 + 3.0) and marks[2].n_positions == 1
    assert handle.calls < 20
    late = list(book.handleInputRows(("x",), [row(9 * DAY, "A", 1.0, 1.0)], _At(watermark)))
    assert [r.kind for r in late] == ["late"]
