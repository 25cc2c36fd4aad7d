import datetime as dt

import pytest
from pyspark.sql import functions as F

from corvane.functions import perf, xs
from corvane.operators import ml, panel, portfolio, risk
from corvane.sources import files

D = dt.date


def test_pct_rank_ties_nulls_and_constant(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 1.0), (1, 3.0), (1, None), (2, 5.0), (2, 5.0)], "d int, x double")
    rows = df.withColumn("r", xs.pct_rank(F.col("x"), "d")).collect()
    assert sorted(r.r for r in rows if r.d == 1 and r.x is not None) == pytest.approx([50.0, 50.0, 100.0])
    assert [r.r for r in rows if r.x is None] == [None]
    assert [r.r for r in rows if r.d == 2] == [50.0, 50.0]


def test_blend_skips_nulls(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (2.0, 4.0)], "a double, b double")
    assert [r[0] for r in df.select(xs.blend({"a": 0.5, "b": 0.5})).collect()] == [1.0, None, 3.0]


def test_as_of_takes_whole_last_row(spark):
    facts = spark.createDataFrame([("A", D(2020, 1, 1), 1.0), ("A", D(2020, 2, 1), None), ("B", D(2021, 1, 1), 2.0)], "ticker string, pub_date date, pe double")
    grid = spark.createDataFrame([("A", D(2020, 1, 15)), ("A", D(2020, 2, 1)), ("A", D(2019, 1, 1)), ("B", D(2020, 1, 1))], "ticker string, as_of date")
    got = {(r.ticker, r.as_of): r.pe for r in panel.as_of(facts, grid).collect()}
    assert got == {("A", D(2020, 1, 15)): 1.0, ("A", D(2020, 2, 1)): None}


def test_split_factors(spark):
    rows = [("N", D(2020, i + 1, 1), v) for i, v in enumerate((600e6, 620e6, 2480e6, 24600e6))] + [("C", D(2020, i + 1, 1), v) for i, v in enumerate((1000e6, 1020e6, 990e6))]
    got = panel.split_factors(spark.createDataFrame(rows, "ticker string, date date, val double")).orderBy("ticker", "date").collect()
    assert [r.factor for r in got] == pytest.approx([1, 1, 1, 39.7, 39.7, 9.92, 1], rel=0.01)


def test_delisting_splice_imputes_failures(spark):
    daily = spark.createDataFrame([(1, D(2020, 1, 1), 10.0, None), (2, D(2020, 1, 1), 10.0, None)], "permno int, date date, prc double, ret double")
    gone = spark.createDataFrame([(1, D(2020, 1, 1), None, 574, 1), (2, D(2020, 1, 5), 0.05, 200, 1)], "permno int, dlstdt date, dlret double, dlstcd int, exchcd int")
    got = panel.total_return_index(panel.delisting_splice(daily, gone)).orderBy("permno", "date").collect()
    assert [(r.date, r.level) for r in got] == [(D(2020, 1, 1), 10.0), (D(2020, 1, 2), pytest.approx(7.0)), (D(2020, 1, 1), 10.0), (D(2020, 1, 5), pytest.approx(10.5))]


def test_first_day_loss_is_no_drawdown(spark):
    df = spark.createDataFrame([("s", D(2020, 1, 1), -0.5), ("s", D(2020, 1, 2), 0.1), ("s", D(2020, 1, 3), -0.1)], "k string, date date, ret double")
    m = perf.metrics(df, ["k"]).first()
    assert m.max_drawdown == pytest.approx(-0.1)
    assert m.total_return == pytest.approx(0.5 * 1.1 * 0.9 - 1)


def test_newey_west_is_naive_without_lags_and_sidak_lowers(spark):
    df = spark.createDataFrame([(D(2020, i + 1, 1), v) for i, v in enumerate((0.1, 0.2, 0.15, 0.3, 0.05, 0.2))], "as_of date, ic double")
    s = ml.sidak(ml.ic_summary(df), trials=10).first()
    n = 6
    assert s.t_nw == pytest.approx(s.t * (n / (n - 1)) ** 0.5)
    assert 0 < s.t_adj < s.t_nw


def test_water_fill_respects_caps(spark):
    rows = [("p", D(2020, 1, 1), f"t{i}", "a" if i < 4 else "b", 50.0 + 10 * i, (i + 1) / 36, 0.25, 0.6) for i in range(8)]
    df = spark.createDataFrame(rows, "portfolio_id string, as_of date, ticker string, sector string, score double, base double, cap double, sector_cap double")
    got = portfolio.construct(df).collect()
    assert sum(r.weight for r in got) == pytest.approx(1)
    assert max(r.weight for r in got) <= 0.25 + 1e-6
    assert sum(r.weight for r in got if r.sector == "b") <= 0.6 + 1e-3


def test_no_change_is_hold(spark):
    w = spark.createDataFrame([("p", D(2020, 1, 1), "A", 0.6), ("p", D(2020, 1, 1), "B", 0.4)], "portfolio_id string, as_of date, ticker string, weight double")
    assert {r.action for r in portfolio.trades(w, w).collect()} == {"hold"}
    assert risk.turnover(w, w).first().turnover == 0


def test_price_payloads(spark):
    a = '{"status":"ok","values":[{"datetime":"2020-01-03","close":"11","volume":""},{"datetime":"2020-01-02","close":"10","volume":"5"}]}'
    b = '{"historical":[{"date":"2020-01-02","close":10,"adjClose":9,"volume":7}]}'
    pay = spark.createDataFrame([("X", a), ("Y", '{"status":"error"}')], "ticker string, body string")
    got = files.price_payload(pay, "a").orderBy("date").collect()
    assert [(r.ticker, r.close, r.volume) for r in got] == [("X", 10.0, 5.0), ("X", 11.0, None)]
    assert files.price_payload(spark.createDataFrame([("Z", b)], "ticker string, body string"), "b").first().close == 9.0


def test_insider_trades_and_facts(spark):
    text = "".join(f"<transactionCode>{c}</transactionCode><transactionShares><value>{n}</value></transactionShares><transactionPricePerShare><value>50</value></transactionPricePerShare>" for c, n in (("P", 1000), ("S", 400)))
    r = files.insider_trades(spark.createDataFrame([("A", D(2020, 1, 1), text)], "ticker string, filed date, text string")).first()
    assert (r.buys, r.sells, r.buy_value, r.sell_value) == (1, 1, 50000.0, 20000.0)
    body = '{"entityName":"A","facts":{"us-gaap":{"Rev":{"units":{"USD":[{"fy":2020,"fp":"FY","form":"10-K","val":5,"filed":"2021-02-01","end":"2020-12-31"},{"fy":2020,"fp":"FY","form":"10-K/A","val":6,"filed":"2021-03-01","end":"2020-12-31"}]}}}}}'
    prio = spark.createDataFrame([("revenue", "Sales", 0, "USD"), ("revenue", "Rev", 1, "USD")], "measure string, concept string, prio int, unit string")
    facts = files.company_facts(spark.createDataFrame([("1", body)], "cik string, body string"), prio)
    assert [r.val for r in files.annual_series(facts).collect()] == [6.0]


def test_bootstrap_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame([("p", D(2020, 1, 1), D(2020, 1, 1) + dt.timedelta(i), 0.01 * ((i * 7) % 5 - 2)) for i in range(60)], "portfolio_id string, as_of date, date date, ret double")
    a, b = risk.bootstrap(df, 50, 20).first(), risk.bootstrap(df.repartition(7), 50, 20).first()
    assert a.p05 == pytest.approx(b.p05) and a.p05 <= a.p50 <= a.p95
