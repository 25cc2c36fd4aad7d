"""What is ranked, thinned or looked up lies or moves once: plans at a date's whole cross-section, at all days' prices and
at companies by dates."""

import datetime as dt

from pyspark.sql import functions as F

from corvane.functions.xs import pct_rank, ranked
from corvane.operators import panel, risk, signals
from corvane.plans import panel_queries as plans
from corvane.sources import files, star

SF = "/root/testdata/sf0.001"


def steps(df, name):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if f"{name} " in line or line.strip(" :+-").startswith(name)]


def test_scores_of_a_date_hold_no_window_for_each_rank(spark):
    facts = plans.snapshot(star.market(spark, SF)).localCheckpoint()
    scores = signals.fundamental_scores(facts)
    assert not steps(scores, "Window")
    assert len([s for s in steps(scores, "Exchange hashpartitioning") if "as_of" in s]) == 1
    assert scores.count() == facts.count()


def test_ranks_made_together_are_those_of_windows(spark):
    nan, inf = float("nan"), float("inf")
    values = [None, nan, 0.0, -0.0, 1.0, 1.0, 0.1 + 0.2, 0.3, inf, -inf, 2.0]
    rows = [(g, i, v) for g in range(3) for i, v in enumerate(values[g:])] + [(7, 0, None), (8, 0, 3.0), (9, 0, nan), (9, 1, nan), (None, 0, 1.0), (None, 1, 2.0)]
    df = spark.createDataFrame(rows, "g int, i int, x double")
    got = ranked(df, {"up": (F.col("x"), True), "down": (F.col("x"), False)}, "g").select("g", "i", "up", "down")
    want = df.select("g", "i", pct_rank(F.col("x"), "g").alias("up"), pct_rank(F.col("x"), "g", ascending=False).alias("down"))
    assert got.count() == len(rows) and not want.exceptAll(got).count()


def test_days_between_dates_are_left_where_prices_lie(spark):
    m = star.market(spark, SF)
    ends = panel.month_ends(m.prices).localCheckpoint()
    prices = m.prices.select("ticker", F.col("date").alias("pub_date"), "close")
    grid = m.prices.select("ticker").distinct().join(ends, how="cross")
    few = panel.thinned(prices, ends)
    assert not [s for s in steps(few, "Exchange hashpartitioning") if "ticker" in s]
    assert few.count() * 15 < prices.count()
    want, got = panel.as_of(prices, grid), panel.as_of(few, grid)
    assert want.count() == got.count() > 0 and not want.exceptAll(got).count()


def test_years_of_a_company_move_without_its_dates(spark):
    day = dt.date
    rows = [("1", "revenue", 2000, 5.0, "2001-03-01"), ("1", "revenue", 2001, 7.0, "2002-03-01"), ("1", "revenue", 1999, 9.0, "2002-06-01"), ("1", "assets", 2001, 3.0, "2002-03-01"), ("2", "assets", 1998, 1.0, None)]
    series = spark.createDataFrame(rows, "cik string, measure string, fy int, val double, filed string").withColumn("filed", F.to_date("filed"))
    grid = spark.createDataFrame([("1", day(2001, 2, 28)), ("1", day(2001, 3, 1)), ("1", day(2002, 7, 1)), ("2", day(1990, 1, 1)), ("3", day(2002, 1, 1))], "cik string, as_of date")
    out = files.annual_pair(series, grid)
    assert not steps(out, "Window")
    assert not [s for s in steps(out, "Exchange hashpartitioning") if "as_of" in s and "cik" not in s]
    assert sorted(map(tuple, out.collect())) == [("1", day(2001, 3, 1), "revenue", 5.0, None), ("1", day(2002, 7, 1), "assets", 3.0, None), ("1", day(2002, 7, 1), "revenue", 7.0, 5.0), ("2", day(1990, 1, 1), "assets", 1.0, None)]


def test_risk_of_dates_is_made_where_a_tickers_rows_lie(spark):
    m = star.market(spark, SF)
    dates = plans.dates_of(m).localCheckpoint()
    returns = signals._market(m.prices, m.benchmarks.localCheckpoint()).where("volume > 0 or ticker = '3'")  # days with gaps
    made = risk.stock_risk(returns, dates)
    assert not [x for x in steps(made, "Exchange hashpartitioning") if "ticker" in x]
    assert not steps(made, "Generate")
    near = lambda df, cs: df.select("as_of", "ticker", *[F.round(c, 8).alias(c) for c in cs])
    rows = risk.windowed(returns, dates, 31).where("i > now - 30 and i > 1")  # 30 returns of 31 prices
    plain = rows.groupBy("as_of", "ticker").agg((F.stddev_pop("ret") * 252**0.5).alias("vol"))
    want, got = near(plain.where("vol is not null"), ["vol"]), near(risk.stock_risk(returns, dates, 30).where("vol is not null"), ["vol"])
    assert want.count() == got.count() > 0 and not want.exceptAll(got).count()
