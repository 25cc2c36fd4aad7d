"""Rows of the market lie in buckets by ticker: what windows, dates and books take from them moves no prices."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.operators import backtest, panel, risk, signals
from corvane.plans import panel_queries as plans
from corvane.sources import star

SF = "/root/testdata/sf0.001"


def moved(df):
    """Exchanges by ticker or day in a plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.split("\n") if "Exchange hashpartitioning" in line and ("ticker" in line or "date#" in line)]


def test_windows_and_dates_move_no_prices(spark):
    m = star.market(spark, SF)
    dates = plans.dates_of(m).localCheckpoint()
    returns = signals._market(m.prices, m.benchmarks.localCheckpoint())
    assert not moved(returns)
    assert not moved(plans.on_dates(m, signals.price_features(m.prices, m.benchmarks.localCheckpoint()), dates))
    assert not moved(risk.windowed(returns, dates).groupBy("as_of", "ticker").agg(F.stddev_pop("ret")))


def test_windows_end_at_the_right_rows(spark):
    m = star.market(spark, SF)
    rows = m.prices.where("volume > 0").select("ticker", "date", "close")  # days with gaps
    dates = plans.dates_of(m)
    got = risk.windowed(rows, dates, 7).select("as_of", "ticker", "date", "i", "now")
    numbered = rows.withColumn("i", F.row_number().over(Window.partitionBy("ticker").orderBy("date")))
    at = numbered.join(dates, F.col("date") == F.col("as_of")).select("as_of", "ticker", F.col("i").alias("now"))
    want = numbered.join(at, "ticker").where("i <= now and i > now - 7").select("as_of", "ticker", "date", "i", "now")
    assert want.count() == got.count() > 0 and not want.exceptAll(got).count()


def test_template_scores_are_means_over_what_is_there(spark):
    p = spark.createDataFrame([("2020-01-01", "A", 10.0, None, None, None, None, 40.0), ("2020-01-01", "B", None, None, None, None, None, None)], "as_of string, ticker string, " + ", ".join(f"{s} double" for s in backtest.STYLES))
    t = spark.createDataFrame([("x", "value", 0.6), ("x", "quality", 0.3), ("y", "low_vol", 0.2), ("z", "growth", 1.0)], "template string, style string, w double")
    scored = backtest.template_scores(p, t)
    assert not moved(scored)
    assert {(r.template, r.ticker, round(r.score, 9)) for r in scored.collect()} == {("x", "A", 10.0), ("y", "A", 40.0)}


def test_prices_are_filled_forward_to_the_end(spark):
    days = spark.sql("select string(t) as ticker, date_add(date'1999-06-01', d) as date, cast(100 + d as decimal(28,2)) as p, cast(2 as decimal(28,2)) as q from (select 1 as t, explode(sequence(0, 30)) as d union all select 2, explode(array(0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 20, 24)))")
    own = [(r.date.day, r.date.month, r.volume) for r in star.prices(spark, "", days).where("ticker = '2'").orderBy("date").collect()]
    assert own == [(21, 6, 2.0), (22, 6, 0.0), (23, 6, 0.0), (24, 6, 0.0), (25, 6, 2.0), *[(d, 6, 0.0) for d in range(26, 31)], (1, 7, 0.0)]


def test_windows_of_books_hold_their_names_alone(spark):
    m = star.market(spark, SF)
    returns = signals._market(m.prices, m.benchmarks).select("date", "ticker", "close", "ret", "m")
    held = plans.dates_of(m).select("as_of", F.lit("3").alias("ticker"))
    got = plans.held_window(m, returns, held, held)
    want = risk.windowed(returns, plans.dates_of(m)).where("ticker = '3'").select(got.columns)
    assert got.count() == want.count() > 0 and not got.exceptAll(want).count()


def test_features_come_from_observed_prices_alone(spark):
    m = star.market(spark, SF)
    days = m.traded.where("i % 13 = 0").select(F.col("date").alias("as_of"))
    same = ["as_of", "ticker", "beta", "gbeta", "mom", "rev", "volatility"]
    rounded = lambda df, names: df.select("as_of", "ticker", *[F.round(c, 8).alias(c) for c in names])
    want = signals.price_features(m.prices, m.benchmarks, dates=days.select(F.col("as_of").alias("date"))).withColumnRenamed("date", "as_of").select(same)
    got = plans.price_features(m, days).select(same)
    pair = got.join(want.select("as_of", "ticker", *[F.col(c).alias(f"w_{c}") for c in same[2:]]), ["as_of", "ticker"], "full")
    far = lambda c: ~F.col(c).eqNullSafe(F.col(f"w_{c}")) & ~F.coalesce(F.abs(F.col(c) - F.col(f"w_{c}")) < 1e-9, F.lit(False))
    assert got.count() == want.count() == pair.count() > 0
    assert not any(pair.where(far(c)).count() for c in same[2:])
    betas = rounded(plans.price_features(m, days, betas=True), ["beta", "gbeta"])
    assert not betas.exceptAll(rounded(got, ["beta", "gbeta"])).count() and betas.count() == got.count()


def test_days_with_prices(spark):
    m = star.market(spark, SF)
    assert sorted(m.traded.select("date").collect()) == sorted(m.prices.select("date").distinct().collect())


def test_macro_fit_makes_no_price_between_observed_ones(spark):
    from corvane.plans import landed_queries

    star.forget()
    assert landed_queries.macro_fit(spark, SF).count()
    assert not {"prices", "fundamentals", "securities"} & vars(star.market(spark, SF)).keys()
