"""Rows of names and dates: what they need is looked up in observed prices where it lies, their ranks are made in one pass
and they never are broadcast, however small their file."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from corvane.functions.xs import by_name, pct_rank, ranks_of
from corvane.operators import backtest, decision, ml, panel, risk, signals
from corvane.plans import panel_queries as plans
from corvane.sources import star

SF = "/root/testdata/sf0.001"
KEYS = ["as_of", "ticker"]


@pytest.fixture(scope="module")
def market(spark):
    return star.market(spark, SF)


def lines(df, *words):
    return [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if all(w in x for w in words)]


def same(a, b, *cs):
    near = lambda df: df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.select(*cs).dtypes])
    a, b = near(a), near(b)
    return a.count() == b.count() > 0 and not a.exceptAll(b).count() and not b.exceptAll(a).count()


def test_features_have_no_joins_of_names_and_inputs_no_broadcasts_of_them(spark, market, monkeypatch):
    assert not lines(plans.features(market), "Join [as_of", "ticker")
    monkeypatch.setattr(plans, "cut", lambda df, label: df)
    own = plans.inputs(market)
    assert lines(own, "SortMergeJoin [as_of", "ticker") and not lines(own, "BroadcastHashJoin [as_of", "ticker")


def test_scores_of_clients_broadcast_no_names(spark):
    names = spark.createDataFrame([], "as_of date, ticker string, hybrid_alpha double, theme_fit double, risk_score double, tail boolean, liquidity_score double, illiquid boolean, max_weight_by_liquidity double, sector string, market_cap double")
    fit = spark.createDataFrame([], "portfolio_id string, as_of date, ticker string, client_fit double, hard_excluded boolean, excluded_reason string")
    small = lambda rows: spark.range(1).join(rows, F.lit(True), "left").drop("id")  # noqa: E731  not empty to the optimizer
    styles = small(spark.createDataFrame([], "as_of date, ticker string, value double, quality double, growth double, garp double, momentum double, low_vol double"))
    weights, clients = spark.createDataFrame([("a", dt.date(2020, 1, 1), "value", 1.0)], "portfolio_id string, as_of date, style string, weight double"), spark.createDataFrame([("a", 3)], "portfolio_id string, risk_band int")
    out = decision.scored_names(styles, small(names), weights, small(fit), clients, styles.select(*KEYS))
    assert not [x for x in lines(out, "BroadcastHashJoin", "ticker")]


def test_observed_prices_give_the_figures_of_all_days(spark, market):
    m, at = market, plans.dates_of(market)
    adv = plans.on_dates(m, panel.adv(m.prices))
    fwd = ml.labels(m.prices).join(at, "as_of")
    assert same(m.dated, adv, *KEYS, "close", "adv") and same(m.dated.where("fwd_return is not null"), fwd, *KEYS, "fwd_return")
    rows = risk.windowed(signals._market(m.prices, m.benchmarks), at, 60)
    assert same(risk.quality_of(m.dated, plans.snapshot(m)), risk.data_quality(rows, plans.snapshot(m)), "as_of", "missing", "stale", "outliers", "n", "coverage", "status")
    assert same(m.breadth, backtest.breadth(m.prices), "date", "breadth")


def test_prices_that_stand_still_jump_or_end(spark):
    calendar = spark.range(1, 301).select(F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("date"), F.col("id").cast("int").alias("i"))
    seen = [("7", 1, 8.0), ("7", 50, 9.0), ("4", 10, 5.0), ("4", 11, 5.0), ("4", 12, 12.0), ("4", 150, 3.0), ("5", 290, None), ("5", 292, 2.0)]
    runs = spark.createDataFrame([(t, i, c, 2.0, 120 if t == "7" else 300) for t, i, c in seen], "ticker string, i int, close double, volume double, end int")
    days = runs.select("ticker", "end", F.col("i").alias("from"), "close", "volume", F.coalesce(F.lead("i").over(plans.Window.partitionBy("ticker").orderBy("i")) - 1, "end").alias("to"))
    full = days.withColumn("i", F.explode(F.sequence("from", "to"))).where("i <= end").join(calendar, "i").select("date", "ticker", "close", F.when(F.col("i") == F.col("from"), F.col("volume")).otherwise(0.0).alias("volume"))
    at = calendar.where("i % 20 = 0 or i = 291").withColumnRenamed("date", "as_of")
    got = panel.observed(runs, at, horizon=30)
    plain = panel.adv(full).withColumnRenamed("date", "as_of").join(at, "as_of").join(ml.labels(full, 30), KEYS, "left")
    assert same(got, plain, *KEYS, "close", "adv", "fwd_return")
    rows = risk.windowed(signals._market(full, calendar.select("date", F.lit("SPX").alias("name"), F.lit(1.0).alias("level"))), at.select("as_of"), 60)
    facts = at.select("as_of", F.lit("4").alias("ticker"), F.lit(1.0).alias("pe"))
    assert same(risk.quality_of(got, facts), risk.data_quality(rows, facts), "as_of", "missing", "stale", "outliers", "n", "status")
    assert same(backtest.breadth_of(runs, calendar), backtest.breadth(full), "date", "breadth")


def test_facts_find_their_dates(spark, market):
    facts, at = market.fundamentals.select("ticker", "pub_date", "pe"), plans.dates_of(market)
    for days in (at, at.withColumn("as_of", F.date_sub("as_of", 365)), at.limit(0)):
        got = panel.as_of_dates(facts, days)
        assert not [x for x in lines(got, "Exchange hashpartitioning") if "ticker" in x]
        want = panel.as_of(facts, facts.select("ticker").distinct().join(days, how="cross"))
        assert got.count() == want.count() and not got.select(want.columns).exceptAll(want).count()


def test_ranks_from_one_column(spark):
    nan = float("nan")
    df = spark.createDataFrame([(g, i, v) for g in (1, 2) for i, v in enumerate([None, nan, 0.0, -0.0, 1.0, 1.0000000001, 0.123456785, 0.12345679, 7e8, 7e8 + 2e-7][g - 1 :])], "g int, i int, x double")
    got = ranks_of(df, {"up": ("x", True), "down": ("x", False)}, ["i"], "g")
    assert not got.exceptAll(df.select("g", "i", pct_rank(F.col("x"), "g").alias("up"), pct_rank(F.col("x"), "g", ascending=False).alias("down"))).count()
    assert len(lines(got, "Exchange hashpartitioning")) == 1


def test_reasons_of_rows_are_those_of_parts(spark):
    rows = [(dt.date(2020, 1, 1), f"t{i}", float(i * 7 % 90), float(100 - i), float(i % 3 * 40)) for i in range(12)]
    x = spark.createDataFrame(rows, "as_of date, ticker string, value double, low_vol double, size double")
    model = spark.createDataFrame([("value", 0.3, 50.0, 20.0, 0.1), ("low_vol", -0.2, 50.0, 25.0, 0.1), ("size", 0.1, 40.0, 30.0, 0.1)], "feature string, coef double, mean double, sd double, intercept double")
    wide, long = (f(x, model, ml.registry(spark), ["value", "low_vol", "size"]) for f in (ml.explained, ml.contributions))
    sure = spark.createDataFrame([(0.3,)], "confidence double")
    a, b = ml.reasons(wide, sure), ml.reasons(long, sure)
    assert a.count() == 12 and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert not lines(wide, "Exchange hashpartitioning", "ticker")
    assert by_name(x).join(x, KEYS).count() == 12


def test_style_scores_group_no_rows_of_names(spark):
    panel_rows = [(dt.date(2020, 1, 1), "A", 10.0, None, 30.0, None, None, None), (dt.date(2020, 1, 1), "B", None, None, None, None, 5.0, None), (dt.date(2020, 2, 1), "A", 1.0, 2.0, 3.0, 4.0, 5.0, 6.0), (dt.date(2020, 3, 1), "A", 1.0, 2.0, 3.0, 4.0, 5.0, 6.0)]
    styles = spark.createDataFrame(panel_rows, "as_of date, ticker string, value double, quality double, growth double, garp double, momentum double, low_vol double")
    rows = [("a", dt.date(2020, 1, 1), "value", 1.0), ("a", dt.date(2020, 1, 1), "growth", 3.0), ("a", dt.date(2020, 1, 1), "quality", 9.0), ("b", dt.date(2020, 1, 1), "momentum", 0.0), ("a", dt.date(2020, 2, 1), "value", None)]
    weights = spark.createDataFrame(rows, "portfolio_id string, as_of date, style string, weight double")
    got = decision.style_scores(styles, weights)
    long = styles.unpivot(KEYS, list(decision.STYLES), "style", "x").where("x is not null").join(weights, ["as_of", "style"])
    want = long.groupBy("portfolio_id", *KEYS).agg(F.try_divide(F.sum(F.col("x") * F.col("weight")), F.sum("weight")).alias("style_score"))
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect())) and got.count() == 3
    assert not lines(got, "Exchange hashpartitioning", "ticker")
