"""Values that differ by rounding alone are ties, in ranks, bands and tails alike."""

import datetime as dt

from pyspark.sql import functions as F

from corvane.functions.xs import pct_rank
from corvane.operators import risk
from corvane.plans import panel_sql


def test_ranks_tie_what_differs_by_rounding(spark):
    df = spark.createDataFrame([(1, "a", 0.1 + 0.2), (1, "b", 0.3), (1, "c", 0.5), (1, "d", None)], "as_of int, ticker string, x double")
    got = df.withColumn("r", pct_rank(F.col("x"), "as_of")).collect()
    assert {r.ticker: r.r for r in got} == {"a": 50.0, "b": 50.0, "c": 100.0, "d": None}


def test_sql_ties_the_same(spark):
    import duckdb

    one = duckdb.sql(f"select ticker, {panel_sql.rank('x')} as r from (values (1, 'a', 0.1::double + 0.2::double), (1, 'b', 0.3::double), (1, 'c', 0.5::double), (1, 'd', null)) t(as_of, ticker, x)").fetchall()
    assert dict(one) == {"a": 50.0, "b": 50.0, "c": 100.0, "d": None}


def test_bands_of_names_that_differ_by_rounding_go_by_ticker(spark):
    day = dt.date(2020, 1, 1)
    moves = [0.01 * (-1) ** d + 0.001 * (d % 7) for d in range(40)]
    # d's returns are those of a but for rounding: a little less volatile, so it came first
    rows = [(day + dt.timedelta(d), t, 0.0 + (r * (1 - 1e-13) if t == "d" else r * (1 + 0.5 * (t == "b"))), r) for t in "abd" for d, r in enumerate(moves)]
    df = spark.createDataFrame(rows, "date date, ticker string, ret double, m double")
    dates = spark.createDataFrame([(day + dt.timedelta(39),)], "as_of date")
    got = {r.ticker: (r.risk_band, r.tail) for r in risk.stock_risk(df, dates).collect()}
    assert got == {"a": (1, False), "d": (3, False), "b": (5, True)}
