"""Experiments, holdout checks under concurrent callers, published reports, stored models and reasons in words."""

import datetime as dt
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import ml
from corvane.sources import registry, report
from corvane.work import new_path

D = dt.date


def made_panel(spark, dates=30, names=12):
    r = np.random.default_rng(5)
    rows = [(D(2018, 1, 1) + dt.timedelta(30 * i), f"t{t}", float(x), float(z), float(x + z), float(x + z)) for i in range(dates) for t in range(names) for x, z in [r.normal(size=2)]]
    return spark.createDataFrame(rows, "as_of date, ticker string, a double, b double, fwd_return double, fwd_excess double")


def test_trials_are_counted_by_family(spark):
    folder = new_path(spark, "trials")
    assert registry.count_trials(spark, folder, "ridge") == 0
    with ThreadPoolExecutor(8) as pool:
        ids = list(pool.map(lambda i: registry.log_experiment(spark, folder, "ridge" if i % 3 else "other", {"alpha": i % 2, "z": 1}, {"t": i / 2}), range(24)))
    assert (registry.count_trials(spark, folder, "ridge"), registry.count_trials(spark, folder, "other")) == (16, 8)
    assert len(set(ids)) == 4  # two specifications in two families
    assert registry.spec_id({"z": 1, "alpha": 0}, "ridge") == registry.spec_id({"alpha": 0, "z": 1}, "ridge")
    assert sorted(r.metrics["t"] for r in registry.experiments(spark, folder).collect()) == [i / 2 for i in range(24)]


def test_one_winner_under_concurrent_callers(spark):
    folder = new_path(spark, "claims")
    with ThreadPoolExecutor(16) as pool:
        won = list(pool.map(lambda i: registry.create(spark, f"{folder}/same.json", {"i": i}), range(64)))
    assert sum(won) == 1 and registry.records(spark, folder, "i int").count() == 1


def test_two_concurrent_holdout_checks_give_one_record(spark):
    p, log = made_panel(spark), new_path(spark, "holdout")
    with ThreadPoolExecutor(2) as pool:
        rows = list(pool.map(lambda _: ml.holdout_check(p, ["a", "b"], {"x": 1}, "ridge", log).first(), range(2)))
    assert sorted(r.already_checked for r in rows) == [False, True]
    done = lambda: registry.records(spark, f"{log}/checks", ml.CHECKS).orderBy("at").collect()
    assert [r.forced for r in done()] == [False]
    again = ml.holdout_check(p, ["a", "b"], {"x": 1}, "ridge", log).first()
    first = next(r for r in rows if not r.already_checked)
    assert again.already_checked and (again.mean_ic, again.n_dates) == (first.mean_ic, first.n_dates) and first.mean_ic > 0.5
    forced = ml.holdout_check(p, ["a", "b"], {"x": 1}, "ridge", log, force=True).first()
    assert not forced.already_checked and [r.forced for r in done()] == [False, True]
    assert not ml.holdout_check(p, ["a", "b"], {"x": 1}, "other", log).first().already_checked


def test_a_broken_run_leaves_the_old_report(spark):
    folder = new_path(spark, "report")
    rows = lambda days, x: spark.createDataFrame([(D(2020, 1, d), f"t{d}", x, None) for d in days], "as_of date, ticker string, weight double, note string")
    report.publish({"portfolio": rows((1, 2, 3), 1.5), "other": rows((1,), 0.0)}, folder)
    report.publish({"portfolio": rows((2,), 2.5)}, folder)
    report.write_run({"portfolio": rows((1, 2, 3), 9.0)}, folder)  # breaks off before it is shown
    got = report.published(spark, folder, "portfolio")
    assert {(r.as_of.day, r.ticker, r.weight, r.note) for r in got.collect()} == {(1, "t1", 1.5, None), (2, "t2", 2.5, None), (3, "t3", 1.5, None)}
    assert dict(got.dtypes)["weight"] == "double" and report.published(spark, folder, "other").count() == 1


def test_a_stored_model_predicts_as_before(spark):
    p, path = made_panel(spark), new_path(spark, "model")
    model = ml.final_fit(p, ["a", "b"])
    ml.write_model(model, spark.createDataFrame([(0.5, 9)], "mean_ic double, n_dates int"), path, task="regression")
    rows, about = ml.read_model(spark, path)
    want = {(r.as_of, r.ticker): r.raw for r in ml.predict(p, model, ["a", "b"]).collect()}
    assert {(r.as_of, r.ticker): r.raw for r in ml.predict(p, rows, ["a", "b"]).collect()} == want
    assert about.first().asDict() == {"mean_ic": 0.5, "n_dates": 9, "task": "regression"}


def test_reasons_in_words(spark):
    schema = "as_of date, ticker string, feature string, family string, raw_value double, contribution double, rank_in_universe int"
    day = D(2020, 1, 1)
    local = spark.createDataFrame([
        (day, "AAA", "f_pe", "value", 90.0, 0.5, 1), (day, "AAA", "quality", "quality", 40.0, 0.2, 1), (day, "AAA", "momentum", "momentum", 10.0, -0.3, 1), (day, "AAA", "x", "odd_one", 70.0, -0.1, 1),
        (day, "BBB", "f_net_issuance", "issuance", 20.0, -0.4, 3), (day, "BBB", "f_roe", "quality", 60.0, -0.1, 3), (day, "CCC", "growth", "growth", 86.0, 0.1, 2),
    ], schema)
    facts = spark.createDataFrame([(day, "AAA", None, None, 12.34, None, None), (day, "BBB", 0.031, None, None, None, None)], "as_of date, ticker string, net_issuance double, asset_growth double, pe double, pb double, roe double")
    got = {r.ticker: r for r in ml.reasons(local, spark.createDataFrame([(0.42,)], "confidence double"), facts).collect()}
    assert got["AAA"].reason == "AAA sits in the model's top 0% (score 100). The biggest push comes from value: it's trades at 12.3x earnings (cheap on valuation). It also helps that the stock is somewhat weak on profitability (percentile 40). The drag is momentum: it's clearly in a weak price trend (percentile 10). Model confidence is only 0.42, so this view carries limited weight."
    assert got["BBB"].reason == "BBB sits in the model's bottom 0% (score 0). The drag is issuance: it's share count up 3% over the trailing year (diluting shareholders). Model confidence is only 0.42, so this view carries limited weight."
    assert got["CCC"].reason.startswith("CCC lands near the middle of the pack (score 50). The biggest push comes from growth: it's clearly growing well (percentile 86).")
    assert all(r.style_ok for r in got.values())
    off = ml.reasons(local.withColumn("ticker", F.concat(F.lit("pivot "), "ticker")), spark.createDataFrame([(0.05,)], "confidence double")).collect()
    assert not any(r.style_ok for r in off) and all("Model confidence is 0.05, so this view doesn't change the portfolio." in r.reason for r in off)


def test_view_joins_scores_and_reasons(spark):
    day = D(2020, 1, 1)
    scores = spark.createDataFrame([(day, "A", 0.2, 90.0), (day, "B", 0.1, 10.0)], "as_of date, ticker string, raw double, ml_alpha double")
    local = spark.createDataFrame([(day, "A", "value", "value", 90.0, 0.5, 1)], "as_of date, ticker string, feature string, family string, raw_value double, contribution double, rank_in_universe int")
    rows = {r.ticker: r for r in ml.view(scores, spark.createDataFrame([(2.0, 0.1)], "t_adj double, mean_ic double"), local).collect()}
    assert {t: (r.raw_score, r.score, r.confidence, r.gated_off) for t, r in rows.items()} == {"A": (90.0, 70.0, 0.5, False), "B": (10.0, 30.0, 0.5, False)}
    assert rows["A"].reason.startswith("A sits in") and rows["B"].reason is None
