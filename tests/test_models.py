"""Models, explanations and evidence against numpy on the training panel of the smallest tables."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corvane.operators import ml, signals
from corvane.plans import decision_queries as dq
from corvane.plans import panel_queries as q
from corvane.sources import star

SF = "/root/testdata/sf0.001"
X = q.FEATURES


@pytest.fixture(scope="module")
def panel(spark):
    return q.training_rows(star.market(spark, SF)).toPandas().sort_values(["as_of", "ticker"]).reset_index(drop=True)


def ridge(p, alpha=10.0):
    x, y = p[X].to_numpy(), p.fwd_excess.to_numpy()
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd[sd < 1e-12] = 1.0
    z = (x - mean) / sd
    return np.linalg.solve(z.T @ z + alpha * np.eye(len(X)), z.T @ (y - y.mean())), y.mean(), mean, sd


def folds(p, min_train=12, splits=5, purge=1):
    dates = sorted(p.as_of.unique())
    size = max(1, math.ceil((len(dates) - min_train) / splits))
    for b in range(min_train, len(dates), size):
        train = p[p.as_of < dates[b - purge]]
        if len(train) >= 30:
            yield dates[b : b + size], ridge(train)


def test_walk_forward_equals_fold_by_fold(spark, panel):
    want = {}
    for dates, (w, icept, mean, sd) in folds(panel):
        for day in dates:
            own = panel[panel.as_of == day]
            pred = pd.Series(icept + ((own[X].to_numpy() - mean) / sd) @ w)
            want[day] = np.corrcoef(pred.rank(), own.fwd_excess.rank())[0, 1]
    got = {r.as_of: r.ic for r in q.walk_forward(spark, SF).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, abs=2e-6) for k, v in want.items())


def test_ridge_model_and_contributions(spark, panel):
    w, icept, mean, sd = ridge(panel)
    got = {r.feature: r for r in q.ridge_model(spark, SF).collect()}
    assert [got[f].coef for f in X] == pytest.approx(list(w), abs=2e-6) and got[X[0]].intercept == pytest.approx(icept, abs=2e-6)
    z = (panel[X] - mean) / sd * w
    local = {(r.as_of, r.ticker, r.feature): r.contribution for r in q.explain_local(spark, SF).collect()}
    assert len(local) == len(panel) * len(X)
    for i in (0, len(panel) // 2, len(panel) - 1):
        for f in X:
            assert local[(panel.as_of[i], panel.ticker[i], f)] == pytest.approx(z[f][i], abs=2e-6)


def test_coefficient_stability(spark, panel):
    each = np.array([w for _, (w, *_) in folds(panel)])
    got = {r.feature: r for r in q.coefficient_stability(spark, SF).collect()}
    assert [got[f].mean_coef for f in X] == pytest.approx(list(each.mean(axis=0)), abs=2e-6)
    assert [got[f].std_coef for f in X] == pytest.approx(list(each.std(axis=0)), abs=2e-6)


def test_single_feature_coefficients(spark, panel):
    got = {r.feature: r for r in q.feature_ic(spark, SF).collect()}
    for f in X:
        ics = [np.corrcoef(g[f].rank(), g.fwd_return.rank())[0, 1] for _, g in panel.groupby("as_of") if g[f].nunique() > 1]
        assert got[f].n_dates == len(ics) and got[f].mean_ic == pytest.approx(np.mean(ics), abs=2e-6)


def test_evidence_gate_follows_the_summary(spark):
    scores = spark.createDataFrame([("A", 90.0), ("B", 10.0)], "ticker string, ml_alpha double")
    for t, ic, c in ((2.0, 0.1, 0.5), (5.0, 0.1, 1.0), (5.0, -0.1, 0.0), (None, None, 0.0)):
        rows = ml.evidence_gate(scores, spark.createDataFrame([(t, ic)], "t_adj double, mean_ic double")).collect()
        assert {r.confidence for r in rows} == {c} and {r.ticker: r.gated for r in rows} == {"A": 50 + 40 * c, "B": 50 - 40 * c}


def test_holdout_is_scored_once(spark):
    a, b = sorted(dq.holdout_check(spark, SF).collect(), key=lambda r: r.already_checked)
    assert (a.already_checked, b.already_checked) == (False, True) and (a.spec_id, a.mean_ic, a.n_dates) == (b.spec_id, b.mean_ic, b.n_dates)


def test_f_score_tests_are_strict_where_they_ask_for_a_change(spark):
    cols = "as_of string, ticker string, roe double, roic double, fcf_yield double, accruals double, debt_equity double, interest_coverage double, net_issuance double, gross_margin double, revenue_growth double, asset_growth double"
    strong = ("d", "STRONG", 0.2, 0.2, 0.1, -0.1, 0.4, 9.0, -0.02, 0.5, 0.2, 0.1)
    same = ("d", "SAME", 0.1, 0.1, 0.1, -0.1, 0.5, 8.0, 0.0, 0.4, 0.1, 0.1)
    blank = ("d", "BLANK", None, None, 0.1, None, None, None, None, None, None, None)
    now = spark.createDataFrame([strong, same, blank], cols)
    prior = spark.createDataFrame([("d", t, 0.1, 0.1, 0.1, -0.1, 0.5, 8.0, 0.0, 0.4, 0.1, 0.1) for t in ("STRONG", "SAME")], cols)
    got = {r.ticker: (r.f_score, r.f_evaluated) for r in signals.piotroski(now, prior).collect()}
    assert got == {"STRONG": (9, 9), "SAME": (4, 9), "BLANK": (1, 1)}


def test_decisions_of_every_client_and_date(spark):
    """On the larger tables books can keep their mandates: some trades pass, and what blocks the others are the gates."""
    rows = dq.decision_run(spark, "/root/testdata/sf0.01").collect()
    assert {r.portfolio_id for r in rows} == {"balanced", "careful", "bold"} and sum(r.initial for r in rows) >= 3
    for r in rows:
        assert r.improvement == pytest.approx(r.new_score - (r.old_score or 0) - 100 * r.cost, abs=1e-4)
        risk = r.initial or not ((r.d_vol or 0) > 0.02 or (r.d_beta or 0) > 0.15)
        gates = {"improvement": r.initial or r.improvement >= 1.5, "mandate": r.violations == 0, "quality": r.quality != "Critical", "confidence": r.confidence >= 0.35, "risk": risk, "turnover": r.initial or r.turnover <= 0.35}
        assert r.blocked_by == ", ".join(g for g, ok in gates.items() if not ok) and r.trade == all(gates.values())
    assert all(r.turnover == pytest.approx(0.5, abs=1e-6) for r in rows if r.initial)
    assert sum(r.trade and not r.initial for r in rows) > 10
    assert {"improvement", "turnover"} <= {g for r in rows for g in r.blocked_by.split(", ")}


def test_beta_by_running_sums_equals_windows(spark):
    m = star.market(spark, SF)
    got = signals.price_features(m.prices, m.benchmarks).where("ticker = '4'").select("date", "beta", "volatility").toPandas().sort_values("date")
    raw = signals._market(m.prices, m.benchmarks).where("ticker = '4'").select("date", "ret", "m").toPandas().sort_values("date")
    for i in (60, 300, len(raw) - 1):
        own = raw.iloc[max(0, i - 251) : i + 1]
        both = own.dropna()
        want = np.cov(both.ret, both.m)[0, 1] / own.m.var(ddof=0)
        assert got.beta.iloc[i] == pytest.approx(want, rel=1e-9)
        assert got.volatility.iloc[i] == pytest.approx(raw.ret.iloc[max(0, i - 125) : i + 1].std(ddof=0) * 252**0.5, rel=1e-9)
