"""Registered queries of clients, integration, decisions and model evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.xs import by_name, pct_rank
from corvane.operators import backtest, decision, ml, panel, portfolio, risk, signals
from corvane.plans.panel_queries import FEATURES, _fitted, books, carried, dates_of, fundamental, held_window, lags_of, members, on_dates, quant, rounded, snapshot, style_panel, training_rows
from corvane.sources import registry, report, star
from corvane.work import cut, new_path

BOOK = ["portfolio_id", "as_of"]
CLIENTS = "portfolio_id string, objective string, risk_band int, turnover_tolerance string, preferred array<string>, income_emphasis double, esg_heavy array<string>, avoid_sectors array<string>, avoid_themes array<string>"


def clients(spark) -> DataFrame:
    """Three mandates; the careful one weighs environmental and social terms and excludes a sector's names."""
    return spark.createDataFrame([("balanced", "balanced", 3, "medium", ["EUROPE"], 0.2, None, [], ["PROMO"]), ("careful", "capital_preservation", 2, "low", ["EUROPE"], 0.2, ["ASIA"], [], ["PROMO"]), ("bold", "growth", 4, "high", ["EUROPE"], 0.2, None, [], ["PROMO"])], CLIENTS)


def mandate_terms(spark, d):
    """C4 by the clients of the star's customers: a market segment is an objective, a nation a risk band."""
    c = spark.read.parquet(f"{d}/customer.parquet")
    goal = F.when(F.col("c_nationkey") % 4 == 0, "capital_preservation").when(F.col("c_nationkey") % 4 == 1, "income").otherwise("balanced")
    rows = c.select(F.col("c_custkey").alias("client_id"), goal.alias("objective"), (F.col("c_nationkey") % 5 + 1).alias("risk_band"), F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), (F.col("c_custkey") % 3 + 1).cast("int")).alias("turnover_tolerance"))
    return rounded(risk.mandate_terms(rows))


def style_tilts(spark, d):
    """C4: tilts of the customers' objectives, with a liking for value among every third."""
    c = spark.read.parquet(f"{d}/customer.parquet")
    goal = F.element_at(F.array(*map(F.lit, ("growth", "income", "capital_preservation", "balanced"))), (F.col("c_nationkey") % 4 + 1).cast("int"))
    likes = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("client_id"), F.lit("value").alias("style"), F.lit(1.0).alias("preference"))
    return rounded(risk.style_tilts(c.select(F.col("c_custkey").alias("client_id"), goal.alias("objective")), likes))


def _fits(m: star.Market, q: DataFrame) -> DataFrame:
    """C1, C2 of each client."""
    base = snapshot(m, fields=("dividend_yield", "earnings_vol", "revenue_growth")).select("as_of", "ticker", "dividend_yield", "earnings_vol", "revenue_growth").join(by_name(q.select("as_of", "ticker", "beta")), ["as_of", "ticker"], "left").join(m.securities.select("ticker", "sector", "themes"), "ticker")
    return risk.client_fit(base, clients(m.prices.sparkSession))


def client_fit(spark, d):
    m = star.market(spark, d)
    return rounded(_fits(m, cut(quant(m), "quant")))


def alerts(spark, d):
    """R7."""
    m = star.market(spark, d)
    b = cut(books(m), "books")
    return rounded(risk.alerts(risk.concentration(b), risk.sector_exposure(b, m.securities), 0.102, 0.38, 11, 30))


def crowding(spark, d):
    """R8."""
    m = star.market(spark, d)
    c = risk.crowding(risk.style_exposure(cut(books(m), "books"), style_panel(m), list(backtest.STYLES)), list(backtest.STYLES))
    return rounded(c.withColumn("crowded", F.array_join("crowded", ",")))


def market_shock(spark, d):
    """R14."""
    m = star.market(spark, d)
    return rounded(risk.market_shock(cut(books(m), "books"), quant(m)))


def posture(spark, d):
    """E10 of every day's regime."""
    m = star.market(spark, d)
    r = backtest.classify_regime(m.benchmarks, m.breadth)
    e, cap = portfolio.posture(F.col("regime"))
    return r.select("date", "regime", e.alias("concentration"), cap.alias("position_cap"))


def book_scores(spark, d):
    """The books by another score, some names without one."""
    m = star.market(spark, d)
    s = fundamental(m).select("as_of", "ticker", F.when(F.col("ticker").cast("int") % 4 > 0, F.col("quality")).alias("score"))
    return rounded(portfolio.book_score(cut(books(m), "books"), s))


def holding_classes(spark, d):
    """E14 on the books' names; the integrated score is the mean of value and momentum."""
    m = star.market(spark, d)
    p = cut(style_panel(m), "styles").withColumn("integrated_score", (F.col("value") + F.col("momentum")) / 2)
    nxt = panel.rebalance_dates(m.traded).where("next_as_of is not null")
    old = p.join(nxt, "as_of").select(F.col("next_as_of").alias("as_of"), "ticker", F.col("integrated_score").alias("old"))
    held = cut(books(m), "books").select("as_of", "ticker").join(p, ["as_of", "ticker"]).join(old, ["as_of", "ticker"], "left")
    return rounded(portfolio.holding_classes(held).select("as_of", "ticker", "weakest", "weakest_score", "class"))


def robust_style_weights(spark, d):
    """E1."""
    m = star.market(spark, d)
    w = backtest.style_weights(_regimes(m), backtest.prior_table(spark))
    r = risk.robustness(style_panel(m), list(backtest.STYLES)).unpivot(["as_of"], list(backtest.STYLES), "style", "robustness")
    return rounded(portfolio.robust_weights(w, r))


def _regimes(m: star.Market) -> DataFrame:
    return on_dates(m, backtest.classify_regime(m.benchmarks, m.breadth)).select("as_of", "regime")


class Run:
    """The parts of a decision run over all clients and dates, made once for its passes and variants. ml_alpha (as_of,
    ticker, ml_alpha): predictions, which scores take in unless asked not to; blend: style weights take in each date's
    best template; neutral: styles are ranked against their sectors."""

    def __init__(self, spark, d, ml_alpha: DataFrame | None = None, blend: bool = True, neutral: bool = False):
        m = self.m = star.market(spark, d)
        self.lags, days = lags_of(m)
        # scores are those of a date: the rebalance dates' are among those of all days
        f, q = cut(fundamental(m, at=days), "fundamental"), cut(quant(m, at=days), "quant")
        every = cut(f.join(by_name(q), ["as_of", "ticker"]).select("as_of", "ticker", *backtest.STYLES), "styles")
        self.every = every
        panel_now = every.join(dates_of(m), "as_of", "left_semi")
        self.panel = cut(decision.sector_neutral_styles(panel_now, m.securities), "neutral") if neutral else panel_now
        now, shot = F.broadcast(dates_of(m)), cut(snapshot(m), "snapshot")  # one date a month
        f, q = f.join(now, "as_of", "left_semi"), q.join(now, "as_of", "left_semi")
        a = signals.analyst(shot).select("as_of", "ticker", "analyst")
        s = signals.compute_signals(f, q, [a]).select("as_of", "ticker", "hybrid_alpha")
        themes = m.securities.select("ticker", "sector", signals.theme_fit(F.col("themes"), ["ECONOMY", "SMALL"], ["PROMO"]).alias("theme_fit"))
        self.returns = signals._market(m.prices, m.benchmarks).select("date", "ticker", "close", "ret", "m")
        safe = risk.stock_risk(self.returns, dates_of(m)).select("as_of", "ticker", "risk_score", "tail")
        traded = risk.liquidity(m.dated.select("as_of", "ticker", "adv"), 1e4, 0.02).select("as_of", "ticker", "liquidity_score", "illiquid", "max_weight_by_liquidity")
        keys = ["as_of", "ticker"]
        names = s.join(themes, "ticker").join(by_name(safe), keys).join(by_name(traded), keys).join(by_name(shot.select(*keys, "market_cap")), keys, "left")
        self.ml = ml_alpha is not None
        self.names = cut(names.join(by_name(ml_alpha), keys) if self.ml else names, "names")
        self.shot, self.clients = shot, clients(spark)
        self.fit = cut(_fits(m, q), "fit")
        self.regimes = cut(_regimes(m), "regimes")
        self.limits = cut(decision.book_limits(self.regimes, risk.mandate_terms(self.clients)), "limits")
        best = None
        if blend:
            t = backtest.template_scores(panel_now, backtest.template_table(spark))
            seg = panel.segments(m.prices.select("date", "ticker", "close"), panel.rebalance_dates(m.traded), m.traded)
            daily = cut(backtest.segment_returns(cut(backtest.top_n(t, 10), "picks"), seg), "daily")
            best = cut(backtest.blend_of(backtest.trailing_best(daily, dates_of(m), m.traded.select("date")), backtest.template_table(spark)), "blend")
        tilts = risk.style_tilts(self.clients.withColumnRenamed("portfolio_id", "client_id"))
        self.raw = cut(backtest.style_weights(self.regimes, backtest.prior_table(spark), best, tilts).withColumnRenamed("client_id", "portfolio_id"), "raw")
        r = risk.robustness(self.panel, list(backtest.STYLES)).unpivot(["as_of"], list(backtest.STYLES), "style", "robustness")
        scaled = self.raw.join(r, ["as_of", "style"], "left").select("portfolio_id", "as_of", "style", (F.col("weight") * (0.5 + 0.5 * F.coalesce("robustness", F.lit(50.0)) / 100)).alias("weight"))
        self.weights = cut(scaled, "weights")  # means of scores don't need their sum to be 1
        self.members = cut(members(m).select("as_of", "ticker"), "members")

    def scored(self, weights: DataFrame | None = None, ml: bool | None = None) -> DataFrame:
        return decision.scored_names(self.panel, self.names, self.weights if weights is None else weights, self.fit, self.clients, self.members, self.ml if ml is None else ml)

    def books(self, tilt: float = 0.0, ml: bool | None = None) -> tuple[DataFrame, DataFrame]:
        """Scores and books after the pass that fades crowded styles."""
        first = cut(decision.books_of(self.scored(ml=ml), self.limits, tilt), "books")
        scored = cut(self.scored(decision.uncrowded(self.weights, first, self.panel), ml), "scored")
        return scored, cut(decision.books_of(scored, self.limits, tilt), "books")


def integrated_scores(spark, d):
    """E2 over all clients and dates, by priors alone."""
    return rounded(Run(spark, d, blend=False).scored().select(*BOOK, "ticker", "style_score", "integrated_score", "eligible", "ineligible_reason"))


def neutral_styles(spark, d):
    """X7 for all styles: the panel that a sector-neutral run scores."""
    m = star.market(spark, d)
    return rounded(decision.sector_neutral_styles(style_panel(m), m.securities))


def tilted_candidates(spark, d):
    """The value scores tilted by a quarter to size, and the names that they select."""
    m = star.market(spark, d)
    s = fundamental(m).select(F.lit("value").alias("portfolio_id"), "as_of", "ticker", F.col("value").alias("integrated_score")).join(snapshot(m).select("as_of", "ticker", "market_cap"), ["as_of", "ticker"]).join(m.securities.select("ticker", "sector"), "ticker")
    return rounded(portfolio.candidates(portfolio.tilted(s, 0.25), 12, 0.25).select(*BOOK, "ticker", "score", "place"))


def decision_run(spark, d):
    """Each client's decision at each rebalance date, against the candidate book of the date before."""
    run = Run(spark, d)
    scored, b = run.books()
    m, now = run.m, cut(carried(run.m, b), "carried")
    win = held_window(m, run.returns, b, now)
    quality = risk.quality_of(m.dated, run.shot)
    sure = backtest.stability(run.every, run.lags, run.raw)
    out = decision.decisions(b, now, scored, risk.book_returns(b, win), risk.book_returns(now, win), m.securities, quality, sure, run.limits)
    return rounded(out.select(*BOOK, "initial", "new_score", "old_score", "turnover", "cost", "violations", "quality", "confidence", "d_vol", "d_beta", "improvement", "trade", "blocked_by"))


def index_holdings(spark, d):
    """The decision run's books by nation."""
    run = Run(spark, d)
    scored, b = run.books()
    s = spark.read.parquet(f"{d}/supplier.parquet").select(F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("index_id"), F.col("s_suppkey").cast("string").alias("ticker"))
    return rounded(decision.index_holdings(b, scored, run.m.securities, s))


def ml_comparison(spark, d, every: int = 6, lookback_days: int | None = 1460):
    """Rule books against books with predictions of models refitted at every sixth date on the last four years,
    purged by the labels' length, and the benchmark, on the dates that have predictions."""
    m, p = star.market(spark, d), _panel(spark, d)
    folds = ml.rolling_folds(p, FEATURES, every=every, lookback_days=lookback_days)
    alpha = cut(ml.predict_folds(p, folds, FEATURES).select("as_of", "ticker", pct_rank(F.col("pred"), "as_of").alias("ml_alpha")), "alpha")
    run = Run(spark, d, alpha, blend=False)
    held = {"ml": run.books()[1], "rules": run.books(ml=False)[1]}
    names = held["ml"].select("as_of", "ticker").unionByName(held["rules"].select("as_of", "ticker")).distinct()
    seg = panel.segments(m.prices.select("date", "ticker", "close"), panel.rebalance_dates(m.traded), m.traded)
    seg = seg.join(F.broadcast(names), ["as_of", "ticker"], "left_semi")  # what books hold, bounded by their mandates; others go before rows are ordered
    w = Window.partitionBy("as_of", "ticker").orderBy("date")
    seg = seg.withColumn("ret", F.col("close") / F.lag("close").over(w) - 1).select("as_of", "date", "ticker", "ret")
    spx = m.benchmarks.where("name = 'SPX'").select("date", (F.col("level") / F.lag("level").over(Window.orderBy("date")) - 1).alias("m"))  # one row a day
    rows = cut(decision.comparison(held, seg, lambda b: carried(m, b), spx), "comparison")
    return rounded(rows.join(portfolio.verdict(rows, ["portfolio_id"]).select("portfolio_id", "delta", "verdict"), "portfolio_id"))


def rolling_models(spark, d):
    """Coefficients of each refit, a row a feature."""
    f = ml.rolling_folds(_panel(spark, d), FEATURES, every=6, lookback_days=1460)
    return rounded(f.select("fold", "first", "last", "n_train", "intercept", F.posexplode("coef").alias("i", "coef")).withColumn("feature", F.element_at(F.array(*map(F.lit, FEATURES)), F.col("i") + 1)).drop("i"))


def classifier_folds(spark, d):
    """Coefficients of each fold's classification, a row a feature."""
    f = ml.logistic_walk_forward(_panel(spark, d), FEATURES, purge=7)
    return rounded(f.select("fold", "first", "last", "n_train", "intercept", F.posexplode("coef").alias("i", "coef")).withColumn("feature", F.element_at(F.array(*map(F.lit, FEATURES)), F.col("i") + 1)).drop("i"))


def classifier_summary(spark, d):
    """The classification's information coefficients and accuracy out of sample."""
    p = _panel(spark, d)
    oos = cut(ml.classify_folds(p, ml.logistic_walk_forward(p, FEATURES, purge=7), FEATURES), "oos")
    return rounded(ml.ic_summary(ml.ic_by_date(oos, "pred"), lags=5).crossJoin(ml.accuracy(oos)))  # one row each


def _panel(spark, d) -> DataFrame:
    return cut(training_rows(star.market(spark, d)), "panel")


def holdout_split(spark, d):
    """M6: sizes of both parts, by date."""
    p = ml.holdout_split(ml.labels(star.market(spark, d).prices).join(dates_of(star.market(spark, d)), "as_of"))
    return p.groupBy("as_of", "part").agg(F.count("*").alias("n"))


def holdout_check(spark, d):
    """A specification scored once; the second call gives what the first one wrote."""
    p, log, spec = _panel(spark, d), new_path(spark, "holdout"), {"alpha": 10.0, "features": "base"}
    first = cut(ml.holdout_check(p, FEATURES, spec, "ridge", log), "first")
    return rounded(first.unionByName(ml.holdout_check(p, FEATURES, spec, "ridge", log)))


def stored_model(spark, d):
    """The final model written with its metrics and read back, a row a feature."""
    p, path = _panel(spark, d), new_path(spark, "model")
    sums = cut(ml.gram(p, FEATURES), "sums")  # a row a date
    folds = ml.walk_forward(p, FEATURES, sums=sums)
    ml.write_model(ml.final_fit(p, FEATURES, sums=sums), ml.ic_summary(ml.ic_by_date(ml.predict_folds(p, folds, FEATURES), "pred"), lags=5), path, task="regression", target="fwd_excess")
    model, about = ml.read_model(spark, path)
    return rounded(model.crossJoin(F.broadcast(about.select("mean_ic", "t_nw", "n_dates", "task", "target"))))  # one row


def ml_view(spark, d):
    """Gated and raw scores with their reasons at all dates of the panel. Three strengths of the
    model are logged as trials of one family, whose number the gate's adjustment takes."""
    p, log = _panel(spark, d), new_path(spark, "trials")
    sums = cut(ml.gram(p, FEATURES), "sums")  # a row a date
    for alpha in (1.0, 10.0, 100.0):
        ics = ml.ic_summary(ml.ic_by_date(ml.predict_folds(p, ml.walk_forward(p, FEATURES, alpha=alpha, sums=sums), FEATURES), "pred"), lags=5).first()
        registry.log_experiment(spark, log, "ridge", {"alpha": alpha}, {"mean_ic": ics.mean_ic, "t_nw": ics.t_nw})
    trials = registry.count_trials(spark, log, "ridge")
    summary = cut(ml.sidak(ml.ic_summary(ml.ic_by_date(ml.predict_folds(p, ml.walk_forward(p, FEATURES, sums=sums), FEATURES), "pred"), lags=5), trials), "summary")
    x = p.select("as_of", "ticker", *FEATURES)
    model = cut(ml.final_fit(p, FEATURES, sums=sums), "model")
    return rounded(ml.view(ml.predict(x, model, FEATURES), summary, ml.explained(x, model, ml.registry(spark), FEATURES), snapshot(star.market(spark, d))))


def published_report(spark, d):
    """Books and regimes published for all dates, the later half again with other weights, then a run that breaks off
    before it is shown: what a reader sees."""
    m = star.market(spark, d)
    b, r = cut(books(m), "books"), cut(_regimes(m), "regimes")
    folder = new_path(spark, "report")
    report.publish({"portfolio": b, "regimes": r}, folder)
    half = b.where("as_of >= date'1997-01-01'")
    report.publish({"portfolio": half.withColumn("weight", F.col("weight") / 2)}, folder)
    report.write_run({"portfolio": b.withColumn("weight", F.lit(9.0))}, folder)
    seen = report.published(spark, folder, "portfolio").join(report.published(spark, folder, "regimes"), "as_of", "left")
    return rounded(seen.select("portfolio_id", "as_of", "ticker", "weight", "regime"))


def ic_breakdowns(spark, d):
    """Of the composite `value` by year, sector and regime."""
    m = star.market(spark, d)
    p = fundamental(m).select("as_of", "ticker", F.col("value").alias("pred")).join(ml.labels(m.prices), ["as_of", "ticker"])
    p = p.join(m.securities.select("ticker", "sector"), "ticker").join(signals.macro_regime(m.benchmarks).select(F.col("date").alias("as_of"), "label"), "as_of", "left")
    p = cut(p.withColumn("year", F.year("as_of").cast("string")), "parts")
    out = None
    for kind in ("year", "sector", "label"):
        one = ml.ic_breakdown(p, kind, lags=2).withColumnRenamed(kind, "part").withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return rounded(out)


def global_explain(spark, d):
    """Every figure of every table: view, item (what the row is of), figure, value."""
    m, p = star.market(spark, d), _panel(spark, d)
    regimes = signals.macro_regime(m.benchmarks).select(F.col("date").alias("as_of"), F.col("label").alias("regime"))
    out = None
    for name, df in ml.global_explain(p, FEATURES, regimes).items():
        item = next(c for c in ("feature", "feature_group", "year", "regime") if c in df.columns)
        figures = [c for c, t in df.dtypes if t in ("double", "bigint", "int") and c != item]
        one = df.select(F.col(item).cast("string").alias("item"), *[F.col(c).cast("double").alias(c) for c in figures]).unpivot(["item"], figures, "figure", "value").withColumn("view", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return rounded(out.select("view", "item", "figure", "value"))


def evidence(spark, d):
    """Scores of all dates, drawn to 50 as far as the evidence is weak."""
    p, folds, model = _fitted(spark, d)
    summary = ml.sidak(ml.ic_summary(ml.ic_by_date(ml.predict_folds(p, folds, FEATURES), "pred"), lags=5), trials=12)
    return rounded(ml.evidence_gate(ml.predict(p.select("as_of", "ticker", *FEATURES), model, FEATURES), summary))


def fit_quality(spark, d):
    """M14."""
    p, folds, _ = _fitted(spark, d)
    return rounded(ml.fit_quality(ml.predict_folds(p, folds, FEATURES)))


def explain_families(spark, d):
    """Each name's families and its largest contributor."""
    p, _, model = _fitted(spark, d)
    local = cut(ml.contributions(p.select("as_of", "ticker", *FEATURES), model, ml.registry(spark), FEATURES), "local")
    top = ml.top_contributors(local, 1).select("as_of", "ticker", F.col("feature").alias("largest"))
    families = sorted({fam for _, fam, _ in ml.FEATURES})
    return rounded(ml.family_rollup(local, families).join(top, ["as_of", "ticker"]))


QUERIES = {f.__name__: f for f in (mandate_terms, style_tilts, client_fit, alerts, crowding, market_shock, posture, book_scores, holding_classes, robust_style_weights, integrated_scores, neutral_styles, tilted_candidates, decision_run, index_holdings, ml_comparison, rolling_models, classifier_folds, classifier_summary, holdout_split, holdout_check, stored_model, ml_view, published_report, ic_breakdowns, global_explain, evidence, fit_quality, explain_families)}
