"""Security and portfolio risk, data quality, mandates and client fit."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.perf import correlation
from corvane.functions.xs import blend, by_name, clipped, pct_rank, ranked

STYLES = ("value", "quality", "growth", "garp", "momentum", "low_vol")
# fixed values: the house's caps, turnover by tolerance, and style multipliers by objective
HOUSE = {"position": 0.08, "target": 0.05, "sector": 0.25, "turnover": 0.35}
TURNOVER = {"low": 0.15, "medium": 0.30, "high": 0.50}
OBJECTIVE_TILTS = {
    "growth": {"growth": 1.3, "garp": 1.15, "momentum": 1.1, "income": 0.7},
    "income": {"income": 1.4, "quality": 1.15, "low_vol": 1.1, "growth": 0.7},
    "capital_preservation": {"low_vol": 1.4, "quality": 1.25, "value": 1.1, "momentum": 0.7, "growth": 0.75},
}
ON = "as_of"
BOOK = ["portfolio_id", "as_of"]


def windowed(returns: DataFrame, dates: DataFrame, window: int = 252) -> DataFrame:
    """returns (date, ticker, close, ret, m) of the last `window` rows before each as_of, with their number i and that of
    as_of, now. Each row lists the dates that it counts for, a stretch of its ticker's dates: running counts of them tell
    where the stretch begins and ends, so rows meet dates where they lie, without a join of rows."""
    w = Window.partitionBy("ticker").orderBy("date")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = returns.join(F.broadcast(dates.select("as_of", F.col("as_of").alias("__at")).distinct()), F.col("date") == F.col("as_of"), "left").drop("as_of")  # one date a month
    rows = marked.withColumn("i", F.row_number().over(w)).withColumn("__n", F.count("__at").over(w))
    rows = rows.withColumns({"__all": F.collect_list(F.when(F.col("__at").isNotNull(), F.struct(F.col("__at").alias("as_of"), F.col("i").alias("now")))).over(whole), "__to": F.lead("__n", window - 1).over(w)})
    begun = F.col("__n") - F.col("__at").isNotNull().cast("int")
    own = F.slice("__all", (begun + 1).cast("int"), (F.coalesce("__to", F.size("__all")) - begun).cast("int"))
    return rows.withColumn("__own", own).withColumn("__a", F.explode("__own")).select("__a.as_of", "ticker", *[c for c in returns.columns if c != "ticker"], "i", "__a.now")


def _figures(window: int):
    """Of one ticker's rows, those of `at` being asked for: figures of the last `window` rows up to each, but the first."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("date")
        asked = np.flatnonzero(rows.column("at").to_numpy())
        known, x = {}, {}
        for c in ("ret", "m"):
            col = rows.column(c).combine_chunks()
            pad = lambda a: np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(window - 2, a.dtype), a]), window - 1)[asked]  # noqa: E731  a window's first row has no say
            own = col.is_valid().to_numpy(zero_copy_only=False)
            own[:1] = False
            known[c], x[c] = pad(own), pad(col.fill_null(0.0).to_numpy(zero_copy_only=False))
        r, m, k, km = x["ret"], x["m"], known["ret"], known["m"]
        both = k & km

        def spread(a, b, on):
            n = on.sum(axis=1)
            mean = lambda v: (np.where(on, v, 0.0).sum(axis=1) / np.maximum(n, 1))[:, None]
            return n, (np.where(on, (a - mean(a)) * (b - mean(b)), 0.0)).sum(axis=1)

        n, ss = spread(r, r, k)
        nb, rm = spread(r, m, both)
        nm, mm = spread(m, m, km)
        flat = np.where(km, m, -np.inf).max(axis=1) == np.where(km, m, np.inf).min(axis=1)
        still = np.where(k, r, -np.inf).max(axis=1) == np.where(k, r, np.inf).min(axis=1)
        curve = np.cumprod(np.where(k, 1 + r, 1.0), axis=1)
        dd = curve / np.maximum.accumulate(np.where(k, curve, -np.inf), axis=1) - 1
        var, some = np.where(flat, 0.0, mm / np.maximum(nm, 1)), n > 0
        beta = (rm / np.maximum(nb - 1, 1)) / np.where(var == 0, 1.0, var)
        out = {"vol": (np.where(still, 0.0, np.sqrt(ss / np.maximum(n, 1))) * 252**0.5, some), "beta": (beta, (nb > 1) & (var != 0)), "mdd": (np.where(k, dd, np.inf).min(axis=1), some), "dd_freq": ((k & (dd < -0.10)).sum(axis=1) / np.maximum(n, 1), some)}
        own = rows.take(pa.array(asked))
        return pa.table({"as_of": own.column("date"), "ticker": own.column("ticker"), **{c: pa.array(v, mask=~ok) for c, (v, ok) in out.items()}, "n": pa.array(n.astype(np.int64))})

    return run


def stock_risk(returns: DataFrame, dates: DataFrame, window: int = 252) -> DataFrame:
    """Volatility, beta, drawdown of the compounded returns and how often it is deep, over the last `window` returns;
    safety score, band of five by volatility and tail flag."""
    at = F.broadcast(dates.select("as_of").distinct())  # one date a month
    rows = returns.select("date", "ticker", "ret", "m").join(at, F.col("date") == F.col("as_of"), "left").select("date", "ticker", "ret", "m", F.col("as_of").isNotNull().alias("at"))
    # window + 1 prices give window returns; a ticker's rows stay where they lie, a row for each date is all that leaves
    types = dict(returns.dtypes)
    df = rows.groupBy("ticker").applyInArrow(_figures(window + 1), f"as_of {types['date']}, ticker {types['ticker']}, vol double, beta double, mdd double, dd_freq double, n long")
    df = df.withColumn("beta", F.when(F.col("beta").isNull() | F.isnan("beta") | (F.col("n") < 30), 1.0).otherwise(F.col("beta")))
    df = ranked(df, {"r_vol": (F.col("vol"), False), "r_mdd": (F.col("mdd"), True), "r_freq": (F.col("dd_freq"), False)}, ON)
    df = df.withColumn("risk_score", blend({"r_vol": 0.5, "r_mdd": 0.3, "r_freq": 0.2}))
    place = F.row_number().over(Window.partitionBy(ON).orderBy(F.round("vol", 8).asc_nulls_last(), "ticker"))  # the band's edges are quintiles of the places
    n = F.count("vol").over(Window.partitionBy(ON))
    whole = n == F.count("*").over(Window.partitionBy(ON))  # with a name of unknown volatility all are in the middle
    band = F.when(whole & (n > 1), F.greatest(F.lit(1), F.ceil(5 * (place - 1) / (n - 1)))).otherwise(3)
    df = df.withColumn("risk_band", band.cast("int"))
    return df.withColumn("tail", F.coalesce((F.round("vol", 8) > F.percentile(F.round("vol", 8), F.lit(0.85)).over(Window.partitionBy(ON))) | (F.col("mdd") < -0.40), F.lit(False))).select(ON, "ticker", "vol", "beta", "mdd", "dd_freq", "risk_score", "risk_band", "tail")


def liquidity(df: DataFrame, portfolio_value: float = 1e8, min_weight: float = 0.01) -> DataFrame:
    """R2 on (as_of, ticker, adv)."""
    safe = 0.10 * F.col("adv")
    df = df.withColumn("liquidity_score", pct_rank(F.col("adv"), ON)).withColumn("max_safe_trade", safe).withColumn("max_weight_by_liquidity", F.least(F.lit(1.0), safe / portfolio_value))
    return df.withColumn("illiquid", F.col("max_weight_by_liquidity") < min_weight)


def concentration(weights: DataFrame) -> DataFrame:
    """R3, R17 over positive weights."""
    w = weights.where("weight > 0").withColumn("k", F.row_number().over(Window.partitionBy(*BOOK).orderBy(F.desc("weight"), "ticker")))
    return w.groupBy(*BOOK).agg(F.max("weight").alias("top1"), F.sum(F.when(F.col("k") <= 5, F.col("weight"))).alias("top5"), F.sum(F.col("weight") ** 2).alias("hhi"), (1 / F.sum(F.col("weight") ** 2)).alias("effective_n"), F.count("*").alias("n_positions"), (-F.max("weight")).alias("worst_single"))


def sector_exposure(weights: DataFrame, securities: DataFrame) -> DataFrame:
    """R4."""
    return weights.join(securities.select("ticker", "sector"), "ticker", "left").groupBy(*BOOK, "sector").agg(F.sum("weight").alias("exposure"))


def style_exposure(weights: DataFrame, scores: DataFrame, styles: list[str]) -> DataFrame:
    """Weighted means, a missing score counting as 50."""
    df = weights.join(by_name(scores), ["as_of", "ticker"], "left")
    return df.groupBy(*BOOK).agg(*[(F.sum(F.col("weight") * F.coalesce(s, F.lit(50.0))) / F.sum("weight")).alias(s) for s in styles])


def book_returns(weights: DataFrame, returns: DataFrame) -> DataFrame:
    """Daily returns of fixed-weight books; a null return contributes 0. returns: as_of, date, ticker, ret, m."""
    return weights.join(returns, ["as_of", "ticker"]).groupBy(*BOOK, "date").agg(F.sum(F.coalesce(F.col("weight") * F.col("ret"), F.lit(0.0))).alias("ret"), F.max("m").alias("m"))


def portfolio_risk(daily: DataFrame) -> DataFrame:
    """R6."""
    pair = F.when(F.col("m").isNotNull(), F.col("ret"))
    beta = F.try_divide(F.covar_samp(pair, "m"), F.var_pop("m"))
    return daily.groupBy(*BOOK).agg((F.stddev_pop("ret") * 252**0.5).alias("vol"), F.when(F.count("ret") > 20, beta).otherwise(1.0).alias("beta"), F.count("*").alias("n_days"))


def alerts(conc: DataFrame, sectors: DataFrame, position_cap: float = 0.08, sector_cap: float = 0.25, least: int = 20, most: int = 30) -> DataFrame:
    """One row for each breach: too few or too many names, the largest position, each sector over its cap."""
    row = lambda df, test, what, x: df.where(test).select(*BOOK, F.lit(what).alias("alert"), x.cast("double").alias("amount"))
    n = F.col("n_positions")
    out = row(conc, n < least, "few holdings", n).unionByName(row(conc, n > most, "many holdings", n))
    return out.unionByName(row(conc, F.col("top1") > position_cap + 1e-9, "position", F.col("top1"))).unionByName(row(sectors, F.col("exposure") > sector_cap + 1e-9, "sector", F.col("exposure")))


def crowding(exposures: DataFrame, styles: list[str]) -> DataFrame:
    """R8."""
    flags = F.filter(F.array(*[F.when(F.col(s) > 70, F.lit(s)) for s in styles]), lambda x: x.isNotNull())
    return exposures.select(*BOOK, flags.alias("crowded"), clipped(100 - 2 * F.greatest(F.col("momentum") - 50, F.lit(0.0))).alias("crowding_score"))


def turnover(target: DataFrame, previous: DataFrame, cost_bps: float = 9.0) -> DataFrame:
    """One-way turnover, cost and score of moving from previous to target."""
    both = target.select(*BOOK, "ticker", F.col("weight").alias("w1")).join(previous.select(*BOOK, "ticker", F.col("weight").alias("w0")), [*BOOK, "ticker"], "full")
    gap = F.sum(F.abs(F.coalesce("w1", F.lit(0.0)) - F.coalesce("w0", F.lit(0.0))))
    out = both.groupBy(*BOOK).agg((gap / 2).alias("turnover"), (gap * cost_bps / 1e4).alias("cost"))
    return out.withColumn("turnover_score", clipped(100 * (1 - F.col("turnover") / 0.5)))


def robustness(scores: DataFrame, styles: list[str]) -> DataFrame:
    """R10."""
    return scores.groupBy(ON).agg(*[(100 * (0.5 * F.avg(F.col(s).isNotNull().cast("double")) + 0.5 * F.least(F.coalesce(F.stddev_pop(s), F.lit(0.0)) / 20, F.lit(1.0)))).alias(s) for s in styles])


def data_quality(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """R11 over windowed rows (as_of, ticker, close, ret); facts: as-of rows, all of whose fields count for coverage."""
    return quality_of(rows.groupBy(ON, "ticker").agg(F.avg(F.col("close").isNull().cast("double")).alias("missing"), ((F.count_distinct("close") <= 1) & (F.count("close") > 1)).alias("stale"), F.max(F.abs("ret")).alias("move")), facts)


def quality_of(names: DataFrame, facts: DataFrame) -> DataFrame:
    """R11 over a row a name and date (as_of, missing, stale, move), see panel.observed."""
    per = names.select(ON, "missing", "stale", (F.col("move") > 0.5).alias("outlier"))
    out = per.groupBy(ON).agg(F.avg("missing").alias("missing"), F.sum(F.col("stale").cast("int")).alias("stale"), F.sum(F.coalesce("outlier", F.lit(False)).cast("int")).alias("outliers"), F.count("*").alias("n"))
    fields = [c for c in facts.columns if c not in (ON, "ticker", "pub_date")]
    cover = facts.groupBy(ON).agg((sum((F.count(c) for c in fields), F.lit(0)) / (F.count("*") * len(fields))).alias("coverage"))
    out = out.join(cover, ON, "left").withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))
    bad = (F.col("missing") > 0.10) | (F.col("coverage") < 0.6) | (F.col("stale") > 0.2 * F.greatest(F.col("n"), F.lit(1)))
    warn = (F.col("missing") > 0.02) | (F.col("stale") > 0) | (F.col("outliers") > 0) | (F.col("coverage") < 0.9)
    return out.withColumn("status", F.when(bad, "Critical").when(warn, "Warning").otherwise("OK"))


def mandate_violations(weights: DataFrame, securities: DataFrame, terms: DataFrame, least: int = 20, most: int = 30, tol: float = 1e-6) -> DataFrame:
    """One row for each rule that a book breaks. terms: portfolio_id, as_of where they change with it, position_cap,
    sector_cap, and, where the client excludes any, avoid_sectors and avoid_themes (arrays of strings). Weights within
    tol of 0 don't count."""
    kinds = ("avoid_sectors", "avoid_themes")
    terms = terms.withColumns({c: F.array().cast("array<string>") for c in kinds if c not in terms.columns})
    keys = [k for k in BOOK if k in terms.columns]
    w = weights.where(F.abs("weight") > tol).join(securities.select("ticker", "sector", *[c for c in ("themes",) if c in securities.columns]), "ticker", "left")
    w = w.join(terms.select(*keys, "position_cap", "sector_cap", *kinds), keys)
    themes = F.coalesce("themes", F.array().cast("array<string>")) if "themes" in w.columns else F.array().cast("array<string>")
    avoided = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    hit = lambda test: F.max(F.coalesce(test, F.lit(False)))
    x = F.col("weight")
    book = w.groupBy(*BOOK).agg((F.min(x) < -tol).alias("short"), (F.sum(x) > 1 + 1e-4).alias("gross"), (~F.count("*").between(least, most)).alias("holdings"), hit(x > F.col("position_cap") + 1e-6).alias("position cap"), hit(F.array_contains(avoided(F.col("avoid_sectors")), F.col("sector"))).alias("excluded sector"), hit(F.arrays_overlap(themes, avoided(F.col("avoid_themes")))).alias("excluded theme"))
    sectors = w.groupBy(*BOOK, "sector", "sector_cap").agg(F.sum(x).alias("e")).where(F.col("e") > F.col("sector_cap") + 1e-6).select(*BOOK).distinct()
    rules = ["short", "gross", "holdings", "position cap", "excluded sector", "excluded theme"]
    broken = book.select(*BOOK, F.explode(F.filter(F.array(*[F.when(F.col(f"`{r}`"), F.lit(r)) for r in rules]), lambda r: r.isNotNull())).alias("rule"))
    return broken.unionByName(sectors.withColumn("rule", F.lit("sector cap")))


def historical_stress(weights: DataFrame, returns: DataFrame, windows: DataFrame) -> DataFrame:
    """Fixed-weight books through named windows (scenario, start, end); weights of names with data are rescaled."""
    from corvane.functions.perf import metrics

    r = returns.join(windows, F.col("date").between(F.col("start"), F.col("end")))
    j = weights.join(r.select("scenario", "date", "ticker", "ret", "m"), "ticker").where(F.col("ret").isNotNull())
    daily = j.groupBy(*BOOK, "scenario", "date").agg((F.sum(F.col("weight") * F.col("ret")) / F.sum("weight")).alias("ret"), F.max("m").alias("m"), F.sum("weight").alias("covered"))
    keys = [*BOOK, "scenario"]
    own = metrics(daily, keys).select(*keys, "total_return", "max_drawdown")
    bench = metrics(daily.drop("ret").withColumnRenamed("m", "ret"), keys).select(*keys, F.col("max_drawdown").alias("benchmark_drawdown"))
    return own.join(bench, keys, "left").join(daily.groupBy(*keys).agg(F.avg("covered").alias("coverage")), keys)


def market_shock(weights: DataFrame, risk: DataFrame, shock: float = -0.2) -> DataFrame:
    """R14."""
    return weights.join(risk.select("as_of", "ticker", "beta"), ["as_of", "ticker"], "left").groupBy(*BOOK).agg((F.sum(F.col("weight") * F.coalesce("beta", F.lit(1.0))) * shock).alias("impact"))


def rate_shock(weights: DataFrame, facts: DataFrame, bps: float = 100.0) -> DataFrame:
    """Duration 2 to 10 by rank of pe within the book."""
    df = weights.join(facts.select("as_of", "ticker", "pe"), ["as_of", "ticker"], "left")
    rank = F.coalesce(pct_rank(F.col("pe"), *BOOK) / 100, F.lit(0.5))
    return df.withColumn("__d", 2 + 8 * rank).groupBy(*BOOK).agg((-bps / 1e4 * F.sum(F.col("weight") * F.col("__d"))).alias("impact"))


def average_correlation(returns: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of the upper triangle; pairs exist within one book and date only, whose size is bounded by its mandate."""
    a, b = returns.alias("a"), returns.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*keys, "date"]] + [F.col("a.ticker") < F.col("b.ticker")]
    pairs = a.join(b, on).groupBy(*[F.col(f"a.{k}").alias(k) for k in keys], F.col("a.ticker").alias("t1"), F.col("b.ticker").alias("t2")).agg(correlation(F.when(F.col("b.ret").isNotNull(), F.col("a.ret")), F.when(F.col("a.ret").isNotNull(), F.col("b.ret"))).alias("c"))
    return pairs.groupBy(*keys).agg(F.avg("c").alias("avg_corr"), F.count("c").alias("n_pairs"))


def bootstrap(daily: DataFrame, n_sims: int = 1000, horizon: int = 126, block: int = 5, seed: int = 7) -> DataFrame:
    """Block bootstrap of each book's daily returns (portfolio_id, as_of, date, ret). Starts come from a hash of
    (seed, simulation, block), so results don't depend on the partitioning."""
    spark = daily.sparkSession
    w = Window.partitionBy(*BOOK).orderBy("date")
    r = daily.withColumn("i", F.row_number().over(w) - 1)
    sizes = r.groupBy(*BOOK).agg(F.count("*").alias("n")).where(F.col("n") > block)
    draws = spark.range(n_sims).withColumnRenamed("id", "sim").withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))))
    draws = sizes.join(draws, how="cross")  # the stated simulations of each book: n_sims * horizon rows a book
    start = F.pmod(F.xxhash64(F.lit(seed), "sim", F.floor(F.col("day") / block)), F.col("n") - block + 1)
    paths = draws.withColumn("i", (start + F.col("day") % block).cast("int")).join(r.select(*BOOK, "i", "ret"), [*BOOK, "i"])
    so_far = Window.partitionBy(*BOOK, "sim").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    paths = paths.withColumn("nav", F.product(1 + F.col("ret")).over(so_far)).withColumn("dd", F.col("nav") / F.greatest(F.max("nav").over(so_far), F.lit(1.0)) - 1)
    ends = paths.groupBy(*BOOK, "sim").agg((F.product(1 + F.col("ret")) - 1).alias("total"), F.min("dd").alias("mdd"))
    out = ends.groupBy(*BOOK).agg(F.percentile("total", F.array(*map(F.lit, (0.05, 0.25, 0.5, 0.75, 0.95)))).alias("q"), F.avg((F.col("total") < 0).cast("double")).alias("p_loss"), F.percentile("mdd", F.lit(0.5)).alias("mdd_median"), F.percentile("mdd", F.lit(0.05)).alias("mdd_p05"), F.count("*").alias("n_sims"))
    tail = ends.join(out.select(*BOOK, F.col("q")[0].alias("v")), BOOK).where("total <= v").groupBy(*BOOK).agg((-F.avg("total")).alias("cvar95"))
    cols = [F.col("q")[i].alias(n) for i, n in enumerate(("p05", "p25", "p50", "p75", "p95"))]
    return out.join(tail, BOOK).select(*BOOK, *cols, (-F.col("q")[0]).alias("var95"), "cvar95", "p_loss", "mdd_median", "mdd_p05", "n_sims")


def exclusions(securities: DataFrame, avoid_sectors: list[str], avoid_themes: list[str]) -> DataFrame:
    """C1 of one client."""
    lits = F.array(*map(F.lit, avoid_themes)).cast("array<string>")
    sector = F.col("sector").isin(*avoid_sectors) if avoid_sectors else F.lit(False)
    reason = F.when(sector, F.concat(F.lit("sector: "), "sector")).when(F.arrays_overlap("themes", lits), F.concat(F.lit("theme: "), F.array_join(F.array_intersect("themes", lits), ", ")))
    return securities.withColumn("excluded_reason", reason).withColumn("hard_excluded", reason.isNotNull())


def client_fit(df: DataFrame, clients: DataFrame) -> DataFrame:
    """C1, C2 for every client: df (as_of, ticker, sector, themes, dividend_yield, earnings_vol, beta, revenue_growth) by
    clients (portfolio_id, risk_band, income_emphasis, and the arrays preferred, avoid_sectors, avoid_themes and
    esg_heavy, null where a client has none): portfolio_id, as_of, ticker, client_fit, hard_excluded, excluded_reason.
    Ranks are those of a date, made once for all clients; the rows are one for each client and name."""
    ranks = {"__yield": (F.col("dividend_yield"), True), "__safe": (F.col("earnings_vol"), False), "__low": (F.col("beta"), False), "__grow": (F.col("revenue_growth"), True)}
    df = ranked(df, ranks, ON).select(ON, "ticker", "sector", "themes", *ranks).join(F.broadcast(clients), how="cross")  # few: each has a row for every name and date
    none = F.array().cast("array<string>")
    has = lambda c, x: F.coalesce(F.array_contains(c, F.col(x)), F.lit(False))
    shared = F.array_intersect(F.coalesce("themes", none), F.coalesce("avoid_themes", none))
    reason = F.when(has("avoid_sectors", "sector"), F.concat(F.lit("sector: "), "sector")).when(F.size(shared) > 0, F.concat(F.lit("theme: "), F.array_join(shared, ", ")))
    gain = lambda c, k: F.coalesce(k * (F.col(c) - 50), F.lit(0.0))
    band = F.col("risk_band")
    fit = 50 + F.when(has("preferred", "sector"), 12.0).otherwise(0.0) + gain("__yield", F.col("income_emphasis") * 0.20)
    fit = fit + F.when(band <= 2, gain("__safe", 0.15) + gain("__low", 0.10)).otherwise(0.0) + F.when(band >= 4, gain("__grow", 0.15)).otherwise(0.0)
    fit = fit + F.when(F.col("esg_heavy").isNull(), 0.0).when(has("esg_heavy", "sector"), -8.0).otherwise(3.0)
    return df.withColumn("excluded_reason", reason).withColumn("hard_excluded", reason.isNotNull()).select(*BOOK, "ticker", F.when(F.col("hard_excluded"), 0.0).otherwise(clipped(fit)).alias("client_fit"), "hard_excluded", "excluded_reason")


def mandate_terms(clients: DataFrame) -> DataFrame:
    """C4: the caps of each client (client_id, objective, risk_band, turnover_tolerance), the tighter of the house's and
    those of its risk, objective and tolerance."""
    careful, keep = F.col("risk_band") <= 2, F.col("objective") == "capital_preservation"
    position = F.least(F.lit(HOUSE["position"]), F.when(careful, 0.06), F.when(keep, 0.05))
    return clients.withColumns({
        "position_cap": position,
        "target_cap": F.least(F.lit(HOUSE["target"]), F.when(careful, 0.04)),
        "sector_cap": F.least(F.lit(HOUSE["sector"]), F.when(careful, 0.20)),
        "turnover_cap": F.least(F.lit(HOUSE["turnover"]), *[F.when(F.col("turnover_tolerance") == t, x) for t, x in TURNOVER.items()]),
    })


def style_tilts(clients: DataFrame, preferences: DataFrame | None = None) -> DataFrame:
    """C4: client_id, style, tilt: what the objective multiplies a style's weight by, times 0.6 + 0.8 * preference
    (0.5 where none of preferences (client_id, style, preference) is given)."""
    rows = clients.sparkSession.createDataFrame([(o, s, x) for o, own in OBJECTIVE_TILTS.items() for s, x in own.items()], "objective string, style string, __o double")
    every = clients.select("client_id", "objective", F.explode(F.array(*map(F.lit, STYLES))).alias("style")).join(rows, ["objective", "style"], "left")
    if preferences is not None:
        every = every.join(preferences.select("client_id", "style", "preference"), ["client_id", "style"], "left")
    liking = F.coalesce("preference", F.lit(0.5)) if preferences is not None else F.lit(0.5)
    return every.select("client_id", "style", (F.coalesce("__o", F.lit(1.0)) * (0.6 + 0.8 * liking)).alias("tilt"))
