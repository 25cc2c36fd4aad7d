"""Score integration, constrained construction and trade decisions, keyed by portfolio and date."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.xs import blend, clipped, pct_rank

BOOK = ["portfolio_id", "as_of"]


def robust_weights(weights: DataFrame, robust: DataFrame) -> DataFrame:
    """Style weights (as_of, style, weight) scaled by robustness (as_of, style, robustness) and renormalised."""
    w = weights.join(robust, ["as_of", "style"], "left").withColumn("__w", F.col("weight") * (0.5 + 0.5 * F.coalesce("robustness", F.lit(50.0)) / 100))
    return w.select("as_of", "style", (F.col("__w") / F.sum("__w").over(Window.partitionBy("as_of"))).alias("weight"))


# fixed values: aversion to risk by the client's band
AVERSION = {1: 0.35, 2: 0.28, 3: 0.20, 4: 0.12, 5: 0.06}


def integrate(df: DataFrame, ml: bool = False) -> DataFrame:
    """E2 on style_score, hybrid_alpha, theme_fit, [ml_alpha], client_fit, risk_score, liquidity_score, tail, illiquid,
    hard_excluded, excluded_reason and the client's risk_band."""
    parts = {"style_score": 0.52, "ml_alpha": 0.22, "hybrid_alpha": 0.18, "theme_fit": 0.08} if ml else {"style_score": 0.68, "hybrid_alpha": 0.24, "theme_fit": 0.08}
    aversion = F.coalesce(*[F.when(F.col("risk_band") == b, a) for b, a in AVERSION.items()])
    core = blend(parts) * (0.5 + 0.5 * F.coalesce("client_fit", F.lit(50.0)) / 100)
    risk = clipped(aversion * (50 - F.coalesce("risk_score", F.lit(50.0))) / 50 * 100, -15.0, 40.0)
    thin = 0.10 * F.greatest(F.lit(0.0), 50 - F.coalesce("liquidity_score", F.lit(50.0))) / 50 * 100
    score = clipped(core - risk - thin - F.when(F.col("tail"), 6.0).otherwise(0.0))
    out, dry = F.coalesce("hard_excluded", F.lit(False)), F.coalesce("illiquid", F.lit(False))
    df = df.withColumn("eligible", ~out & ~dry).withColumn("ineligible_reason", F.when(out, F.coalesce("excluded_reason", F.lit(""))).when(dry, "insufficient liquidity").otherwise(""))
    return df.withColumn("integrated_score", F.when(F.col("eligible"), score))


def tilted(df: DataFrame, tilt: float = 0.0) -> DataFrame:
    """E3."""
    return df.withColumn("score", (1 - tilt) * F.col("integrated_score") + tilt * F.coalesce(pct_rank(F.col("market_cap"), *BOOK), F.lit(50.0)))


def candidates(df: DataFrame, max_holdings: int = 25, sector_cap: float | Column = 0.30) -> DataFrame:
    """At most max(2, ceil(cap * holdings) + 1) names of a sector, then the best max_holdings. The cap may be a
    column, such as each client's own."""
    cap = F.lit(sector_cap) if isinstance(sector_cap, float) else sector_cap
    most = F.greatest(F.lit(2), F.ceil(F.round(cap * max_holdings, 9)) + 1)
    order = (F.round("score", 8).desc(), F.col("ticker"))
    own = df.where(F.col("score").isNotNull())
    own = own.withColumn("__s", F.row_number().over(Window.partitionBy(*BOOK, "sector").orderBy(*order))).where(F.col("__s") <= most)
    return own.withColumn("place", F.row_number().over(Window.partitionBy(*BOOK).orderBy(*order))).where(F.col("place") <= max_holdings).drop("__s")


def base_weights(df: DataFrame, concentration: float | Column = 1.0, position_cap: float | Column = 0.10, min_weight: float = 0.01) -> DataFrame:
    """Weights by score and each name's cap, which is its liquidity's where that is tighter."""
    w = Window.partitionBy(*BOOK)
    lit = lambda x: F.lit(x) if isinstance(x, float) else x
    raw = F.power(F.col("score") - F.min("score").over(w) + 5, lit(concentration))
    cap = F.greatest(F.least(lit(position_cap), F.coalesce("max_weight_by_liquidity", F.lit(1.0))), F.lit(min_weight))
    return df.withColumn("__raw", raw).withColumn("base", F.col("__raw") / F.sum("__raw").over(w)).withColumn("cap", cap).drop("__raw")


def _let(value: Column, body) -> Column:
    """body of one evaluation of value."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def _shares(w: Column) -> Column:
    return _let(_total(w), lambda t: F.transform(w, lambda x: x / t))


def filled(weights: Column, caps: Column) -> Column:
    """E7 on arrays: min(cap, level * weight) with the level at which the sum is 1. In order of cap over weight a name is
    capped as long as what is left for the others would lift it over its cap; where all caps don't reach 1 together,
    their shares. Repeated proportional hand-outs end there too."""
    ratio = lambda w, c: F.struct(F.when(w > 0, c / w).otherwise(1e300).alias("r"), c.alias("c"), w.alias("w"))

    def level(w: Column) -> Column:
        step = lambda s, x: F.when(x["r"] * s["o"] < 1 - s["c"], F.struct((s["c"] + x["c"]).alias("c"), (s["o"] - x["w"]).alias("o"))).otherwise(s)
        start = F.struct(F.lit(0.0).alias("c"), F.lit(1.0).alias("o"))
        return F.aggregate(F.array_sort(F.zip_with(w, caps, ratio)), start, step, lambda s: F.when(s["o"] > 1e-12, (1 - s["c"]) / s["o"]).otherwise(1e300))

    capped = lambda w: _let(level(w), lambda k: F.zip_with(w, caps, lambda x, c: F.least(c, k * x)))
    return _let(_shares(weights), lambda w: _shares(capped(w)))


def sector_filled(weights: Column, caps: Column, sectors: Column, most: Column, rounds: int = 50) -> Column:
    """E8 on arrays: in each round the sectors that are over their cap at its start, by name, are scaled down one after
    the other; what each frees goes to all names outside it by their headroom. Then position caps hold again."""

    def of(w: Column, s: Column) -> Column:
        return _total(F.zip_with(w, sectors, lambda x, t: F.when(t == s, x).otherwise(0.0)))

    def scaled(v: Column, s: Column, total: Column) -> Column:
        less = F.zip_with(v, sectors, lambda x, t: F.when(t == s, x * most / total).otherwise(x))
        freed = of(v, s) * (1 - most / total)
        room = lambda u: F.zip_with(F.zip_with(u, caps, lambda x, c: F.greatest(c - x, F.lit(0.0))), sectors, lambda h, t: F.when(t == s, 0.0).otherwise(h))
        give = lambda u, h: _let(F.struct(freed.alias("f"), _total(h).alias("t")), lambda k: F.when(k["t"] > 0, F.zip_with(u, h, lambda x, y: x + k["f"] * y / k["t"])).otherwise(u))
        return _let(less, lambda u: _let(room(u), lambda h: give(u, h)))

    def one_round(state: Column) -> Column:
        w = _shares(state["w"])
        over = lambda x: F.filter(F.transform(F.array_sort(F.array_distinct(sectors)), lambda s: F.struct(s.alias("s"), of(x, s).alias("t"))), lambda g: g["t"] > most + 1e-9)
        fold = lambda x, own: F.struct(F.aggregate(own, x, lambda v, g: scaled(v, g["s"], g["t"])).alias("w"), (F.size(own) == 0).alias("done"))
        return _let(w, lambda x: _let(over(x), lambda own: fold(x, own)))

    start = F.struct(weights.alias("w"), F.lit(False).alias("done"))
    ended = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda s, _: F.when(s["done"], s).otherwise(one_round(s)), lambda s: s["w"])
    return _let(ended, lambda w: filled(w, caps))


def construct(df: DataFrame, min_weight: float = 0.01, min_holdings: int = 5) -> DataFrame:
    """Each book's weights from base, cap, sector and the book's sector_cap; names under min_weight go where at least
    min_holdings stay. A book is one row with an array of its names, whose number its mandate bounds."""
    name = F.struct("ticker", F.coalesce("sector", F.lit("Unknown")).alias("sector"), "score", "base", F.col("cap").cast("double").alias("cap"))
    books = df.groupBy(*BOOK).agg(F.first("sector_cap").cast("double").alias("most"), F.array_sort(F.collect_list(name)).alias("n"))

    def solved(names: str, w: Column) -> Column:
        caps, sectors = F.transform(names, lambda x: x["cap"]), F.transform(names, lambda x: x["sector"])
        return _let(filled(w, caps), lambda v: sector_filled(v, caps, sectors, F.col("most")))

    books = books.withColumn("w", solved("n", F.transform("n", lambda x: x["base"])))
    every = F.zip_with("n", "w", lambda x, w: F.struct(x["ticker"].alias("ticker"), x["sector"].alias("sector"), x["score"].alias("score"), w.alias("base"), x["cap"].alias("cap")))
    books = books.withColumn("n", every).withColumn("kept", F.filter("n", lambda x: x["base"] >= min_weight))
    books = books.withColumn("n", F.when(F.size("kept") >= min_holdings, F.col("kept")).otherwise(F.col("n"))).drop("kept", "w")
    books = books.withColumn("w", solved("n", _shares(F.transform("n", lambda x: x["base"]))))
    rows = books.select(*BOOK, F.explode(F.arrays_zip("n", "w")).alias("x"))
    return rows.select(*BOOK, "x.n.ticker", "x.n.sector", "x.n.score", F.col("x.w").alias("weight"))


def posture(regime) -> tuple:
    """Concentration and position cap from the regime column."""
    risky = regime.startswith("bear") | regime.endswith("high_vol")
    return F.when(regime == "bull_low_vol", 1.3).when(risky, 0.7).otherwise(1.0), F.when(risky, 0.06)


def trades(target: DataFrame, current: DataFrame) -> DataFrame:
    """E11."""
    t = target.select(*BOOK, "ticker", F.col("weight").alias("target_weight"))
    c = current.select(*BOOK, "ticker", F.col("weight").alias("current_weight"))
    df = t.join(c, [*BOOK, "ticker"], "full").fillna(0.0, ["target_weight", "current_weight"]).withColumn("delta", F.col("target_weight") - F.col("current_weight"))
    a = F.when(F.abs("delta") <= 1e-6, "hold").when(F.col("current_weight") <= 1e-6, "add").when(F.col("target_weight") <= 1e-6, "exit").when(F.col("delta") > 0, "increase").otherwise("trim")
    return df.withColumn("action", a)


def book_score(weights: DataFrame, scores: DataFrame) -> DataFrame:
    """Missing scores count as the date's median."""
    mid = scores.groupBy("as_of").agg(F.percentile("score", F.lit(0.5)).alias("__mid"))
    df = weights.select(*BOOK, "ticker", "weight").join(scores.select("as_of", "ticker", F.col("score").alias("__s")), ["as_of", "ticker"], "left").join(mid, "as_of", "left")
    return df.groupBy(*BOOK).agg(F.sum(F.col("weight") * F.coalesce("__s", "__mid")).alias("book_score"))


def decision(books: DataFrame, turnover_cap: float = 0.35) -> DataFrame:
    """E13 on one row a book: new_score, old_score, cost, initial, violations, quality, confidence, d_vol, d_beta,
    turnover. The turnover cap is the house's for all clients; a change of risk that isn't known passes."""
    c = F.col
    df = books.withColumn("improvement", c("new_score") - F.coalesce("old_score", F.lit(0.0)) - 100 * c("cost"))
    gates = {"gate_improvement": c("initial") | (c("improvement") >= 1.5), "gate_mandate": c("violations") == 0, "gate_quality": c("quality") != "Critical", "gate_confidence": c("confidence") >= 0.35, "gate_risk": c("initial") | (F.coalesce(c("d_vol") <= 0.02, F.lit(True)) & F.coalesce(c("d_beta") <= 0.15, F.lit(True))), "gate_turnover": c("initial") | (c("turnover") <= turnover_cap)}
    df = df.withColumns({k: F.coalesce(g, F.lit(False)) for k, g in gates.items()})
    ok = F.forall(F.array(*gates), lambda x: x)
    failed = F.array_join(F.filter(F.array(*[F.when(~c(g), F.lit(g.removeprefix("gate_"))) for g in gates]), lambda x: x.isNotNull()), ", ")
    return df.withColumn("trade", ok).withColumn("blocked_by", failed)


def holding_classes(df: DataFrame) -> DataFrame:
    """E14 on value, quality, momentum, integrated_score and the earlier one, `old`: a weak part breaks the thesis; where
    all parts hold, a fallen score is out of favor. Parts that are missing don't count; without any a name is healthy."""
    names = ("value", "quality", "momentum")
    weak = F.least(*names)
    which = F.coalesce(*[F.when(F.col(c) == weak, c) for c in names])
    fell = F.coalesce(F.col("old") - F.col("integrated_score") >= 5, F.lit(False))
    return df.withColumn("weakest", which).withColumn("weakest_score", weak).withColumn("class", F.when(weak < 25, "thesis_broken").when(weak.isNotNull() & fell, "out_of_favor").otherwise("healthy"))


def verdict(summary: DataFrame, keys: list[str] = ()) -> DataFrame:
    """variants' Sharpe ratios side by side, for each of keys."""
    p = summary.groupBy(*keys).pivot("variant", ["rules", "ml"]).agg(F.first("sharpe"))
    d = F.col("ml") - F.col("rules")
    return p.withColumn("delta", d).withColumn("verdict", F.when(d > 0.05, "added").when(d < -0.05, "hurt").otherwise("neutral"))


LEDGER = "portfolio_id string, as_of date, nav double, cash double, n_positions int, traded double"


def ledger(targets: DataFrame, prices: DataFrame, start_cash: float = 1e6, cost_bps: float = 9.0) -> DataFrame:
    """Whole shares of each book from its targets, date after date; path dependent, so one group a book. Names
    without a price that day keep their shares and their last mark."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        cash, held, marks, rows = start_cash, {}, {}, []
        for day, g in pdf.sort_values(["as_of", "ticker"]).groupby("as_of"):
            marks |= {t: p for t, p in zip(g.ticker, g.close, strict=True) if p == p and p > 0}
            nav = cash + sum(n * marks[t] for t, n in held.items())
            own = g[g.close.notna() & (g.close > 0) & (g.weight > 0)]
            goal = {t: 0.0 for t in held if t in set(g.ticker[g.close.notna()])}
            goal |= {t: np.floor(nav * w / own.weight.sum() * 0.999 / p) for t, w, p in zip(own.ticker, own.weight, own.close, strict=True)}
            traded = sum(abs(n - held.get(t, 0.0)) * marks[t] for t, n in goal.items())
            cash -= sum((n - held.get(t, 0.0)) * marks[t] for t, n in goal.items()) + traded * cost_bps / 1e4
            held = {t: n for t, n in (held | goal).items() if n}
            rows.append((pdf.portfolio_id.iloc[0], day, cash + sum(n * marks[t] for t, n in held.items()), cash, len(held), traded))
        return pd.DataFrame(rows, columns=["portfolio_id", "as_of", "nav", "cash", "n_positions", "traded"])

    books = targets.select("portfolio_id").distinct()
    days = targets.select("portfolio_id", "as_of").distinct()
    names = targets.select("portfolio_id", "ticker").distinct()
    grid = books.join(days, "portfolio_id").join(names, "portfolio_id").join(targets.select(*BOOK, "ticker", "weight"), [*BOOK, "ticker"], "left").fillna(0.0, ["weight"])
    marked = grid.join(prices.select(F.col("date").alias("as_of"), "ticker", "close"), ["as_of", "ticker"], "left")
    return marked.groupBy("portfolio_id").applyInPandas(walk, LEDGER)


def track_record(nav: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Benchmark: as_of, level."""
    df = nav.join(benchmark, "as_of", "left")
    w = Window.partitionBy("portfolio_id").orderBy("as_of")
    df = df.withColumn("r", F.col("nav") / F.lag("nav").over(w) - 1).withColumn("dd", F.col("nav") / F.max("nav").over(w) - 1)
    ends = lambda c: F.max_by(c, "as_of") / F.min_by(c, "as_of") - 1
    return df.groupBy("portfolio_id").agg(ends("nav").alias("total_return"), ends("level").alias("benchmark_return"), F.min("dd").alias("max_drawdown"), F.stddev_pop("r").alias("mark_vol"), F.count("*").alias("n_marks")).withColumn("excess_return", F.col("total_return") - F.col("benchmark_return"))
