"""Rebalanced style backtests, regimes and their stability, for all dates and strategies at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.perf import correlation, metrics
from corvane.functions.xs import by_name, normalised, pct_rank
from corvane.operators.panel import as_of

STYLES = ("value", "quality", "growth", "garp", "momentum", "low_vol")
# fixed values: style weights of the templates
TEMPLATES = {
    "deep_value": {"value": 0.67, "quality": 0.22, "low_vol": 0.11},
    "quality_compounder": {"quality": 0.55, "growth": 0.2, "value": 0.15, "low_vol": 0.1},
    "garp_blend": {"garp": 0.4, "growth": 0.25, "quality": 0.2, "value": 0.15},
    "momentum_tilt": {"momentum": 0.55, "growth": 0.2, "quality": 0.15, "low_vol": 0.1},
    "defensive_low_vol": {"low_vol": 0.53, "quality": 0.35, "value": 0.12},
    "hybrid_multifactor": {"value": 0.22, "quality": 0.28, "growth": 0.17, "momentum": 0.22, "low_vol": 0.11},
}
# fixed values: style weights by market regime; income is no style of the panel: its share goes to the others
PRIORS = {
    "bull_low_vol": {"momentum": 0.25, "growth": 0.22, "quality": 0.2, "garp": 0.15, "value": 0.1, "low_vol": 0.04, "income": 0.04},
    "bull_high_vol": {"quality": 0.28, "momentum": 0.2, "growth": 0.15, "garp": 0.12, "low_vol": 0.13, "value": 0.08, "income": 0.04},
    "bear_low_vol": {"quality": 0.3, "low_vol": 0.25, "value": 0.18, "income": 0.15, "garp": 0.07, "growth": 0.03, "momentum": 0.02},
    "bear_high_vol": {"low_vol": 0.32, "quality": 0.3, "income": 0.18, "value": 0.12, "garp": 0.04, "growth": 0.02, "momentum": 0.02},
    "sideways_low_vol": {"quality": 0.24, "value": 0.22, "garp": 0.18, "low_vol": 0.14, "income": 0.1, "momentum": 0.08, "growth": 0.04},
    "sideways_high_vol": {"quality": 0.28, "low_vol": 0.22, "value": 0.2, "income": 0.14, "garp": 0.08, "momentum": 0.04, "growth": 0.04},
}


def template_table(spark, templates: dict[str, dict[str, float]] = TEMPLATES) -> DataFrame:
    return spark.createDataFrame([(t, s, float(w)) for t, ws in templates.items() for s, w in ws.items()], "template string, style string, w double")


def template_scores(panel: DataFrame, templates: DataFrame) -> DataFrame:
    """B1, B2: weighted means over the styles that are there. panel: as_of, ticker and styles. A row of the panel meets
    each template's weights as columns, so nothing is grouped."""
    wide = templates.groupBy("template").pivot("style", list(STYLES)).agg(F.sum("w")).select("template", *[F.col(s).alias(f"w_{s}") for s in STYLES])
    there = lambda s, x: F.when(F.col(s).isNotNull(), F.coalesce(x, F.lit(0.0))).otherwise(0.0)
    own = sum((F.when(F.col(s).isNotNull() & F.col(f"w_{s}").isNotNull(), 1).otherwise(0) for s in STYLES), F.lit(0))
    score = sum((there(s, F.col(s) * F.col(f"w_{s}")) for s in STYLES), F.lit(0.0)) / sum((there(s, F.col(f"w_{s}")) for s in STYLES), F.lit(0.0))
    rows = panel.select("as_of", "ticker", *STYLES).crossJoin(F.broadcast(wide))  # a row a template
    return rows.where(own > 0).select("template", "as_of", "ticker", score.alias("score"))


def top_n(scores: DataFrame, n: int = 25) -> DataFrame:
    """Ties go to the smaller ticker."""
    place = F.row_number().over(Window.partitionBy("template", "as_of").orderBy(F.round("score", 8).desc_nulls_last(), "ticker"))
    return scores.where(F.col("score").isNotNull()).withColumn("place", place).where(F.col("place") <= n)


def segment_returns(picks: DataFrame, segments: DataFrame, include_entry: bool = False) -> DataFrame:
    """Equal-weight daily returns of the picks between rebalances. segments: date, ticker, close, as_of. The first
    day of a segment has no return within it and is left out; include_entry counts it from the rebalance day's price."""
    w = Window.partitionBy("as_of", "ticker").orderBy("date")
    own = picks.select("template", "as_of", "ticker")
    # rows of names that no template holds go before the rest are ordered by day
    r = segments.join(own.select("as_of", "ticker").distinct(), ["as_of", "ticker"], "left_semi").withColumn("ret", F.col("close") / F.lag("close").over(w) - 1)
    if include_entry:
        r = r.withColumn("ret", F.coalesce("ret", F.col("close") / F.col("entry_close") - 1))
    held = own.join(r.select("as_of", "ticker", "date", "ret"), ["as_of", "ticker"])
    return held.groupBy("template", "date").agg(F.avg("ret").alias("ret"), F.first("as_of").alias("as_of")).where(F.col("ret").isNotNull())


def summary(daily: DataFrame) -> DataFrame:
    """B5, P9."""
    return metrics(daily, ["template"])


def survivorship_bias(full: DataFrame, survivors: DataFrame) -> DataFrame:
    """Yearly return of the survivors' run over that of all names."""
    a = summary(full).select("template", F.col("ann_return").alias("all_names"))
    b = summary(survivors).select("template", F.col("ann_return").alias("survivors"))
    return a.join(b, "template").withColumn("bias", F.col("survivors") - F.col("all_names"))


def breadth(prices: DataFrame, days: int = 200) -> DataFrame:
    """Share of names above their trailing mean; 0.5 until they have 20 rows."""
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(1 - days, 0)
    p = prices.withColumn("__ma", F.when(F.count("close").over(w) >= 20, F.avg("close").over(w)))
    share = F.avg(F.coalesce(F.col("close") > F.col("__ma"), F.lit(False)).cast("double"))
    return p.groupBy("date").agg(F.when(F.count("__ma") > 0, share).otherwise(0.5).alias("breadth"))


def breadth_of(runs: DataFrame, calendar: DataFrame, days: int = 200, least: int = 20) -> DataFrame:
    """breadth from observed prices alone (star.runs with `end`; calendar: date, i). A ticker's days are made in memory, a
    price as often as it stands; the days on which the ticker begins, ends or crosses its mean are all that leaves it, and
    running sums of them are the numbers of names of each day. Prices are whole millionths: sums are exact."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("i")
        i, end, close = rows.column("i").to_numpy().astype(np.int64), rows.column("end")[0].as_py(), rows.column("close").to_numpy(zero_copy_only=False)
        i, close = i[i <= end], close[: int((i <= end).sum())]
        if not len(i):
            i, end = np.zeros(1, np.int64), -1
        start, none = i[0], int(np.isnan(close).sum())  # filled forward: no price up to the first
        stands = np.diff(np.append(i, end + 1))
        blank = int(stands[:none].sum()) if len(close) else 0
        price = np.repeat(np.rint(close[none:] * 1e6).astype(np.int64), stands[none:]) if len(close) else np.zeros(0, np.int64)
        total = np.concatenate([np.zeros(days, np.int64), np.cumsum(price)])
        n = np.minimum(np.arange(1, len(price) + 1), days)
        known = n >= least
        above = known & (price * n > total[days:] - total[: len(price)])
        pad = np.zeros(blank, bool)
        marks = np.stack([np.diff(np.concatenate([[0], x.astype(np.int64), [0]])) for x in (np.ones(blank + len(price), bool), np.concatenate([pad, known]), np.concatenate([pad, above]))])
        some = np.flatnonzero(marks.any(axis=0))
        return pa.table({"i": some + start, **{c: marks[k][some] for k, c in enumerate(("names", "known", "above"))}})

    kept = runs.select("ticker", "i", F.col("close").cast("double"), "end")
    marks = kept.groupBy("ticker").applyInArrow(run, "i long, names long, known long, above long").groupBy("i").agg(*[F.sum(c).alias(c) for c in ("names", "known", "above")])
    w = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)  # one row a day
    every = calendar.select("date", "i").join(marks, "i", "left").select("date", *[F.sum(F.coalesce(c, F.lit(0))).over(w).alias(c) for c in ("names", "known", "above")])
    return every.where("names > 0").select("date", F.when(F.col("known") > 0, F.col("above") / F.col("names")).otherwise(0.5).alias("breadth"))


def classify_regime(benchmarks: DataFrame, breadths: DataFrame) -> DataFrame:
    """{bull, bear, sideways}_{low, high}_vol for each date."""
    w = Window.orderBy("date")  # one row a day
    b = benchmarks.where("name = 'SPX'").withColumn("n", F.row_number().over(w)).withColumn("r", F.col("level") / F.lag("level").over(w) - 1)
    b = b.withColumn("ma", F.avg("level").over(w.rowsBetween(-199, 0))).withColumn("ret6", F.col("level") / F.coalesce(F.lag("level", 125).over(w), F.first("level").over(w)) - 1)
    b = b.withColumn("v21", F.stddev_pop("r").over(w.rowsBetween(-20, 0))).withColumn("vall", F.stddev_pop("r").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    b = b.join(breadths, "date", "left")
    trend = F.when((F.col("level") > F.col("ma")) & (F.col("ret6") > 0.02) & (F.col("breadth") > 0.55), "bull").when((F.col("level") < F.col("ma")) & (F.col("ret6") < -0.02) & (F.col("breadth") < 0.45), "bear").otherwise("sideways")
    vol = F.when(F.col("v21") > 1.15 * F.col("vall"), "high_vol").otherwise("low_vol")
    return b.select("date", F.when(F.col("n") < 60, "sideways_low_vol").otherwise(F.concat_ws("_", trend, vol)).alias("regime"), "breadth")


def trailing_best(daily: DataFrame, dates: DataFrame, calendar: DataFrame, lookback: int = 1000) -> DataFrame:
    """as_of, template, sharpe: at each date the template with the highest Sharpe ratio over the last `lookback`
    days of the calendar (date) up to it. Ratios come from running sums of log returns, returns and their squares, taken
    at both ends of the window. A ratio of 0 or none comes last, ties go by the order of TEMPLATES, so a date without
    history has the first of them. daily: template, date, ret."""
    day = Window.orderBy("date")  # one row a day
    days = calendar.select("date").distinct().withColumn("start", F.coalesce(F.lag("date", lookback - 1).over(day), F.first("date").over(day)))
    ends = dates.select("as_of").join(days, F.col("as_of") == F.col("date")).select("as_of", "start")
    w = Window.partitionBy("template").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    known = daily.where("ret is not null")
    log = F.when(F.col("ret") > -1, F.log1p("ret")).otherwise(-1e5)
    sums = known.select("template", F.col("date").alias("pub_date"), F.count("ret").over(w).alias("n"), F.sum(log).over(w).alias("l"), F.sum("ret").over(w).alias("s"), F.sum(F.col("ret") ** 2).over(w).alias("q"))
    spark = daily.sparkSession
    names = spark.createDataFrame([(t, i) for i, t in enumerate(TEMPLATES)], "template string, place int")
    grid = ends.join(names, how="cross")  # a row for each date and template
    at = lambda c, p: as_of(sums, grid.select("template", F.col(c).alias("as_of")).distinct(), key="template").select("template", F.col("as_of").alias(c), *[F.col(x).alias(f"{p}{x}") for x in "nlsq"])
    both = grid.join(at("as_of", "b"), ["template", "as_of"], "left").join(at("start", "a"), ["template", "start"], "left")
    diff = lambda x: F.coalesce(f"b{x}", F.lit(0)) - F.coalesce(f"a{x}", F.lit(0))
    both = both.select("as_of", "template", "place", *[diff(x).alias(x) for x in "nlsq"])
    sd = F.sqrt(F.greatest(F.col("q") / F.col("n") - (F.col("s") / F.col("n")) ** 2, F.lit(0.0)))
    ratio = F.when((F.col("n") >= 2) & (sd > 1e-12), (F.exp(F.col("l") * 252 / F.col("n")) - 1) / (sd * 252**0.5))
    order = F.when(F.abs(ratio) > 1e-12, F.round(ratio, 9)).desc_nulls_last()
    return both.withColumn("sharpe", ratio).withColumn("k", F.row_number().over(Window.partitionBy("as_of").orderBy(order, "place"))).where("k = 1").select("as_of", "template", "sharpe")


def blend_of(best: DataFrame, templates: DataFrame) -> DataFrame:
    """as_of, style and normalised weight w of each date's template."""
    return best.join(templates, "template").select("as_of", "style", normalised(F.col("w"), "as_of").alias("w"))


def point_in_time(scores: DataFrame, members: DataFrame) -> DataFrame:
    """Scores ranked over all names of a date, then only those of its eligible members (as_of, ticker)."""
    return scores.join(members.select("as_of", "ticker").distinct(), ["as_of", "ticker"], "left_semi")


def lagged_dates(dates: DataFrame, calendar: DataFrame, rows: int = 5) -> DataFrame:
    """as_of and the day `rows` rows of the calendar (date) before it, null where there is none."""
    days = calendar.select("date").distinct().withColumn("lagged", F.lag("date", rows).over(Window.orderBy("date")))  # one row a day
    return dates.select("as_of").join(days, F.col("as_of") == F.col("date")).select("as_of", "lagged")


def stability(panel: DataFrame, lags: DataFrame, weights: DataFrame) -> DataFrame:
    """The rank correlation of a composite with itself on the lagged day, the mean change of the styles and the
    confidence from both. panel: as_of, ticker and styles, of dates and lagged days alike; lags: as_of, lagged; weights:
    as_of, style, weight, with portfolio_id where each client has its own. Missing styles count as 50 in composites and
    not at all in the change; with under five common names, or no lagged day, the confidence is 0.5."""
    keys = [c for c in ("portfolio_id", "as_of") if c in weights.columns]
    then = panel.select(F.col("as_of").alias("lagged"), "ticker", *[F.col(s).alias(f"old_{s}") for s in STYLES])
    both = panel.join(lags.where("lagged is not null"), "as_of").join(by_name(then), ["lagged", "ticker"])
    moved = both.groupBy("as_of").agg(F.count("*").alias("n"), *[F.avg(F.abs(F.col(s) - F.col(f"old_{s}"))).alias(s) for s in STYLES])
    known = F.filter(F.array(*STYLES), lambda x: x.isNotNull())
    moved = moved.select("as_of", "n", F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), F.size(known)).alias("drift"))
    wide = weights.groupBy(*keys).pivot("style", list(STYLES)).agg(F.sum("weight")).select(*keys, *[F.coalesce(s, F.lit(0.0)).alias(f"w_{s}") for s in STYLES])
    mean = lambda p: sum((F.col(f"w_{s}") * F.coalesce(f"{p}{s}", F.lit(50.0)) for s in STYLES), F.lit(0.0)) / sum((F.col(f"w_{s}") for s in STYLES), F.lit(0.0))
    pairs = both.join(wide, "as_of").select(*keys, F.round(mean(""), 9).alias("x"), F.round(mean("old_"), 9).alias("y"))
    ranked = pairs.withColumn("a", pct_rank(F.col("x"), *keys)).withColumn("b", pct_rank(F.col("y"), *keys))
    rho = ranked.groupBy(*keys).agg(correlation("a", "b").alias("rho"))
    out = wide.select(*keys).join(rho, keys, "left").join(moved, "as_of", "left")
    enough = F.coalesce(F.col("n") >= 5, F.lit(False))
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 * (F.coalesce("rho", F.lit(0.0)) + 1) - 0.003 * F.col("drift")))
    return out.select(*keys, F.when(enough, F.coalesce("rho", F.lit(0.0))).alias("rho"), F.when(enough, F.col("drift")).alias("drift"), F.when(enough, sure).otherwise(0.5).alias("confidence"))


def prior_table(spark) -> DataFrame:
    return spark.createDataFrame([(r, s, float(w)) for r, ws in PRIORS.items() for s, w in ws.items()], "regime string, style string, prior double")


def style_weights(regimes: DataFrame, priors: DataFrame, best: DataFrame | None = None, tilts: DataFrame | None = None, share: float = 0.35) -> DataFrame:
    """The regime's prior blended with the weights of each date's best template (as_of, style, w; see
    trailing_best), tilted (client_id, style, tilt; else 1) and normalised over the styles of the panel. regimes: as_of,
    regime."""
    df = regimes.join(priors.where(F.col("style").isin(*STYLES)), "regime")
    raw = F.col("prior")
    if best is not None:
        df = df.join(best.select("as_of", "style", "w"), ["as_of", "style"], "left")
        raw = (1 - share) * raw + share * F.coalesce("w", F.lit(0.0))
    keys = ["as_of"] if tilts is None else ["client_id", "as_of"]
    if tilts is not None:
        df = df.join(tilts, "style")
        raw = raw * F.col("tilt")
    return df.withColumn("__w", raw).select(*keys, "regime", "style", normalised(F.col("__w"), *keys).alias("weight"))
