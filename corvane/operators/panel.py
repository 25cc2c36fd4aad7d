"""Point-in-time panel assembly: calendars, as-of snapshots, universes, corporate actions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_ticker(*keys: str):
    return Window.partitionBy(*(keys or ("ticker",))).orderBy("date")


def align(prices: DataFrame, calendar: DataFrame) -> DataFrame:
    """Every calendar day from a ticker's first observation on, filled forward."""
    first = prices.where(F.col("close").isNotNull()).groupBy("ticker").agg(F.min("date").alias("__first"))
    grid = calendar.select("date").distinct().join(first, F.col("date") >= F.col("__first")).select("ticker", "date")
    filled = grid.join(prices, ["ticker", "date"], "left")
    return filled.withColumn("close", F.last("close", ignorenulls=True).over(by_ticker()))


def merge_batches(batches: list[DataFrame], keys: list[str]) -> DataFrame:
    """Of rows with equal keys the earliest batch's stays."""
    all_rows = batches[0].withColumn("__b", F.lit(0))
    for i, b in enumerate(batches[1:], 1):
        all_rows = all_rows.unionByName(b.withColumn("__b", F.lit(i)), allowMissingColumns=True)
    return all_rows.withColumn("__m", F.min("__b").over(Window.partitionBy(*keys))).where("__b = __m").drop("__b", "__m")


def as_of(facts: DataFrame, grid: DataFrame, fact_date: str = "pub_date", key: str = "ticker") -> DataFrame:
    """For each (key, as_of) of grid the last whole row of facts dated on or before as_of; its null fields
    stay null. One shuffle by key: facts and grid are put in one sequence and the last fact is carried forward."""
    rest = [c for c in facts.columns if c not in (key, fact_date)]
    left = facts.select(key, F.col(fact_date).alias("__at"), F.struct(fact_date, *rest).alias("__f"), F.lit(0).alias("__side"))
    right = grid.select(key, F.col("as_of").alias("__at"), F.lit(None).cast(left.schema["__f"].dataType).alias("__f"), F.lit(1).alias("__side"))
    w = Window.partitionBy(key).orderBy("__at", "__side")
    both = left.unionByName(right).withColumn("__f", F.last("__f", ignorenulls=True).over(w)).where("__side = 1 and __f is not null")
    return both.select(F.col("__at").alias("as_of"), key, "__f.*")


def as_of_dates(facts: DataFrame, dates: DataFrame, fact_date: str = "pub_date", key: str = "ticker") -> DataFrame:
    """as_of for every key of facts on every one of dates (as_of, a few). A fact stands from its day up to the key's next
    one and lists the dates in between, which it finds by their places: facts by key stay where they lie. Of a key's facts
    of one day any may stand."""
    at = dates.select("as_of").distinct()
    w = Window.partitionBy(key).orderBy(fact_date)
    every = at.agg(F.sort_array(F.collect_list("as_of")).alias("__every"))
    days = facts.select(fact_date).distinct().join(F.broadcast(every)).select(fact_date, F.size(F.filter("__every", lambda d: d < F.col(fact_date))).alias("__from"))  # one row a day
    rows = facts.join(F.broadcast(days), fact_date).withColumn("__to", F.lead("__from").over(w)).join(F.broadcast(every))  # an aggregate: one row
    some = rows.where(F.coalesce("__to", F.size("__every")) > F.col("__from"))
    own = F.slice("__every", F.col("__from") + 1, F.coalesce("__to", F.size("__every")) - F.col("__from"))
    return some.withColumn("as_of", F.explode(own)).select("as_of", key, fact_date, *[c for c in facts.columns if c not in (key, fact_date)])


def observed(runs: DataFrame, dates: DataFrame, horizon: int = 126, traded: int = 63, recent: int = 60) -> DataFrame:
    """Of each ticker on each of dates (as_of and i, its number in the calendar: a few), from observed prices alone
    (star.runs, with `end`, the number of the ticker's last day): close; adv, the mean traded value of `traded` days;
    fwd_return over the next `horizon` days; and of the last `recent` days the share without a price (missing), whether the
    price stood still (stale) and the largest move (move). Between two observed prices a price stands and nothing is
    traded, so no day between is made: a ticker's prices are looked up where they lie."""
    days = sorted((r.i, r.as_of) for r in dates.select("i", "as_of").distinct().collect())  # one date a month
    at, names = np.array([i for i, _ in days], dtype=np.int64), np.array([d for _, d in days], dtype="datetime64[D]")

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("i")
        i, end = rows.column("i").to_numpy().astype(np.int64), rows.column("end")[0].as_py()
        close, volume = (rows.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("close", "volume"))  # nulls are NaN
        mine = (at >= i[0]) & (at <= end)
        d, day = at[mine], names[mine]
        here = lambda n: np.searchsorted(i, n, side="right") - 1
        now, then = here(d), here(d + horizon)
        price = close[now]
        ahead = np.where(d + horizon <= end, close[then] / price - 1, np.nan)

        def last(values, n, nothing):
            """The values of the last n days' observed prices, oldest first, others are nothing."""
            k = now[:, None] - np.arange(min(n, len(i)) - 1, -1, -1)
            ok = (k >= 0) & (i[np.maximum(k, 0)] > (d - n)[:, None])
            return np.where(ok, values[np.maximum(k, 0)], nothing)

        value = close * volume
        sums = np.cumsum(np.nan_to_num(last(value, traded, 0.0)), axis=1)[:, -1] if len(d) else d.astype(float)
        blank = int(np.isnan(close).argmin()) if not np.isnan(close).all() else len(i)  # filled forward: no price up to the first
        known = i[blank] if blank < len(i) else end + 1
        adv = sums / np.maximum(np.minimum(traded, d - np.maximum(i[0], known) + 1), 1)
        adv[np.isnan(price)] = np.nan
        low = np.maximum(d - recent + 1, i[0])
        missing = np.clip(known - low, 0, d - low + 1) / (d - low + 1)
        moves = np.abs(np.concatenate([[np.nan], close[1:] / close[:-1] - 1]))
        move = np.fmax.reduce(last(moves, recent, np.nan), axis=1) if len(d) else d.astype(float)
        changed = np.concatenate([[False], close[1:] != close[:-1]])
        inside = last(changed, recent, False) & (last(i, recent, -1) > np.maximum(low, known)[:, None]) if len(d) else np.zeros((0, 1), bool)
        stale = ~inside.any(axis=1) & (d - np.maximum(low, known) + 1 > 1)
        nan = lambda x: pa.array(x, mask=np.isnan(x))
        return pa.table({"as_of": pa.array(day), "ticker": pa.repeat(rows.column("ticker")[0], len(d)), "close": nan(price), "adv": nan(adv), "fwd_return": nan(ahead), "missing": missing, "stale": stale, "move": nan(move)})

    kept = runs.select("ticker", "i", F.col("close").cast("double"), F.col("volume").cast("double"), "end")
    return kept.groupBy("ticker").applyInArrow(run, f"as_of date, ticker {dict(runs.dtypes)['ticker']}, close double, adv double, fwd_return double, missing double, stale boolean, move double")


def thinned(facts: DataFrame, dates: DataFrame, fact_date: str = "pub_date", key: str = "ticker") -> DataFrame:
    """Of each key's facts, one a day at most, the last between each two of dates (as_of): as_of finds the same on these
    dates. The days of the calendar meet the dates, facts meet the days, so facts by key stay where they lie."""
    days = facts.select(fact_date).distinct().join(F.broadcast(dates.select("as_of")), F.col(fact_date) <= F.col("as_of")).groupBy(fact_date).agg(F.min("as_of").alias("__to"))
    rest = [c for c in facts.columns if c not in (key, fact_date)]
    last = facts.join(F.broadcast(days), fact_date).groupBy(key, "__to").agg(F.max(F.struct(fact_date, *rest)).alias("__f"))  # one row a day
    return last.select(key, "__f.*")


def rebalance_dates(prices: DataFrame) -> DataFrame:
    """The first trading day of each month, with the next one."""
    firsts = prices.groupBy(F.trunc("date", "month").alias("month")).agg(F.min("date").alias("as_of"))
    return firsts.select("as_of", F.lead("as_of").over(Window.orderBy("as_of")).alias("next_as_of"))


def walk_schedule(prices: DataFrame, weekly: bool = True, skip: int = 252) -> DataFrame:
    """Trading Fridays, or last trading days of months, after the first `skip` trading days."""
    days = prices.select("date").distinct().withColumn("n", F.row_number().over(Window.orderBy("date")))
    if weekly:
        return days.where((F.dayofweek("date") == 6) & (F.col("n") > skip)).select("date")
    last = days.groupBy(F.trunc("date", "month").alias("m")).agg(F.max(F.struct("date", "n")).alias("x"))
    return last.where(F.col("x.n") > skip).select("x.date")


def month_ends(dates: DataFrame) -> DataFrame:
    """The last weekday of each month of dates."""
    last = F.last_day("date")
    back = F.when(F.dayofweek(last) == 1, 2).when(F.dayofweek(last) == 7, 1).otherwise(0)
    return dates.select(F.date_sub(last, back).alias("as_of")).distinct()


def segments(prices: DataFrame, dates: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """Each row with the rebalance date d for which d < date <= next d. The dates are matched to the days of the
    calendar (date), or else of prices, rows meet them by equality."""
    days = (prices if calendar is None else calendar).select("date").distinct().join(dates, (F.col("date") > F.col("as_of")) & (F.col("next_as_of").isNull() | (F.col("date") <= F.col("next_as_of"))))
    return prices.join(F.broadcast(days), "date")  # one row a day


def trailing_rows(prices: DataFrame, n: int) -> DataFrame:
    """T4: the last n calendar days of the panel."""
    days = prices.select("date").distinct()
    start = days.orderBy(F.desc("date")).limit(n).agg(F.min("date").alias("__start"))
    return prices.join(F.broadcast(start), F.col("date") >= F.col("__start")).drop("__start")  # one row


def before(df: DataFrame, day: str, lookback: int | None = None, column: str = "date") -> DataFrame:
    """T5: rows up to a day, not older than lookback days."""
    out = df.where(F.col(column) <= F.lit(day).cast("date"))
    return out if lookback is None else out.where(F.col(column) >= F.date_sub(F.lit(day).cast("date"), lookback))


def restrict(df: DataFrame, tickers: DataFrame) -> DataFrame:
    """Rows of the listed tickers."""
    return df.join(tickers.select("ticker").distinct(), "ticker", "left_semi")


def adv(prices: DataFrame, n: int = 63, trailing: bool = True) -> DataFrame:
    """Mean traded value over n rows up to each day, or over the last n rows of the load."""
    value = F.col("close") * F.col("volume")
    if trailing:
        return prices.withColumn("adv", F.avg(value).over(by_ticker().rowsBetween(1 - n, 0)))
    back = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))
    return prices.withColumn("__n", back).where(F.col("__n") <= n).groupBy("ticker").agg(F.avg(value).alias("adv"))


def eligible(snapshot: DataFrame, securities: DataFrame, types: tuple[str, ...] = ("common",), min_price: float = 5.0, min_adv: float = 1e6) -> DataFrame:
    """Rows of snapshot (as_of, ticker, close, adv) that are listed, priced and liquid on their date."""
    s = securities.select("ticker", "security_type", "listing_date", "delisting_date")
    listed = (F.col("listing_date").isNull() | (F.col("listing_date") <= F.col("as_of"))) & (F.col("delisting_date").isNull() | (F.col("delisting_date") > F.col("as_of")))
    liquid = F.lit(True) if min_adv <= 0 else F.col("adv") >= min_adv
    return snapshot.join(s, "ticker").where(F.col("security_type").isin(*types) & listed & (F.col("close") >= min_price) & liquid).select(snapshot.columns)


def delisting_splice(daily: DataFrame, delistings: DataFrame, nasdaq_rule: bool = False) -> DataFrame:
    """One more row for each delisting (permno, dlstdt, dlret, dlstcd, exchcd), with an imputed return where it is missing."""
    last = daily.groupBy("permno").agg(F.max("date").alias("__last"))
    failed = F.col("dlstcd").between(400, 591)
    worse = F.when(failed & (F.col("exchcd") == 3), -0.55) if nasdaq_rule else F.lit(None).cast("double")
    ret = F.coalesce("dlret", worse, F.when(failed, -0.30).otherwise(0.0))
    rows = delistings.join(last, "permno").select("permno", F.greatest(F.date_add("__last", 1), F.col("dlstdt")).alias("date"), ret.alias("ret"))
    return daily.unionByName(rows, allowMissingColumns=True)


def total_return_index(daily: DataFrame) -> DataFrame:
    """From the first price on, compounded returns; null returns count as 0. daily: permno, date, prc, ret."""
    w = Window.partitionBy("permno").orderBy("date")
    growth = F.product(1 + F.coalesce(F.col("ret"), F.lit(0.0))).over(w)
    seed = F.first(F.abs("prc"), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return daily.withColumn("__g", growth).withColumn("level", seed * F.col("__g") / F.first("__g").over(w)).drop("__g")


def publication_date(rdq: Column, period_end: Column) -> Column:
    """T11."""
    return F.coalesce(rdq, F.date_add(period_end, 60))


def quarterly_ratios(q: DataFrame) -> DataFrame:
    """Annualised ratios of quarterly statements, growth against the same quarter a year before."""
    ratio = lambda a, b: F.when(b != 0, a / b)
    c = F.col
    w = Window.partitionBy("permno").orderBy("datadate")
    mcap, debt = c("prccq") * c("cshoq"), F.when(c("dlttq").isNotNull() | c("dlcq").isNotNull(), F.coalesce("dlttq", F.lit(0.0)) + F.coalesce("dlcq", F.lit(0.0)))
    growth = lambda name: F.when(F.lag(name, 4).over(w) != 0, (c(name) - F.lag(name, 4).over(w)) / F.abs(F.lag(name, 4).over(w)))
    out = q.select("permno", "datadate", publication_date(c("rdq"), c("datadate")).alias("pub_date"), mcap.alias("market_cap"), ratio(mcap, 4 * c("niq")).alias("pe"), ratio(mcap, c("ceqq")).alias("pb"), ratio(mcap + debt, 4 * c("oiadpq")).alias("ev_ebit"), ratio(4 * (c("oancfq") - c("capxq")), mcap).alias("fcf_yield"), ratio(4 * (c("niq") - c("oancfq")), mcap).alias("accruals"), ratio(4 * c("niq"), c("ceqq")).alias("roe"), ratio(4 * c("oiadpq"), c("ceqq") + debt).alias("roic"), ratio(c("saleq") - c("cogsq"), c("saleq")).alias("gross_margin"), ratio(debt, c("ceqq")).alias("debt_equity"), ratio(c("oiadpq"), c("xintq")).alias("interest_coverage"), F.coalesce(ratio(4 * c("dvpsxq"), c("prccq")), F.lit(0.0)).alias("dividend_yield"), growth("saleq").alias("revenue_growth"), growth("epspxq").alias("eps_growth"), growth("cshoq").alias("net_issuance"), growth("atq").alias("asset_growth"))
    return growth_stability(out, "permno", "datadate")


def growth_stability(df: DataFrame, key: str = "ticker", at: str = "date") -> DataFrame:
    """Population deviation of the growth seen so far, from three values on."""
    w = Window.partitionBy(key).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    vol = F.when(F.count("eps_growth").over(w) >= 3, F.stddev_pop("eps_growth").over(w))
    return df.withColumn("earnings_vol", vol).withColumn("growth_stability", 1 / (1 + F.col("earnings_vol")))


def split_factors(shares: DataFrame) -> DataFrame:
    """Product of later split ratios of a share-count series (ticker, date, val)."""
    w = Window.partitionBy("ticker").orderBy("date")
    r = F.col("val") / F.lag("val").over(w)
    step = shares.withColumn("__r", F.when((r >= 1.45) | ((r > 0) & (r <= 0.69)), r).otherwise(1.0))
    return step.withColumn("factor", F.coalesce(F.product("__r").over(w.rowsBetween(1, Window.unboundedFollowing)), F.lit(1.0))).drop("__r")


def restated(per_share: DataFrame, factors: DataFrame) -> DataFrame:
    """A per-share series (ticker, filed, val) over the split factor as of its own filing."""
    f = as_of(factors.select("ticker", F.col("date").alias("pub_date"), "factor"), per_share.select("ticker", F.col("filed").alias("as_of")).distinct())
    return per_share.join(f.select("ticker", F.col("as_of").alias("filed"), "factor"), ["ticker", "filed"], "left").withColumn("val", F.col("val") / F.coalesce("factor", F.lit(1.0)))


def yoy_instant(facts: DataFrame, grid: DataFrame) -> DataFrame:
    """Value as of a date over the value as of 365 days before; null where that is not positive."""
    now = as_of(facts, grid).select("ticker", "as_of", F.col("val").alias("v1"))
    then = as_of(facts, grid.select("ticker", F.date_sub("as_of", 365).alias("as_of"))).select("ticker", F.date_add("as_of", 365).alias("as_of"), F.col("val").alias("v0"))
    return now.join(then, ["ticker", "as_of"], "left").select("ticker", "as_of", F.when(F.col("v0") > 0, F.col("v1") / F.col("v0") - 1).alias("yoy"))


def index_membership(current: DataFrame, removed: DataFrame) -> DataFrame:
    """Names of today without an end, removed ones with their delisting date."""
    return current.select("ticker", F.lit(None).cast("date").alias("delisting_date")).unionByName(removed.select("ticker", "delisting_date"))
