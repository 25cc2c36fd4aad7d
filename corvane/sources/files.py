"""Landed files to canonical tables: CSV datasets, provider payloads, company facts, filings and research tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.sources.star import FIELDS
from corvane.work import cut

BARS = "array<struct<datetime:string,date:string,time:string,time_milliseconds:string,open:string,close:string,adjClose:string,volume:string>>"
FACT = "struct<fy:int,fp:string,form:string,val:double,filed:date,end:date>"
FACTS = f"struct<entityName:string,facts:map<string,map<string,struct<units:map<string,array<{FACT}>>>>>>"
# fixed values: sector names of the vendors
SECTORS = {"information technology": "Technology", "technology": "Technology", "healthcare": "Health Care", "health care": "Health Care", "financial services": "Financials", "financials": "Financials", "consumer cyclical": "Consumer Discretionary", "consumer discretionary": "Consumer Discretionary", "consumer defensive": "Consumer Staples", "consumer staples": "Consumer Staples", "industrials": "Industrials", "energy": "Energy", "basic materials": "Materials", "materials": "Materials", "utilities": "Utilities", "communication services": "Communication Services", "real estate": "Real Estate"}


FIELD = r',("(?:[^"\\]|\\.|"")*+"|[^,]*)'


def _cells(line: Column) -> Column:
    """Fields of a CSV line, without their quotes."""
    bare = lambda x: F.regexp_replace(F.substring(x, 2, F.length(x) - 2), r'\\(.)|"(")', "$1$2")
    quoted = F.transform(F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(FIELD), F.lit(1)), lambda x: F.when(x.startswith('"'), bare(x)).otherwise(x))
    return F.when(F.contains(line, F.lit('"')), quoted).otherwise(F.split(line, ","))


def wide_rows(spark: SparkSession, path: str) -> DataFrame:
    """date, name and cell of a wide CSV with a column a name. Lines are read as texts and their cells meet the header's
    names by place, so that plans don't grow with names."""
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    first = lines.first()
    head = "" if first is None else first.line
    names = spark.createDataFrame([(head,)], "head string").select("head", _cells(F.col("head")).alias("names"))
    rows = lines.where("line <> ''").join(F.broadcast(names), F.col("line") != F.col("head")).withColumn("cells", _cells(F.col("line")))  # one row
    day = F.get("cells", F.array_position("names", "date").cast("int") - 1)
    return rows.select(day.alias("date"), F.col("names").alias("name"), F.col("cells").alias("cell")).select("date", F.explode(F.arrays_zip("name", "cell")).alias("c")).select("date", "c.*")


def write_wide(df: DataFrame, key: str, value: str, path: str) -> None:
    """A line a date, a column a name. Lines are put together from each date's values, sorted by their names' places,
    with as many commas between two as lie between their places; the header is the name of the one column written."""
    names = df.agg(F.array_sort(F.collect_set(key)).alias("names"))
    places = names.select(F.posexplode("names").alias("__i", key)).withColumn("__i", F.col("__i") + 1)
    own = df.where(F.col(value).isNotNull()).join(places, key).groupBy("date").agg(F.array_sort(F.collect_list(F.struct("__i", F.col(value).cast("string").alias("x")))).alias("a"))
    every = names.first().names  # the header is one line
    before = lambda i: F.when(i > 0, F.get("a", i - 1)["__i"]).otherwise(0)
    cell = lambda x, i: F.when(x["__i"] > before(i), F.concat(F.repeat(F.lit(","), x["__i"] - before(i)), x["x"])).otherwise("")
    rest = F.repeat(F.lit(","), F.lit(len(every)) - F.element_at("a", -1)["__i"])
    quoted = lambda n: f'"{n.replace(chr(92), chr(92) * 2).replace(chr(34), chr(92) + chr(34))}"' if any(c in n for c in ',"\\') else n
    line = F.concat(F.col("date").cast("string"), F.array_join(F.transform("a", cell), ""), rest)
    own.select(line.alias(",".join(["date", *map(quoted, every)]))).write.csv(path, header=True, sep="\x01", quote="")


def csv_dataset(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Prices.csv and benchmarks.csv are wide, fundamentals.csv and meta.csv long; only tickers in both stay."""
    read = lambda n: spark.read.csv(f"{folder}/{n}.csv", header=True)

    def long(name: str, key: str, value: str) -> DataFrame:
        rows = wide_rows(spark, f"{folder}/{name}.csv").where("name <> 'date'")
        return rows.select(F.to_date("date").alias("date"), F.col("name").alias(key), F.expr("try_cast(cell as double)").alias(value)).where(f"{value} is not null and not isnan({value})")

    meta = read("meta")
    themes = F.filter(F.split(F.coalesce("themes", F.lit("")), r"\|"), lambda x: (x != "") & (x != "nan"))
    meta = meta.withColumn("themes", themes).withColumn("pays_dividend", F.col("pays_dividend").isin("1", "True", "true"))
    facts = read("fundamentals")
    facts = facts.select(F.to_date("date").alias("pub_date"), "ticker", *[(F.expr(f"nanvl(try_cast({c} as double), null)") if c in facts.columns else F.lit(None).cast("double")).alias(c) for c in FIELDS])
    prices = long("prices", "ticker", "close").join(meta.select("ticker"), "ticker", "left_semi")
    both = cut(prices.select("ticker").distinct(), "names")  # one more pass over the prices, not one a table
    return {"prices": prices, "benchmarks": long("benchmarks", "name", "level"), "fundamentals": facts.join(both, "ticker", "left_semi"), "securities": meta.join(both, "ticker", "left_semi")}


def write_dataset(tables: dict[str, DataFrame], folder: str) -> None:
    """Parquet, dated tables by year; themes pipe-joined, pays_dividend as 0 or 1."""
    for name, df in tables.items():
        if "themes" in df.columns:
            df = df.withColumn("themes", F.array_join("themes", "|")).withColumn("pays_dividend", F.col("pays_dividend").cast("int"))
        day = next((c for c in ("date", "pub_date") if c in df.columns), None)
        out = df.withColumn("year", F.year(day)).write.partitionBy("year") if day else df.write
        out.mode("overwrite").parquet(f"{folder}/{name}")


def price_payload(payloads: DataFrame, provider: str) -> DataFrame:
    """(ticker, body) to (ticker, date, close, volume); providers a, b and c differ in names. Errors and bodies
    without bars give no rows, an empty volume is null, null closes are dropped."""
    shape = {"a": "values", "b": "historical", "c": "prices"}[provider]
    body = F.from_json("body", f"struct<status:string,{shape}:{BARS},data:{BARS}>")
    bars = payloads.withColumn("__b", body).where("coalesce(__b.status, '') <> 'error'").select("ticker", F.explode(F.coalesce(F.col(f"__b.{shape}"), F.col("__b.data"))).alias("r"))
    number = lambda c: F.expr(f"try_cast({c} as double)")
    day = {"a": F.to_date(F.substring("r.datetime", 1, 10)), "b": F.to_date("r.date"), "c": F.coalesce(F.expr("try_to_timestamp(r.time)").cast("date"), F.expr("try_to_timestamp(r.date)").cast("date"), F.timestamp_millis(F.col("r.time_milliseconds").cast("long")).cast("date"))}[provider]
    close = F.coalesce(number("r.adjClose"), number("r.close")) if provider == "b" else number("r.close")
    return bars.select("ticker", day.alias("date"), close.alias("close"), number("r.volume").alias("volume")).where("close is not null")


def metrics_panel(metrics: DataFrame, mapping: dict[str, str], lag_days: int = 45) -> DataFrame:
    """Vendor metric rows (ticker, report_period, ...) to fundamentals, published lag_days later."""
    from corvane.operators.panel import growth_stability

    named = {v: F.col(k) for k, v in mapping.items()}
    out = metrics.select("ticker", F.date_add("report_period", lag_days).alias("pub_date"), *[named.get(c, F.lit(None)).cast("double").alias(c) for c in FIELDS if c not in ("earnings_vol", "growth_stability")])
    return growth_stability(out.fillna(0.0, ["dividend_yield"]), "ticker", "pub_date")


def sector_name(raw: Column) -> Column:
    """Alias, then substring, else Unknown."""
    low = F.lower(F.trim(raw))
    exact = F.create_map(*[F.lit(x) for kv in SECTORS.items() for x in kv])[low]
    part = F.coalesce(*[F.when(F.contains(low, F.lit(k)), v) for k, v in SECTORS.items()])
    return F.coalesce(exact, part, F.lit("Unknown"))


def security_dimension(profiles: DataFrame, facts: DataFrame) -> DataFrame:
    """pays_dividend by the last known dividend yield."""
    pays = facts.where("dividend_yield is not null").groupBy("ticker").agg((F.max_by("dividend_yield", "pub_date") > 0).alias("pays_dividend"))
    return profiles.join(pays, "ticker", "left").select("ticker", F.coalesce("name", "ticker").alias("name"), sector_name(F.col("sector")).alias("sector"), F.coalesce("pays_dividend", F.lit(False)).alias("pays_dividend"))


def ticker_map(body: DataFrame) -> DataFrame:
    """S8."""
    rows = body.select(F.explode(F.map_values(F.from_json("body", "map<string,struct<ticker:string,cik_str:string>>"))).alias("r"))
    return rows.select(F.upper("r.ticker").alias("ticker"), F.lpad("r.cik_str", 10, "0").alias("cik"))


def company_facts(bodies: DataFrame, priorities: DataFrame) -> DataFrame:
    """Facts of (cik, body) for each measure: the first concept that is present of priorities (measure, concept,
    prio, unit); its unit if present, else the first."""
    c = bodies.withColumn("__f", F.from_json("body", FACTS)).select("cik", F.explode("__f.facts").alias("taxonomy", "concepts")).select("cik", F.explode("concepts").alias("concept", "u"))
    j = c.join(priorities, "concept")
    j = j.withColumn("__k", F.row_number().over(Window.partitionBy("cik", "measure").orderBy("prio"))).where("__k = 1")
    unit = F.coalesce(F.try_element_at("u.units", F.col("unit")), F.element_at(F.map_values("u.units"), 1))
    return j.select("cik", "measure", "concept", F.explode(unit).alias("r")).select("cik", "measure", "concept", "r.*")


def annual_series(facts: DataFrame) -> DataFrame:
    """Of each fiscal year the value filed last."""
    ok = facts.where("fp = 'FY' and form like '10-K%' and val is not null and fy is not null")
    k = F.row_number().over(Window.partitionBy("cik", "measure", "fy").orderBy(F.desc("filed"), F.desc("end")))
    return ok.withColumn("__k", k).where("__k = 1").drop("__k")


def instant_series(facts: DataFrame) -> DataFrame:
    """One value of each filing date."""
    k = F.row_number().over(Window.partitionBy("cik", "measure", "filed").orderBy(F.desc("end"), F.desc("val")))
    return facts.where("val is not null").withColumn("__k", k).where("__k = 1").drop("__k")


def annual_pair(series: DataFrame, grid: DataFrame) -> DataFrame:
    """The last two fiscal years known on each date of grid (cik, as_of), for each measure of which there is one.
    A company's years and dates are two short lists: only what was filed moves, the rows of all dates are made where they
    end."""
    known = F.sort_array(F.collect_list(F.struct("fy", "val", "filed")), asc=False).alias("y")
    years = series.where("cik is not null").repartition("cik").groupBy("cik", "measure").agg(known)
    dates = grid.where("as_of is not null").groupBy("cik").agg(F.collect_list("as_of").alias("d"))
    rows = years.join(dates, "cik").select("cik", "measure", "y", F.explode("d").alias("as_of"))
    rows = rows.withColumn("k", F.filter("y", lambda y: F.coalesce(y["filed"].cast("date") <= F.col("as_of"), F.lit(True)))).where("size(k) > 0")
    return rows.select("cik", "as_of", "measure", F.col("k")[0]["val"].alias("latest"), F.try_element_at("k", F.lit(2))["val"].alias("previous"))


# measures of the monthly panel: flows by fiscal year, and stocks of a day
FLOWS = ("revenue", "net_income", "eps", "gross_profit", "operating_income", "ocf", "capex", "dividends", "interest", "weighted_shares")
STOCKS = ("equity", "liabilities", "assets", "cash", "debt", "shares")


def company_panel(annual: DataFrame, instant: DataFrame, grid: DataFrame) -> DataFrame:
    """FIELDS of each (cik, as_of) of grid (cik, as_of, close, and adv if known), from what was filed by then.
    annual: cik, measure, fy, val, filed of FLOWS, one row a fiscal year (see annual_series); instant: cik, measure, val,
    filed of STOCKS, one row a filing (see instant_series).

    All measures, the share counts' split factors and the grid are one sequence of days a company, carried forward in one
    shuffle: of a flow the last two fiscal years filed by a day, of a stock the last value by it and by 365 days before.
    Shares count on the basis of the latest split; earnings a share are restated by the factor in force at their own
    filing. Growth is measured over the months of the grid so far. Companies of the grid without any facts have rows of
    nulls."""
    from corvane.operators.panel import split_factors

    of = lambda m, x: F.when(F.col("measure") == m, x)
    flows = annual.groupBy("cik", "filed").agg(*[F.collect_list(of(m, F.struct("fy", "val"))).alias(f"f_{m}") for m in FLOWS])
    stocks = instant.groupBy("cik", "filed").agg(*[F.max(of(m, F.col("val"))).alias(f"s_{m}") for m in STOCKS])
    steps = split_factors(instant.where("measure = 'shares'").select(F.col("cik").alias("ticker"), F.col("filed").alias("date"), "val")).select(F.col("ticker").alias("cik"), F.col("date").alias("filed"), "factor")
    events = flows.join(stocks, ["cik", "filed"], "full").join(steps, ["cik", "filed"], "left").withColumn("day", F.unix_date("filed")).drop("filed")
    asked = grid.select("cik", "as_of", "close", (F.col("adv") if "adv" in grid.columns else F.lit(None)).cast("double").alias("adv_usd"), F.unix_date("as_of").alias("day"))
    days = Window.partitionBy("cik").orderBy("day")
    now, year_ago = days.rangeBetween(Window.unboundedPreceding, 0), days.rangeBetween(Window.unboundedPreceding, -365)
    rows = events.unionByName(asked, allowMissingColumns=True).withColumn("factor", F.coalesce(F.last("factor", True).over(now), F.lit(1.0)))
    rows = rows.withColumn("f_eps", F.transform("f_eps", lambda x: F.struct(x["fy"].alias("fy"), (x["val"] / F.col("factor")).alias("val"))))
    known = {f"f_{m}": F.slice(F.sort_array(F.flatten(F.collect_list(f"f_{m}").over(now)), asc=False), 1, 2) for m in FLOWS}
    known |= {f"s_{m}": F.last(f"s_{m}", True).over(now) for m in STOCKS}
    known |= {f"y_{m}": F.last(f"s_{m}", True).over(year_ago) for m in ("assets", "shares")}
    rows = rows.select("cik", "as_of", "close", "adv_usd", "factor", *[x.alias(k) for k, x in known.items()]).where("as_of is not null")
    last, before = (lambda m: F.try_element_at(f"f_{m}", F.lit(1))["val"]), (lambda m: F.try_element_at(f"f_{m}", F.lit(2))["val"])
    rows = rows.select("cik", "as_of", "close", "adv_usd", (F.col("close") * F.col("s_shares") * F.col("factor")).alias("cap"), *[x(m).alias(f"{p}{m}") for m in FLOWS for p, x in (("", last), ("p_", before))], *[F.col(f"s_{m}").alias(m) for m in STOCKS], "y_assets", "y_shares")
    c = F.col
    over = lambda a, b: F.when(b > 0, a / b)
    zero = lambda m: F.coalesce(m, F.lit(0.0))
    growth = lambda m: over(c(m), c(f"p_{m}")) - 1
    capital = c("equity") + zero("debt")
    out = rows.select("cik", "as_of", c("cap").alias("market_cap"), over(c("close"), c("eps")).alias("pe"), over(c("cap"), c("equity")).alias("pb"), over(c("cap") + zero("debt") - zero("cash"), c("operating_income")).alias("ev_ebit"), over(c("ocf") - c("capex"), c("cap")).alias("fcf_yield"), over(c("net_income") - c("ocf"), c("assets")).alias("accruals"), over(c("net_income"), c("equity")).alias("roe"), over(c("net_income"), capital).alias("roic"), F.when(c("revenue") != 0, c("gross_profit") / c("revenue")).alias("gross_margin"), over(c("liabilities"), c("equity")).alias("debt_equity"), over(c("operating_income"), c("interest")).alias("interest_coverage"), growth("revenue").alias("revenue_growth"), growth("eps").alias("eps_growth"), F.coalesce(growth("weighted_shares"), over(c("shares"), c("y_shares")) - 1).alias("net_issuance"), (over(c("assets"), c("y_assets")) - 1).alias("asset_growth"), F.when(c("cap") > 0, F.coalesce(c("dividends") / c("cap"), F.lit(0.0))).alias("dividend_yield"), F.coalesce(over(c("dividends"), c("net_income")), F.lit(0.0)).alias("payout_ratio"), "adv_usd")
    so_far = Window.partitionBy("cik").orderBy("as_of").rowsBetween(Window.unboundedPreceding, 0)
    spread = F.when(F.count("eps_growth").over(so_far) >= 3, F.stddev_pop("eps_growth").over(so_far))
    out = out.withColumn("earnings_vol", spread).withColumn("growth_stability", 1 / (1 + c("earnings_vol")))
    return out.select("cik", "as_of", *FIELDS)


def sic_sector(df: DataFrame, bands: DataFrame) -> DataFrame:
    """The first of the ordered bands (lo, hi, prio, sector) that holds sic."""
    j = df.join(bands, F.col("sic").between(F.col("lo"), F.col("hi")), "left")
    return j.groupBy(*df.columns).agg(F.coalesce(F.min_by("sector", "prio"), F.lit("Unknown")).alias("sector"))


def filing_counts(submissions: DataFrame, dates: DataFrame, days: int = 180) -> DataFrame:
    """Insider filings of the last `days` days; submissions: ticker, body."""
    recent = F.from_json("body", "struct<filings:struct<recent:struct<form:array<string>,filingDate:array<date>,accessionNumber:array<string>>>>")["filings"]["recent"]
    rows = submissions.select("ticker", F.explode(F.arrays_zip(recent["form"].alias("form"), recent["filingDate"].alias("filed"), recent["accessionNumber"].alias("accession"))).alias("r")).select("ticker", "r.*").where("trim(form) = '4'")
    # filings and dates are one sequence of days, of which the last ones are counted
    asked = rows.select("ticker").distinct().join(dates.select("as_of"), how="cross").withColumn("day", F.unix_date("as_of"))  # one row a ticker and date
    events = rows.select("ticker", F.unix_date("filed").alias("day"), F.lit(1).alias("one"))
    w = Window.partitionBy("ticker").orderBy("day").rangeBetween(-days, 0)
    counted = events.unionByName(asked, allowMissingColumns=True).withColumn("n_filings", F.count("one").over(w))
    return counted.where("as_of is not null and n_filings > 0").select("as_of", "ticker", "n_filings")


def insider_trades(filings: DataFrame, most: int = 25) -> DataFrame:
    """Purchases and sales in the texts of the last `most` filings of a ticker (ticker, filed, text)."""
    k = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("filed"), "text"))
    last = filings.withColumn("__k", k).where(F.col("__k") <= most)
    found = lambda tag, inner="": F.regexp_extract_all("text", F.lit(rf"(?s)<{tag}>\s*{inner}([^<\s]+)"), F.lit(1))
    rows = last.select("ticker", F.explode(F.arrays_zip(found("transactionCode").alias("code"), found("transactionShares", r"<value>\s*").alias("shares"), found("transactionPricePerShare", r"<value>\s*").alias("price"))).alias("r")).select("ticker", "r.*")
    worth = F.coalesce(F.expr("try_cast(shares as double) * try_cast(price as double)"), F.lit(0.0))
    of = lambda c, x: F.sum(F.when(F.col("code") == c, x).otherwise(0))
    return rows.groupBy("ticker").agg(of("P", F.lit(1)).alias("buys"), of("S", F.lit(1)).alias("sells"), of("P", worth).alias("buy_value"), of("S", worth).alias("sell_value"))


def daily_stock(rows: DataFrame, permnos: DataFrame, start: str, end: str) -> DataFrame:
    """Both filters reach the scan."""
    return rows.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).join(permnos, "permno", "left_semi").select("permno", "date", "prc", "ret", "vol", "shrout")


def identities(names: DataFrame) -> DataFrame:
    """The last name of each permno among common shares."""
    last = names.where("shrcd in (10, 11) or shrcd is null").groupBy("permno").agg(F.max_by(F.struct("ticker", "comnam", "siccd", "exchcd"), "nameenddt").alias("r"))
    return last.select("permno", F.coalesce("r.ticker", F.concat(F.lit("P"), F.col("permno").cast("string"))).alias("ticker"), F.initcap("r.comnam").alias("name"), F.col("r.siccd").alias("sic"), F.col("r.exchcd").alias("exchcd"))


def delistings(rows: DataFrame) -> DataFrame:
    """S17."""
    return rows.where("dlstcd > 100").groupBy("permno").agg(F.max_by(F.struct("dlstdt", "dlret", "dlstcd"), "dlstdt").alias("r")).select("permno", "r.*")


def linked(statements: DataFrame, links: DataFrame) -> DataFrame:
    """Statements joined to the link that holds on their date; open ends are null."""
    ok = links.where("linktype in ('LC', 'LU') and linkprim in ('P', 'C')").select("gvkey", "permno", "linkdt", "linkenddt")
    on = (F.coalesce("linkdt", F.col("datadate")) <= F.col("datadate")) & (F.col("datadate") <= F.coalesce("linkenddt", F.col("datadate")))
    return statements.join(ok, "gvkey").where(on).drop("linkdt", "linkenddt")


def market_index(returns: DataFrame) -> DataFrame:
    """100 times the compounded value-weighted return, as SPX and NDX."""
    level = 100 * F.product(1 + F.coalesce(F.col("vwretd"), F.lit(0.0))).over(Window.orderBy("date"))  # one row a day
    return returns.select("date", level.alias("level")).select("date", "level", F.explode(F.array(F.lit("SPX"), F.lit("NDX"))).alias("name"))


def coverage(requested: DataFrame, prices: DataFrame, least: int = 20) -> DataFrame:
    """Requested tickers with `least` usable rows or fewer."""
    ok = prices.where("close is not null").groupBy("ticker").count().where(F.col("count") > least)
    return requested.join(ok, "ticker", "left_anti")


def index_report(members: DataFrame, securities: DataFrame) -> DataFrame:
    """Known names of each index (index_id, ticker)."""
    return members.join(securities.select("ticker").withColumn("__k", F.lit(1)), "ticker", "left").groupBy("index_id").agg(F.count("*").alias("n_listed"), F.count("__k").alias("n_available"))
