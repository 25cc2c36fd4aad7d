"""Registered queries of sources and panel operators over landed forms of the star tables: Spark writes the star's rows
as a vendor would land them (payloads, filings, research tables), the operators read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import perf
from corvane.operators import panel, signals
from corvane.plans.panel_queries import dates_of, rounded, snapshot
from corvane.sources import files, star
from corvane.work import cut, new_path

text = lambda c: F.col(c).cast("string")


def csv_dataset(spark, d):
    """The tables as CSV, prices and benchmarks wide, read back; a ticker of no securities row falls out."""
    m = star.market(spark, d)
    path = new_path(spark, "csv")
    few = m.securities.where("ticker <> '3'")
    files.write_wide(m.prices, "ticker", "close", f"{path}/prices.csv")
    files.write_wide(m.benchmarks, "name", "level", f"{path}/benchmarks.csv")
    m.fundamentals.withColumnRenamed("pub_date", "date").drop("accruals").write.csv(f"{path}/fundamentals.csv", header=True)
    few.select("ticker", "name", "sector", F.array_join("themes", "|").alias("themes"), F.col("pays_dividend").cast("int").cast("string").alias("pays_dividend")).write.csv(f"{path}/meta.csv", header=True)
    got = files.csv_dataset(spark, path)
    files.write_dataset({"prices": got["prices"]}, f"{path}/out")
    back = spark.read.parquet(f"{path}/out/prices").groupBy("ticker").agg(F.count("*").alias("n_prices"), F.sum("close").alias("sum_close"))
    facts = got["fundamentals"].groupBy("ticker").agg(F.count("pe").alias("n_pe"), F.count("accruals").alias("n_accruals"))
    meta = got["securities"].select("ticker", "sector", "pays_dividend", F.size("themes").cast("long").alias("n_themes"))
    return rounded(meta.join(back, "ticker").join(facts, "ticker"), 3)


def provider_payloads(spark, d):
    """A JSON body a ticker and year in each provider's shape."""
    p = star.market(spark, d).prices.where("volume > 0")
    day, close, volume = text("date"), text("close"), text("volume")
    shapes = {"a": ("values", F.struct(day.alias("datetime"), close.alias("close"), volume.alias("volume"))), "b": ("historical", F.struct(day.alias("date"), F.lit("1").alias("close"), close.alias("adjClose"), volume.alias("volume"))), "c": ("prices", F.struct(day.alias("time"), close.alias("close"), volume.alias("volume")))}
    out = None
    for name, (field, bar) in shapes.items():
        bodies = p.groupBy("ticker", F.year("date").alias("y")).agg(F.to_json(F.struct(F.lit("ok").alias("status"), F.collect_list(bar).alias(field))).alias("body")).select("ticker", "body")
        failed = p.select("ticker", F.lit('{"status":"error"}').alias("body")).distinct()
        got = files.price_payload(bodies.unionByName(failed), name).withColumn("provider", F.lit(name))
        out = got if out is None else out.unionByName(got)
    return out


MAPPING = {"price_to_earnings_ratio": "pe", "return_on_equity": "roe", "earnings_per_share_growth": "eps_growth", "dividend_yield": "dividend_yield"}


def metrics_panel(spark, d):
    """S6."""
    f = star.market(spark, d).fundamentals
    landed = f.select("ticker", F.date_sub("pub_date", 45).alias("report_period"), *[F.col(v).alias(k) for k, v in MAPPING.items()])
    return rounded(files.metrics_panel(landed, MAPPING).select("ticker", "pub_date", *MAPPING.values(), "pb", "earnings_vol", "growth_stability"))


def security_dimension(spark, d):
    """S7."""
    m = star.market(spark, d)
    raw = F.create_map(*[F.lit(x) for kv in {"AFRICA": "Basic Materials", "AMERICA": " information technology ", "ASIA": "Consumer Cyclical Goods", "EUROPE": "FINANCIAL SERVICES", "MIDDLE EAST": "Oil"}.items() for x in kv])
    return files.security_dimension(m.securities.select("ticker", F.when(F.col("ticker") != "5", F.col("name")).alias("name"), raw[F.col("sector")].alias("sector")), m.fundamentals)


def ticker_map(spark, d):
    """One body a nation."""
    s = spark.read.parquet(f"{d}/supplier.parquet")
    one = F.struct(F.lower("s_name").alias("ticker"), text("s_suppkey").alias("cik_str"))
    return files.ticker_map(s.groupBy("s_nationkey").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(text("s_suppkey"), one)))).alias("body")))


def _company_facts(spark, d) -> DataFrame:
    """Yearly sums of each supplier as company facts: sales under a second-choice concept, with a restatement of even
    years, and assets in another unit."""
    y = star._lines(spark, d).groupBy("ticker", F.year("date").alias("fy")).agg(F.sum("p").cast("double").alias("rev"), F.sum("q").cast("double").alias("qty"))
    day = lambda tail: F.concat((F.col("fy") + 1).cast("string"), F.lit(tail))
    fact = lambda val, form, filed: F.struct(F.col("fy"), F.lit("FY").alias("fp"), F.lit(form).alias("form"), val.alias("val"), day(filed).alias("filed"), F.concat(text("fy"), F.lit("-12-31")).alias("end"))
    first, again = fact(F.col("rev"), "10-K", "-03-01"), fact(F.col("rev") + 1, "10-K/A", "-06-01")
    rows = y.groupBy("ticker").agg(F.collect_list(first).alias("f"), F.collect_list(F.when(F.col("fy") % 2 == 0, again)).alias("a"), F.collect_list(fact(F.col("qty"), "10-K", "-03-01")).alias("q"))
    units = lambda unit, values: F.struct(F.create_map(F.lit(unit), values).alias("units"))
    concepts = F.create_map(F.lit("SalesRevenueNet"), units("USD", F.concat("f", "a")), F.lit("Assets"), units("EUR", F.col("q")))
    bodies = rows.select(F.col("ticker").alias("cik"), F.to_json(F.struct(F.lit("x").alias("entityName"), F.create_map(F.lit("us-gaap"), concepts).alias("facts"))).alias("body"))
    wanted = spark.createDataFrame([("revenue", "Revenues", 0, "USD"), ("revenue", "SalesRevenueNet", 1, "USD"), ("assets", "Assets", 0, "USD")], "measure string, concept string, prio int, unit string")
    return files.company_facts(bodies, wanted)


def annual_facts(spark, d):
    """S10."""
    return rounded(files.annual_series(_company_facts(spark, d)).select("cik", "measure", "concept", "fy", "form", "val", "filed"), 2)


def instant_facts(spark, d):
    """Values of each measure by filing date; their growth over a year as of each rebalance date."""
    m = star.market(spark, d)
    s = files.instant_series(_company_facts(spark, d)).select(F.concat_ws("|", "cik", "measure").alias("ticker"), F.col("filed").alias("pub_date"), "val")
    grid = s.select("ticker").distinct().join(F.broadcast(dates_of(m)), how="cross")  # one date a month
    return rounded(panel.yoy_instant(s, grid))


def annual_pairs(spark, d):
    """The last two fiscal years known on each rebalance date."""
    m = star.market(spark, d)
    s = cut(files.annual_series(_company_facts(spark, d)).select("cik", "measure", "fy", "val", "filed"), "annual")  # read twice: the lines are not
    grid = s.select("cik").distinct().join(F.broadcast(dates_of(m)), how="cross")  # one date a month
    return rounded(files.annual_pair(s, grid), 2)


def company_panel(spark, d):
    """From bodies of company facts to the monthly fields: sixteen measures of each supplier's years under their
    concepts, sales restated in even years, cash, debt and weighted share counts for some, a split in 1996."""
    y = star._lines(spark, d).groupBy("ticker", F.year("date").alias("fy")).agg(F.sum("p").cast("double").alias("rev"), F.sum(F.col("p") * F.col("d")).cast("double").alias("disc"), F.sum(F.col("p") * F.col("t")).cast("double").alias("tax"), F.sum("q").cast("double").alias("qty"))
    k, c = F.col("ticker").cast("int"), F.col
    fact = lambda val, filed="-03-01", form="10-K": F.struct("fy", F.lit("FY").alias("fp"), F.lit(form).alias("form"), val.cast("double").alias("val"), F.concat((c("fy") + 1).cast("string"), F.lit(filed)).alias("filed"), F.concat(text("fy"), F.lit("-12-31")).alias("end"))
    shares = c("qty") * F.when(c("fy") >= 1996, 4.0).otherwise(1.0)
    values = {"SalesRevenueNet": c("rev"), "NetIncomeLoss": c("disc") - c("tax") / 2, "GrossProfit": c("rev") - c("tax"), "OperatingIncomeLoss": c("disc"), "NetCashProvidedByUsedInOperatingActivities": c("disc") + 3, "PaymentsToAcquirePropertyPlantAndEquipment": c("tax") / 4, "PaymentsOfDividends": F.when(k % 2 == 0, c("disc") / 10), "InterestExpenseDebt": c("tax") / 8, "EarningsPerShareBasic": c("disc") / c("qty"), "WeightedAverageNumberOfDilutedSharesOutstanding": F.when(k % 4 == 0, shares), "StockholdersEquity": c("tax") * 2, "Liabilities": c("disc"), "Assets": c("rev") * 2, "CashAndCashEquivalentsAtCarryingValue": F.when(k % 2 == 1, c("tax") / 2), "LongTermDebt": F.when(k % 3 > 0, c("disc") / 2), "EntityCommonStockSharesOutstanding": shares}
    units = {"EarningsPerShareBasic": "USD/shares", "WeightedAverageNumberOfDilutedSharesOutstanding": "shares", "EntityCommonStockSharesOutstanding": "shares"}
    own = y.groupBy("ticker").agg(*[F.collect_list(F.when(v.isNotNull(), fact(v))).alias(n) for n, v in values.items()], F.collect_list(F.when(c("fy") % 2 == 0, fact(c("rev") + 1, "-06-01", "10-K/A"))).alias("again"))
    entry = lambda n: F.struct(F.lit(n).alias("key"), F.struct(F.create_map(F.lit(units.get(n, "USD")), F.concat(n, "again") if n == "SalesRevenueNet" else F.col(n)).alias("units")).alias("value"))
    part = lambda names: F.map_from_entries(F.filter(F.array(*[entry(n) for n in names]), lambda e: F.size(F.element_at(F.map_values(e["value"]["units"]), 1)) > 0))
    cover = ["EntityCommonStockSharesOutstanding"]
    facts = F.map_from_arrays(F.array(F.lit("us-gaap"), F.lit("dei")), F.array(part([n for n in values if n not in cover]), part(cover)))
    bodies = own.select(F.col("ticker").alias("cik"), F.to_json(F.struct(F.lit("x").alias("entityName"), facts.alias("facts"))).alias("body"))
    wanted = [(m, n, i, units.get(names[-1], "USD")) for m, names in CONCEPTS.items() for i, n in enumerate(names)]
    found = cut(files.company_facts(bodies, spark.createDataFrame(wanted, "measure string, concept string, prio int, unit string")), "facts")
    m = star.market(spark, d)
    ends = cut(panel.month_ends(m.prices), "ends")
    closes = panel.thinned(m.prices.select("ticker", F.col("date").alias("pub_date"), "close"), ends)
    grid = panel.as_of(closes, m.prices.select("ticker").distinct().join(F.broadcast(ends), how="cross"))  # one date a month
    flows, stocks = files.annual_series(found.where(F.col("measure").isin(*files.FLOWS))), files.instant_series(found.where(F.col("measure").isin(*files.STOCKS)))
    return rounded(files.company_panel(flows, stocks, grid.select(F.col("ticker").alias("cik"), "as_of", "close")))


# fixed values: concepts of each measure, the first that a company has counts
CONCEPTS = {
    "revenue": ["RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues", "SalesRevenueNet"], "net_income": ["NetIncomeLoss"], "eps": ["EarningsPerShareDiluted", "EarningsPerShareBasic"], "gross_profit": ["GrossProfit"], "operating_income": ["OperatingIncomeLoss"],
    "ocf": ["NetCashProvidedByUsedInOperatingActivities"], "capex": ["PaymentsToAcquirePropertyPlantAndEquipment"], "dividends": ["PaymentsOfDividendsCommonStock", "PaymentsOfDividends"], "interest": ["InterestExpense", "InterestExpenseDebt"], "weighted_shares": ["WeightedAverageNumberOfDilutedSharesOutstanding", "WeightedAverageNumberOfSharesOutstandingBasic"],
    "equity": ["StockholdersEquity", "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"], "liabilities": ["Liabilities"], "assets": ["Assets"], "cash": ["CashAndCashEquivalentsAtCarryingValue"], "debt": ["LongTermDebtNoncurrent", "LongTermDebt"], "shares": ["EntityCommonStockSharesOutstanding"],
}


def sic_sectors(spark, d):
    """S12."""
    bands = spark.createDataFrame([(100, 999, 0, "Materials"), (900, 1500, 1, "Energy"), (1501, 1900, 2, "Utilities")], "lo int, hi int, prio int, sector string")
    s = spark.read.parquet(f"{d}/supplier.parquet").select(text("s_suppkey").alias("ticker"), (F.col("s_nationkey") * 90 + 50).alias("sic"))
    return files.sic_sector(s, bands)


def filing_counts(spark, d):
    """A filing a month, insider forms in odd months."""
    m = star.market(spark, d)
    one = F.struct(F.when(F.month("pub_date") % 2 == 1, " 4").otherwise("8-K").alias("form"), text("pub_date").alias("filingDate"), F.lit("x").alias("accessionNumber"))
    g = m.fundamentals.groupBy("ticker").agg(F.collect_list(one).alias("r"))
    recent = F.struct(*[F.col(f"r.{c}").alias(c) for c in ("form", "filingDate", "accessionNumber")])
    return files.filing_counts(g.select("ticker", F.to_json(F.struct(F.struct(recent.alias("recent")).alias("filings"))).alias("body")), dates_of(m))


def _insiders(spark, d) -> DataFrame:
    x = spark.read.parquet(f"{d}/lineitem.parquet").select(text("l_suppkey").alias("ticker"), F.col("l_shipdate").cast("date").alias("filed"), "l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "R", "P").otherwise("S").alias("code"), text("l_quantity").alias("q"), text("l_extendedprice").alias("p"))
    tag = F.format_string("<transactionCode>%s</transactionCode><transactionShares> <value>%s</value></transactionShares><transactionPricePerShare><value>%s</value></transactionPricePerShare>", "code", "q", "p")
    return files.insider_trades(x.groupBy("ticker", "filed").agg(F.array_join(F.array_sort(F.collect_list(tag)), "\n").alias("text")))


def insider_trades(spark, d):
    """S14."""
    return rounded(_insiders(spark, d), 2)


def insider_scores(spark, d):
    """As of each rebalance date, with the counts of filings as a third choice."""
    n = filing_counts(spark, d)
    return rounded(signals.insider_score(n.join(_insiders(spark, d), "ticker", "left")).select("as_of", "ticker", "detail", "insider"))


def _crsp(m: star.Market) -> DataFrame:
    r = m.prices.withColumn("ret", perf.daily_return(F.col("close"), "ticker"))
    return r.select(F.col("ticker").cast("int").alias("permno"), "date", (-F.col("close")).alias("prc"), "ret", F.col("volume").alias("vol"), F.lit(1000.0).alias("shrout"))


def crsp_daily(spark, d):
    """S15."""
    m = star.market(spark, d)
    return rounded(files.daily_stock(_crsp(m), m.securities.select(F.col("ticker").cast("int").alias("permno")), "1900-01-01", "2100-12-31"))


def crsp_identities(spark, d):
    """Two names a permno, the later one last; every seventh is no common share."""
    s = spark.read.parquet(f"{d}/supplier.parquet")
    kind = F.when(F.col("s_suppkey") % 7 == 0, 73).when(F.col("s_suppkey") % 7 == 1, F.lit(None)).otherwise(11)
    rows = s.select(F.col("s_suppkey").cast("int").alias("permno"), kind.cast("int").alias("shrcd"), F.explode(F.array(F.lit(0), F.lit(1))).alias("k"), "s_suppkey", "s_nationkey")
    rows = rows.select("permno", "shrcd", F.when((F.col("k") == 1) & (F.col("s_suppkey") % 5 > 0), F.concat(F.lit("T"), text("s_suppkey"))).when(F.col("k") == 0, "OLD").alias("ticker"), F.concat(F.lit("COMPANY "), text("k")).alias("comnam"), F.col("s_nationkey").alias("siccd"), F.col("k").alias("exchcd"), F.when(F.col("k") == 1, "2001-12-31").otherwise("1997-12-31").cast("date").alias("nameenddt"))
    return files.identities(rows)


def crsp_delisted(spark, d):
    """Index levels after the last row of each delisted name."""
    m = star.market(spark, d)
    k = F.col("ticker").cast("int")
    code = F.when(k % 20 == 7, 574).otherwise(200)
    gone = m.securities.where("delisting_date is not null").select(k.alias("permno"), F.col("delisting_date").alias("dlstdt"), F.when(k % 20 == 17, 0.05).alias("dlret"), code.alias("dlstcd"), F.lit(3).alias("exchcd"))
    noise = gone.withColumn("dlstcd", F.lit(100)).withColumn("dlstdt", F.date_add("dlstdt", 9))
    rows = files.delistings(gone.drop("exchcd").unionByName(noise.drop("exchcd"))).withColumn("exchcd", F.lit(3))
    levels = panel.total_return_index(panel.delisting_splice(_crsp(m), rows, nasdaq_rule=True))
    ends = levels.groupBy("permno").agg(F.max("date").alias("date"), F.max_by("level", "date").alias("level"), F.count("*").alias("n"))
    return rounded(ends)


def linked_statements(spark, d):
    """Two links a company, one of a kind that doesn't count."""
    f = star.market(spark, d).fundamentals.select(F.col("ticker").alias("gvkey"), F.col("pub_date").alias("datadate"), "pe")
    links = f.select("gvkey").distinct().select("gvkey", F.explode(F.from_json(F.lit('[{"t":"LC","p":"P","a":null,"b":"1998-06-30","o":0},{"t":"LU","p":"C","a":"1998-07-01","b":null,"o":1000},{"t":"LX","p":"P","a":null,"b":null,"o":2000}]'), "array<struct<t:string,p:string,a:date,b:date,o:int>>")).alias("l"))
    links = links.select("gvkey", (F.col("gvkey").cast("int") + F.col("l.o")).alias("permno"), F.col("l.t").alias("linktype"), F.col("l.p").alias("linkprim"), F.col("l.a").alias("linkdt"), F.col("l.b").alias("linkenddt"))
    return rounded(files.linked(f, links).select("gvkey", "permno", "datadate", "pe"))


def market_index(spark, d):
    """S19."""
    b = star.market(spark, d).benchmarks.where("name = 'SPX'")
    return rounded(files.market_index(b.select("date", (F.col("level") / F.lag("level").over(Window.orderBy("date")) - 1).alias("vwretd"))))


def source_coverage(spark, d):
    """Requested tickers with too few rows, one of them unknown."""
    m = star.market(spark, d)
    asked = m.securities.select("ticker").unionByName(spark.createDataFrame([("none",)], "ticker string"))
    return files.coverage(asked, m.prices.where("volume > 0"), 520)


def index_report(spark, d):
    """Nations as indices, with names that have left."""
    m = star.market(spark, d)
    s = spark.read.parquet(f"{d}/supplier.parquet").select(F.concat(F.lit("N"), text("s_nationkey")).alias("index_id"), text("s_suppkey").alias("ticker"))
    left = panel.index_membership(m.securities.where("delisting_date is null").select("ticker"), m.securities.where("delisting_date is not null").select("ticker", "delisting_date"))
    return files.index_report(s, left.where("delisting_date is null"))


def aligned_prices(spark, d):
    """Trading days alone, aligned to the index's calendar."""
    m = star.market(spark, d)
    return panel.align(m.prices.where("volume > 0").select("ticker", "date", "close"), m.benchmarks.select("date"))


def merged_batches(spark, d):
    """The earlier batch's rows of a ticker stay."""
    p = star.market(spark, d).prices.select("ticker", "date", "close")
    return rounded(panel.merge_batches([p.where("cast(ticker as int) % 2 = 0"), p.withColumn("close", F.col("close") * 2)], ["ticker"]).groupBy("ticker").agg(F.count("*").alias("n"), F.avg("close").alias("mean_close")))


def recent_prices(spark, d):
    """T4, T5: the last 63 days of the calendar up to a day."""
    p = star.market(spark, d).prices
    return rounded(panel.trailing_rows(panel.before(p, "1999-12-31", 400), 63))


def schedules(spark, d):
    """Month ends, Fridays and last trading days."""
    p = star.market(spark, d).prices
    return panel.month_ends(p).select(F.lit("month end").alias("kind"), F.col("as_of").alias("date")).unionByName(panel.walk_schedule(p).select(F.lit("weekly").alias("kind"), "date")).unionByName(panel.walk_schedule(p, weekly=False).select(F.lit("monthly").alias("kind"), "date"))


def quarterly_ratios(spark, d):
    """The months' sums as quarterly statements."""
    m = F.trunc("date", "month")
    s = star._lines(spark, d).groupBy("ticker", m.alias("datadate")).agg(*[F.sum(x).cast("double").alias(n) for n, x in (("saleq", F.col("p")), ("niq", F.col("p") * F.col("d")), ("ceqq", F.col("p") * F.col("t")), ("cshoq", F.col("q")))])
    c = F.col
    q = s.select(c("ticker").cast("int").alias("permno"), "datadate", F.when(F.month("datadate") % 2 == 0, F.date_add("datadate", 40)).alias("rdq"), F.lit(10.0).alias("prccq"), "cshoq", (c("saleq") * 2).alias("atq"), "ceqq", F.when(F.month("datadate") % 3 > 0, c("ceqq") / 2).alias("dlttq"), F.lit(None).cast("double").alias("dlcq"), "niq", "saleq", (c("saleq") * 0.6).alias("cogsq"), (c("niq") * 2).alias("oiadpq"), F.lit(5.0).alias("xintq"), F.lit(1.0).alias("capxq"), (c("niq") + 3).alias("oancfq"), F.lit(0.1).alias("dvpsxq"), (c("niq") / c("cshoq")).alias("epspxq"))
    return rounded(panel.quarterly_ratios(q), 9)


def restated_series(spark, d):
    """Quantities per month over the split factor as of their filing."""
    s = star._lines(spark, d).groupBy("ticker", F.trunc("date", "month").alias("date")).agg(F.sum("q").cast("double").alias("val"))
    per = s.select("ticker", F.date_add("date", 10).alias("filed"), "val")
    return rounded(panel.restated(per, cut(panel.split_factors(s), "factors")))


def macro_fit(spark, d):
    """G24. No fact is needed for it, nor any price between those that were observed."""
    from corvane.plans.panel_queries import macro, price_features

    m = star.market(spark, d)
    return rounded(macro(m, cut(price_features(m, betas=True), "betas")).select("as_of", "ticker", "beta", "gbeta", "macro_fit"))


def theme_fit(spark, d):
    """Themes wanted and not, and hard exclusions, by region and theme."""
    from corvane.operators import risk

    m = star.market(spark, d)
    s = m.securities.withColumn("theme_fit", signals.theme_fit(F.col("themes"), ["ECONOMY", "SMALL", "LARGE", "MEDIUM"], ["PROMO"]))
    return risk.exclusions(s, ["ASIA"], ["STANDARD", "PROMO"]).select("ticker", "theme_fit", "hard_excluded", "excluded_reason")


def prior_facts(spark, d):
    """Each date's facts of a year before."""
    return rounded(snapshot(star.market(spark, d), 365).select("as_of", "ticker", "pub_date", "roe", "gross_margin"))


QUERIES = {f.__name__: f for f in (csv_dataset, provider_payloads, metrics_panel, security_dimension, ticker_map, annual_facts, instant_facts, annual_pairs, company_panel, sic_sectors, filing_counts, insider_trades, insider_scores, crsp_daily, crsp_identities, crsp_delisted, linked_statements, market_index, source_coverage, index_report, aligned_prices, merged_batches, recent_prices, schedules, quarterly_ratios, restated_series, macro_fit, theme_fit, prior_facts)}
