"""The queries over landed forms in SQL, from the star's tables directly."""

from __future__ import annotations

from corvane.plans.panel_sql import ASOF, C, DATES, FIELDS, FIT, FUND, QUANT, RETS, out, rank

VOL = ", ev as (select *, case when count(eps_growth) over w >= 3 then stddev_pop(eps_growth) over w end as vol from fundamentals window w as (partition by ticker order by pub_date rows between unbounded preceding and current row))"
YEARS = ", yearly as (select ticker, year(date)::int as fy, sum(p)::double as rev, sum(q)::double as qty from lines group by 1, 2)"
ANNUAL = YEARS + ", annual as (select ticker as cik, 'revenue' as measure, 'SalesRevenueNet' as concept, fy, case when fy % 2 = 0 then '10-K/A' else '10-K' end as form, case when fy % 2 = 0 then rev + 1 else rev end as val, make_date(fy + 1, case when fy % 2 = 0 then 6 else 3 end, 1) as filed from yearly union all select ticker, 'assets', 'Assets', fy, '10-K', qty, make_date(fy + 1, 3, 1) from yearly)"
TRADES = ", lt as (select cast(l_suppkey as varchar) as ticker, cast(l_shipdate as date) as filed, case when l_returnflag = 'R' then 'P' else 'S' end as code, l_quantity * l_extendedprice as worth from lineitem), ld as (select ticker, filed, row_number() over (partition by ticker order by filed desc) as k from (select distinct ticker, filed from lt)), trades as (select ticker, count(*) filter (code = 'P') as buys, count(*) filter (code = 'S') as sells, coalesce(sum(worth) filter (code = 'P'), 0) as buy_value, coalesce(sum(worth) filter (code = 'S'), 0) as sell_value from lt join ld using (ticker, filed) where k <= 25 group by ticker)"
FILED = DATES + ", filed as (select as_of, ticker, count(*) as n_filings from reb join fundamentals on month(pub_date) % 2 = 1 and pub_date between as_of - 180 and as_of group by as_of, ticker)"
CRSP = RETS + ", crsp as (select ticker::int as permno, date, -close as prc, ret, volume as vol, 1000.0::double as shrout from rets)"
THEMES = "themes as (select s_suppkey, list_sort(list(distinct p_type)) as themes from supplier join lineitem on l_suppkey = s_suppkey join part on p_partkey = l_partkey where date_trunc('month', l_shipdate) = (select min(date_trunc('month', x.l_shipdate)) from lineitem x where x.l_suppkey = s_suppkey) group by s_suppkey)"
STEPS = ", s as (select ticker, month as date, qty as val, qty / lag(qty) over (partition by ticker order by month) as r from months), t as (select *, case when r >= 1.45::double or (r > 0 and r <= 0.69::double) then r else 1 end as step from s), u as (select *, coalesce(product(step) over (partition by ticker order by date rows between 1 following and unbounded following), 1) as factor from t)"
_G = lambda c: f"case when lag({c}, 4) over w <> 0 then ({c} - lag({c}, 4) over w) / abs(lag({c}, 4) over w) end"
QUARTERS = f""", q0 as (select ticker::int as permno, month as datadate, case when month(month) % 2 = 0 then month + 40 end as rdq, qty as cshoq, 10.0::double * qty as mcap, 2 * rev as atq, tax as ceqq, case when month(month) % 3 > 0 then tax / 2 end as debt, disc as niq, rev as saleq, rev * 0.6::double as cogsq, disc * 2 as oiadpq, disc + 3 as oancfq, disc / qty as epspxq from months),
q1 as (select permno, datadate, coalesce(rdq, datadate + 60) as pub_date, mcap as market_cap, mcap / nullif(4 * niq, 0) as pe, mcap / nullif(ceqq, 0) as pb, (mcap + debt) / nullif(4 * oiadpq, 0) as ev_ebit, 4 * (oancfq - 1) / nullif(mcap, 0) as fcf_yield, 4 * (niq - oancfq) / nullif(mcap, 0) as accruals, 4 * niq / nullif(ceqq, 0) as roe, 4 * oiadpq / nullif(ceqq + debt, 0) as roic, (saleq - cogsq) / nullif(saleq, 0) as gross_margin, debt / nullif(ceqq, 0) as debt_equity, oiadpq / 5.0::double as interest_coverage, 4 * 0.1::double / 10.0::double as dividend_yield,
  {_G('saleq')} as revenue_growth, {_G('epspxq')} as eps_growth, {_G('cshoq')} as net_issuance, {_G('atq')} as asset_growth from q0 window w as (partition by permno order by datadate)),
q2 as (select *, case when count(eps_growth) over w >= 3 then stddev_pop(eps_growth) over w end as earnings_vol from q1 window w as (partition by permno order by datadate rows between unbounded preceding and current row)), q3 as (select *, 1 / (1 + earnings_vol) as growth_stability from q2)"""

COMPANY = """, y0 as (select ticker, year(date)::int as fy, sum(p)::double as rev, sum(p * d)::double as disc, sum(p * t)::double as tax, sum(q)::double as qty from lines group by 1, 2),
y1 as (select *, ticker::int as k, make_date(fy + 1, 3, 1) as filed, rev + case when fy % 2 = 0 then 1 else 0 end as sales, make_date(fy + 1, case when fy % 2 = 0 then 6 else 3 end, 1) as sales_filed, qty * case when fy >= 1996 then 4.0::double else 1.0::double end as sh from y0),
y2 as (select *, sh / lag(sh) over (partition by ticker order by fy) as r from y1), y3 as (select *, coalesce(product(case when r >= 1.45::double or (r > 0 and r <= 0.69::double) then r else 1 end) over (partition by ticker order by fy rows between 1 following and unbounded following), 1) as factor from y2),
y4 as (select *, disc / qty / factor as eps, lag(disc / qty / factor) over w as p_eps, lag(sh) over w as p_sh, lag(sales) over w as p_sales from y3 window w as (partition by ticker order by fy)),
md as (select distinct last_day(date) as e from prices), me as (select (e - case dayofweek(e) when 0 then 2 when 6 then 1 else 0 end)::date as as_of from md),
g0 as (select a.as_of, t.ticker from me a, (select distinct ticker from prices) t), g1 as (select g0.as_of, g0.ticker, p.close from g0 asof join prices p on g0.ticker = p.ticker and g0.as_of >= p.date),
g2 as (select g.*, y.* exclude (ticker, sales, p_sales, sales_filed) from g1 g asof left join y4 y on g.ticker = y.ticker and g.as_of >= y.filed), g3 as (select g.*, s.sales, s.p_sales from g2 g asof left join y4 s on g.ticker = s.ticker and g.as_of >= s.sales_filed),
g4 as (select g.*, o.rev as rev_old, o.sh as sh_old from g3 g asof left join y4 o on g.ticker = o.ticker and (g.as_of - 365) >= o.filed),
g5 as (select *, close * sh * factor as cap, disc - tax / 2 as ni, tax * 2 as eq, case when ticker::int % 3 > 0 then disc / 2 end as debt, case when ticker::int % 2 = 1 then tax / 2 end as cash, case when ticker::int % 2 = 0 then disc / 10 end as div from g4),
g6 as (select ticker as cik, as_of, cap as market_cap, case when eps > 0 then close / eps end as pe, case when eq > 0 then cap / eq end as pb, case when disc > 0 then (cap + coalesce(debt, 0) - coalesce(cash, 0)) / disc end as ev_ebit, case when cap > 0 then (disc + 3 - tax / 4) / cap end as fcf_yield, case when rev > 0 then (ni - disc - 3) / (rev * 2) end as accruals, case when eq > 0 then ni / eq end as roe, case when eq + coalesce(debt, 0) > 0 then ni / (eq + coalesce(debt, 0)) end as roic,
  (rev - tax) / nullif(sales, 0) as gross_margin, case when eq > 0 then disc / eq end as debt_equity, case when tax > 0 then disc / (tax / 8) end as interest_coverage, case when p_sales > 0 then sales / p_sales - 1 end as revenue_growth, case when p_eps > 0 then eps / p_eps - 1 end as eps_growth, coalesce(case when ticker::int % 4 = 0 and p_sh > 0 then sh / p_sh - 1 end, case when sh_old > 0 then sh / sh_old - 1 end) as net_issuance, case when rev_old > 0 then rev / rev_old - 1 end as asset_growth,
  case when cap > 0 then coalesce(div / cap, 0) end as dividend_yield, coalesce(case when ni > 0 then div / ni end, 0) as payout_ratio, null::double as adv_usd from g5),
g7 as (select *, case when count(eps_growth) over w >= 3 then stddev_pop(eps_growth) over w end as earnings_vol from g6 window w as (partition by cik order by as_of rows between unbounded preceding and current row)), company as (select *, 1 / (1 + earnings_vol) as growth_stability from g7)"""

SQL: dict[str, str] = {
    "company_panel": C + COMPANY + out("cik as_of " + " ".join(f"{c}:r" for c in FIELDS), "company"),
    "csv_dataset": C + ", few as (select * from securities where ticker <> '3'), a as (select ticker, count(*) as n_prices, sum(close) as sum_close from prices group by ticker), f as (select ticker, count(pe) as n_pe from fundamentals group by ticker), " + THEMES + " select ticker, sector, pays_dividend, len(themes)::bigint as n_themes, n_prices, round(sum_close, 3) + 0.0::double as sum_close, n_pe, 0::bigint as n_accruals from few join themes on s_suppkey::varchar = ticker join a using (ticker) join f using (ticker)",
    "provider_payloads": C + "select provider, ticker, date, close, volume from prices, (values ('a'), ('b'), ('c')) v(provider) where volume > 0",
    "metrics_panel": C + VOL + " select ticker, pub_date, round(pe, 6) + 0.0::double as pe, round(roe, 6) + 0.0::double as roe, round(eps_growth, 6) + 0.0::double as eps_growth, round(coalesce(dividend_yield, 0), 6) + 0.0::double as dividend_yield, null::double as pb, round(vol, 6) + 0.0::double as earnings_vol, round(1 / (1 + vol), 6) + 0.0::double as growth_stability from ev",
    "security_dimension": C + ", l as (select ticker, last(dividend_yield order by pub_date) > 0 as pays from fundamentals where dividend_yield is not null group by ticker) select ticker, case when ticker = '5' then ticker else name end as name, case sector when 'AFRICA' then 'Materials' when 'AMERICA' then 'Technology' when 'ASIA' then 'Consumer Discretionary' when 'EUROPE' then 'Financials' else 'Unknown' end as sector, coalesce(pays, false) as pays_dividend from securities left join l using (ticker)",
    "ticker_map": "select upper(s_name) as ticker, lpad(s_suppkey::varchar, 10, '0') as cik from supplier",
    "annual_facts": C + ANNUAL + " select cik, measure, concept, fy, form, round(val, 2) + 0.0::double as val, filed from annual",
    "instant_facts": C + DATES + YEARS + ", i as (select ticker || '|assets' as ticker, make_date(fy + 1, 3, 1) as filed, qty as val from yearly union all select ticker || '|revenue', make_date(fy + 1, 3, 1), rev from yearly union all select ticker || '|revenue', make_date(fy + 1, 6, 1), rev + 1 from yearly where fy % 2 = 0), g as (select as_of, ticker from reb, (select distinct ticker from i)), n as (select g.*, i.val as v1 from g asof join i on g.ticker = i.ticker and g.as_of >= i.filed), o as (select n.*, i.val as v0 from n asof left join i on n.ticker = i.ticker and (n.as_of - 365) >= i.filed) select ticker, as_of, round(case when v0 > 0 then v1 / v0 - 1 end, 6) + 0.0::double as yoy from o",
    "annual_pairs": C + DATES + ANNUAL + ", k as (select a.cik, r.as_of, a.measure, val, row_number() over (partition by a.cik, r.as_of, a.measure order by fy desc) as k from reb r join annual a on a.filed <= r.as_of) select cik, as_of, measure, round(max(val) filter (k = 1), 2) + 0.0::double as latest, round(max(val) filter (k = 2), 2) + 0.0::double as previous from k where k <= 2 group by all",
    "sic_sectors": "select s_suppkey::varchar as ticker, s_nationkey * 90 + 50 as sic, case when s_nationkey * 90 + 50 between 100 and 999 then 'Materials' when s_nationkey * 90 + 50 between 900 and 1500 then 'Energy' when s_nationkey * 90 + 50 between 1501 and 1900 then 'Utilities' else 'Unknown' end as sector from supplier",
    "filing_counts": C + FILED + " select as_of, ticker, n_filings from filed",
    "insider_trades": C + TRADES + " select ticker, buys, sells, round(buy_value, 2) + 0.0::double as buy_value, round(sell_value, 2) + 0.0::double as sell_value from trades",
    "insider_scores": C + FILED + TRADES + f", j as (select f.as_of, f.ticker, n_filings, case when buy_value + sell_value > 0 then (buy_value - sell_value) / (buy_value + sell_value) when buys + sells > 0 then (buys - sells)::double / (buys + sells) end as net from filed f left join trades t using (ticker)), k as (select *, {rank('n_filings')} as r from j) select as_of, ticker, net is not null as detail, round(coalesce(50 + 50 * net, r, 50), 6) + 0.0::double as insider from k",
    "crsp_daily": C + CRSP + out("permno date prc:r ret:r vol:r shrout:r", "crsp"),
    "crsp_identities": "select s_suppkey::int as permno, case when s_suppkey % 5 > 0 then 'T' || s_suppkey else 'P' || s_suppkey end as ticker, 'Company 1' as name, s_nationkey as sic, 1 as exchcd from supplier where s_suppkey % 7 <> 0",
    "crsp_delisted": C + CRSP + ", base as (select permno, date, first_value(prc) over w as seed, product(1 + coalesce(ret, 0)) over (w rows between unbounded preceding and current row) as g, count(*) over (w rows between unbounded preceding and current row) as n from crsp window w as (partition by permno order by date)), ends as (select permno, max(date) as date, max_by(abs(seed) * g, date) as level, max(n) as n from base group by permno) select permno, case when permno % 10 = 7 then greatest(date + 1, date '2000-01-01') else date end as date, round(case when permno % 20 = 7 then level * 0.45::double when permno % 20 = 17 then level * 1.05::double else level end, 6) + 0.0::double as level, n + (permno % 10 = 7)::bigint as n from ends",
    "linked_statements": C + "select ticker as gvkey, case when pub_date <= date '1998-06-30' then ticker::int else ticker::int + 1000 end as permno, pub_date as datadate, round(pe, 6) + 0.0::double as pe from fundamentals",
    "market_index": C + ", r as (select date, level / lag(level) over (order by date) - 1 as r from benchmarks where name = 'SPX') select date, name, round(100 * product(1 + coalesce(r, 0)) over (partition by name order by date rows between unbounded preceding and current row), 6) + 0.0::double as level from r, (values ('SPX'), ('NDX')) v(name)",
    "source_coverage": C + "select ticker from (select ticker from securities union all select 'none') where ticker not in (select ticker from prices where volume > 0 group by ticker having count(*) > 520)",
    "index_report": C + "select 'N' || s_nationkey as index_id, count(*) as n_listed, count(*) filter (delisting_date is null) as n_available from supplier join securities on ticker = s_suppkey::varchar group by s_nationkey",
    "aligned_prices": C + ", o as (select ticker, date, close from prices where volume > 0), f as (select ticker, min(date) as first from o group by ticker), g as (select ticker, b.date from f join (select distinct date from benchmarks) b on b.date >= first) select ticker, date, last_value(close ignore nulls) over (partition by ticker order by date) as close from g left join o using (ticker, date)",
    "merged_batches": C + "select ticker, count(*) as n, round(avg(case when ticker::int % 2 = 0 then close else close * 2 end), 6) + 0.0::double as mean_close from prices group by ticker",
    "recent_prices": C + ", b as (select * from prices where date <= date '1999-12-31' and date >= date '1999-12-31' - 400) select date, ticker, round(close, 6) + 0.0::double as close, round(volume, 6) + 0.0::double as volume from b where date >= (select min(date) from (select distinct date from b order by date desc limit 63))",
    "schedules": C + ", d as (select date, row_number() over (order by date) as n from (select distinct date from prices)), e as (select distinct last_day(date) as e from d) select 'month end' as kind, (e - case dayofweek(e) when 0 then 2 when 6 then 1 else 0 end)::date as date from e union all select 'weekly', date from d where dayofweek(date) = 5 and n > 252 union all select 'monthly', max(date) from d group by date_trunc('month', date) having max(n) > 252",
    "quarterly_ratios": C + QUARTERS + out("permno datadate pub_date " + " ".join(f"round({c},9)+0.0::double~as~{c}" for c in "market_cap pe pb ev_ebit fcf_yield accruals roe roic gross_margin debt_equity interest_coverage dividend_yield revenue_growth eps_growth net_issuance asset_growth earnings_vol growth_stability".split()), "q3").replace("~", " "),
    "restated_series": C + STEPS + ", p as (select ticker, date + 10 as filed, val from s) select p.ticker, filed, round(p.val / coalesce(factor, 1), 6) + 0.0::double as val, round(factor, 6) + 0.0::double as factor from p asof left join u on p.ticker = u.ticker and p.filed >= u.date",
    "macro_fit": C + ASOF + QUANT + FIT + out("as_of ticker beta:r gbeta:r macro_fit:r", "quant join mf using (as_of, ticker)"),
    "theme_fit": C + ", " + THEMES + ", j as (select s.ticker, sector, coalesce(themes, []) as t from securities s left join themes on s_suppkey::varchar = s.ticker) select ticker, (case when list_contains(t, 'PROMO') then 20 when len(list_intersect(t, ['ECONOMY', 'SMALL', 'LARGE', 'MEDIUM'])) > 0 then least(50 + 12.0 * len(list_intersect(t, ['ECONOMY', 'SMALL', 'LARGE', 'MEDIUM'])), 85) else 50 end)::double as theme_fit, sector = 'ASIA' or list_has_any(t, ['STANDARD', 'PROMO']) as hard_excluded, case when sector = 'ASIA' then 'sector: ASIA' when list_has_any(t, ['STANDARD', 'PROMO']) then 'theme: ' || array_to_string(list_filter(t, lambda x: x in ('STANDARD', 'PROMO')), ', ') end as excluded_reason from j",
    "prior_facts": C + DATES + ", g as (select r.as_of, t.ticker from reb r, (select distinct ticker from fundamentals) t), o as (select g.as_of, f.* from g asof join fundamentals f on g.ticker = f.ticker and (g.as_of - 365) >= f.pub_date) " + out("as_of ticker pub_date roe:r gross_margin:r", "o"),
}
