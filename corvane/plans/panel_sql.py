"""The registered panel queries in SQL, written apart from their Spark form."""

from __future__ import annotations

from corvane.sources.star import ORACLE_CTE

X = "partition by as_of"
FIELDS = "market_cap pe pb ev_ebit fcf_yield accruals roe roic gross_margin earnings_vol debt_equity interest_coverage revenue_growth eps_growth growth_stability net_issuance asset_growth dividend_yield payout_ratio adv_usd".split()
STYLES = "value quality growth garp momentum low_vol".split()
# fixed values: template, style, weight
TEMPLATE_ROWS = """('deep_value', 'value', 0.67), ('deep_value', 'quality', 0.22), ('deep_value', 'low_vol', 0.11),
('quality_compounder', 'quality', 0.55), ('quality_compounder', 'growth', 0.2), ('quality_compounder', 'value', 0.15), ('quality_compounder', 'low_vol', 0.1),
('garp_blend', 'garp', 0.4), ('garp_blend', 'growth', 0.25), ('garp_blend', 'quality', 0.2), ('garp_blend', 'value', 0.15),
('momentum_tilt', 'momentum', 0.55), ('momentum_tilt', 'growth', 0.2), ('momentum_tilt', 'quality', 0.15), ('momentum_tilt', 'low_vol', 0.1),
('defensive_low_vol', 'low_vol', 0.53), ('defensive_low_vol', 'quality', 0.35), ('defensive_low_vol', 'value', 0.12),
('hybrid_multifactor', 'value', 0.22), ('hybrid_multifactor', 'quality', 0.28), ('hybrid_multifactor', 'growth', 0.17), ('hybrid_multifactor', 'momentum', 0.22), ('hybrid_multifactor', 'low_vol', 0.11)"""
# fixed values: regime, style, weight; without income
PRIOR_ROWS = """('bull_low_vol', 'momentum', 0.25), ('bull_low_vol', 'growth', 0.22), ('bull_low_vol', 'quality', 0.2), ('bull_low_vol', 'garp', 0.15), ('bull_low_vol', 'value', 0.1), ('bull_low_vol', 'low_vol', 0.04),
('bull_high_vol', 'quality', 0.28), ('bull_high_vol', 'momentum', 0.2), ('bull_high_vol', 'growth', 0.15), ('bull_high_vol', 'garp', 0.12), ('bull_high_vol', 'low_vol', 0.13), ('bull_high_vol', 'value', 0.08),
('bear_low_vol', 'quality', 0.3), ('bear_low_vol', 'low_vol', 0.25), ('bear_low_vol', 'value', 0.18), ('bear_low_vol', 'garp', 0.07), ('bear_low_vol', 'growth', 0.03), ('bear_low_vol', 'momentum', 0.02),
('bear_high_vol', 'low_vol', 0.32), ('bear_high_vol', 'quality', 0.3), ('bear_high_vol', 'value', 0.12), ('bear_high_vol', 'garp', 0.04), ('bear_high_vol', 'growth', 0.02), ('bear_high_vol', 'momentum', 0.02),
('sideways_low_vol', 'quality', 0.24), ('sideways_low_vol', 'value', 0.22), ('sideways_low_vol', 'garp', 0.18), ('sideways_low_vol', 'low_vol', 0.14), ('sideways_low_vol', 'momentum', 0.08), ('sideways_low_vol', 'growth', 0.04),
('sideways_high_vol', 'quality', 0.28), ('sideways_high_vol', 'low_vol', 0.22), ('sideways_high_vol', 'value', 0.2), ('sideways_high_vol', 'garp', 0.08), ('sideways_high_vol', 'momentum', 0.04), ('sideways_high_vol', 'growth', 0.04)"""
TEMPLATES = f"(select t as template, s as style, w::double as w from (values {TEMPLATE_ROWS}) v(t, s, w))"
PRIORS = f"(select r as regime, s as style, w::double as prior from (values {PRIOR_ROWS}) v(r, s, w))"


def rank(x: str, high: bool = True, part: str = "as_of") -> str:
    """Values that are equal to eight digits are ties."""
    order, x = "asc" if high else "desc", f"round({x}, 8)"
    return f"case when {x} is null then null when min({x}) over (partition by {part}) = max({x}) over (partition by {part}) then 50 else (rank() over (partition by {part} order by {x} {order} nulls last) + (count(*) over (partition by {part}, {x}) - 1) / 2.0::double) / count({x}) over (partition by {part}) * 100 end"


def mix(**weights: float) -> str:
    top = " + ".join(f"coalesce({c} * {w}::double, 0)" for c, w in weights.items())
    below = " + ".join(f"case when {c} is null then 0 else {w}::double end" for c, w in weights.items())
    return f"({top}) / nullif({below}, 0)"


def clip(x: str, low: float = 0, high: float = 100) -> str:
    return f"case when {x} is not null then greatest({low}::double, least({high}::double, {x})) end"


def out(cols: str, source: str, tail: str = "") -> str:
    """cols: `name` or `name:round`."""
    named = [(f"round({c[:-2]}, 6) + 0.0::double as {c[:-2]}" if c.endswith(":r") else c) for c in cols.split()]
    return f"select {', '.join(named)} from {source} {tail}"


DATES = ", reb as (select as_of, lead(as_of) over (order by as_of) as next_as_of from (select min(date) as as_of from prices group by date_trunc('month', date)))"
ASOF = DATES + ", grid2 as (select r.as_of, t.ticker from reb r, (select distinct ticker from fundamentals) t), facts as (select g.as_of, f.* from grid2 g asof join fundamentals f on g.ticker = f.ticker and g.as_of >= f.pub_date)"
GRAHAM = "case when pe > 0 and pb > 0 then sqrt(pe * pb / 22.5::double) end"
FUND = ASOF + f""", g1 as (select *, {clip(f"1 - {GRAHAM}", -2, 1)} as margin_of_safety_pct, coalesce(pe > 0 and pb > 0 and pe <= 15 and pb <= 1.5::double, false) as graham_pass,
  {", ".join(f"{rank(c, h)} as r_{c}" for c, h in dict(interest_coverage=1, fcf_yield=1, pe=0, pb=0, ev_ebit=0, debt_equity=0, accruals=0, roe=1, roic=1, gross_margin=1, growth_stability=1, earnings_vol=0, revenue_growth=1, eps_growth=1, net_issuance=0, asset_growth=0).items())}, 100 - {rank("accruals")} as r_cash,
  case when dividend_yield > 0 then dividend_yield end as y, case when eps_growth is not null then pe / (greatest(eps_growth, 0.01::double) * 100) end as peg from facts),
g2 as (select *, {rank("margin_of_safety_pct")} as r_mos, {rank("y")} as r_y, {rank("peg", False)} as r_peg, {mix(r_pe=.4, r_pb=.25, r_ev_ebit=.35)} as valuation, {mix(r_debt_equity=.5, r_interest_coverage=.5)} as balance_sheet, {mix(r_fcf_yield=.65, r_accruals=.35)} as cash_flow,
  {mix(r_roe=.35, r_roic=.4, r_gross_margin=.25)} as profitability, {mix(r_earnings_vol=.5, r_growth_stability=.5)} as steady, {mix(r_revenue_growth=.4, r_eps_growth=.4, r_growth_stability=.2)} as growth from g1),
fund as (select as_of, ticker, {mix(r_mos=.6, r_fcf_yield=.4)} as intrinsic, margin_of_safety_pct, graham_pass, {mix(valuation=.55, balance_sheet=.2, cash_flow=.25)} as value, coalesce((valuation >= 70 or graham_pass) and balance_sheet >= 50, false) as margin_of_safety, {mix(profitability=.6, steady=.4)} as quality, growth, {mix(r_peg=.6, growth=.4)} as garp,
  coalesce({clip("r_y - 60 * greatest(coalesce(payout_ratio, 0) - 0.6::double, 0)")}, 15) as income, coalesce({mix(r_net_issuance=.4, r_asset_growth=.35, r_accruals=.25)}, 50) as discipline, (coalesce(r_roic, 50) + coalesce({mix(r_growth_stability=.5, r_cash=.5)}, 50) + coalesce(r_gross_margin, 50)) / 3.0::double as analyst from g2)"""
RETS = ", spx as (select date, level, level / lag(level) over (order by date) - 1 as m from benchmarks where name = 'SPX'), ndx as (select date, level / lag(level) over (order by date) - 1 as n from benchmarks where name = 'NDX'), rets as (select p.*, close / lag(close) over (partition by ticker order by p.date) - 1 as ret, s.m, s.level as spx, x.n - s.m as g from prices p left join spx s on p.date = s.date left join ndx x on p.date = x.date)"
QUANT = RETS + f""", f0 as (select date, ticker, close, row_number() over w as n, lag(close, 20) over w as near, coalesce(lag(close, 251) over w, nth_value(close, 2) over w) as back, stddev_pop(ret) over (w rows between 125 preceding and current row) * sqrt(252) as vol, covar_samp(case when m is not null then ret end, m) over (w rows between 251 preceding and current row) / nullif(var_pop(m) over (w rows between 251 preceding and current row), 0) as b, covar_samp(case when g is not null then ret end, g) over (w rows between 251 preceding and current row) / nullif(var_pop(g) over (w rows between 251 preceding and current row), 0) as gb from rets window w as (partition by ticker order by date)),
f1 as (select f.date as as_of, f.ticker, case when n >= 40 then near / back - 1 end as mom, case when n >= 40 then f.close / near - 1 end as rev, case when n >= 40 then vol end as volatility, case when b is null or isnan(b) or n < 30 then 1 else b end as beta, case when gb is null or isnan(gb) or n < 30 then 0 else gb end as gbeta, facts.market_cap from f0 f join reb on f.date = reb.as_of left join facts on facts.as_of = f.date and facts.ticker = f.ticker),
f2 as (select *, {rank("mom")} as momentum, {rank("rev", False)} as reversal, {rank("volatility", False)} as low_vol, {rank("market_cap", False)} as size, {rank("beta", False)} as macro_tilt from f1),
quant as (select as_of, ticker, momentum, low_vol, size, case when mom is null and volatility is null then 50 else {mix(momentum=.45, low_vol=.30, size=.15, reversal=.10)} end as factor, beta, gbeta, macro_tilt, volatility from f2)"""
STYLED = FUND + QUANT + f", styles as (select as_of, ticker, {', '.join(STYLES)} from fund join quant using (as_of, ticker))"
BOOKS = ", picked as (select *, row_number() over (partition by as_of order by round(value, 8) desc, ticker) as k from fund where value is not null), books as (select 'value' as portfolio_id, as_of, ticker, value / sum(value) over (partition by as_of) as weight from picked where k <= 10)"
MOVES = BOOKS + ", prev as (select 'value' as portfolio_id, r.next_as_of as as_of, b.ticker, b.weight from books b join reb r using (as_of) where r.next_as_of in (select as_of from books)), moves as (select coalesce(b.portfolio_id, p.portfolio_id) as portfolio_id, coalesce(b.as_of, p.as_of) as as_of, coalesce(b.ticker, p.ticker) as ticker, coalesce(b.weight, 0) as target_weight, coalesce(p.weight, 0) as current_weight from books b full join prev p on b.as_of = p.as_of and b.ticker = p.ticker)"
SEG = ", seg as (select r.as_of, x.* from reb r join rets x on x.date > r.as_of and (r.next_as_of is null or x.date <= r.next_as_of))"
METRICS = lambda key, src: f""", c0 as (select *, product(1 + ret) over (partition by {key} order by date rows between unbounded preceding and current row) as e from {src} where ret is not null), c1 as (select *, e / max(e) over (partition by {key} order by date rows between unbounded preceding and current row) - 1 as dd from c0),
m0 as (select {key}, product(1 + ret) as g, count(*) as n, stddev_pop(ret) as sd, min(dd) as max_drawdown from c1 group by {key}), m1 as (select {key}, min(y) as worst_year from (select {key}, product(1 + ret) - 1 as y from c1 group by {key}, year(date)) group by {key}),
metrics as (select {key}, power(g, 252.0::double / n) - 1 as ann_return, case when n >= 2 then sd * sqrt(252) end as ann_vol, case when sd > 0 then (power(g, 252.0::double / n) - 1) / (sd * sqrt(252)) end as sharpe, g - 1 as total_return, max_drawdown, n as n_days, worst_year from m0 join m1 using ({key}))"""  # noqa: E731

def backtest(survivors: bool, tag: str = "", pit: bool = False) -> str:
    """With pit the CTE of MEMBERS comes before."""
    rule = "where true" + (" and ticker in (select ticker from securities where delisting_date is null)" if survivors else "") + (" and (as_of, ticker) in (select (as_of, ticker) from members)" if pit else "")
    return f""", ts{tag} as (select template, as_of, ticker, sum(x * w) / sum(w) as score from (unpivot styles on {', '.join(STYLES)} into name style value x) join {TEMPLATES} t using (style) where x is not null group by all),
top{tag} as (select *, row_number() over (partition by template, as_of order by round(score, 8) desc nulls last, ticker) as k from ts{tag} {rule}),
segr{tag} as (select r.as_of, p.date, p.ticker, p.close / lag(p.close) over (partition by r.as_of, p.ticker order by p.date) - 1 as ret from reb r join prices p on p.date > r.as_of and (r.next_as_of is null or p.date <= r.next_as_of)),
daily{tag} as (select template, date, avg(ret) as ret, min(s.as_of) as as_of from top{tag} t join segr{tag} s using (as_of, ticker) where k <= 10 group by template, date having avg(ret) is not null)"""


REGIME = """, ma0 as (select *, case when count(close) over w >= 20 then avg(close) over w end as ma from prices window w as (partition by ticker order by date rows between 199 preceding and current row)),
br as (select date, case when count(ma) > 0 then avg(case when coalesce(close > ma, false) then 1.0::double else 0 end) else 0.5::double end as breadth from ma0 group by date),
bx as (select date, level, level / lag(level) over (order by date) - 1 as r, row_number() over (order by date) as n from benchmarks where name = 'SPX'),
by0 as (select bx.*, avg(level) over (order by date rows between 199 preceding and current row) as ma, level / coalesce(lag(level, 125) over (order by date), first_value(level) over (order by date)) - 1 as ret6, stddev_pop(r) over (order by date rows between 20 preceding and current row) as v21, stddev_pop(r) over (order by date) as vall from bx),
regimes as (select date, case when n < 60 then 'sideways_low_vol' else (case when level > ma and ret6 > 0.02::double and breadth > 0.55::double then 'bull' when level < ma and ret6 < -0.02::double and breadth < 0.45::double then 'bear' else 'sideways' end) || '_' || (case when v21 > 1.15::double * vall then 'high_vol' else 'low_vol' end) end as regime, breadth from by0 left join br using (date))"""
MEMBERS = ", adv0 as (select *, avg(close * volume) over (partition by ticker order by date rows between 62 preceding and current row) as adv from prices), members as (select a.date as as_of, a.ticker, a.close, a.adv from adv0 a join reb on a.date = reb.as_of join securities s on s.ticker = a.ticker where (s.delisting_date is null or s.delisting_date > a.date) and close >= 5 and adv >= 1000)"
MACRO = f""", w0 as (select date, max(level) filter (name = 'SPX') as s, max(level) filter (name = 'NDX') as n from benchmarks group by date), w1 as (select *, row_number() over (order by date) as i, s / lag(s) over (order by date) - 1 as r from w0),
w2 as (select *, lag(s, 20) over (order by date) / coalesce(lag(s, 251) over (order by date), nth_value(s, 2) over (order by date)) - 1 as trend, stddev_pop(r) over (order by date rows between 62 preceding and current row) * sqrt(252) as vol, s / max(s) over (order by date rows between 251 preceding and current row) - 1 as dd, n / lag(n, 126) over (order by date) - s / lag(s, 126) over (order by date) as leadership from w1),
w3 as (select *, case when stddev_pop(vol) over y > 0 then (vol - avg(vol) over y) / stddev_pop(vol) over y else 0 end as vol_z from w2 window y as (order by date rows between 251 preceding and current row)),
w4 as (select *, case when i < 130 then 0.5::double else {clip("0.5::double + 1.2::double * tanh(4 * trend) - 0.35::double * tanh(vol_z) + 3 * dd", 0, 1)} end as risk_on from w3), w5 as (select *, case when risk_on >= 0.66::double then 'risk-on' when risk_on <= 0.34::double then 'risk-off' else 'neutral' end as label from w4)"""
Z = lambda x: f"case when coalesce(stddev_pop({x}) over ({X}), 0) = 0 then 0 else ({x} - avg({x}) over ({X})) / stddev_pop({x}) over ({X}) end"
FIT = MACRO + f", mf0 as (select q.as_of, ticker, (coalesce(risk_on, 0.5::double) - 0.5::double) * 2 as tilt, coalesce(leadership, 0) as lead, {Z('beta')} as zb, {Z('gbeta')} as zg from quant q left join w5 on w5.date = q.as_of), mf1 as (select *, tilt * zb + 0.5::double * tilt * tanh(50 * lead) * zg as a from mf0), mf as (select as_of, ticker, {rank('a')} as macro_fit from mf1)"
FEATURES = "value quality growth garp discipline momentum low_vol size factor macro_tilt macro_fit analyst".split()
RAW = "pe pb ev_ebit fcf_yield roe roic gross_margin earnings_vol debt_equity interest_coverage revenue_growth eps_growth growth_stability accruals net_issuance asset_growth".split()
ALL = FEATURES + [f"f_{c}" for c in RAW]
# ranks among the eligible names alone
ONLY = lambda text, name: text.replace(f", {name} as (", f", {name}_all as (", 1)
PIT_FUND = (ONLY(FUND, "facts")).replace(", g1 as (", MEMBERS + ", facts as (select * from facts_all where (as_of, ticker) in (select (as_of, ticker) from members)), g1 as (", 1)
PIT_QUANT = QUANT.replace("\nf1 as (", "\nf1_all as (", 1).replace("\nf2 as (", "\nf1 as (select * from f1_all where (as_of, ticker) in (select (as_of, ticker) from members)),\nf2 as (", 1)
FRAME = PIT_FUND + PIT_QUANT + FIT + f", raw as (select as_of, ticker, {', '.join(f'{rank(c)} as f_{c}' for c in RAW)} from facts), frame as (select as_of, ticker, {', '.join(ALL)} from raw left join fund using (as_of, ticker) left join quant using (as_of, ticker) left join mf using (as_of, ticker))"
TRAIN = FRAME + f""", fwd as (select date as as_of, ticker, lead(close, 126) over (partition by ticker order by date) / close - 1 as fwd_return from prices),
tp0 as (select as_of, ticker, {', '.join(f'coalesce({c}, 50) as {c}' for c in ALL)}, fwd_return, count(*) over ({X}) as n from frame join fwd using (as_of, ticker) where fwd_return is not null),
train as (select * exclude (n), fwd_return - avg(fwd_return) over ({X}) as fwd_excess, (fwd_return > quantile_cont(fwd_return, 0.5) over ({X}))::int as outperform from tp0 where n >= 5)"""
RISK_WIN = lambda days, cond="true": RETS + DATES + f", num as (select *, row_number() over (partition by ticker order by date) as i from rets), win as (select a.date as as_of, b.* from num a join reb on a.date = reb.as_of and {cond} join num b on a.ticker = b.ticker and b.i <= a.i and b.i > a.i - {days})"
C = ORACLE_CTE
# fixed values: feature, family, expected sign, source, lag, history, proxy
REGISTRY = """('value', 'value', 1, 'derived', 45, 0, false), ('quality', 'quality', 1, 'derived', 45, 0, false), ('growth', 'growth', 1, 'derived', 45, 0, false), ('garp', 'growth', 1, 'derived', 45, 0, false), ('discipline', 'discipline', 1, 'derived', 45, 0, false),
('momentum', 'momentum', 1, 'derived', 0, 252, false), ('low_vol', 'risk', 1, 'derived', 0, 252, false), ('size', 'risk', 1, 'derived', 0, 252, false), ('factor', 'momentum', 0, 'derived', 0, 252, false), ('macro_tilt', 'macro', 0, 'derived', 0, 0, false), ('macro_fit', 'macro', 0, 'derived', 0, 0, false), ('analyst', 'analyst_proxy', 0, 'derived', 0, 0, true),
('f_pe', 'value', 1, 'sec', 45, 365, false), ('f_pb', 'value', 1, 'sec', 45, 365, false), ('f_ev_ebit', 'value', 1, 'sec', 45, 365, false), ('f_fcf_yield', 'value', 1, 'sec', 45, 365, false), ('f_roe', 'quality', 1, 'sec', 45, 365, false), ('f_roic', 'quality', 1, 'sec', 45, 365, false), ('f_gross_margin', 'quality', 1, 'sec', 45, 365, false), ('f_earnings_vol', 'risk', 1, 'sec', 45, 365, false),
('f_debt_equity', 'risk', 1, 'sec', 45, 365, false), ('f_interest_coverage', 'risk', 1, 'sec', 45, 365, false), ('f_revenue_growth', 'growth', 1, 'sec', 45, 365, false), ('f_eps_growth', 'growth', 1, 'sec', 45, 365, false), ('f_growth_stability', 'growth', 1, 'sec', 45, 365, false), ('f_accruals', 'discipline', 1, 'sec', 45, 365, false), ('f_net_issuance', 'issuance', 1, 'sec', 45, 365, false), ('f_asset_growth', 'discipline', 1, 'sec', 45, 365, false)"""
F_COLS = "as_of ticker intrinsic:r margin_of_safety_pct:r graham_pass value:r margin_of_safety quality:r growth:r garp:r income:r discipline:r"
TESTS = ["roa > 0", "fcf_yield > 0", "roa > p_roa", "accruals < 0", "debt_equity < p_debt_equity", "interest_coverage > p_interest_coverage", "net_issuance <= 0", "gross_margin > p_gross_margin", "revenue_growth > asset_growth"]

RISK = RISK_WIN(253) + f""", k0 as (select as_of, ticker, date, case when i > min(i) over (partition by as_of, ticker) then ret end as ret, case when i > min(i) over (partition by as_of, ticker) then m end as m from win),
k1 as (select *, case when ret is not null then product(1 + coalesce(ret, 0)) over (partition by as_of, ticker order by date rows between unbounded preceding and current row) end as curve from k0), k2 as (select *, curve / max(curve) over (partition by as_of, ticker order by date rows between unbounded preceding and current row) - 1 as dd from k1),
k3 as (select as_of, ticker, stddev_pop(ret) * sqrt(252) as vol, case when covar_samp(case when m is not null then ret end, m) / nullif(var_pop(m), 0) is null or count(ret) < 30 then 1 else covar_samp(case when m is not null then ret end, m) / nullif(var_pop(m), 0) end as beta, min(dd) as mdd, avg((dd < -0.10::double)::int) as dd_freq from k2 group by as_of, ticker), k4 as (select *, {rank('vol', False)} as r_vol, {rank('mdd')} as r_mdd, {rank('dd_freq', False)} as r_freq from k3), k5 as (select *, {mix(r_vol=.5, r_mdd=.3, r_freq=.2)} as risk_score from k4),
risks as (select *, case when count(vol) over ({X}) = count(*) over ({X}) and count(vol) over ({X}) > 1 then greatest(1, ceil(5.0::double * (row_number() over ({X} order by round(vol, 8) nulls last, ticker) - 1) / (count(vol) over ({X}) - 1))) else 3 end::int as risk_band, coalesce(round(vol, 8) > quantile_cont(round(vol, 8), 0.85) over ({X}) or mdd < -0.40::double, false) as tail from k5)"""

QUALITY = f""", qp as (select as_of, ticker, avg((close is null)::int) as missing, count(distinct close) <= 1 and count(close) > 1 as stale, coalesce(max(abs(ret)) > 0.5::double, false) as outlier from win group by all), qo as (select as_of, avg(missing) as missing, sum(stale::int) as stale, sum(outlier::int) as outliers, count(*) as n from qp group by as_of),
qv as (select qo.*, coalesce(c, 0) as coverage from qo left join (select as_of, ({' + '.join(f'count({c})' for c in FIELDS)})::double / (count(*) * {len(FIELDS)}) as c from facts group by as_of) using (as_of)),
quality as (select as_of, missing, stale::bigint as stale, outliers::bigint as outliers, n, coverage, case when missing > 0.10::double or coverage < 0.6::double or stale > 0.2::double * n then 'Critical' when missing > 0.02::double or stale > 0 or outliers > 0 or coverage < 0.9::double then 'Warning' else 'OK' end as status from qv)"""
# fixed values: templates in the order that decides ties
BEST = """, cal as (select date, row_number() over (order by date) as i from (select distinct date from prices)), tw as (select r.as_of, coalesce(b.date, (select min(date) from prices)) as start from reb r join cal c on c.date = r.as_of left join cal b on b.i = c.i - 999),
tr as (select tw.as_of, d.template, product(1 + ret) as g, count(*) as n, stddev_pop(ret) as sd from tw join daily d on d.date > tw.start and d.date <= tw.as_of group by tw.as_of, d.template),
tb as (select tw.as_of, v.template, place, case when n >= 2 and sd > 1e-12 then (power(g, 252.0::double / n) - 1) / (sd * sqrt(252)) end as sharpe from tw cross join (values ('deep_value', 0), ('quality_compounder', 1), ('garp_blend', 2), ('momentum_tilt', 3), ('defensive_low_vol', 4), ('hybrid_multifactor', 5)) v(template, place) left join tr on tr.as_of = tw.as_of and tr.template = v.template),
best as (select as_of, template, sharpe from tb qualify row_number() over (partition by as_of order by case when abs(sharpe) > 1e-12 then round(sharpe, 9) end desc nulls last, place) = 1)"""
# the same chain on the rebalance dates and on the days five rows before each
REB0 = DATES.replace("reb as (", "reb0 as (", 1) + ", cal0 as (select date, row_number() over (order by date) as i from (select distinct date from prices)), lags as (select r.as_of, b.date as lagged from reb0 r join cal0 c on c.date = r.as_of left join cal0 b on b.i = c.i - 5), reb as (select as_of, next_as_of from reb0 union all select distinct lagged, null::date from lags where lagged is not null and lagged not in (select as_of from reb0))"
BOTH = lambda text: text.replace(DATES, REB0, 1)
STABLE = f""", sw as (select r.as_of, {', '.join(f"coalesce(sum(p.prior) filter (p.style = '{c}'), 0) as w_{c}" for c in STYLES)} from reb0 r join regimes g on g.date = r.as_of join {PRIORS} p using (regime) group by r.as_of),
sb as (select l.as_of, n.ticker, {', '.join(f'n.{c}, o.{c} as old_{c}' for c in STYLES)} from lags l join styles n on n.as_of = l.as_of join styles o on o.as_of = l.lagged and o.ticker = n.ticker),
sm as (select as_of, count(*) as n, {', '.join(f'avg(abs({c} - old_{c})) as {c}' for c in STYLES)} from sb group by as_of), sd as (select as_of, n, ({' + '.join(f'coalesce({c}, 0)' for c in STYLES)}) / nullif({' + '.join(f'({c} is not null)::int' for c in STYLES)}, 0) as drift from sm),
sx as (select sb.as_of, round(({' + '.join(f'w_{c} * coalesce({c}, 50)' for c in STYLES)}) / ({' + '.join(f'w_{c}' for c in STYLES)}), 9) as x, round(({' + '.join(f'w_{c} * coalesce(old_{c}, 50)' for c in STYLES)}) / ({' + '.join(f'w_{c}' for c in STYLES)}), 9) as y from sb join sw using (as_of)),
sr as (select as_of, {rank('x')} as a, {rank('y')} as b from sx), sc0 as (select as_of, coalesce(covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0), 0) as rho from sr group by as_of),
sure as (select sw.as_of, case when n >= 5 then rho end as rho, case when n >= 5 then drift end as drift, case when n >= 5 then greatest(0, least(1, 0.5::double * (rho + 1) - 0.003::double * drift)) else 0.5::double end as confidence from sw left join sc0 using (as_of) left join sd using (as_of))"""


def filled(src: str, to: str) -> str:
    """Rows of src (as_of, ticker, sector, score, cap, w) with w water-filled to caps."""
    t = to
    order = "partition by as_of order by cap / u, cap, u rows between unbounded preceding and 1 preceding"
    return f""", {t}1 as (select *, w / sum(w) over ({X}) as u from {src}), {t}2 as (select *, coalesce(sum(cap) over ({order}), 0) as c0, 1 - coalesce(sum(u) over ({order}), 0) as o from {t}1), {t}3 as (select *, cap / u * o < 1 - c0 as capped from {t}2),
{t}4 as (select *, case when 1 - coalesce(sum(u) filter (capped) over ({X}), 0) > 1e-12 then (1 - coalesce(sum(cap) filter (capped) over ({X}), 0)) / (1 - coalesce(sum(u) filter (capped) over ({X}), 0)) else 1e300 end as level from {t}3),
{to} as (select as_of, ticker, sector, score, cap, least(cap, level * u) / sum(least(cap, level * u)) over ({X}) as w from {t}4)"""


def sectors_filled(src: str, to: str, most: float) -> str:
    """Fifty rounds over at most five sectors each: one step a sector, in the order of names; then caps again."""
    t = to + "r"
    m = f"{most}::double"
    return f""", {t}(step, as_of, ticker, sector, score, cap, k, w, tot) as (select 0, as_of, ticker, sector, score, cap, dense_rank() over ({X} order by sector), w, 0.0::double from {src}
  union all select step + 1, as_of, ticker, sector, score, cap, k, case when s > {m} + 1e-9 then v + case when h > 0 then freed * head / h else 0 end else u end, tot from (
    select *, sum(head) over ({X}) as h from (select *, case when k = now then 0 else greatest(cap - v, 0) end as head from (
      select *, case when k = now and s > {m} + 1e-9 then u * {m} / s else u end as v, coalesce(sum(u) filter (k = now) over ({X}), 0) * (1 - {m} / nullif(s, 0)) as freed from (
        select *, coalesce(max(tot) filter (k = now) over ({X}), 0) as s from (
          select step, as_of, ticker, sector, score, cap, k, u, step % 5 + 1 as now, case when step % 5 = 0 then sum(u) over (partition by as_of, k) else tot end as tot from (
            select *, case when step % 5 = 0 then w / sum(w) over ({X}) else w end as u from {t} where step < 250)))))))
, {t}x as (select as_of, ticker, sector, score, cap, w from {t} where step = 250)""" + filled(f"{t}x", to)


PICKED15 = ", pick as (select as_of, f.ticker, sector, value as score, row_number() over (partition by as_of, sector order by round(value, 8) desc, f.ticker) as j from fund f join securities using (ticker) where value is not null), pick2 as (select *, row_number() over (partition by as_of order by round(score, 8) desc, ticker) as place from pick where j <= 6), w0 as (select as_of, ticker, sector, score, 0.12::double as cap, power(score - min(score) over (partition by as_of) + 5, 1.2::double) as w from pick2 where place <= 15)"
BUILT = PICKED15 + filled("w0", "wa") + sectors_filled("wa", "wb", 0.30) + ", wk as (select *, count(*) filter (w >= 0.01::double) over (partition by as_of) as good from wb), wc as (select as_of, ticker, sector, score, cap, w from wk where w >= 0.01::double or good < 5)" + filled("wc", "wd") + sectors_filled("wd", "we", 0.30)
RECURSIVE = C.replace("with ", "with recursive ", 1)

SQL: dict[str, str] = {
    "adapter_prices": C + "select date, ticker, close, volume from prices",
    "adapter_benchmarks": C + "select date, name, level from benchmarks",
    "adapter_fundamentals": C + out("pub_date ticker " + " ".join(f"{c}:r" for c in FIELDS), "fundamentals"),
    "adapter_securities": C + "select ticker, name, sector, pays_dividend, delisting_date from securities",
    "value_top10": C + FUND + out("as_of ticker value:r margin_of_safety place", "(select *, row_number() over (partition by as_of order by round(value, 8) desc nulls last, ticker)::int as place from fund)", "where place <= 10"),
    "facts_as_of": C + ASOF + out("as_of ticker pub_date pe:r market_cap:r revenue_growth:r", "facts"),
    "fundamental_scores": C + FUND + out(F_COLS, "fund"),
    "f_score": C + ASOF + ", old as (select g.as_of, f.* from grid2 g asof join fundamentals f on g.ticker = f.ticker and (g.as_of - 365) >= f.pub_date), t as (select n.*, coalesce(n.roic, n.roe) as roa, coalesce(o.roic, o.roe) as p_roa, o.debt_equity as p_debt_equity, o.interest_coverage as p_interest_coverage, o.gross_margin as p_gross_margin from facts n left join old o on n.as_of = o.as_of and n.ticker = o.ticker), " + f"s as (select as_of, ticker, ({' + '.join(f'coalesce(({t})::int, 0)' for t in TESTS)}) as f_score, ({' + '.join(f'(({t}) is not null)::int' for t in TESTS)}) as f_evaluated from t), u as (select *, 9 - f_evaluated as f_missing, f_score::double / nullif(f_evaluated, 0) as f_score_pct, f_score::double / nullif(f_evaluated, 0) * 9 as f_score_adj from s), v as (select *, {rank('f_score_pct')} as piotroski, coalesce(f_score_adj >= 7, false) as f_strong, coalesce(f_score_adj <= 3, false) as f_weak from u) " + out("as_of ticker f_score f_evaluated f_missing f_score_pct:r f_score_adj:r piotroski:r f_strong f_weak", "v"),
    "universe": C + DATES + MEMBERS + out("as_of ticker close:r adv:r", "members"),
    "cross_section": C + ASOF + f", q as (select as_of, quantile_cont(pe, 0.02) as lo, quantile_cont(pe, 0.98) as hi, count(pe) as n from facts group by as_of), w as (select f.as_of, f.ticker, case when q.n < 3 then pe when pe is not null then greatest(lo, least(hi, pe)) end as pe, roe, sector from facts f join q using (as_of) join securities s on s.ticker = f.ticker), z as (select *, case when coalesce(stddev_pop(pe) over ({X}), 0) = 0 then 0 else (pe - avg(pe) over ({X})) / stddev_pop(pe) over ({X}) end as z, {rank('pe', False)} as rank, round(roe - avg(roe) over (partition by as_of, sector), 9) as gap from w), n as (select *, {rank('gap')} as neutral from z), b as (select *, {mix(rank=.7, neutral=.3)} as mixed from n) " + out("as_of ticker pe:r z:r rank:r neutral:r mixed:r", "b"),
    "performance": C + RETS + METRICS("ticker", "rets") + out("ticker ann_return:r ann_vol:r sharpe:r total_return:r max_drawdown:r n_days worst_year:r", "metrics"),
    "equity_curves": C + ", r as (select *, level / lag(level) over (partition by name order by date) - 1 as ret from benchmarks), e as (select *, product(1 + ret) over (partition by name order by date rows between unbounded preceding and current row) as equity from r where ret is not null), f as (select *, equity / max(equity) over (partition by name order by date rows between unbounded preceding and current row) - 1 as drawdown from e) " + out("date name ret:r equity:r drawdown:r", "f"),
    "quant_scores": C + ASOF + QUANT + out("as_of ticker momentum:r low_vol:r size:r factor:r beta:r gbeta:r macro_tilt:r volatility:r", "quant"),
    "macro_regime": C + MACRO + out("date trend:r vol:r vol_z:r dd:r leadership:r risk_on:r label", "w5"),
    "hybrid": C + FUND + QUANT + f", h as (select as_of, ticker, value, quality, growth, factor, analyst, {mix(value=.34, quality=.4, growth=.26)} as f, {mix(factor=.5, analyst=.5)} as q from fund full join quant using (as_of, ticker)), i as (select *, {clip(mix(f=.6, q=.4) + ' + (0.10::double * (' + clip('100 - abs(f - q)') + ' - 50) + case when f > 55 and q > 55 then 4 else 0 end)')}::decimal(18, 9) as hybrid_alpha from h) " + out("as_of ticker value:r quality:r growth:r factor:r analyst:r hybrid_alpha:r", "i"),
    "stock_risk": C + RISK + out("as_of ticker vol:r beta:r mdd:r dd_freq:r risk_score:r risk_band tail", "risks"),
    "liquidity": C + DATES + f", a as (select *, avg(close * volume) over (partition by ticker order by date rows between 62 preceding and current row) as adv from prices), b as (select a.date as as_of, ticker, adv from a join reb on a.date = reb.as_of), c as (select *, {rank('adv')} as liquidity_score, 0.10::double * adv as max_safe_trade, least(1, 0.10::double * adv / 1e8) as max_weight_by_liquidity, least(1, 0.10::double * adv / 1e8) < 0.01::double as illiquid from b) " + out("as_of ticker adv:r liquidity_score:r max_safe_trade:r max_weight_by_liquidity:r illiquid", "c"),
    "concentration": C + FUND + BOOKS + ", c as (select portfolio_id, as_of, max(weight) as top1, sum(weight) filter (j <= 5) as top5, sum(weight * weight) as hhi, 1 / sum(weight * weight) as effective_n, count(*) as n_positions, -max(weight) as worst_single from (select *, row_number() over (partition by as_of order by weight desc, ticker) as j from books) group by all) " + out("portfolio_id as_of top1:r top5:r hhi:r effective_n:r n_positions worst_single:r", "c"),
    "sector_exposure": C + FUND + BOOKS + out("portfolio_id as_of sector exposure:r", "(select portfolio_id, as_of, sector, sum(weight) as exposure from books left join securities using (ticker) group by all)"),
    "style_exposure": C + STYLED + BOOKS + out("portfolio_id as_of " + " ".join(f"{s}:r" for s in STYLES), f"(select portfolio_id, as_of, {', '.join(f'sum(weight * coalesce(s.{s}, 50)) / sum(weight) as {s}' for s in STYLES)} from books left join styles s using (as_of, ticker) group by all)"),
    "portfolio_risk": C + FUND + BOOKS + RETS + SEG + ", d as (select portfolio_id, as_of, date, sum(coalesce(weight * ret, 0)) as ret, max(m) as m from books join seg using (as_of, ticker) group by all), p as (select portfolio_id, as_of, stddev_pop(ret) * sqrt(252) as vol, case when count(ret) > 20 then covar_samp(case when m is not null then ret end, m) / var_pop(m) else 1 end as beta, count(*) as n_days from d group by all) " + out("portfolio_id as_of vol:r beta:r n_days", "p"),
    "turnover": C + FUND + MOVES + f", t as (select portfolio_id, as_of, sum(abs(target_weight - current_weight)) / 2 as turnover, sum(abs(target_weight - current_weight)) * 9.0::double / 1e4::double as cost from moves group by all), u as (select *, {clip('100 * (1 - turnover / 0.5::double)')} as turnover_score from t) " + "select portfolio_id, as_of, round(turnover, 9) as turnover, round(cost, 9) as cost, round(turnover_score, 9) as turnover_score from u",
    "trade_list": C + FUND + MOVES + ", t as (select *, target_weight - current_weight as delta from moves), u as (select *, case when abs(delta) <= 1e-6 then 'hold' when current_weight <= 1e-6 then 'add' when target_weight <= 1e-6 then 'exit' when delta > 0 then 'increase' else 'trim' end as action from t) " + out("portfolio_id as_of ticker target_weight:r current_weight:r delta:r action", "u"),
    "data_quality": C + RISK_WIN(60) + ASOF.replace(DATES, "") + QUALITY + out("as_of missing:r stale outliers n coverage:r status", "quality"),
    "robustness": C + STYLED + out("as_of " + " ".join(f"{s}:r" for s in STYLES), f"(select as_of, {', '.join(f'100 * (0.5::double * avg(({s} is not null)::int) + 0.5::double * least(coalesce(stddev_pop({s}), 0) / 20, 1)) as {s}' for s in STYLES)} from styles group by as_of)"),
    "rate_shock": C + FUND + BOOKS + f", d as (select b.*, {rank('pe', True, 'portfolio_id, as_of')} as k from books b left join facts using (as_of, ticker)) " + out("portfolio_id as_of impact:r", "(select portfolio_id, as_of, -0.01::double * sum(weight * (2 + 8 * coalesce(k / 100, 0.5::double))) as impact from d group by all)"),
    "average_correlation": C + FUND + BOOKS + RETS + SEG + ", o as (select portfolio_id, as_of, ticker, date, ret from books join seg using (as_of, ticker)), p as (select a.portfolio_id, a.as_of, a.ticker as t1, b.ticker as t2, covar_pop(a.ret, b.ret) / nullif(stddev_pop(case when b.ret is not null then a.ret end) * stddev_pop(case when a.ret is not null then b.ret end), 0) as c from o a join o b on a.as_of = b.as_of and a.date = b.date and a.ticker < b.ticker group by all) " + out("portfolio_id as_of avg_corr:r n_pairs", "(select portfolio_id, as_of, avg(c) as avg_corr, count(c) as n_pairs from p group by all)"),
    "template_backtest": C + STYLED + backtest(False) + METRICS("template", "daily") + out("template ann_return:r ann_vol:r sharpe:r total_return:r max_drawdown:r n_days worst_year:r", "metrics"),
    "template_daily": C + STYLED + backtest(False) + out("template date ret:r as_of", "daily"),
    "pit_backtest": C + STYLED + MEMBERS + backtest(False, pit=True) + METRICS("template", "daily") + out("template ann_return:r ann_vol:r sharpe:r total_return:r max_drawdown:r n_days worst_year:r", "metrics"),
    "survivorship": C + STYLED + MEMBERS + backtest(False, pit=True) + backtest(True, "x", pit=True) + ", a as (select template, power(product(1 + ret), 252.0::double / count(*)) - 1 as all_names from daily group by template), b as (select template, power(product(1 + ret), 252.0::double / count(*)) - 1 as survivors from dailyx group by template), c as (select *, survivors - all_names as bias from a join b using (template)) " + out("template all_names:r survivors:r bias:r", "c"),
    "market_regime": C + REGIME + out("date regime breadth:r", "regimes"),
    "best_templates": C + STYLED + backtest(False) + BEST + out("as_of template sharpe:r", "best"),
    "style_weights": C + STYLED + REGIME + backtest(False) + BEST + f", bw as (select as_of, style, w / sum(w) over (partition by as_of) as w from best join {TEMPLATES} using (template)), wr as (select reb.as_of, regime, p.style, 0.65::double * p.prior + 0.35::double * coalesce(t.w, 0) as raw from reb join regimes on regimes.date = reb.as_of join {PRIORS} p using (regime) left join bw t on t.as_of = reb.as_of and t.style = p.style) " + out("as_of regime style weight:r", "(select *, greatest(raw, 0) / sum(greatest(raw, 0)) over (partition by as_of) as weight from wr)"),
    "signal_stability": C + BOTH(STYLED) + REGIME + STABLE + out("as_of rho:r drift:r confidence:r", "sure"),
    "training_panel": C + TRAIN + out("as_of ticker " + " ".join(f"{c}:r" for c in ALL) + " fwd_return:r fwd_excess:r outperform", "train"),
    "feature_registry": C + FRAME + f", r as (select feature, family, sign::int as sign, source, lag_days::int as lag_days, min_history_days::int as min_history_days, is_proxy from (values {REGISTRY}) v(feature, family, sign, source, lag_days, min_history_days, is_proxy)) select r.*, coalesce(n_known, 0) as n_known from r left join (select feature, count(x) as n_known from (unpivot frame on {', '.join(ALL)} into name feature value x) group by feature) using (feature)",
    "candidate_selection": C + FUND + ", s as (select 'value' as portfolio_id, as_of, f.ticker, sector, value as score, row_number() over (partition by as_of, sector order by round(value, 8) desc, f.ticker) as j from fund f join securities using (ticker) where value is not null), t as (select *, row_number() over (partition by as_of order by round(score, 8) desc, ticker)::int as place from s where j <= 5) " + out("portfolio_id as_of ticker sector score:r place", "t", "where place <= 12"),
    "portfolio_weights": RECURSIVE + FUND + BUILT + out("portfolio_id as_of ticker sector score:r weight:r", "(select 'value' as portfolio_id, as_of, ticker, sector, score, w as weight from we)"),
    "split_factors": C + ", s as (select ticker, month as date, qty as val, qty / lag(qty) over (partition by ticker order by month) as r from months), t as (select *, case when r >= 1.45::double or (r > 0 and r <= 0.69::double) then r else 1 end as step from s), u as (select *, coalesce(product(step) over (partition by ticker order by date rows between 1 following and unbounded following), 1) as factor from t) " + out("ticker date val:r factor:r", "u"),
    "total_return": C + RETS + ", t as (select ticker as permno, date, first_value(close) over w * product(1 + coalesce(ret, 0)) over (w rows between unbounded preceding and current row) as level from rets window w as (partition by ticker order by date)) " + out("permno date level:r", "t"),
    "event_marks": "select cast(user_id as varchar) as portfolio_id, event_id, round(100 * product(1 + value / 1e4) over w, 6) + 0.0::double as nav, count(*) over w as n_marks from events window w as (partition by user_id order by ts, event_id rows between unbounded preceding and current row)",
    "event_marks_stream": "select cast(user_id as varchar) as portfolio_id, round(100 * product(1 + value / 1e4), 6) as nav, count(*) as n_marks from events group by user_id",
    "event_positions": """with e as (select user_id::varchar as p, epoch_ms(ts) as ms, epoch_ms(ts) // 86400000 as day, event_type as t, value + 1 as price, (event_id % 5 - 2)::double as s from events),
days as (select distinct p, day from e where (day + 1) * 86400000 - 1 <= (select max(ms) from e) - 2 * 86400000),
pos as (select d.p, d.day, t, sum(s) as n, last(price order by ms, price, s) as px, -sum(s * price) as paid, bool_or(s <> 0) as traded from days d join e on e.p = d.p and e.day <= d.day group by d.p, d.day, t)
select p as portfolio_id, date '1970-01-01' + day::int as date, round(sum(paid) + sum(n * px), 4) + 0.0::double as nav, round(sum(paid), 4) + 0.0::double as cash, (count(*) filter (abs(n) > 1e-12))::int as n_positions from pos group by p, day""",
    "event_properties": "select event_type, count(*) as n, count(json_extract(props, '$.k')) as with_k, sum(cast(json_extract(props, '$.k') as bigint))::bigint as sum_k, count(distinct user_id) as users from events group by event_type",
    "page_fields": "select page_id, len(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1))::bigint as n_links, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, array_to_string(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1), '|') as links from pages",
}
