"""The queries of clients, integration and evidence in SQL."""

from __future__ import annotations

from corvane.plans.panel_sql import ALL, ASOF, BOOKS, BOTH, DATES, FRAME, FUND, MACRO, MEMBERS, METRICS, MOVES, PRIORS, QUALITY, QUANT, REGIME, REGISTRY, RETS, RISK, STABLE, STYLED, STYLES, X, C, clip, mix, out, rank

CUSTOMER = "case c_nationkey % 4 when 0 then '{}' when 1 then '{}' when 2 then '{}' else '{}' end as objective"
# fixed values: objective, style, multiplier
TILTS = "(select o as objective, s as style, x::double as x from (values ('growth', 'growth', 1.3), ('growth', 'garp', 1.15), ('growth', 'momentum', 1.1), ('income', 'quality', 1.15), ('income', 'low_vol', 1.1), ('income', 'growth', 0.7), ('capital_preservation', 'low_vol', 1.4), ('capital_preservation', 'quality', 1.25), ('capital_preservation', 'value', 1.1), ('capital_preservation', 'momentum', 0.7), ('capital_preservation', 'growth', 0.75)) v(o, s, x))"
NAMES = f"(values {', '.join(f'({s!r})' for s in STYLES)}) st(style)"
THEMES = ", themes as (select s_suppkey::varchar as ticker, list(distinct p_type) as t from supplier join lineitem on l_suppkey = s_suppkey join part on p_partkey = l_partkey where date_trunc('month', l_shipdate) = (select min(date_trunc('month', x.l_shipdate)) from lineitem x where x.l_suppkey = s_suppkey) group by 1)"
FITS = THEMES + f""", fb as (select f.as_of, f.ticker, s.sector, coalesce(list_contains(t, 'PROMO'), false) as hard_excluded, {rank('f.dividend_yield', True, 'f.as_of')} as ry, {rank('f.earnings_vol', False, 'f.as_of')} as rs, {rank('q.beta', False, 'f.as_of')} as rb, {rank('f.revenue_growth', True, 'f.as_of')} as rg from facts f left join quant q using (as_of, ticker) join securities s on s.ticker = f.ticker left join themes t on t.ticker = f.ticker),
fc as (select *, 50 + case when sector = 'EUROPE' then 12 else 0 end + coalesce(0.2::double * 0.20::double * (ry - 50), 0) as base, coalesce(0.15::double * (rs - 50), 0) + coalesce(0.10::double * (rb - 50), 0) as safe, coalesce(0.15::double * (rg - 50), 0) as grow, case when sector = 'ASIA' then -8 else 3 end as esg from fb),
fits as (select portfolio_id, as_of, ticker, case when hard_excluded then 0 else {clip("case portfolio_id when 'balanced' then base when 'careful' then base + safe + esg else base + grow end")} end as client_fit, hard_excluded, case when hard_excluded then 'theme: PROMO' end as excluded_reason from fc, (values ('balanced'), ('careful'), ('bold')) v(portfolio_id))"""
DRIFT = "product(1 + r) - 1"
SHOCKS = "(values ('spring 1998', date '1998-03-01', date '1998-06-30'), ('autumn 1999', date '1999-09-01', date '1999-12-31')) sc(scenario, a, z)"
#: ic_summary of rows (key, as_of, ic): lags of Newey and West's kernel
IC = lambda key, lags: f""", i0 as (select *, ic - avg(ic) over (partition by {key}) as d from ics where ic is not null), i1 as (select *, {', '.join(f'd * lag(d, {k}) over (partition by {key} order by as_of) as d{k}' for k in range(1, lags + 1))} from i0),
i2 as (select {key}, avg(ic) as mean_ic, stddev_samp(ic) as std_ic, avg((round(ic, 10) > 0)::int) as hit_rate, count(*) as n_dates, sum(d * d) / count(*) + {' + '.join(f'2 * (1 - {k} / {lags + 1}.0::double) * coalesce(sum(d{k}), 0) / count(*)' for k in range(1, lags + 1))} as lrv from i1 group by {key}),
summary as (select {key}, mean_ic, std_ic, mean_ic / nullif(std_ic, 0) as ir, mean_ic / nullif(std_ic, 0) * sqrt(n_dates) as t, hit_rate, n_dates, case when lrv > 0 then mean_ic / sqrt(lrv / n_dates) end as t_nw, n_dates / {lags + 1}.0::double as n_effective from i2)"""  # noqa: E731
PEARSON = "covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0)"
PARTS = FUND + MACRO + f""", fwd as (select date as as_of, ticker, lead(close, 126) over (partition by ticker order by date) / close - 1 as y from prices), p0 as (select f.as_of, f.ticker, value as pred, y, year(f.as_of)::varchar as year, sector, label from fund f join fwd using (as_of, ticker) join securities s on s.ticker = f.ticker left join w5 on w5.date = f.as_of where y is not null and value is not null),
parts as (select 'year' as kind, year as part, as_of, pred, y from p0 union all select 'sector', sector, as_of, pred, y from p0 union all select 'label', label, as_of, pred, y from p0 where label is not null),
pr as (select kind, part, as_of, {rank('pred', True, 'kind, part, as_of')} as a, {rank('y', True, 'kind, part, as_of')} as b from parts), ics as (select kind, part, as_of, case when count(*) >= 3 then {PEARSON} end as ic from pr group by all)"""
EVENTS = RETS.replace(", ndx as", ", ndx as", 1) + ASOF + f""", ep as (select ticker, date, close, spx as m, row_number() over (partition by ticker order by date) as i from rets), ea as (select p.date as as_of, p.ticker, i as now, close as c_now, m as m_now from ep p join reb on p.date = reb.as_of),
eo as (select g.as_of, g.ticker, f.roe from grid2 g asof join fundamentals f on g.ticker = f.ticker and (g.as_of - 365) >= f.pub_date),
ev as (select a.*, f.pub_date, f.revenue_growth, f.eps_growth, f.roe - o.roe as d_roe from ea a join facts f using (as_of, ticker) left join eo o using (as_of, ticker)),
ef as (select e.*, x.i + (x.date < e.pub_date)::int as ei from ev e asof join ep x on e.ticker = x.ticker and e.pub_date >= x.date),
eg as (select e.*, greatest(ei - 3, 1) as lo, least(ei + 3, now) as hi from ef e),
eh as (select e.*, h.close / l.close - h.m / l.m as reaction, c_now / h.close - m_now / h.m as drift from eg e join ep l on l.ticker = e.ticker and l.i = e.lo join ep h on h.ticker = e.ticker and h.i = e.hi),
ei as (select *, {rank('revenue_growth')} as r1, {rank('eps_growth')} as r2, {rank('d_roe')} as r3, {rank('reaction', False)} as r4 from eh), ej as (select *, {mix(r1=1.0, r2=1.0, r3=1.0)} as fundamental_trend from ei), events as (select *, case when now - ei > 200 then 50 else coalesce(0.5::double * r4 + 0.5::double * fundamental_trend, 50) end as overreaction from ej)"""
SCORED = STYLED + REGIME + RISK.replace(RETS + DATES, "", 1) + MEMBERS + FITS + f""", rb as (select as_of, {', '.join(f'100 * (0.5::double * avg(({s} is not null)::int) + 0.5::double * least(coalesce(stddev_pop({s}), 0) / 20, 1)) as {s}' for s in STYLES)} from styles group by as_of), rbl as (unpivot rb on {', '.join(STYLES)} into name style value robust),
cl as (select * from (values ('balanced', 'balanced', 0.20::double), ('careful', 'capital_preservation', 0.28::double), ('bold', 'growth', 0.12::double)) v(portfolio_id, objective, aversion)),
wt as (select cl.portfolio_id, reb.as_of, p.style, p.prior * coalesce(t.x, 1) * (0.5::double + 0.5::double * coalesce(robust, 50) / 100) as w from reb join regimes on regimes.date = reb.as_of join {PRIORS} p using (regime) cross join cl left join {TILTS} t on t.objective = cl.objective and t.style = p.style left join rbl on rbl.as_of = reb.as_of and rbl.style = p.style),
sty as (select portfolio_id, as_of, ticker, sum(x * w) / nullif(sum(w), 0) as style_score from (unpivot styles on {', '.join(STYLES)} into name style value x) join wt using (as_of, style) where x is not null group by all),
hy as (select as_of, ticker, {mix(value=.34, quality=.4, growth=.26)} as f, {mix(factor=.5, analyst=.5)} as q from fund full join quant using (as_of, ticker)), hz as (select as_of, ticker, {clip(mix(f=.6, q=.4) + ' + 0.10::double * (greatest(0, least(100, 100 - abs(f - q))) - 50) + case when f > 55 and q > 55 then 4 else 0 end')} as hybrid_alpha from hy),
lq as (select a.date as as_of, ticker, adv from adv0 a join reb on a.date = reb.as_of), lz as (select as_of, ticker, {rank('adv')} as liquidity_score, least(1, 0.10::double * adv / 1e4) < 0.02::double as illiquid from lq),
th as (select s.ticker, case when list_contains(t, 'PROMO') then 20 when len(list_intersect(t, ['ECONOMY', 'SMALL'])) > 0 then 50 + 12 * len(list_intersect(t, ['ECONOMY', 'SMALL'])) else 50 end as theme_fit from securities s left join themes t using (ticker)),
sc as (select y.*, {mix(style_score=.68, hybrid_alpha=.24, theme_fit=.08)} * (0.5::double + 0.5::double * coalesce(client_fit, 50) / 100) - greatest(-15, least(40, aversion * (50 - coalesce(risk_score, 50)) / 50 * 100)) - 0.10::double * greatest(0, 50 - coalesce(liquidity_score, 50)) / 50 * 100 - case when tail then 6 else 0 end as raw, coalesce(hard_excluded, false) as ex, coalesce(illiquid, false) as dry, (as_of, ticker) in (select (as_of, ticker) from members) as inside
  from sty y join hz using (as_of, ticker) join th using (ticker) join risks using (as_of, ticker) join lz using (as_of, ticker) left join fits using (portfolio_id, as_of, ticker) join cl using (portfolio_id)),
scored as (select portfolio_id, as_of, ticker, style_score, case when not ex and not dry and inside then {clip('raw')} end as integrated_score, not ex and not dry as eligible, case when ex then 'theme: PROMO' when dry then 'insufficient liquidity' else '' end as ineligible_reason from sc)"""

# fixed values: family, words for one that helps, words for one that hurts
PHRASES = """('value', 'cheap on valuation', 'expensive on valuation'), ('quality', 'strong on profitability', 'weak on profitability'), ('growth', 'growing well', 'growing slowly'), ('momentum', 'in a strong price trend', 'in a weak price trend'), ('risk', 'low-risk on volatility and size', 'higher-risk on volatility and size'),
('macro', 'well-matched to today''s market regime', 'poorly matched to today''s market regime'), ('issuance', 'returning capital to shareholders', 'diluting shareholders'), ('discipline', 'disciplined with capital', 'loose with capital'), ('analyst_proxy', 'favoured by the fundamentals-based analyst proxy', 'disfavoured by the fundamentals-based analyst proxy')"""
WHOLE = lambda x: f"round_even({x}, 0)::int::varchar"
TENTH = lambda x: f"printf('%.1f', round_even({x}, 1))"
REASONS = f""", r0 as (select as_of, ticker, feature, family, x, (x - 50) / 25 * ((length(feature) % 5) * 0.1::double - 0.2::double) as c from (unpivot (select * from frame where {' and '.join(f'{c} is not null' for c in ALL)}) on {', '.join(ALL)} into name feature value x) join (select feature, family from (values {REGISTRY}) v(feature, family, a1, a2, a3, a4, a5)) using (feature)),
r1 as (select as_of, ticker, rank() over (partition by as_of order by round(t, 10) desc) as k, count(*) over (partition by as_of) as n from (select as_of, ticker, sum(c) as t from r0 group by all)),
r2 as (select as_of, ticker, family, sum(c) as c, max_by(struct_pack(feature := feature, x := x), struct_pack(a := round(abs(c), 10), b := feature)) as top from r0 group by all),
r3 as (select r2.*, good, bad, replace(r2.family, '_', ' ') as fam, regexp_replace(top.feature, '^f_', '') as field, net_issuance, asset_growth, pe, pb, roe from r2 left join (values {PHRASES}) p(family, good, bad) on p.family = r2.family left join facts_all f on f.as_of = r2.as_of and f.ticker = r2.ticker),
r4 as (select *, case field when 'net_issuance' then 'share count ' || case when net_issuance >= 0 then 'up ' else 'down ' end || {WHOLE('abs(net_issuance) * 100')} || '% over the trailing year' when 'asset_growth' then 'total assets ' || case when asset_growth >= 0 then 'up ' else 'down ' end || {WHOLE('abs(asset_growth) * 100')} || '% over the trailing year'
  when 'pe' then case when pe > 0 then 'trades at ' || {TENTH('pe')} || 'x earnings' end when 'pb' then case when pb > 0 then 'trades at ' || {TENTH('pb')} || 'x book value' end when 'roe' then 'posts a ' || {WHOLE('roe * 100')} || '% return on equity' end as figure from r3),
r5 as (select *, case when figure is not null then figure || ' (' || case when c > 0 then good else bad end || ')' else case when top.x >= 85 or top.x <= 15 then 'clearly ' else 'somewhat ' end || case when top.x >= 50 then good else bad end || ' (percentile ' || {WHOLE('top.x')} || ')' end as said, row_number() over (partition by as_of, ticker order by round(c, 10) desc, fam) as up, row_number() over (partition by as_of, ticker order by round(c, 10), fam) as down from r4),
r6 as (select as_of, ticker, max(fam) filter (c > 0 and up = 1) as fa, max(said) filter (c > 0 and up = 1) as sa, max(said) filter (c > 0 and up = 2) as sb, max(fam) filter (c < 0 and down = 1) as fd, max(said) filter (c < 0 and down = 1) as sd from r5 group by all),
r7 as (select r6.as_of, r6.ticker, k, concat_ws(' ', case when pct >= 80 then r6.ticker || ' sits in the model''s top ' || {WHOLE('100 - pct')} || '% (score ' || {WHOLE('pct')} || ').' when pct <= 20 then r6.ticker || ' sits in the model''s bottom ' || {WHOLE('pct')} || '% (score ' || {WHOLE('pct')} || ').' else r6.ticker || ' lands near the middle of the pack (score ' || {WHOLE('pct')} || ').' end,
  'The biggest push comes from ' || fa || ': it''s ' || sa || '.', 'It also helps that the stock is ' || sb || '.', 'The drag is ' || fd || ': it''s ' || sd || '.', 'Model confidence is only 0.30, so this view carries limited weight.') as reason from r6 join (select *, 100.0::double * (1 - (k - 1)::double / greatest(1, n - 1)) as pct from r1) q on q.as_of = r6.as_of and q.ticker = r6.ticker)"""
BETA = "case when count(ret) > 20 then covar_samp(case when m is not null then ret end, m) / nullif(var_pop(m), 0) else 1 end"
NUMBERED = lambda days, name: f", n{name} as (select *, row_number() over (partition by ticker order by date) as i from rets), {name} as (select a.date as as_of, b.* from n{name} a join reb0 on a.date = reb0.as_of join n{name} b on a.ticker = b.ticker and b.i <= a.i and b.i > a.i - {days})"

SQL: dict[str, str] = {
    "mandate_terms": f"with c as (select c_custkey as client_id, {CUSTOMER.format('capital_preservation', 'income', 'balanced', 'balanced')}, c_nationkey % 5 + 1 as risk_band, (['low', 'medium', 'high'])[c_custkey % 3 + 1] as turnover_tolerance from customer) select *, least(0.08::double, case when risk_band <= 2 then 0.06::double end, case when objective = 'capital_preservation' then 0.05::double end) as position_cap, case when risk_band <= 2 then 0.04::double else 0.05::double end as target_cap, case when risk_band <= 2 then 0.2::double else 0.25::double end as sector_cap, case turnover_tolerance when 'low' then 0.15::double when 'medium' then 0.3::double else 0.35::double end as turnover_cap from c",
    "style_tilts": f"with c as (select c_custkey as client_id, {CUSTOMER.format('growth', 'income', 'capital_preservation', 'balanced')} from customer) select client_id, st.style, round(coalesce(x, 1) * (0.6::double + 0.8::double * case when client_id % 3 = 0 and st.style = 'value' then 1 else 0.5::double end), 6) + 0.0::double as tilt from c cross join {NAMES} left join {TILTS} t on t.objective = c.objective and t.style = st.style",
    "client_fit": C + FUND + QUANT + FITS + out("portfolio_id as_of ticker client_fit:r hard_excluded excluded_reason", "fits"),
    "alerts": C + FUND + BOOKS + ", a0 as (select portfolio_id, as_of, max(weight) as top1, count(*)::double as n from books group by all), a1 as (select portfolio_id, as_of, sum(weight) as e from books left join securities using (ticker) group by portfolio_id, as_of, sector), a2 as (select portfolio_id, as_of, 'few holdings' as alert, n as amount from a0 where n < 11 union all select portfolio_id, as_of, 'many holdings', n from a0 where n > 30 union all select portfolio_id, as_of, 'position', top1 from a0 where top1 > 0.102::double + 1e-9 union all select portfolio_id, as_of, 'sector', e from a1 where e > 0.38::double + 1e-9) " + out("portfolio_id as_of alert amount:r", "a2"),
    "mandate_check": C + FUND + THEMES + BOOKS + ", b as (select x.*, sector, coalesce(list_contains(t, 'PROMO'), false) as promo from books x left join securities using (ticker) left join themes using (ticker)) select distinct portfolio_id, as_of, rule from (select portfolio_id, as_of, 'position cap' as rule from b where weight > 0.105::double + 1e-6 union all select portfolio_id, as_of, 'sector cap' from b group by portfolio_id, as_of, sector having sum(weight) > 0.4::double + 1e-6 union all select portfolio_id, as_of, 'holdings' from b group by portfolio_id, as_of having count(*) not between 5 and 40 union all select portfolio_id, as_of, 'excluded sector' from b where sector = 'ASIA' union all select portfolio_id, as_of, 'excluded theme' from b where promo)",
    "neutral_styles": C + STYLED + ", n0 as (select as_of, ticker, style, round(x - avg(x) over (partition by as_of, style, sector), 9) as gap from (select * from styles unpivot include nulls (x for style in (" + ", ".join(STYLES) + "))) join securities using (ticker)), n1 as (select as_of, ticker, style, " + rank("gap", True, "as_of, style") + " as r from n0), n2 as (select as_of, ticker, " + ", ".join(f"max(r) filter (style = '{s}') as {s}" for s in STYLES) + " from n1 group by as_of, ticker) " + out("as_of ticker " + " ".join(f"{s}:r" for s in STYLES), "n2"),
    "published_report": C + FUND + BOOKS + REGIME + out("portfolio_id as_of ticker weight:r regime", "(select portfolio_id, b.as_of, ticker, case when b.as_of >= date '1997-01-01' then weight / 2 else weight end as weight, regime from books b left join regimes on regimes.date = b.as_of)"),
    "score_reasons": C + FRAME + REASONS + " select as_of, ticker, k as rank_in_universe, reason, reason not like '%' || chr(8212) || '%' and not regexp_matches(lower(reason), 'delve|tapestry|robust|pivot|seamless') as style_ok from r7",
    "tilted_candidates": C + FUND + f", t0 as (select 'value' as portfolio_id, f.as_of, f.ticker, sector, 0.75::double * f.value + 0.25::double * coalesce({rank('market_cap', True, 'f.as_of')}, 50) as score from fund f join facts using (as_of, ticker) join securities s on s.ticker = f.ticker), t1 as (select *, row_number() over (partition by as_of, sector order by round(score, 8) desc, ticker) as j from t0 where score is not null), t2 as (select *, row_number() over (partition by as_of order by round(score, 8) desc, ticker)::int as place from t1 where j <= 4) " + out("portfolio_id as_of ticker score:r place", "t2", "where place <= 12"),
    "value_book_decisions": C + BOTH(STYLED) + REGIME + STABLE + ", fund0 as (select * from fund where as_of in (select as_of from reb0))" + MOVES.replace("from fund where", "from fund0 where") + NUMBERED(252, "win") + NUMBERED(60, "win60") + QUALITY.replace("from win group", "from win60 group") + f""",
risk1 as (select as_of, stddev_pop(ret) * sqrt(252) as vol, {BETA} as beta from (select as_of, date, sum(coalesce(weight * ret, 0)) as ret, max(m) as m from books join win using (as_of, ticker) group by all) group by as_of),
risk0 as (select as_of, stddev_pop(ret) * sqrt(252) as vol, {BETA} as beta from (select as_of, date, sum(coalesce(weight * ret, 0)) as ret, max(m) as m from prev join win using (as_of, ticker) group by all) group by as_of),
mid as (select as_of, quantile_cont(value, 0.5) as mid from fund0 group by as_of), sco as (select as_of, ticker, value from fund0),
new as (select as_of, sum(weight * coalesce(value, mid)) as new_score from books left join sco using (as_of, ticker) left join mid using (as_of) group by as_of), old as (select as_of, sum(weight * coalesce(value, mid)) as old_score from prev left join sco using (as_of, ticker) left join mid using (as_of) group by as_of),
tu as (select as_of, sum(abs(target_weight - current_weight)) / 2 as turnover from moves group by as_of),
mv as (select as_of from books left join securities using (ticker) group by as_of, sector having sum(weight) > 0.4::double + 1e-6 union select as_of from books where weight > 0.103::double + 1e-6),
d0 as (select new.as_of, old_score is null as initial, new_score, old_score, turnover, r1.vol - r0.vol as d_vol, r1.beta - r0.beta as d_beta, confidence, status as quality, new_score - coalesce(old_score, 0) - 100 * (2 * turnover * 9.0::double / 1e4::double) as improvement, new.as_of not in (select as_of from mv) as clean from new left join old using (as_of) left join tu using (as_of) left join risk1 r1 using (as_of) left join risk0 r0 using (as_of) left join sure using (as_of) left join quality using (as_of)),
d1 as (select *, initial or coalesce(improvement >= 1.5::double, false) as gate_improvement, clean as gate_mandate, coalesce(quality <> 'Critical', false) as gate_quality, coalesce(confidence >= 0.35::double, false) as gate_confidence, initial or (coalesce(d_vol <= 0.02::double, true) and coalesce(d_beta <= 0.15::double, true)) as gate_risk, initial or coalesce(turnover <= 0.35::double, false) as gate_turnover from d0),
d2 as (select *, 'value' as portfolio_id, gate_improvement and gate_mandate and gate_quality and gate_confidence and gate_risk and gate_turnover as trade, concat_ws(', ', case when not gate_improvement then 'improvement' end, case when not gate_mandate then 'mandate' end, case when not gate_quality then 'quality' end, case when not gate_confidence then 'confidence' end, case when not gate_risk then 'risk' end, case when not gate_turnover then 'turnover' end) as blocked_by from d1) """ + out("portfolio_id as_of initial new_score:r old_score:r turnover:r d_vol:r d_beta:r confidence:r quality improvement:r gate_improvement gate_mandate gate_quality gate_confidence gate_risk gate_turnover trade blocked_by", "d2"),
    "crowding": C + STYLED + BOOKS + f", e as (select portfolio_id, as_of, {', '.join(f'sum(weight * coalesce(s.{s}, 50)) / sum(weight) as {s}' for s in STYLES)} from books left join styles s using (as_of, ticker) group by all) select portfolio_id, as_of, concat_ws(',', {', '.join(f'case when {s} > 70 then {s!r} end' for s in STYLES)}) as crowded, round({clip('100 - 2 * greatest(momentum - 50, 0)')}, 6) + 0.0::double as crowding_score from e",
    "market_shock": C + FUND + QUANT + BOOKS + out("portfolio_id as_of impact:r", "(select portfolio_id, as_of, sum(weight * coalesce(beta, 1)) * -0.2::double as impact from books left join quant using (as_of, ticker) group by all)"),
    "posture": C + REGIME + " select date, regime, case when regime = 'bull_low_vol' then 1.3::double when regime like 'bear%' or regime like '%high_vol' then 0.7::double else 1.0::double end as concentration, case when regime like 'bear%' or regime like '%high_vol' then 0.06::double end as position_cap from regimes",
    "book_scores": C + FUND + BOOKS + ", s as (select as_of, ticker, case when ticker::int % 4 > 0 then quality end as score from fund), m as (select as_of, quantile_cont(score, 0.5) as mid from s group by as_of) " + out("portfolio_id as_of book_score:r", "(select portfolio_id, as_of, sum(weight * coalesce(score, mid)) as book_score from books left join s using (as_of, ticker) left join m using (as_of) group by all)"),
    "holding_classes": C + STYLED + BOOKS + ", h as (select s.*, (s.value + s.momentum) / 2 as now, (o.value + o.momentum) / 2 as old from books b join styles s using (as_of, ticker) left join reb r on r.next_as_of = b.as_of left join styles o on o.as_of = r.as_of and o.ticker = b.ticker), k as (select *, least(value, quality, momentum) as w from h) select as_of, ticker, case w when value then 'value' when quality then 'quality' when momentum then 'momentum' end as weakest, round(w, 6) + 0.0::double as weakest_score, case when w < 25 then 'thesis_broken' when w is not null and coalesce(old - now >= 5, false) then 'out_of_favor' else 'healthy' end as class from k",
    "robust_style_weights": C + STYLED + REGIME + f", rb as (select as_of, {', '.join(f'100 * (0.5::double * avg(({s} is not null)::int) + 0.5::double * least(coalesce(stddev_pop({s}), 0) / 20, 1)) as {s}' for s in STYLES)} from styles group by as_of), rbl as (unpivot rb on {', '.join(STYLES)} into name style value robust), w as (select reb.as_of, p.style, p.prior / sum(p.prior) over (partition by reb.as_of) as w from reb join regimes on regimes.date = reb.as_of join {PRIORS} p using (regime)), v as (select w.as_of, w.style, w * (0.5::double + 0.5::double * coalesce(robust, 50) / 100) as w from w left join rbl using (as_of, style)) " + out("as_of style weight:r", "(select *, w / sum(w) over (partition by as_of) as weight from v)"),
    "integrated_scores": C + SCORED + out("portfolio_id as_of ticker style_score:r integrated_score:r eligible ineligible_reason", "scored"),
    "holdout_split": C + DATES + ", f as (select date as as_of, ticker from (select *, lead(close, 126) over (partition by ticker order by date) / close - 1 as y from prices) where y is not null and date in (select as_of from reb)), k as (select as_of, row_number() over (order by as_of desc) as k, count(*) over () as n from (select distinct as_of from f)) select as_of, case when k <= greatest(1, round_even(n * 0.15::double, 0)) then 'holdout' else 'research' end as part, (select count(*) from f where f.as_of = k.as_of) as n from k",
    "ic_breakdowns": C + PARTS + IC("kind, part", 2) + out("kind part mean_ic:r std_ic:r ir:r t:r hit_rate:r n_dates t_nw:r n_effective:r", "summary"),
    "earnings_events": C + EVENTS + out("as_of ticker pub_date reaction:r drift:r fundamental_trend:r overreaction:r", "events"),
    "stress_windows": C + FUND + BOOKS + RETS + f""", sd as (select portfolio_id, as_of, scenario, r.date, sum(weight * ret) / sum(weight) as ret, max(m) as m, sum(weight) as covered from books b join rets r using (ticker) join {SHOCKS} on r.date between a and z where ret is not null group by all),
own as (select portfolio_id || '|' || as_of || '|' || scenario as k, date, ret from sd), bench as (select portfolio_id || '|' || as_of || '|' || scenario as k, date, m as ret from sd)""" + METRICS("k", "own") + ", b0 as (select *, product(1 + ret) over (partition by k order by date rows between unbounded preceding and current row) as e from bench where ret is not null), b1 as (select k, min(e / mx - 1) as benchmark_drawdown from (select *, max(e) over (partition by k order by date rows between unbounded preceding and current row) as mx from b0) group by k), g as (select portfolio_id, as_of, scenario, portfolio_id || '|' || as_of || '|' || scenario as k, avg(covered) as coverage from sd group by all) " + out("portfolio_id as_of scenario total_return:r max_drawdown:r benchmark_drawdown:r coverage:r", "g join metrics using (k) left join b1 using (k)"),
}
