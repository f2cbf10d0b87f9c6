"""Point-in-time valuation and fundamentals."""
from pyspark.sql import functions as F

from tapeloom.functions.columns import r
from tapeloom.operators import valuation as v
from tapeloom.plans.bar_queries import rounded
from tapeloom.plans.registry import query, view

view("rep", """
with b as (select symbol, fiscal_year, q, period_end, period_type, is_cumulative, revision, round(revenue, 2)::decimal(20,2) as revenue,
  round(net_profit_attr, 0)::decimal(20,2) as np, available_date, case when cast(substring(symbol,7) as int) % 10 = 9 then 'HKD' else 'CNY' end as currency,
  case when cast(substring(symbol,7) as int) % 8 <> 3 then available_date end as published_at from reports)
select * from b union all select * replace (2 as revision, np + 50000 as np, (available_date + 45)::date as available_date) from b where q = 2""")
view("share_events", """
with g as (select symbol, year(trade_date) as y, min(trade_date) as eff, sum(volume_raw) as v from daily_bars group by 1, 2),
o as (select symbol, y, eff, (eff + 10)::date as avail, (v*1000)::decimal(20,2) as shares, 'issued' as kind, case when y = 1996 then 'snapshot_quote' else 'issue' end as event_type from g)
select * from o union all select * replace (shares * 2 as shares, 'group_total' as kind) from o where y = 1998""")
view("balance", """
select symbol, period_end, period_type, revenue*3 as total_assets, revenue + 1000000 as total_liabilities, revenue*2 - 1000000 as total_equity,
  case when q = 2 then revenue end as stb, case when q <> 3 then revenue*2 end as ltb from rep where revision = 1 and q <> 1""")
view("cash", "select symbol, period_end, period_type, np*2 as ocf, 250000 as capex from rep where revision = 1 and q <> 3")
view("rep_latest", "select * from rep qualify row_number() over (partition by symbol, period_end, period_type, is_cumulative order by revision desc) = 1")
view("rep_yoy", """
select a.*, a.revenue::double/nullif(b.revenue::double, 0) - 1 as revenue_yoy, a.np::double/nullif(b.np::double, 0) - 1 as np_yoy from rep_latest a
left join rep_latest b on b.symbol = a.symbol and b.period_type = a.period_type and b.is_cumulative = a.is_cumulative and b.fiscal_year = a.fiscal_year - 1
  and strftime(b.period_end, '%m-%d') = strftime(a.period_end, '%m-%d')""")
# every report row seen from every visibility point, newest revision only
view("seen", """
select p.symbol, p.d as visible_from, r.* exclude (symbol), count(*) over (partition by p.symbol, p.d) as visible_rows
from (select distinct symbol, available_date as d from rep) p join rep r on r.symbol = p.symbol and r.available_date <= p.d""")
view("seen_latest", "select * from seen qualify row_number() over (partition by symbol, visible_from, period_end, period_type order by revision desc) = 1")
TTM = """case when c.period_type = 'annual' then c.np else a.np + c.np - s.np end as ttm,
  case when c.period_type = 'annual' then 'ok' when a.np is null then 'ttm_missing_prev_annual' when s.np is null then 'ttm_missing_prev_same_period' else 'ok' end as ttm_reason"""
view("ttm_points", f"""
with c as (select * from seen_latest qualify row_number() over (partition by symbol, visible_from order by period_end desc) = 1)
select c.symbol, c.visible_from, c.visible_rows, c.period_end, c.revision, {TTM} from c
left join seen_latest a on a.symbol = c.symbol and a.visible_from = c.visible_from and a.period_type = 'annual' and a.fiscal_year = c.fiscal_year - 1
left join seen_latest s on s.symbol = c.symbol and s.visible_from = c.visible_from and s.period_type = c.period_type and s.fiscal_year = c.fiscal_year - 1
  and strftime(s.period_end, '%m-%d') = strftime(c.period_end, '%m-%d')""")
view("ttm_whole", f"""
with c as (select * from rep_latest qualify row_number() over (partition by symbol order by period_end desc) = 1)
select c.symbol, {TTM} from c left join rep_latest a on a.symbol = c.symbol and a.period_type = 'annual' and a.fiscal_year = c.fiscal_year - 1
left join rep_latest s on s.symbol = c.symbol and s.period_type = c.period_type and s.fiscal_year = c.fiscal_year - 1 and strftime(s.period_end, '%m-%d') = strftime(c.period_end, '%m-%d')""")
view("day_shares", """
select b.symbol, b.trade_date, b.close_raw, e.shares, e.event_type, e.eff from daily_bars b left join share_events e on e.symbol = b.symbol and e.eff <= b.trade_date
  and (e.event_type like 'snapshot%' or e.avail <= b.trade_date)
qualify row_number() over (partition by b.symbol, b.trade_date order by e.eff desc, case when e.kind = 'group_total' then 1 else 0 end desc) = 1""")
view("pe_days", """
with f as (select symbol, bool_or(published_at is null) as degraded, max(currency) as currency from rep_latest group by 1),
x as (select d.*, f.degraded, f.currency, case when f.degraded then w.ttm else p.ttm end as ttm, case when f.degraded then w.ttm_reason else p.ttm_reason end as reason
  from day_shares d asof left join ttm_points p on p.symbol = d.symbol and d.trade_date >= p.visible_from left join f on f.symbol = d.symbol left join ttm_whole w on w.symbol = d.symbol),
s as (select *, case when shares is null or shares <= 0 then 'no_share_capital' when ttm is null then coalesce(reason, 'no_visible_report') when ttm <= 0 then 'ttm_non_positive'
  when currency <> 'CNY' then 'fx_missing' else 'ok' end as st from x)
select symbol, trade_date, close_raw, st as pe_status, case when st = 'ok' then close_raw * shares::double / ttm::double end as pe_ttm,
  st || case when event_type like 'snapshot%' then ';snapshot_share_basis' else '' end || case when degraded then ';degraded_available_at' else '' end as pe_status_full from s""")


@query("p01_latest_revisions", """
select symbol, period_end::varchar as period_end, period_type, revision, round(np::double, 2) as net_profit_attr, available_date::varchar as available_date from rep_latest""")
def _(m):
    return v.latest_revisions(m.rep).select("symbol", "period_end", "period_type", "revision", r("net_profit_attr", 2).alias("net_profit_attr"), "available_date")


@query("p02_visible_reports", """
select symbol, visible_from::varchar as visible_from, visible_rows, period_end::varchar as period_end, revision from ttm_points""")
def _(m):
    return v.visible_latest(m.rep).select("symbol", "visible_from", "visible_rows", "period_end", "revision")


@query("p03_ttm", "select symbol, visible_from::varchar as visible_from, ttm::double as ttm, ttm_reason from ttm_points")
def _(m):
    return v.ttm(m.rep).select("symbol", "visible_from", "ttm", "ttm_reason")


@query("p04_shares_asof", "select symbol, trade_date::varchar as trade_date, shares::double as shares, eff::varchar as effective_at from day_shares")
def _(m):
    return v.shares_asof(m.daily_bars.select("symbol", "trade_date"), m.share_events).select("symbol", "trade_date", "shares", "effective_at")


def pe(m):
    return v.pe_series(m.daily_bars, m.rep, m.share_events)


@query("p05_pe_ttm", "select symbol, trade_date::varchar as trade_date, round(pe_ttm, 6) as pe_ttm, pe_status from pe_days")
def _(m):
    return rounded(pe(m), ["symbol", "trade_date", "pe_status"], pe_ttm=6)


@query("p06_pe_series", "select symbol, trade_date::varchar as trade_date, round(pe_ttm, 6) as pe_ttm, pe_status_full from pe_days")
def _(m):
    return rounded(pe(m), ["symbol", "trade_date", "pe_status_full"], pe_ttm=6)


QS = (5, 25, 50, 75, 95)
view("pe_quant", "select symbol, count(*) as n_days, min(trade_date) as s, max(trade_date) as e, arg_max(pe_ttm, trade_date) as current_pe, "
     + ", ".join(f"quantile_cont(pe_ttm, {p / 100}) as p{p}" for p in QS) + " from pe_days where pe_ttm is not null group by 1")


@query("p07_pe_quantiles", 'select symbol, n_days, s::varchar as start, e::varchar as "end", round(current_pe, 4) as current_pe, '
       + ", ".join(f"round(p{p}, 4) as p{p}" for p in QS) + " from pe_quant")
def _(m):
    return rounded(v.pe_quantiles(pe(m)), ["symbol", "n_days", "start", "end"], current_pe=4, **{f"p{p}": 4 for p in QS})


@query("p08_yoy", """
select symbol, period_end::varchar as period_end, period_type, round(revenue_yoy, 6) as revenue_yoy, round(np_yoy, 6) as net_profit_attr_yoy from rep_yoy""")
def _(m):
    return rounded(v.yoy(v.latest_revisions(m.rep)), ["symbol", "period_end", "period_type"], revenue_yoy=6, net_profit_attr_yoy=6)


view("fc", """
select symbol, (period_end + 60)::date as snapshot_at, np*2 as fy1, np*3 as fy2, case when fiscal_year % 2 = 0 then np*4 end as fy3 from rep
where period_type = 'annual' qualify row_number() over (partition by symbol order by period_end desc) = 1""")


@query("p09_forecast_gap", """
with l as (select symbol, period_end, np_yoy from rep_yoy qualify row_number() over (partition by symbol order by period_end desc) = 1)
select f.symbol, snapshot_at::varchar as snapshot_at, year(snapshot_at)::int as fy1_year, fy1::double as fy1, 0.125::double as fy1_yoy, round(fy2::double/nullif(fy1::double, 0) - 1, 6) as fy2_yoy,
  round(fy3::double/nullif(fy2::double, 0) - 1, 6) as fy3_yoy, period_end::varchar as actual_period, round((0.125 - np_yoy)*100, 4) as gap_pp from fc f left join l using (symbol)""")
def _(m):
    return rounded(v.forecast_gap(m.forecasts, m.rep), ["symbol", "snapshot_at", "fy1_year", F.col("fy1").cast("double"), "actual_period"],
                   fy1_yoy=6, fy2_yoy=6, fy3_yoy=6, gap_pp=4)


view("fund", """
select y.symbol, y.period_end, y.period_type, round(np::double/nullif(y.revenue::double, 0), 6) as net_margin, round(np::double/nullif(total_equity::double, 0), 6) as roe,
  round(total_liabilities::double/total_assets::double, 6) as liability_ratio, case when coalesce(stb, ltb) is not null then coalesce(stb, 0) + coalesce(ltb, 0) end::double as interest_debt,
  (ocf - capex)::double as fcf, round(ocf::double/nullif(np::double, 0), 6) as ocf_to_np, case when q <> 2 then q::varchar end as gross_margin_src,
  concat_ws(',', case when total_assets is null then 'balance_sheet' end, case when ocf is null then 'cash_flow' end, case when q = 2 then 'gross_margin' end) as incomplete
from rep_yoy y left join balance b using (symbol, period_end, period_type) left join cash c using (symbol, period_end, period_type)""")


@query("p10_fundamentals", "select * replace (period_end::varchar as period_end) from fund")
def _(m):
    x = v.fundamentals(m.rep, m.balance, m.cash, m.snapshots)
    return rounded(x, ["symbol", "period_end", "period_type", "gross_margin_src", "incomplete", F.col("interest_debt").cast("double"), F.col("fcf").cast("double")],
                   net_margin=6, roe=6, liability_ratio=6, ocf_to_np=6)


view("last_close", "select symbol, close_raw from daily_bars qualify row_number() over (partition by symbol order by trade_date desc) = 1")
view("last_shares", "select symbol, shares from day_shares qualify row_number() over (partition by symbol order by trade_date desc) = 1")


@query("p11_implied_returns", """
with u as (select symbol, 'fy1' as fy, fy1::double as np from fc union all select symbol, 'fy2', fy2::double from fc),
q as (select symbol, 'p25' as quantile, p25 as pe from pe_quant union all select symbol, 'p50', p50 from pe_quant union all select symbol, 'p75', p75 from pe_quant),
g as (select c.symbol, f.fy, n.quantile, c.close_raw, s.shares::double as shares, u.np, q.pe from last_close c cross join (values ('fy1'), ('fy2')) f(fy) cross join (values ('p25'), ('p50'), ('p75')) n(quantile)
  left join last_shares s using (symbol) left join u on u.symbol = c.symbol and u.fy = f.fy left join q on q.symbol = c.symbol and q.quantile = n.quantile)
select symbol, fy, quantile, case when shares is null or close_raw is null then 'no_share_or_price' when np is null then 'no_forecast' else 'ok' end as status,
  round(np/shares, 6) as eps, round(np/shares*pe, 4) as implied_price, round(np/shares*pe/close_raw - 1, 6) as upside from g""")
def _(m):
    bars = m.daily_bars.groupBy("symbol").agg(F.max_by("close_raw", "trade_date").alias("close_raw"), F.max("trade_date").alias("trade_date"))
    sh = v.shares_asof(bars.select("symbol", "trade_date"), m.share_events).select("symbol", "shares")
    x = v.implied_returns(v.forecast_extract(m.forecasts), v.pe_quantiles(pe(m)), sh, bars.drop("trade_date"))
    return rounded(x, ["symbol", "fy", "quantile", "status"], eps=6, implied_price=4, upside=6)


@query("p12_pool_comps", """
with p as (select symbol, pe_ttm, trade_date from pe_days where pe_ttm is not null qualify row_number() over (partition by symbol order by trade_date desc) = 1),
l as (select symbol, period_end, np_yoy from rep_yoy qualify row_number() over (partition by symbol order by period_end desc) = 1),
b as (select symbol, roe, liability_ratio from fund where liability_ratio is not null qualify row_number() over (partition by symbol order by period_end desc) = 1)
select l.symbol, round(pe_ttm, 4) as pe_ttm, trade_date::varchar as pe_date, period_end::varchar as latest_period, round(np_yoy, 6) as net_profit_yoy, roe, liability_ratio
from l left join p using (symbol) left join b using (symbol)""")
def _(m):
    return rounded(v.pool_comps(pe(m), m.rep, m.balance), ["symbol", "pe_date", "latest_period"], pe_ttm=4, net_profit_yoy=6, roe=6, liability_ratio=6)


@query("p13_fundamental_panel", """
with y as (select symbol, period_type, period_end, round(revenue::double/1e8, 2) as rev, round(np::double/1e8, 2) as np, round(revenue_yoy, 4) as rev_yoy, round(np_yoy, 4) as np_yoy from rep_yoy),
a as (select * from y where period_type = 'annual' qualify row_number() over (partition by symbol order by period_end desc) = 1),
i as (select * from y where period_type <> 'annual' qualify row_number() over (partition by symbol order by period_end desc) = 1)
select s.symbol, a.period_end::varchar as annual_period_end, a.rev as annual_rev, a.np as annual_np, a.rev_yoy as annual_rev_yoy, a.np_yoy as annual_np_yoy,
  i.period_end::varchar as interim_period_end, i.rev as interim_rev, i.np as interim_np, i.rev_yoy as interim_rev_yoy, i.np_yoy as interim_np_yoy,
  case when f.symbol is not null then 3.25 end::double as pb_mrq, case when f.symbol is not null then 1.5 end::double as ps_lyr,
  round(fy1::double/1e8, 2) as fy1_yi, round(fy2::double/1e8, 2) as fy2_yi, round(fy3::double/1e8, 2) as fy3_yi
from (select distinct symbol from rep) s left join a using (symbol) left join i using (symbol) left join fc f using (symbol)""")
def _(m):
    return v.fundamental_panel(m.rep, m.forecasts)


@query("p14_flatten_snapshot", """
select symbol, period_end::varchar as period_end, indicator, value from (
  select symbol, period_end, '净资产收益率(ROE)' as indicator, fiscal_year::varchar as value from rep where revision = 1 and q <> 2
  union all select symbol, period_end, '毛利率', q::varchar from rep where revision = 1 and q <> 2
  union all select symbol, period_end, '营业总收入', revenue::varchar from rep where revision = 1 and q <> 2) x""")
def _(m):
    return v.flatten_snapshot(m.snapshots)
