"""SQL of the derived tables, for the checks. Kept apart from the DataFrame code in market.py."""
from tapeloom.plans.registry import view

view("bars0", """
select symbol, trade_date, max(case when rn=1 then px end) as open_raw, max(px) as high_raw, min(px) as low_raw,
  max(case when rn=n then px end) as close_raw, sum(l_quantity) as volume_raw, sum(l_extendedprice) as amount_raw
from (select p_brand as symbol, cast(l_shipdate as date) as trade_date, l_extendedprice/l_quantity as px, l_quantity,
        l_extendedprice,
        row_number() over (partition by p_brand, cast(l_shipdate as date)
          order by l_orderkey,l_linenumber,l_extendedprice/l_quantity) as rn,
        count(*) over (partition by p_brand, cast(l_shipdate as date)) as n
      from lineitem join part on l_partkey=p_partkey where isodow(l_shipdate) <= 5) x
group by symbol, trade_date""")

view("daily_bars", """
select b.*, case when cast(substring(symbol,7) as int) % 5 = 0 and trade_date >= date '1999-06-15' then 2.0
  when cast(substring(symbol,7) as int) % 5 = 1 and trade_date >= date '1998-06-15' then 1.01 else 1.0 end::double as price_adj_factor,
  case when cast(substring(symbol,7) as int) % 5 = 0 and trade_date < date '1999-06-15' then 0.5 else 1.0 end::double as share_factor,
  case when volume_raw/2000.0 > 0.5 then 0.5 else volume_raw/2000.0 end as turnover from bars0 b""")

view("trading_calendar", """
select 'CN' as market, trade_date, true as is_open, row_number() over (order by trade_date) as td_ord
from (select distinct trade_date from bars0) x""")

view("index_bars", "select 'IDX' as index_code, trade_date, avg(close_raw) as close from bars0 group by trade_date")

view("reports", """
select symbol, fiscal_year, q, last_day(make_date(fiscal_year, q*3, 1)) as period_end,
  case when q=4 then 'annual' when q=2 then 'interim' else 'quarterly' end as period_type, true as is_cumulative,
  1 as revision, sum(rev) over (partition by symbol, fiscal_year order by q) as revenue,
  sum(rev*0.12 - 300000) over (partition by symbol, fiscal_year order by q) as net_profit_attr,
  cast(last_day(make_date(fiscal_year, q*3, 1)) + interval 30 day as date) as available_date
from (select concat('Brand#', cast(o_custkey % 25 + 1 as int)) as symbol, cast(extract(year from o_orderdate) as int) as fiscal_year,
  cast(extract(quarter from o_orderdate) as int) as q, sum(o_totalprice) as rev from orders group by 1,2,3) x""")

view("announcements", """
select event_id, concat('Brand#', cast(user_id % 25 + 1 as int)) as symbol,
  cast(cast(ts as date) - interval 8766 day as date) as a_date, ts, event_type, value from events""")

view("macro_factors", """
select concat('F_', event_type) as code, case when event_type in ('click','view') then 'GLOBAL' else 'CN' end as market,
  a_date as trade_date, cast(round(avg(value),4) as decimal(38,10)) as close from announcements group by 1,2,3""")

view("cards", """
select symbol, v as card_version_id, case when v=1 then 'superseded' else 'active' end as status,
  case when v=1 then date '1999-01-01' else date '2000-01-01' end as effective_from,
  case when v=1 then date '2000-01-01' end as effective_to,
  cast(round(m*0.95,4) as decimal(18,4)) as t1_low, cast(round(m*1.00,4) as decimal(18,4)) as t1_high,
  cast(round(m*0.75,4) as decimal(18,4)) as t2_low, cast(round(m*0.85,4) as decimal(18,4)) as t2_high,
  cast(round(m*0.60,4) as decimal(18,4)) as invalidation_line, cast(round(m*1.20,4) as decimal(18,4)) as trigger_level,
  cast(round(m*1.05,4) as decimal(18,4)) as stop_level
from (select symbol, v, avg(close_raw)*(case when v=1 then 1.0 else 0.9 end) as m
      from bars0 cross join (select 1 as v union all select 2 as v) t where trade_date < date '1999-01-01' group by symbol, v) x""")

view("fwd_closes", """
select symbol, trade_date, close_raw * price_adj_factor * (1 + 0.005::double * (year(trade_date) - 1998)) * (1 + ((cast(substring(symbol, 7) as int) * 37 + date_diff('day', date '1970-01-01', trade_date) * 11) % 100 - 45) * 0.000002::double) as close_fwd
from daily_bars where (cast(substring(symbol, 7) as int) * 37 + date_diff('day', date '1970-01-01', trade_date) * 11) % 100 < 90""")

view("corporate_actions", """
with s as (select symbol, trade_date, close_raw, price_adj_factor as f, share_factor as sf,
    lag(close_raw) over w as pc, lag(price_adj_factor) over w as pf, lag(share_factor) over w as psf
  from daily_bars window w as (partition by symbol order by trade_date)),
u as (
  select symbol, trade_date as ex_date, 'split' as action_type, null::double as cash_per_share, round(sf/psf, 6) as split_ratio
  from s where sf <> psf
  union all
  select symbol, trade_date, 'cash_dividend', round(pc * (1 - pf/f), 4), null from s where f <> pf and sf = psf
  union all
  select symbol, a_date, 'cash_dividend', round(max(value) * 10, 2), null from announcements where event_type = 'purchase' group by 1, 2)
select symbol || '/' || ex_date::varchar || '/' || action_type as ca_id, * from u""")

view("adj", """
select symbol, trade_date, open_raw*price_adj_factor as open, high_raw*price_adj_factor as high, low_raw*price_adj_factor as low,
  close_raw*price_adj_factor as close, volume_raw/share_factor as volume, amount_raw as amount, close_raw, low_raw,
  row_number() over (partition by symbol order by trade_date) - 1 as i from daily_bars""")

view("weeks", """
with c as (select date_trunc('week', trade_date)::date as wk, min(trade_date) as week_start_date, max(trade_date) as week_end_date
           from trading_calendar group by 1),
b as (select *, date_trunc('week', trade_date)::date as wk from adj)
select b.symbol, b.wk, c.week_start_date, c.week_end_date, arg_min(open, trade_date) as open, max(high) as high, min(low) as low,
  arg_max(close, trade_date) as close, arg_max(close_raw, trade_date) as close_raw, sum(volume) as volume, sum(amount) as amount, count(*) as trading_days,
  row_number() over (partition by b.symbol order by c.week_end_date) - 1 as i
from b join c on b.wk = c.wk group by b.symbol, b.wk, c.week_start_date, c.week_end_date
having max(trade_date) = c.week_end_date""")

def ema_sql(src: str, order: str, col: str, n: int) -> str:
    a = 2.0 / (n + 1)
    return (f"(select a.symbol, a.{order}, a.i, sum(b.{col} * pow({1 - a!r}, a.i - b.i) * case when b.i = 0 then 1.0 else {a!r} end) as v "
            f"from {src} a join {src} b on a.symbol = b.symbol and b.i <= a.i group by 1, 2, 3)")

def recursive_views(tag: str, src: str, order: str) -> None:
    """Closed forms of the recursions: a weighted sum over the rows so far."""
    view(f"dif_{tag}", f"""
select a.symbol, a.{order}, a.i, sum(b.close * (pow({1 - 2 / 13!r}, a.i - b.i) * case when b.i = 0 then 1.0 else {2 / 13!r} end)) as ema12,
  sum(b.close * (pow({1 - 2 / 27!r}, a.i - b.i) * case when b.i = 0 then 1.0 else {2 / 27!r} end)) as ema26
from {src} a join {src} b on a.symbol = b.symbol and b.i <= a.i group by 1, 2, 3""")
    view(f"macd_{tag}", f"""
select a.symbol, a.{order}, a.i, any_value(a.ema12 - a.ema26) as dif,
  sum((b.ema12 - b.ema26) * pow(0.8, a.i - b.i) * case when b.i = 0 then 1.0 else 0.2 end) as dea
from dif_{tag} a join dif_{tag} b on a.symbol = b.symbol and b.i <= a.i group by 1, 2, 3""")
    view(f"steps_{tag}", f"""
select symbol, {order}, i, greatest(close - lag(close) over w, 0) as up, greatest(lag(close) over w - close, 0) as down
from {src} window w as (partition by symbol order by {order})""")
    for n in (6, 12, 24):
        k = (n - 1) / n
        view(f"rsi{n}_{tag}", f"""
select symbol, {order}, i, case when l = 0 then case when g > 0 then 100.0 else 50.0 end when g = 0 then 0.0
  else 100.0 - 100.0/(1.0 + g/l) end as rsi{n}
from (select a.symbol, a.{order}, a.i,
    sum(b.up * case when b.i <= {n} then pow({k!r}, a.i - {n}) / {n} else pow({k!r}, a.i - b.i) / {n} end) as g,
    sum(b.down * case when b.i <= {n} then pow({k!r}, a.i - {n}) / {n} else pow({k!r}, a.i - b.i) / {n} end) as l
  from steps_{tag} a join steps_{tag} b on a.symbol = b.symbol and b.i >= 1 and b.i <= a.i where a.i >= {n} group by 1, 2, 3) x""")
    view(f"rsv_{tag}", f"""
select *, row_number() over (partition by symbol order by {order}) as m from (
  select symbol, {order}, i, (close - min(low) over w) / (max(high) over w - min(low) over w) * 100.0 as rsv,
    max(high) over w as hh, min(low) over w as ll from {src}
  window w as (partition by symbol order by {order} rows between 8 preceding and current row)) x where i >= 8 and hh <> ll""")
    view(f"k_{tag}", f"""
select a.symbol, a.{order}, a.m, pow(2.0/3, a.m) * 50.0 + sum(b.rsv / 3 * pow(2.0/3, a.m - b.m)) as k
from rsv_{tag} a join rsv_{tag} b on a.symbol = b.symbol and b.m <= a.m group by 1, 2, 3""")
    view(f"kd_{tag}", f"""
select a.symbol, a.{order}, any_value(a.k) as k, pow(2.0/3, a.m) * 50.0 + sum(b.k / 3 * pow(2.0/3, a.m - b.m)) as d
from k_{tag} a join k_{tag} b on a.symbol = b.symbol and b.m <= a.m group by a.symbol, a.{order}, a.m""")

recursive_views("d", "adj", "trade_date")
recursive_views("w", "weeks", "week_end_date")
