"""SQL of the vendor fixtures for the checks."""
from tapeloom.plans.registry import view

view("full_cal", """
select 'CN' as market, d::date as trade_date, t.trade_date is not null as is_open from (select unnest(generate_series(min(trade_date), max(trade_date), interval 1 day)) as d from trading_calendar) s
left join trading_calendar t on t.trade_date = s.d::date""")
view("vendor", """
select case when n % 5 = 0 then lpad(n::varchar, 5, '0') else (n + 600000)::varchar end as code, case when n % 5 = 0 then '31' else '1' end as setcode,
  case when n % 5 = 0 then lpad(n::varchar, 5, '0') || '.HK' else (n + 600000)::varchar || '.SH' end as sym, case when n % 5 = 0 then 'HK' else 'CN' end as market,
  case when k = 3 and day(trade_date) = 7 then (date_trunc('week', trade_date)::date + 6)::date else trade_date end as td, year(trade_date) as yr,
  case when k <> 2 then round(open_raw, 7) end as open, case when k <> 2 then case when k = 1 and day(trade_date) = 13 then round(low_raw, 7)/2 else round(high_raw, 7) end end as high,
  case when k <> 2 then round(low_raw, 7) end as low, case when k <> 2 then round(close_raw, 7) end as close, volume_raw as v, k, n, round(amount_raw, 2) as amount, round(turnover, 4) as turnover
from (select *, cast(substring(symbol, 7) as int) as n, (cast(substring(symbol, 7) as int) * 37 + date_diff('day', date '1970-01-01', trade_date) * 11) % 100 as k from daily_bars) x""")
view("vgate", """
select v.*, 'data/raw/stock_finance_data/price/' || yr || '-12-31/run1/' || sym || '.csv' as file_path,
  case when v.market = 'HK' then null when k.is_open is null then 'outside_calendar' when not k.is_open then 'closed_day' end as cal_reason,
  case when open is null then 'EMPTY' when not (low - 1e-6 <= least(open, close) and greatest(open, close) <= high + 1e-6) then 'ohlc_order' end as bar_reason
from vendor v left join full_cal k on k.market = v.market and k.trade_date = v.td""")
view("vrows", """
select *, coalesce(cal_reason, bar_reason) as reason, case when cal_reason is not null then 'conflict' when bar_reason = 'EMPTY' then 'skip' when bar_reason is not null then 'conflict' else 'ok' end as outcome from vgate""")
view("vkept", "select *, (n * 37 + date_diff('day', date '1970-01-01', td) * 11) % 100 as kk from vrows r where outcome = 'ok' and not exists (select 1 from vrows b where b.file_path = r.file_path and b.outcome = 'conflict')")
view("raw_files", """
select 'data/raw/' || k || '/2001-12-31/run' || doc_id || '/' || stem || '.csv' as file_path, k, stem, tag, base, sha256(text) as content_hash, doc_id
from (select *, 'Brand#' || (doc_id % 40 + 1) as base, 'Brand#' || (doc_id % 40 + 1) || tag as stem from (
  select *, ['stock_finance_data/price', 'tdx/kline', 'akshare/price', 'akshare/telegraph', 'tdx/unknown', 'yahoo_finance/fx'][(doc_id % 6 + 1)::int] as k,
    case doc_id % 4 when 0 then '_forward' when 1 then '_tq1' else '' end as tag from documents) x) y""")
