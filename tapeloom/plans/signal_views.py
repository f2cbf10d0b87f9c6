"""SQL of chips, anchors and exhaustion facts for the checks, written with self-joins and recursive queries."""
from tapeloom.plans.registry import view

BINS = 200

view("chip_days", """
select symbol, trade_date, low_raw*price_adj_factor as a, high_raw*price_adj_factor as b, close_raw*price_adj_factor as c,
  price_adj_factor as f, turnover, amount_raw, volume_raw,
  min(low_raw*price_adj_factor) over (partition by symbol) * (1 - 0.1::double) as g0,
  max(high_raw*price_adj_factor) over (partition by symbol) * (1 + 0.1::double) as g1,
  row_number() over (partition by symbol order by trade_date) as i from daily_bars""")


def cdf(x: str, peak: str) -> str:
    return (f"case when {x} <= a then 0.0 when {x} >= b then 1.0 when {x} <= {peak} then pow({x} - a, 2)/((b - a)*({peak} - a)) "
            f"else 1 - pow(b - {x}, 2)/((b - a)*(b - {peak})) end")


def kernel_view(name: str, bins: int, peak: str, first_uniform: bool) -> None:
    uni = "when i = 1 then least(greatest((hi - a)/(b - a), 0), 1) - least(greatest((lo - a)/(b - a), 0), 1)" if first_uniform else ""
    view(name, f"""
select symbol, trade_date, i, a, b, c, f, turnover, g0, g1, k, lo, hi, case when a >= b then case when lo < a and a <= hi then 1.0 else 0.0 end {uni}
  else ({cdf('hi', 'pk')}) - ({cdf('lo', 'pk')}) end as mass
from (select *, g0 + k * ((g1 - g0)/{bins}) as lo, g0 + (k + 1) * ((g1 - g0)/{bins}) as hi, {peak} as pk
      from chip_days cross join (select unnest(range({bins})) as k)) x""")


kernel_view("kernel20", 20, "least(greatest(amount_raw/volume_raw, a), b)", False)
kernel_view(f"kernel{BINS}", BINS, "c", True)

view("chip_kernels", f"select symbol, i, any_value(turnover) as turnover, list(mass order by k) as m from kernel{BINS} group by 1, 2")
view("chip_replay", """
select * from (with recursive s as (
  select symbol, i, m as w from chip_kernels where i = 1
  union all
  select d.symbol, d.i, list_transform(list_zip(s.w, d.m), lambda x: (1 - least(0.7*d.turnover, 0.8))*x[1] + least(0.7*d.turnover, 0.8)*x[2])
  from s join chip_kernels d on d.symbol = s.symbol and d.i = s.i + 1) select * from s)""")
view("chip_cum", f"""
select d.symbol, d.trade_date, d.i, d.c, d.f, u.k, g0 + (u.k + 0.5)*((g1 - g0)/{BINS}) as mid, u.w,
  sum(u.w) over (partition by d.symbol, d.i order by u.k) as cum
from (select symbol, i, unnest(range({BINS})) as k, unnest(w) as w from chip_replay) u join chip_days d on d.symbol = u.symbol and d.i = u.i""")
view("chip_steps", """
select *, lead(mid) over (partition by symbol, i order by k) as mid2, lead(cum) over (partition by symbol, i order by k) as cum2 from chip_cum""")
view("chip_out", """
select symbol, trade_date, any_value(i) as i, any_value(f) as f, sum(mid*w)/sum(w) as avg_cost_adj,
  max(case when mid <= c and c < mid2 then cum + (c - mid)/(mid2 - mid)*(cum2 - cum) end) as winner_ratio,
  coalesce(max(case when cum <= 0.05 and 0.05 < cum2 then mid + (0.05 - cum)/(cum2 - cum)*(mid2 - mid) end), min(mid)) as c5,
  coalesce(max(case when cum <= 0.95 and 0.95 < cum2 then mid + (0.95 - cum)/(cum2 - cum)*(mid2 - mid) end), min(mid)) as c95,
  any_value(c) as c, min(mid) as m0, max(case when k = 0 then cum end) as cum0
from chip_steps group by 1, 2""")

view("panic_weeks", """
select *, coalesce(volume >= 2*base and high - low > 0 and (
    (least(open, close) - low >= 2*abs(close - open) and least(open, close) - low >= 0.35*(high - low))
    or (close > open and abs(close - open) >= 0.6*(high - low) and close/prev - 1.0 >= 0.05)), false) as panic
from (select *, case when i >= 20 then avg(volume) over (partition by symbol order by i rows between 20 preceding and 1 preceding) end as base,
  lag(close) over (partition by symbol order by i) as prev from weeks) x""")
view("anchor_weeks", """
with p as (select *, max(case when panic then i end) over (partition by symbol order by i rows between unbounded preceding and current row) as pj from panic_weeks),
fb as (select a.symbol, a.i, b.i as fj from p a join p b on a.symbol = b.symbol and b.i between a.i - 25 and a.i
  qualify row_number() over (partition by a.symbol, a.i order by b.close, b.i desc) = 1)
select p.*, coalesce(pj, fj) as j, pj is null as is_fallback from p join fb using (symbol, i)""")
view("low_days", """
select w.symbol, w.i, d.trade_date as low_date, d.low as low_adj, d.low_raw from weeks w
join adj d on d.symbol = w.symbol and d.trade_date between w.week_start_date and w.week_end_date
qualify row_number() over (partition by w.symbol, w.i order by d.low, d.trade_date) = 1""")
view("decline_weeks", """
select a.symbol, a.i, b.i as di, b.week_end_date as decl_date, b.close as decl_close, b.close_raw as decl_close_raw
from weeks a join weeks b on a.symbol = b.symbol and b.i between a.i - 26 and a.i - 1
qualify row_number() over (partition by a.symbol, a.i order by b.close desc, b.i desc) = 1""")
view("tline", """
select a.symbol, a.i, a.week_end_date, a.close, a.low, a.volume, a.panic, a.j, a.is_fallback, l.low_date, l.low_adj, l.low_raw,
  d.di, d.decl_date, d.decl_close, d.decl_close_raw
from anchor_weeks a join low_days l on l.symbol = a.symbol and l.i = a.j left join decline_weeks d on d.symbol = a.symbol and d.i = a.j""")
view("episodes", """
with r as (select *, sum(chg) over (partition by symbol order by i) as run from (
  select *, case when lag(low_date) over w = low_date and lag(is_fallback) over w = is_fallback then 0 else 1 end as chg
  from tline window w as (partition by symbol order by i)) x),
f as (select symbol, run, arg_min(coalesce(decl_close, 1e300), i) as top from r group by 1, 2),
e as (select symbol, run, min(i) as ei, min(week_end_date) as ew from r join f using (symbol, run) where close > top group by 1, 2)
select r.*, case when r.i >= ei then ei end as end_idx, case when r.i >= ei then ew end as end_week from r left join e using (symbol, run)""")
view("week_until", """
with n as (select symbol, count(*) as n, max(wk) as lw from weeks group by 1),
c as (select wk, max(trade_date) as we, row_number() over (order by wk) as pos from (select trade_date, date_trunc('week', trade_date)::date as wk from trading_calendar) group by 1)
select w.symbol, w.i, w.week_end_date, coalesce(x.week_end_date, c2.we) as until from weeks w join n using (symbol)
left join weeks x on x.symbol = w.symbol and x.i = w.i + 3
left join c c1 on c1.wk = n.lw left join c c2 on c2.pos = c1.pos + (w.i + 3 - n.n + 1) and w.i + 3 >= n.n""")
view("dryups", """
select t.*, b.n as base_n, b.m as base_mean,
  case when di is null then 'no_decline_start' when b.n is null or b.n < 4 then 'insufficient_base_weeks' when t.volume <= 0.5*b.m then 'condition_met' else 'condition_not_met' end as dry_reason
from tline t left join (select t.symbol, t.i, count(*) as n, avg(w.volume) as m from tline t join weeks w
  on w.symbol = t.symbol and w.i between t.di + 1 and t.di + 4 and w.i < t.i group by 1, 2) b on b.symbol = t.symbol and b.i = t.i""")
view("nnls", """
select t.*, case when t.i - t.j < 3 then 'waiting_confirm' when f.m < low_adj then 'broken_before_confirm' when t.low < low_adj then 'new_low'
  when t.i - t.j = 3 then 'confirmed' else 'holding' end as nnl_reason
from tline t left join (select t.symbol, t.i, min(w.low) as m from tline t join weeks w on w.symbol = t.symbol and w.i between t.j + 1 and t.j + 3 group by 1, 2) f
  on f.symbol = t.symbol and f.i = t.i""")
view("pivots", """
select w.*, coalesce(low < lag(low) over x and low < lag(low, 2) over x and low < lead(low) over x and low < lead(low, 2) over x, false) as is_pivot
from weeks w window x as (partition by symbol order by i)""")
view("divs", """
with p as (select symbol, p.i, close, rsi12, 2*(dif - dea) as hist, row_number() over (partition by symbol order by p.i) as k
  from pivots p left join rsi12_w r using (symbol, week_end_date) left join macd_w q using (symbol, week_end_date) where is_pivot)
select w.symbol, w.i, w.week_end_date, case when w.i < 4 then 'insufficient_history' when c.i is null then 'no_pivot_confirmed' when b.i is null then 'single_pivot'
  when w.i - b.i > 26 then 'outside_lookback'
  when c.close < b.close and (coalesce(c.rsi12 > b.rsi12, false) or coalesce(c.hist > b.hist, false)) then 'condition_met' else 'condition_not_met' end as div_reason
from weeks w left join p c on c.symbol = w.symbol and c.i = w.i - 2 left join p b on b.symbol = c.symbol and b.k = c.k - 1""")
view("durs", """
select *, case when di is null then 'no_decline_start' when i - di >= 8 then 'condition_met' else 'condition_not_met' end as dur_reason,
  coalesce(i - di = 8, false) as dur_trigger from tline""")
view("exh_wide", """
select e.symbol, e.i, e.week_end_date, e.panic, e.is_fallback, e.low_date, e.end_idx, e.end_week, d.dry_reason, n.nnl_reason, v.div_reason, u.dur_reason, u.dur_trigger,
  (select max(p.i) from tline p where p.symbol = e.symbol and p.i between e.i - 3 and e.i and p.panic and p.low_date = e.low_date and p.is_fallback = e.is_fallback) as pt,
  (select max(p.i) from tline p join divs q using (symbol, i) where p.symbol = e.symbol and p.i between e.i - 3 and e.i and q.div_reason = 'condition_met'
    and p.low_date = e.low_date and p.is_fallback = e.is_fallback) as dt,
  substring(sha256(e.symbol || '|panic_low|' || e.low_date::varchar || '|' || e.is_fallback::varchar), 1, 16) as anchor_id
from episodes e join dryups d using (symbol, i) join nnls n using (symbol, i) join divs v using (symbol, i) join durs u using (symbol, i)""")
view("exh_rows", """
select symbol, i, week_end_date, anchor_id, end_idx, end_week, 'panic' as signal, pt is not null as active, panic as trig,
  case when pt is not null then case when end_idx <= pt + 3 then end_week else (select until from week_until x where x.symbol = e.symbol and x.i = pt) end end as until,
  case when panic then 'condition_met' when pt is not null then 'holding_active' else 'condition_not_met' end as reason from exh_wide e
union all
select symbol, i, week_end_date, anchor_id, end_idx, end_week, 'dry_up', dry_reason = 'condition_met', dry_reason = 'condition_met',
  case when dry_reason = 'condition_met' then week_end_date end, dry_reason from exh_wide
union all
select symbol, i, week_end_date, anchor_id, end_idx, end_week, 'no_new_low_3w', nnl_reason in ('confirmed', 'holding'), nnl_reason = 'confirmed', null, nnl_reason from exh_wide
union all
select symbol, i, week_end_date, anchor_id, end_idx, end_week, 'divergence', dt is not null, div_reason = 'condition_met',
  case when dt is not null then case when end_idx <= dt + 3 then end_week else (select until from week_until x where x.symbol = e.symbol and x.i = dt) end end,
  case when div_reason = 'condition_met' then 'condition_met' when dt is not null then 'holding_active' else div_reason end from exh_wide e
union all
select symbol, i, week_end_date, anchor_id, end_idx, end_week, 'duration', dur_reason = 'condition_met', dur_trigger, null, dur_reason from exh_wide""")
view("exh_facts", """
select symbol, week_end_date as observed_on, anchor_id, signal, case when active and end_idx is null then 'active' else 'inactive' end as state,
  active and trig and end_idx is null as triggered,
  case when active and end_idx is not null then least(coalesce(until, end_week), end_week) else until end as active_until,
  case when active and end_idx is not null then 'episode_ended' else reason end as reason from exh_rows""")
view("week_counts", """
with g as (select symbol, observed_on, anchor_id, count(distinct signal) filter (state = 'active') as n,
    coalesce(string_agg(signal, ',' order by signal) filter (state = 'active'), '') as signals from exh_facts group by 1, 2, 3),
r as (select *, row_number() over (partition by symbol, observed_on order by n desc, anchor_id) as k, max(n) over (partition by symbol, observed_on) >= 2 as meets_min from g)
select symbol, observed_on, anchor_id, n as active_count, signals as active_signals, meets_min from r where k = 1""")
