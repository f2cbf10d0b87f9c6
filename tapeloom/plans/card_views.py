"""SQL of cards, daily signals and state machines for the checks."""
from tapeloom.plans.registry import view

view("vcards", """
select symbol, card_version_id::varchar as card_version_id, status, effective_from, effective_to,
  case when card_version_id = 2 then '1' end as supersedes_id, (effective_from + 120)::date as next_review_at,
  t1_low, t1_high, t2_low, t2_high, invalidation_line, trigger_level, stop_level,
  t2_low as box_low, trigger_level as box_high, t2_low as buy_zone_low, t2_high as buy_zone_high, t1_high as sell_zone_low,
  stop_level as sell_zone_high, invalidation_line as box_invalidation
from cards where not (card_version_id = 1 and symbol like '%3')""")
view("bars_h", "select * replace (case when (cast(substring(symbol, 7) as int) * 37 + date_diff('day', date '1970-01-01', trade_date) * 11) % 100 <> 1 then close_raw end as close_raw) from daily_bars")


def bar_cards_view(name: str, bars: str) -> None:
    view(name, f"""
select b.*, c.* exclude (symbol), cast(b.close_raw as decimal(28,10)) as dc from {bars} b join vcards c on c.symbol = b.symbol
  and b.trade_date >= c.effective_from and (c.effective_to is null or b.trade_date < c.effective_to)
qualify row_number() over (partition by b.symbol, b.trade_date order by c.effective_from, c.card_version_id) = 1""")


bar_cards_view("bar_cards", "daily_bars")
view("freezes", "select symbol, ca_id, ex_date, action_type, cash_per_share from corporate_actions where action_type = 'split' or cash_per_share >= 2000")
view("open_freeze_rows", """
select * from freezes f where not exists (select 1 from freezes r where r.ca_id = f.ca_id and (r.cash_per_share >= 3000 or (r.cash_per_share >= 2500 and r.cash_per_share < 2700)))""")


def watch_views(tag: str, src: str) -> None:
    """Signals of the bar/card rows in ``src``."""
    near = lambda n: (f"(not (t{n}_low <= dc and dc <= t{n}_high) and abs(dc - case when dc < t{n}_low then t{n}_low else t{n}_high end) "
                      f"<= case when dc < t{n}_low then t{n}_low else t{n}_high end * 0.03)")
    view(f"prox{tag}", f"""
select *, case when tier is null then 'inactive' else 'active' end as state,
  case when tier is null then 'no_tier_within_threshold' else 'within_3%_of_tier_' || tier end as reason
from (select symbol, trade_date, card_version_id, case when {near(1)} then 1 when {near(2)} then 2 end as tier from {src}) x""")
    view(f"trig{tag}", f"""
with m as (select s.*, w.meets_min, t1_low <= dc and dc <= t1_high as in1, t2_low <= dc and dc <= t2_high as in2
  from {src} s asof left join week_counts w on w.symbol = s.symbol and s.trade_date >= w.observed_on),
h as (select *, case when in2 and coalesce(meets_min, false) then 2 when in1 then 1 end as hit, case when in2 and not coalesce(meets_min, false) then 2 end as pend from m)
select symbol, trade_date, card_version_id, hit, case when hit is not null then 'triggered' when pend is not null then 'pending_signals' else 'inactive' end as state,
  case when hit is not null then 'close_in_tier_' || hit || '_zone' when pend is not null then 'tier_' || pend || '_zone_entered_but_active_signals<2'
    else 'no_tier_zone_entered' end as reason from h""")
    view(f"fals{tag}", f"""
with b as (select symbol, trade_date, card_version_id, dc <= invalidation_line * 0.99 as br,
    row_number() over (partition by symbol, card_version_id order by trade_date) as k from {src}),
r as (select *, case when br then k - coalesce(max(case when not br then k end) over (partition by symbol, card_version_id order by k), 0) else 0 end as run from b),
p as (select *, coalesce(lag(run) over (partition by symbol, card_version_id order by k), 0) as prev from r)
select symbol, trade_date, card_version_id, run, case when run >= 2 then 'active' when br then 'watching' else 'inactive' end as state, run = 2 as triggered,
  case when run = 2 then 'confirmed' when run > 2 then 'holding' when br then 'breach_day_' || run || '_of_2' when prev >= 2 then 'recovered' else 'no_breach' end as reason from p""")
    view(f"box{tag}", f"""
select symbol, trade_date, card_version_id, case when dc < box_invalidation then 'box_breached' when dc > box_high then 'above_box'
  when sell_zone_low <= dc and dc <= sell_zone_high then 'sell_zone' when buy_zone_low <= dc and dc <= buy_zone_high then 'buy_zone'
  when dc < box_low then 'below_box' else 'mid_box' end as state from {src}""")
    view(f"mac{tag}", f"""
with m as (select s.symbol, s.trade_date, s.card_version_id, s.close_raw, s.price_adj_factor as f, x.ma20, x.ma60 from {src} s left join (
  select symbol, trade_date, case when i >= 19 then avg(close) over (partition by symbol order by i rows between 19 preceding and current row) end as ma20,
    case when i >= 59 then avg(close) over (partition by symbol order by i rows between 59 preceding and current row) end as ma60 from adj) x using (symbol, trade_date)),
p as (select *, case when close_raw > ma20/f then 'above' when close_raw < ma20/f then 'below' when ma20 is not null then 'at' end as p20,
  case when close_raw > ma60/f then 'above' when close_raw < ma60/f then 'below' when ma60 is not null then 'at' end as p60 from m)
select symbol, trade_date, card_version_id, case when p20 is null and p60 is null then 'incomplete' when coalesce(p20, p60) = 'above' and coalesce(p60, p20) = 'above' then 'above'
  when coalesce(p20, p60) = 'below' and coalesce(p60, p20) = 'below' then 'below' else 'mixed' end as state,
  case when p20 is null and p60 is null then 'missing_indicators' else 'adjusted_ma_folded_by_factor' end as reason from p""")


watch_views("", "bar_cards")
bar_cards_view("bar_cards_h", "bars_h")
view("frozen_from", "select symbol, min(ex_date) as frozen_from from open_freeze_rows group by 1")
view("live_days", """
select b.* from bar_cards_h b left join frozen_from f using (symbol) where close_raw is not null and (frozen_from is null or trade_date < frozen_from)""")
watch_views("_l", "live_days")
view("watch_rows", """
select symbol, trade_date as observed_on, card_version_id, 'tier_proximity' as signal, state, state = 'active' as triggered, reason from prox_l
union all select symbol, trade_date, card_version_id, 'tier_triggered', state, state = 'triggered', reason from trig_l
union all select symbol, trade_date, card_version_id, 'falsification_breach', state, triggered, reason from fals_l
union all select symbol, trade_date, card_version_id, 'box_position', state, state in ('buy_zone', 'sell_zone', 'box_breached'), state from box_l
union all select symbol, trade_date, card_version_id, 'ma_comparison', state, false, reason from mac_l
union all select symbol, trade_date, card_version_id, 'daily_watch', case when close_raw is null then 'incomplete' else 'suspended' end, false,
  case when close_raw is null then 'missing_close_raw' else 'suspended_corporate_action' end
from bar_cards_h b left join frozen_from f using (symbol) where close_raw is null or trade_date >= frozen_from""")


def right_views(tag: str, bars: str, cards: str, where: str) -> None:
    view(f"rs_in{tag}", f"""
select *, case when n > 20 then avg(volume_adj) over (partition by symbol order by trade_date rows between 20 preceding and 1 preceding) end as vol_base
from (select symbol, trade_date, close_raw, low_raw, volume_raw/share_factor as volume_adj, row_number() over (partition by symbol order by trade_date) as n
  from {bars} where close_raw is not null and low_raw is not null and volume_raw is not null) x""")
    view(f"rs_days{tag}", f"""
select r.symbol, c.card_version_id, r.trade_date, row_number() over (partition by r.symbol, c.card_version_id order by r.trade_date) as k,
  coalesce(cast(close_raw as decimal(28,10)) >= trigger_level * 1.01 and volume_adj >= 1.5 * vol_base, false) as f_break,
  cast(close_raw as decimal(28,10)) <= trigger_level * 0.99 as f_fail,
  cast(low_raw as decimal(28,10)) <= trigger_level * 1.02 and cast(close_raw as decimal(28,10)) >= trigger_level * 0.99 as f_retest,
  cast(close_raw as decimal(28,10)) <= stop_level as f_stop
from rs_in{tag} r join {cards} c on c.symbol = r.symbol and r.trade_date >= c.effective_from and (c.effective_to is null or r.trade_date < c.effective_to)
left join frozen_from f on f.symbol = r.symbol where {where}""")
    view(f"rs_scan{tag}", f"""
select * from (with recursive s as (
  select distinct symbol, card_version_id, 0::bigint as k, 'idle' as st, 0 as waited, null::varchar as emitted, null::date as day from rs_days{tag}
  union all
  select d.symbol, d.card_version_id, d.k,
    case when s.st = 'idle' then case when d.f_break then 'wait' else 'idle' end
      when s.st = 'wait' then case when d.f_fail then 'idle' when d.f_retest then 'hold' when s.waited + 1 >= 10 then 'idle' else 'wait' end
      else case when d.f_stop then 'idle' else 'hold' end end,
    case when s.st = 'wait' and not d.f_fail and not d.f_retest then s.waited + 1 else 0 end,
    case when s.st = 'idle' then case when d.f_break then 'waiting_retest' end
      when s.st = 'wait' then case when d.f_fail then 'invalidated' when d.f_retest then 'confirmed' when s.waited + 1 >= 10 then 'expired' end
      else case when d.f_stop then 'stopped_out' else 'holding' end end, d.trade_date
  from s join rs_days{tag} d on d.symbol = s.symbol and d.card_version_id = s.card_version_id and d.k = s.k + 1) select * from s)""")
    view(f"rs_rows{tag}", f"""
select symbol, card_version_id, day as observed_on, emitted as state, emitted <> 'holding' as triggered,
  case emitted when 'waiting_retest' then 'breakout_with_volume' when 'invalidated' then 'close_below_invalidate_line' when 'confirmed' then 'retest_within_band_and_held'
    when 'expired' then 'no_qualified_retest_within_window' when 'stopped_out' then 'close_below_stop_level' else 'tracking' end as reason
from rs_scan{tag} where emitted is not null""")


right_views("", "daily_bars", "vcards", "true")
right_views("_h", "bars_h", "vcards", "frozen_from is null or r.trade_date < frozen_from")

view("acc_in", """
select *, case when i >= 20 then avg(volume) over (w rows between 20 preceding and 1 preceding) end as vol_base, lag(close) over w as prev_close,
  case when i >= 59 then min(close) over (w rows between 59 preceding and current row) end as low60,
  case when i >= 4 then avg(close) over (w rows between 4 preceding and current row) end as ma5,
  case when i >= 9 then avg(close) over (w rows between 9 preceding and current row) end as ma10,
  case when i >= 19 then avg(close) over (w rows between 19 preceding and current row) end as ma20
from adj window w as (partition by symbol order by i)""")
view("acc_days", """
select *, case when prev_close is null or low60 is null then 'insufficient_history' when prev_close <= 0 then 'invalid_prev_close'
    when close/prev_close - 1.0 <= -0.05 and volume >= 2*vol_base and close <= low60 then 'condition_met' else 'condition_not_met' end as bd,
  coalesce((high - low)/prev_close >= 0.03 and (high - greatest(open, close))/nullif(high - low, 0) >= 0.5 and volume >= 1.5*vol_base, false) as is_probe,
  (greatest(ma5, ma10, ma20) - least(ma5, ma10, ma20))/ma20 as spread, ma20 is null as no_ma from acc_in""")
view("acc_scan", """
select * from (with recursive s as (
  select distinct symbol, -1::bigint as i, null::date as day, 'idle' as st, null::varchar as reason, false as trig, 0 as since, 0 as held, 0 as probes, null::double as base, null::double as c0,
    null::double as lo, null::double as hi, null::double as clo, null::double as chi, 0.0::double as vs, null::double as b0, null::double as b1 from acc_days
  union all
  select symbol, i, trade_date,
    case when p = 'idle' then case when bd = 'condition_met' then 'watching' else 'idle' end
      when p = 'watching' then case when since1 > 120 then 'failed' when not falling and since1 >= 10 and quiet = 'condition_met' then 'consolidating' else 'watching' end
      else case when close < b0 then 'failed' when brk then 'confirmed' when held1 > 120 then 'failed' else 'consolidating' end end,
    case when p = 'idle' then case when bd = 'condition_met' then 'breakdown_detected' else bd end
      when p = 'watching' then case when since1 > 120 then 'expired_no_consolidation' when falling then 'still_falling' when since1 < 10 then 'waiting_min_days'
        when quiet = 'condition_met' then 'consolidation_confirmed' else quiet end
      else case when close < b0 then 'box_broken' when brk then 'breakout_confirmed' when held1 > 120 then 'expired_consolidation' when is_probe then 'probe_detected' else 'holding' end end,
    case when p = 'idle' then bd = 'condition_met'
      when p = 'watching' then since1 > 120 or (not falling and since1 >= 10 and quiet = 'condition_met')
      else close < b0 or brk or held1 > 120 end,
    case when p = 'watching' then since1 else 0 end, case when p = 'consolidating' then held1 else 0 end,
    case when p = 'consolidating' then probes + is_probe::int else 0 end,
    case when p = 'idle' then vol_base else base end, case when p = 'idle' then close else c0 end,
    case when p = 'watching' then lo1 end, case when p = 'watching' then hi1 end, case when p = 'watching' then clo1 end, case when p = 'watching' then chi1 end,
    case when p = 'watching' then vs1 else 0.0 end,
    case when p = 'consolidating' then b0 when p = 'watching' and since1 <= 120 and not falling and since1 >= 10 and quiet = 'condition_met' then clo1 end,
    case when p = 'consolidating' then b1 when p = 'watching' and since1 <= 120 and not falling and since1 >= 10 and quiet = 'condition_met' then chi1 end
  from (select *, coalesce(close < c0*(1 - 0.03::double), false) as falling,
      case when no_ma then 'missing_ma' when lo1 > 0 and (hi1 - lo1)/lo1 <= 0.15::double and vs1/since1 <= 0.8::double*base and spread <= 0.05::double then 'condition_met' else 'condition_not_met' end as quiet,
      coalesce(close > b1 and close > open and volume >= 1.5*vol_base, false) as brk
    from (select d.symbol, d.i, d.trade_date, d.close, d.open, d.volume, d.vol_base, d.bd, d.is_probe, d.spread, d.no_ma,
        case when s.st in ('failed', 'confirmed') then 'idle' else s.st end as p, s.since + 1 as since1, s.held + 1 as held1, s.probes, s.base, s.c0,
        least(s.lo, d.low) as lo1, greatest(s.hi, d.high) as hi1, least(s.clo, d.close) as clo1, greatest(s.chi, d.close) as chi1, s.vs + d.volume as vs1, s.b0, s.b1
      from s join acc_days d on d.symbol = s.symbol and d.i = s.i + 1) x) y) select * from s where i >= 0)""")
