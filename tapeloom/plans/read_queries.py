"""Read queries, reports and screens."""
from pyspark.sql import functions as F

from tapeloom.functions.columns import r
from tapeloom.operators import daily_watch as dw, events as ev, exhaustion as ex, indicators, quality as q, reads, reports, screens, valuation as v
from tapeloom.plans.bar_queries import BOLL_SQL, CHG_SQL, roll_sql, rounded
from tapeloom.plans.event_queries import study
from tapeloom.plans.market import mark
from tapeloom.plans.registry import query, view
from tapeloom.plans.valuation_queries import pe

BRANDS = [f"Brand#{i}" for i in range(1, 26)]


@query("flagship_latest_indicators", f"""
with x as (select *, {roll_sql('avg', 'close', 20)} as ma20, {roll_sql('avg', 'close', 60)} as ma60, {CHG_SQL} from adj),
b as (select symbol, trade_date, mid + 2*sd as up, mid - 2*sd as lo from ({BOLL_SQL}) y)
select symbol, trade_date::varchar as trade_date, round(close, 7) as close, round(ma20, 4) as ma20, round(ma60, 4) as ma60, pct_chg, round(up, 4) as boll_upper, round(lo, 4) as boll_lower
from x join b using (symbol, trade_date) qualify row_number() over (partition by symbol order by trade_date desc) = 1""", shared=False)
def _(m):
    x = indicators.change_amp(indicators.boll(indicators.sma(m.adj, windows=(20, 60))))
    cols = ["trade_date", "close", "ma20", "ma60", "pct_chg", "boll_upper", "boll_lower"]
    return rounded(reads.latest(x, "symbol", "trade_date", cols), ["symbol", "trade_date"], close=7, ma20=4, ma60=4, pct_chg=6, boll_upper=4, boll_lower=4)


view("runs", """
select event_id as run_key, 'run_' || user_id as run_id, 'symbol:' || symbol as stage, case event_type when 'click' then 'degraded' when 'error' then 'failed' when 'signup' then 'running' else 'success' end as status,
  case when event_type = 'error' then 'boom ' || floor(value)::int end as error, ts as started_at, case when event_type <> 'signup' then ts + to_microseconds((round(value * 100)::bigint) * 10000) end as finished_at, symbol from (
  select a.*, e.user_id from announcements a join events e using (event_id)) z""")
view("dayf", """
select symbol, trade_date as observed_on, card_version_id, 'falsification_breach' as signal, state, triggered from fals
union all select symbol, trade_date, card_version_id, 'box_position', state, state in ('buy_zone', 'sell_zone', 'box_breached') from box
union all select symbol, observed_on, card_version_id, 'right_side', state, triggered from rs_rows""")
view("last_bars", "select * from daily_bars qualify row_number() over (partition by symbol order by trade_date desc) = 1")
view("recent_n", """
select f.symbol, count(*) as n from dayf f join (select symbol, min(trade_date) as d from (select symbol, trade_date, row_number() over (partition by symbol order by trade_date desc) as k from daily_bars) x where k <= 5 group by 1) s
  on s.symbol = f.symbol and f.observed_on >= s.d where triggered group by 1""")
view("stock_rows", f"""
with c as (select symbol, trade_date, {CHG_SQL} from adj),
r as (select symbol, status from runs qualify row_number() over (partition by symbol order by started_at desc, run_key desc) = 1),
k as (select * from vcards where status = 'active')
select w.symbol, w.market, w.name, b.trade_date, b.close_raw, b.volume_raw, c.pct_chg, p.pe_ttm, p.pe_status_full as pe_status, k.card_version_id as active_card_id, coalesce(n.n, 0) as signal_count, r.status as last_run_status,
  case when t1_low::double <= b.close_raw and b.close_raw <= t1_high::double then 1 when t2_low::double <= b.close_raw and b.close_raw <= t2_high::double then 2 end as in_tier,
  case when b.close_raw::decimal(28,10) < box_invalidation then 'box_breached' when b.close_raw::decimal(28,10) > box_high then 'above_box' when b.close_raw::decimal(28,10) between sell_zone_low and sell_zone_high then 'sell_zone'
    when b.close_raw::decimal(28,10) between buy_zone_low and buy_zone_high then 'buy_zone' when b.close_raw::decimal(28,10) < box_low then 'below_box' else 'mid_box' end as box_state
from watchlist w left join last_bars b using (symbol) left join c on c.symbol = w.symbol and c.trade_date = b.trade_date left join pe_days p on p.symbol = w.symbol and p.trade_date = b.trade_date
left join k on k.symbol = w.symbol left join recent_n n on n.symbol = w.symbol left join r on r.symbol = w.symbol""")
STOCK = "symbol, market, name, trade_date::varchar as trade_date, round(close_raw, 7) as close_raw, pct_chg, round(pe_ttm, 6) as pe_ttm, pe_status, active_card_id, signal_count, last_run_status, in_tier, box_state"


def stocks(m, filters=None):
    ind = indicators.change_amp(m.adj)
    return reads.stock_list(m.watchlist, m.daily_bars, ind, pe(m), m.vcards, m.day_facts, m.runs, filters)


def stock_cols(x):
    return rounded(x, ["symbol", "market", "name", "trade_date", "pe_status", "active_card_id", "signal_count", "last_run_status", "in_tier", "box_state"], close_raw=7, pct_chg=6, pe_ttm=6)


@query("q01_stock_list", f"select {STOCK} from stock_rows order by pct_chg desc nulls last limit 50")
def _(m):
    return stock_cols(reads.paged(stocks(m), "pct_chg", False, 1, 50, "symbol"))


@query("q01_stock_list_filtered", f"""
select {STOCK} from stock_rows where market = 'CN' and (contains(symbol, '2') or contains(name, '2') or contains('alias' || substring(symbol, 7), '2')) and volume_raw >= 5 and pct_chg <= 5000
  and (pe_status = '' or pe_status like 'ok%' or pe_status like '%degraded%') and active_card_id is not null""")
def _(m):
    return stock_cols(stocks(m, {"market": ["CN"], "q": "2", "volume_min": 5, "pct_chg_max": 5000, "pe_status": ["ok", "degraded"], "has_active_card": True}))


@query("q02_search", "select symbol, market, name from watchlist where contains(symbol, '1') or contains(name, '1') or contains(alias, '1') order by symbol limit 10")
def _(m):
    return reads.search(m.watchlist, "1", 10)


@query("q03_stock_overview", """
with s as (select symbol, string_agg(signal || '=' || state, ';' order by signal) as signals from (select * from dayf qualify row_number() over (partition by symbol, signal order by observed_on desc) = 1) x group by 1)
select r.symbol, r.trade_date::varchar as trade_date, round(r.pct_chg, 6) as pct_chg, r.in_tier, r.box_state, s.signals, y.annual_np from stock_rows r left join s using (symbol)
left join (select symbol, round(np::double/1e8, 2) as annual_np from rep_yoy where period_type = 'annual' qualify row_number() over (partition by symbol order by period_end desc) = 1) y using (symbol)""")
def _(m):
    x = reads.stock_overview(m.watchlist, m.daily_bars, indicators.change_amp(m.adj), pe(m), m.vcards, m.day_facts, v.fundamental_panel(m.rep, m.forecasts))
    sig = F.array_join(F.transform(F.array_sort(F.map_entries("signals")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return x.select("symbol", "trade_date", r("pct_chg", 6).alias("pct_chg"), "in_tier", "box_state", sig.alias("signals"), "annual_np")


@query("q04_latest_signals", """
select symbol, signal, observed_on::varchar as observed_on, state, triggered from dayf qualify row_number() over (partition by symbol, signal order by observed_on desc) = 1""")
def _(m):
    return reads.latest_signals(m.day_facts)


@query("q04_exhaustion_summary", """
select symbol, observed_on::varchar as observed_on, count(*) filter (state = 'active') as active, count(*) as total, max(anchor_id) as anchor_id from exh_facts f
where observed_on = (select max(observed_on) from exh_facts g where g.symbol = f.symbol) group by 1, 2""")
def _(m):
    return reads.exhaustion_summary(m.weekly_facts)


@query("q05_signal_events", """
with p as (select *, lag(state) over (partition by symbol, signal order by observed_on) as prev from dayf), e as (select * from p where triggered or prev is distinct from state),
r as (select *, row_number() over (partition by symbol order by observed_on desc, signal desc) as rank, count(*) over (partition by symbol) as total from e)
select symbol, observed_on::varchar as observed_on, signal, state, triggered, rank::int as rank, total from r where rank > 20 and rank <= 60""")
def _(m):
    return reads.signal_events(m.day_facts, limit=40, offset=20).select("symbol", "observed_on", "signal", "state", "triggered", "rank", "total")


BARS = dict(open=7, high=7, low=7, close=7, volume=4, amount=2)


@query("q06_bars_daily", """
select symbol, trade_date::varchar as trade_date, round(open, 7) as open, round(high, 7) as high, round(low, 7) as low, round(close, 7) as close, round(volume, 4) as volume, round(amount, 2) as amount
from adj where trade_date between date '1996-01-01' and date '2000-12-31'""", shared=False)
def _(m):
    return rounded(reads.bars_view(m.daily_bars, "fully_adjusted", "1996-01-01", "2000-12-31"), ["symbol", "trade_date"], **BARS)


@query("q06_bars_raw", """
select symbol, trade_date::varchar as trade_date, round(open_raw, 7) as open, round(high_raw, 7) as high, round(low_raw, 7) as low, round(close_raw, 7) as close, volume_raw as volume, round(amount_raw, 2) as amount from daily_bars""", shared=False)
def _(m):
    return rounded(reads.bars_view(m.daily_bars), ["symbol", "trade_date"], **BARS)


view("ind_small", f"""
select symbol, trade_date, {roll_sql('avg', 'close', 20)} as ma20, {roll_sql('avg', 'volume', 5)} as vol_ma5 from adj""")


@query("q07_indicators", """
select i.symbol, i.trade_date::varchar as trade_date, round(ma20 / price_adj_factor, 4) as ma20, round(vol_ma5, 4) as vol_ma5 from ind_small i join daily_bars using (symbol, trade_date)""")
def _(m):
    ind = indicators.volume_stats(indicators.sma(m.adj, windows=(20,)))
    return rounded(reads.indicators_view(ind, m.daily_bars, ["ma20", "vol_ma5"]), ["symbol", "trade_date"], ma20=4, vol_ma5=4)


WIDE = lambda field, col: ", ".join(f"max(case when symbol = '{b}' then {col} end) as \"{b}\"" for b in BRANDS)


@query("q08_align", f"""
with l as (select symbol, trade_date, 'ma20' as field, round(ma20, 4) as value from ind_small union all select symbol, trade_date, 'vol_ma5', round(vol_ma5, 4) from ind_small)
select field, trade_date::varchar as trade_date, {WIDE('', 'value')} from l where value is not null group by 1, 2""", shared=False)
def _(m):
    ind = rounded(indicators.volume_stats(indicators.sma(m.adj, windows=(20,))), ["symbol", "trade_date"], ma20=4, vol_ma5=4)
    return reads.align(ind, ["ma20", "vol_ma5"], BRANDS)


@query("q09_compare", f"""
select trade_date::varchar as trade_date, {WIDE('', 'round(close, 7)')} from adj where trade_date in (select trade_date from adj where symbol = 'Brand#1') group by 1""")
def _(m):
    return reads.compare(m.adj.withColumn("close", F.round("close", 7)), BRANDS, "close")


@query("q10_signal_list", """
select f.symbol, f.observed_on::varchar as observed_on, f.signal, f.state, f.anchor_id, a.trade_date::varchar as anchor_date, round(a.adjusted_price, 7) as anchor_price
from exh_facts f left join anchor_rows a on a.symbol = f.symbol and a.anchor_type = 'panic_low' and substring(sha256(a.symbol || '|panic_low|' || a.trade_date::varchar || '|' || a.is_fallback::varchar), 1, 16) = f.anchor_id
where f.signal in ('panic', 'dry_up', 'duration') and f.state = 'active' and f.observed_on between date '1996-01-01' and date '2001-06-30'""")
def _(m):
    x = reads.signal_list(m.weekly_facts, m.anchor_rows, {"signals": ["panic", "dry_up", "duration"], "states": ["active"], "start": "1996-01-01", "end": "2001-06-30"})
    return x.select("symbol", "observed_on", "signal", "state", "anchor_id", "anchor_date", r("anchor_price", 7).alias("anchor_price"))


@query("q11_card_list", """
select c.symbol, card_version_id, status, effective_from::varchar as effective_from, effective_to::varchar as effective_to, name from vcards c left join watchlist using (symbol)
where (effective_to is null or effective_to >= date '1999-06-01') and effective_from <= date '1999-12-31'""")
def _(m):
    return reads.card_list(m.vcards, m.watchlist, start="1999-06-01", end="1999-12-31").select("symbol", "card_version_id", "status", "effective_from", "effective_to", "name")


@query("q11_card_chain", """
with v as (select symbol || '/' || fiscal_year as id, case when lag(fiscal_year) over (partition by symbol order by fiscal_year) is not null then symbol || '/' || lag(fiscal_year) over (partition by symbol order by fiscal_year) end as prev,
  symbol, fiscal_year from (select distinct symbol, fiscal_year from reports) x)
select a.id as card_version_id, string_agg(b.id, ' > ' order by b.fiscal_year desc) as chain, count(*)::int as depth from v a join v b on b.symbol = a.symbol and b.fiscal_year <= a.fiscal_year group by 1""")
def _(m):
    from pyspark.sql import Window
    x = m.reports.select("symbol", "fiscal_year").distinct().withColumn("p", F.lag("fiscal_year").over(Window.partitionBy("symbol").orderBy("fiscal_year")))
    ids = lambda c: F.concat("symbol", F.lit("/"), F.col(c).cast("string"))
    chain = reads.card_chain(x.select(ids("fiscal_year").alias("card_version_id"), ids("p").alias("supersedes_id")))
    return chain.select("card_version_id", F.array_join("chain", " > ").alias("chain"), F.size("chain").alias("depth"))


@query("q12_executions", "select execution_id, symbol, strftime(executed_at, '%Y-%m-%d %H:%M:%S') as executed_at from executions where executed_at >= timestamp '1996-03-01' and executed_at < timestamp '2000-07-01'")
def _(m):
    return reads.executions_between(m.executions, "1996-03-01", "2000-06-30").select("execution_id", "symbol", "executed_at")


@query("q13_runs", """
select run_key, run_id, stage, status, round(epoch(finished_at) - epoch(started_at), 2) as duration_sec from runs where contains(run_id, '1') and contains(stage, 'Brand#2') and status in ('success', 'failed', 'running')
  and started_at >= timestamp '2024-01-03' and started_at < timestamp '2024-01-26'""")
def _(m):
    x = reads.run_list(m.runs, "1", "Brand#2", ["success", "failed", "running"], "2024-01-03", "2024-01-25")
    return x.select("run_key", "run_id", "stage", "status", "duration_sec")


@query("q14_lookups", """
select 'trading_date' as kind, trade_date::varchar as key, null::double as value from trading_calendar where trade_date between date '1997-01-01' and date '1999-12-31'
union all select 'latest_date', market || ':' || max(trade_date)::varchar, null from trading_calendar group by market
union all select 'benchmark', trade_date::varchar, round(close, 4) from index_bars where trade_date between date '1997-01-01' and date '1999-12-31'
union all select distinct 'card_status', status, null::double from vcards union all select distinct 'market', market, null::double from watchlist union all select distinct 'run', run_id, null::double from runs""")
def _(m):
    return reads.lookups(m.trading_calendar, m.index_bars, m.vcards, m.watchlist, m.runs, "1997-01-01", "1999-12-31")


@query("q15_dashboard", """
select 'total_stocks' as name, count(*) as value from watchlist
union all select 'stocks_with_data_today', count(distinct symbol) from daily_bars where trade_date = (select max(trade_date) from daily_bars)
union all select 'stocks_with_active_card', count(distinct symbol) from vcards where status = 'active'
union all select 'stocks_with_signal_today', count(distinct symbol) from dayf where triggered and observed_on = (select max(observed_on) from dayf where triggered)
union all select 'runs_' || status, count(*) from runs where status in ('success', 'degraded', 'failed', 'running') group by status""")
def _(m):
    return reads.dashboard(m.watchlist, m.daily_bars, m.vcards, m.day_facts, m.runs)


@query("q16_alerts", """
select * from (select symbol, 'run_' || status as type, coalesce(error, stage) as message from runs where status in ('failed', 'degraded') order by started_at desc, run_key desc limit 20) a
union all select * from (select symbol, 'signal_incomplete', signal || ' ' || observed_on::varchar from watch_rows where state = 'incomplete' order by observed_on desc, symbol, signal limit 20) b
union all select symbol, 'pe_status', pe_status_full from pe_days qualify row_number() over (partition by symbol order by trade_date desc) = 1
union all select symbol, 'suspended', trade_date::varchar from last_bars where (cast(substring(symbol, 7) as int) * 37 + date_diff('day', date '1970-01-01', trade_date) * 11) % 100 < 30
union all select symbol, 'review_due', next_review_at::varchar from vcards where status = 'active' and next_review_at <= date '2000-04-30'
union all select symbol, 'calendar', note from event_calendar where scheduled_date >= date '2000-04-30' and scheduled_date <= date '2000-04-30' + remind""")
def _(m):
    from tapeloom.operators import cards
    from tapeloom.operators.cards import cards_asof
    ma = indicators.sma(m.adj, windows=(20, 60)).select("symbol", "trade_date", "ma20", "ma60")
    watch = dw.daily_watch(cards_asof(m.bars_h, m.vcards), ma, ex.active_counts(m.weekly_facts), m.weeks, m.open_freezes)
    bars = m.daily_bars.withColumn("trading_status", F.when(mark() < 30, "suspended").otherwise("trading"))
    due = ev.due_items(m.event_calendar, m.vcards, "2000-04-30")
    return reads.alerts(m.runs, watch, pe(m), bars, m.vcards, due, "2000-04-30")


@query("q17_run_trend", """
with d as (select unnest(generate_series(date '2024-01-14', date '2024-01-20', interval 1 day))::date as day)
select d.day::varchar as day, count(*) filter (status = 'success') as success, count(*) filter (status = 'degraded') as degraded, count(*) filter (status = 'failed') as failed, count(*) filter (status = 'running') as other
from d left join runs r on r.started_at::date = d.day group by 1""")
def _(m):
    return reads.run_trend(m.runs, "2024-01-20")


# ------------------------------------------------------------------------------------------- reports

AS_OF = "1999-08-20"
DIST = lambda n: f"case when not (t{n}_low <= dc and dc <= t{n}_high) then abs(close_raw - (case when dc < t{n}_low then t{n}_low else t{n}_high end)::double)/(case when dc < t{n}_low then t{n}_low else t{n}_high end)::double end"
view("day_state", f"""
with f as (select * from dayf where observed_on <= date '{AS_OF}'
  union all select symbol, trade_date, card_version_id, 'tier_triggered', case when t1_low <= dc and dc <= t1_high then 'triggered' when t2_low <= dc and dc <= t2_high then 'pending_signals' else 'inactive' end, t1_low <= dc and dc <= t1_high from bar_cards where trade_date <= date '{AS_OF}'),
l as (select * from f qualify row_number() over (partition by symbol, signal order by observed_on desc) = 1),
s as (select symbol, {', '.join(f"max(case when signal = '{k}' then {c} end) as {k[:4]}_{c[:3]}" for k in ('tier_triggered', 'falsification_breach', 'box_position', 'right_side') for c in ('observed_on', 'state', 'triggered'))} from l group by 1),
p as (select symbol, trade_date as prox_on, p.state as prox_state, least(coalesce({DIST(1)}, 1e18), coalesce({DIST(2)}, 1e18)) as d from prox p join bar_cards b using (symbol, trade_date, card_version_id) where trade_date <= date '{AS_OF}'
  qualify row_number() over (partition by symbol order by trade_date desc) = 1),
g as (select w.symbol, case when b.symbol is not null then 'trading_with_bars' when i.trade_date is not null then 'suspended' else 'source_missing' end as gate from watchlist w left join daily_bars b on b.symbol = w.symbol and b.trade_date = date '{AS_OF}' left join index_h i on i.trade_date = date '{AS_OF}'),
c as (select symbol, card_version_id, next_review_at from vcards where effective_from <= date '{AS_OF}' and (effective_to is null or effective_to > date '{AS_OF}')),
z as (select symbol, count(*) as n from open_freeze_rows where ex_date <= date '{AS_OF}' group by 1), y as (select symbol, count(*) as n from corporate_actions where action_type = 'split' and ex_date <= date '{AS_OF}' group by 1),
o as (select symbol, count(*) as n from (select distinct symbol, observed_on, state from rs_rows where state in ('confirmed', 'stopped_out') and observed_on between date '{AS_OF}' - 10 and date '{AS_OF}') x
  where not exists (select 1 from executions e where e.symbol = x.symbol and e.executed_at::date >= x.observed_on) group by 1)
select g.symbol, gate, c.card_version_id, coalesce(z.n, 0) as fz, coalesce(y.n, 0) as dr, coalesce(o.n, 0) as fo, coalesce(c.next_review_at < date '{AS_OF}', false) as overdue, coalesce(fals_sta = 'active', false) as broken,
  coalesce(tier_obs = date '{AS_OF}' and tier_tri, false) as tier_now, coalesce(tier_obs = date '{AS_OF}' and tier_sta = 'pending_signals', false) as tier_wait, case when righ_obs = date '{AS_OF}' then righ_sta end as right_now,
  case when box__obs = date '{AS_OF}' and box__tri then box__sta end as box_now, coalesce(prox_on = date '{AS_OF}' and prox_state = 'active', false) as near_now, case when d < 1e17 then d end as d
from g left join s using (symbol) left join p using (symbol) left join c using (symbol) left join z using (symbol) left join y using (symbol) left join o using (symbol)""")


def day_state(m):
    x = dw._zones(m.bar_cards)
    dist = F.array_min(F.transform(F.filter("zones", lambda t: ~t["inside"]), lambda t: F.abs(F.col("close_raw") - t["bound"].cast("double")) / t["bound"].cast("double")))
    prox = dw.tier_proximity(m.bar_cards).select("symbol", "trade_date", "prox_state", "card_version_id").join(
        x.select("symbol", "trade_date", dist.alias("min_dist")), ["symbol", "trade_date"])
    tiers = x.select("symbol", F.col("trade_date").alias("observed_on"), "card_version_id", F.lit("tier_triggered").alias("signal"),
                     F.when(F.exists("zones", lambda t: t["inside"] & (t["tier"] == 1)), "triggered").when(F.exists("zones", lambda t: t["inside"]), "pending_signals").otherwise("inactive").alias("state"))
    facts = m.day_facts.unionByName(tiers.withColumn("triggered", F.col("state") == "triggered"))
    day = F.lit(AS_OF).cast("date")
    pairs = m.watchlist.select("symbol", day.alias("trade_date"), F.lit("CN").alias("market"))
    gate = q.day_status(pairs, m.full_cal, m.daily_bars, m.index_h)
    card = m.vcards.where((F.col("effective_from") <= day) & (F.col("effective_to").isNull() | (F.col("effective_to") > day)))
    splits = m.corporate_actions.where("action_type = 'split'")
    follow = reports.followups(m.day_facts, m.executions, AS_OF)
    return reports.state_of_day(m.watchlist, gate, facts, prox, card, m.open_freezes.where(F.col("ex_date") <= day), splits.where(F.col("ex_date") <= day), follow, AS_OF)


@query("n01_report_priority", """
select symbol, case when gate in ('source_missing', 'suspended') or card_version_id is null then 'degraded' else 'complete' end as status,
  case when gate in ('source_missing', 'suspended') then 1 when fz > 0 or dr > 0 or broken or overdue or coalesce(right_now, '') = 'stopped_out' then 2
    when tier_now or coalesce(right_now, '') in ('confirmed', 'invalidated') or box_now is not null then 3 when near_now or fo > 0 then 4 else 5 end as priority, round(d, 6) as distance, card_version_id from day_state""")
def _(m):
    return rounded(reports.report_priority(day_state(m)), ["symbol", "status", "priority", "card_version_id"], distance=6)


@query("n02_decision_points", """
select symbol, kind from (select symbol, unnest([case when fz > 0 then 'frozen' end, case when dr > 0 then 'draft_pending' end, case when overdue then 'review_overdue' end, case when broken then 'falsified' end, case when tier_now then 'tier_triggered' end,
  case when tier_wait then 'tier_pending' end, case when right_now in ('confirmed', 'invalidated', 'expired', 'stopped_out', 'holding') then 'right_side_' || right_now end, case when box_now is not null then 'box_' || box_now end, case when fo > 0 then 'follow_up' end]) as kind from day_state) x where kind is not null""")
def _(m):
    return reports.decision_points(day_state(m))


@query("n03_followups", """
select distinct x.symbol, observed_on::varchar as observed_on, state from rs_rows x where state in ('confirmed', 'stopped_out') and observed_on between date '2000-01-01' and date '2001-06-30'
  and not exists (select 1 from executions e where e.symbol = x.symbol and e.executed_at::date >= x.observed_on)""")
def _(m):
    return reports.followups(m.day_facts, m.executions, "2001-06-30", 546)


@query("n04_draft_queue", "select symbol, count(*) as drafts, min(ca_id) as first_ca from classified where channel <> 'fastlane' group by 1")
def _(m):
    from tapeloom.operators import cards
    from tapeloom.plans.card_queries import pending
    x = cards.classify_actions(pending(m), m.bars_h)
    return reports.draft_queue(x.withColumn("status", F.when(F.col("channel") == "fastlane", "active").otherwise("draft")))


@query("n04_study_counts", "select symbol, status, count(*) as n, count(*) filter (t1_mark = 'pending' or t5_mark = 'pending') as pending from study group by 1, 2")
def _(m):
    return reports.study_counts(study(m, m.study_events.select("event_id", "symbol", "a_date")))


view("report_runs", "select event_type as report_type, case when event_type <> 'view' then symbol end as symbol, a_date as trade_date, count(*)::int as revision from announcements where event_type <> 'error' group by 1, 2, 3")


@query("n05_next_revision", """
select w.report_type, w.symbol, w.trade_date::varchar as trade_date, (coalesce(max(r.revision), 0) + 1)::int as revision from (select distinct event_type as report_type, case when event_type <> 'view' then symbol end as symbol, a_date as trade_date from announcements) w
left join report_runs r on r.report_type = w.report_type and r.symbol is not distinct from w.symbol and r.trade_date = w.trade_date group by 1, 2, 3""")
def _(m):
    k = [F.col("event_type").alias("report_type"), F.when(F.col("event_type") != "view", F.col("symbol")).alias("symbol"), F.col("a_date").alias("trade_date")]
    have = m.announcements.where("event_type <> 'error'").groupBy(*k).agg(F.count("*").cast("int").alias("revision"))
    return reports.next_revision(m.announcements.select(*k).distinct(), have)


@query("n06_card_inputs", """
select w.symbol, w.name, b.trade_date::varchar as cutoff, round(b.close_raw, 4) as close_raw, y.n as n_reports, q.n_days, e.active::int as active, c.card_version_id, 10 as sections
from watchlist w join last_bars b using (symbol) left join (select symbol, count(*)::int as n from rep_latest group by 1) y using (symbol) left join pe_quant q using (symbol)
left join (select symbol, count(*) filter (state = 'active') as active from exh_facts f where observed_on = (select max(observed_on) from exh_facts g where g.symbol = f.symbol) group by 1) e using (symbol)
left join (select * from vcards where status = 'active') c using (symbol)""")
def _(m):
    from tapeloom.plans.event_queries import exposure
    from tapeloom.operators import macro
    bar = reads.latest(m.daily_bars, "symbol", "trade_date", ["trade_date", "close_raw"])
    rep = v.yoy(v.latest_revisions(m.rep)).groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("period_end", "period_type", "revenue", "net_profit_attr", "net_profit_attr_yoy"))).alias("reports"))
    pes = pe(m)
    fac = macro.factor_snapshot(bar.select("symbol", F.col("trade_date").alias("as_of")), exposure(m), m.macro_factors, m.cn_spine).groupBy("symbol").agg(
        F.collect_list(F.struct("code", "status", "close")).alias("factors"))
    weekly = m.weekly_facts
    last_week = reads.exhaustion_summary(weekly)
    doc = reports.card_inputs({
        "meta": m.watchlist.select("symbol", "name", "market").join(bar.select("symbol", F.col("trade_date").alias("data_cutoff")), "symbol"), "earnings": rep,
        "forecasts": v.forecast_gap(m.forecasts, m.rep), "factor_snapshot": fac, "valuation_scale": v.pe_quantiles(pes),
        "market_snapshot": bar.join(reads.latest(pes, "symbol", "trade_date", ["pe_ttm", "pe_status_full"]), "symbol"),
        "exhaustion_params": reports.exhaustion_params(m.anchor_rows, m.weeks), "signal_status": last_week,
        "daily_watch": m.vcards.where("status = 'active'").select("symbol", "card_version_id", "effective_from", "tiers", "invalidation_line"),
        "config_params": m.symbols.withColumn("rule_version", F.lit("v1"))})
    g = lambda p: F.get_json_object("document", f"$.{p}")
    d = F.from_json("document", "map<string,string>")
    return doc.select("symbol", g("meta.name").alias("name"), g("meta.data_cutoff").alias("cutoff"), F.round(g("market_snapshot.close_raw").cast("double"), 4).alias("close_raw"),
                      F.size(F.from_json(g("earnings.reports"), "array<struct<period_end:date>>")).alias("n_reports"), g("valuation_scale.n_days").cast("long").alias("n_days"),
                      g("signal_status.active").cast("int").alias("active"), g("daily_watch.card_version_id").alias("card_version_id"), F.lit(10).alias("sections")).where(d.isNotNull())


@query("n07_exhaustion_params", """
with l as (select symbol, max(as_of) as as_of from anchor_rows group by 1),
a as (select r.symbol, r.as_of, max(case when anchor_type = 'panic_low' then raw_price end) as prev_low_raw, max(case when anchor_type = 'decline_start' then trade_date end) as dw from anchor_rows r join l using (symbol, as_of) group by 1, 2),
b as (select symbol, week_end_date as dw, case when count(*) over n = 4 then avg(volume) over n end as mv from weeks window n as (partition by symbol order by i rows between 1 following and 4 following))
select a.symbol, a.as_of::varchar as as_of, round(prev_low_raw, 7) as prev_low_raw, a.dw::varchar as decline_week, round(mv, 4) as mean_volume, round(mv*2, 4) as panic_volume_x2, round(mv*0.4::double, 4) as dryup_040,
  case when a.dw is null then 'no_decline_start' when mv is null then 'too_few_weeks' else 'ok' end as note from a left join b on b.symbol = a.symbol and b.dw = a.dw""")
def _(m):
    x = reports.exhaustion_params(m.anchor_rows, m.weeks)
    return rounded(x, ["symbol", "as_of", "decline_week", "note"], prev_low_raw=7, mean_volume=4, panic_volume_x2=4, dryup_040=4)


@query("n08_run_summary", """
select started_at::date::varchar as day, count(*) filter (status = 'success') as success, count(*) filter (status = 'degraded') as degraded, count(*) filter (status = 'failed') as failed, count(*) filter (status = 'running') as running,
  case when count(*) filter (status = 'failed') > 0 then 'failed' when count(*) filter (status = 'degraded') > 0 then 'degraded' else 'success' end as overall from runs group by 1""")
def _(m):
    return reports.run_summary(m.runs)


# ------------------------------------------------------------------------------------------- screens

PHRASES = ("净利润同比增长 55%~80%，订单饱满", "营业收入同比增长 120%", "预计净利润预亏，产能不足", "扭亏为盈，供需格局持续改善", "净利润变动比例区间为：30.5％—45％，需求旺盛", "产能利用率较高")
view("surge_docs", f"""
select doc_id, source as company, text || ' ' || case when doc_id % 25 = 0 then {list(PHRASES)!r}[((doc_id // 25) % 6 + 1)::int] else '' end as raw from documents""")
P1, P2, P3 = screens.GROWTH_PATTERNS
G = lambda w, i: f"regexp_extract({w}, '{(P1, P2, P3)[i]}', 1)"
LOW = lambda w: f"case when {G(w, 0)} <> '' then {G(w, 0)} when {G(w, 1)} <> '' then {G(w, 1)} when {G(w, 2)} <> '' then {G(w, 2)} end"
HIGH = lambda w: f"case when {G(w, 0)} <> '' then regexp_extract({w}, '{P1}', 2) when {G(w, 1)} <> '' then regexp_extract({w}, '{P2}', 2) when {G(w, 2)} <> '' then {G(w, 2)} end"


@query("z01_surge_screen", f"""
with n as (select *, translate(raw, '－—–~：％', '----:%') as t from surge_docs),
s as (select doc_id, company, t, unnest(range(1, len(string_split(t, '净利润')))) as k, string_split(t, '净利润') as parts from n),
w as (select doc_id, company, k, length(array_to_string(list_slice(parts, 1, k), '净利润')) as p0, t from s),
x as (select doc_id, company, k, substring(t, greatest(p0 - 60, 0) + 1, p0 + 200 - greatest(p0 - 60, 0)) as win from w),
h as (select company, {LOW('win')} as lo, {HIGH('win')} as hi, doc_id, k from x),
near as (select company, lo, hi from h where lo is not null qualify row_number() over (partition by company order by doc_id, k) = 1),
a as (select company, {LOW('t')} as lo, {HIGH('t')} as hi, doc_id from n), anyg as (select company, lo, hi from a where lo is not null qualify row_number() over (partition by company order by doc_id) = 1),
g as (select company, bool_or(contains(t, '净利润')) as mentions, bool_or(regexp_matches(raw, '{screens.LOSS_WORDS}')) as loss, bool_or(regexp_matches(raw, '{screens.TURN_WORDS}')) as turn,
  {', '.join(f"bool_or(regexp_matches(raw, '{p}')) as k{i}" for i, p in enumerate(screens.KEYWORD_GROUPS.values()))} from n group by 1),
j as (select g.*, concat_ws(',', {', '.join(f"case when k{i} then '{k}' end" for i, k in enumerate(screens.KEYWORD_GROUPS))}) as keywords, ({' + '.join(f'k{i}::int' for i in range(8))})::int as n_keywords, loss and not turn as excluded,
  try_cast(replace(case when mentions then near.lo else anyg.lo end, ',', '') as double) as growth_low, try_cast(replace(case when mentions then near.hi else anyg.hi end, ',', '') as double) as growth_high
  from g left join near using (company) left join anyg using (company))
select company, keywords, n_keywords, growth_low, growth_high, turn as turnaround, excluded, not excluded and (turn or coalesce(growth_low >= 50, false)) and n_keywords > 0 as qualified from j""")
def _(m):
    i = F.col("doc_id")
    phrase = F.when(i % 25 == 0, F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (F.floor(i / 25) % 6 + 1).cast("int"))).otherwise("")
    docs = m.table("documents").select(F.concat("source", F.lit("：notice")).alias("title"), i.alias("doc_order"), F.concat_ws(" ", "text", phrase).alias("text"))
    return screens.surge_screen(docs)


view("ev_in", """
select p_partkey as id, ['intraday', 'short', 'swing', 'long'][(p_partkey % 4 + 1)::int] as horizon, case when p_partkey % 11 = 0 then null else p_size % 7 - 3 end as technical, (p_partkey // 3) % 7 - 3 as volume, case when p_partkey % 5 = 0 then null else (p_size // 2) % 7 - 3 end as news,
  (p_partkey // 7) % 7 - 3 as macro, case when p_partkey % 3 = 0 then null else (p_partkey // 2) % 7 - 3 end as industry, case when p_partkey % 2 = 0 then null else p_size % 5 - 2 end as position,
  case when p_partkey % 6 <> 0 then p_retailprice end as entry, p_retailprice * case when p_partkey % 9 < 5 then 0.93::double else 1.06::double end as stop, p_retailprice * case when p_partkey % 9 < 5 or p_partkey % 13 = 0 then 1.17::double else 0.9::double end as target from part""")
DW = screens.HORIZON_WEIGHTS
WSQL = lambda i: "case horizon " + " ".join(f"when '{h}' then {w[i]}::double" for h, w in DW.items()) + " end"


@query("z02_ev_scores", f"""
with c as (select *, {' + '.join(f'case when {d} is not null then {WSQL(i)} else 0 end' for i, d in enumerate(screens.DIMS))} as comp, 0 as tot from ev_in),
z as (select *, {' + '.join(f'case when {d} is not null then ({WSQL(i)})/comp * {d} else 0 end' for i, d in enumerate(screens.DIMS))} as z, case when entry is null then null when target > entry and stop < entry then 'long' when target < entry and stop > entry then 'short' end as dir from c),
s as (select *, case when z >= 0.6::double then 'long' when z <= -0.6::double then 'short' else 'neutral' end as sug, case when entry is not null and dir is null then 'bad_prices' end as error from z),
p as (select *, case when error is null and sug <> 'neutral' then least(greatest(1/(1 + exp(-0.6 * case dir when 'long' then z when 'short' then -z else abs(z) end)), 0.3), 0.72) end as p, case when error is null then case dir when 'long' then (target - entry)/(entry - stop) when 'short' then (entry - target)/(stop - entry) end end as r from s),
e as (select *, p*r - (1 - p) as ev from p)
select id, sug as suggested, dir as direction, error, round(z, 6) as z, round(comp, 6) as completeness, round(p, 6) as win_rate, round(greatest(p - (0.05 + 0.1*(1 - comp)), 0.05), 6) as win_low, round(r, 6) as odds, round(ev, 6) as ev,
  round(case when p is not null and r is not null then least(greatest((p - (1 - p)/r)/4, 0), 0.25)*100 end, 6) as position_pct,
  case when ev >= 0.3 and p >= 0.6 and comp >= 0.999 then 'A' when ev >= 0.15 then 'B' when ev > 0 then 'C' when ev is not null then 'D' end as grade from (select *, case when p is null then null else 1 end as k from e) f""".replace("round(greatest(p - (0.05 + 0.1*(1 - comp)), 0.05), 6) as win_low", "case when p is not null then round(greatest(p - (0.05 + 0.1*(1 - comp)), 0.05), 6) end as win_low"))
def _(m):
    i, sz, px = F.col("p_partkey"), F.col("p_size"), F.col("p_retailprice")
    fl = lambda n: F.floor(i / n)
    d = lambda e: e.cast("int")
    x = m.table("part").select(
        i.alias("id"), F.element_at(F.array(*[F.lit(h) for h in DW]), (i % 4 + 1).cast("int")).alias("horizon"), d(F.when(i % 11 != 0, sz % 7 - 3)).alias("technical"), d(fl(3) % 7 - 3).alias("volume"),
        d(F.when(i % 5 != 0, F.floor(sz / 2) % 7 - 3)).alias("news"), d(fl(7) % 7 - 3).alias("macro"), d(F.when(i % 3 != 0, fl(2) % 7 - 3)).alias("industry"), d(F.when(i % 2 != 0, sz % 5 - 2)).alias("position"),
        F.when(i % 6 != 0, px).alias("entry"), (px * F.when(i % 9 < 5, 0.93).otherwise(1.06)).alias("stop"), (px * F.when((i % 9 < 5) | (i % 13 == 0), 1.17).otherwise(0.9)).alias("target"))
    return rounded(screens.ev_scores(x), ["id", "suggested", "direction", "error", "grade"], z=6, completeness=6, win_rate=6, win_low=6, odds=6, ev=6, position_pct=6)


view("sched_in", """
select p_partkey as id, p_retailprice/100 as e1, p_retailprice/100*0.9::double as e2, p_retailprice/100*0.8::double as e3, (18 + p_size % 5)::double as h, 15.0::double as b, (11 + p_size % 3)::double as l, p_retailprice * (0.06::double + (p_partkey % 17) * 0.006::double) as price, p_partkey % 4 as k from part""")


@query("z03_schedule", """
with z as (select id, price, e1*h as goal, e3*l as line, 1 as zone, e1*b*0.96::double as lo, e1*b as hi, 30 as split, 50.0 as win, k from sched_in union all select id, price, e1*h, e3*l, 2, e2*b*0.95::double, e2*b, 35, 60.0, k from sched_in
  union all select id, price, e1*h, e3*l, 3, e3*l, e3*l*1.08::double, 35, 65.0, k from sched_in),
y as (select *, (lo + hi)/2 as buy from z), x as (select *, case when buy - line > 0 then (goal - buy)/(buy - line) end as o from y),
w as (select *, case when k <> 0 then greatest(0, ((win/100)*o - (1 - win/100))/nullif(o, 0)/4)*100 end as kc from x)
select id, zone, round(lo, 6) as zone_low, round(hi, 6) as zone_high, round(line, 6) as line, round(o, 6) as odds, round(case when o is not null then kc end, 6) as kelly_cap, round(case when o is null or kc is null then split else least(split, kc) end, 6) as cap,
  case when price between lo and hi then 'inside' when price > hi then 'above' else 'below' end as position, round(case when price > hi then (price/hi - 1)*100 when price < lo then (1 - price/lo)*100 end, 6) as distance_pct from w""")
def _(m):
    px, sz, i = F.col("p_retailprice"), F.col("p_size"), F.col("p_partkey")
    lit = lambda x, n: F.lit(x).alias(n)
    win = lambda x, n: F.when(i % 4 != 0, F.lit(x)).alias(n)
    x = m.table("part").select(i.alias("id"), (px / 100).alias("eps_base"), (px / 100 * 0.9).alias("eps_bear"), (px / 100 * 0.8).alias("eps_worst"), (18 + sz % 5).cast("double").alias("pe_high"), lit(15.0, "pe_base"),
                               (11 + sz % 3).cast("double").alias("pe_low"), (px * (0.06 + (i % 17) * 0.006)).alias("price"), lit(30.0, "split_1"), lit(35.0, "split_2"), lit(35.0, "split_3"),
                               win(50.0, "win_1"), win(60.0, "win_2"), win(65.0, "win_3"))
    return rounded(screens.schedule(x), ["id", "zone", "position"], zone_low=6, zone_high=6, line=6, odds=6, kelly_cap=6, cap=6, distance_pct=6)


@query("z03_scenario_matrix", """
select id, e.n as eps, p.n as pe, round(case e.n when 'eps_base' then e1 when 'eps_bear' then e2 else e3 end * case p.n when 'pe_high' then h when 'pe_base' then b else l end, 6) as value
from sched_in cross join (values ('eps_base'), ('eps_bear'), ('eps_worst')) e(n) cross join (values ('pe_high'), ('pe_base'), ('pe_low')) p(n)""")
def _(m):
    px, sz, i = F.col("p_retailprice"), F.col("p_size"), F.col("p_partkey")
    x = m.table("part").select(i.alias("id"), (px / 100).alias("eps_base"), (px / 100 * 0.9).alias("eps_bear"), (px / 100 * 0.8).alias("eps_worst"), (18 + sz % 5).cast("double").alias("pe_high"), F.lit(15.0).alias("pe_base"), (11 + sz % 3).cast("double").alias("pe_low"))
    return screens.scenario_matrix(x).select("id", "c.eps", "c.pe", r("c.value", 6).alias("value"))
