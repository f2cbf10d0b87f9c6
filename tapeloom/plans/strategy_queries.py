"""Cross-section scores, target weights, timing flags, decision points and outcome statistics."""
from pyspark.sql import functions as F

from tapeloom.functions.columns import r
from tapeloom.operators import cross_section as cs, exhaustion as ex, outcomes as oc
from tapeloom.plans.bar_queries import rounded
from tapeloom.plans.market import mark
from tapeloom.plans.registry import query, view

FULL = lambda fn, col, n: f"case when count({col}) over (partition by symbol order by i rows between {n - 1} preceding and current row) = {n} then {fn}({col}) over (partition by symbol order by i rows between {n - 1} preceding and current row) end"
view("fac", f"""
select symbol, trade_date, close/lag(close, 20) over (partition by symbol order by i) - 1 as momentum, {FULL('stddev_pop', 'r', 20)} as volatility, {FULL('avg', 'amount', 20)} as liquidity
from (select *, close/lag(close) over (partition by symbol order by i) - 1 as r from adj) x""")
F3 = ("momentum", "volatility", "liquidity")
view("fac_ok", "select * from fac where momentum is not null and volatility is not null and liquidity is not null")
view("fac_clip", "select f.symbol, f.trade_date, " + ", ".join(
    f"least(greatest({k}, quantile_cont({k}, 0.05) over w), quantile_cont({k}, 0.95) over w) as c_{k}, stddev_pop({k}) over w as s_{k}" for k in F3) +
    ", count(*) over w as n from fac_ok f window w as (partition by trade_date)")
view("scores", "select symbol, trade_date, case when n >= 3 and greatest(s_momentum, s_volatility, s_liquidity) > 0 then " + " + ".join(
    f"case when s_{k} > 0 then {w} * (c_{k} - avg(c_{k}) over (partition by trade_date))/s_{k} else 0 end" for k, w in cs.WEIGHTS.items()) +
    " end as score, (" + " + ".join(f"case when n >= 3 and s_{k} > 0 then 0 else 1 end" for k in F3) + ")::int as neutral_factors from fac_clip")


@query("b01_symbol_factors", """
select symbol, trade_date::varchar as trade_date, round(momentum, 6) as momentum, round(volatility, 6) as volatility, round(liquidity, 4) as liquidity from fac""", shared=False)
def _(m):
    return rounded(cs.symbol_factors(m.adj), ["symbol", "trade_date"], momentum=6, volatility=6, liquidity=4)


def scores(m):
    return cs.factor_scores(cs.symbol_factors(m.adj))


@query("b02_factor_scores", "select symbol, trade_date::varchar as trade_date, round(score, 6) as score, neutral_factors from scores")
def _(m):
    return rounded(scores(m), ["symbol", "trade_date", "neutral_factors"], score=6)


@query("b03_score_coverage", """
select f.symbol, count(*) as days, count(score) as scored_days, min(case when score is not null then f.trade_date end)::varchar as first_score,
  max(case when score is not null then f.trade_date end)::varchar as last_score from fac f left join scores s using (symbol, trade_date) group by 1""")
def _(m):
    f = cs.symbol_factors(m.adj)
    return cs.score_coverage(f, cs.factor_scores(f))


view("score_days", """
select t.trade_date as as_of, (select max(trade_date) from scores s where s.score is not null and s.trade_date < t.trade_date) as score_date from trading_calendar t""")


@query("b04_score_asof", """
select d.as_of::varchar as as_of, d.score_date::varchar as score_date, s.symbol, round(s.score, 6) as score from score_days d join scores s on s.trade_date = d.score_date where s.score is not null""")
def _(m):
    return rounded(cs.score_asof(m.trading_calendar.select(F.col("trade_date").alias("as_of")), scores(m)), ["as_of", "score_date", "symbol"], score=6)


view("rebal", "select min(trade_date) as as_of from daily_bars group by date_trunc('week', trade_date)")


@query("b05_topn_weights", """
with x as (select d.as_of, s.symbol, row_number() over (partition by d.as_of order by s.score desc, s.symbol) as rank from score_days d join rebal using (as_of)
  join scores s on s.trade_date = d.score_date where s.score is not null)
select as_of::varchar as as_of, symbol, rank::int as rank, round(0.95/count(*) over (partition by as_of), 6) as weight from x where rank <= 5""")
def _(m):
    return rounded(cs.topn_weights(m.daily_bars, scores(m)), ["as_of", "symbol", "rank"], weight=6)


@query("b06_momentum_topn", """
with m as (select symbol, trade_date, close/b - 1 as mom from (select *, lag(close, 19) over (partition by symbol order by i) as b from adj) x where b > 0),
g as (select r.as_of, m.symbol, arg_max(mom, trade_date) as mom from rebal r join m on m.trade_date <= r.as_of group by 1, 2),
x as (select *, row_number() over (partition by as_of order by mom desc, symbol) as rank from g)
select as_of::varchar as as_of, symbol, rank::int as rank, round(0.95/count(*) over (partition by as_of), 6) as weight from x where rank <= 5""")
def _(m):
    return rounded(cs.momentum_topn(m.adj), ["as_of", "symbol", "rank"], weight=6)


@query("b07_dual_ma_signal", """
with x as (select symbol, trade_date, i, case when ma20 is not null then case when ma5 > ma20 then 0.95 when ma5 < ma20 then 0.0 end end as want from acc_in),
p as (select *, coalesce(last_value(want ignore nulls) over (partition by symbol order by i rows between unbounded preceding and current row), 0.0) as position from x),
q as (select *, coalesce(lag(position) over (partition by symbol order by i), 0.0) as b from p)
select symbol, trade_date::varchar as trade_date, position::double as position, case when position > b then 'enter' when position < b then 'exit' end as action from q""", shared=False)
def _(m):
    return cs.dual_ma_signal(m.adj)


@query("b08_eligible_universe", """
select w.symbol, count(b.symbol) as bars, count(b.symbol) >= 1100 as eligible, case when count(b.symbol) = 0 then 'no_data' when count(b.symbol) < 1100 then 'too_few_bars' end as reason
from (select distinct p_brand as symbol from part union select 'Brand#0') w left join daily_bars b using (symbol) group by 1""")
def _(m):
    pool = m.table("part").select(F.col("p_brand").alias("symbol")).union(m.table("part").select(F.lit("Brand#0").alias("symbol"))).distinct()
    return cs.eligible_universe(pool, m.daily_bars, 1100)


@query("b09_period_return", """
select index_code, count(*) as n, round((arg_max(close, trade_date)/arg_min(close, trade_date) - 1)*100, 6) as return_pct from index_bars
where trade_date between date '1997-01-01' and date '2000-12-31' group by 1""", shared=False)
def _(m):
    return rounded(cs.period_return(m.index_bars, "1997-01-01", "2000-12-31"), ["index_code", "n"], return_pct=6)


view("wk_counts", "select symbol, observed_on as week_end_date, anchor_id, active_count as n_active from week_counts")
view("anchor_rows", """
with u as (select symbol, week_end_date, is_fallback, 'panic_low' as anchor_type, low_date as trade_date, low_adj as p, low_raw as q from tline
  union all select symbol, week_end_date, is_fallback, 'decline_start', decl_date, decl_close, decl_close_raw from tline where di is not null)
select symbol, anchor_type, trade_date, is_fallback, min(week_end_date) as as_of, min(p) as adjusted_price, min(q) as raw_price from u group by 1, 2, 3, 4""")
view("lines", """
select a.symbol, a.trade_date, adjusted_price, case when (cast(substring(a.symbol, 7) as int) * 37 + date_diff('day', date '1970-01-01', a.trade_date) * 11) % 100 > 2 then round(adjusted_price * (1 - 0.08::double), 6) end as stop_adj
from anchor_rows a left join daily_bars b using (symbol, trade_date) where anchor_type = 'decline_start' and not is_fallback""")


def lines(m):
    bars = m.daily_bars.withColumn("price_adj_factor", F.when(mark() > 2, F.col("price_adj_factor")))
    return cs.stop_lines(m.anchor_rows, bars, 0.08)


@query("b10_weekly_counts", "select symbol, week_end_date::varchar as week_end_date, anchor_id, n_active from wk_counts")
def _(m):
    return cs.weekly_counts(m.weekly_facts)


@query("b11_stop_lines", """
select symbol, trade_date::varchar as trade_date, round(adjusted_price, 7) as adjusted_price, round(stop_adj, 5) as stop_adj from lines""")
def _(m):
    return rounded(lines(m), ["symbol", "trade_date"], adjusted_price=7, stop_adj=5)


view("timing_days", """
with l as (select *, row_number() over (partition by symbol order by trade_date) - 1 as no, last_value(stop_adj ignore nulls) over (partition by symbol order by trade_date rows between unbounded preceding and current row) as stop from lines),
a as (select a.symbol, a.trade_date, a.i, a.close, w.n_active from adj a asof left join wk_counts w on w.symbol = a.symbol and a.trade_date >= w.week_end_date)
select a.symbol, a.trade_date, a.i, a.close, a.n_active, coalesce(l.no, -1) as no, l.stop, l.adjusted_price as ref from a asof left join l on l.symbol = a.symbol and a.trade_date >= l.trade_date""")


def timing_view(name: str, cheap: str) -> None:
    view(name, f"""
select * from (with recursive d as materialized (select * from timing_days), s as (
  select distinct symbol, -1::bigint as i, null::date as trade_date, false as held, null::bigint as used, -1::bigint as prev, null::varchar as flag from d
  union all
  select symbol, i, trade_date, case when held then not (x1 or x2) else go end, case when held then case when x1 or x2 then null else used end else case when go then no else used end end, no,
    case when held and x1 then 'exit_stop' when held and x2 then 'exit_new_anchor' when not held and go then 'enter' end
  from (select d.symbol, d.i, d.trade_date, s.held, s.used, d.no, coalesce(d.close <= d.stop, false) as x1, coalesce(s.prev <> d.no and d.no > s.used, false) as x2,
      coalesce(d.n_active >= 2, false) and {cheap} and (s.used is null or d.no <> s.used) as go
    from s join d on d.symbol = s.symbol and d.i = s.i + 1) y) select * from s where flag is not null)""")


timing_view("timing", "true")
timing_view("timing_disc", "coalesce(d.close <= d.ref * (1 - 0.1::double), false)")


@query("b12_exhaustion_flags", "select symbol, trade_date::varchar as trade_date, flag from timing")
def _(m):
    return cs.exhaustion_flags(m.adj, cs.weekly_counts(m.weekly_facts), lines(m))


@query("b12_exhaustion_flags_discount", "select symbol, trade_date::varchar as trade_date, flag from timing_disc")
def _(m):
    return cs.exhaustion_flags(m.adj, cs.weekly_counts(m.weekly_facts), lines(m), discount=0.1)


# ------------------------------------------------------------------------------------------- decisions

view("sigf", """
select symbol, trade_date as observed_on, card_version_id, 'tier_triggered' as signal, state, state = 'triggered' as triggered from trig
union all select symbol, trade_date, card_version_id, 'falsification_breach', state, triggered from fals
union all select symbol, trade_date, card_version_id, 'box_position', state, state in ('buy_zone', 'sell_zone', 'box_breached') from box
union all select symbol, observed_on, card_version_id, 'right_side', state, triggered from rs_rows""")
view("sig_prev", "select *, lag(state) over (partition by symbol, signal order by observed_on) as prev from sigf")
view("direct_points", """
select symbol, observed_on as decision_date, signal as source from sig_prev where (signal = 'tier_triggered' and state = 'triggered' and coalesce(prev, '') <> 'triggered')
  or (signal = 'right_side' and state = 'confirmed') or (signal = 'falsification_breach' and triggered)""")
view("box_cand", """
select s.symbol, s.observed_on, t.td_ord, row_number() over (partition by s.symbol order by s.observed_on) as k from sig_prev s join trading_calendar t on t.trade_date = s.observed_on
where signal = 'box_position' and state = 'buy_zone' and coalesce(prev, '') <> 'buy_zone'""")


def thin(start: str) -> str:
    return f"""
select * from (with recursive d as materialized (select * from box_cand), s as (
  select c.symbol, 0::bigint as k, l.o as last, false as kept, null::date as day from (select distinct symbol from d) c left join ({start}) l on l.symbol = c.symbol
  union all select d.symbol, d.k, case when s.last is null or d.td_ord - s.last + 1 > 5 then d.td_ord else s.last end, s.last is null or d.td_ord - s.last + 1 > 5, d.observed_on
  from s join d on d.symbol = s.symbol and d.k = s.k + 1) select symbol, day as decision_date, 'box_entry' as source from s where kept)"""


view("box_points", thin("select null::varchar as symbol, null::bigint as o where false"))
view("entry_rows", "select e.*, b.close_raw as entry_close from (select * from direct_points union all select * from box_points) e join daily_bars b on b.symbol = e.symbol and b.trade_date = e.decision_date")
view("decisions", """
select symbol || '/' || decision_date::varchar || '/' || source as position_id, symbol, decision_date, source, case when day(decision_date) % 4 < 2 then 'follow' when day(decision_date) % 4 = 2 then 'skip' else 'counter' end as decision,
  entry_close, day(decision_date) % 5 = 0 as tagged, day(decision_date) % 7 = 0 as late, day(decision_date) % 11 = 0 as reversed from entry_rows""")
view("positions", "select position_id, symbol, decision_date as entry_date, entry_close, source, round(entry_close * 0.95::double, 6) as deep_exit_line from decisions where decision = 'follow'")
view("early_decisions", "select * from decisions where decision_date < date '2000-02-01'")
view("box_points_open", thin("select e.symbol, max(t.td_ord) as o from early_decisions e join trading_calendar t on t.trade_date = e.decision_date where source = 'box_entry' group by 1"))


@query("t01_trading_days", """
select d::varchar as day, (select count(*) from trading_calendar t where t.trade_date >= d and t.trade_date <= date '2000-06-30')::int as to_end,
  (select min(trade_date) from trading_calendar t where t.trade_date > d)::varchar as next_open, (select min(b.trade_date) from daily_bars b where b.symbol = s.symbol and b.trade_date > d)::varchar as next_bar, s.symbol
from (select distinct symbol, a_date as d from announcements) s""")
def _(m):
    x = m.announcements.select("symbol", F.col("a_date").alias("day")).distinct()
    x = oc.with_ordinals(x, m.cn_spine, "day", "a")
    x = oc.with_ordinals(x.withColumn("end", F.lit("2000-06-30").cast("date")), m.cn_spine, "end", "b")
    x = oc.asof(x, m.daily_bars, ["symbol"], "day", "trade_date", [F.col("trade_date").alias("next_bar")], strict=True, backward=False, unique=True)
    return x.select("symbol", "day", oc.td_between().cast("int").alias("to_end"), F.col("a_next").alias("next_open"), "next_bar")


@query("t02_entry_points", "select symbol, decision_date::varchar as decision_date, source from entry_rows")
def _(m):
    return m.entries.select("symbol", "decision_date", "source")


@query("t02_entry_points_undecided", """
select symbol, decision_date::varchar as decision_date, source from (select * from direct_points union all select * from box_points_open) p
where not exists (select 1 from early_decisions d where d.symbol = p.symbol and d.decision_date = p.decision_date and d.source = p.source)""")
def _(m):
    return oc.entry_points(m.sig_facts, m.trading_calendar, m.decisions.where("decision_date < '2000-02-01'"))


view("exit_sig", """
select symbol, observed_on, case when signal = 'right_side' then 'stopped_out' else signal end as source from sigf where (signal = 'falsification_breach' and triggered) or (signal = 'right_side' and state = 'stopped_out')""")


@query("t03_exit_points", """
select symbol, position_id, d::varchar as exit_date, source from (
  select p.symbol, position_id, observed_on as d, e.source from positions p join exit_sig e on e.symbol = p.symbol and e.observed_on > p.entry_date
  union all select p.symbol, position_id, min(trade_date), 'deep_exit' from positions p join daily_bars b on b.symbol = p.symbol and b.trade_date > p.entry_date and b.close_raw < p.deep_exit_line group by 1, 2)
where not (source = 'stopped_out' and day(d) % 3 = 0 or source = 'deep_exit' and day(d) % 4 = 0)""")
def _(m):
    """Stop-outs of every third day of a month and deep exits of every fourth were decided before."""
    days = m.daily_bars.select("symbol", F.col("trade_date").alias("decision_date"))
    decided = days.where(F.day("decision_date") % 3 == 0).withColumn("source", F.lit("stopped_out")).unionByName(days.where(F.day("decision_date") % 4 == 0).withColumn("source", F.lit("deep_exit")))
    return oc.exit_points(m.positions, m.sig_facts, m.daily_bars, decided)


@query("t04_decision_fields", """
select e.symbol, e.decision_date::varchar as decision_date, e.source, round(e.entry_close, 7) as close_raw,
  (select count(*) from trading_calendar t where t.trade_date >= e.decision_date and t.trade_date <= date '2000-06-30') > 2 as late,
  (floor(floor(100000/e.entry_close)/100)*100)::bigint as quantity,
  floor(round(coalesce(case when e.source = 'tier_triggered' then greatest(case when t1_low::double <= e.entry_close then t1_low end, case when t2_low::double <= e.entry_close then t2_low end)::double end, e.entry_close) * (1 - 0.05::double), 6) * 100) / 100 as deep_exit_line
from entry_rows e left join bar_cards c on c.symbol = e.symbol and c.trade_date = e.decision_date""")
def _(m):
    x = oc.decision_fields(m.entries.select("symbol", "decision_date", "source"), m.bar_cards, m.cn_spine, "2000-06-30")
    return rounded(x.withColumn("deep_exit_line", F.floor(F.col("deep_exit_line") * 100) / 100), ["symbol", "decision_date", "source", "late", "quantity", "deep_exit_line"], close_raw=7)


view("base_exit", """
with x as (select e.*, (select min(observed_on) from exit_sig s where s.symbol = e.symbol and s.observed_on > e.decision_date) as sig,
  (select min(trade_date) from daily_bars b where b.symbol = e.symbol and b.trade_date > e.decision_date and b.close_raw < e.entry_close * (1 - 0.05::double)) as deep,
  (select max(trade_date) from daily_bars b where b.symbol = e.symbol) as last from entry_rows e),
y as (select *, coalesce(least(sig, deep), last) as exit_date, case when least(sig, deep) is null then 'last_bar' when sig = least(sig, deep) then 'signal' else 'deep_exit' end as exit_kind from x)
select y.symbol, y.decision_date, y.source, y.entry_close, y.exit_date, y.exit_kind, b.close_raw as exit_close, b.close_raw * b.price_adj_factor / (y.entry_close * a.price_adj_factor) - 1 as ret,
  (select count(*) from trading_calendar t where t.trade_date >= y.decision_date and t.trade_date <= y.exit_date)::int as hold_days
from y join daily_bars b on b.symbol = y.symbol and b.trade_date = y.exit_date join daily_bars a on a.symbol = y.symbol and a.trade_date = y.decision_date""")


def exits(m):
    return oc.baseline_exit(m.entries.withColumnRenamed("decision_date", "entry_date"), m.sig_facts, m.daily_bars)


@query("t05_settle", """
select symbol, decision_date::varchar as entry_date, source, exit_date::varchar as exit_date, hold_days, round(ret, 6) as ret, round(ret * 100000, 2) as pnl from base_exit""")
def _(m):
    return rounded(oc.settle(exits(m), m.daily_bars, m.cn_spine), ["symbol", "entry_date", "source", "exit_date", F.col("hold_days").cast("int")], ret=6, pnl=2)


@query("t06_timeout_exits", """
with x as (select p.*, (select count(*) from trading_calendar t where t.trade_date < p.entry_date) + 60 as o, (select count(*) from trading_calendar t where t.trade_date >= p.entry_date and t.trade_date <= date '2000-06-30') as held from positions p),
y as (select x.*, t.trade_date as target, (select min(trade_date) from daily_bars b where b.symbol = x.symbol and b.trade_date >= t.trade_date) as exit_date from x join trading_calendar t on t.td_ord = x.o where held >= 60)
select y.symbol, position_id, target::varchar as target, exit_date::varchar as exit_date, round(b.close_raw, 7) as exit_close from y join daily_bars b on b.symbol = y.symbol and b.trade_date = y.exit_date where exit_date <= date '2000-06-30'""")
def _(m):
    x = oc.timeout_exits(m.positions, m.daily_bars, m.trading_calendar, m.cn_spine, "2000-06-30")
    return x.select("symbol", "position_id", "target", "exit_date", r("exit_close", 7).alias("exit_close"))


@query("t07_baseline_exit", """
select symbol, decision_date::varchar as entry_date, source, exit_date::varchar as exit_date, exit_kind, round(exit_close, 7) as exit_close from base_exit""")
def _(m):
    return exits(m).select("symbol", "entry_date", "source", "exit_date", "exit_kind", r("exit_close", 7).alias("exit_close"))


@query("t08_outcome_stats", """
with v as (select d.*, b.ret, b.exit_kind from decisions d join base_exit b on b.symbol = d.symbol and b.decision_date = d.decision_date and b.source = d.source),
w as (select * from v union all select * replace ('*' as symbol) from v)
select symbol, count(*) filter (decision = 'follow') as follow_n, count(*) filter (decision = 'follow' and ret > 0) as follow_wins, round(avg(ret) filter (decision = 'follow'), 6) as follow_avg_ret,
  round(coalesce(sum(100000*ret) filter (decision = 'follow'), 0), 1) as follow_pnl, count(*) filter (decision = 'follow' and exit_kind = 'last_bar') as open_n,
  count(*) filter (decision = 'skip' and not reversed and not late) as skip_n, count(*) filter (decision = 'skip' and not reversed and not late and tagged) as skip_structural_n,
  round(coalesce(sum(100000*ret) filter (decision = 'skip' and not reversed and not late and ret > 0), 0), 1) as missed_profit, round(coalesce(sum(-100000*ret) filter (decision = 'skip' and not reversed and not late and ret <= 0), 0), 1) as avoided_loss,
  count(*) filter (decision = 'counter' and not reversed and not late) as counter_n, count(*) filter (decision = 'counter' and not reversed and not late and ret < 0) as counter_correct_n,
  count(*) as baseline_n, round(sum(100000*ret), 1) as baseline_pnl, count(*) filter (late) as late_count,
  round(coalesce(sum(100000*ret) filter (decision = 'follow'), 0) - sum(100000*ret), 1) as judgement_diff,
  count(*) filter (decision = 'follow') + count(*) filter (decision in ('skip', 'counter') and not reversed and not late) < 30 as small_sample
from w group by 1""")
def _(m):
    base = oc.settle(exits(m), m.daily_bars, m.cn_spine)
    ret = base.select("symbol", F.col("entry_date").alias("decision_date"), F.col("source").alias("signal_source"), "ret", "exit_kind")
    dec = m.decisions.join(ret, ["symbol", "decision_date", "signal_source"])
    settled = dec.where("decision = 'follow'").select("symbol", "ret", (F.col("exit_kind") == "last_bar").alias("is_open"))
    x = oc.outcome_stats(settled, m.decisions, dec.withColumnRenamed("ret", "vret"), base, exclude_late=True)
    return rounded(x, ["symbol", "follow_n", "follow_wins", "open_n", "skip_n", "skip_structural_n", "counter_n", "counter_correct_n", "baseline_n", "late_count", "small_sample"],
                   follow_avg_ret=6, follow_pnl=1, missed_profit=1, avoided_loss=1, baseline_pnl=1, judgement_diff=1)


view("executions", """
select o_orderkey as execution_id, concat('Brand#', cast(o_custkey % 25 + 1 as int)) as symbol, o_orderdate - to_days((o_custkey % 25 + 1)::int % 8 * 100) as executed_at, o_totalprice as price, o_orderpriority as action_type,
  case when o_orderstatus = 'P' then o_orderkey - 1 end as reverses_execution_id from orders""")


@query("t09_net_reversals", """
select execution_id, symbol, round(price, 2) as price from executions e where reverses_execution_id is null and not exists (select 1 from executions r where r.reverses_execution_id = e.execution_id)""")
def _(m):
    return oc.net_reversals(m.executions).select("execution_id", "symbol", r("price", 2).alias("price"))


@query("t10_signal_snapshot", """
select symbol, signal, observed_on::varchar as observed_on, state, triggered from (
  select *, row_number() over (partition by symbol, signal order by observed_on desc, card_version_id desc) as k from sigf where observed_on <= date '2000-03-31') x where k = 1
union all select symbol, 'anchor:' || anchor_type, trade_date::varchar, case when is_fallback then 'fallback' else 'panic' end, false from anchor_rows a
where as_of = (select max(as_of) from anchor_rows b where b.symbol = a.symbol and b.as_of <= date '2000-03-31')""")
def _(m):
    return oc.signal_snapshot(m.sig_facts, m.anchor_rows, "2000-03-31")


@query("t11_dedup_key", """
with x as (select event_id, symbol, event_type, round(value, 0)::int::varchar as price, ts::date::varchar as d from announcements),
k as (select *, 'auto_' || substring(sha256(symbol || '|' || event_type || '|' || price || '|100|||' || d), 1, 24) as idempotency_key from x)
select idempotency_key, min(event_id) as execution_id, any_value(symbol) as symbol, any_value(price) as price from k group by 1""")
def _(m):
    x = m.announcements.select(F.col("event_id").alias("execution_id"), "symbol", F.col("event_type").alias("action_type"), F.round("value", 0).cast("int").cast("string").alias("price"),
                               F.lit("100").alias("quantity"), F.lit(None).cast("string").alias("tier"), F.lit(None).cast("string").alias("fees"),
                               F.to_date("ts").cast("string").alias("executed_day"))
    return oc.dedup_key(x).select("idempotency_key", "execution_id", "symbol", "price")
