"""Cost distribution, anchors and weekly exhaustion signals."""
from pyspark.sql import functions as F

from tapeloom.functions.columns import r
from tapeloom.operators import chips, exhaustion as ex, indicators
from tapeloom.plans import signal_views
from tapeloom.plans.bar_queries import rounded
from tapeloom.plans.registry import query

BINS = signal_views.BINS


@query("c01_kernel_mass", """
select symbol, trade_date::varchar as trade_date, round(sum(mass), 6) as total, round(max(mass), 6) as peak_mass,
  round(sum(mass * k), 6) as mean_bin from kernel20 group by 1, 2""")
def _(m):
    x = chips.kernel_mass(m.daily_bars, 20, peak="vwap")
    pos = F.transform("mass", lambda v, i: v * i)
    add = lambda a, b: a + b
    return x.select("symbol", "trade_date", r(F.aggregate("mass", F.lit(0.0), add), 6).alias("total"),
                    r(F.array_max("mass"), 6).alias("peak_mass"), r(F.aggregate(pos, F.lit(0.0), add), 6).alias("mean_bin"))


@query("c02_chip_series", """
select symbol, trade_date::varchar as trade_date, round(case when c < m0 then cum0 else winner_ratio end, 6) as winner_ratio,
  round(avg_cost_adj, 4) as avg_cost_adj, round(c5, 4) as cost_5_adj, round(c95, 4) as cost_95_adj from chip_out""", shared=False)
def _(m):
    return rounded(chips.chip_series(m.daily_bars, BINS), ["symbol", "trade_date"], winner_ratio=6, avg_cost_adj=4, cost_5_adj=4, cost_95_adj=4)


@query("c03_chip_outputs", """
select symbol, trade_date::varchar as trade_date, round(avg_cost_adj/f, 4) as avg_cost, round(c5/f, 4) as cost_5, round(c95/f, 4) as cost_95,
  round((c95 - c5)/(c95 + c5), 6) as concentration_90, case when i <= 90 then 'burn_in' else 'mature' end as estimation_status from chip_out""", shared=False)
def _(m):
    return rounded(chips.chip_series(m.daily_bars, BINS), ["symbol", "trade_date", "estimation_status"],
                   avg_cost=4, cost_5=4, cost_95=4, concentration_90=6)


@query("c02_chip_series_full_grid", shared=False)
def _(m):
    cols = dict(winner_ratio=6, avg_cost_adj=4, cost_5_adj=4, cost_95_adj=4, concentration_90=6, avg_cost=4, cost_5=4, cost_95=4)
    return rounded(chips.chip_series(m.daily_bars), ["symbol", "trade_date", "estimation_status"], **cols)


@query("a01_panic_weeks", """
select symbol, week_end_date::varchar as week_end_date, i::int as idx, round(base, 6) as vol_base, panic from panic_weeks""")
def _(m):
    return ex.panic(m.weeks).select("symbol", "week_end_date", "idx", r("vol_base", 6).alias("vol_base"), "panic")


@query("a02_panic_anchor", """
select symbol, week_end_date::varchar as week_end_date, i::int as idx, j::int as anchor_idx, is_fallback from anchor_weeks""")
def _(m):
    return ex.anchor_index(m.weeks).select("symbol", "week_end_date", "idx", "anchor_idx", "is_fallback")


@query("a03_locate_low", """
select symbol, week_end_date::varchar as week_end_date, low_date::varchar as low_date, round(low_adj, 7) as low_adj, round(l.low_raw, 7) as low_raw
from weeks join low_days l using (symbol, i)""")
def _(m):
    return m.weeks.select("symbol", "wk", "week_end_date").join(ex.week_lows(m.daily_bars), ["symbol", "wk"]).select(
        "symbol", "week_end_date", "low_date", r("low_adj", 7).alias("low_adj"), r("low_raw", 7).alias("low_raw"))


@query("a04_decline_anchor", """
select symbol, week_end_date::varchar as week_end_date, di::int as decl_idx, decl_date::varchar as decl_date, round(decl_close, 7) as decl_close
from tline where di is not null""")
def _(m):
    return ex.timeline(m.weeks, m.daily_bars).where("decl_idx is not null").select(
        "symbol", "week_end_date", "decl_idx", "decl_date", r("decl_close", 7).alias("decl_close"))


@query("a05_anchor_ids", """
with u as (select symbol, week_end_date, is_fallback, 'panic_low' as anchor_type, low_date as trade_date, low_adj as p, low_raw as q from tline
  union all select symbol, week_end_date, is_fallback, 'decline_start', decl_date, decl_close, decl_close_raw from tline where di is not null)
select substring(sha256(symbol || '|' || anchor_type || '|' || trade_date::varchar || '|' || is_fallback::varchar), 1, 16) as anchor_id,
  symbol, anchor_type, trade_date::varchar as trade_date, is_fallback, min(week_end_date)::varchar as as_of,
  round(min(p), 7) as adjusted_price, round(min(q), 7) as raw_price from u group by 1, 2, 3, 4, 5""")
def _(m):
    return rounded(ex.anchor_ids(ex.timeline(m.weeks, m.daily_bars)), ["anchor_id", "symbol", "anchor_type", "trade_date", "is_fallback", "as_of"],
                   adjusted_price=7, raw_price=7)


@query("a06_episode_end", """
select symbol, week_end_date::varchar as week_end_date, run::int as run, end_idx::int as end_idx, end_week::varchar as end_week from episodes""")
def _(m):
    return ex.episode_end(ex.timeline(m.weeks, m.daily_bars)).select("symbol", "week_end_date", F.col("run").cast("int"), "end_idx", "end_week")


def weekly_ind(m):
    return indicators.recursive_indicators(m.weeks, "week_end_date")


def facts(m):
    return m.weekly_facts


def fact_sql(signal: str) -> str:
    return ("select symbol, observed_on::varchar as observed_on, state, triggered, active_until::varchar as active_until, reason "
            f"from exh_facts where signal = '{signal}'")


def one_signal(m, signal):
    return facts(m).where(F.col("signal") == signal).select("symbol", "observed_on", "state", "triggered", "active_until", "reason")


@query("x01_panic", fact_sql("panic"))
def _(m):
    return one_signal(m, "panic")


@query("x02_dry_up", "select symbol, week_end_date::varchar as week_end_date, dry_reason from dryups")
def _(m):
    return ex.dryup(ex.timeline(m.weeks, m.daily_bars)).select("symbol", "week_end_date", "dry_reason")


@query("x03_no_new_low", "select symbol, week_end_date::varchar as week_end_date, nnl_reason from nnls")
def _(m):
    return ex.no_new_low(ex.timeline(m.weeks, m.daily_bars)).select("symbol", "week_end_date", "nnl_reason")


@query("x04_pivot_low", "select symbol, week_end_date::varchar as week_end_date, is_pivot from pivots")
def _(m):
    return ex.pivot_low(m.weeks).select("symbol", "week_end_date", "is_pivot")


@query("x05_divergence", "select symbol, week_end_date::varchar as week_end_date, div_reason from divs")
def _(m):
    return ex.divergence(m.weeks, weekly_ind(m)).select("symbol", "week_end_date", "div_reason")


@query("x06_duration", "select symbol, week_end_date::varchar as week_end_date, dur_reason, dur_trigger from durs")
def _(m):
    return ex.duration(ex.timeline(m.weeks, m.daily_bars)).select("symbol", "week_end_date", "dur_reason", "dur_trigger")


@query("x07_exhaustion_facts", """
select symbol, observed_on::varchar as observed_on, anchor_id, signal, state, triggered, active_until::varchar as active_until, reason from exh_facts""")
def _(m):
    return facts(m)


@query("x08_active_counts", """
select symbol, observed_on::varchar as observed_on, anchor_id, active_count, active_signals, meets_min from week_counts""")
def _(m):
    return ex.active_counts(facts(m))


@query("x09_project_week_end", """
select symbol, i::int as idx, week_end_date::varchar as week_end_date, until::varchar as until from week_until""")
def _(m):
    return ex.projected_ends(ex.indexed(m.weeks), m.trading_calendar)
