"""Adjustment, weekly bars and indicators."""
from pyspark.sql import functions as F

from tapeloom.functions.columns import r
from tapeloom.operators import adjust, indicators, weekly
from tapeloom.params import MA_WINDOWS
from tapeloom.plans.base_views import ema_sql
from tapeloom.plans.registry import query, view


def rounded(df, keep, **places):
    """Keep the key columns and round the others."""
    return df.select(*keep, *[r(k, n).alias(k) for k, n in places.items()])


view("src_factor", """
select f.symbol, f.trade_date, close_fwd/close_raw as f from fwd_closes f join daily_bars b using (symbol, trade_date) where close_raw <> 0""")

view("plateau_days", """
select symbol, trade_date, f, row_number() over (partition by symbol order by trade_date) as i from src_factor""")

# running median of the open segment, one day at a time
view("plateau_scan", """
select * from (
with recursive s as (
  select symbol, i, trade_date, 1 as seq, [f] as seg from plateau_days where i = 1
  union all
  select d.symbol, d.i, d.trade_date,
    case when abs(d.f - list_median(s.seg)) / abs(list_median(s.seg)) > 0.001 then s.seq + 1 else s.seq end,
    case when abs(d.f - list_median(s.seg)) / abs(list_median(s.seg)) > 0.001 then [d.f] else list_append(s.seg, d.f) end
  from s join plateau_days d on d.symbol = s.symbol and d.i = s.i + 1)
select symbol, i, trade_date, seq from s)""")

view("plateaus", """
select s.symbol, seq, min(trade_date) as start_date, max(trade_date) as end_date, median(f) as factor, count(*) as days
from plateau_scan s join plateau_days d using (symbol, i, trade_date) group by 1, 2""")

view("norm_factor", """
with flat as (select d.symbol, d.trade_date, p.factor from plateau_days d
  join plateaus p on p.symbol = d.symbol and d.trade_date between p.start_date and p.end_date),
o as (select symbol, min(trade_date) as trade_date from daily_bars group by 1)
select f.symbol, f.trade_date, f.factor / b.factor as price_adj_factor
from flat f join (select flat.* from flat join o using (symbol, trade_date)) b on b.symbol = f.symbol""")

view("share_factors", """
select b.symbol, b.trade_date, coalesce(product(1.0/c.split_ratio), 1.0) as share_factor
from daily_bars b left join corporate_actions c on c.symbol = b.symbol and c.ex_date > b.trade_date and c.action_type = 'split'
group by 1, 2""")


def plateaus(m):
    return adjust.detect_plateaus(adjust.source_factor(m.daily_bars, m.fwd_closes))


@query("f01_source_factor", "select symbol, trade_date::varchar as trade_date, round(f, 12) as f from src_factor")
def _(m):
    return rounded(adjust.source_factor(m.daily_bars, m.fwd_closes), ["symbol", "trade_date"], f=12)


@query("f02_detect_plateaus", """
select symbol, start_date::varchar as start_date, end_date::varchar as end_date, days, seq::bigint as seq, round(factor, 6) as factor
from plateaus""")
def _(m):
    return rounded(plateaus(m), ["symbol", "start_date", "end_date", "days", "seq"], factor=6)


@query("f03_normalise_factor", "select symbol, trade_date::varchar as trade_date, round(price_adj_factor, 6) as price_adj_factor from norm_factor")
def _(m):
    f = adjust.source_factor(m.daily_bars, m.fwd_closes)
    return rounded(adjust.normalise_factor(f, plateaus(m), m.daily_bars), ["symbol", "trade_date"], price_adj_factor=6)


@query("f04_share_factor", "select symbol, trade_date::varchar as trade_date, round(share_factor, 6) as share_factor from share_factors")
def _(m):
    return rounded(adjust.share_factor(m.daily_bars, m.corporate_actions), ["symbol", "trade_date"], share_factor=6)


@query("f05_factor_change", """
with n as (select s.*, cast(substring(symbol,7) as int) as b from src_factor s),
w as (select symbol, trade_date, f from n where trade_date >= case when b % 4 = 0 then date '2000-11-01' else date '2001-01-01' end),
x as (select w.symbol, w.f / d.price_adj_factor as ratio from w join daily_bars d using (symbol, trade_date) where price_adj_factor <> 0),
med as (select symbol, median(ratio) as median_ratio, count(*) as n_overlap from x group by 1),
dev as (select x.symbol, max(abs(ratio - median_ratio)/abs(median_ratio)) as max_dev from x join med using (symbol) group by 1),
s as (select distinct symbol, case cast(substring(symbol,7) as int) % 3 when 0 then 1.015 when 1 then null else 1.01 end::double as f_origin from daily_bars),
j as (select s.symbol, coalesce(n_overlap, 0) as n_overlap, median_ratio, max_dev, f_origin,
  case when n_overlap is null then 'empty_overlap' when max_dev > 0.001 then 'plateau_in_window' when f_origin is null then 'no_reference'
    when abs(median_ratio - f_origin)/abs(f_origin) > 0.001 then 'level_shift' else 'consistent' end as reason
  from s left join med using (symbol) left join dev using (symbol))
select symbol, n_overlap, reason, reason <> 'consistent' as changed, round(median_ratio, 6) as median_ratio, round(max_dev, 6) as max_dev,
  round(f_origin, 6) as f_origin from j""")
def _(m):
    n = F.substring("symbol", 7, 9).cast("int")
    since = F.when(n % 4 == 0, F.lit("2000-11-01").cast("date")).otherwise(F.lit("2001-01-01").cast("date"))
    new = adjust.source_factor(m.daily_bars, m.fwd_closes).where(F.col("trade_date") >= since)
    ref = m.daily_bars.select("symbol").distinct().select(
        "symbol", F.when(n % 3 == 0, 1.015).when(n % 3 == 2, 1.01).alias("f_origin"))
    out = adjust.factor_change(m.daily_bars.select("symbol", "trade_date", "price_adj_factor"), new, ref)
    return rounded(out, ["symbol", "n_overlap", "reason", "changed"], median_ratio=6, max_dev=6, f_origin=6)


view("action_days", """
select distinct symbol, ex_date, (select count(*) from trading_calendar t where t.trade_date < ex_date) as o
from (select distinct symbol, ex_date from corporate_actions)""")


@query("f06_cross_check_actions", """
with sw as (select symbol, start_date as switch_date, (select count(*) from trading_calendar t where t.trade_date < start_date) as o
  from plateaus where seq > 1),
j as (select sw.symbol, switch_date, arg_min(ex_date, abs(sw.o - e.o) * 100000 + (ex_date - date '1970-01-01')) as nearest, min(abs(sw.o - e.o)) as distance
  from sw left join action_days e on e.symbol = sw.symbol group by 1, 2)
select symbol, switch_date::varchar as switch_date, nearest::varchar as nearest_ex_date, distance::int as distance,
  case when distance is null then 'unchecked' when distance > 2 then 'warn' else 'ok' end as status from j""")
def _(m):
    return adjust.cross_check_actions(plateaus(m), m.corporate_actions, m.spine.where("market = 'CN'"))


@query("f07_apply_adjustment", """
select b.symbol, b.trade_date::varchar as trade_date, round(b.close_raw, 7) as close_raw,
  round(coalesce(round(n.price_adj_factor, 6), b.price_adj_factor), 6) as price_adj_factor,
  round(case when n.price_adj_factor is not null then s.share_factor else b.share_factor end, 6) as share_factor,
  n.price_adj_factor is not null as updated
from daily_bars b left join norm_factor n using (symbol, trade_date) left join share_factors s using (symbol, trade_date)""")
def _(m):
    f = adjust.source_factor(m.daily_bars, m.fwd_closes)
    price = adjust.normalise_factor(f, adjust.detect_plateaus(f), m.daily_bars)
    out = adjust.apply_adjustment(m.daily_bars, price, adjust.share_factor(m.daily_bars, m.corporate_actions))
    return rounded(out, ["symbol", "trade_date", "updated"], close_raw=7, price_adj_factor=6, share_factor=6)


PRICE4 = dict(open=9, high=9, low=9, close=9, volume=4, amount=2)
PRICE4_SQL = ", ".join(f"round({k}, {n}) as {k}" for k, n in PRICE4.items())


@query("f08_adjusted_bars", f"select symbol, trade_date::varchar as trade_date, {PRICE4_SQL} from adj", shared=False)
def _(m):
    return rounded(m.adj, ["symbol", "trade_date"], **PRICE4)


@query("f09_weekly_bars", f"""
select symbol, week_start_date::varchar as week_start_date, week_end_date::varchar as week_end_date, trading_days, {PRICE4_SQL} from weeks""", shared=False)
def _(m):
    return rounded(m.weeks, ["symbol", "week_start_date", "week_end_date", "trading_days"], **PRICE4)


@query("f10_weekly_raw", """
select w.symbol, w.week_end_date::varchar as week_end_date, round(arg_min(open_raw, trade_date), 9) as open, round(max(high_raw), 9) as high,
  round(min(low_raw), 9) as low, round(arg_max(b.close_raw, trade_date), 9) as close, round(sum(volume_raw), 4) as volume, round(sum(amount_raw), 2) as amount
from weeks w join daily_bars b on b.symbol = w.symbol and b.trade_date between w.week_start_date and w.week_end_date group by 1, 2""")
def _(m):
    return rounded(weekly.weekly_raw(m.daily_bars, m.weeks), ["symbol", "week_end_date"], **PRICE4)


def roll_sql(fn: str, col: str, n: int, lag: int = 0) -> str:
    fr = f"(partition by symbol order by trade_date rows between {n - 1 + lag} preceding and {f'{lag} preceding' if lag else 'current row'})"
    return f"case when count({col}) over {fr} = {n} then {fn}({col}) over {fr} end"


MA_PLACES = {n: 6 if n <= 10 else 4 for n in MA_WINDOWS}
KEY = "symbol, trade_date::varchar as trade_date"


@query("i01_sma", f"select {KEY}, " + ", ".join(f"round({roll_sql('avg', 'close', n)}, {MA_PLACES[n]}) as ma{n}" for n in MA_WINDOWS) + " from adj", shared=False)
def _(m):
    return rounded(indicators.sma(m.adj), ["symbol", "trade_date"], **{f"ma{n}": MA_PLACES[n] for n in MA_WINDOWS})


@query("i02_ema", f"""
select a.symbol, a.trade_date::varchar as trade_date, round(a.v, 4) as ema12, round(b.v, 4) as ema26
from {ema_sql('adj', 'trade_date', 'close', 12)} a join {ema_sql('adj', 'trade_date', 'close', 26)} b using (symbol, trade_date)""", shared=False)
def _(m):
    return rounded(indicators.recursive_indicators(m.adj, extra_ema=(12, 26)), ["symbol", "trade_date"], ema12=4, ema26=4)


@query("i03_rolling_std", f"select {KEY}, round({roll_sql('stddev_pop', 'close', 20)}, 4) as std20, round({roll_sql('stddev_pop', 'close', 60)}, 4) as std60 from adj", shared=False)
def _(m):
    return rounded(indicators.rolling_std(m.adj), ["symbol", "trade_date"], std20=4, std60=4)


@query("i04_hist_mean", f"select {KEY}, round({roll_sql('avg', 'volume', 20, 1)}, 6) as vol_base20 from adj", shared=False)
def _(m):
    return rounded(indicators.hist_mean(m.adj, "volume", 20, name="vol_base20"), ["symbol", "trade_date"], vol_base20=6)


@query("i05_macd", f"select {KEY}, round(dif, 4) as dif, round(dea, 4) as dea, round(2*(dif - dea), 4) as macd_hist from macd_d", shared=False)
def _(m):
    return rounded(indicators.recursive_indicators(m.adj), ["symbol", "trade_date"], dif=4, dea=4, macd_hist=4)


@query("i06_wilder_rma", """
select symbol, trade_date::varchar as trade_date, round(g, 4) as rma_gain, round(l, 4) as rma_loss from (
  select a.symbol, a.trade_date, a.i, sum(b.up * case when b.i <= 14 then pow(13/14.0, a.i - 14) / 14 else pow(13/14.0, a.i - b.i) / 14 end) as g,
    sum(b.down * case when b.i <= 14 then pow(13/14.0, a.i - 14) / 14 else pow(13/14.0, a.i - b.i) / 14 end) as l
  from steps_d a join steps_d b on a.symbol = b.symbol and b.i >= 1 and b.i <= a.i where a.i >= 14 group by 1, 2, 3) x""", shared=False)
def _(m):
    return rounded(indicators.wilder_rma(m.adj, 14).where("rma_gain is not null"), ["symbol", "trade_date"], rma_gain=4, rma_loss=4)


@query("i07_rsi", f"""
select {KEY}, round(rsi6, 4) as rsi6, round(rsi12, 4) as rsi12, round(rsi24, 4) as rsi24 from adj
left join rsi6_d using (symbol, trade_date, i) left join rsi12_d using (symbol, trade_date, i) left join rsi24_d using (symbol, trade_date, i)""", shared=False)
def _(m):
    return rounded(indicators.recursive_indicators(m.adj), ["symbol", "trade_date"], rsi6=4, rsi12=4, rsi24=4)


BOLL_SQL = f"select *, {roll_sql('avg', 'close', 20)} as mid, {roll_sql('stddev_pop', 'close', 20)} as sd from adj"


@query("i08_boll", f"""
select {KEY}, round(mid, 4) as boll_mid, round(mid + 2*sd, 4) as boll_upper, round(mid - 2*sd, 4) as boll_lower,
  round(((mid + 2*sd) - (mid - 2*sd))/mid, 6) as boll_bandwidth from ({BOLL_SQL}) x""", shared=False)
def _(m):
    return rounded(indicators.boll(m.adj), ["symbol", "trade_date"], boll_mid=4, boll_upper=4, boll_lower=4, boll_bandwidth=6)


@query("i09_kdj", """
select a.symbol, a.trade_date::varchar as trade_date, round(k, 4) as kdj_k, round(d, 4) as kdj_d, round(3*k - 2*d, 4) as kdj_j from (
  select symbol, trade_date, case when i >= 8 then coalesce(last_value(k ignore nulls) over w, 50.0) end as k,
    case when i >= 8 then coalesce(last_value(d ignore nulls) over w, 50.0) end as d
  from adj left join kd_d using (symbol, trade_date)
  window w as (partition by symbol order by trade_date rows between unbounded preceding and current row)) a""", shared=False)
def _(m):
    return rounded(indicators.recursive_indicators(m.adj), ["symbol", "trade_date"], kdj_k=4, kdj_d=4, kdj_j=4)


VOL_COLS = {"vol_ma5": ("avg", "volume", 5, 4), "vol_ma10": ("avg", "volume", 10, 4),
            **{f"{p}_{t}{n}": (fn, col, n, 2 if (p, t) == ("amt", "std") else 4) for p, col in (("vol", "volume"), ("amt", "amount"))
               for t, fn in (("mean", "avg"), ("std", "stddev_pop")) for n in (20, 60)}}
VOL_SQL = ", ".join(f"round({roll_sql(fn, col, n)}, {d}) as {k}" for k, (fn, col, n, d) in VOL_COLS.items())


@query("i10_volume_stats", f"select {KEY}, {VOL_SQL} from adj", shared=False)
def _(m):
    return rounded(indicators.volume_stats(m.adj), ["symbol", "trade_date"], **{k: v[3] for k, v in VOL_COLS.items()})


CHG_SQL = """round((close/lag(close) over (partition by symbol order by trade_date) - 1)*100, 6) as pct_chg,
  round((high - low)/lag(close) over (partition by symbol order by trade_date)*100, 6) as amplitude"""


@query("i11_change_amp", f"select {KEY}, {CHG_SQL} from adj", shared=False)
def _(m):
    return rounded(indicators.change_amp(m.adj), ["symbol", "trade_date"], pct_chg=6, amplitude=6)


ALL = {**{f"ma{n}": MA_PLACES[n] for n in MA_WINDOWS}, **dict.fromkeys(("dif", "dea", "macd_hist", "rsi6", "rsi12", "rsi24"), 4),
       "boll_mid": 4, "boll_upper": 4, "boll_lower": 4, "boll_bandwidth": 6, **{k: v[3] for k, v in VOL_COLS.items()},
       "kdj_k": 4, "kdj_d": 4, "kdj_j": 4, "pct_chg": 6, "amplitude": 6}


def indicator_sql(tag: str, src: str, order: str, windows) -> str:
    fix = lambda s: s.replace("order by trade_date", f"order by {order}")
    mas = ", ".join(f"round({fix(roll_sql('avg', 'close', n))}, {MA_PLACES[n]}) as ma{n}" for n in windows)
    return f"""
with x as (select *, {fix(roll_sql('avg', 'close', 20))} as mid, {fix(roll_sql('stddev_pop', 'close', 20))} as sd,
    {mas}, {fix(VOL_SQL)}, {fix(CHG_SQL)} from {src})
select x.symbol, x.{order}::varchar as {order}, {', '.join(f'ma{n}' for n in windows)}, {', '.join(VOL_COLS)}, pct_chg, amplitude,
  round(mid, 4) as boll_mid, round(mid + 2*sd, 4) as boll_upper, round(mid - 2*sd, 4) as boll_lower, round(4*sd/mid, 6) as boll_bandwidth,
  round(dif, 4) as dif, round(dea, 4) as dea, round(2*(dif-dea), 4) as macd_hist, round(rsi6, 4) as rsi6, round(rsi12, 4) as rsi12,
  round(rsi24, 4) as rsi24, round(k, 4) as kdj_k, round(d, 4) as kdj_d, round(3*k - 2*d, 4) as kdj_j
from x left join macd_{tag} using (symbol, {order}) left join rsi6_{tag} using (symbol, {order}) left join rsi12_{tag} using (symbol, {order})
left join rsi24_{tag} using (symbol, {order}) left join kd_{tag} using (symbol, {order})"""


@query("i12_indicators_daily", indicator_sql("d", "adj", "trade_date", MA_WINDOWS))
def _(m):
    return rounded(indicators.compute_indicators(m.adj), ["symbol", "trade_date"], **ALL)


@query("i12_indicators_weekly", indicator_sql("w", "weeks", "week_end_date", (5, 10, 20, 60)))
def _(m):
    cols = {k: v for k, v in ALL.items() if k not in ("ma120", "ma250")}
    return rounded(indicators.compute_indicators(m.weeks, "week_end_date", (5, 10, 20, 60)), ["symbol", "week_end_date"], **cols)
