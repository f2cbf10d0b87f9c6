"""Raw files, price-like sources and validation."""
from pyspark.sql import functions as F

from tapeloom.functions.columns import r
from tapeloom.operators import adjust, quality as q
from tapeloom.plans import raw_zone, source_views  # noqa: F401
from tapeloom.plans.bar_queries import rounded
from tapeloom.plans.market import mark
from tapeloom.plans.registry import query, view
from tapeloom.session import work_folder
from tapeloom.sources import files, prices

BAR = dict(open=7, high=7, low=7, close=7, volume=2)
BAR_SQL = ", ".join(f"round({k}, {n}) as {k}" for k, n in BAR.items())


@query("s01_route_raw", """
select file_path, split_part(k, '/', 1) as source, split_part(k, '/', 2) as data_type, '2001-12-31' as ingest_date, stem,
  case when k = 'tdx/unknown' then 'unrouted' when k like '%/price' and tag = '_forward' then 'forward_skipped' else 'parse' end as outcome from raw_files""")
def _(m):
    return files.route_raw(m.raw_files).select("file_path", "source", "data_type", "ingest_date", "stem", "outcome")


@query("s02_classify_files", """
select file_path, case when k = 'tdx/unknown' then 'unrouted' when split_part(k, '/', 1) not in ('tdx', 'akshare', 'stock_finance_data') then 'filtered'
  when (k like '%/price' and tag = '_forward') or (k like '%/kline' and tag <> '') then case when base in (select distinct symbol from daily_bars) then 'forward' else 'other' end
  when stem in (select distinct symbol from daily_bars) then 'pool' else 'other' end as kind from raw_files""")
def _(m):
    return files.classify_files(m.raw_files, m.symbols, ("tdx", "akshare", "stock_finance_data")).select("file_path", "kind")


@query("s03_skip_seen", """
select content_hash, min(file_path) as file_path from raw_files f where not exists (select 1 from raw_files o where o.content_hash = f.content_hash and o.doc_id in (select doc_id from labels where quality = 1)) group by 1""")
def _(m):
    done = m.raw_files.join(m.table("labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi").select("content_hash", F.lit("ok").alias("fetch_status"))
    return files.skip_seen(m.raw_files, done)


@query("s04_parse_price_a", f"select sym as symbol, td::varchar as trade_date, market, {BAR_SQL.replace('volume', 'v', 1)}, round(amount, 2) as amount from vkept")
def _(m):
    """From real files, found by route and read by their own headers."""
    raw = raw_zone.deliver(raw_zone.price_rows(m).drop("yr"), work_folder(m.spark))
    kept, _ = raw_zone.parse_prices(m)(files.scan(m.spark, raw, "stock_finance_data/price", "stock_finance_data/index"))
    return rounded(kept, ["symbol", "trade_date", "market"], **BAR, amount=2)


@query("s05_parse_price_b", """
select e.sym as symbol, e.td::varchar as trade_date, case when k.sym is not null and (e.k > 50 or e.k = 5 or e.td is null) then true else false end as turnover_changed,
  round(case when k.sym is not null then k.turnover when e.k > 50 then null when e.k = 5 then 0.9 else e.turnover end, 4) as turnover
from (select * from vendor where td in (select trade_date from trading_calendar)) e left join vkept k on k.sym = e.sym and k.td = e.td""")
def _(m):
    rows, _ = q.batch_policy(prices.parse_price_b(m.vendor_files("akshare", "price"), m.full_cal))
    cur = m.vendor.join(m.trading_calendar.select(F.col("trade_date").alias("td")), "td", "left_semi").select(
        F.col("thscode").alias("symbol"), F.col("td").alias("trade_date"),
        F.when(F.col("k") > 50, F.lit(None)).when(F.col("k") == 5, F.lit(0.9)).otherwise(F.col("turnover").cast("double")).alias("turnover"))
    return rounded(prices.turnover_update(cur, rows), ["symbol", "trade_date", "turnover_changed"], turnover=4)


@query("s06_parse_kline", """
select sym as symbol, td::varchar as trade_date, case when k = 4 then 'skip' else outcome end as outcome, case when k = 4 then 'forward_row' else reason end as reason,
  v * case when k % 2 = 0 then 1 else 100 end as volume, case when market = 'HK' then 'HKD' else 'CNY' end as currency, market = 'HK' as incomplete from vrows""")
def _(m):
    raw = m.vendor_files("tdx", "kline").select("file_path", "code", "setcode", F.col("time").alias("data"), "open", "high", "low", "close", "volume", "amount",
                                                F.when(F.col("k") % 2 == 0, "1").otherwise("").alias("unit"), F.when(F.col("k") == 4, "1").otherwise("0").alias("tqflag"))
    return prices.parse_kline(raw, m.full_cal).select("symbol", "trade_date", "outcome", "reason", "volume", "currency", "incomplete")


@query("s07_parse_price_utc", "select sym as symbol, td::varchar as trade_date, outcome, reason, market = 'HK' as incomplete, round(close, 7) as close from vrows")
def _(m):
    at = F.date_format(F.col("td").cast("timestamp") - F.expr("interval 8 hours"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    raw = m.vendor_files("yahoo_finance", "price").select("file_path", "thscode", at.alias("Date"), *[F.col(k).alias(k.capitalize()) for k in BAR], "currency")
    return prices.parse_price_utc(raw, m.full_cal).select("symbol", "trade_date", "outcome", "reason", "incomplete", r("close", 7).alias("close"))


@query("s08_parse_index", """
with i as (select trade_date as d, round(close, 4) as c from index_bars)
select 'a' as vendor, '000300.SH' as index_code, d::varchar as trade_date, 'ok' as outcome, null as reason, c as close from i
union all select 'b', '000300.SH', d::varchar, case when c < 1500 then 'skip' else 'ok' end, case when c < 1500 then 'ohlc_order' end, c from i
union all select 'k', '000300.SH', d::varchar, case when c > 9000 then 'conflict' else 'ok' end, case when c > 9000 then 'not_an_index' end, c from i
union all select 'u', '000300.SH', d::varchar, 'ok', null, c from i""", shared=False)
def _(m):
    c = F.round("close", 4).cast("decimal(18,4)").cast("string")
    base = m.index_bars.select(F.lit("f.csv").alias("file_path"), "trade_date", c.alias("c"), F.col("close").alias("_x"))
    day = F.date_format("trade_date", "yyyyMMdd")
    four = lambda names, hi=None: [(hi if k.lower() == "high" and hi is not None else F.col("c")).alias(k) for k in names]
    names = ("open", "high", "low", "close")
    a = base.select(F.lit("a").alias("file_path"), F.lit("000300.SH").alias("thscode"), day.alias("time"), *four(names), F.lit("1").alias("volume"), F.lit("CNY").alias("currency"))
    low = F.when(F.round("_x", 4) < 1500, (F.col("c").cast("double") / 2).cast("string")).otherwise(F.col("c"))
    b = base.select(F.lit("b").alias("file_path"), F.lit("000300.SH").alias("thscode"), day.alias("time"), *four(names, low), F.lit("1").alias("volume"), F.lit("CNY").alias("currency"))
    k = base.select(F.lit("k").alias("file_path"), F.lit("000300").alias("code"), F.when(F.round("_x", 4) > 9000, "1").otherwise("62").alias("setcode"), day.alias("data"), *four(names),
                    F.lit("1").alias("volume"), F.lit("").alias("unit"))
    at = F.date_format(F.col("trade_date").cast("timestamp") - F.expr("interval 8 hours"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    u = base.select(F.lit("u").alias("file_path"), F.lit("000300.SS").alias("thscode"), at.alias("Date"), *four([n.capitalize() for n in names]), F.lit("1").alias("Volume"), F.lit("CNY").alias("currency"))
    return prices.parse_index(a, b, k, u).select(F.col("file_path").alias("vendor"), "index_code", "trade_date", "outcome", "reason", r("close", 4).alias("close"))


@query("s09_parse_fx", """
with i as (select trade_date as d, round(close, 4) as c from index_bars)
select 'HKD' as from_currency, 'CNY' as to_currency, d::varchar as rate_date, case when c < 1500 then 'skip' when c > 9000 then 'conflict' else 'ok' end as outcome,
  case when c < 1500 then 'missing_close' when c > 9000 then 'not_positive' end as reason, case when c between 1500 and 9000 then round(1/c, 9) end as rate from i""", shared=False)
def _(m):
    x = F.round("close", 4)
    at = F.date_format(F.col("trade_date").cast("timestamp") - F.expr("interval 8 hours"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    raw = m.index_bars.select(F.lit("data/raw/yahoo_finance/fx/2001-12-31/run1/CNYHKD=X.csv").alias("file_path"), at.alias("Date"),
                              F.when(x < 1500, "").when(x > 9000, "-1").otherwise(x.cast("decimal(18,4)").cast("string")).alias("Close"))
    return rounded(prices.parse_fx(raw, ("HKD", "CNY")), ["from_currency", "to_currency", "rate_date", "outcome", "reason"], rate=9)


@query("s10_parse_actions", """
select case when n % 5 = 0 then lpad(n::varchar, 5, '0') || '.HK' else (n + 600000)::varchar || '.SH' end as symbol, ex_date::varchar as ex_date, action_type,
  round(max(cash_per_share), 4) as cash_per_share, max(split_ratio) as split_ratio from (select *, cast(substring(symbol, 7) as int) as n from corporate_actions) x group by 1, 2, 3""")
def _(m):
    n = F.substring("symbol", 7, 9).cast("int")
    sym = F.when(n % 5 == 0, F.concat(F.lpad(n.cast("string"), 5, "0"), F.lit(".HK"))).otherwise(F.concat((n + 600000).cast("string"), F.lit(".SH")))
    at = F.date_format(F.col("ex_date").cast("timestamp") - F.expr("interval 8 hours"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    num = lambda k: F.coalesce(F.col(k).cast("decimal(18,4)").cast("string"), F.lit("0"))
    raw = m.corporate_actions.select(F.concat(F.lit("raw/"), sym, F.lit(".csv")).alias("file_path"), at.alias("Date"), num("cash_per_share").alias("Dividends"), num("split_ratio").alias("Stock Splits"))
    out = prices.parse_actions(raw.unionByName(raw))
    return rounded(out, ["symbol", "ex_date", "action_type", "split_ratio"], cash_per_share=4)


@query("s34_normalise_units", """
select sym as symbol, td::varchar as trade_date, (v * 100)::bigint as volume, (amount)::bigint as amount, round(turnover, 6) as turnover from (select *, floor(amount) as amount from vendor) x""".replace("select *, floor(amount) as amount", "select * replace (floor(amount) as amount)"), shared=False)
def _(m):
    yi = (F.floor(F.col("amount").cast("double")).cast("decimal(18,0)") / F.lit(100000000).cast("decimal(18,0)")).cast("decimal(28,8)").cast("string")
    raw = m.vendor.select(F.col("thscode").alias("symbol"), F.col("td").alias("trade_date"), F.col("volume").alias("volume_lots"), yi.alias("amount_yi"),
                          (F.col("turnover").cast("decimal(10,4)") * 100).cast("string").alias("turnover_pct"))
    return prices.normalise_units(raw.withColumn("amount_yi", F.concat("amount_yi", F.lit("00000001")))).select("symbol", "trade_date", "volume", "amount", r("turnover", 6).alias("turnover"))


# ------------------------------------------------------------------------------------------- validation

def gated(m):
    return prices.parse_price_a(m.vendor_files("stock_finance_data", "price"), m.full_cal)


@query("v01_validate_ohlc", "select sym as symbol, td::varchar as trade_date, bar_reason as reason from vgate", shared=False)
def _(m):
    x = m.vendor.select(F.col("thscode").alias("symbol"), F.col("td").alias("trade_date"), *[q.clean_num(k).alias(k) for k in prices.BAR_COLS])
    return q.validate_ohlc(x).select("symbol", "trade_date", "reason")


@query("v02_clean_values", """
with t as (select conv_id, turn, conv_id % 7 as k, text from conversations)
select conv_id, turn, case k when 0 then null when 1 then null when 2 then null when 3 then 1200.5 when 4 then null when 5 then null else conv_id end::double as num,
  case k when 3 then '1200.5' when 6 then conv_id::varchar end as dec, try_cast(nullif(trim(text), '') as double) as of_text from t""")
def _(m):
    k = F.col("conv_id") % 7
    raw = F.when(k == 0, " ").when(k == 1, "NA").when(k == 2, "nan").when(k == 3, " 1.2005E3 ").when(k == 4, "None").when(k == 5, F.col("text")).otherwise(F.col("conv_id").cast("string"))
    return m.table("conversations").select("conv_id", "turn", q.clean_num(raw).alias("num"), q.dec_text(q.clean_dec(raw)).alias("dec"), q.clean_num("text").alias("of_text"))


@query("v03_gate_calendar", "select sym as symbol, td::varchar as trade_date, case when market = 'HK' then 'calendar_missing' else cal_reason end as cal_reason from vgate")
def _(m):
    x = m.vendor.select(F.col("thscode").alias("symbol"), F.col("td").alias("trade_date"), q.market_of("thscode").alias("market"))
    return q.gate_calendar(x, m.full_cal).select("symbol", "trade_date", "cal_reason")


@query("v04_batch_policy", """
select file_path, count(*) filter (outcome = 'ok') as ok, count(*) filter (outcome = 'skip') as skipped, count(*) filter (outcome = 'conflict') as conflicts,
  case when count(*) filter (outcome = 'conflict') > 0 then 'conflict' when bool_or(market = 'HK') then 'incomplete' else 'ok' end as status,
  case when count(*) filter (outcome = 'conflict') > 0 then 0 else count(*) filter (outcome = 'ok') end as kept from vrows group by 1""")
def _(m):
    return q.batch_policy(gated(m))[1].select("file_path", "ok", "skipped", "conflicts", "status", "kept")


view("old_bars_v", """
select sym, td, case when kk = 7 then close + 1 when kk = 8 then close + 5e-7 when kk = 9 then null else close end as close, case when kk = 10 then 'HKD' else 'CNY' end as currency from vkept where kk < 80""")


def old_vendor(m):
    kept, _ = q.batch_policy(gated(m))
    k = F.pmod(F.unix_date("trade_date") * 11 + F.substring_index("symbol", ".", 1).cast("int") % 600000 * 37, F.lit(100))
    return kept, kept.where(k < 80).select(
        "symbol", "trade_date", F.when(k == 7, F.col("close") + 1).when(k == 8, F.col("close") + 5e-7).when(k != 9, F.col("close")).alias("close"),
        F.when(k == 10, "HKD").otherwise("CNY").alias("currency"))


@query("v05_vals_equal", """
select k.sym as symbol, k.td::varchar as trade_date, not (k.kk in (7, 9)) as close_equal, k.kk <> 10 as currency_equal from vkept k join old_bars_v o on o.sym = k.sym and o.td = k.td""")
def _(m):
    kept, old = old_vendor(m)
    o = old.select("symbol", "trade_date", F.col("close").alias("o_close"), F.col("currency").alias("o_cur"))
    return kept.join(o, ["symbol", "trade_date"]).select("symbol", "trade_date", q.vals_equal("o_close", "close").alias("close_equal"),
                                                         q.vals_equal("o_cur", "currency", None).alias("currency_equal"))


@query("v06_merge_facts", """
select k.sym as symbol, k.td::varchar as trade_date, case when k.kk >= 80 then 'insert' when k.kk in (7, 9, 10) then 'update' else 'same' end as action,
  round(case when k.kk = 8 then k.close + 5e-7 else k.close end, 8) as close, 'CNY' as currency, k.kk in (7, 9, 10) as logged from vkept k
union all select 'GONE', '2001-01-01', 'keep', 1.0, 'CNY', false""")
def _(m):
    kept, old = old_vendor(m)
    gone = old.agg(F.lit("GONE").alias("symbol"), F.lit("2001-01-01").cast("date").alias("trade_date"), F.lit(1.0).alias("close"), F.lit("CNY").alias("currency"))
    new = kept.select("symbol", "trade_date", "close", "currency")
    twice = new.withColumns({"close": F.col("close") + 9, "row_no": F.lit(1)}).unionByName(new.withColumn("row_no", F.lit(2)))  # each key comes twice
    out = q.merge_facts(old.unionByName(gone), twice, ["symbol", "trade_date"], ["close", "currency"], ("close",))
    return out.select("symbol", "trade_date", "action", r("close", 8).alias("close"), "currency", F.col("old_value").isNotNull().alias("logged"))


@query("v07_append_revision", """
with n as (select symbol, period_end, period_type, np + case when q = 1 then 1 else 0 end as np from rep_latest union all select symbol, (period_end + 365)::date, period_type, np from rep_latest where q = 4)
select n.symbol, n.period_end::varchar as period_end, n.period_type, (coalesce(l.revision, 0) + 1)::int as revision, n.np::double as net_profit_attr
from n left join rep_latest l using (symbol, period_end, period_type) where l.revision is null or l.np <> n.np
union all select symbol, period_end::varchar, period_type, (revision + k)::int, (case k when 1 then np + 5 else np end)::double from rep_latest, (values (1), (2)) t(k) where q = 2""")
def _(m):
    from tapeloom.operators.valuation import latest_revisions
    key, val = ["symbol", "period_end", "period_type"], ["net_profit_attr"]
    last = latest_revisions(m.rep)
    amt = lambda e: e.cast("decimal(20,2)").alias("net_profit_attr")
    parts = [  # in delivery order: second quarters with other content first, third quarters twice alike, last year's figures last
        last.where("q = 2").select(*key, amt(F.col("net_profit_attr") + 5)).unionByName(last.where("q = 3").select(*key, amt(F.col("net_profit_attr")))),
        last.select(*key, amt(F.col("net_profit_attr") + F.when(F.col("q") == 1, 1).otherwise(0))),
        last.where("q = 4").select("symbol", F.date_add("period_end", 365).alias("period_end"), "period_type", amt(F.col("net_profit_attr"))),
    ]
    parts = [x.withColumn("row_no", F.lit(i)) for i, x in enumerate(parts)]
    new = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return q.append_revision(m.rep.select(*key, "revision", *val), new, key, val)


@query("v08_inherit_factor", """
select symbol, trade_date::varchar as trade_date, coalesce(last_value(case when (cast(substring(symbol, 7) as int) * 37 + date_diff('day', date '1970-01-01', trade_date) * 11) % 100 > 20 then price_adj_factor end ignore nulls) over (partition by symbol order by trade_date rows between unbounded preceding and current row), 1.0) as price_adj_factor,
  coalesce(last_value(case when (cast(substring(symbol, 7) as int) * 37 + date_diff('day', date '1970-01-01', trade_date) * 11) % 100 > 20 then share_factor end ignore nulls) over (partition by symbol order by trade_date rows between unbounded preceding and current row), 1.0) as share_factor from daily_bars""", shared=False)
def _(m):
    x = m.daily_bars.withColumns({k: F.when(mark() > 20, F.col(k)) for k in ("price_adj_factor", "share_factor")})
    return adjust.inherit_factor(x).select("symbol", "trade_date", "price_adj_factor", "share_factor")


@query("v09_symbols", "select distinct sym as symbol, market, case market when 'HK' then 'Asia/Hong_Kong' else 'Asia/Shanghai' end as tz from vendor", shared=False)
def _(m):
    s = q.to_symbol("code", "setcode")
    return m.vendor.select(s.alias("symbol"), q.market_of(s).alias("market"), q.tz_of(q.market_of(s)).alias("tz")).distinct()


view("next_opens", """
select event_id, m, d, case when m = 'HK' then (d + 1)::date when n is null or n - d > 41 then (d + 41)::date else n end as avail from (
  select event_id, case when event_type = 'click' then 'HK' else 'CN' end as m, a_date as d, (select min(trade_date) from trading_calendar t where t.trade_date > a_date) as n from study_events) x""")


@query("v10_next_open", "select event_id, m as market, d::varchar as pub_date, avail::varchar as available_on, strftime(avail::timestamp - interval 8 hour, '%Y-%m-%d %H:%M:%S') as available_at from next_opens")
def _(m):
    x = m.study_events.select("event_id", F.when(F.col("event_type") == "click", "HK").otherwise("CN").alias("market"), F.col("a_date").alias("pub_date"))
    return q.next_open(x, m.spine, "pub_date").select("event_id", "market", "pub_date", "available_on", q.local_midnight_utc("available_on", "Asia/Shanghai").alias("available_at"))


@query("v11_day_status", """
select s.symbol, s.a_date::varchar as trade_date, case when c.trade_date is null then 'incomplete' when not c.is_open then 'non_trading_day' when b.symbol is not null then 'trading_with_bars'
  when i.trade_date is not null then 'suspended' else 'source_missing' end as status
from (select distinct symbol, a_date from study_events) s left join full_cal c on c.trade_date = s.a_date left join daily_bars b on b.symbol = s.symbol and b.trade_date = s.a_date left join index_h i on i.trade_date = s.a_date""")
def _(m):
    pairs = m.study_events.select("symbol", F.col("a_date").alias("trade_date"), F.lit("CN").alias("market")).distinct()
    return q.day_status(pairs, m.full_cal, m.daily_bars, m.index_h).select("symbol", "trade_date", "status")


@query("v12_calendar_conflicts", """
with d as (select unnest(generate_series(date '1994-12-25', date '2001-12-31', interval 1 day))::date as d),
i as (select trade_date from index_h union select (trade_date + 6)::date from trading_calendar where isodow(trade_date) = 1 and day(trade_date) = 1)
select d::varchar as trade_date, case when c.trade_date is null then 'outside_calendar' when c.is_open and i.trade_date is null then 'open_without_index' when not c.is_open and i.trade_date is not null then 'closed_with_index' end as conflict
from d left join full_cal c on c.trade_date = d.d left join i on i.trade_date = d.d where conflict is not null""")
def _(m):
    odd = m.trading_calendar.where((F.weekday("trade_date") == 0) & (F.dayofmonth("trade_date") == 1)).select(F.date_add("trade_date", 6).alias("trade_date"))
    return q.calendar_conflicts(m.full_cal, m.index_h.select("trade_date").union(odd).distinct(), "CN", "1994-12-25", "2001-12-31")


@query("v13_market_day_status", """
select s.m as market, s.a_date::varchar as trade_date, case when c.trade_date is null then 'missing' when c.is_open then 'open' else 'closed' end as status
from (select distinct case when event_type = 'click' then 'HK' else 'CN' end as m, a_date from study_events) s left join full_cal c on c.market = s.m and c.trade_date = s.a_date""")
def _(m):
    days = m.study_events.select(F.when(F.col("event_type") == "click", "HK").otherwise("CN").alias("market"), F.col("a_date").alias("trade_date")).distinct()
    return q.market_day_status(days, m.full_cal)


# titles: full text, abstract, revised and English variants, at different dates
view("titles", """
with r as (select symbol, period_end, period_type, fiscal_year, q, available_date, case q when 4 then fiscal_year || '年年度报告' when 2 then fiscal_year || '年半年度报告' when 1 then fiscal_year || '年第一季度报告' else fiscal_year || '年三季度报告' end as t from reports)
select symbol, t || '摘要' as title, (available_date - 9)::date as d from r union all select symbol, '公司' || t, (available_date - 5)::date from r where q <> 3
union all select symbol, t, (available_date - 4)::date from r where q = 4 union all select symbol, t || '（修订版）', (available_date - 20)::date from r union all select symbol, t || '英文版', (available_date - 21)::date from r""")
view("disclosed", """
select symbol, period_end, period_type, available_date, (available_date - case when q = 3 then 9 else 5 end)::date as d, case when q = 3 then 'abstract' else 'full' end as tier from reports""")


def titles(m):
    fy = F.col("fiscal_year").cast("string")
    t = F.concat(fy, F.when(F.col("q") == 4, "年年度报告").when(F.col("q") == 2, "年半年度报告").when(F.col("q") == 1, "年第一季度报告").otherwise("年三季度报告"))
    v = lambda title, d, ok=F.lit(True): F.when(ok, F.struct(title.alias("title"), F.date_sub("available_date", d).alias("ann_date")))
    rows = F.array_compact(F.array(v(F.concat(t, F.lit("摘要")), 9), v(F.concat(F.lit("公司"), t), 5, F.col("q") != 3), v(t, 4, F.col("q") == 4),
                                   v(F.concat(t, F.lit("（修订版）")), 20), v(F.concat(t, F.lit("英文版")), 21)))
    return m.reports.select("symbol", F.explode(rows).alias("r")).select("symbol", "r.*")


REPS = ["symbol", "period_end", "period_type", "fiscal_year", "available_date"]


@query("v14_match_disclosures", "select symbol, period_end::varchar as period_end, period_type, d::varchar as disclosed_on, tier from disclosed")
def _(m):
    return q.match_disclosures(m.reports.select(*REPS), titles(m)).select("symbol", "period_end", "period_type", "disclosed_on", "tier")


@query("v15_backfill_pit", """
select symbol, period_end::varchar as period_end, strftime(d::timestamp - interval 8 hour, '%Y-%m-%d %H:%M:%S') as new_published_at, true as matched,
  (case when n is null or n - d > 41 then (d + 41)::date else n end)::varchar as new_available_on from (select *, (select min(trade_date) from trading_calendar t where t.trade_date > d) as n from disclosed) x""")
def _(m):
    return q.backfill_pit(m.reports.select(*REPS), titles(m), m.spine).select("symbol", "period_end", "new_published_at", "matched", "new_available_on")


# stored: a publication date at local midnight or none
@query("v15_pit_revisions", """
select symbol, period_end::varchar as period_end, period_type,
  '{' || coalesce('"published_at":"' || strftime(published_at::timestamp - interval 8 hour, '%Y-%m-%d %H:%M:%S') || '",', '') || '"available_on":"' || available_date || '"}' as old_value,
  '{"published_at":"' || strftime(d::timestamp - interval 8 hour, '%Y-%m-%d %H:%M:%S') || '","available_on":"' || na || '","title":"' || title || '","tier":"' || tier || '"}' as new_value
from (select x.*, r.published_at, case when n is null or n - d > 41 then (d + 41)::date else n end as na, case when x.q = 3 then t || '摘要' else '公司' || t end as title
  from (select d.*, p.q, p.t, (select min(trade_date) from trading_calendar c where c.trade_date > d.d) as n from disclosed d join (select symbol, period_end, period_type, q,
    case q when 4 then fiscal_year || '年年度报告' when 2 then fiscal_year || '年半年度报告' when 1 then fiscal_year || '年第一季度报告' else fiscal_year || '年三季度报告' end as t from reports) p using (symbol, period_end, period_type)) x
  join (select symbol, period_end, period_type, published_at from rep where revision = 1) r using (symbol, period_end, period_type)) y""")
def _(m):
    stored = m.rep.where("revision = 1").select(*REPS, q.local_midnight_utc("published_at", "Asia/Shanghai").alias("published_at"))
    return q.pit_revisions(q.backfill_pit(stored, titles(m), m.spine))
