"""Statements, snapshots, announcements, news, flow events, calendars and tables in cells."""
from pyspark.sql import functions as F

from tapeloom.functions.columns import r
from tapeloom.operators import quality as q
from tapeloom.plans.bar_queries import rounded
from tapeloom.plans import raw_zone
from tapeloom.plans.registry import query, view
from tapeloom.session import work_folder
from tapeloom.sources import files, messages as ms, reports as rp

view("vsym", """
select distinct symbol, case when n % 5 = 0 then lpad(n::varchar, 5, '0') else (n + 600000)::varchar end as code, case when n % 5 = 0 then '31' else '1' end as setcode,
  case when n % 5 = 0 then lpad(n::varchar, 5, '0') || '.HK' else (n + 600000)::varchar || '.SH' end as sym from (select symbol, cast(substring(symbol, 7) as int) as n from reports) x""")


def vsym(x):
    n = F.substring("symbol", 7, 9).cast("int")
    hk = n % 5 == 0
    code = F.when(hk, F.lpad(n.cast("string"), 5, "0")).otherwise((n + 600000).cast("string"))
    return x.withColumns({"code": code, "setcode": F.when(hk, "31").otherwise("1"), "sym": F.concat(code, F.when(hk, ".HK").otherwise(".SH"))})


def s(e):
    return (F.col(e) if isinstance(e, str) else e).cast("string")


def rep1(m):
    return vsym(m.rep.where("revision = 1"))


IS_FILE = lambda: F.concat(F.lit("data/raw/v/financials/2001-12-31/run1/"), "sym", F.lit("_is_"), F.date_format("period_end", "yyyyMMdd"), F.lit(".csv"))


@query("s11_parse_income_a", """
select v.sym as symbol, period_end::varchar as period_end, period_type, case when fiscal_year <= 1999 then 2 else 1 end as revision, revenue::double as revenue, np::double as net_profit_attr, (q/10.0)::double as eps_basic
from rep join vsym v using (symbol) where revision = 1 and (fiscal_year > 1999 or q = 3)""")
def _(m):
    x = rep1(m)
    raw = x.select(IS_FILE().alias("file_path"), F.col("sym").alias("thscode"), F.when(F.col("q") == 1, "").otherwise(s("revenue")).alias("ths_operating_total_revenue_stock"),
                   s("revenue").alias("ths_revenue_stock"), s("net_profit_attr").alias("ths_np_atoopc_stock"), s(F.col("q") / 10).alias("ths_basic_eps_stock"), F.lit("NA").alias("ths_dlt_earnings_per_share_stock"))
    d = lambda e, n: e.cast("decimal(38,10)").alias(n)
    cur = x.where("fiscal_year <= 1999").select(F.col("sym").alias("symbol"), "period_end", "period_type", "is_cumulative", F.lit(1).alias("revision"), d(F.col("revenue"), "revenue"),
                                               d(F.col("net_profit_attr") + F.when(F.col("q") == 3, 5).otherwise(0), "net_profit_attr"), d(F.col("q") / 10, "eps_basic"), d(F.lit(None), "eps_diluted"))
    return rp.parse_income_a(raw, cur).select("symbol", "period_end", "period_type", "revision", "revenue", "net_profit_attr", "eps_basic")


def income_b(m):
    x = rep1(m)
    unit = F.when(F.col("q") == 1, "yuan").when(F.col("q") == 2, "万元").when(F.col("q") == 3, "百万元").otherwise("zzz")
    path = F.when(F.col("q") == 2, "data/raw/v/financials/2001-12-31/run1/batch.csv").otherwise(IS_FILE())
    return x, rp.parse_income_b(x.select(path.alias("file_path"), "code", "setcode", s("period_end").alias("period_end"), s("revenue").alias("revenue"), s("net_profit_attr").alias("net_profit_attr"),
                                         s(F.col("q") / 10).alias("eps_basic"), F.lit("").alias("eps_diluted"), F.lit("").alias("currency"), unit.alias("unit"), F.lit("1").alias("is_cumulative"),
                                         F.when(F.col("q") == 4, s("available_date")).otherwise("").alias("published_at")))


MULT = "case q when 2 then 10000 when 3 then 1000000 else 1 end"


@query("s12_parse_income_b", f"""
select v.sym as symbol, period_end::varchar as period_end, period_type, (revenue * {MULT})::double as revenue, (np * {MULT})::double as net_profit_attr, (q/10.0)::double as eps_basic, q = 4 as unit_unknown,
  case when q = 4 then available_date::varchar end as published_on from rep join vsym v using (symbol) where revision = 1""")
def _(m):
    _, x = income_b(m)
    return x.select("symbol", "period_end", "period_type", "revenue", "net_profit_attr", "eps_basic", "unit_unknown", "published_on")


@query("s12_fill_published", "select v.sym as symbol, period_end::varchar as period_end, 1 as revision, available_date::varchar as published_on from rep join vsym v using (symbol) where revision = 1 and q = 4 and fiscal_year < 1999")
def _(m):
    _, x = income_b(m)
    none = F.lit(None).cast("date")
    cur = x.where("fiscal_year < 2000").select(*rp.REPORT_KEY, F.lit(1).alias("revision"), none.alias("published_on"), "revenue",
                                               F.when(F.col("fiscal_year") == 1999, F.col("net_profit_attr") + 1).otherwise(F.col("net_profit_attr")).cast("decimal(38,6)").alias("net_profit_attr"), "eps_basic", "eps_diluted")
    return rp.fill_published(cur, x).select("symbol", "period_end", "revision", "published_on")


# stored before the delivery of the last day of 2001: annual and half-year reports to 1999, those of 1999 with another profit, undated but for half-years
LANDED = "2001-12-31"
view("history", f"""
with n as (select v.sym, v.symbol, period_end, period_type, fiscal_year, q, (revenue * {MULT})::double as revenue, (np * {MULT})::double as np, case when q = 4 then available_date end as pub from rep join vsym v using (symbol) where revision = 1),
o as (select *, case when q = 2 then (period_end + 40)::date end as opub, (period_end + 50)::date as oav from n where fiscal_year < 2000 and q in (2, 4)),
d as (select n.*, case when v.sym like '%.HK' then (pub + 1)::date else case when t.x is null or t.x - pub > 41 then (pub + 41)::date else t.x end end as pav
  from n join (select distinct sym from vsym) v using (sym) left join (select r.pub as p, (select min(trade_date) from trading_calendar c where c.trade_date > r.pub) as x from (select distinct pub from n) r) t on t.p = n.pub)
select sym, period_end, period_type, 1 as revision, case when fiscal_year = 1999 then np + 1 else np end as np, coalesce(opub, case when fiscal_year < 1999 then pub end) as published_on,
  case when opub is null and fiscal_year < 1999 and pub is not null then pav else oav end as available_on,
  case when opub is null and fiscal_year < 1999 and pub is not null then 'date' else 'keep' end as action, opub as before_published_on, oav as before_available_on from o join (select sym, period_end, pav from d) x using (sym, period_end)
union all select sym, period_end, period_type, case when fiscal_year = 1999 and q in (2, 4) then 2 else 1 end, np, pub, coalesce(pav, date '{LANDED}'), 'insert', null, null from d
  where fiscal_year > 1999 or (fiscal_year = 1999) or q in (1, 3)""")


def history(m):
    _, x = income_b(m)
    x = x.withColumn("ingested_on", F.lit(LANDED).cast("date"))
    half = F.month("period_end") == 6
    cur = x.where("fiscal_year < 2000 and month(period_end) in (6, 12)").select(
        *rp.REPORT_KEY, F.lit(1).alias("revision"), *[F.col(v) if v != "net_profit_attr" else F.when(F.col("fiscal_year") == 1999, F.col(v) + 1).otherwise(F.col(v)).cast("decimal(38,6)").alias(v) for v in rp.FACTS],
        F.when(half, F.date_add("period_end", 40)).alias("published_on"), F.date_add("period_end", 50).alias("available_on"))
    return q.revise(cur, x, rp.REPORT_KEY, rp.FACTS, m.spine)


@query("s12_revisions", "select sym as symbol, period_end::varchar as period_end, period_type, revision, np as net_profit_attr, published_on::varchar as published_on, available_on::varchar as available_on, action from history")
def _(m):
    return history(m).select("symbol", "period_end", "period_type", "revision", "net_profit_attr", "published_on", "available_on", "action")


@query("s12_revision_log", """
select sym as symbol, period_end::varchar as period_end, period_type, revision, action, case when action = 'date' then '{"available_on":"' || before_available_on || '"}' end as old_value,
  '{' || coalesce('"published_on":"' || published_on || '",', '') || '"available_on":"' || available_on || '"}' as new_value from history where action <> 'keep'""")
def _(m):
    return q.revision_log(history(m), rp.REPORT_KEY).drop("is_cumulative")


@query("s12_known_on", """
select sym as symbol, period_end::varchar as period_end, period_type, revision, np as net_profit_attr, available_on::varchar as available_on from history where available_on <= date '2000-06-30'
qualify row_number() over (partition by sym, period_end, period_type order by revision desc) = 1""")
def _(m):
    return q.known_on(history(m), rp.REPORT_KEY, "2000-06-30").select("symbol", "period_end", "period_type", "revision", "net_profit_attr", "available_on")


@query("s13_parse_statement", """
select v.sym as symbol, b.period_end::varchar as period_end, b.period_type, year(b.period_end) < 1997 as created, case when year(b.period_end) < 1997 then 1 when b.period_type = 'interim' then 2 else 1 end as revision,
  total_assets::double as total_assets, stb::double as short_term_borrowing from balance b join vsym v using (symbol)""")
def _(m):
    x = vsym(m.balance)
    blank = [F.lit("").alias(f) for f in rp.BALANCE_FIELDS if f not in ("total_assets", "total_liabilities", "short_term_borrowing")]
    raw = x.select("code", "setcode", s("period_end").alias("period_end"), s("total_assets").alias("total_assets"), s("total_liabilities").alias("total_liabilities"),
                   s("short_term_borrowing").alias("short_term_borrowing"), *blank, F.lit("").alias("currency"))
    empty = x.select("code", "setcode", F.lit("1990-12-31").alias("period_end"), *[F.lit("NA").alias(f) for f in rp.BALANCE_FIELDS], F.lit("").alias("currency"))
    heads = vsym(m.rep.where("fiscal_year >= 1997")).select(F.col("sym").alias("symbol"), "period_end", "period_type", "is_cumulative", "revision")
    rows, _ = rp.parse_statement(raw.unionByName(empty), rp.BALANCE_FIELDS, heads)
    return rows.select("symbol", "period_end", "period_type", "created", "revision", "total_assets", "short_term_borrowing")


def cash_flow(m):
    """Real files of five amounts; periods before 1998 have no report yet, one row in four is empty."""
    x = vsym(m.cash)
    d = lambda e: s(e.cast("decimal(20,2)"))
    gone = F.year("period_end") % 4 == 0
    amounts = {"ocf": d(F.col("ocf")), "capex": d(F.col("capex")), "icf": d(-F.col("ocf") / 2), "financing_cf": F.lit("NA"), "net_cash_increase": d(F.col("ocf") - F.col("capex"))}
    rows = x.select(*raw_zone.places("akshare", "cash_flow", F.concat("sym", F.lit("_cf_all"))), F.unix_date("period_end").alias("row_no"), "code", "setcode", s("period_end").alias("period_end"),
                    F.lit("").alias("currency"), *[F.when(gone, "").otherwise(v).alias(k) for k, v in amounts.items()])
    found = files.scan(m.spark, raw_zone.deliver(rows, work_folder(m.spark)), "akshare/cash_flow")
    heads = vsym(m.rep.where("fiscal_year >= 1998")).select(F.col("sym").alias("symbol"), "period_end", "period_type", "is_cumulative", "revision")
    return rp.parse_statement(files.read_layout(found, ["code", "setcode", "period_end", "currency", *rp.CASH_FIELDS]), rp.CASH_FIELDS, heads)


view("cash_src", """
select v.sym, v.symbol, r.period_end, r.period_type, r.q, year(r.period_end) < 1998 as created, r.np * 2 as ocf, 250000 as capex from rep r join vsym v using (symbol)
where revision = 1 and q <> 3 and year(r.period_end) % 4 <> 0""")


@query("s13_cash_flow", """
select sym as symbol, period_end::varchar as period_end, period_type, created, case when not created and q = 2 then 2 else 1 end as revision, ocf::double as ocf, capex::double as capex,
  round(-ocf::double / 2, 1) as icf, null::double as financing_cf, (ocf - capex)::double as net_cash_increase from cash_src""")
def _(m):
    rows, _ = cash_flow(m)
    return rows.select("symbol", "period_end", "period_type", "created", "revision", "ocf", "capex", r(F.col("icf").cast("double"), 1).alias("icf"), "financing_cf", "net_cash_increase")


@query("s13_degraded_headers", "select sym as symbol, period_end::varchar as period_end, period_type, 1 as revision, 'CNY' as currency from cash_src where created")
def _(m):
    return cash_flow(m)[1]


def abstract_raw(m):
    x = rep1(m)
    row = lambda g, i, v: F.struct(F.lit(g).alias("group"), F.lit(i).alias("indicator"), v.alias("value"))
    rows = F.array(row("常用指标", "归母净利润", s((F.col("net_profit_attr") * 1.01).cast("decimal(24,2)"))), row("常用指标", "营业总收入", s("revenue")),
                   row("常用指标", "基本每股收益", s(F.col("q") / 10)), row("盈利能力", "毛利率", F.when(F.col("q") == 2, "nan").otherwise(s("q"))))
    return x.select(F.concat(F.lit("raw/akshare/fin_abstract/d/r/"), "sym", F.lit("_abstract.csv")).alias("file_path"), s("period_end").alias("period_end"), F.explode(rows).alias("r")).select("file_path", "period_end", "r.*")


view("abs_src", "select v.sym, r.* from rep r join vsym v using (symbol) where revision = 1 and v.sym like '%.SH'")


@query("s14_fold_abstract", """
select sym as symbol, period_end::varchar as period_end, round(np::double * 1.01, 1) as net_profit_attr, revenue::double as revenue, (q/10.0)::double as eps_basic, case when q <> 2 then q::double end as gross_margin, case when q = 2 then 1 else 2 end as groups from abs_src""")
def _(m):
    """From real files, whose names carry the symbol."""
    rows = abstract_raw(m).select(*raw_zone.places("akshare", "fin_abstract", F.regexp_extract("file_path", r"([^/]+)\.csv$", 1)), F.monotonically_increasing_id().alias("row_no"), "period_end", "group", "indicator", "value")
    found = files.scan(m.spark, raw_zone.deliver(rows, work_folder(m.spark)), "akshare/fin_abstract")
    snap = rp.fold_abstract(files.read_layout(found, ["period_end", "group", "indicator", "value"]))
    x = rp.abstract_income(snap).join(snap.select("symbol", "period_end", F.col("payload")["盈利能力"]["毛利率"].alias("gross_margin"), F.size("payload").alias("groups")), ["symbol", "period_end"])
    return x.select("symbol", "period_end", r(F.col("net_profit_attr").cast("double"), 1).alias("net_profit_attr"), "revenue", "eps_basic", "gross_margin", "groups")


def stored_facts(m):
    d = lambda e, n: e.cast("decimal(38,10)").alias(n)
    x = rep1(m)
    empty = (F.col("q") == 1) & (F.col("fiscal_year") < 1998)
    return x.where("fiscal_year >= 1996").select(F.col("sym").alias("symbol"), "period_end", d(F.when(~empty, F.col("net_profit_attr") * F.when(F.col("q") == 3, 1.01).otherwise(1.0)), "net_profit_attr"),
                                                d(F.when(~empty, F.col("revenue") * F.when(F.col("q") == 4, 2).otherwise(1)), "revenue"), d(F.lit(None), "eps_basic"))


@query("s15_reconcile", """
select sym as symbol, period_end::varchar as period_end, 'net_profit_attr' as field from abs_src where fiscal_year >= 1996 and q <> 3 and np <> 0 and not (q = 1 and fiscal_year < 1998)
union all select sym, period_end::varchar, 'revenue' from abs_src where fiscal_year >= 1996 and q = 4""")
def _(m):
    return rp.reconcile(rp.abstract_income(rp.fold_abstract(abstract_raw(m))), stored_facts(m)).select("symbol", "period_end", "field")


@query("s16_backfill_nulls", """
with f as (select v.sym, r.*, q = 1 and fiscal_year < 1998 as empty from rep r join vsym v using (symbol) where revision = 1 and fiscal_year >= 1996)
select coalesce(f.sym, a.sym) as symbol, coalesce(f.period_end, a.period_end)::varchar as period_end,
  round(case when f.sym is null or f.empty then a.revenue::double when f.q = 4 then f.revenue::double * 2 else f.revenue::double end, 2) as revenue,
  case when f.sym is null or f.empty then (a.q/10.0)::double end as eps_basic, (f.sym is null or f.empty) and a.sym is not null as filled
from f full outer join abs_src a on a.sym = f.sym and a.period_end = f.period_end""")
def _(m):
    x = rp.backfill_nulls(stored_facts(m), rp.abstract_income(rp.fold_abstract(abstract_raw(m))))
    return x.select("symbol", "period_end", r(F.col("revenue").cast("double"), 2).alias("revenue"), "eps_basic", "filled")


@query("s17_parse_holders", """
select sym as symbol, period_end::varchar as stat_date, case when fiscal_year >= 2000 then 'insert' when q = 2 then 'update' else 'same' end as action, floor(revenue::double/1000) as holder_count, floor(np::double/1000) as holder_count_delta from abs_src where q <> 3""")
def _(m):
    x = rep1(m)
    raw = x.select(F.concat(F.lit("raw/akshare/gdhs/d/r/"), "sym", F.lit("_gdhs.csv")).alias("file_path"), s("period_end").alias("stat_date"),
                   F.when(F.col("q") == 3, "").otherwise(s(F.col("revenue") / 1000)).alias("holder_count"), F.lit("").alias("holder_count_prev"), s(F.col("net_profit_attr") / 1000).alias("holder_count_delta"),
                   *[F.lit("").alias(k) for k in rp.HOLDER_FIELDS[3:]], s("available_date").alias("announced_at"))
    none = F.lit(None).cast("double")
    cur = x.where("fiscal_year < 2000 and q <> 3 and sym like '%.SH'").select(
        F.col("sym").alias("symbol"), F.col("period_end").alias("stat_date"), (F.floor((F.col("revenue") / 1000).cast("double")) + F.when(F.col("q") == 2, 1).otherwise(0)).cast("double").alias("holder_count"),
        none.alias("holder_count_prev"), F.floor((F.col("net_profit_attr") / 1000).cast("double")).cast("double").alias("holder_count_delta"), *[none.alias(k) for k in rp.HOLDER_FIELDS[3:]], s("available_date").alias("announced_at"))
    raw = raw.withColumns({"holder_count": F.when(F.col("holder_count") != "", "1").otherwise(""), "row_no": F.lit(1)}).unionByName(raw.withColumn("row_no", F.lit(2)))
    return rp.parse_holders(raw, cur).select("symbol", "stat_date", "action", "holder_count", "holder_count_delta")


@query("s18_parse_forecast", """
select v.sym as symbol, '2001-12-31' as snapshot_at, count(*)::int as n_rows, arg_min((np*2)::double, period_end) as first_fy1 from rep r join vsym v using (symbol) where revision = 1 group by 1""")
def _(m):
    x = rep1(m)
    raw = x.select(F.concat(F.lit("f/"), "sym", F.lit(".csv")).alias("file_path"), F.datediff("period_end", F.lit("1970-01-01")).alias("row_no"), F.when(F.col("q") == 1, "").otherwise(F.col("sym")).alias("thscode"),
                   s((F.col("net_profit_attr") * 2).cast("decimal(24,2)")).alias("ths_fore_np_fy1_stock"))
    cols = ["thscode", "ths_fore_np_fy1_stock"]
    rows = raw.select(*raw_zone.places("stock_finance_data", "forecast", F.regexp_extract("file_path", r"([^/]+)\.csv$", 1)), "row_no", *cols)
    found = files.scan(m.spark, raw_zone.deliver(rows, work_folder(m.spark)), "stock_finance_data/forecast")
    y = rp.parse_forecast(files.read_layout(found, cols), "2001-12-31")
    fy1 = F.get_json_object("payload_json", "$.ths_fore_np_fy1_stock").cast("double")
    return y.groupBy("symbol", "snapshot_at").agg(F.count("*").cast("int").alias("n_rows"), F.min_by(fy1, "row_no").alias("first_fy1"))


view("first_bar", "select v.sym, v.symbol, min(b.trade_date) as d, sum(volume_raw) as vol, cast(substring(v.symbol, 7) as int) as n from vsym v left join daily_bars b on b.symbol = v.symbol group by 1, 2")


@query("s19_parse_shares", """
select sym as symbol, d::varchar as effective_at, (vol * 1000)::double as shares, case when n % 3 = 0 then 'insert' when n % 3 = 1 then 'skip' else 'conflict' end as outcome from first_bar where d is not null""")
def _(m):
    b = vsym(m.daily_bars).withColumn("symbol", F.col("sym"))
    g = vsym(m.daily_bars.groupBy("symbol").agg(F.sum("volume_raw").alias("v"), F.min("trade_date").alias("d")))
    raw = g.select(F.col("sym").alias("thscode"), s((F.col("v") * 1000).cast("decimal(24,0)")).alias("ths_total_shares_stock"))
    n = F.substring("symbol", 7, 9).cast("int") % 3
    cur = g.where(n != 0).select(F.col("sym").alias("symbol"), F.col("d").alias("effective_at"), (F.col("v") * 1000 + F.when(n == 2, 1).otherwise(0)).alias("shares"), F.lit("group_total").alias("share_count_type"))
    return rp.parse_shares(raw, b, cur)


@query("s20_parse_quotes", """
select v.sym as symbol, e.eff::varchar as effective_at, e.shares::bigint as shares from (select * from share_events where kind = 'issued' and y <> 1999) e join vsym v using (symbol)""")
def _(m):
    x = vsym(m.share_events.where("share_count_type = 'issued'"))
    raw = x.select("code", "setcode", F.when(F.year("effective_at") == 1997, "").otherwise(s("effective_at")).alias("snapshot_at"), F.date_format("effective_at", "yyyyMMdd").alias("hqdate"),
                   s((F.col("shares") / 10000).cast("decimal(24,4)")).alias("zgb"))
    bad = raw.withColumns({"zgb": F.lit("0"), "snapshot_at": F.lit("1990-01-01")})
    cur = x.where("year(effective_at) = 1999").select(F.col("sym").alias("symbol"), "effective_at")
    return rp.parse_quotes(raw.unionByName(bad), cur).drop("share_count_type")


# ------------------------------------------------------------------------------------------- announcements

view("ann", "select a.*, v.sym, v.code, v.setcode, 'Notice ' || event_type || ' ' || floor(value / 50)::int || ' ' || v.sym as title from announcements a join vsym v using (symbol)")
EVT = lambda src, key: f"'evt_' || substring(sha256('{src}|' || {key}), 1, 16)"
AVAIL = "case when sym like '%.HK' then (d + 1)::date when n is null or n - d > 41 then (d + 41)::date else n end"
UTC8 = lambda e: f"strftime({e}::timestamp - interval 8 hour, '%Y-%m-%d %H:%M:%S')"


def ann(m):
    x = vsym(m.announcements)
    return x.withColumn("title", F.concat(F.lit("Notice "), "event_type", F.lit(" "), F.floor(F.col("value") / 50).cast("int").cast("string"), F.lit(" "), "sym"))


@query("s21_parse_disclosure", f"""
with g as (select sym, title, a_date as d, min(event_type) as et from ann group by 1, 2, 3), x as (select *, (select min(trade_date) from trading_calendar t where t.trade_date > d) as n from g)
select {EVT('tdx', "title || '|' || d::varchar")} as event_id, sym as symbol, title, {UTC8('d')} as published_at, {UTC8(AVAIL)} as available_at, et as summary from x""")
def _(m):
    x = ann(m)
    path = F.concat(F.lit("raw/tdx/announcement/d/r/"), F.when(F.col("setcode") == "31", "batch").otherwise(F.col("sym")), F.lit("_p1.csv"))
    raw = x.select(path.alias("file_path"), "code", "setcode", "title", F.concat(s("a_date"), F.lit(" 00:00:00")).alias("time"), F.lit("").alias("url"), F.lit("").alias("summary"), F.col("event_type").alias("source"))
    return ms.parse_disclosure(raw, "tdx", m.spine).select("event_id", "symbol", "title", "published_at", "available_at", "summary")


@query("s22_parse_ann_uuid", f"""
with a as (select *, 'raw/t/' || sym || '_p' || day(a_date) || '.csv' as f from ann where sym like '%.SH'),
o as (select *, case when value > 330 then 'conflict' when event_type = 'signup' and value < 10 then 'skip' else 'ok' end as outcome from a),
k as (select * from o where outcome = 'ok' and f not in (select f from o where outcome = 'conflict')),
u as (select (event_id // 2) as uid, arg_min(sym, sym || '#' || title) as sym, arg_min(title, sym || '#' || title) as title, arg_min(a_date, sym || '#' || title) as d from k group by 1),
x as (select *, (select min(trade_date) from trading_calendar t where t.trade_date > d) as n from u)
select {EVT('tianyancha', "'u' || uid")} as event_id, sym as symbol, title, d::varchar as pub_date, {UTC8(AVAIL)} as available_at from x""")
def _(m):
    x = ann(m).where("sym like '%.SH'")
    other = F.when(F.col("value") > 330, "999999").when((F.col("event_type") == "signup") & (F.col("value") < 10), "HK.03288").otherwise(F.col("code"))
    raw = x.select(F.concat(F.lit("raw/t/"), "sym", F.lit("_p"), F.dayofmonth("a_date").cast("string"), F.lit(".csv")).alias("file_path"), "title", s("a_date").alias("time"),
                   F.concat(F.lit("u"), F.floor(F.col("event_id") / 2).cast("string")).alias("uuid"), other.alias("stock_code"))
    return ms.parse_ann_uuid(raw, m.spine)[0].select("event_id", "symbol", "title", "pub_date", "available_at")


@query("s23_parse_ann_alias", f"""
with b as (select *, case when event_type = 'view' then title || '|' || a_date::varchar else 'q' || event_id end as k from ann),
g as (select k, min(sym) as sym, min(title) as title, min(a_date) as d from b group by 1), x as (select *, (select min(trade_date) from trading_calendar t where t.trade_date > d) as n from g)
select {EVT('stock_finance_data', 'k')} as event_id, sym as symbol, title, d::varchar as pub_date, {UTC8(AVAIL)} as available_at from x""")
def _(m):
    x = ann(m)
    seq = F.when(F.col("event_type") == "view", "").otherwise(F.concat(F.lit("q"), s("event_id")))
    raw = x.select(F.concat(F.lit("raw/"), "sym", F.lit(".csv")).alias("file_path"), s("a_date").alias("reportDate"), F.lit("").alias("time"), F.col("title").alias("ReportTitle"), F.lit("").alias("pdfURL"),
                   seq.alias("SEQ"), F.when((F.col("event_type") == "click") & F.endswith("sym", F.lit(".SH")), "").otherwise(F.col("sym")).alias("thscode"))
    return ms.parse_ann_alias(raw, m.spine).select("event_id", "symbol", "title", "pub_date", "available_at")


view("feed", """
select doc_id as row_no, 'News ' || (doc_id % 50) as title, text as content, case when doc_id % 3 = 0 then null else 'cls_' || (doc_id // 4) end as ext, case when doc_id % 5 = 0 then null else sha256(text) end as h from documents""")
view("feed_new", """
select *, row_number() over (order by row_no) as k from feed f where not exists (select 1 from labels l join feed o on o.row_no = l.doc_id and l.quality = 0 where o.ext = f.ext)
  and not exists (select 1 from labels l join feed o on o.row_no = l.doc_id and l.quality = 0 where o.h = f.h)""")
view("feed_kept", """
select * from (with recursive d as materialized (select k, row_no, ext, h from feed_new), s as (
  select 0::bigint as k, null::bigint as row_no, false as kept, []::varchar[] as es, []::varchar[] as hs
  union all select d.k, d.row_no, not (coalesce(list_contains(s.es, d.ext), false) or coalesce(list_contains(s.hs, d.h), false)),
    case when not (coalesce(list_contains(s.es, d.ext), false) or coalesce(list_contains(s.hs, d.h), false)) and d.ext is not null then list_append(s.es, d.ext) else s.es end,
    case when not (coalesce(list_contains(s.es, d.ext), false) or coalesce(list_contains(s.hs, d.h), false)) and d.h is not null then list_append(s.hs, d.h) else s.hs end
  from s join d on d.k = s.k + 1) select row_no from s where kept)""")


def feed(m):
    i = F.col("doc_id")
    return m.table("documents").select(
        i.alias("row_no"), F.concat(F.lit("News "), s(i % 50)).alias("title"), F.col("text").alias("content"), F.lit("2024-01-01T00:00:00+00:00").alias("published_at"), F.lit("").alias("summary"),
        F.when(i % 3 == 0, "").otherwise(F.concat(F.lit("cls_"), s(F.floor(i / 4)))).alias("source_external_id"), F.when(i % 5 == 0, "").otherwise(F.sha2("text", 256)).alias("content_hash"))


@query("s24_parse_news", f"""
select f.row_no, f.title, case when f.ext is not null then {EVT('akshare', 'f.ext')} when f.h is not null then {EVT('akshare', 'f.h')} else {EVT('akshare', 'f.title')} end as event_id,
  substring(trim(f.content), 1, 120) as summary, 4 as source_tier from feed_kept k join feed f using (row_no)
qualify row_number() over (partition by coalesce(f.ext, f.h, f.title) order by f.row_no) = 1""")
def _(m):
    x = feed(m)
    known = x.join(m.table("labels").where("quality = 0").select(F.col("doc_id").alias("row_no")), "row_no", "left_semi").select(
        q.text("source_external_id").alias("ext_id"), q.text("content_hash").alias("content_hash"))
    return ms.parse_news(x, known).select("row_no", "title", "event_id", "summary", "source_tier")


@query("s25_match_entities", """
with t as (select doc_id as event_id, 'T ' || text || case when doc_id % 3 = 0 then ' x' || (600000 + doc_id % 40) || '.SH 600' || lpad((doc_id % 40)::varchar, 3, '0') || '.SZ,' else '' end as txt from documents),
w as (select symbol, case n % 4 when 0 then 'elle est' when 1 then 'thand' when 2 then 'und ' else '' end as term from (select distinct symbol, cast(substring(symbol, 7) as int) as n from daily_bars) z where n % 6 <> 5
  union all select symbol, 'que' || (n % 3) from (select distinct symbol, cast(substring(symbol, 7) as int) as n from daily_bars) z where n % 6 <> 5)
select distinct event_id, symbol from t join w on w.term <> '' and contains(txt, w.term)
union select event_id, '600' || lpad((event_id % 40)::varchar, 3, '0') || '.SZ' from t where event_id % 3 = 0""")
def _(m):
    i = F.col("doc_id")
    tail = F.when(i % 3 == 0, F.concat(F.lit(" x"), s(600000 + i % 40), F.lit(".SH 600"), F.lpad(s(i % 40), 3, "0"), F.lit(".SZ,"))).otherwise("")
    news = m.table("documents").select(i.alias("event_id"), F.lit("T").alias("title"), F.concat("text", tail).alias("content"))
    n = F.substring("symbol", 7, 9).cast("int")
    name = F.when(n % 4 == 0, "elle est").when(n % 4 == 1, "thand").when(n % 4 == 2, "und ").otherwise("")
    watch = m.symbols.select("symbol", name.alias("name"), F.array(F.concat(F.lit("que"), s(n % 3))).alias("aliases"), (n % 6 != 5).alias("active"))
    return ms.match_entities(news, watch)


@query("s26_flow_lhb", f"""
with x as (select sym, a_date as d, event_id, event_type, ((value::decimal(18,2))*1000000 - 50003000)::decimal(18,0) as net, round(value, 0)::int as ratio from ann),
f as (select * from x qualify row_number() over (partition by sym, d order by event_id) = 1),
g as (select sym, d, string_agg(event_type, '；' order by e) as reasons from (select sym, d, event_type, min(event_id) as e from x group by 1, 2, 3) y group by 1, 2)
select {EVT('akshare|lhb', "'lhb:' || f.sym || ':' || f.d::varchar")} as event_id, f.sym as symbol, f.d::varchar as trade_date, '龙虎榜上榜（' || reasons || '）' as title,
  case when net < 0 then '净卖出 ' else '净买入 ' end || printf('%.2f', net::double/1e8) || ' 亿元；占成交比 ' || ratio || '%' as summary from f join g using (sym, d)""")
def _(m):
    x = ann(m).select(F.col("sym").alias("symbol"), F.col("a_date").alias("trade_date"), F.col("event_type").alias("reason"), F.col("event_id").alias("row_no"),
                      s((F.col("value").cast("decimal(18,2)") * 1000000 - 50003000).cast("decimal(18,0)")).alias("net_buy"), s(F.round("value", 0).cast("int")).alias("net_buy_ratio"), F.lit(None).cast("string").alias("pct_chg"))
    return ms.flow_lhb(x)


@query("s27_flow_block", f"""
with y as (select p_brand as sym, l_shipdate::date as d, l_extendedprice::decimal(18,2)::varchar as price, l_quantity::int::varchar as vol, l_discount::decimal(6,2)::varchar as prem, l_extendedprice*1000 as amt,
  'B' || l_suppkey as buyer, l_orderkey * 100 + l_linenumber as row_no from lineitem join part on p_partkey = l_partkey),
x as (select * from y qualify row_number() over (partition by sym, d, price, vol order by row_no, prem, buyer) = 1)
select {EVT('akshare|dzjy', "'dzjy:' || sym || ':' || d::varchar || ':' || price || ':' || vol")} as event_id, sym as symbol, d::varchar as trade_date, '大宗交易：成交价 ' || price || '（折溢价 ' || prem || '%）' as title,
  '成交量 ' || vol || ' 股；成交额 ' || printf('%.2f', amt/1e8) || ' 亿元；买方 ' || buyer as summary from x""")
def _(m):
    li = m.table("lineitem").join(m.table("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol")), "l_partkey")
    raw = li.select("symbol", F.to_date("l_shipdate").alias("trade_date"), s(F.col("l_extendedprice").cast("decimal(18,2)")).alias("price"), s(F.col("l_quantity").cast("int")).alias("volume"),
                    s(F.col("l_discount").cast("decimal(6,2)")).alias("premium_rate"), s(F.col("l_extendedprice") * 1000).alias("amount"), F.concat(F.lit("B"), s("l_suppkey")).alias("buy_branch"), F.lit("").alias("sell_branch"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("row_no"))
    return ms.flow_block(raw)


CAL = lambda kind, day: f"'cal_' || substring(sha256('akshare|{kind}|' || symbol || '|' || {day}::varchar), 1, 16)"


@query("s28_cal_disclosure", f"""
with x as (select symbol, period_end, q, available_date as f, (available_date + case q when 2 then 5 when 4 then 9 else 0 end)::date as w from reports)
select {CAL('report_disclosure', 'w')} as cal_id, symbol, w::varchar as scheduled_date, '财报披露预约（' || period_end::varchar || '）' || case when f <> w then '，首次预约 ' || f::varchar || '（已变更）' else '' end || case when q = 1 then '，已实际披露' else '' end as note from x""")
def _(m):
    d = lambda q_, n: F.when(F.col("q") == q_, F.date_add("available_date", n))
    raw = m.reports.select("symbol", s("period_end").alias("period"), F.col("available_date").alias("first_booking"), d(2, 5).alias("change1"), d(4, 9).alias("change2"), F.lit(None).cast("date").alias("change3"), d(1, 0).alias("actual"))
    return ms.cal_disclosure(raw)


@query("s29_cal_unlock", f"""
select {CAL('unlock', 'eff')} as cal_id, symbol, eff::varchar as scheduled_date, min('解禁 ' || printf('%.2f', shares::double*70/1e8) || ' 亿股；占总市值 ' || printf('%.2f', (y - 1990)*0.013*100) || '%；' || kind) as note from share_events group by 1, 2, 3""")
def _(m):
    raw = m.share_events.select("symbol", F.col("effective_at").alias("unlock_date"), s(F.col("shares").cast("double") * 70).alias("shares_free"), s((F.year("effective_at") - 1990) * F.lit(0.013)).alias("ratio_total"), F.col("share_count_type").alias("share_type"))
    return ms.cal_unlock(raw)


@query("s30_parse_macro", """
select 'x' as factor_type, code, trade_date::varchar as trade_date, case when trade_date >= date '2000-01-15' then 'CN' else market end as market,
  case when trade_date >= date '2000-01-15' then close + 1 else close end::double as close, trade_date >= date '2000-01-15' as fresh,
  case when trade_date >= date '2000-01-15' then 'new ' || code else code end as name, case when trade_date < date '2000-01-15' then 0.5 when code <> 'F_click' then round(close / 100, 4)::double end as change_pct,
  case when trade_date >= date '2000-01-15' and market = 'CN' then 'pct' end as unit from macro_factors""")
def _(m):
    base = m.macro_factors.withColumn("factor_type", F.lit("x"))
    old = base.where("trade_date < '2000-01-20'").select("factor_type", "code", "trade_date", "market", "close", F.col("code").alias("name"), F.lit("0.5").cast("decimal(38,10)").alias("change_pct"), F.lit(None).cast("string").alias("unit"))
    new = base.where("trade_date >= '2000-01-15'").select(
        "factor_type", "code", "trade_date", F.lit("").alias("market"), (F.col("close") + 1).cast("decimal(38,10)").alias("close"), F.concat(F.lit(" new "), "code").alias("name"),
        F.when(F.col("code") == "F_click", "NA").otherwise(s(F.round(F.col("close") / 100, 4))).alias("change_pct"), F.when(F.col("market") == "CN", "pct ").otherwise("").alias("unit"))
    new = new.withColumns({"close": (F.col("close") + 7).cast("decimal(38,10)"), "row_no": F.lit(1)}).unionByName(new.withColumn("row_no", F.lit(2)))
    return ms.parse_macro(new, old)


@query("s31_parse_industry", """
select symbol, 'BK9' as industry_code, industry_name, '2001-01-05' as classification_date from watchlist union all select symbol, industry_code, industry_name, '2000-01-05' from watchlist""")
def _(m):
    x = m.industry.join(m.watchlist.select("symbol", "industry_code"), "symbol")
    cur = x.select("symbol", "industry_code", "industry_name", F.lit("2000-01-05").cast("date").alias("classification_date"))
    old = x.select("symbol", F.lit("BK7").alias("industry_code"), "industry_name", F.lit("2001-01-05").cast("date").alias("classification_date"))
    raw = x.select(F.lit("data/raw/akshare/industry/2001-01-05/run1/symbol_industry.csv").alias("file_path"), "symbol", F.lit("BK9").alias("industry_code"), "industry_name")
    raw = raw.withColumns({"industry_code": F.lit("BX"), "row_no": F.lit(1)}).unionByName(raw.withColumn("row_no", F.lit(2)))
    return ms.parse_industry(raw.unionByName(raw.withColumn("industry_name", F.lit(""))), cur.unionByName(old))


@query("s32_expand_calendar", """
with y as (select distinct year(trade_date) as y from daily_bars), d as (select 'CN' as market, y, unnest(generate_series(make_date(y, 1, 1), make_date(y, 12, 31), interval 1 day))::date as d from y),
c as (select *, case when (month(d) = 1 and day(d) <= 3) or (month(d) = 10 and day(d) <= 7) then 'holiday' when isodow(d) > 5 then 'weekend' when (month(d) = 12 and day(d) = 24) or (month(d) = 10 and day(d) = 4) then 'half_day' else 'trading' end as status from d)
select market, d::varchar as trade_date, status, status in ('half_day', 'trading') as is_open, status = 'trading' as is_full_day, case status when 'holiday' then case when month(d) = 1 then 'new year' else 'october' end when 'half_day' then 'half' end as status_detail from c""")
def _(m):
    y = m.daily_bars.select(F.year("trade_date").alias("year")).distinct().withColumn("market", F.lit("CN"))
    md = lambda a, b: F.make_date("year", F.lit(a), F.lit(b))
    hol = y.select("market", F.explode(F.array(F.struct(md(1, 1).alias("a"), md(1, 3).alias("b"), F.lit("new year").alias("name")), F.struct(md(10, 1).alias("a"), md(10, 7).alias("b"), F.lit("october").alias("name")))).alias("h"))
    half = y.select("market", F.explode(F.array(md(12, 24), md(10, 4))).alias("trade_date"), F.lit("half").alias("name"))
    return ms.expand_calendar(y, hol.select("market", F.col("h.a").alias("from_date"), F.col("h.b").alias("to_date"), "h.name"), half)


@query("s35_explode_md_table", """
with l as (select doc_id, u.i, u.line from (select doc_id, string_split(text, chr(10)) as ls from documents) d, lateral (select unnest(range(len(ls))) as i, unnest(ls) as line) u),
w as (select doc_id, i, '| ' || array_to_string(list_slice(ws, k * 3 + 1, k * 3 + 3), ' | ') || ' |' as t from (select doc_id, i, ws, unnest(range((len(ws) + 2) // 3)) as k from (select doc_id, i, string_split(line, ' ') as ws from l) x) y),
c as (select doc_id, i, list_transform(string_split(regexp_replace(t, '^\\|+|\\|+$', '', 'g'), '|'), lambda v: regexp_replace(v, '^\\s+|\\s+$', '', 'g')) as c from w where not regexp_full_match(t, '\\|[\\s\\-:|]+\\|')),
k as (select c, min((doc_id, i + 1)) as k from c where len(c) = 3 group by 1)
select k[1] as doc_id, u.h as "column", u.v as value from (select k, c from k) z, lateral (select unnest(['name', '_col2', 'name_2']) as h, unnest(c) as v) u""")
def _(m):
    # every three words of a line are a row; what is left over at its end makes a ragged one
    row = lambda ws, k: F.concat(F.lit("| "), F.array_join(F.slice(ws, k * 3 + 1, 3), " | "), F.lit(" |"))
    lines = F.transform(F.split("text", "\n"), lambda v: F.split(v, " "))
    rows = F.flatten(F.transform(lines, lambda ws: F.transform(F.sequence(F.lit(0), F.floor((F.size(ws) - 1) / 3).cast("int")), lambda k: row(ws, k))))
    md = F.concat(F.lit("| name |  | name |\\n|---|:-:|---|\n"), F.array_join(rows, "\n"))
    return ms.explode_md_table(m.table("documents").select("doc_id", md.alias("table_markdown"))).drop("row_no")
