"""Event study, message links, reviews, labels, due items and macro factors."""
from pyspark.sql import functions as F

from tapeloom.functions.columns import r
from tapeloom.operators import events as ev, macro
from tapeloom.plans.bar_queries import rounded
from tapeloom.plans.registry import query, view

view("study_events", """
select event_id, symbol, (a_date + case event_type when 'error' then 652 when 'view' then -1840 else 0 end)::date as a_date, event_type, ts from announcements""")
view("index_h", "select * from index_bars where close >= 1500")
view("event_anchor", """
select event_id, symbol, a_date, event_type, ts, (select max(trade_date) from trading_calendar t where t.trade_date < a_date) as base_date,
  (select count(*) from trading_calendar t where t.trade_date < a_date) as o from study_events""")
view("event_anchor2", """
select a.*, t1.trade_date as t1_date, t5.trade_date as t5_date from event_anchor a left join trading_calendar t1 on t1.td_ord = a.o + 1
left join trading_calendar t5 on t5.td_ord = a.o + 5""")


def study_view(name: str, src: str, bars: str, index: str) -> None:
    view(name, f"""
with c as (select symbol, trade_date, close_raw * price_adj_factor as c from {bars} where close_raw is not null),
m as (select symbol, least(max(trade_date), (select max(trade_date) from {index})) as cutoff from c group by 1),
j as (select e.event_id, e.symbol, e.a_date, e.base_date, m.cutoff, e.t1_date, e.t5_date, b.c as bc, x.close as bx, c1.c as c1, x1.close as x1, c5.c as c5, x5.close as x5
  from {src} e left join m using (symbol)
  left join c b on b.symbol = e.symbol and b.trade_date = e.base_date left join {index} x on x.trade_date = e.base_date
  left join c c1 on c1.symbol = e.symbol and c1.trade_date = e.t1_date left join {index} x1 on x1.trade_date = e.t1_date
  left join c c5 on c5.symbol = e.symbol and c5.trade_date = e.t5_date left join {index} x5 on x5.trade_date = e.t5_date),
k as (select *, case when base_date is null then 'no_base_date' when bc is null then 'base_no_bar' when bx is null then 'bench_base_missing' end as early from j),
n as (select *, case when early is null then case when t1_date is null or t1_date > cutoff then 'pending' when c1 is null then 'suspended' end end as t1_mark,
  case when early is null then case when t5_date is null or t5_date > cutoff then 'pending' when c5 is null then 'suspended' end end as t5_mark from k),
p as (select *, coalesce(early, case when t5_mark is null and x5 is null then 'bench_missing_t5' when t1_mark is null and x1 is null then 'bench_missing_t1' end) as reason from n)
select event_id, symbol, a_date, base_date, cutoff, t1_mark, t5_mark, reason, case when early is null and t1_mark is null then c1/bc - 1 end as t1_ret,
  case when early is null and t5_mark is null then c5/bc - 1 end as t5_ret, case when early is null and t1_mark is null then c1/bc - x1/bx end as t1_excess,
  case when early is null and t5_mark is null then c5/bc - x5/bx end as t5_excess,
  case when reason is not null then 'degraded' when coalesce(t1_mark, '') = 'suspended' or coalesce(t5_mark, '') = 'suspended' then 'suspended' else 'ok' end as status from p""")


study_view("study", "event_anchor2", "daily_bars", "index_h")
view("old_bars", "select * from daily_bars where trade_date <= date '2000-01-20'")
view("old_events", "select * from event_anchor2 where ts < timestamp '2024-01-21'")
study_view("old_study", "old_events", "old_bars", "index_h")


def study(m, events, bars=None):
    return ev.event_study(events, m.daily_bars if bars is None else bars, m.index_h, m.spine.drop("market"), m.trading_calendar)


@query("e01_event_days", """
select event_id, symbol, a_date::varchar as a_date, base_date::varchar as base_date, t1_date::varchar as t1_date, t5_date::varchar as t5_date from event_anchor2""")
def _(m):
    e = m.study_events.select("event_id", "symbol", "a_date")
    return e.join(ev.event_days(e, m.spine.drop("market"), m.trading_calendar), "a_date")


@query("e02_event_study", """
select event_id, symbol, a_date::varchar as a_date, t1_mark, t5_mark, reason, status, round(t1_ret, 6) as t1_ret, round(t5_ret, 6) as t5_ret,
  round(t1_excess, 6) as t1_excess, round(t5_excess, 6) as t5_excess from study""")
def _(m):
    x = study(m, m.study_events.select("event_id", "symbol", "a_date"))
    return rounded(x, ["event_id", "symbol", "a_date", "t1_mark", "t5_mark", "reason", "status"], t1_ret=6, t5_ret=6, t1_excess=6, t5_excess=6)


@query("e03_study_status", """
select symbol, status, coalesce(reason, '') as reason, cutoff::varchar as cutoff, count(*) as n, count(*) filter (t1_mark = 'pending' or t5_mark = 'pending') as pending
from study group by 1, 2, 3, 4""")
def _(m):
    x = study(m, m.study_events.select("event_id", "symbol", "a_date"))
    return x.groupBy("symbol", "status", F.coalesce("reason", F.lit("")).alias("reason"), "cutoff").agg(
        F.count("*").alias("n"), F.count(F.when(ev.has_pending(), 1)).alias("pending"))


@query("e04_merge_studies", """
with done as (select * from old_study where status in ('ok', 'suspended') and coalesce(t1_mark, '') <> 'pending' and coalesce(t5_mark, '') <> 'pending')
select event_id, symbol, status, 'kept' as action, round(t5_ret, 6) as t5_ret from done
union all select s.event_id, s.symbol, s.status, case when o.event_id is null then 'new' else 'recomputed' end, round(s.t5_ret, 6)
from study s left join old_study o using (event_id) where not exists (select 1 from done d where d.event_id = s.event_id)""")
def _(m):
    cols = ["event_id", "symbol", "a_date"]
    old = study(m, m.study_events.where("ts < timestamp '2024-01-21'").select(*cols), m.daily_bars.where("trade_date <= '2000-01-20'"))
    out = ev.merge_studies(m.study_events.select(*cols), old, lambda e: study(m, e))
    return out.select("event_id", "symbol", "status", "action", r("t5_ret", 6).alias("t5_ret"))


view("news", """
select doc_id as event_id, case lang when 'fr' then 'announcement' when 'de' then 'flow' else 'news' end as event_type,
  ['央行降准落地', '财政部公布新规', '黄金周消费回暖', '国务院谈国际黄金价格', '美联储表态后电解铜库存下降', '商务部调研白酒企业'][(doc_id % 6 + 1)::int] as title, text as summary,
  timestamp '2024-01-01' + to_hours(doc_id::int) as published_at, (doc_id % 4 + 1)::int as source_tier, source from documents""")
view("scoped", f"""
select *, title || ' ' || summary as text, case when event_type = 'flow' then 'flow' when event_type = 'announcement' then 'company'
  when regexp_matches(title || ' ' || summary, '{ev.any_word(ev.MACRO_WORDS)}') then 'macro' when regexp_matches(title || ' ' || summary, '{ev.any_word(ev.POLICY_WORDS)}') then 'policy' end as scope from news""")
view("watchlist", """
select symbol, case when n % 2 = 0 then 'CN' else 'HK' end as market, 'Pool ' || n as name, 'alias' || n as alias,
  case n % 4 when 0 then ['黄金'] when 1 then ['铜'] when 2 then ['白酒', 'la'] else []::varchar[] end as themes, 'BK' || (n % 3) as industry_code, n % 6 <> 5 as active,
  case n % 3 when 0 then '白酒' when 1 then '黄金' else 'than' end as industry_name
from (select distinct symbol, cast(substring(symbol, 7) as int) as n from daily_bars) x""")
view("news_links", """
select distinct s.event_id, t.symbol from scoped s join (select symbol, unnest(themes) as term from watchlist where active union select symbol, industry_name from watchlist where active) t
on s.scope in ('industry', 'policy', 'macro') and regexp_matches(s.text, t.term || '([^周节]|$)')""")


@query("e05_classify_scope", "select event_id, event_type, scope from scoped")
def _(m):
    return ev.classify_scope(m.news).select("event_id", "event_type", "scope")


def links(m):
    return ev.link_events(ev.classify_scope(m.news), m.watchlist, m.industry)


@query("e06_link_events", "select event_id, symbol from news_links")
def _(m):
    return links(m)


view("reviews", """
select a.event_id as review_id, e.user_id as event_id, case when a.event_id % 3 = 0 then a.symbol else '__event__' end as symbol, a.ts as reviewed_at,
  case case when a.event_type in ('click', 'signup') and a.value < 150 then 'view' else a.event_type end when 'view' then 'note' when 'click' then 'confirm' when 'signup' then 'dismiss' when 'purchase' then 'upgrade_materiality' else 'amend' end as action,
  case when a.value < 20 then 'low' when a.value < 60 then 'medium' when a.value < 120 then 'high' else 'critical' end as materiality,
  case when a.value > 50 then 'gap' end as expectation_gap, case when a.value < 10 then 'line' end as falsification,
  case when a.event_id % 2 = 0 then 'eps' end as target, case when a.event_id % 5 = 0 then 'week' end as half_life
from announcements a join events e using (event_id)""")
view("ev_links", "select distinct user_id as event_id, concat('Brand#', cast(user_id % 25 + 1 as int)) as symbol from events")
view("assess", """
select event_id, case when event_id % 4 = 0 then 'ok' else 'needs_review' end as status, ['positive', 'negative', 'neutral'][(event_id % 3 + 1)::int] as direction from ev_links where event_id % 7 <> 0""")
LASTV = lambda col, cond: f"(select {col} from reviews q where q.event_id = k.event_id and q.symbol = k.symbol and {cond} order by reviewed_at desc, review_id desc limit 1)"
view("replay", f"""
select k.event_id, k.symbol, {LASTV("action = 'dismiss'", "action in ('dismiss', 'confirm')")} as hide, {LASTV("'ok'", "action = 'confirm'")} as ok,
  {LASTV('materiality', "action = 'upgrade_materiality'")} as mat, {LASTV('expectation_gap', "action = 'amend' and expectation_gap is not null")} as gap,
  {LASTV('falsification', "action = 'amend' and falsification is not null")} as fals, {LASTV('target', "action = 'amend' and target is not null")} as tgt,
  {LASTV('half_life', "action = 'amend' and half_life is not null")} as half from (select distinct event_id, symbol from reviews) k""")
view("ev_state", """
with b as (select l.event_id, coalesce(r.hide, false) as hidden, coalesce(r.ok, a.status) as status, a.direction, coalesce(r.mat, case when a.event_id is not null then 'medium' end) as materiality,
    r.tgt as target, coalesce(r.half, case when a.event_id is not null then 'day' end) as half_life, r.gap as expectation_gap, r.fals as falsification
  from (select distinct event_id from ev_links) l left join assess a using (event_id) left join replay r on r.event_id = l.event_id and r.symbol = '__event__')
select event_id, '__event__' as symbol, hidden, status, direction, materiality, target, half_life, expectation_gap, falsification from b
union all select b.event_id, l.symbol, coalesce(r.hide, hidden), coalesce(r.ok, status), direction, coalesce(r.mat, materiality), coalesce(r.tgt, target), coalesce(r.half, half_life),
  coalesce(r.gap, expectation_gap), coalesce(r.fals, falsification) from b join ev_links l using (event_id) left join replay r on r.event_id = l.event_id and r.symbol = l.symbol""")


def state(m):
    return ev.effective_state(m.event_links, m.assessments, m.reviews)


@query("e07_effective_state", "select * from ev_state")
def _(m):
    return state(m).drop("confidence", "rationale")


@query("e08_label_candidates", """
with c as (select * from news where event_type in ('announcement', 'news') and published_at::date <= date '2024-02-05' and not exists (select 1 from labels l where l.doc_id = event_id)
  order by published_at desc, event_id desc limit 100),
g as (select code, arg_max(close, trade_date) as close, max(trade_date) as d from macro_factors where trade_date <= date '2024-02-05' group by 1)
select event_id, event_type, title, strftime(published_at, '%Y-%m-%d %H:%M:%S') as published_at, (select string_agg(symbol, ',' order by symbol) from news_links l where l.event_id = c.event_id) as linked_symbols,
  (select string_agg(code || ' ' || printf('%.4f', close::double) || '（' || d::varchar || '）', ';' order by code) from g) as macro_context from c""")
def _(m):
    x = ev.label_candidates(m.news, m.assessed, links(m), m.macro_factors, "2024-02-05", 100)
    return x.select("event_id", "event_type", "title", "published_at", "linked_symbols", "macro_context")


@query("e09_gate_labels", """
with t as (select d.*, doc_id % 12 as k from documents d),
v as (select t.doc_id as event_id, k, (t.doc_id % 4 + 1)::int as source_tier, l.doc_id is not null as done, case when k = 1 then 'other' when k in (2, 3) then 'company' else 'macro' end as scope,
  case when k = 4 then 'high' else 'low' end as materiality, case k when 5 then 0.8 when 6 then 0.3 when 7 then 1.5 when 8 then null when 9 then 0.25 else 0.5 end::double as conf,
  case when k = 10 then '建议买入' when k = 11 then text else '业绩改善' end as rationale from t left join labels l on l.doc_id = t.doc_id),
o as (select event_id, conf, case when done then 'skipped' when k = 1 or coalesce(conf, 9) > 1 or length(rationale) > 300 or length(rationale) < 1 then 'rejected'
  when materiality = 'high' or conf < 0.4 or regexp_matches(rationale, '建议买入|必涨|必跌|建议卖出|目标价|涨停|抄底|逃顶') or (scope = 'company' and source_tier <= 2) then 'needs_review' else 'ok' end as outcome from v)
select event_id, outcome, case when outcome in ('ok', 'needs_review') then round(conf, 6) end as confidence from o""")
def _(m):
    k = F.col("event_id") % 12
    conf = F.when(k == 5, F.lit('"80%"')).when(k == 6, F.lit("0.3")).when(k == 7, F.lit("1.5")).when(k == 8, F.lit('"high"')).when(k == 9, F.lit('"25%"')).otherwise(F.lit("0.5"))
    body = F.to_json(F.struct(
        "event_id", F.when(k == 1, "other").when(k.isin(2, 3), "company").otherwise("macro").alias("scope"), F.lit("neutral").alias("direction"),
        F.when(k == 4, "high").otherwise("low").alias("materiality"), F.lit("none").alias("action_hint"),
        F.when(k == 10, "建议买入").when(k == 11, F.col("summary")).otherwise("业绩改善").alias("rationale")))
    tags = m.news.select(F.concat(F.lit('{"confidence":'), conf, F.lit(","), F.substring(body, 2, 2147483647)).alias("tag_json"))
    return rounded(ev.gate_labels(tags, m.news, m.assessed), ["event_id", "outcome"], confidence=6)


AWAIT = """select event_id from assess a where status = 'needs_review' and not exists (select 1 from reviews r where r.event_id = a.event_id and r.symbol = '__event__' and action in ('confirm', 'dismiss'))"""


@query("e10_awaiting_confirm", AWAIT)
def _(m):
    return ev.awaiting_confirm(m.assessments, m.reviews)


@query("e11_review_list", """
select event_id, hidden, status, case status when 'ok' then '已过审' when 'needs_review' then '待人审' else '' end as status_cn,
  case direction when 'positive' then '利好' when 'negative' then '利空' when 'neutral' then '中性' else '' end as direction_cn,
  case materiality when 'low' then '轻微' when 'medium' then '一般' when 'high' then '重大' when 'critical' then '关键' else '' end as materiality_cn,
  (select string_agg(l.symbol || ' ' || case when n % 2 = 0 then 'Pool ' else 'Dir ' end || n, ';' order by l.symbol) from (select *, cast(substring(symbol, 7) as int) as n from ev_links) l where l.event_id = s.event_id) as symbols_label
from ev_state s where symbol = '__event__'""")
def _(m):
    n = F.substring("symbol", 7, 9)
    names = m.watchlist.select("symbol", F.concat(F.lit("Dir "), n).alias("name"))
    return ev.review_list(state(m), m.event_links, names, m.watchlist.where("market = 'CN'").select("symbol", "name"))


view("event_calendar", """
select 'report_disclosure' as kind, symbol, available_date as scheduled_date, 7 as remind, period_end::varchar as note from reports
union all select 'macro_release', null, (trade_date + 95)::date, 3, code from macro_factors""")


@query("e12_event_summary", """
with e as (select *, case when event_type in ('click', 'view') then 'news' when event_type = 'error' then 'flow' else 'announcement' end as kind from announcements where a_date <= date '2000-01-25'),
t as (select symbol, event_id, kind, row_number() over (partition by symbol order by ts desc, event_id desc) as rank from e qualify rank <= 10),
p as (select symbol, count(*) as pending from e where kind <> 'flow' and not exists (select 1 from labels l where l.doc_id = e.event_id) group by 1),
c as (select symbol, count(*) as n from event_calendar where scheduled_date between date '2000-01-25' and date '2000-02-24' group by 1)
select t.symbol, t.rank::int as rank, t.event_id, t.kind as event_type, coalesce(pending, 0)::bigint as pending, (coalesce(c.n, 0) + coalesce((select n from c where symbol is null), 0))::bigint as upcoming
from t left join p using (symbol) left join c on c.symbol = t.symbol""")
def _(m):
    k = F.col("event_type")
    e = m.announcements.where("a_date <= '2000-01-25'").select(
        "symbol", "event_id", F.col("ts").alias("available_at"), F.when(k.isin("click", "view"), "news").when(k == "error", "flow").otherwise("announcement").alias("event_type"))
    x = ev.event_summary(e.withColumn("available_at", F.col("available_at") - F.expr("interval 8766 days")), m.assessed, m.event_calendar, "2000-01-25")
    return x


@query("e13_due_items", """
select kind, symbol, scheduled_date::varchar as due_date, note from event_calendar where scheduled_date >= date '2000-04-30' and scheduled_date <= date '2000-04-30' + remind
union all select 'card_review', symbol, next_review_at::varchar, card_version_id from vcards where status = 'active' and next_review_at <= date '2000-04-30'""")
def _(m):
    return ev.due_items(m.event_calendar, m.vcards, "2000-04-30")


view("factor_days", """
select f.code, f.market, t.trade_date as as_of, (select max(m.trade_date) from macro_factors m where m.code = f.code and (m.trade_date < t.trade_date or (f.market = 'CN' and m.trade_date = t.trade_date))) as rd
from (select code, max(market) as market from macro_factors group by 1) f cross join trading_calendar t""")
view("factor_chg", """
select *, round(close::double/lag(close, 20) over w::double - 1, 6) as change_20, round(close::double/lag(close, 60) over w::double - 1, 6) as change_60 from macro_factors
window w as (partition by code order by trade_date)""".replace("lag(close, 20) over w::double", "(lag(close, 20) over w)::double").replace("lag(close, 60) over w::double", "(lag(close, 60) over w)::double"))
view("factor_read", """
select d.code, d.market, d.as_of, d.rd, m.close, m.change_20, m.change_60,
  case when d.rd is null then 'missing' when (select count(*) from trading_calendar t where t.trade_date > d.rd and t.trade_date <= d.as_of) > 5 then 'stale' else 'ok' end as status
from factor_days d left join factor_chg m on m.code = d.code and m.trade_date = d.rd""")


@query("m01_factor_asof", """
select code, market, as_of::varchar as as_of, rd::varchar as reading_date, close::double as close, status from factor_read""")
def _(m):
    every = m.trading_calendar.agg(F.collect_list("trade_date")).scalar()
    days = m.macro_factors.select("code").distinct().select("code", F.explode(every).alias("as_of"))
    return macro.factor_asof(days, m.macro_factors, m.spine.drop("market")).select("code", "market", "as_of", "reading_date", "close", "status")


@query("m02_factor_change", "select code, trade_date::varchar as trade_date, change_20, change_60 from factor_chg")
def _(m):
    return macro.factor_changes(m.macro_factors).select("code", "trade_date", "change_20", "change_60")


view("exposure_rows", """
select symbol, unnest(case when n % 5 = 0 then ['F_view', 'F_none'] when n % 3 = 0 then ['F_click', 'F_error'] when n % 3 = 1 then ['F_purchase'] else [] end) as code
from (select symbol, cast(substring(symbol, 7) as int) as n from watchlist) x""")


def exposure(m):
    n = F.substring("symbol", 7, 9).cast("int")
    own = m.watchlist.where(n % 5 == 0).select("symbol", F.explode(F.array(F.lit("F_view"), F.lit("F_none"))).alias("code"))
    ind = m.watchlist.select("industry_code").distinct().select("industry_code", F.explode(
        F.when(F.col("industry_code") == "BK0", F.array(F.lit("F_click"), F.lit("F_error"))).when(F.col("industry_code") == "BK1", F.array(F.lit("F_purchase")))
        .otherwise(F.array().cast("array<string>"))).alias("code"))
    return macro.exposures(m.watchlist, own, ind)


@query("m03_exposures", "select symbol, code from exposure_rows")
def _(m):
    return exposure(m)


@query("m04_factor_snapshot", """
with d as (select symbol, max(trade_date) as as_of from daily_bars where trade_date <= date '2000-01-28' group by 1)
select e.symbol, e.code, d.as_of::varchar as as_of, r.rd::varchar as reading_date, r.close::double as close, coalesce(r.status, 'missing') as status, r.change_20
from exposure_rows e join d using (symbol) left join factor_read r on r.code = e.code and r.as_of = d.as_of""")
def _(m):
    pool = m.daily_bars.where("trade_date <= '2000-01-28'").groupBy("symbol").agg(F.max("trade_date").alias("as_of"))
    x = macro.factor_snapshot(pool, exposure(m), m.macro_factors, m.spine.drop("market"))
    return x.select("symbol", "code", "as_of", "reading_date", "close", "status", "change_20")
