"""Daily watch, right side, accumulation, corporate actions and card conversion."""
from pyspark.sql import functions as F

from tapeloom.functions.columns import r
from tapeloom.operators import accumulation, cards, daily_watch as dw, exhaustion as ex, indicators, right_side as rs
from tapeloom.plans import card_views  # noqa: F401
from tapeloom.plans.bar_queries import rounded
from tapeloom.plans.registry import query, view

DAY = ["symbol", "trade_date", "card_version_id"]
DAY_SQL = "symbol, trade_date::varchar as trade_date, card_version_id"


@query("d01_cards_asof", f"select {DAY_SQL}, status from bar_cards")
def _(m):
    return m.bar_cards.select(*DAY, "status")


@query("d02_tier_proximity", f"select {DAY_SQL}, tier, state, reason from prox")
def _(m):
    return dw.tier_proximity(m.bar_cards).select(*DAY, F.col("prox_tier").alias("tier"), F.col("prox_state").alias("state"), F.col("prox_reason").alias("reason"))


@query("d03_tier_trigger", f"select {DAY_SQL}, hit as tier, state, reason from trig")
def _(m):
    x = dw.tier_trigger(m.bar_cards, ex.active_counts(m.weekly_facts), m.weeks)
    return x.select(*DAY, F.col("trig_tier").alias("tier"), F.col("trig_state").alias("state"), F.col("trig_reason").alias("reason"))


@query("d04_falsification", f"select {DAY_SQL}, run, state, triggered, reason from fals")
def _(m):
    return dw.falsification(m.bar_cards).select(*DAY, "run", F.col("fals_state").alias("state"), F.col("fals_triggered").alias("triggered"),
                                                F.col("fals_reason").alias("reason"))


@query("d05_box_position", f"select {DAY_SQL}, state from box")
def _(m):
    return dw.box_position(m.bar_cards).select(*DAY, F.col("box_state").alias("state"))


@query("d06_ma_compare", f"select {DAY_SQL}, state, reason from mac")
def _(m):
    ma = indicators.sma(m.adj, windows=(20, 60)).select("symbol", "trade_date", "ma20", "ma60")
    x = dw.ma_compare(m.bar_cards.join(ma, ["symbol", "trade_date"], "left"))
    return x.select(*DAY, F.col("ma_state").alias("state"), F.col("ma_reason").alias("reason"))


@query("d07_daily_watch", """
select symbol, observed_on::varchar as observed_on, card_version_id, signal, state, triggered, reason from watch_rows
union all select symbol, d::varchar, null, 'daily_watch', 'incomplete', false, 'card_not_effective_at_as_of' from (
  select symbol, max(trade_date) as d from daily_bars group by 1) a where not exists (select 1 from bar_cards_h b where b.symbol = a.symbol and b.trade_date = a.d)""")
def _(m):
    bc = cards.cards_asof(m.bars_h, m.vcards)
    ma = indicators.sma(m.adj, windows=(20, 60)).select("symbol", "trade_date", "ma20", "ma60")
    rows = dw.daily_watch(bc, ma, ex.active_counts(m.weekly_facts), m.weeks, m.open_freezes)
    last = m.bars_h.groupBy("symbol").agg(F.max("trade_date").alias("trade_date"))
    return rows.unionByName(dw.uncovered(last, m.vcards))


@query("d08_tier_state", f"""
with x as (select *, case when t1_low <= close_raw and close_raw <= t1_high then 1 when t2_low <= close_raw and close_raw <= t2_high then 2 end as in_tier,
    least(abs(close_raw - t1_low), abs(close_raw - t1_high), abs(close_raw - t2_low), abs(close_raw - t2_high)) as d from (
    select {DAY_SQL}, close_raw, t1_low::double as t1_low, t1_high::double as t1_high, t2_low::double as t2_low, t2_high::double as t2_high from bar_cards) y)
select symbol, trade_date, card_version_id, in_tier, case when in_tier is null then case when d in (abs(close_raw - t1_low), abs(close_raw - t1_high)) then 1 else 2 end end as nearest_tier,
  round(case when in_tier = 1 then least((close_raw - t1_low)/t1_low, (t1_high - close_raw)/t1_high)*100 when in_tier = 2 then least((close_raw - t2_low)/t2_low, (t2_high - close_raw)/t2_high)*100
    when d = abs(close_raw - t1_low) then (close_raw - t1_low)/t1_low*100 when d = abs(close_raw - t1_high) then (close_raw - t1_high)/t1_high*100
    when d = abs(close_raw - t2_low) then (close_raw - t2_low)/t2_low*100 else (close_raw - t2_high)/t2_high*100 end, 6) as dist_pct from x""")
def _(m):
    return dw.tier_state(m.bar_cards).select(*DAY, "in_tier", "nearest_tier", r("dist_pct", 6).alias("dist_pct"))


@query("r01_right_side_inputs", """
select symbol, trade_date::varchar as trade_date, round(volume_adj, 4) as volume_adj, round(vol_base, 6) as vol_base from rs_in_h""", shared=False)
def _(m):
    return rounded(rs.right_side_inputs(m.bars_h), ["symbol", "trade_date"], volume_adj=4, vol_base=6)


@query("r02_right_side", "select symbol, card_version_id, observed_on::varchar as observed_on, state, triggered, reason from rs_rows")
def _(m):
    return rs.right_side(cards.cards_asof(rs.right_side_inputs(m.daily_bars), m.vcards))


@query("r02_right_side_frozen", "select symbol, card_version_id, observed_on::varchar as observed_on, state, triggered, reason from rs_rows_h")
def _(m):
    return rs.right_side(cards.cards_asof(rs.right_side_inputs(m.bars_h), m.vcards), m.open_freezes)


@query("u01_breakdown", "select symbol, trade_date::varchar as trade_date, bd as breakdown_reason from acc_days", shared=False)
def _(m):
    return accumulation.breakdown(accumulation.inputs(m.daily_bars)).select("symbol", "trade_date", "breakdown_reason")


@query("u02_consolidation", """
select symbol, day::varchar as observed_on, reason, round(b0, 7) as box_low, round(b1, 7) as box_high from acc_scan
where st in ('watching', 'consolidating') and reason in ('consolidation_confirmed', 'condition_not_met', 'missing_ma')""", shared=False)
def _(m):
    return rounded(accumulation.consolidation(m.daily_bars), ["symbol", "observed_on", "reason"], box_low=7, box_high=7)


@query("u03_probe", "select symbol, trade_date::varchar as trade_date, is_probe from acc_days", shared=False)
def _(m):
    return accumulation.probe(accumulation.inputs(m.daily_bars)).select("symbol", "trade_date", "is_probe")


@query("u04_accumulation", """
select symbol, day::varchar as observed_on, st as state, trig as triggered, reason, probes as probe_count, round(b0, 7) as box_low, round(b1, 7) as box_high from acc_scan""", shared=False)
def _(m):
    return rounded(accumulation.accumulation(m.daily_bars), ["symbol", "observed_on", "state", "triggered", "reason", "probe_count"], box_low=7, box_high=7)


@query("k01_open_freezes", "select symbol, ca_id, ex_date::varchar as ex_date, action_type from open_freeze_rows")
def _(m):
    return m.open_freezes.select("symbol", "ca_id", "ex_date", "action_type")


view("pending_rows", """
select c.*, k.effective_from, k.card_version_id from corporate_actions c join vcards k on k.symbol = c.symbol and k.status = 'active'
where c.ex_date >= k.effective_from and c.ex_date <= (select max(trade_date) from daily_bars b where b.symbol = c.symbol)
  and not exists (select 1 from open_freeze_rows f where f.ca_id = c.ca_id)
  and not exists (select 1 from freezes f where f.ca_id = c.ca_id and f.cash_per_share >= 2500 and f.cash_per_share < 2700)""")
view("classified", """
select p.*, b.close_raw as prev_close, case when action_type = 'cash_dividend' and cash_per_share::decimal(38,10) < b.close_raw::decimal(28,10) * 0.02 then 'fastlane' else 'three_step' end as channel
from pending_rows p left join (select p.ca_id, max(b.trade_date) as d from pending_rows p join bars_h b on b.symbol = p.symbol and b.trade_date < p.ex_date group by 1) l using (ca_id)
left join bars_h b on b.symbol = p.symbol and b.trade_date = l.d""")


def pending(m):
    last = m.daily_bars.groupBy("symbol").agg(F.max("trade_date").alias("as_of"))
    handled = m.absorbed.select("symbol", "ca_id").unionByName(m.open_freezes.select("symbol", "ca_id"))
    return cards.pending_actions(m.corporate_actions.join(last, "symbol"), m.vcards, handled, F.col("as_of")).drop("as_of")


@query("k02_pending_actions", "select symbol, ca_id, ex_date::varchar as ex_date, action_type, card_version_id from pending_rows")
def _(m):
    return pending(m).select("symbol", "ca_id", "ex_date", "action_type", "card_version_id")


@query("k03_classify_action", """
select symbol, ca_id, channel, round(prev_close, 7) as prev_close, round(cash_per_share/prev_close, 6) as impact from classified""")
def _(m):
    x = cards.classify_actions(pending(m), m.bars_h)
    return x.select("symbol", "ca_id", "channel", r("prev_close", 7).alias("prev_close"), r(F.col("cash_per_share") / F.col("prev_close"), 6).alias("impact"))


CONV = ("t1_low", "t1_high", "t2_low", "t2_high", "invalidation_line", "trigger_level", "stop_level")
view("converted", """
select a.ca_id, c.symbol, c.card_version_id, """ + ", ".join(
    f"round(case when a.action_type = 'split' then c.{k} * (1.0::decimal(20,10) / a.split_ratio)::decimal(12,6) else c.{k} - a.cash_per_share::decimal(18,4) end, 4)::double as {k}" for k in CONV) +
    """, round(round(invalidation_line * 0.05::double, 4) * case when a.action_type = 'split' then 1/a.split_ratio else 1.0 end, 4) as eps_base
from corporate_actions a join vcards c on c.symbol = a.symbol""")


def with_eps(m):
    card = m.vcards.join(m.card_docs.select("symbol", "card_version_id", F.from_json(
        "earnings_scenarios_json", "struct<eps:map<string,string>>")["eps"].alias("eps")), ["symbol", "card_version_id"])
    return card.withColumn("eps", F.transform_values("eps", lambda k, v: v.cast("decimal(18,4)")))


def convertible(m):
    return cards.convert_cards(m.corporate_actions.join(with_eps(m), "symbol"))


@query("k04_convert_cards", "select symbol, ca_id, card_version_id, " + ", ".join(f"round({k}, 4) as {k}" for k in CONV) + ", eps_base from converted")
def _(m):
    t = lambda i, k: F.col("tiers")[i][k]
    return convertible(m).select("symbol", "ca_id", "card_version_id", t(0, "zone_low").alias("t1_low"), t(0, "zone_high").alias("t1_high"),
                                 t(1, "zone_low").alias("t2_low"), t(1, "zone_high").alias("t2_high"), *CONV[4:], F.col("eps")["base"].alias("eps_base"))


@query("k05_validate_conversion", """
select symbol, ca_id, card_version_id, concat_ws(',', case when least(t1_low, t1_high, t2_low, t2_high) <= 0 then 'tier_not_positive' end,
  case when t1_low >= t1_high or t2_low >= t2_high then 'tier_zone_order' end, case when t2_high >= t1_low then 'tiers_overlap' end,
  case when invalidation_line <= 0 then 'line_not_positive' end, case when t2_low <= 0 then 'box_low_not_positive' end, case when trigger_level <= 0 then 'box_high_not_positive' end,
  case when t2_low <= 0 then 'buy_zone_low_not_positive' end, case when t2_high <= 0 then 'buy_zone_high_not_positive' end, case when t1_high <= 0 then 'sell_zone_low_not_positive' end,
  case when stop_level <= 0 then 'sell_zone_high_not_positive' end, case when invalidation_line <= 0 then 'box_invalidation_not_positive' end,
  case when t2_low >= trigger_level then 'box_low_ge_box_high' end, case when t2_low >= t2_high then 'buy_zone_low_ge_buy_zone_high' end,
  case when t1_high >= stop_level then 'sell_zone_low_ge_sell_zone_high' end, case when trigger_level <= 0 then 'trigger_not_positive' end,
  case when stop_level <= 0 then 'stop_not_positive' end) as errors from converted""")
def _(m):
    return convertible(m).select("symbol", "ca_id", "card_version_id", F.array_join(cards.conversion_errors(), ",").alias("errors"))


view("roll_scan", """
select * from (with recursive p as (select c.*, row_number() over (partition by c.symbol order by ex_date, ca_id) as k,
    k.t1_low, k.t1_high, k.invalidation_line, least(k.t1_low, k.t2_low, k.invalidation_line, k.trigger_level, k.stop_level) as low
  from classified c join vcards k on k.symbol = c.symbol and k.status = 'active'),
s as (select symbol, 0::bigint as k, 0::decimal(18,4) as total, null::varchar as ca_id, effective_from as ex_date, 'version' as kind, 0::decimal(18,4) as used, 1.0::double as mul
  from vcards where status = 'active'
  union all
  select p.symbol, p.k, case when channel = 'fastlane' and low - total - cash_per_share::decimal(18,4) > 0 then (total + cash_per_share::decimal(18,4))::decimal(18,4) else total end, p.ca_id, p.ex_date,
    case when channel = 'fastlane' then case when low - total - cash_per_share::decimal(18,4) > 0 then 'version' else 'refused' end
      when p.action_type = 'split' then case when round((low - total)/split_ratio, 4) > 0 then 'draft' else 'refused' end
      else case when low - total - cash_per_share::decimal(18,4) > 0 then 'draft' else 'refused' end end,
    (total + case when p.action_type = 'split' then 0 else cash_per_share::decimal(18,4) end)::decimal(18,4), case when p.action_type = 'split' then 1/split_ratio else 1.0 end
  from s join p on p.symbol = s.symbol and p.k = s.k + 1) select * from s)""")


ROLLED = (*CONV, *cards.BOX_KEYS)


@query("k06_roll_versions", f"""
with x as (select s.*, {', '.join(f'c.{k}' for k in ROLLED)}, case when kind = 'version' then lead(ex_date) over (partition by s.symbol, kind order by s.k) end as nxt
  from roll_scan s join vcards c on c.symbol = s.symbol and c.status = 'active')
select symbol, k::int as seq, ca_id, kind, case when kind <> 'version' then kind when nxt is null then 'active' else 'superseded' end as status,
  case when kind = 'version' then ex_date end::varchar as effective_from, nxt::varchar as effective_to,
  {', '.join(f"case when kind <> 'refused' then round(({k} - used) * mul, 4) end::double as {k}" for k in ROLLED)},
  {', '.join(f"case when kind <> 'refused' then round(round(invalidation_line * {v}::double, 4) * mul, 4) end::double as eps_{k}" for k, v in (('bear', 0.04), ('base', 0.05), ('bull', 0.06)))} from x""")
def _(m):
    x = cards.roll_versions(with_eps(m), cards.classify_actions(pending(m), m.bars_h))
    zone = lambda i, k: F.col("tiers")[i][f"zone_{k}"].alias(f"t{i + 1}_{k}")
    return x.select("symbol", "seq", "ca_id", "kind", "status", "effective_from", "effective_to", zone(0, "low"), zone(0, "high"), zone(1, "low"), zone(1, "high"), *CONV[4:],
                    *[F.col(f"box.{k}").alias(k) for k in cards.BOX_KEYS], *[F.col("eps")[k].alias(f"eps_{k}") for k in ("bear", "base", "bull")])


@query("k07_check_cards", """
with c as (select *, cast(substring(symbol, 7) as int) % 10 as d from cards)
select symbol, card_version_id::varchar as card_version_id, case when d = 4 then 'schema' else concat_ws(',', case when d = 1 then 'zone_order_1' end, case when d = 2 then 'duplicate_1' end,
  case when d = 5 then 'box_low_gt_box_high' end, case when d = 6 then 'anchor_metric' end) end as errors, d = 7 as anchor_missing from c""")
def _(m):
    d = F.substring("symbol", 7, 9).cast("int") % 10
    s = lambda k: F.col(k).cast("string")
    flip = lambda n, a, b: F.when(d == n, b).otherwise(a)
    tiers = F.array(F.struct(F.lit(1).alias("tier"), flip(1, s("t1_low"), s("t1_high")).alias("zone_low"), flip(1, s("t1_high"), s("t1_low")).alias("zone_high")),
                    F.struct(flip(2, F.lit(2), F.lit(1)).alias("tier"), flip(4, s("t2_low"), F.lit("12.34567")).alias("zone_low"), s("t2_high").alias("zone_high")))
    doc = F.struct(F.lit("CNY").alias("currency"), F.struct(tiers.alias("tiers")).alias("price_tiers"),
                   F.struct(flip(5, s("t2_low"), s("trigger_level")).alias("box_low"), flip(5, s("trigger_level"), s("t2_low")).alias("box_high")).alias("swing_box"),
                   F.struct(s("invalidation_line").alias("line")).alias("invalidation"),
                   F.struct(F.when(d != 7, F.struct(flip(6, F.lit("pb"), F.lit("other")).alias("metric"))).alias("anchor")).alias("valuation"))
    docs = m.cards.select("symbol", s("card_version_id").alias("card_version_id"), F.to_json(doc).alias("doc_json"))
    return cards.check_cards(docs).drop("doc_json")
