"""Logical tables of the engine, derived from the given parquet tables.

Line items are ticks (brand = symbol, price = extended price / quantity), orders give cumulative
quarterly reports, events give announcements and macro readings.
"""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tapeloom.functions.columns import ordered_price, price_of
from tapeloom.operators import (adjust, cards, daily_watch, exhaustion, indicators, outcomes, right_side, timeops,
                                weekly)
from tapeloom.session import cut_lineage


def mark() -> Column:
    """0 to 99 by symbol and day, each on one day in a hundred whatever the volume: places the faults of derived tables."""
    return F.pmod(F.unix_date("trade_date") * 11 + F.substring("symbol", 7, 9).cast("int") * 37, F.lit(100))


class Market:
    def __init__(self, spark: SparkSession, sf_dir: str, shared: bool = True):
        """``shared`` writes the daily bars once as a table: jobs that use them in several branches then scan the
        ticks once. A single-branch job is better off without."""
        self.spark, self.dir, self.shared = spark, sf_dir, shared

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def ticks(self) -> DataFrame:
        brand = self.table("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol"))
        li = self.table("lineitem").where(F.weekday("l_shipdate") < 5)
        return li.join(brand, "l_partkey").select(
            "symbol", F.to_date("l_shipdate").alias("trade_date"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"),
            F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("amt"),
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))

    @cached_property
    def bars0(self) -> DataFrame:
        """At most one row per symbol and open day, however many ticks: hashed together map-side, before the shuffle, unsorted."""
        at = ordered_price(F.col("seq"), "px")
        bars = self.ticks.groupBy("symbol", "trade_date").agg(
            F.min(at).alias("_open"), F.max("px").alias("high_raw"), F.min("px").alias("low_raw"),
            F.max(at).alias("_close"), F.sum("qty").alias("volume_raw"), F.sum("amt").alias("amount_raw"))
        bars = bars.select("symbol", "trade_date", price_of("_open").alias("open_raw"), "high_raw", "low_raw", price_of("_close").alias("close_raw"), "volume_raw", "amount_raw")
        return cut_lineage(bars) if self.shared else bars

    @cached_property
    def daily_bars(self) -> DataFrame:
        n = F.substring("symbol", 7, 9).cast("int")
        return self.bars0.select(
            "*",
            F.when((n % 5 == 0) & (F.col("trade_date") >= "1999-06-15"), 2.0)
            .when((n % 5 == 1) & (F.col("trade_date") >= "1998-06-15"), 1.01).otherwise(1.0).alias("price_adj_factor"),
            F.when((n % 5 == 0) & (F.col("trade_date") < "1999-06-15"), 0.5).otherwise(1.0).alias("share_factor"),
            F.least(F.lit(0.5), F.col("volume_raw") / 2000.0).alias("turnover"))

    @cached_property
    def trading_calendar(self) -> DataFrame:
        if self.shared:
            days = self.bars0.select("trade_date").distinct()
        else:
            li = self.table("lineitem").where(F.weekday("l_shipdate") < 5)
            days = li.select(F.to_date("l_shipdate").alias("trade_date")).distinct()
        return timeops.trading_ordinals(days.select(F.lit("CN").alias("market"), "trade_date", F.lit(True).alias("is_open")))

    @cached_property
    def index_bars(self) -> DataFrame:
        return self.bars0.groupBy("trade_date").agg(F.avg("close_raw").alias("close")).select(
            F.lit("IDX").alias("index_code"), "trade_date", "close")

    @cached_property
    def adj(self) -> DataFrame:
        return adjust.adjusted_bars(self.daily_bars)

    @cached_property
    def weeks(self) -> DataFrame:
        w = weekly.weekly_bars(self.daily_bars, self.trading_calendar)
        return cut_lineage(w) if self.shared else w

    @cached_property
    def reports(self) -> DataFrame:
        o = self.table("orders").select(
            F.concat(F.lit("Brand#"), (F.col("o_custkey") % 25 + 1).cast("int").cast("string")).alias("symbol"),
            F.year("o_orderdate").alias("fiscal_year"), F.quarter("o_orderdate").alias("q"), "o_totalprice")
        g = o.groupBy("symbol", "fiscal_year", "q").agg(F.sum("o_totalprice").alias("rev"))
        w = Window.partitionBy("symbol", "fiscal_year").orderBy("q")
        end = F.last_day(F.make_date("fiscal_year", F.col("q") * 3, F.lit(1)))
        return g.select(
            "symbol", "fiscal_year", "q", end.alias("period_end"),
            F.when(F.col("q") == 4, "annual").when(F.col("q") == 2, "interim").otherwise("quarterly").alias("period_type"),
            F.lit(True).alias("is_cumulative"), F.lit(1).alias("revision"), F.sum("rev").over(w).alias("revenue"),
            F.sum(F.col("rev") * 0.12 - 300000).over(w).alias("net_profit_attr"), F.date_add(end, 30).alias("available_date"))

    @cached_property
    def announcements(self) -> DataFrame:
        return self.table("events").select(
            "event_id", F.concat(F.lit("Brand#"), (F.col("user_id") % 25 + 1).cast("int").cast("string")).alias("symbol"),
            F.date_sub(F.to_date("ts"), 8766).alias("a_date"), "ts", "event_type", "value")

    @cached_property
    def macro_factors(self) -> DataFrame:
        a = self.announcements
        market = F.when(F.col("event_type").isin("click", "view"), "GLOBAL").otherwise("CN")
        return a.groupBy(F.concat(F.lit("F_"), "event_type").alias("code"), market.alias("market"),
                         F.col("a_date").alias("trade_date")).agg(
            F.round(F.avg("value"), 4).cast("decimal(38,10)").alias("close"))

    @cached_property
    def cards(self) -> DataFrame:
        base = self.bars0.where("trade_date < '1999-01-01'").groupBy("symbol").agg(F.avg("close_raw").alias("m0"))
        v = F.explode(F.array(F.lit(1), F.lit(2)))
        x = base.select("symbol", "m0", v.alias("card_version_id")).withColumn(
            "m", F.col("m0") * F.when(F.col("card_version_id") == 1, 1.0).otherwise(0.9))
        first = F.col("card_version_id") == 1
        price = {"t1_low": 0.95, "t1_high": 1.00, "t2_low": 0.75, "t2_high": 0.85, "invalidation_line": 0.60,
                 "trigger_level": 1.20, "stop_level": 1.05}
        return x.select(
            "symbol", "card_version_id", F.when(first, "superseded").otherwise("active").alias("status"),
            F.when(first, F.lit("1999-01-01").cast("date")).otherwise(F.lit("2000-01-01").cast("date")).alias("effective_from"),
            F.when(first, F.lit("2000-01-01").cast("date")).alias("effective_to"),
            *[F.round(F.col("m") * k, 4).cast("decimal(18,4)").alias(n) for n, k in price.items()])

    @cached_property
    def fwd_closes(self) -> DataFrame:
        step = 1 + 0.005 * (F.year("trade_date") - 1998)
        return self.daily_bars.where(mark() < 90).select(
            "symbol", "trade_date", (F.col("close_raw") * F.col("price_adj_factor") * step
                                     * (1 + (mark() - 45) * 0.000002)).alias("close_fwd"))

    @cached_property
    def corporate_actions(self) -> DataFrame:
        w = Window.partitionBy("symbol").orderBy("trade_date")
        s = self.daily_bars.select("symbol", "trade_date", F.col("price_adj_factor").alias("f"), F.col("share_factor").alias("sf"),
                                   F.lag("close_raw").over(w).alias("pc"), F.lag("price_adj_factor").over(w).alias("pf"),
                                   F.lag("share_factor").over(w).alias("psf"))
        none = F.lit(None).cast("double")
        split = s.where("sf <> psf").select("symbol", F.col("trade_date").alias("ex_date"), F.lit("split").alias("action_type"),
                                            none.alias("cash_per_share"), F.round(F.col("sf") / F.col("psf"), 6).alias("split_ratio"))
        step = s.where("f <> pf and sf = psf").select(
            "symbol", F.col("trade_date").alias("ex_date"), F.lit("cash_dividend").alias("action_type"),
            F.round(F.col("pc") * (1 - F.col("pf") / F.col("f")), 4).alias("cash_per_share"), none.alias("split_ratio"))
        news = self.announcements.where("event_type = 'purchase'").groupBy("symbol", F.col("a_date").alias("ex_date")).agg(
            F.round(F.max("value") * 10, 2).alias("cash_per_share")).select(
            "symbol", "ex_date", F.lit("cash_dividend").alias("action_type"), "cash_per_share", none.alias("split_ratio"))
        u = split.unionByName(step).unionByName(news)
        return u.select(F.concat_ws("/", "symbol", F.col("ex_date").cast("string"), "action_type").alias("ca_id"), "*")

    @cached_property
    def spine(self) -> DataFrame:
        return timeops.day_spine(self.trading_calendar)

    @cached_property
    def card_docs(self) -> DataFrame:
        """Cards as the JSON documents the store keeps; some first versions carry a negative price."""
        s = lambda k: F.col(k).cast("string")
        bad = (F.col("card_version_id") == 1) & F.col("symbol").endswith("3")
        tier = lambda n, lo, hi: F.struct(F.lit(n).alias("tier"), lo.alias("zone_low"), s(hi).alias("zone_high"))
        low1 = F.when(bad, F.concat(F.lit("-"), s("t1_low"))).otherwise(s("t1_low"))
        box = {"box_low": "t2_low", "box_high": "trigger_level", "buy_zone_low": "t2_low", "buy_zone_high": "t2_high",
               "sell_zone_low": "t1_high", "sell_zone_high": "stop_level", "box_invalidation": "invalidation_line"}
        eps = F.struct(*[F.round(F.col("invalidation_line") * k, 4).cast("decimal(18,4)").cast("string").alias(n)
                         for n, k in (("bear", 0.04), ("base", 0.05), ("bull", 0.06))])
        return self.cards.select(
            "symbol", s("card_version_id").alias("card_version_id"), "status", "effective_from", "effective_to",
            F.when(F.col("card_version_id") == 2, "1").alias("supersedes_id"), F.date_add("effective_from", 120).alias("next_review_at"),
            F.to_json(F.struct(F.array(tier(1, low1, "t1_high"), tier(2, s("t2_low"), "t2_high")).alias("tiers"))).alias("price_tiers_json"),
            F.to_json(F.struct(s("invalidation_line").alias("line"))).alias("invalidation_json"),
            F.to_json(F.struct(*[s(v).alias(k) for k, v in box.items()])).alias("swing_box_json"),
            F.to_json(F.struct(s("trigger_level").alias("trigger_level"), s("stop_level").alias("stop_level"))).alias("right_side_trigger_json"),
            F.to_json(F.struct(eps.alias("eps"))).alias("earnings_scenarios_json"))

    @cached_property
    def vcards(self) -> DataFrame:
        return cards.parse_cards(self.card_docs)

    @cached_property
    def bars_h(self) -> DataFrame:
        """Daily bars with holes: the close is unknown on one day in a hundred."""
        return self.daily_bars.withColumn("close_raw", F.when(mark() != 1, F.col("close_raw")))

    @cached_property
    def bar_cards(self) -> DataFrame:
        return cards.cards_asof(self.daily_bars, self.vcards)

    @cached_property
    def freezes(self) -> DataFrame:
        return self.corporate_actions.where("action_type = 'split' or cash_per_share >= 2000").select(
            "symbol", "ca_id", "ex_date", "action_type", "cash_per_share")

    @cached_property
    def rescinded(self) -> DataFrame:
        return self.freezes.where("cash_per_share >= 3000")

    @cached_property
    def absorbed(self) -> DataFrame:
        return self.freezes.where("cash_per_share >= 2500 and cash_per_share < 2700")

    @cached_property
    def open_freezes(self) -> DataFrame:
        return cards.open_freezes(self.freezes, self.rescinded, self.absorbed)

    @cached_property
    def weekly_facts(self) -> DataFrame:
        ind = indicators.recursive_indicators(self.weeks, "week_end_date")
        return cut_lineage(exhaustion.exhaustion_facts(self.timeline, self.weeks, self.trading_calendar, ind))

    @cached_property
    def timeline(self) -> DataFrame:
        """Anchors of every week; a table of its own between weeks and facts, so that each plan stays small."""
        return cut_lineage(exhaustion.timeline(self.weeks, self.daily_bars))

    # ------------------------------------------------------------------ reports and shares

    @cached_property
    def rep(self) -> DataFrame:
        """Reports in decimals with a second revision of interim reports, a currency and a publication date."""
        n = F.substring("symbol", 7, 9).cast("int")
        base = self.reports.select(
            "symbol", "fiscal_year", "q", "period_end", "period_type", "is_cumulative", "revision",
            F.round("revenue", 2).cast("decimal(20,2)").alias("revenue"),
            F.round("net_profit_attr", 0).cast("decimal(20,2)").alias("net_profit_attr"), "available_date",
            F.when(n % 10 == 9, "HKD").otherwise("CNY").alias("currency"), F.when(n % 8 != 3, F.col("available_date")).alias("published_at"))
        rev2 = base.where("q = 2").withColumns({
            "revision": F.lit(2), "net_profit_attr": (F.col("net_profit_attr") + 50000).cast("decimal(20,2)"),
            "available_date": F.date_add("available_date", 45)})
        return base.unionByName(rev2)

    @cached_property
    def share_events(self) -> DataFrame:
        g = self.daily_bars.groupBy("symbol", F.year("trade_date").alias("y")).agg(
            F.min("trade_date").alias("effective_at"), F.sum("volume_raw").alias("v"))
        one = g.select("symbol", "effective_at", F.date_add("effective_at", 10).alias("available_at"),
                       (F.col("v") * 1000).cast("decimal(20,2)").alias("shares"), F.lit("issued").alias("share_count_type"),
                       F.when(F.col("y") == 1996, "snapshot_quote").otherwise("issue").alias("event_type"), "y")
        two = one.where("y = 1998").withColumns({"shares": (F.col("shares") * 2).cast("decimal(20,2)"), "share_count_type": F.lit("group_total")})
        return one.unionByName(two).drop("y")

    @cached_property
    def balance(self) -> DataFrame:
        d = lambda e: e.cast("decimal(20,2)")
        rev = F.col("revenue")
        return self.rep.where("revision = 1 and q <> 1").select(
            "symbol", "period_end", "period_type", d(rev * 3).alias("total_assets"), d(rev + 1000000).alias("total_liabilities"),
            d(rev * 2 - 1000000).alias("total_equity_attr"), F.when(F.col("q") == 2, d(rev)).alias("short_term_borrowing"),
            F.when(F.col("q") != 3, d(rev * 2)).alias("long_term_borrowing"), F.lit(None).cast("decimal(20,2)").alias("bonds_payable"),
            F.lit(None).cast("decimal(20,2)").alias("noncurrent_liab_1y"))

    @cached_property
    def cash(self) -> DataFrame:
        return self.rep.where("revision = 1 and q <> 3").select(
            "symbol", "period_end", "period_type", (F.col("net_profit_attr") * 2).cast("decimal(20,2)").alias("ocf"),
            F.lit(250000).cast("decimal(20,2)").alias("capex"))

    @cached_property
    def snapshots(self) -> DataFrame:
        s = lambda e: e.cast("string")
        return self.rep.where("revision = 1 and q <> 2").select(
            "symbol", "period_end", F.create_map(
                F.lit("盈利能力"), F.create_map(F.lit("净资产收益率(ROE)"), s(F.col("fiscal_year")), F.lit("毛利率"), F.lit("1")),
                F.lit("常用指标"), F.create_map(F.lit("毛利率"), s(F.col("q")), F.lit("营业总收入"), s(F.col("revenue")))).alias("payload"))

    @cached_property
    def forecasts(self) -> DataFrame:
        a = self.rep.where("period_type = 'annual'")
        s = lambda k: (F.col("net_profit_attr") * k).cast("decimal(24,2)").cast("string")
        blank = F.struct(F.lit("").alias("ths_fore_np_fy1_stock"), F.lit("9").alias("ths_fore_np_fy2_stock"), F.lit("").alias("ths_fore_np_fy3_stock"),
                         F.lit("").alias("ths_fore_np_yoy_stock"), F.lit("3.25").alias("ths_pb_mrq_stock"), F.lit("").alias("ths_ps_lyr_stock"))
        real = F.struct(s(2).alias("ths_fore_np_fy1_stock"), s(3).alias("ths_fore_np_fy2_stock"),
                        F.when(F.col("fiscal_year") % 2 == 0, s(4)).otherwise("").alias("ths_fore_np_fy3_stock"), F.lit("12.5").alias("ths_fore_np_yoy_stock"),
                        F.lit("4").alias("ths_pb_mrq_stock"), F.lit("1.5").alias("ths_ps_lyr_stock"))
        return a.select("symbol", F.date_add("period_end", 60).alias("snapshot_at"),
                        F.to_json(F.struct(F.array(blank, real).alias("rows"))).alias("payload_json"))

    # ------------------------------------------------------------------ messages and macro

    @cached_property
    def symbols(self) -> DataFrame:
        return self.daily_bars.select("symbol").distinct()

    @cached_property
    def watchlist(self) -> DataFrame:
        n = F.substring("symbol", 7, 9).cast("int")
        s = F.array
        themes = (F.when(n % 4 == 0, s(F.lit("黄金"))).when(n % 4 == 1, s(F.lit("铜"))).when(n % 4 == 2, s(F.lit("白酒"), F.lit("la")))
                  .otherwise(F.array().cast("array<string>")))
        return self.symbols.select(
            "symbol", F.when(n % 2 == 0, "CN").otherwise("HK").alias("market"), F.concat(F.lit("Pool "), n.cast("string")).alias("name"),
            F.array(F.concat(F.lit("alias"), n.cast("string"))).alias("aliases"), themes.alias("themes"),
            F.concat(F.lit("BK"), (n % 3).cast("string")).alias("industry_code"), (n % 6 != 5).alias("active"))

    @cached_property
    def industry(self) -> DataFrame:
        n = F.substring("symbol", 7, 9).cast("int")
        return self.symbols.select("symbol", F.when(n % 3 == 0, "白酒").when(n % 3 == 1, "黄金").otherwise("than").alias("industry_name"))

    @cached_property
    def news(self) -> DataFrame:
        titles = ("央行降准落地", "财政部公布新规", "黄金周消费回暖", "国务院谈国际黄金价格", "美联储表态后电解铜库存下降", "商务部调研白酒企业")
        title = F.element_at(F.array(*[F.lit(t) for t in titles]), (F.col("doc_id") % 6 + 1).cast("int"))
        when = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("doc_id").cast("int"))
        kind = F.when(F.col("lang") == "fr", "announcement").when(F.col("lang") == "de", "flow").otherwise("news")
        return self.table("documents").select(
            F.col("doc_id").alias("event_id"), kind.alias("event_type"), title.alias("title"), F.col("text").alias("summary"),
            when.alias("published_at"), when.alias("available_at"), (F.col("doc_id") % 4 + 1).cast("int").alias("source_tier"), "source")

    @cached_property
    def assessed(self) -> DataFrame:
        return self.table("labels").select(F.col("doc_id").alias("event_id"))

    @cached_property
    def reviews(self) -> DataFrame:
        e, k = self.announcements, F.col("event_type")
        users = self.table("events").select("event_id", "user_id")
        action = (F.when((k == "view") | k.isin("click", "signup") & (F.col("value") < 150), "note").when(k == "click", "confirm").when(k == "signup", "dismiss")
                  .when(k == "purchase", "upgrade_materiality").otherwise("amend"))
        v = F.col("value")
        mat = F.when(v < 20, "low").when(v < 60, "medium").when(v < 120, "high").otherwise("critical")
        return e.join(users, "event_id").select(
            F.col("event_id").alias("review_id"), F.col("user_id").alias("event_id"),
            F.when(F.col("event_id") % 3 == 0, F.col("symbol")).otherwise("__event__").alias("symbol"), F.col("ts").alias("reviewed_at"),
            action.alias("action"), mat.alias("materiality"), F.when(v > 50, "gap").alias("expectation_gap"),
            F.when(v < 10, F.lit("line")).alias("falsification"), F.when(F.col("event_id") % 2 == 0, "eps").alias("target"),
            F.when(F.col("event_id") % 5 == 0, "week").alias("half_life"))

    @cached_property
    def event_links(self) -> DataFrame:
        return self.table("events").select(
            F.col("user_id").alias("event_id"), F.concat(F.lit("Brand#"), (F.col("user_id") % 25 + 1).cast("int").cast("string")).alias("symbol")).distinct()

    @cached_property
    def assessments(self) -> DataFrame:
        u = F.col("event_id")
        pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (u % len(v) + 1).cast("int"))
        none = F.lit(None).cast("string")
        return self.event_links.where(u % 7 != 0).select(
            "event_id", F.when(u % 4 == 0, "ok").otherwise("needs_review").alias("status"), pick("positive", "negative", "neutral").alias("direction"),
            F.lit("medium").alias("materiality"), ((u % 10) / 10).alias("confidence"), F.lit("r").alias("rationale"), none.alias("target"),
            F.lit("day").alias("half_life"), none.alias("expectation_gap"))

    @cached_property
    def event_calendar(self) -> DataFrame:
        a = self.reports.select(F.lit("report_disclosure").alias("kind"), "symbol", F.col("available_date").alias("scheduled_date"),
                                F.lit(7).alias("remind_before_days"), F.col("period_end").cast("string").alias("note"))
        b = self.macro_factors.select(F.lit("macro_release").alias("kind"), F.lit(None).cast("string").alias("symbol"),
                                      F.date_add("trade_date", 95).alias("scheduled_date"), F.lit(3).alias("remind_before_days"), F.col("code").alias("note"))
        return a.unionByName(b)

    @cached_property
    def study_events(self) -> DataFrame:
        k = F.col("event_type")
        shift = F.when(k == "error", 652).when(k == "view", -1840).otherwise(0)
        return self.announcements.select("event_id", "symbol", F.date_add("a_date", shift).alias("a_date"), "event_type", "ts")

    @cached_property
    def index_h(self) -> DataFrame:
        return self.index_bars.where("close >= 1500")

    # ------------------------------------------------------------------ signals, decisions, executions

    @cached_property
    def sig_facts(self) -> DataFrame:
        """Tier, falsification, box and right-side facts of all days; written once as they feed several branches."""
        x = daily_watch.box_position(daily_watch.falsification(daily_watch.tier_trigger(
            self.bar_cards, exhaustion.active_counts(self.weekly_facts), self.weeks)))
        row = lambda sig, st, trig: F.struct(F.lit(sig).alias("signal"), st.alias("state"), trig.alias("triggered"))
        rows = F.array(row("tier_triggered", F.col("trig_state"), F.col("trig_state") == "triggered"),
                       row("falsification_breach", F.col("fals_state"), F.col("fals_triggered")),
                       row("box_position", F.col("box_state"), F.col("box_state").isin("buy_zone", "sell_zone", "box_breached")))
        a = x.select("symbol", F.col("trade_date").alias("observed_on"), "card_version_id", F.explode(rows).alias("s")).select(
            "symbol", "observed_on", "card_version_id", "s.*")
        rs = right_side.right_side(cards.cards_asof(right_side.right_side_inputs(self.daily_bars), self.vcards))
        b = rs.select("symbol", "observed_on", "card_version_id", F.lit("right_side").alias("signal"), "state", "triggered")
        return cut_lineage(a.unionByName(b))

    @cached_property
    def cn_spine(self) -> DataFrame:
        return self.spine.where("market = 'CN'").drop("market")

    @cached_property
    def entries(self) -> DataFrame:
        """All entry points with their closes."""
        close = self.daily_bars.select("symbol", F.col("trade_date").alias("decision_date"), F.col("close_raw").alias("entry_close"))
        return outcomes.entry_points(self.sig_facts, self.trading_calendar).join(close, ["symbol", "decision_date"])

    @cached_property
    def decisions(self) -> DataFrame:
        d = F.dayofmonth("decision_date")
        dec = F.when(d % 4 < 2, "follow").when(d % 4 == 2, "skip").otherwise("counter")
        return self.entries.select(
            F.concat_ws("/", "symbol", F.col("decision_date").cast("string"), "source").alias("position_id"), "symbol", "decision_date",
            F.lit("entry").alias("decision_type"), F.col("source").alias("signal_source"), dec.alias("decision"), "entry_close",
            F.when(d % 5 == 0, "single_position").alias("constraint_tag"), (d % 7 == 0).alias("late"), F.when(d % 11 == 0, 1).alias("reversed_by"))

    @cached_property
    def positions(self) -> DataFrame:
        return self.decisions.where("decision = 'follow'").select(
            "position_id", "symbol", F.col("decision_date").alias("entry_date"), "entry_close", F.col("signal_source").alias("source"),
            F.round(F.col("entry_close") * 0.95, 6).alias("deep_exit_line"))

    @cached_property
    def executions(self) -> DataFrame:
        """All orders; symbols stop trading at different times, so that some signals have no execution after them."""
        n = (F.col("o_custkey") % 25 + 1).cast("int")
        return self.table("orders").select(
            F.col("o_orderkey").alias("execution_id"), F.concat(F.lit("Brand#"), n.cast("string")).alias("symbol"),
            (F.col("o_orderdate") - F.make_dt_interval(days=n % 8 * 100)).alias("executed_at"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("action_type"),
            F.when(F.col("o_orderstatus") == "P", F.col("o_orderkey") - 1).alias("reverses_execution_id"))

    @cached_property
    def anchor_rows(self) -> DataFrame:
        return exhaustion.anchor_ids(self.timeline)

    # ------------------------------------------------------------------ vendor files (text columns, as read from CSV)

    @cached_property
    def full_cal(self) -> DataFrame:
        """Every natural day of the domestic calendar with its open flag; the other market has no calendar."""
        s = self.trading_calendar.agg(F.min("trade_date").alias("a"), F.max("trade_date").alias("b"))
        days = s.select(F.explode(F.sequence("a", "b")).alias("trade_date"))
        return days.join(self.trading_calendar.select("trade_date", "is_open"), "trade_date", "left").select(
            F.lit("CN").alias("market"), "trade_date", F.coalesce("is_open", F.lit(False)).alias("is_open"))

    @cached_property
    def vendor(self) -> DataFrame:
        """Bars as a vendor would deliver them: one file per symbol and year, with empty bars, broken bars and bars on closed days."""
        n = F.substring("symbol", 7, 9).cast("int")
        hk = n % 5 == 0
        v, k = F.col("volume_raw"), mark()
        td = F.when((k == 3) & (F.dayofmonth("trade_date") == 7), F.date_add(F.trunc("trade_date", "week"), 6)).otherwise(F.col("trade_date"))
        p = lambda k: F.round(k, 7).cast("decimal(18,7)")
        high = F.when((k == 1) & (F.dayofmonth("trade_date") == 13), (p("low_raw") / 2).cast("decimal(18,7)")).otherwise(p("high_raw"))
        s = lambda e: F.when(k == 2, "").otherwise(e.cast("string"))
        x = self.daily_bars.select(
            F.when(hk, F.lpad(n.cast("string"), 5, "0")).otherwise((n + 600000).cast("string")).alias("code"), F.when(hk, "31").otherwise("1").alias("setcode"),
            F.when(hk, ".HK").otherwise(".SH").alias("_sfx"), td.alias("td"), F.year("trade_date").alias("yr"), s(p("open_raw")).alias("open"), s(high).alias("high"), s(p("low_raw")).alias("low"),
            s(p("close_raw")).alias("close"), v.cast("int").cast("string").alias("volume"), F.round("amount_raw", 2).cast("decimal(18,2)").cast("string").alias("amount"),
            F.round("turnover", 4).cast("decimal(10,4)").cast("string").alias("turnover"), v.alias("v"), k.alias("k"))
        return x.select("*", F.concat("code", "_sfx").alias("thscode"), F.date_format("td", "yyyyMMdd").alias("time"), F.lit("CNY").alias("currency")).drop("_sfx")

    def vendor_files(self, source: str, kind: str) -> DataFrame:
        path = F.concat(F.lit(f"data/raw/{source}/{kind}/"), F.col("yr").cast("string"), F.lit("-12-31/run1/"), F.col("thscode"), F.lit(".csv"))
        return self.vendor.withColumn("file_path", path)

    @cached_property
    def raw_files(self) -> DataFrame:
        """One row per document: a path below the raw folder and its content."""
        kinds = ("stock_finance_data/price", "tdx/kline", "akshare/price", "akshare/telegraph", "tdx/unknown", "yahoo_finance/fx")
        i = F.col("doc_id")
        kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (i % len(kinds) + 1).cast("int"))
        tag = F.when(i % 4 == 0, "_forward").when(i % 4 == 1, "_tq1").otherwise("")
        stem = F.concat(F.lit("Brand#"), (i % 40 + 1).cast("int").cast("string"), tag)
        return self.table("documents").select(F.concat(F.lit("data/raw/"), kind, F.lit("/2001-12-31/run"), i.cast("string"), F.lit("/"), stem, F.lit(".csv")).alias("file_path"),
                                              F.sha2("text", 256).alias("content_hash"), F.col("doc_id"))

    @cached_property
    def runs(self) -> DataFrame:
        k = F.col("event_type")
        users = self.table("events").select("event_id", "user_id")
        status = F.when(k == "click", "degraded").when(k == "error", "failed").when(k == "signup", "running").otherwise("success")
        end = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.round(F.col("value") * 100).cast("long") * 10000)
        return self.announcements.join(users, "event_id").select(
            F.col("event_id").alias("run_key"), F.concat(F.lit("run_"), F.col("user_id").cast("string")).alias("run_id"), F.concat(F.lit("symbol:"), "symbol").alias("stage"), status.alias("status"),
            F.when(k == "error", F.concat(F.lit("boom "), F.floor("value").cast("string"))).alias("error"), F.col("ts").cast("timestamp").alias("started_at"), F.when(k != "signup", end).alias("finished_at"))

    @cached_property
    def day_facts(self) -> DataFrame:
        """Falsification, box and right-side facts of all days."""
        x = daily_watch.box_position(daily_watch.falsification(self.bar_cards))
        row = lambda sig, st, trig: F.struct(F.lit(sig).alias("signal"), st.alias("state"), trig.alias("triggered"))
        rows = F.array(row("falsification_breach", F.col("fals_state"), F.col("fals_triggered")),
                       row("box_position", F.col("box_state"), F.col("box_state").isin("buy_zone", "sell_zone", "box_breached")))
        a = x.select("symbol", F.col("trade_date").alias("observed_on"), "card_version_id", F.explode(rows).alias("s")).select(
            "symbol", "observed_on", "card_version_id", "s.*")
        rs = right_side.right_side(cards.cards_asof(right_side.right_side_inputs(self.daily_bars), self.vcards))
        return a.unionByName(rs.select("symbol", "observed_on", "card_version_id", F.lit("right_side").alias("signal"), "state", "triggered"))
