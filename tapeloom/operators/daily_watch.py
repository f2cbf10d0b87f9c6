"""Daily card signals. Thresholds are compared in decimals, so closes are cast before comparing."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapeloom.functions.columns import dec
from tapeloom.operators.timeops import asof
from tapeloom.params import BREACH_PCT, CONFIRM_DAYS, PROXIMITY_PCT

CLOSE = "decimal(28,10)"


def pct(v: str) -> Column:
    return F.lit(v).cast("decimal(6,4)")


def _zones(x: DataFrame) -> DataFrame:
    """Tiers with their position against the close, lowest tier number first."""
    close = F.col("close_raw").cast(CLOSE)

    def place(t):
        inside = (t["zone_low"] <= close) & (close <= t["zone_high"])
        bound = F.when(close < t["zone_low"], t["zone_low"]).otherwise(t["zone_high"])
        return F.struct(t["tier"].alias("tier"), inside.alias("inside"), bound.alias("bound"),
                        (~inside & (F.abs(close - bound) <= bound * pct(PROXIMITY_PCT))).alias("near"))
    live = F.filter("tiers", lambda t: t["zone_low"].isNotNull() & t["zone_high"].isNotNull())
    return x.withColumn("zones", F.array_sort(F.transform(live, place)))


def tier_proximity(x: DataFrame) -> DataFrame:
    """Active when a zone the close is not in lies within 3 % of its nearest bound."""
    z = _zones(x)
    hit = F.filter("zones", lambda t: t["near"])
    tier = F.when(F.size(hit) > 0, hit[0]["tier"])
    z = z.withColumns({"prox_tier": tier})
    return z.withColumns({
        "prox_state": F.when(F.col("prox_tier").isNotNull(), "active").otherwise("inactive"),
        "prox_reason": F.when(F.col("prox_tier").isNotNull(), F.concat(F.lit("within_3%_of_tier_"), F.col("prox_tier").cast("string")))
        .otherwise("no_tier_within_threshold")})


def tier_trigger(x: DataFrame, counts: DataFrame, weeks: DataFrame) -> DataFrame:
    """Close inside a zone; tiers from 2 on also need enough active exhaustion signals at the last completed week."""
    wk = weeks.select("symbol", "week_end_date").join(
        counts.select("symbol", F.col("observed_on").alias("week_end_date"), "meets_min", "active_count"),
        ["symbol", "week_end_date"], "left")
    y = asof(_zones(x) if "zones" not in x.columns else x, wk, ["symbol"], "trade_date", "week_end_date",
             ["meets_min", "active_count", F.col("week_end_date").alias("completed_week")])
    met = F.coalesce("meets_min", F.lit(False))
    go = F.filter("zones", lambda t: t["inside"] & ((t["tier"] < 2) | met))
    wait = F.filter("zones", lambda t: t["inside"] & (t["tier"] >= 2) & ~met)
    last = lambda a: F.when(F.size(a) > 0, F.element_at(a, -1)["tier"])
    y = y.withColumns({"trig_tier": last(go), "pend_tier": last(wait)})
    hit, pend = F.col("trig_tier"), F.col("pend_tier")
    return y.withColumns({
        "trig_state": F.when(hit.isNotNull(), "triggered").when(pend.isNotNull(), "pending_signals").otherwise("inactive"),
        "trig_reason": F.when(hit.isNotNull(), F.concat(F.lit("close_in_tier_"), hit.cast("string"), F.lit("_zone")))
        .when(pend.isNotNull(), F.concat(F.lit("tier_"), pend.cast("string"), F.lit("_zone_entered_but_active_signals<2")))
        .otherwise("no_tier_zone_entered")})


def breached() -> Column:
    """Close at or below the line less 1 %."""
    line = F.col("invalidation_line") * (F.lit(1).cast("decimal(6,4)") - pct(BREACH_PCT))
    return F.col("close_raw").cast(CLOSE) <= line


def falsification(x: DataFrame) -> DataFrame:
    """Closes at or below the line less 1 %: confirmed on the second day in a row, then holding. Counts restart per card."""
    w = Window.partitionBy("symbol", "card_version_id").orderBy("trade_date")
    y = x.withColumn("breached", breached())
    y = y.withColumn("_g", F.sum(F.when(F.col("breached"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("symbol", "card_version_id", "_g").orderBy("trade_date")
    y = y.withColumn("run", F.sum(F.when(F.col("breached"), 1).otherwise(0)).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.coalesce(F.lag("run").over(w), F.lit(0))
    run, done = F.col("run"), F.col("run") >= CONFIRM_DAYS
    return y.withColumns({
        "fals_state": F.when(done, "active").when(F.col("breached"), "watching").otherwise("inactive"),
        "fals_triggered": run == CONFIRM_DAYS,
        "fals_reason": F.when(run == CONFIRM_DAYS, "confirmed").when(done, "holding")
        .when(F.col("breached"), F.concat(F.lit("breach_day_"), run.cast("string"), F.lit(f"_of_{CONFIRM_DAYS}")))
        .when(before >= CONFIRM_DAYS, "recovered").otherwise("no_breach")}).drop("_g")


def box_state(close: Column, box: str = "box") -> Column:
    b = lambda k: F.col(f"{box}.{k}")
    zone = lambda k: (b(f"{k}_zone_low") <= close) & (close <= b(f"{k}_zone_high"))
    return (F.when(close < b("box_invalidation"), "box_breached").when(close > b("box_high"), "above_box")
            .when(zone("sell"), "sell_zone").when(zone("buy"), "buy_zone").when(close < b("box_low"), "below_box").otherwise("mid_box"))


def box_position(x: DataFrame) -> DataFrame:
    state = box_state(F.col("close_raw").cast(CLOSE))
    return x.withColumn("box_state", F.when(F.col("box").isNotNull() & F.col("close_raw").isNotNull(), state))


def ma_compare(x: DataFrame) -> DataFrame:
    """Adjusted averages folded by the day's factor against the raw close."""
    f = F.col("price_adj_factor")
    side = lambda k: F.when(F.col("close_raw") > F.col(k) / f, "above").when(F.col("close_raw") < F.col(k) / f, "below").when(
        F.col(k).isNotNull(), "at")
    pos = F.array_compact(F.array(side("ma20"), side("ma60")))
    all_are = lambda v: F.forall(pos, lambda p: p == v)
    bad = f.isNull() | (f <= 0)
    state = (F.when(bad | (F.size(pos) == 0), "incomplete").when(all_are("above"), "above").when(all_are("below"), "below").otherwise("mixed"))
    reason = F.when(bad, "missing_adj_factor").when(F.size(pos) == 0, "missing_indicators").otherwise("adjusted_ma_folded_by_factor")
    return x.withColumns({"ma_state": state, "ma_reason": reason})


def tier_state(x: DataFrame) -> DataFrame:
    """For display: the zone the close is in and how far from its edge, else the nearest bound and the signed distance."""
    close = F.col("close_raw")
    d = lambda v: v.cast("double")
    inside = F.filter("tiers", lambda t: (d(t["zone_low"]) <= close) & (close <= d(t["zone_high"])))
    hit = F.when(F.size(inside) > 0, inside[0])
    edge = F.least((close - d(hit["zone_low"])) / d(hit["zone_low"]), (d(hit["zone_high"]) - close) / d(hit["zone_high"])) * 100
    bounds = F.flatten(F.transform("tiers", lambda t: F.array(
        F.struct(F.abs(close - d(t["zone_low"])).alias("dist"), t["tier"].alias("tier"), d(t["zone_low"]).alias("bound")),
        F.struct(F.abs(close - d(t["zone_high"])).alias("dist"), t["tier"].alias("tier"), d(t["zone_high"]).alias("bound")))))
    near = F.array_min(bounds)
    ok = close.isNotNull() & (F.size("tiers") > 0)
    return x.withColumns({
        "in_tier": F.when(ok, hit["tier"]), "nearest_tier": F.when(ok & hit.isNull(), near["tier"]),
        "nearest_bound": F.when(ok & hit.isNull(), near["bound"]),
        "dist_pct": F.when(ok, F.when(hit.isNotNull(), edge).otherwise((close - near["bound"]) / near["bound"] * 100))})


def daily_watch(bar_cards: DataFrame, ma: DataFrame, counts: DataFrame, weeks: DataFrame, freezes: DataFrame) -> DataFrame:
    """All daily card signals as rows. Days without a close and days from the earliest open freeze on report that
    instead, and stay outside the falsification count."""
    frozen = freezes.groupBy("symbol").agg(F.min("ex_date").alias("frozen_from"))
    x = bar_cards.join(frozen, "symbol", "left")
    gap = F.col("close_raw").isNull()
    stop = ~gap & F.coalesce(F.col("trade_date") >= F.col("frozen_from"), F.lit(False))
    key = ["symbol", F.col("trade_date").alias("observed_on"), "card_version_id"]
    row = lambda sig, st, trig, why: F.struct(F.lit(sig).alias("signal"), st.alias("state"), trig.alias("triggered"), why.alias("reason"))
    held = x.where(gap | stop).select(*key, F.when(gap, row("daily_watch", F.lit("incomplete"), F.lit(False), F.lit("missing_close_raw"))).otherwise(
        row("daily_watch", F.lit("suspended"), F.lit(False), F.lit("suspended_corporate_action"))).alias("s")).select("symbol", "observed_on", "card_version_id", "s.*")
    live = x.where(~gap & ~stop)
    y = live.join(ma.select("symbol", "trade_date", "ma20", "ma60"), ["symbol", "trade_date"], "left")
    y = ma_compare(box_position(falsification(tier_trigger(tier_proximity(y), counts, weeks))))
    has_tiers, has_line = F.coalesce(F.size("tiers") > 0, F.lit(False)), F.col("invalidation_line").isNotNull()
    no = F.lit(False)
    rows = F.array_compact(F.array(
        F.when(has_tiers, row("tier_proximity", F.col("prox_state"), F.col("prox_state") == "active", F.col("prox_reason"))),
        F.when(has_tiers, row("tier_triggered", F.col("trig_state"), F.col("trig_state") == "triggered", F.col("trig_reason"))).otherwise(
            row("tier_triggered", F.lit("incomplete"), no, F.lit("missing_price_tiers"))),
        F.when(has_line, row("falsification_breach", F.col("fals_state"), F.col("fals_triggered"), F.col("fals_reason"))).otherwise(
            row("falsification_breach", F.lit("incomplete"), no, F.lit("missing_invalidation_line"))),
        F.when(F.col("box_state").isNotNull(), row("box_position", F.col("box_state"),
                                                   F.col("box_state").isin("buy_zone", "sell_zone", "box_breached"), F.col("box_state"))),
        row("ma_comparison", F.col("ma_state"), no, F.col("ma_reason"))))
    return y.select(*key, F.explode(rows).alias("s")).select("symbol", "observed_on", "card_version_id", "s.*").unionByName(held)


def uncovered(as_of: DataFrame, cards: DataFrame) -> DataFrame:
    """Symbols that no card covers on their as-of day."""
    any_card = cards.select("symbol").distinct().withColumn("_any", F.lit(True))
    from tapeloom.operators.cards import cards_asof
    have = cards_asof(as_of, cards).select("symbol", "trade_date")
    return as_of.join(have, ["symbol", "trade_date"], "left_anti").join(any_card, "symbol", "left").select(
        "symbol", F.col("trade_date").alias("observed_on"), F.lit(None).cast("string").alias("card_version_id"),
        F.lit("daily_watch").alias("signal"), F.lit("incomplete").alias("state"), F.lit(False).alias("triggered"),
        F.when(F.col("_any"), "card_not_effective_at_as_of").otherwise("no_active_card").alias("reason"))


def decimals(x: DataFrame) -> DataFrame:
    return x.withColumn("close_dec", dec("close_raw"))
