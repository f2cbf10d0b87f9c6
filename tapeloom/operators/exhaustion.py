"""Weekly anchors and exhaustion signals.

Variable look-backs are not range self-joins: every week carries, from bounded row frames, what it would
contribute as an anchor (its decline start, the lows after it, the base volume), and the week that picks it
as anchor fetches that by one equi-join on the week index.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tapeloom.functions.columns import full, previous, series, short_hash, week_of
from tapeloom.operators.timeops import run_ids
from tapeloom.operators.weekly import calendar_weeks
from tapeloom.params import (ACTIVE_WEEKS, ANCHOR_LOOKBACK, DIVERGENCE_LOOKBACK, DRYUP_RATIO, DRYUP_WEEKS, DURATION_WEEKS,
                             MIN_ACTIVE, NO_LOW_WEEKS, PANIC_BASE_WEEKS, PANIC_VOLUME, PIVOT_SIDE, SHADOW_BODY,
                             SHADOW_RANGE, YANG_BODY, YANG_GAIN)

def W():
    return series("symbol", order="week_end_date")


def indexed(weeks: DataFrame) -> DataFrame:
    return weeks.withColumn("idx", F.row_number().over(W()) - 1)


def panic(weeks: DataFrame) -> DataFrame:
    """Volume of twice the base with a long lower shadow or a large rising body."""
    body = F.abs(F.col("close") - F.col("open"))
    span = F.col("high") - F.col("low")
    shadow = F.least("open", "close") - F.col("low")
    long_shadow = (shadow >= SHADOW_BODY * body) & (shadow >= SHADOW_RANGE * span)
    yang = ((F.col("close") > F.col("open")) & (body >= YANG_BODY * span)
            & (F.col("close") / F.lag("close").over(W()) - 1.0 >= YANG_GAIN))
    x = indexed(weeks).withColumns({"vol_base": previous(F.avg, "volume", W(), PANIC_BASE_WEEKS)})
    hit = (F.col("volume") >= PANIC_VOLUME * F.col("vol_base")) & (span > 0) & (long_shadow | yang)
    return x.withColumns({"lower_shadow": shadow, "body": body, "panic": F.coalesce(hit, F.lit(False))})


def anchor_index(weeks: DataFrame) -> DataFrame:
    """Week index of the panic-low anchor: the last panic week, else the lowest close of the look-back (latest on ties)."""
    x = weeks if "panic" in weeks.columns else panic(weeks)
    last_panic = F.last(F.when(F.col("panic"), F.col("idx")), True).over(W().rowsBetween(Window.unboundedPreceding, 0))
    lowest = F.min_by("idx", F.struct("close", -F.col("idx"))).over(W().rowsBetween(-ANCHOR_LOOKBACK + 1, 0))
    return x.withColumns({"anchor_idx": F.coalesce(last_panic, lowest), "is_fallback": last_panic.isNull()})


def week_lows(bars: DataFrame) -> DataFrame:
    """Day of the lowest adjusted low in each ISO week, earliest on ties; days without a low do not count."""
    f = F.coalesce("price_adj_factor", F.lit(1.0))
    x = bars.select("symbol", week_of("trade_date").alias("wk"), "trade_date", "low_raw", (F.col("low_raw") * f).alias("low_adj"))
    best = F.min_by(F.struct("trade_date", "low_adj", "low_raw"), F.struct("low_adj", "trade_date")).alias("b")
    return x.where("low_adj is not null").groupBy("symbol", "wk").agg(best).select(
        "symbol", "wk", F.col("b.trade_date").alias("low_date"), "b.low_adj", "b.low_raw")


def decline_start(weeks: DataFrame) -> DataFrame:
    """Highest close of the look-back before each week, latest on ties, with the base volume after it."""
    x = weeks if "idx" in weeks.columns else indexed(weeks)
    x = x.withColumn("_base", full(F.avg, "volume", W(), 1, DRYUP_WEEKS, DRYUP_WEEKS))
    top = F.max_by(F.struct(F.col("idx").alias("decl_idx"), F.col("week_end_date").alias("decl_date"), F.col("close").alias("decl_close"),
                            F.col("close_raw").alias("decl_close_raw"), F.col("_base").alias("decl_base")),
                   F.struct("close", "idx")).over(W().rowsBetween(-ANCHOR_LOOKBACK, -1))
    return x.withColumn("_d", top).select(*[c for c in x.columns if c != "_base"], "_d.*")


def timeline(weeks: DataFrame, bars: DataFrame) -> DataFrame:
    """For every completed week: its panic-low anchor and decline start, from data up to that week."""
    x = anchor_index(panic(weeks))
    low3 = full(F.min, "low", W(), 1, NO_LOW_WEEKS, NO_LOW_WEEKS)
    info = decline_start(x.withColumn("low3", low3)).join(week_lows(bars), ["symbol", "wk"]).select(
        "symbol", F.col("idx").alias("anchor_idx"), F.col("week_end_date").alias("anchor_week"), "low_date", "low_adj", "low_raw",
        "low3", "decl_idx", "decl_date", "decl_close", "decl_close_raw", "decl_base")
    keep = ["symbol", "idx", "wk", "week_end_date", "close", "low", "volume", "panic", "anchor_idx", "is_fallback"]
    return x.select(*keep).join(info, ["symbol", "anchor_idx"])


def anchor_ids(tl: DataFrame) -> DataFrame:
    """One row per anchor identity with a stable id and the week it first appeared."""
    def side(kind, date, adj, raw):
        return F.struct(F.lit(kind).alias("anchor_type"), F.col(date).alias("trade_date"), F.col(adj).alias("adjusted_price"),
                        F.col(raw).alias("raw_price"))
    both = tl.select("symbol", "week_end_date", "is_fallback", F.explode(F.array(
        side("panic_low", "low_date", "low_adj", "low_raw"), side("decline_start", "decl_date", "decl_close", "decl_close_raw"))).alias("a"))
    g = both.where("a.trade_date is not null").groupBy("symbol", "a.anchor_type", "a.trade_date", "is_fallback").agg(
        F.min("week_end_date").alias("as_of"), F.min("a.adjusted_price").alias("adjusted_price"), F.min("a.raw_price").alias("raw_price"))
    return g.select(anchor_id(F.col("anchor_type"), F.col("trade_date")).alias("anchor_id"), "*")


def anchor_id(kind: Column, date: Column) -> Column:
    return short_hash("symbol", kind, date.cast("string"), F.col("is_fallback").cast("string"))


def episode_end(tl: DataFrame) -> DataFrame:
    """First week of a run of equal anchors whose close exceeds the run's first decline close."""
    changed = ~(F.lag("low_date").over(W()).eqNullSafe(F.col("low_date")) & F.lag("is_fallback").over(W()).eqNullSafe(F.col("is_fallback")))
    x = tl.withColumn("run", run_ids(changed, W()))
    run = Window.partitionBy("symbol", "run").orderBy("week_end_date")
    top = F.first("decl_close").over(run)
    past = F.when(F.col("close") > F.col("_top"), F.struct("idx", "week_end_date"))
    x = x.withColumn("_top", top).withColumn("_end", F.min(past).over(run.rowsBetween(Window.unboundedPreceding, 0)))
    return x.withColumns({"end_idx": F.col("_end.idx"), "end_week": F.col("_end.week_end_date")}).drop("_top", "_end")


def projected_ends(weeks: DataFrame, cal: DataFrame, ahead: int = ACTIVE_WEEKS - 1) -> DataFrame:
    """Week end ``ahead`` completed weeks later; past the last one, of the calendar weeks after it."""
    c = Window.orderBy("wk")
    nxt = calendar_weeks(cal).select("wk", F.array(*[F.lead("week_end_date", k).over(c) for k in range(1, ahead + 1)]).alias("_next"))
    x = weeks.select("symbol", "wk", "idx", "week_end_date")
    last = x.groupBy("symbol").agg(F.max("wk").alias("_w"), F.count("*").alias("_n")).join(
        nxt.withColumnRenamed("wk", "_w"), "_w", "left")
    x = x.withColumn("_lead", F.lead("week_end_date", ahead).over(W())).join(last, "symbol")
    k = (F.col("idx") + ahead - F.col("_n") + 1).cast("int")
    return x.select("symbol", "idx", "week_end_date", F.when(F.col("_lead").isNotNull(), F.col("_lead")).otherwise(
        F.when(k >= 1, F.element_at("_next", k))).alias("until"))


def dryup(tl: DataFrame) -> DataFrame:
    cond = F.col("volume") <= DRYUP_RATIO * F.col("decl_base")
    few = F.col("idx") <= F.col("decl_idx") + DRYUP_WEEKS
    reason = (F.when(F.col("decl_idx").isNull(), "no_decline_start").when(few, "insufficient_base_weeks")
              .when(cond, "condition_met").otherwise("condition_not_met"))
    return tl.withColumn("dry_reason", reason)


def no_new_low(tl: DataFrame) -> DataFrame:
    gap = F.col("idx") - F.col("anchor_idx")
    reason = (F.when(gap < NO_LOW_WEEKS, "waiting_confirm").when(F.col("low3") < F.col("low_adj"), "broken_before_confirm")
              .when(F.col("low") < F.col("low_adj"), "new_low").when(gap == NO_LOW_WEEKS, "confirmed").otherwise("holding"))
    return tl.withColumn("nnl_reason", reason)


def pivot_low(weeks: DataFrame) -> DataFrame:
    """Low strictly below those of the two weeks on either side."""
    x = weeks if "idx" in weeks.columns else indexed(weeks)
    around = [F.lag("low", k).over(W()) for k in range(1, PIVOT_SIDE + 1)] + [F.lead("low", k).over(W()) for k in range(1, PIVOT_SIDE + 1)]
    ok = F.lit(True)
    for v in around:
        ok = ok & (v > F.col("low"))
    return x.withColumn("is_pivot", F.coalesce(ok, F.lit(False)))


def divergence(weeks: DataFrame, ind: DataFrame) -> DataFrame:
    """At the week that confirms a pivot: price lower than at the pivot before, RSI12 or MACD bar higher."""
    x = pivot_low(weeks).select("symbol", "idx", "week_end_date", "close", "is_pivot").join(
        ind.select("symbol", "week_end_date", "rsi12", "macd_hist"), ["symbol", "week_end_date"], "left")
    point = F.struct("idx", "close", "rsi12", "macd_hist")
    before = F.last(F.when(F.col("is_pivot"), point), True).over(W().rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("_p", F.struct("is_pivot", point.alias("cur"), before.alias("prev")))
    x = x.withColumn("_p", F.lag("_p", PIVOT_SIDE).over(W()))
    cur, prev = F.col("_p.cur"), F.col("_p.prev")
    higher = F.coalesce(cur["rsi12"] > prev["rsi12"], F.lit(False)) | F.coalesce(cur["macd_hist"] > prev["macd_hist"], F.lit(False))
    reason = (F.when(F.col("idx") < 2 * PIVOT_SIDE, "insufficient_history").when(~F.col("_p.is_pivot"), "no_pivot_confirmed")
              .when(prev.isNull(), "single_pivot").when(F.col("idx") - prev["idx"] > DIVERGENCE_LOOKBACK, "outside_lookback")
              .when((cur["close"] < prev["close"]) & higher, "condition_met").otherwise("condition_not_met"))
    return x.select("symbol", "idx", "week_end_date", reason.alias("div_reason"))


def duration(tl: DataFrame) -> DataFrame:
    gone = F.col("idx") - F.col("decl_idx")
    reason = F.when(gone.isNull(), "no_decline_start").when(gone >= DURATION_WEEKS, "condition_met").otherwise("condition_not_met")
    return tl.withColumns({"dur_reason": reason, "dur_trigger": F.coalesce(gone == DURATION_WEEKS, F.lit(False))})


def recent(flag: Column, value: Column) -> Column:
    """Latest flagged week among the last active weeks that share the anchor."""
    w = Window.partitionBy("symbol", "low_date", "is_fallback").orderBy("idx").rangeBetween(-(ACTIVE_WEEKS - 1), 0)
    return F.max(F.when(flag, value)).over(w)


def exhaustion_facts(tl: DataFrame, weeks: DataFrame, cal: DataFrame, ind: DataFrame) -> DataFrame:
    """Five signal rows per completed week from the anchor timeline. An ended episode switches active signals off and
    caps active_until."""
    x = episode_end(duration(no_new_low(dryup(tl))))
    x = x.join(divergence(weeks, ind).drop("week_end_date"), ["symbol", "idx"])
    x = x.join(projected_ends(indexed(weeks), cal).select("symbol", "idx", "until"), ["symbol", "idx"])
    mark = F.struct("idx", "until", "week_end_date")
    x = x.withColumns({"_pt": recent(F.col("panic"), mark), "_dt": recent(F.col("div_reason") == "condition_met", mark)})
    ended = F.col("end_idx").isNotNull()
    none = F.lit(None).cast("date")

    def held(t, now, miss):
        """State of a signal that stays active some weeks after its trigger."""
        hit = t.isNotNull()
        until = F.when(ended & (F.col("end_idx") <= t["idx"] + ACTIVE_WEEKS - 1), F.col("end_week")).otherwise(t["until"])
        return hit, now, F.when(hit, until), F.when(now, "condition_met").when(hit, "holding_active").otherwise(miss)

    def row(name, active, trig, until, reason):
        off = ended & active
        return F.struct(
            F.lit(name).alias("signal"), F.when(active & ~off, "active").otherwise("inactive").alias("state"),
            (trig & active & ~off).alias("triggered"),
            F.when(off, F.least(until, F.col("end_week"))).otherwise(until).alias("active_until"),
            F.when(off, F.lit("episode_ended")).otherwise(reason).alias("reason"))
    dry = F.col("dry_reason") == "condition_met"
    nnl = F.col("nnl_reason").isin("confirmed", "holding")
    rows = F.array(
        row("panic", *held(F.col("_pt"), F.col("panic"), F.lit("condition_not_met"))),
        row("dry_up", dry, dry, F.when(dry, F.col("week_end_date")), F.col("dry_reason")),
        row("no_new_low_3w", nnl, F.col("nnl_reason") == "confirmed", none, F.col("nnl_reason")),
        row("divergence", *held(F.col("_dt"), F.col("div_reason") == "condition_met", F.col("div_reason"))),
        row("duration", F.col("dur_reason") == "condition_met", F.col("dur_trigger"), none, F.col("dur_reason")))
    return x.select("symbol", F.col("week_end_date").alias("observed_on"),
                    anchor_id(F.lit("panic_low"), F.col("low_date")).alias("anchor_id"), F.explode(rows).alias("f")).select(
        "symbol", "observed_on", "anchor_id", "f.*")


def active_counts(facts: DataFrame, min_active: int = MIN_ACTIVE) -> DataFrame:
    """Distinct active signals per week and anchor, then the best anchor of the week (smallest id on ties)."""
    g = facts.groupBy("symbol", "observed_on", "anchor_id").agg(
        F.countDistinct(F.when(F.col("state") == "active", F.col("signal"))).alias("n"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("state") == "active", F.col("signal")))), ",").alias("signals"))
    best = F.min_by(F.struct("anchor_id", "n", "signals"), F.struct(-F.col("n"), F.col("anchor_id"))).alias("b")
    return g.groupBy("symbol", "observed_on").agg(best, (F.max("n") >= min_active).alias("meets_min")).select(
        "symbol", "observed_on", F.col("b.anchor_id").alias("anchor_id"), F.col("b.n").alias("active_count"),
        F.col("b.signals").alias("active_signals"), "meets_min")
