"""Accumulation pattern: breakdown, quiet consolidation, probes, confirmation."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tapeloom.functions.columns import nonzero, previous, series, trailing
from tapeloom.params import (BREAKDOWN_DROP, BREAKDOWN_LOW_DAYS, BREAKDOWN_VOLUME, CONFIRM_VOLUME, CONSOLIDATION_EXPIRY,
                             CONSOLIDATION_MAX, CONSOLIDATION_MIN, CONSOLIDATION_RANGE, CONSOLIDATION_VOLUME, CONTINUE_DROP,
                             MA_SPREAD, PROBE_AMPLITUDE, PROBE_SHADOW, PROBE_VOLUME)


def inputs(bars: DataFrame) -> DataFrame:
    """Adjusted complete bars with the volume base and the spread of the short averages."""
    f = nonzero("price_adj_factor")
    x = bars.where("open_raw is not null and high_raw is not null and low_raw is not null and close_raw is not null and volume_raw is not null")
    x = x.select("symbol", "trade_date", *[(F.col(f"{k}_raw") * f).alias(k) for k in ("open", "high", "low", "close")],
                 (F.col("volume_raw") / nonzero("share_factor")).alias("volume"))
    w = series("symbol")
    x = x.withColumns({"vol_base": previous(F.avg, "volume", w, 20), "prev_close": F.lag("close").over(w),
                       **{f"ma{n}": trailing(F.avg, "close", w, n) for n in (5, 10, 20)}})
    spread = (F.greatest("ma5", "ma10", "ma20") - F.least("ma5", "ma10", "ma20")) / F.nullif(F.col("ma20"), F.lit(0.0))
    return x.withColumn("ma_spread", F.when(F.col("ma5").isNotNull() & F.col("ma10").isNotNull() & F.col("ma20").isNotNull(), spread))


def breakdown(x: DataFrame) -> DataFrame:
    """Drop of 5 % or more on twice the base volume to a 60-day closing low."""
    w = series("symbol")
    low60 = trailing(F.min, "close", w, BREAKDOWN_LOW_DAYS)
    y = x.withColumn("_low60", low60)
    cond = ((F.col("close") / F.col("prev_close") - 1.0 <= -BREAKDOWN_DROP) & (F.col("volume") >= BREAKDOWN_VOLUME * F.col("vol_base"))
            & (F.col("close") <= F.col("_low60")))
    reason = (F.when(F.col("prev_close").isNull() | F.col("_low60").isNull(), "insufficient_history")
              .when(F.col("prev_close") <= 0, "invalid_prev_close").when(F.coalesce(cond, F.lit(False)), "condition_met")
              .otherwise("condition_not_met"))
    return y.withColumn("breakdown_reason", reason).drop("_low60")


def probe(x: DataFrame) -> DataFrame:
    """Wide day with a long upper shadow on raised volume."""
    span = F.col("high") - F.col("low")
    amp = F.when(F.col("prev_close") > 0, span / F.col("prev_close")).otherwise(0.0)
    upper = F.when(span > 0, (F.col("high") - F.greatest("open", "close")) / span).otherwise(0.0)
    cond = (amp >= PROBE_AMPLITUDE) & (upper >= PROBE_SHADOW) & (F.col("volume") >= PROBE_VOLUME * F.col("vol_base"))
    return x.withColumn("is_probe", F.coalesce(cond, F.lit(False)))


class Pattern:
    """State of one symbol's pattern; ``day`` takes the next bar and returns its row."""

    def __init__(self):
        self.clear()
        self.ended = False

    def clear(self):
        self.state, self.base, self.close0, self.since, self.probes = "idle", None, None, 0, 0
        self.low = self.high = self.c_low = self.c_high = None
        self.volume, self.days, self.box, self.held = 0.0, 0, None, 0

    def widen(self, b):
        first = self.days == 0
        self.low = b.low if first else min(self.low, b.low)
        self.high = b.high if first else max(self.high, b.high)
        self.c_low = b.close if first else min(self.c_low, b.close)
        self.c_high = b.close if first else max(self.c_high, b.close)
        self.volume += b.volume
        self.days += 1

    def quiet(self, b):
        """Reason the window since the breakdown is or is not a consolidation."""
        if pd.isna(b.ma_spread):
            return "missing_ma"
        ok = (self.low > 0 and (self.high - self.low) / self.low <= CONSOLIDATION_RANGE
              and self.volume / self.days <= CONSOLIDATION_VOLUME * self.base and b.ma_spread <= MA_SPREAD)
        return "condition_met" if ok else "condition_not_met"

    def day(self, b):
        if self.ended:
            self.clear()
            self.ended = False
        if self.state == "idle":
            if b.breakdown_reason != "condition_met":
                return self.row(False, b.breakdown_reason)
            self.state, self.base, self.close0 = "watching", b.vol_base, b.close
            return self.row(True, "breakdown_detected")
        if self.state == "watching":
            self.since += 1
            self.widen(b)
            if self.since > CONSOLIDATION_MAX:
                return self.finish("failed", "expired_no_consolidation")
            if b.close < self.close0 * (1 - CONTINUE_DROP):
                return self.row(False, "still_falling")
            if self.since < CONSOLIDATION_MIN:
                return self.row(False, "waiting_min_days")
            why = self.quiet(b)
            if why != "condition_met":
                return self.row(False, why)
            self.state, self.box = "consolidating", (self.c_low, self.c_high)
            return self.row(True, "consolidation_confirmed")
        self.held += 1
        self.probes += bool(b.is_probe)
        if b.close < self.box[0]:
            return self.finish("failed", "box_broken")
        if b.close > self.box[1] and b.close > b.open and not pd.isna(b.vol_base) and b.volume >= CONFIRM_VOLUME * b.vol_base:
            return self.finish("confirmed", "breakout_confirmed")
        if self.held > CONSOLIDATION_EXPIRY:
            return self.finish("failed", "expired_consolidation")
        return self.row(False, "probe_detected" if b.is_probe else "holding")

    def finish(self, state, reason):
        self.state, self.ended = state, True
        return self.row(True, reason)

    def row(self, triggered, reason):
        low, high = self.box or (None, None)
        return self.state, triggered, reason, self.probes, low, high


def _scan(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("trade_date", ignore_index=True)
    p = Pattern()
    rows = [p.day(b) for b in pdf.itertuples(index=False)]
    out = pd.DataFrame(rows, columns=["state", "triggered", "reason", "probe_count", "box_low", "box_high"])
    out.insert(0, "symbol", pdf["symbol"])
    out.insert(1, "observed_on", pdf["trade_date"])
    return out


def accumulation(bars: DataFrame) -> DataFrame:
    """One row per symbol and day; tests are window columns, only the state walks the days in order."""
    return probe(breakdown(inputs(bars))).groupBy("symbol").applyInPandas(
        _scan, "symbol string, observed_on date, state string, triggered boolean, reason string, probe_count int, box_low double, box_high double")


def consolidation(bars: DataFrame) -> DataFrame:
    """Days on which a watched symbol was tested for consolidation, with the outcome and the box."""
    return accumulation(bars).where(F.col("reason").isin("consolidation_confirmed", "condition_not_met", "missing_ma") & (
        F.col("state").isin("watching", "consolidating"))).select("symbol", "observed_on", "reason", "box_low", "box_high")
